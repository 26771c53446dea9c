import collections
import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from kinlode.llm import mixing, quality, queries
from kinlode.llm.common import read_table
from tests.llm.test_near_dedup import brute_kept
from tests.llm.test_operators import brute_ids


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_against_brute_force(spark, sf_dir):
    """Each stage by plain Python on the rows that the stage before it kept; the classifier's decisions are taken as they are."""
    docs = read_table(spark, sf_dir, "documents")
    good = {r.doc_id for r in quality.score_quality(docs, read_table(spark, sf_dir, "labels")).collect() if r.accepted}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    owner = {}
    for key, r in rows.items():
        owner[r.text] = max(key, owner.get(r.text, key))
    keys = sorted(brute_kept([(k, rows[k].text) for k in sorted(owner.values())])[0])
    n = collections.Counter(rows[k].source for k in keys)
    total = sum(math.sqrt(x) for x in n.values())
    repeats = {}
    for k in keys:
        s = rows[k].source
        mean = len(keys) * math.sqrt(n[s]) / total / n[s]
        import hashlib

        u = (int(hashlib.md5(f"{mixing.SEED}:{k}:0".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        count, p = 0, math.exp(-mean)
        cdf = p
        while cdf < u:
            count += 1
            p *= mean / count
            cdf += p
        repeats[k] = count
    want = collections.Counter()
    for k, ids in zip(keys, brute_ids([rows[k].text for k in keys]), strict=True):
        for i in range(0, len(ids), 4096):
            part = ids[i : i + 4096]
            want[k, i // 4096, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += repeats[k]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, sf_dir, name):
    docs = read_table(spark, sf_dir, "documents").limit(60)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)
    assert out.columns == corpus_pipeline.COLUMNS and out.dtypes == docs.select(*corpus_pipeline.COLUMNS).dtypes
    assert out.count() > 0
    assert queries.queries()["pipeline"]
