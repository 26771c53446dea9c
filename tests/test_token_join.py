"""The tiled token join against brute force over all pairs."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from kinlode.operators import blocking, token_join
from kinlode.plans import queries

SCHEMA = "row_id long, source int, country string, addr_empty boolean, name array<string>, addrw array<string>"


def brute(rows, params):
    df, n, out = collections.Counter(), collections.Counter(), set()
    tokens = lambda r: {("name", t) for t in r[4]} | {("addrw", t) for t in r[5]}
    for r in rows:
        if r[1] != 1 and r[2] is not None:
            n[r[2]] += 1
            df.update((r[2], *t) for t in tokens(r))
    for q in (r for r in rows if r[1] == 1):
        channels = collections.defaultdict(list)
        for r in rows:
            met = [t for t in tokens(q) & tokens(r) if df[(q[2], *t)] <= params.max_df] if r[1] != 1 and r[2] == q[2] is not None else []
            if met:
                score = round(sum(math.log(n[q[2]] / df[(q[2], *t)]) for t in sorted(met)), 9)
                channels[r[1], r[3] and bool(params.k_empty)].append((-score, r[0]))
        for (_, empty), found in channels.items():
            out |= {(q[0], r, round(-s, 6), i) for i, (s, r) in enumerate(sorted(found)[: params.k_empty if empty else params.k])}
    return out


@pytest.mark.parametrize("chunk, k, k_empty, max_df", [(1 << 17, 4, 2, 60), (40, 4, 2, 60), (25, 3, 0, 30), (1 << 17, 500, 500, 500)])
def test_blocking_against_brute_force(spark, monkeypatch, chunk, k, k_empty, max_df):
    """Equal records, a token of all records (weight 0, no reason to lose a pair), tokens above the cap, several chunks and lanes."""
    monkeypatch.setattr(token_join, "CHUNK", chunk)
    monkeypatch.setattr(token_join, "LANE", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, 1 + i % 3, rng.choice(["a", "b", None]) if i % 9 else "a", i % 5 == 0, rng.sample(words[:20], rng.randint(0, 4)), rng.sample(words, rng.randint(0, 3))) for i in range(300)]
    rows += [(300 + i, 1 + i % 3, "c", False, ["all", *(["same"] if i % 4 else [])], []) for i in range(60)]
    params = blocking.BlockingParams(k=k, k_empty=k_empty, max_df=max_df, types=("name", "addrw"))
    got = blocking.block(spark.createDataFrame(rows, SCHEMA).repartition(3), params).withColumn("score", F.round("score", 6)).collect()
    assert len(got) == len({(r.q, r.r) for r in got}) and {(r.q, r.r, r.score, r.rank) for r in got} == brute(rows, params)


def test_only_the_best_come_back(spark):
    """Of 900 pairs that share a token no more than the best of each channel leave their tile."""
    rows = [(i, 1 + i % 3, "a", False, ["same", f"x{i}"], []) for i in range(90)]
    pairs = blocking.scored_pairs(spark.createDataFrame(rows, SCHEMA), blocking.BlockingParams(k=2, types=("name", "addrw")))
    assert pairs.count() == 30 * 2 * 2


def test_candidates_are_read_from_a_table(spark, sf_dir):
    """Queries on the candidates do not block again for each use."""
    found = queries.cands(spark, sf_dir)
    assert "Window" not in found._jdf.queryExecution().toString() and len(found.inputFiles()) > 0
