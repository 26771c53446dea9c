import random

import numpy as np
import pytest

import corpus_pipeline
from kinlode.llm import near_dedup
from kinlode.llm.common import read_table


def brute_kept(rows):
    """Positions kept: all pairs of five-word sets compared, components joined, the smallest id of each stays."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    best = {}
    for (key, _), x in zip(rows, label, strict=True):
        if key is not None:
            best[x] = min(key, best.get(x, key))
    return set(best.values()), sum(x not in best for x in set(label))


def mutated(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"z{rng.randrange(10**9)}"
    return " ".join(out)


def test_near_stage_on_table(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.near_stage(spark, docs, sf_dir)
    assert {r.doc_id for r in kept.collect()} == brute_kept(rows)[0]


@pytest.mark.parametrize("tile", [8, 256])
def test_near_groups_with_common_passages(spark, monkeypatch, tile):
    """Copies on both sides of the threshold, a group above a tile, a passage in all, texts without words, null ids."""
    monkeypatch.setattr(near_dedup.tiles, "__defaults__", (tile,))
    monkeypatch.setattr(near_dedup.near_groups, "__defaults__", (tile,))
    rng = random.Random(7)
    base = [[f"w{rng.randrange(500)}" for _ in range(150)] for _ in range(12)]
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [passage + " " + mutated(rng, b, n) for b in base for n in (0, 1, 2, 3, 4, 5, 6)] + [mutated(rng, base[0], rng.randint(1, 5)) for _ in range(60)]
    texts += ["", " \n", None, "one two", "One  two", passage, passage + " end"]
    rows = list(enumerate(rng.sample(texts, len(texts))))
    rows += [(None, mutated(rng, base[1], 1)), (None, " ".join(f"n{k}" for k in range(80))), (None, " ".join(f"n{k}" for k in range(81)))]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    ids, nulls = brute_kept(rows)
    assert {r.doc_id for r in got if r.doc_id is not None} == ids and sum(r.doc_id is None for r in got) == nulls and len(got) == len(ids) + nulls


def test_near_empty(spark):
    assert near_dedup.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketch_never_exceeds_difference():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)) for _ in range(2))
        y = np.unique(np.concatenate([x[:50], y[:10]]))
        d = int.from_bytes(near_dedup.sketch(x)) ^ int.from_bytes(near_dedup.sketch(y))
        assert d.bit_count() <= len(np.setxor1d(x, y))


def test_wide_sketches_never_exceed_the_difference():
    """Also between sketches of different sizes; of sets far apart they say so."""
    rng = np.random.default_rng(6)
    for n, m in ((250, 256), (256, 260), (300, 300), (2000, 2100)):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for shared in (0, n // 2, n - n // 10, n):
            y = np.unique(np.concatenate([x[:shared], rng.integers(0, 1 << 63, m - shared, dtype=np.uint64)]))
            d, real = near_dedup.apart(near_dedup.wide(x), near_dedup.wide(y)), len(np.setxor1d(x, y))
            assert d <= real and d == near_dedup.apart(near_dedup.wide(y), near_dedup.wide(x))
            assert 9 * real > n + m or 9 * d <= n + m
            assert 9 * real < 1.3 * (n + m) or 9 * d > n + m


def test_marks_hold_every_node(spark):
    rng = np.random.default_rng(7)
    nodes = rng.integers(-(1 << 63), 1 << 63, 400)
    found = near_dedup.marks(spark.createDataFrame([(int(a), int(b)) for a, b in nodes.reshape(-1, 2)], "a long, b long"))
    low = nodes.view(np.uint64) & np.uint64(8 * len(found) - 1)
    assert (found[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).all()
    assert 200 < int(np.bitwise_count(found).sum()) <= 400


def test_near_groups_link_by_simhash(spark, monkeypatch):
    """What SimHash links is found without the buckets, and only what the sets confirm."""
    monkeypatch.setattr(near_dedup, "possible_pairs", lambda rows, again: spark.createDataFrame([], "a long, b long"))
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    texts = [" ".join(words), " ".join(words + ["end"]), " ".join(words) + "  ", " ".join(reversed(words)), "", " \n"]
    got = near_dedup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()
    assert {r.doc_id for r in got} == brute_kept(list(enumerate(texts)))[0] == {0, 3, 4}


def test_sketches_of_long_sets_tell_them_apart():
    """Long documents that share a passage give no pair; those at the threshold give one, across sizes of sketches as well."""
    rng = np.random.default_rng(8)
    fresh = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    passage, long = fresh(40), fresh(4000)
    sets = [np.unique(np.concatenate([passage, fresh(n)])) for n in (2500, 3000, 4000, 5000, 5500, 8000, 12000)]
    sets += [np.unique(np.concatenate([passage, long])), np.unique(np.concatenate([passage, long, fresh(400)]))]
    m = len(sets)
    n, bits = np.array(list(map(len, sets))), np.array(list(map(near_dedup.sketch, sets)), dtype=object)
    assert len(bits[m - 2]) < len(bits[m - 1])
    for again in (False, True):
        a, b = near_dedup.candidates([np.zeros(m, np.int64), np.ones(m, bool), np.arange(m), n, bits, np.arange(m)], again)
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(m - 2, m - 1)]
