"""Near duplicates by the Jaccard similarity of their sets of word shingles; no pair at or above the threshold is missed.

Two sets with a Jaccard of at least 4/5 share an element among the first n - ceil(4n/5) + 1 of each, in any one order of
all elements (prefix filter). The order puts shingles that a sample of the documents shows often last, so buckets of a
prefix shingle stay small; the sample changes the work, never the result. In a bucket, odd sketches (parities of the
shingles in a bin or more for each) differ in at most as many bits as the sets differ in elements, so a pair whose sketches
differ in more than (n + m) / 9 bits is out for certain. What is left is compared set by set.

Links come in three rounds, each checked by the sets themselves. The first is SimHash (simhash.py): fingerprints of the
same shingles, linked at four or fewer differing bits. Most pairs of similarity 0.8 to 0.95 differ in more, so the buckets
follow, for pairs that still lie in two components: first a spanning forest of the likeliest pairs of each bucket above
FEW documents and all pairs of the others, then all that is left.

Defined results: shingles are of lower-cased (ASCII) words; a text below five words is one shingle, and a text without
words is one, too. Rows are told apart by id and text, so a null id is no exception; of a component the row of the smallest
id stays, null ids last. Rows with the same id and text stay or go together. Shingles are compared by 64-bit hashes.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlode.llm import common, simhash
from kinlode.llm import kernels as K
from kinlode.llm.graph import components
from kinlode.llm.simhash import SEED, _forest, _small_groups

#: Words of a shingle, and bins of a sketch at least and at most (sets of more than twice the most all look alike).
SHINGLE, BINS, MOST_BINS = 5, 1 << 10, 1 << 16
#: Documents in the sample that finds frequent shingles, and shingles kept from it.
SAMPLE, FREQUENT = 5000, 20_000
#: Documents that a chunk of a bucket holds; a tile holds two chunks.
TILE = 256
#: Buckets up to this size give all their pairs at once.
FEW = 8
#: Bits of a node that the bitmap of nodes in pairs is over, at most.
MARKS = 28


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a UTF-8 text."""
    words = raw.translate(K.LOWER).split()
    n, text, digest = len(words), b" ".join(words), xxhash.xxh64_intdigest
    if n <= size:
        return np.array([digest(text, SEED)], dtype=np.uint64)
    width = np.fromiter(map(len, words), dtype=np.int64, count=n)
    start = np.cumsum(width + 1) - width - 1
    ends = (start + width)[size - 1 :].tolist()
    return np.unique(np.array([digest(text[a:b], SEED) for a, b in zip(start[: n - size + 1].tolist(), ends, strict=True)], dtype=np.uint64))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least 4/5."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 9 * both >= 4 * (len(x) + len(y))


def odd(found: np.ndarray, bins: int) -> bytes:
    """An odd sketch: the parity of the elements of each bin."""
    ones = np.bincount((found & np.uint64(bins - 1)).astype(np.int64), minlength=bins).astype(np.uint8) & 1
    return np.packbits(ones, bitorder="little").tobytes()


def sketch(found: np.ndarray) -> bytes:
    """An odd sketch of a bin or more for each element, up to MOST_BINS."""
    return odd(found, min(MOST_BINS, max(BINS, 1 << (len(found) - 1).bit_length())))


def wide(found: np.ndarray) -> bytes:
    """An odd sketch of four bins or more for each element."""
    return odd(found, 1 << max(10, (4 * len(found) - 1).bit_length()))


def apart(x: bytes, y: bytes) -> int:
    """In how many bins two wide sketches differ; the larger is folded to the size of the smaller."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefix(found: np.ndarray, often: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The elements one of which every similar set shares: the first in the order (place among the frequent, hash)."""
    n = len(found)
    rank = np.zeros(n, dtype=np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        rank = np.where(often[at] == found, place[at], 0)
    return found[np.lexsort((found, rank))][: n - (4 * n + 4) // 5 + 1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for lo, hi, raws in K.raw_slices(batch.column(1)):
            yield batch.column(0).slice(lo, hi - lo), [shingles(raw) for raw in raws]


def _longs(found: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, their places from rarer to commoner) of shingles that a sample shows three times or more."""

    def scan(batches):
        for _, found in _texts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    sample = texts.filter(F.pmod(F.xxhash64("node"), F.lit(max(1, texts.count() // SAMPLE))) == 0)
    rows = sample.mapInArrow(scan, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    often = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(often)
    return often[order], (len(rows) - np.arange(len(rows)))[order]


def described(texts: DataFrame) -> DataFrame:
    """(node, n, sketch, prefix)"""
    often, place = frequent(texts)

    def scan(batches):
        for nodes, found in _texts(batches):
            yield pa.RecordBatch.from_arrays([nodes, pa.array([len(f) for f in found], pa.int64()), pa.array([sketch(f) for f in found], pa.binary()), _longs([prefix(f, often, place) for f in found])], names=["node", "n", "sketch", "prefix"])

    return texts.mapInArrow(scan, "node long, n long, sketch binary, prefix array<long>")


def shared_keys(facts: DataFrame) -> DataFrame:
    """(node, key, size): the prefix shingles that two documents have; of keys with the same documents one is kept."""
    n = common.partitions(facts.sparkSession)
    keys = facts.select("node", F.explode("prefix").alias("key")).repartition(n, "key")  # one exchange for the counts and the join
    size = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("size > 1")
    found = common.materialise(keys.join(size, "key").select("node", "key", "size", "lo", "hi"), "near-keys")
    common.release(facts.sparkSession)
    part = lambda seed: F.sum(F.shiftright(F.xxhash64("node", F.lit(seed)), 28))
    members = found.groupBy("key", "size", "lo", "hi").agg(part(1).alias("x"), part(2).alias("y"))
    first = members.groupBy("size", "lo", "hi", "x", "y").agg(F.min("key").alias("key")).select("key")
    out = common.materialise(found.join(first, "key", "left_semi").select("node", "key", "size"), "near-keys")
    common.drop(found)
    return out


def tiles(shared: DataFrame, facts: DataFrame, tile: int = TILE) -> DataFrame:
    """(bucket, many, node, n, sketch, component): the documents of each shared key; buckets above a tile are cut."""
    c = F.ceil(F.col("size") / tile).cast("int")
    own = F.pmod(F.xxhash64("node"), c).cast("int")
    at = F.transform(F.sequence(F.lit(0), c - 1), lambda j: F.least(own, j) * c + F.greatest(own, j))
    dealt = shared.select("node", (F.col("size") > FEW).alias("many"), "key", F.explode(at).alias("tile"))
    return dealt.select(F.xxhash64("key", "tile").alias("bucket"), "many", "node").join(facts.select("node", "n", "sketch", "component"), "node")


def _possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, bits: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs that the sizes and sketches (bits, of so many bytes) leave possible, with their share of different
    bits; of two sketches the larger is folded to the size of the smaller."""
    fit = 5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])
    i, j = i[fit], j[fit]
    both, d = np.minimum(width[i], width[j]), np.zeros(len(i), dtype=np.int64)
    for size in np.unique(both).tolist():
        at = np.flatnonzero(both == size)
        rows, ends = np.unique(np.stack([i[at], j[at]]), return_inverse=True)
        ends, even = ends.reshape(2, -1), np.empty((len(rows), size // 8), dtype=np.uint64)
        for own in np.unique(width[rows]).tolist():
            these = width[rows] == own
            part = np.frombuffer(b"".join(bits[rows[these]]), dtype=np.uint64).reshape(-1, own // 8)
            while part.shape[1] > even.shape[1]:
                part = part[:, : part.shape[1] // 2] ^ part[:, part.shape[1] // 2 :]
            even[these] = part
        step = max(1, (1 << 23) // size)
        for a in range(0, len(at), step):
            d[at[a : a + step]] = np.bitwise_count(even[ends[0, a : a + step]] ^ even[ends[1, a : a + step]]).sum(axis=1, dtype=np.int64)
    ok = 9 * d <= n[i] + n[j]
    return i[ok], j[ok], d[ok] / (n[i[ok]] + n[j[ok]])


def _likeliest(size: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs, the least w first."""
    order = np.argsort(w, kind="stable")
    i, j, label, out = i[order], j[order], np.arange(size), np.zeros(len(order), dtype=bool)
    while True:
        open_ = np.flatnonzero(label[i] != label[j])
        if not len(open_):
            return i[out], j[out]
        ends = np.stack([label[i[open_]], label[j[open_]]], axis=1).ravel()
        out[open_[np.unique(ends, return_index=True)[1] // 2]] = True
        label = _forest(size, i[out], j[out])


def candidates(group: list[np.ndarray], again: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of two components from rows (bucket, many, node, n, bits, component) sorted by bucket."""
    bucket, many, node, n, bits, component = group
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(first, len(bucket)))
    width = np.fromiter(map(len, bits), dtype=np.int64, count=len(bits))
    left, right = [], []
    few = (size > 1) & ~many[first]
    if few.any() and not again:
        i, j = _small_groups(first[few], size[few])
        apart = component[i] != component[j]
        i, j, _ = _possible(i[apart], j[apart], n, bits, width)
        left.append(i), right.append(j)
    for a, m in zip(first[(size > 1) & many[first]].tolist(), size[(size > 1) & many[first]].tolist(), strict=True):
        i, j = np.triu_indices(m, 1)
        apart = component[a + i] != component[a + j]
        i, j, w = _possible(i[apart] + a, j[apart] + a, n, bits, width)
        if not again:
            i, j = _likeliest(m, i - a, j - a, w)
            i, j = i + a, j + a
        left.append(i), right.append(j)
    none = np.zeros(0, dtype=np.int64)
    x, y = node[np.concatenate([none, *left])], node[np.concatenate([none, *right])]
    return np.minimum(x, y), np.maximum(x, y)


def possible_pairs(rows: DataFrame, again: bool) -> DataFrame:
    """(a, b) from (bucket, many, node, n, sketch, component)."""

    def scan(batches):
        rest = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # buckets come sorted; the last may go on
            rest = [x[cut:] for x in now]
            if cut:
                yield pa.RecordBatch.from_arrays([*map(pa.array, candidates([x[:cut] for x in now], again))], names=["a", "b"])
        if rest is not None:
            yield pa.RecordBatch.from_arrays([*map(pa.array, candidates(rest, again))], names=["a", "b"])

    dealt = rows.select("bucket", "many", "node", "n", "sketch", "component").repartition(common.partitions(rows.sparkSession), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(scan, "a long, b long").distinct()


def marks(pairs: DataFrame) -> np.ndarray:
    """A bitmap over the low bits of the nodes of written pairs (a, b); of 4 MB a million pairs, 32 MB at most. A node whose
    bit is not set is in no pair."""
    bits = min(MARKS, max(15, (32 * pairs.count()).bit_length()))
    at = F.explode(F.array("a", "b")).alias("node")
    bit = pairs.select(at).select(F.col("node").bitwiseAND(F.lit((1 << bits) - 1)).alias("bit"))
    parts = bit.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("map")).collect()
    out = np.zeros((1 << bits - 15, 4096), dtype=np.uint8)
    for row in parts:
        out[row["part"]] = np.frombuffer(row["map"], np.uint8)
    return out.ravel()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the written pairs (a, b) whose sets are similar. Texts are not shuffled: the wide sketches and sets of those
    that the bitmap of marked nodes lets through are written down. Pairs are joined with both sketches first, a sixteenth of
    a set each, and only what these leave possible with both sets."""
    marked = pairs.sparkSession.sparkContext.broadcast(marks(pairs))

    def wanted(batches):
        for batch in batches:
            low = batch.column(0).to_numpy().view(np.uint64) & np.uint64(8 * len(marked.value) - 1)
            hit = marked.value[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1
            yield batch.filter(pa.array(hit.astype(bool)))

    def sets(batches):
        for nodes, found in _texts(wanted(batches)):
            columns = [pa.array([len(f) for f in found], pa.int64()), pa.array([wide(f) for f in found], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([nodes, *columns], names=["node", "n", "wide", "set"])

    def both(pairs, *columns):
        """(a, b) and the columns of each."""
        for end in "ab":
            pairs = pairs.join(have.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in columns]), end)
        return pairs.select("a", "b", *[f"{end}_{c}" for c in columns for end in "ab"])

    def possible(batches):
        for batch in batches:
            keep = [9 * apart(x.as_py(), y.as_py()) <= n.as_py() + m.as_py() for n, m, x, y in zip(*batch.columns[2:], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def scan(batches):
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(*batch.columns[2:], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    have = common.materialise(texts.mapInArrow(sets, "node long, n long, wide binary, set binary"), "near-sets")
    left = common.materialise(both(pairs, "n", "wide").mapInArrow(possible, "a long, b long"), "near-pairs")
    out = common.materialise(both(left, "set").mapInArrow(scan, "a long, b long"), "near-links")
    for table in (have, left):
        common.drop(table)
    common.release(pairs.sparkSession)
    return out


def alike(prints: DataFrame) -> DataFrame:
    """(a, b) from written (node, fp): pairs that connect all nodes whose fingerprints SimHash links."""
    first = common.materialise(prints.groupBy("fp").agg(F.min("node").alias("id")), "near-prints")
    same = prints.join(first, "fp").filter("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    return same.unionAll(simhash.links(first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def with_component(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """nodes with the component of each, itself where it has none."""
    out = nodes.join(groups.select(F.col("id").alias("node"), "component"), "node", "left")
    return out.withColumn("component", F.coalesce("component", "node"))


def near_groups(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(id, component) of the nodes (content keys) that have a near duplicate."""
    texts = docs.select(common.content_key().alias("node"), common.whole().alias("text"))
    if not texts.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])
    prints = common.materialise(simhash.fingerprints(docs, SHINGLE).select(F.col("tkey").alias("node"), "fp").distinct(), "near-prints")
    links = verified(common.materialise(alike(prints), "near-pairs"), texts)
    common.release(docs.sparkSession)
    facts = common.materialise(with_component(described(texts), components(links)), "near-facts")
    shared = shared_keys(facts)
    rows = common.materialise(tiles(shared, facts, tile), "near-tiles")
    for table in (prints, facts, shared):
        common.drop(table)
    common.release(docs.sparkSession)
    tried = common.materialise(possible_pairs(rows, False), "near-pairs")
    links = links.unionAll(verified(tried, texts))
    common.release(docs.sparkSession)
    groups = components(links)
    more = common.materialise(possible_pairs(with_component(rows.filter("many").drop("component"), groups), True).join(tried, ["a", "b"], "left_anti"), "near-pairs")
    if not more.isEmpty():
        groups = components(links.unionAll(verified(more, texts)))
    for table in (rows, tried, more):
        common.drop(table)
    return groups


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one document of each component."""
    groups = near_groups(docs)
    keyed = docs.withColumn("_node", common.content_key())
    members = keyed.select(F.col("_node").alias("id"), "doc_id").join(groups, "id")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "id"))
    gone = groups.join(members.groupBy("component").agg(best["id"].alias("stays")), "component").filter("id <> stays").select(F.col("id").alias("_node"))
    return keyed.join(gone, "_node", "left_anti").select(*docs.columns)
