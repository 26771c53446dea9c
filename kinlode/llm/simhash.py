"""SimHash near-dedup by bit-sliced comparison.

Fingerprints are compared only where they agree on two of six bit blocks: four differing bits touch at most four
blocks, so every pair within the radius meets in one of the fifteen tables at least; larger tables of fingerprints take
seven or eight blocks, so that a bucket's key has more bits. A bucket larger than a tile is cut
into chunks and every pair of chunks is a tile of its own, so no bucket, however large, is one task's work. In a tile
the fingerprints lie as bit planes; carry-save counters add up the differing planes of 64 comparisons a machine word,
and words whose comparisons have all passed the radius are abandoned. A tile returns a forest of its links, not the
pairs, and the components follow from star contraction.

Defined results: a null or empty text has fingerprint zero, which is linked like any other. Rows with the same id and
text have one fingerprint and come out one by one. A null id links its row by its fingerprint like any other but is never
the smallest id; a component of null ids only has a null component. Empty tables give empty results. Other columns are
ignored by near_duplicates() and carried by keep_one(), where of each component the row of the smallest id stays (null
ids last, then by content); rows that repeat an id and a text stay or go together.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlode.llm import common
from kinlode.llm import kernels as K
from kinlode.llm.graph import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Bits that are cut into blocks, and up to how many fingerprints by so many blocks (above: by one more than the last).
BITS, MOST = 64, {6: 1 << 28, 7: 1 << 33}
#: Fingerprints that a chunk of a bucket holds; a tile holds two chunks.
TILE = 1024
#: Comparisons that are made at once.
LANES = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text; bit b is set if it is set in more than half of the shingle hashes."""
    words = raw.translate(K.LOWER).split()
    n = len(words)
    if not n:
        return 0
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(text, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n)
    start = np.cumsum(size + 1) - size - 1
    ends = (start + size)[shingle - 1 :].tolist()
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(start[: n - shingle + 1].tolist(), ends, strict=True)], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def blocks_for(n: int) -> list[int]:
    """Widths of the blocks for n fingerprints."""
    count = next((k for k, most in MOST.items() if n <= most), max(MOST) + 1)
    return [BITS // count + (i < BITS % count) for i in range(count)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tkey, fp): the row's key by content, and fp as a signed long."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(raw, shingle) for _, _, raws in K.raw_slices(batch.column(2)) for raw in raws], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "tkey", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), common.content_key(id_col, text_col), common.whole(text_col)).mapInArrow(scan, f"doc_id {kind}, tkey long, fp long")


class Counter:
    """Bit-sliced counts of ones, three bits and a sticky overflow, for 64 lanes in each word."""

    def __init__(self, shape: tuple, radius: int):
        self.ones, self.twos, self.fours, self.over = (np.zeros(shape, dtype=np.uint64) for _ in range(4))
        self.radius = radius

    @staticmethod
    def _add(a, b, c):
        half = a ^ b
        return half ^ c, (a & b) | (half & c)

    def add4(self, a, b, c, d) -> None:
        self.ones, x = self._add(self.ones, a, b)
        self.ones, y = self._add(self.ones, c, d)
        self.twos, z = self._add(self.twos, x, y)
        carry = self.fours & z
        self.fours ^= z
        self.over |= carry

    def dead(self) -> np.ndarray:
        """Lanes whose count has passed the radius, which is at most 7."""
        out = self.over.copy()
        for value in range(self.radius + 1, 8):
            hit = np.full_like(out, ~np.uint64(0))
            for bit, plane in ((1, self.ones), (2, self.twos), (4, self.fours)):
                hit &= plane if value & bit else ~plane
            out |= hit
        return out

    def keep(self, at: np.ndarray) -> None:
        self.ones, self.twos, self.fours, self.over = (x[at] for x in (self.ones, self.twos, self.fours, self.over))


def planes(values: np.ndarray) -> np.ndarray:
    """64 bit planes of values; plane b has bit b of value i at bit i % 64 of word i // 64. Lanes are padded by zeros."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little").astype(bool)


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the pairs (x[i], y[i]) differ in at most radius bits."""
    differ = planes(x ^ y)
    alive = np.arange(differ.shape[1])
    count = Counter(alive.shape, radius)
    for p in range(0, 64, 4):
        count.add4(*(differ[p + i][alive] for i in range(4)))
        if p in (12, 20, 28, 40):
            at = np.flatnonzero(count.dead() != ~np.uint64(0))
            if len(at) < len(alive):
                alive = alive[at]
                count.keep(at)
            if not len(alive):
                break
    out = np.zeros((differ.shape[1], 64), dtype=bool)
    if len(alive):
        out[alive] = _lanes(~count.dead()).reshape(-1, 64)
    return out.reshape(-1)[: len(x)]


def close_in_block(queries: np.ndarray, block: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of each query i and member j of the block that differ in at most radius bits; the block's planes are laid
    out once, and a query's word of 64 members is abandoned once all of them have passed the radius."""
    vertical = planes(block)
    words = vertical.shape[1]
    bits = np.unpackbits(queries.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64)
    flip = np.uint64(0) - bits
    row, col = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), np.arange(words), indexing="ij"))
    count = Counter(row.shape, radius)
    for p in range(0, 64, 4):
        count.add4(*(vertical[p + i][col] ^ flip[row, p + i] for i in range(4)))
        if p in (12, 20, 28, 40):
            at = np.flatnonzero(count.dead() != ~np.uint64(0))
            if len(at) < len(row):
                row, col = row[at], col[at]
                count.keep(at)
            if not len(row):
                break
    if not len(row):
        return row, col
    word, lane = np.nonzero(_lanes(~count.dead()).reshape(-1, 64))
    member = col[word] * 64 + lane
    real = member < len(block)
    return row[word][real], member[real]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach over links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if np.array_equal(label, old):
            return label


def link_group(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Labels of one bucket larger than 64."""
    label = np.arange(len(fps))
    step = max(1, LANES * 16 // max(64, len(fps)))
    pairs = [close_in_block(fps[a : a + step], fps, radius) + (a,) for a in range(0, len(fps), step)]
    return _forest(len(label), np.concatenate([i + a for i, _, a in pairs]), np.concatenate([j for _, j, _ in pairs]))


def _small_groups(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row indices (i < j) of all pairs inside each of the groups."""
    left, right = [], []
    for n in np.unique(size):
        a, b = np.triu_indices(n, 1)
        base = first[size == n][:, None]
        left.append((base + a).ravel())
        right.append((base + b).ravel())
    return np.concatenate(left), np.concatenate(right)


def link_sorted(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) links that connect within each run of equal keys what differs in at most radius bits; fewer than rows."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(keys)))
    label = np.arange(len(keys))
    few = (size > 1) & (size <= 64)
    if few.any():
        cost = np.cumsum(size[few] * (size[few] - 1) // 2)
        part = cost // (4 * LANES)
        for p in np.unique(part):
            i, j = _small_groups(first[few][part == p], size[few][part == p])
            hit = close_pairs(fps[i], fps[j], radius)
            i, j = i[hit], j[hit]
            if len(i):
                rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                label[rows] = rows[_forest(len(rows), at[: len(i)], at[len(i) :])]
    for a, n in zip(first[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        label[a : a + n] = a + link_group(fps[a : a + n], radius)
    at = np.flatnonzero(label != np.arange(len(label)))
    return ids[at], ids[label[at]]


def _link(radius: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # keys come sorted; the last bucket may go on
            rest = [x[cut:] for x in now]
            if cut:
                a, b = link_sorted(now[0][:cut], now[1][:cut].view(np.uint64), now[2][:cut], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if rest is not None:
            a, b = link_sorted(rest[0], np.ascontiguousarray(rest[1]).view(np.uint64), rest[2], radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return scan


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) ids that connect all distinct fingerprints (fp, id) within the radius."""
    blocks, at = [], 0
    for width in blocks_for(prints.count()):
        blocks.append((at, width))
        at += width
    together = len(blocks) - radius
    if together < 1:
        raise ValueError(f"a radius below {len(blocks)} is supported")
    keys = []
    for t, chosen in enumerate(combinations(blocks, together)):
        key = F.lit(t).cast("long")
        for first, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    rows = prints.select("fp", "id", F.explode(F.array(*keys)).alias("key"))
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile).select("key", F.ceil(F.col("n") / tile).cast("int").alias("c"))
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    tiles = F.when(F.col("c").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.least(own, j) * F.col("c") + F.greatest(own, j)))
    dealt = rows.join(large, "key", "left").select("key", F.explode(tiles).alias("tile"), "fp", "id")
    dealt = dealt.select(F.xxhash64("key", "tile").alias("bucket"), "fp", "id")
    n = common.partitions(prints.sparkSession)
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_link(radius), "a long, b long").distinct()


def _grouped(docs: DataFrame, shingle: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written rows (doc_id, tkey, fp), and (fp, component) of the fingerprints that have a link; a component is named by
    one of its fingerprints, so rows without an id are linked like others."""
    rows = common.materialise(fingerprints(docs, shingle, id_col, text_col), "simhash")
    nodes = common.materialise(rows.select("fp", F.col("fp").alias("id")).distinct(), "simhash-nodes")
    return rows, components(links(nodes, radius)).withColumnRenamed("id", "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the smallest doc_id reachable."""
    rows, groups = _grouped(docs, shingle, radius, id_col, text_col)
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("id")).join(groups, "fp", "left")
    least = nodes.filter("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    owner = nodes.join(least, "component", "left").select("fp", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(owner, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, one document of each component."""
    rows, groups = _grouped(docs, shingle, radius, id_col, text_col)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tkey"))
    group = F.coalesce("component", "fp")
    stays = rows.join(groups, "fp", "left").groupBy(group.alias("component")).agg(best.alias("row")).select(F.col("row.doc_id").alias("_id"), F.col("row.tkey").alias("_tkey"))
    return docs.join(stays, docs[id_col].eqNullSafe(stays["_id"]) & (common.content_key(id_col, text_col) == stays["_tkey"]), "left_semi")
