"""Best-fit packing after Martello-Toth dominance reduction.

Only the lengths of the pieces matter, and there are at most `capacity` of them, so the packing is planned on a table of
counts by length whose size has nothing to do with the number of documents. The reduction fixes bins of up to three
pieces that provably dominate all other bins with their largest piece; what remains is packed by best-fit decreasing,
a whole class of equal pieces and equal bins at a time. Pieces then look up their place by (length, rank within length).

Defined results: a null or empty text is one piece with the end token alone. Rows that repeat an id and a text are
packed as documents of their own. An empty table gives an empty result. Other columns are ignored.
"""

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlode.llm import common
from kinlode.llm import kernels as K
from kinlode.llm.tokens import tokenizer

CAPACITY = 4096
END_ID = 1


class _Counts:
    """Pieces left, by length, with the lengths that have any in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.n)

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            del self.n[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest_to(self, room: int) -> int | None:
        i = bisect_left(self.sizes, room + 1)
        return self.sizes[i - 1] if i else None

    def smallest(self, k: int, without: int) -> int | None:
        """Sum of the k smallest pieces besides one piece of size `without`; None if there are fewer."""
        total = 0
        for s in self.sizes:
            have = self.n[s] - (s == without)
            use = min(k, have)
            total, k = total + use * s, k - use
            if not k:
                return total
        return None


def _best_pair(left: _Counts, size: int, room: int) -> tuple[int, int] | None:
    """The two further pieces with the largest sum within room (one piece of `size` is already used)."""
    best = None
    have = lambda s: left.n.get(s, 0) - (s == size)
    lo, hi = 0, bisect_left(left.sizes, room + 1) - 1
    while 0 <= lo <= hi:
        a, b = left.sizes[lo], left.sizes[hi]
        if a + b > room or not have(b):
            hi -= 1
            continue
        ok = have(a) >= 1 + (a == b)
        if ok and (best is None or a + b > sum(best)):
            best = (b, a)
        lo += 1
    return best


def _triple(left: _Counts, size: int, mate: int, pair: tuple[int, int], room: int) -> bool:
    """Whether a pair with the largest piece that fits beside `size` dominates: its smaller piece cannot be traded for
    two larger ones."""
    if pair[0] != mate:
        return False
    between, two = 0, []
    for s in left.sizes[bisect_left(left.sizes, pair[1] + 1) :]:
        have = left.n[s] - (s == size)
        between += have if s < mate else 0
        two += [s] * min(2, have)
        if len(two) >= 2:
            break
    return between <= 1 or sum(two[:2]) > room


def reduce_bins(left: _Counts, capacity: int) -> list[tuple[list[int], int]]:
    """Bins fixed by dominance, as (lengths, how many such bins). A set with the largest piece j dominates all other bins
    that hold j when j is alone and nothing fits beside it; when j and the largest piece that fits fill the bin, or only
    one piece fits, or at most two fit and no pair of them exceeds that piece; or when at most two fit and the best pair
    has that piece and cannot be bettered. Taking such a set leaves its condition true for the next copies of the same
    lengths, so all copies are fixed in one step."""
    fixed: list[tuple[list[int], int]] = []
    changed = True
    while changed:
        changed = False
        for size in list(reversed(left.sizes)):
            while (n := left.n.get(size, 0)) > 0:
                room = capacity - size
                one, two, three = (left.smallest(k, size) for k in (1, 2, 3))
                if one is None or one > room:
                    bin_ = [size]
                else:
                    mate = left.largest_to(room)
                    if mate == size and n == 1:
                        i = bisect_left(left.sizes, size)
                        mate = left.sizes[i - 1]
                    bin_ = [size, mate]
                    if size + mate < capacity and two is not None and two <= room:
                        if three is not None and three <= room:
                            break
                        pair = _best_pair(left, size, room)
                        if pair is not None and sum(pair) > mate:
                            if not _triple(left, size, mate, pair, room):
                                break
                            bin_ = [size, *pair]
                times = min(left.n[s] // bin_.count(s) for s in bin_)
                fixed.append((sorted(bin_, reverse=True), times))
                for s in bin_:
                    left.take(s, times)
                changed = True
    return fixed


def best_fit(left: _Counts, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over classes of equal pieces and equal bins."""
    rooms: dict[int, list[tuple[tuple, int]]] = {}
    order: list[int] = []
    closed: list[tuple[list[int], int]] = []

    def put(room: int, items: tuple, n: int) -> None:
        """items: (length, times) pairs, in the order of the bin."""
        if not room:
            closed.append(([s for s, m in items for _ in range(m)], n))
        elif room in rooms:
            rooms[room].append((items, n))
        else:
            rooms[room] = [(items, n)]
            insort(order, room)

    def add(items: tuple, size: int) -> tuple:
        if items and items[-1][0] == size:
            return (*items[:-1], (size, items[-1][1] + 1))
        return (*items, (size, 1))

    for size in sorted(left.n, reverse=True):
        n = left.n[size]
        while n:
            i = bisect_left(order, size)
            if i == len(order):
                each = capacity // size
                bins, rest = divmod(n, each)
                if bins:
                    put(capacity - each * size, ((size, each),), bins)
                if rest:
                    put(capacity - rest * size, ((size, rest),), 1)
                break
            room = order[i]
            items, bins = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            each = min(room // size, n)
            use = min(bins, n // each)
            if use < bins:
                put(room, items, bins - use)
            for _ in range(each):
                items = add(items, size)
            put(room - each * size, items, use)
            n -= use * each
    for room in order:
        closed.extend(([s for s, m in items for _ in range(m)], n) for items, n in rooms[room])
    left.n, left.sizes = {}, []
    return closed


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins for all pieces, as (lengths, how many such bins)."""
    left = _Counts(counts)
    return reduce_bins(left, capacity) + best_fit(left, capacity)


def placements(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """By (length, rank of a piece within its length): runs of ranks with the first bin's number, the pieces of this
    length in each bin and the offset of the first of them. Sorted by key = length << 44 | first rank."""
    used: dict[int, int] = {}
    rows, number = [], 0
    for lengths, n in bins:
        offset, i = 0, 0
        while i < len(lengths):
            size, j = lengths[i], i
            while j < len(lengths) and lengths[j] == size:
                j += 1
            rows.append((size << 44 | used.get(size, 0), number, j - i, offset))
            used[size] = used.get(size, 0) + n * (j - i)
            offset += (j - i) * size
            i = j
        number += n
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return dict(zip(("key", "bin", "each", "offset"), columns, strict=True))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth[, ids]) of every document cut into pieces of at most
    `capacity` tokens. nth counts the pieces of equal length within a task; ids are little-endian 32-bit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task, known = {}, TaskContext.get().partitionId(), tokenizer(tokenizer_path)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, raws in K.raw_slices(batch.column(1)):
                rows = []
                for key, tokens in zip(keys[lo:hi], known.texts(raws), strict=True):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), capacity)):
                        body = tokens[start : start + capacity].tobytes()
                        size = len(body) // 4
                        seen[size] = nth = seen.get(size, -1) + 1
                        rows.append((key, piece, start, size, zlib.crc32(body), task, nth, *[body] * ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())] + [("ids", pa.binary())] * ids
    schema = pa.schema([("doc_id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]), *fields])
    return docs.select(F.col(id_col), common.whole(text_col)).mapInArrow(scan, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * ids)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have been written down (their task and nth must not change)."""
    spark = cut.sparkSession
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(placements(plan_bins(counts, capacity)))
    columns = [f.name for f in cut.schema if f.name not in ("task", "nth")]
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("nth").to_numpy() + batch.column("first").to_numpy()
            p = plan.value
            run = np.searchsorted(p["key"], length << 44 | rank, side="right") - 1
            within = rank - (p["key"][run] & ((1 << 44) - 1))
            each = p["each"][run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(p["bin"][run] + within // each), pa.array(p["offset"][run] + within % each * length)], names=[*columns, "sequence_id", "offset"])

    return cut.join(first, ["length", "task"]).mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for every document."""
    return pack(common.materialise(pieces(docs, tokenizer_path, capacity, end_id, ids), "pieces"), capacity)
