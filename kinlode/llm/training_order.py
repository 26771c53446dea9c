"""Training-order materialisation.

Documents are cut into sequences of at most `length` tokens. Sequences are numbered 0..M-1: a task numbers its own, and
a small table with one row for each task holds what lies before it. A keyed Feistel network over the next even number of
bits, walked along its cycle until it falls below M, turns a sequence's number into its global slot, so the order is a
permutation that needs no sort key and can be computed for any slot alone. Partitions are ranges of slots, cut between
shards; as the slots are known to be 0..M-1, the cuts need no sample. Records have a fixed stride; shard s holds slots
s*R to (s+1)*R-1 in order, so a reader resumes at slot x by seeking to (x mod R) * stride of shard x div R. An id takes
two bytes if the whole vocabulary fits, else four.

Defined results: a null or empty text is one sequence with the end token alone. Rows that repeat an id are documents of
their own. An empty table gives no records. Other columns are ignored.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlode.llm import common
from kinlode.llm import kernels as K
from kinlode.llm.tokens import tokenizer

LENGTH, END_ID, PAD_ID, SHARD_RECORDS, SEED, ROUNDS = 512, 1, 0, 2048, 20240117, 4


def id_bytes(tokenizer_path: str, *ids: int) -> int:
    """2 if all ids of the tokenizer and those given fit 16 bits, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), *(i + 1 for i in ids)) <= 1 << 16 else 4


def sequences(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, width: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(task, nth, doc_id, piece, n_tokens, ids): one row for each sequence, ids little-endian without padding."""
    width = width or id_bytes(tokenizer_path, end_id)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, known, nth = TaskContext.get().partitionId(), tokenizer(tokenizer_path), 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, hi, raws in K.raw_slices(batch.column(1)):
                rows = []
                for key, tokens in zip(keys[lo:hi], known.texts(raws), strict=True):
                    tokens = np.append(tokens, np.uint32(end_id))
                    if width == 2 and tokens.max() > 0xFFFF:
                        raise OverflowError("a token id does not fit two bytes")
                    tokens = tokens.astype(f"<u{width}")
                    for piece, start in enumerate(range(0, len(tokens), length)):
                        part = tokens[start : start + length]
                        rows.append((task, nth, key, piece, len(part), part.tobytes()))
                        nth += 1
                yield pa.RecordBatch.from_arrays([pa.array(c) if i != 2 else pa.array(c, type=batch.column(0).type) for i, c in enumerate(zip(*rows, strict=True))], names=["task", "nth", "doc_id", "piece", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), common.whole(text_col)).mapInArrow(scan, f"task long, nth long, doc_id {kind}, piece long, n_tokens long, ids binary")


def bits_for(n: int) -> int:
    """The even number of bits, 2 at least, that holds 0..n-1."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits + bits % 2


def permute(total: int, seed: int):
    """permute(total, seed)(numbers) -> slots. Each walk ends: the network permutes its domain, which is less than four
    times as large as total, so a step falls below total with a chance of a quarter or more."""
    half = bits_for(total) // 2
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = (x >> np.uint64(half)) & mask, x & mask
        for r in range(ROUNDS):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & K.M64)
            left, right = right, left ^ (K.mix(right + key) & mask)
        return (left << np.uint64(half)) | right

    def slots(numbers: np.ndarray) -> np.ndarray:
        x = once(numbers.astype(np.uint64))
        while len(out := np.flatnonzero(x >= np.uint64(total))):
            x[out] = once(x[out])
        return x.astype(np.int64)

    return slots


def training_order(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, shard_records: int = SHARD_RECORDS, seed: int = SEED, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, piece, n_tokens, ids_crc32, record): fixed-stride records, a shard's records
    together and in order. record is n_tokens as 32 bits, then `length` ids, padded; ids_crc32 is of the ids."""
    width = id_bytes(tokenizer_path, end_id, pad_id)
    cut = common.materialise(sequences(docs, tokenizer_path, length, end_id, width), "sequences")
    per_task = cut.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first = common.materialise(first, "offsets")  # a row for each input split: of known size, so the sequences are not shuffled to join it
    total = cut.count()
    stride = 4 + width * length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = permute(total, seed)
        for batch in batches:
            slot = slots(batch.column("first").to_numpy() + batch.column("nth").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // shard_records), *(batch.column(c) for c in ("doc_id", "piece", "n_tokens", "ids"))], names=["slot", "shard", "doc_id", "piece", "n_tokens", "ids"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.full(length, pad_id, dtype=f"<u{width}").tobytes()
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            body = [(len(x) // width).to_bytes(4, "little") + x + pad[len(x) :] for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("slot", "shard", "doc_id", "piece", "n_tokens")), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(body, pa.binary())], names=["slot", "shard", "doc_id", "piece", "n_tokens", "ids_crc32", "record"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    placed = cut.join(first, "task").mapInArrow(place, f"slot long, shard long, doc_id {kind}, piece long, n_tokens long, ids binary")
    n = common.partitions(docs.sparkSession)
    shards = max(1, -(-total // shard_records))
    # range partitions of whole shards: the slots are 0..total-1, so the bounds are known and differ by a shard at most
    ordered = placed.repartitionById(n, F.floor(F.col("shard") * n / shards).cast("int")).sortWithinPartitions("slot")
    out = ordered.mapInArrow(records, f"slot long, shard long, doc_id {kind}, piece long, n_tokens long, ids_crc32 long, record binary")
    return out.withColumn("byte_offset", F.pmod("slot", F.lit(shard_records)) * stride)


def write_shards(ordered: DataFrame, uri: str) -> DataFrame:
    """Write one file for each shard below uri (any store that pyarrow opens) and return (shard, path, records, bytes).
    A file is written under the attempt's name and then moved, so a task that is run again leaves one whole file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        attempt, now, sink, done = TaskContext.get().taskAttemptId(), None, None, []

        def end() -> None:
            if sink is not None:
                sink.close()
                store.move(f"{root}/.{now:08d}-{attempt}", f"{root}/shard-{now:08d}.bin")

        for batch in batches:
            for shard, record in zip(batch.column("shard").to_pylist(), batch.column("record").to_pylist(), strict=True):
                if shard != now:
                    end()
                    now, sink = shard, store.open_output_stream(f"{root}/.{shard:08d}-{attempt}")
                    done.append([shard, f"{root}/shard-{shard:08d}.bin", 0, 0])
                sink.write(record)
                done[-1][2] += 1
                done[-1][3] += len(record)
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["shard", "path", "records", "bytes"])

    return ordered.select("shard", "record").mapInArrow(write, "shard long, path string, records long, bytes long")


def read_slots(root: str, start: int, count: int, shard_records: int = SHARD_RECORDS, length: int = LENGTH, width: int = 2) -> list[np.ndarray]:
    """The ids of `count` slots from `start` on, by seeking in shard files of a local or mounted folder."""
    stride, out = 4 + width * length, []
    for slot in range(start, start + count):
        with open(f"{root}/shard-{slot // shard_records:08d}.bin", "rb") as file:
            file.seek(slot % shard_records * stride)
            record = file.read(stride)
        out.append(np.frombuffer(record, f"<u{width}", offset=4)[: int.from_bytes(record[:4], "little")])
    return out
