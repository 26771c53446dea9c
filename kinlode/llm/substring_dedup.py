"""Substring dedup over a log-structured fingerprint index.

Every window of `window` consecutive words is represented by its smallest word n-gram hash (a minimiser), so equal
windows share a fingerprint and only about one word position in thirteen yields an index entry. The index is a list of
immutable runs, each a table bucketed and sorted by fingerprint. A batch becomes a run and is merge-joined with the runs
of history (none is shuffled again), which gives the fingerprints that now stand twice; runs are compacted by levels, so
that an entry is rewritten as often as the index doubles. Fingerprints that very many positions have are few: they are
broadcast, and only the others are joined by a shuffle. The windows that a repeated fingerprint stands for are verified
by 96 bits of independent hashes of all their words.

Defined results: a null text has no words. A text shorter than the window loses nothing. Rows that repeat an id and a
text count as copies of each other, so all their windows repeat, and each row comes out. Rows with a null id are
documents like any other. An empty table gives an empty result. Other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlode.llm import common
from kinlode.llm import kernels as K

WINDOW = 35
#: A fingerprint is hot if it has more than one in HOT of all positions; so fewer than HOT of a run's are.
HOT = 10_000
_WORD, _GRAM = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_CHECKS = ((0xD6E8FEB86659FD93, 0xA0761D6478BD642F), (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _shape(window: int) -> tuple[int, int]:
    """Words of an n-gram, and how many n-grams a window holds."""
    k = max(1, (window + 1) // 3 - 1)
    return k, window - k + 1


class _Chunk:
    """Word hashes, n-gram hashes and each window's smallest n-gram hash for a run of whole texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        self.data, self.window = data, window
        self.starts, self.ends, self.first = K.word_spans(data, offsets)
        k, width = _shape(window)
        self.grams = K.ngram_hashes(K.word_hashes(data, self.starts, self.ends, _WORD), k, _GRAM)
        self.least = K.sliding(self.grams, width, np.minimum)
        counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        last = np.repeat(self.first[1:], counts)
        self.valid = (np.arange(len(self.doc)) + window <= last)[: len(self.least)]
        self.width = width

    def selected(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of each n-gram position that is the smallest in some window."""
        if not len(self.least):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        pad = np.zeros(len(self.grams) + self.width - 1, dtype=np.uint64)
        pad[self.width - 1 : self.width - 1 + len(self.least)] = np.where(self.valid, self.least, 0)
        at = np.flatnonzero(K.sliding(pad, self.width, np.maximum) == self.grams)
        at = at[self.grams[at] > 0]
        return self.doc[at], self.grams[at]

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for the words of each window that starts at a word of `at`."""
        out = []
        for word, gram in _CHECKS:
            out.append(K.ngram_hashes(K.word_hashes(self.data, self.starts, self.ends, word), self.window, gram)[at])
        return out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _batches(columns: dict[str, pa.DataType], rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array(row[c], type=t) for c, t in columns.items()], names=list(columns))


def fingerprints(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tkey, fp, n): the window fingerprints of each document and at how many of its positions each stands."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, data, offsets in K.text_chunks(batch.column(1)):
                doc, fp = _Chunk(data, offsets, window).selected()
                order = np.lexsort((fp, doc))
                doc, fp = doc[order], fp[order]
                new = np.ones(len(fp), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(fp)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo + doc[at]]), pa.array(fp[at].view(np.int64)), pa.array(n)], names=["tkey", "fp", "n"])

    return docs.select(common.content_key(id_col, text_col).alias("tkey"), common.whole(text_col).alias("text")).mapInArrow(scan, "tkey long, fp long, n long")


class FingerprintIndex:
    """Sorted immutable runs of (fp, n), largest first; n counts the positions at which a fingerprint stands."""

    def __init__(self, spark: SparkSession, label: str = "fingerprints"):
        self.spark, self.label, self.buckets = spark, label, common.partitions(spark)
        self.runs: list[tuple[str, str, int, int]] = []

    def _write(self, rows: DataFrame) -> tuple[str, str, int, int]:
        """(name, path, fingerprints, positions) of a new run."""
        path = common.scratch_path(self.spark, self.label)
        name = "run_" + path.rsplit("-", 1)[1]
        rows.sortWithinPartitions("fp").write.bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).saveAsTable(name)
        return name, path, *self.spark.table(name).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def add(self, prints: DataFrame) -> None:
        """Append a batch as a run of its own."""
        counted = prints.groupBy("fp").agg(F.sum("n").alias("n"))
        self.runs.append(self._write(counted.repartition(self.buckets, "fp")))

    def ingest(self, prints: DataFrame) -> DataFrame:
        """Append a batch; returns a table (fp, hot) of its fingerprints that now stand at two positions or more, in the batch
        or in history: a merge join of the batch's run with each run before it."""
        self.add(prints)
        name, _, _, positions = self.runs[-1]
        new = self.spark.table(name)
        found = new.filter("n > 1")
        for old, *_ in self.runs[:-1]:
            found = found.unionAll(new.join(self.spark.table(old).select("fp"), "fp", "left_semi"))
        found = common.materialise(found.select("fp", (F.col("n") * HOT > positions).alias("hot")).distinct(), "repeated")
        self.level()
        return found

    def level(self) -> None:
        """Merge the last runs as long as the last is at least half as large as the one before."""
        while len(self.runs) > 1 and 2 * self.runs[-1][2] >= self.runs[-2][2]:
            self._merge()

    def compact(self) -> None:
        """Merge all runs into one."""
        while len(self.runs) > 1:
            self._merge()

    def _merge(self) -> None:
        """The last two runs become one: a full outer merge join, bucket by bucket. The old ones go once it is written."""
        old = self.runs[-2:]
        a, b = (self.spark.table(name).select("fp", F.col("n").alias(f"n{i}")) for i, (name, *_) in enumerate(old))
        both = a.join(b, "fp", "full_outer").select("fp", (F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))).alias("n"))
        self.runs[-2:] = [self._write(both)]
        self._drop(old)

    def _drop(self, runs: list[tuple]) -> None:
        for name, path, *_ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            common.delete(self.spark, path)

    def close(self) -> None:
        self._drop(self.runs)
        self.runs = []


def having(prints: DataFrame, repeated: list[DataFrame]) -> DataFrame:
    """The rows of prints whose fingerprint is in a table of repeated ones. The hot ones, fewer than HOT of each table, are
    broadcast; the rest have at most one in HOT of the positions each, and are joined by an exchange of both sides."""
    tables = repeated[0]
    for table in repeated[1:]:
        tables = tables.unionAll(table)
    hot, rest = tables.filter("hot").select("fp").distinct(), tables.filter("not hot").select("fp")
    marked = prints.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "fp", "left")
    cold = marked.filter("hot is null").drop("hot").join(rest, "fp", "left_semi")
    return marked.filter("hot").drop("hot").unionByName(cold)


def candidate_windows(flagged: DataFrame, window: int) -> DataFrame:
    """(h, c, tkey, pos): each window of the flagged texts whose fingerprint is among `fps`, with 96 bits of its words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column("tkey").to_numpy(), batch.column("fps")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, data, offsets in K.text_chunks(batch.column("text")):
                chunk = _Chunk(data, offsets, window)
                hit = np.zeros(len(chunk.least), dtype=bool)
                for i in range(lo, hi):
                    a, b = chunk.first[i - lo], min(chunk.first[i - lo + 1], len(hit))
                    if b > a:
                        hit[a:b] = np.isin(chunk.least[a:b], values[bounds[i] : bounds[i + 1]])
                at = np.flatnonzero(hit & chunk.valid)
                h, c = chunk.window_hashes(at)
                doc = chunk.doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(keys[lo + doc]), pa.array((at - chunk.first[doc]).astype(np.int32))], names=["h", "c", "tkey", "pos"])

    return flagged.select("tkey", "text", "fps").mapInArrow(scan, "h long, c int, tkey long, pos int")


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests = [], []
        for _, _, raws in K.raw_slices(batch.column(2)):
            for raw in raws:
                words = raw.split()
                n.append(len(words))
                digests.append(_digest(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "tkey", "n_words", "whole_sha256"])


def remove_windows(text: bytes, positions: np.ndarray, window: int) -> tuple[int, list[bytes]]:
    """Number of words removed, and the words kept."""
    words = text.split()
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, positions, 1)
    np.add.at(cover, np.asarray(positions) + window, -1)
    keep = np.cumsum(cover[:-1]) == 0
    return len(words) - int(keep.sum()), [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _strip(window: int, texts: bool):
    """Over (tkey, text, starts): starts null means that every window goes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, every = batch.column(2), batch.column(2).is_null().to_pylist()
            bounds, values = spans.offsets.to_numpy(), spans.values.to_numpy(zero_copy_only=False)
            for lo, hi, raws in K.raw_slices(batch.column(1)):
                removed, digests, kept = [], [], []
                for i, raw in enumerate(raws, lo):
                    n, words = remove_windows(raw, np.arange(len(raw.split()) - window + 1) if every[i] else values[bounds[i] : bounds[i + 1]], window)
                    removed.append(n)
                    digests.append(_digest(words))
                    if texts:
                        kept.append(b" ".join(words).decode())
                columns = [batch.column(0)[lo:hi], pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.string())] * texts, names=["tkey", "n_removed", "left_sha256", "kept_text"][: 3 + texts])

    return scan


def repeated_windows(docs: DataFrame, window: int = WINDOW, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flagged texts that stand once (tkey, text, fps), flagged copies, and the window starts to remove from the former
    (tkey, starts); all from written tables. Copies lose every window; only the first of them shows its windows, with double weight, to
    the other texts, so a large group of copies is not spread out into windows."""
    spark = docs.sparkSession
    keyed = docs.select(common.content_key(id_col, text_col).alias("tkey"), common.whole(text_col).alias("text"))
    prints = common.materialise(fingerprints(docs, window, id_col, text_col), "prints")
    index = FingerprintIndex(spark)
    repeated = [index.ingest(prints.filter(F.pmod("tkey", F.lit(batches)) == b)) for b in range(batches)]
    flags = having(prints, repeated).groupBy("tkey").agg(F.collect_set("fp").alias("fps"))
    shas = keyed.select("tkey", F.unhex(F.sha2("text", 256)).alias("sha"))
    copied = shas.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("tkey").alias("head")).filter("copies > 1")
    copied = common.materialise(copied, "copied")
    copied = shas.join(copied, "sha").select("tkey", (F.col("tkey") == F.col("head")).alias("head")).distinct()
    flagged = common.materialise(keyed.join(flags.join(copied, "tkey", "left"), "tkey"), "flagged")
    index.close()
    for table in (prints, *repeated):
        common.drop(table)
    common.release(spark)
    alone, twins = flagged.filter("head is null"), flagged.filter("head is not null")
    own = candidate_windows(alone, window)
    windows = own.select("h", "c", F.lit(1).alias("n")).unionAll(candidate_windows(twins.filter("head"), window).select("h", "c", F.lit(2).alias("n")))
    twice = windows.groupBy("h", "c").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "c")
    twice = common.materialise(twice, "twice")  # a table of its own, so that a window that very many texts share can be split in the join
    starts = own.join(twice, ["h", "c"], "left_semi").groupBy("tkey").agg(F.collect_set("pos").alias("starts"))
    starts = common.materialise(starts, "starts")
    common.drop(twice)
    common.release(spark)
    return alone, twins, starts


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = 2, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]): what is left of each document when every word covered by a
    window that also starts elsewhere goes. kept_text is null where nothing was removed."""
    alone, twins, starts = repeated_windows(docs, window, batches, id_col, text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), common.content_key(id_col, text_col).alias("tkey"), common.whole(text_col).alias("text")).mapInArrow(_untouched, f"doc_id {docs.schema[id_col].dataType.simpleString()}, tkey long, n_words long, whole_sha256 string")
    schema = "tkey long, n_removed long, left_sha256 string" + ", kept_text string" * texts
    hit = alone.join(starts, "tkey").select("tkey", "text", "starts").unionAll(twins.select("tkey", "text", F.lit(None).cast("array<int>")))
    left = hit.mapInArrow(_strip(window, texts), schema).dropDuplicates(["tkey"])
    out = base.join(left, "tkey", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
    return out.select("doc_id", "n_words", "n_removed", F.coalesce("left_sha256", "whole_sha256").alias("kept_sha256"), *["kept_text"] * texts)


class IncrementalDedup:
    """Batches that arrive one after the other. The index and the texts behind it grow; each batch is held against both.

    ingest(batch) returns (tkey, starts) of the windows of the batch that stand in an earlier batch or twice in this one.
    Earlier batches are not changed by later ones.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW):
        self.spark, self.window = spark, window
        self.index, self.history = FingerprintIndex(spark), []

    def ingest(self, docs: DataFrame) -> DataFrame:
        keyed = common.materialise(docs.select(common.content_key().alias("tkey"), common.whole().alias("text")), "history")
        prints = common.materialise(fingerprints(docs, self.window), "prints")
        repeated = self.index.ingest(prints)
        new = keyed.join(having(prints, [repeated]).groupBy("tkey").agg(F.collect_set("fp").alias("fps")), "tkey")
        windows = candidate_windows(new, self.window).withColumn("new", F.lit(True))
        for texts, old_prints in self.history:
            shared = having(old_prints, [repeated]).groupBy("tkey").agg(F.collect_set("fp").alias("fps"))
            windows = windows.unionByName(candidate_windows(texts.join(shared, "tkey"), self.window).withColumn("new", F.lit(False)))
        twice = windows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h", "c")
        starts = windows.filter("new").join(twice, ["h", "c"], "left_semi").groupBy("tkey").agg(F.collect_set("pos").alias("starts"))
        starts = common.materialise(starts, "starts")
        common.drop(repeated)
        self.history.append((keyed, prints))
        return starts
