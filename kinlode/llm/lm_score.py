"""Language-model scores by a subword lattice.

The vocabulary is that of a public subword tokenizer. Its scores give each piece a first weight; one step of expectation
maximisation over the counts of all training words turns them into the weights of a unigram model of pieces. The
probability of a word is the sum over all its segmentations into pieces (a forward recursion in logarithms), and since
no piece crosses white space the probability of a text is the product over its words and the end.

Word counts are grouped once over the whole corpus. The words above a count, of which there are at most `hot_words`,
are broadcast; the others are joined by a shuffle, so the vocabulary is never held in one place.

Defined results: a null or empty text is the end token alone. The split takes a null id as an empty text. Rows that
repeat an id and a text count as often as they stand there and come out one by one with equal scores. Without any
training document every base probability is 1 and the pieces keep their first weights. A text without white space is one
word, whatever its length. An empty table gives an empty result. Other columns are ignored.
"""

import math
from collections import Counter, deque
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlode.llm import common
from kinlode.llm import kernels as K

#: Most words that are broadcast, and entries after which a task hands on its word counts.
HOT_WORDS, FLUSH = 200_000, 300_000
_HASH = 0x9FB21C651E98DF25
#: Words of so many bytes are worked off one by one, so many places at a time.
BLOCK = 2048
LN10 = math.log(10)


class Lattice:
    """Piece weights over bytes; a word is written as a space and its bytes. Bytes alone are pieces too, so every word has
    a segmentation."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.pieces, self.log_p = pieces, log_p
        self.longest = max(map(len, pieces))
        self.bits = max(10, (len(pieces) * 16).bit_length())
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.ids = np.full(1 << self.bits, -1, dtype=np.int64)
        p, _ = K.powers(_HASH, self.longest + 1)
        for i, piece in enumerate(pieces):
            raw = np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)
            h = K.mix(np.array([(raw * p[: len(raw)]).sum(dtype=np.uint64)]))[0]
            at = int(h) & ((1 << self.bits) - 1)
            while self.keys[at] and self.keys[at] != h:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ids[at] = h, i

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        mask = np.uint64((1 << self.bits) - 1)
        at = h & mask
        have = self.keys[at]
        out = np.where(have == h, self.ids[at], -1)
        on = np.flatnonzero((have != h) & (have != 0))
        while len(on):
            at_on = at[on] = (at[on] + np.uint64(1)) & mask
            have = self.keys[at_on]
            hit = have == h[on]
            out[on[hit]] = self.ids[at_on[hit]]
            on = on[~hit & (have != 0)]
        return out

    def _edges(self, chars: np.ndarray) -> list[np.ndarray]:
        """For each length l from 1, the piece that starts at each place of each word."""
        n, size = chars.shape
        p, inverse = K.powers(_HASH, size + 1)
        prefix = np.zeros((n, size + 1), dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * p[:size], axis=1, out=prefix[:, 1:])
        out = []
        for l in range(1, min(size, self.longest) + 1):  # noqa: E741
            h = K.mix((prefix[:, l:] - prefix[:, :-l]) * inverse[: size - l + 1])
            out.append(self.look_up(h.ravel()).reshape(n, -1))
        return out

    def run(self, words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """words: (n, size) bytes of equal length. The log probability of each, and with counts the expected number of
        uses of each piece."""
        n, size = words.shape
        edges = self._edges(words)
        weight = np.append(self.log_p, -np.inf)
        scores = [weight[e] for e in edges]
        alpha = np.full((n, size + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, size + 1):
            alpha[:, j] = _log_sum([alpha[:, j - l] + scores[l - 1][:, j - l] for l in range(1, min(j, len(edges)) + 1)])
        total = alpha[:, size]
        if counts is None:
            return total, None
        beta = np.full((n, size + 1), -np.inf)
        beta[:, size] = 0
        for i in range(size - 1, -1, -1):
            beta[:, i] = _log_sum([beta[:, i + l] + scores[l - 1][:, i] for l in range(1, min(size - i, len(edges)) + 1)])
        uses = np.zeros(len(self.pieces))
        for l, (e, s) in enumerate(zip(edges, scores, strict=True), 1):
            row, at = np.nonzero(e >= 0)
            share = np.exp(alpha[row, at] + s[row, at] + beta[row, at + l] - total[row]) * counts[row]
            uses += np.bincount(e[row, at], weights=share, minlength=len(uses))
        return total, uses

    def _long_edges(self, raw: np.ndarray, a: int, b: int) -> list[list[tuple[int, int]]]:
        """(length, piece) of the pieces that end at each place from a + 1 to b."""
        lo = max(0, a - self.longest)
        out: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
        for l, e in enumerate(self._edges(raw[None, lo:b]), 1):  # noqa: E741
            for start in np.flatnonzero(e[0] >= 0).tolist():
                if lo + start + l > a:
                    out[lo + start + l - a - 1].append((l, int(e[0][start])))
        return out

    def long(self, word: bytes, count: float | None = None) -> tuple[float, np.ndarray | None]:
        """run() for one word of any length: edges are made BLOCK places at a time, and only the scores of the last places
        (with a count: of all places) are kept."""
        raw = np.frombuffer(b" " + word, np.uint8)
        size, weight = len(raw), self.log_p.tolist()
        recent, every = deque([0.0], maxlen=self.longest), [] if count is None else [0.0]
        for a in range(0, size, BLOCK):
            for ends in self._long_edges(raw, a, min(size, a + BLOCK)):
                now = _log_add([recent[-l] + weight[piece] for l, piece in ends])
                recent.append(now)
                if count is not None:
                    every.append(now)
        total = recent[-1]
        if count is None:
            return total, None
        uses = np.zeros(len(self.pieces))
        later = [-math.inf] * size + [0.0]  # from each place to the end
        for a in range((size - 1) // BLOCK * BLOCK, -1, -BLOCK):
            b = min(size, a + BLOCK)
            for j, ends in zip(range(b, a, -1), reversed(self._long_edges(raw, a, b)), strict=True):
                after = later[j]
                for l, piece in ends:
                    i, step = j - l, weight[piece] + after
                    later[i] = _log_add([later[i], step])
                    uses[piece] += count * math.exp(min(0.0, every[i] + step - total)) if every[i] + step > -math.inf else 0.0
        return total, uses

    def all(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """As run(), for words of any lengths."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out, uses = np.zeros(len(words)), None if counts is None else np.zeros(len(self.pieces))
        for r in np.flatnonzero(size >= BLOCK).tolist():
            out[r], more = self.long(words[r], None if counts is None else float(counts[r]))
            if more is not None:
                uses += more
        for s in np.unique(size[size < BLOCK]).tolist():
            rows = np.flatnonzero(size == s)
            step = max(1, 40_000 // (s + 1))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                chars = np.frombuffer(b"".join([b" " + words[r] for r in part.tolist()]), np.uint8).reshape(len(part), s + 1)
                out[part], more = self.run(chars, None if counts is None else counts[part])
                if more is not None:
                    uses += more
        return out, uses


def _log_add(terms: list[float]) -> float:
    top = max(terms, default=-math.inf)
    return top if top == -math.inf or len(terms) == 1 else top + math.log(math.fsum([math.exp(x - top) for x in terms]))


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    x = np.stack(terms)
    top = x.max(axis=0)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(axis=0))


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (the word mark is a space) and their first probabilities: the existing scores order the pieces, and
    a piece's weight falls with its place. Single bytes come last. Pieces with a space inside are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = {}
    for i in range(model.get_piece_size()):
        if model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            named[piece] = max(named.get(piece, -math.inf), model.get_score(i))
    order = sorted(named, key=lambda x: (-named[x], x))
    pieces = order + [bytes([b]) for b in range(256) if bytes([b]) not in named]
    weight = 1 / (10.0 + np.arange(len(pieces)))
    weight[len(order) :] = weight[-1] / 100
    return pieces, weight / weight.sum()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        marks = batch.column(0).to_pylist()
        for lo, hi, raws in K.raw_slices(batch.column(1)):
            for held, raw in zip(marks[lo:hi], raws, strict=True):
                words = raw.lower().split()
                if held:
                    for word in set(words):
                        seen.setdefault(word, 0)
                else:
                    seen.update(words)
                if len(seen) > FLUSH:
                    yield out()
                    seen = Counter()
    if seen:
        yield out()


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 1


class SubwordModel:
    """fit(docs) on the training part; word_table() has every word's count and log probability."""

    def __init__(self, vocabulary_path: str, prior: float = 1000.0, steps: int = 1):
        self.path, self.prior, self.steps = vocabulary_path, prior, steps

    def fit(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "SubwordModel":
        sc = docs.sparkSession.sparkContext
        rows = docs.select(held_out(id_col).alias("held"), common.whole(text_col).alias("text"))
        counted = rows.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
        self.words = common.materialise(counted, "words")
        n, v = self.words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
        ends = docs.filter(~held_out(id_col)).count()
        self.n, self.v, self.ends = n + ends, v + (ends > 0), ends
        pieces, first = vocabulary(self.path)
        p = np.append(first * (1 - 1e-3), 1e-3)
        for _ in range(self.steps):
            lattice = sc.broadcast(Lattice(pieces, np.log(p[:-1])))

            def expect(batches: Iterator[pa.RecordBatch], lattice=lattice) -> Iterator[pa.RecordBatch]:
                uses = None
                for batch in batches:
                    _, more = lattice.value.all(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float))
                    uses = more if uses is None else uses + more
                if uses is not None:
                    at = np.flatnonzero(uses)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(uses[at])], names=["piece", "uses"])

            sums = self.words.filter("c > 0").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
            uses = np.zeros(len(p))
            for row in sums.collect():  # at most a row for each piece of the vocabulary
                uses[row["piece"]] = row["uses"]
            uses[-1] = ends
            p = (uses + self.prior * p) / (uses.sum() + self.prior)
        self.end = float(np.log(p[-1]))
        self.lattice = sc.broadcast(Lattice(pieces, np.log(p[:-1])))
        return self

    def word_table(self) -> DataFrame:
        """(word, c, lp): natural log of the word's marginal probability."""
        lattice = self.lattice

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lp, _ = lattice.value.all(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lp)], names=["word", "c", "lp"])

        return self.words.mapInArrow(score, "word binary, c long, lp double")


def score_documents(docs: DataFrame, vocabulary_path: str, hot_words: int = HOT_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = docs.sparkSession
    model = SubwordModel(vocabulary_path).fit(docs, id_col, text_col)
    table = common.materialise(model.word_table(), "lattice")
    scale = 8.0
    step = F.floor(F.log2(F.col("c") + 1) * scale)
    sizes = sorted(((r["s"], r["n"]) for r in table.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # a row for each eighth of a power of two
    least, total = math.inf, 0
    for s, n in sizes:
        if s < 1 or total + n > hot_words:
            break
        least, total = s, total + n
    top = table.filter(step >= (least if total else 1 << 20)).toArrow()  # at most hot_words rows
    word, count, lp = top.column("word").to_pylist(), top.column("c").to_numpy(), top.column("lp").to_numpy()
    log_base = math.log10(model.n + 0.5 * (model.v + 1))
    base_of = lambda c: np.log10(c + 0.5) - log_base
    shared = spark.sparkContext.broadcast(({w: i for i, w in enumerate(word)}, count, base_of(count.astype(float)), lp / LN10))
    end_base, end_score = float(base_of(float(model.ends))), model.end / LN10
    end_known = int(model.ends > 0)
    kind = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, c, base, score = shared.value
        seen = (c > 0).astype(np.int64)
        for batch in batches:
            names = ["doc_id", "tkey", "held_out", "word", "tf", "n_tokens", "n_known", "base_score", "score", "copies"]
            keys, tkeys, held = (batch.column(i).to_pylist() for i in range(3))
            rows, size = [], 0
            raws = (raw for _, _, part in K.raw_slices(batch.column(3)) for raw in part)
            for key, tkey, h, raw in zip(keys, tkeys, held, raws, strict=True):
                words = raw.lower().split()
                at = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
                on = at[at >= 0]
                rows.append((key, tkey, h, b" " + tkey.to_bytes(8, "little", signed=True), 0, len(words) + 1, int(seen[on].sum()) + end_known, float(base[on].sum()) + end_base, float(score[on].sum()) + end_score, 1))
                cold = Counter([words[i] for i in np.flatnonzero(at < 0).tolist()])
                rows.extend((key, tkey, h, w, n, 0, 0, 0.0, 0.0, 0) for w, n in cold.items())
                size += 1 + len(cold)
                if size > 50_000:
                    yield _rows(rows, names, batch.schema.field(0).type)
                    rows, size = [], 0
            if rows:
                yield _rows(rows, names, batch.schema.field(0).type)

    source = docs.select(F.col(id_col), common.content_key(id_col, text_col), held_out(id_col), common.whole(text_col))
    parts = source.mapInArrow(split, f"doc_id {kind}, tkey long, held_out boolean, word binary, tf long, n_tokens long, n_known long, base_score double, score double, copies long")
    rare = table.filter(step < (least if total else 1 << 20))
    # a document's own row has a word that no text can hold, so these rows spread evenly and meet nothing
    joined = parts.join(rare, "word", "left")
    sums = joined.groupBy("doc_id", "tkey").agg(
        F.first("held_out").alias("held_out"), F.sum("copies").alias("copies"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base_score") + F.coalesce(F.col("tf") * (F.log10(F.col("c") + 0.5) - log_base), F.lit(0.0))).alias("base_score"),
        F.sum(F.col("score") + F.coalesce(F.col("tf") * F.col("lp") / LN10, F.lit(0.0))).alias("score"))
    each = lambda c: (F.col(c) / F.col("copies")).alias(c)
    whole = lambda c: F.expr(f"{c} div copies").alias(c)
    return sums.select("doc_id", "held_out", whole("n_tokens"), whole("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), each("base_score"), each("score"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def _rows(rows: list[tuple], names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.bool_(), pa.binary(), *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
