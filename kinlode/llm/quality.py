"""Quality classifier with hierarchical empirical Bayes.

A logistic model of a text's form gives each document a probability of being good. Documents are grouped by host and by
path below it; labels where there are any, probabilities elsewhere, give each group a count and a sum. The spread of the
groups around the level above says how far a group may depart from it (beta-binomial moments), so sparse sites shrink
to their host and sparse hosts to the global mean. A document's score is its own evidence on top of its path's
posterior without itself.

The logistic model is fitted on at most `fit_rows` labelled rows; everything else covers all rows. Site tables are
written down before they are joined, so Spark broadcasts them only where their size allows it.

Defined results: a null or empty text has the form of no words. A null host or path part is a site of its own. Labels
that disagree count as bad; labels of unknown documents are ignored. Without labels of both kinds every document has
probability one half, and is kept. Rows that repeat an id come out one by one, each judged by its own text and site: a
rejected row goes even if an accepted one has the same id or both have none. Empty tables give empty results. Columns of
the input may have any names; filter_quality() returns them unchanged.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlode.llm import common
from kinlode.llm import kernels as K

FIT_ROWS, THRESHOLD = 20_000, 0.5
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_MARK = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_PLAIN = b".,;:'\"()?-"
FEATURES = ["log_words", "word_bytes", "distinct", "top_share", "again", "upper", "digit", "mark", "odd_mark", "loud", "bars", "line_words", "line_again", "short", "long", "high"]


def form(raw: bytes) -> list[float]:
    """Measures of a text's form; all from its whole bytes."""
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    count = lambda chars: size - len(raw.translate(None, chars))
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    letters = max(1, count(_UPPER) + count(_LOWER))
    mark = count(_MARK)
    return [
        np.log1p(n), lengths.mean(), len(tally) / n, max(tally.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, count(_UPPER) / letters, count(_DIGIT) / size, mark / n,
        (mark - count(_PLAIN)) / n, raw.count(b"!") / n, raw.count(b"|") / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), (lengths <= 3).mean(), (lengths >= 15).mean(), (size - len(raw.decode())) / size,
    ]


class LogisticModel:
    """Standardised features and their squares; ridge-penalised Newton steps."""

    def __init__(self, ridge: float = 1.0, steps: int = 25):
        self.ridge, self.steps = ridge, steps
        self.weights = None

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def fit(self, x: np.ndarray, y: np.ndarray) -> "LogisticModel":
        if not len(y) or y.min() == y.max():
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self._design(x)
        w = np.zeros(a.shape[1])
        penalty = np.full(len(w), self.ridge)
        penalty[0] = 1e-6
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


def _forms(raws: list[bytes]) -> np.ndarray:
    return np.array([form(r) for r in raws], dtype=float).reshape(len(raws), len(FEATURES))


def text_forms(docs: DataFrame, columns: list[Column], text_col: str = "text") -> DataFrame:
    """The columns and `form`, the measures of the text."""
    named = docs.select(*columns, common.whole(text_col).alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.vstack([np.zeros((0, len(FEATURES))), *(_forms(raws) for _, _, raws in K.raw_slices(batch.column(batch.num_columns - 1)))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), type=pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "form"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema[:-1])
    return named.mapInArrow(scan, f"{schema}, form array<double>")


def _predicted(rows: DataFrame, model: LogisticModel) -> DataFrame:
    """Replaces `form` by `p`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).values.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.predict(x))], names=[*batch.schema.names[:-1], "p"])

    return rows.mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", p double")


def shrinkage(groups: DataFrame, centre: Column) -> float:
    """The prior strength (in rows) for groups (n, s) around a centre, from the moments of a beta-binomial."""
    own = F.col("s") / F.col("n")
    spread = centre * (1 - centre)
    g, n, n2, out, v = groups.select("n", own.alias("r"), centre.alias("m"), spread.alias("v")).agg(
        F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * F.pow(F.col("r") - F.col("m"), 2)), F.sum(F.col("n") * F.col("v"))).first()
    if not g or g < 2 or not v or n <= g:
        return 100.0
    v /= n
    rho = (out - v * (g - 1)) / (v * max(1e-9, n - n2 / n - (g - 1)))
    return float(np.clip(1 / np.clip(rho, 1e-6, 0.5) - 1, 1.0, 1e6))


class SiteQuality:
    """fit(docs, labels) learns the text model and the site posteriors; score(rows) joins both."""

    def __init__(self, host: str = "source", path: tuple[str, ...] = ("lang",), fit_rows: int = FIT_ROWS):
        self.host, self.path, self.fit_rows = host, path, fit_rows

    def sites(self) -> list[Column]:
        part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
        return [part(self.host).alias("host"), F.concat_ws("/", *(part(c) for c in (self.host, *self.path))).alias("path")]

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> "SiteQuality":
        forms = common.materialise(text_forms(docs, [F.col(id_col).alias("doc_id"), common.content_key(id_col, text_col).alias("tkey"), *self.sites()], text_col), "forms")
        marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        rows = forms.join(marks, "doc_id", "left").select("doc_id", "tkey", "host", "path", "quality", "form")
        sample = rows.filter("quality is not null").orderBy(F.xxhash64("doc_id")).limit(self.fit_rows).select("quality", "form").toArrow()
        x = np.array(sample.column("form").to_pylist(), dtype=float).reshape(-1, len(FEATURES))
        self.model = LogisticModel().fit(x, sample.column("quality").to_numpy().astype(float))
        self.rows = common.materialise(_predicted(rows, self.model), "evidence")
        y = F.coalesce(F.col("quality").cast("double"), F.col("p"))
        paths = common.materialise(self.rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s")), "paths")
        hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
        n, s = paths.agg(F.sum("n"), F.sum("s")).first()
        self.mean = float(np.clip((s or 0.5) / (n or 1), 1e-3, 1 - 1e-3)) if n else 0.5
        self.host_prior = shrinkage(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), F.lit(self.mean))
        centre = (self.mean * self.host_prior + F.col("host_s")) / (self.host_prior + F.col("host_n"))
        self.path_prior = shrinkage(paths.join(hosts, "host"), centre)
        self.table = common.materialise(paths.join(hosts, "host").select(F.col("path").alias("_path"), F.col("n").alias("_n"), F.col("s").alias("_s"), F.col("host_n").alias("_hn"), F.col("host_s").alias("_hs")), "sites")
        return self

    def score(self, rows: DataFrame, path: Column, p: Column, y: Column) -> DataFrame:
        """Adds host_posterior, path_posterior and score; a row's own share y is taken out of its site."""
        logit = lambda x: F.log(x / (1 - x))
        near = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
        host = (self.mean * self.host_prior + F.col("_hs") - y) / (self.host_prior + F.col("_hn") - 1)
        site = (host * self.path_prior + F.col("_s") - y) / (self.path_prior + F.col("_n") - 1)
        joined = rows.join(self.table, path == F.col("_path"))
        total = logit(near(p)) - logit(F.lit(self.mean)) + logit(near(site))
        return joined.withColumns({"host_posterior": host, "path_posterior": site, "score": 1 / (1 + F.exp(-total))}).drop("_path", "_n", "_s", "_hn", "_hs")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **sites) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, score, accepted) for every row."""
    model = SiteQuality(**sites).fit(docs, labels)
    y = F.coalesce(F.col("quality").cast("double"), F.col("p"))
    out = model.score(model.rows, F.col("path"), F.col("p"), y)
    return out.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("accepted"))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **sites) -> DataFrame:
    """The accepted rows with the columns of docs. The text is not shuffled where the site table can be broadcast."""
    model = SiteQuality(**sites).fit(docs, labels, id_col, text_col)
    decided = model.score(model.rows, F.col("path"), F.col("p"), F.coalesce(F.col("quality").cast("double"), F.col("p")))
    good = decided.filter(F.col("score") >= threshold).select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"), F.col("path").alias("_path")).distinct()
    _, path = model.sites()
    return docs.join(good, docs[id_col].eqNullSafe(good["_id"]) & (common.content_key(id_col, text_col) == good["_tkey"]) & (path == good["_path"]), "left_semi")
