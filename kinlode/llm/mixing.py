"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target over its share of the rows. Each document inverts the Poisson
distribution of that mean at a uniform number hashed from the seed and its id, so its count does not depend on where or
when it is computed; rows are exploded by the count and shuffled globally by a hash of seed, id and replica. The
distribution function is an array computed once for each source; a mean above 500 is drawn as a sum of equal parts.

Defined results: a null source is a source of its own; a null id is hashed as an empty text. Rows with the same id are
repeated equally often. Sources without a given weight have weight 0 and go; without given weights a source weighs its
row count to the power `temperature`. An empty table gives an empty result. Columns of the input are kept, whatever
their names; those called repeats, rate or replica give way to the operator's own.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlode.llm import common

SEED, TEMPERATURE, PART = 7, 0.5, 500.0
_BITS = 52


def uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def poisson_cdf(mean: Column) -> Column:
    """P(K <= k) for k = 0, 1, ... until the rest cannot be told from 0; mean is at most PART."""
    top = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, temperature: float = TEMPERATURE, source_col: str = "source") -> DataFrame:
    """(source, n, rate, parts, cdf) for each source; size is the number of rows aimed at, by default as many as there are."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n"), F.lit(temperature))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighted = counts.withColumn("w", weight)
    all_w, all_n = weighted.agg(F.sum("w"), F.sum("n")).first()
    goal = float(all_n or 0) if size is None else float(size)
    rated = weighted.select("source", "n", (F.lit(goal) * F.col("w") / F.lit(all_w or 1.0) / F.col("n")).alias("rate"))
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    return rated.withColumn("parts", parts).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, seed: int = SEED, temperature: float = TEMPERATURE, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as its count says, with `replica` (from 0), `repeats` and `rate`, in an order that is
    random over the whole result."""
    rates = common.materialise(repetition_rates(docs, weights, size, temperature, source_col), "rates")
    rates = rates.select("source", "rate", "parts", "cdf")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # one column, so that no name clashes
    name = F.coalesce(F.col("row")[id_col].cast("string"), F.lit(""))
    joined = held.join(rates, F.col("row")[source_col].eqNullSafe(F.col("source"))).withColumn("u", uniform(F.lit(str(seed)), name, F.lit("0")))
    draw = lambda u: F.size(F.filter("cdf", lambda c: c < u))
    more = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, j: a + F.when(j < F.col("parts"), draw(uniform(F.lit(str(seed)), name, j.cast("string")))).otherwise(0))
    counted = joined.withColumn("repeats", (draw(F.col("u")) + F.when(F.col("parts") > 1, more).otherwise(0)).cast("long")).filter("repeats > 0")
    out = counted.select("row", "repeats", "rate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)).alias("replica"))
    out = out.withColumn("key", F.md5(F.concat_ws("/", F.lit(str(seed)), name, F.col("replica").cast("string")).cast("binary")))
    shuffled = out.repartition(common.partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    own = ("repeats", "rate", "replica")
    return shuffled.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in own], *own)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The replicated rows with the columns of docs only."""
    out = replicate(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col("doc_id"), F.col("source")), **settings)
    return out.select("all.*")


def mix_sql(seed: int = SEED, temperature: float = TEMPERATURE) -> str:
    """The rows of documents with rate and repeats, as replicate() has them, in DuckDB SQL, for means of at most PART. Rows
    are told apart by a number, so ids may repeat or be null; a null source is a source."""
    return f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s) * n ** {temperature} / (SELECT sum(n ** {temperature}) FROM s) / n AS rate FROM s),
c AS (SELECT source, rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r, (SELECT unnest(range(0, 900))::DOUBLE AS k)),
u AS (SELECT *, row_number() OVER () AS rid, (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':0'), 1, 13))::BIGINT + 0.5) / {1 << _BITS}::DOUBLE AS u FROM documents),
m AS (SELECT u.rid, count(*) AS repeats, any_value(c.rate) AS rate FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf < u.u GROUP BY u.rid),
k AS (SELECT u.doc_id, u.source, u.lang, u.text, u.n_chars, m.repeats, m.rate FROM u JOIN m USING (rid))
"""
