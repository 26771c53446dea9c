"""Candidate generation: a weighted token join inside each country, and the best of each source and channel."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlode.functions.tokens import TYPES, explode_tokens
from kinlode.operators.token_join import best_pairs


@dataclass(frozen=True)
class BlockingParams:
    """k best of each source with an address, k_empty of those without; tokens of more than max_df records (by type: caps)
    do not count. The cap bounds the join: every query token meets at most that many records."""

    k: int = 20
    k_empty: int = 8
    max_df: int = 5000
    caps: dict[str, int] = field(default_factory=dict)
    types: tuple[str, ...] = TYPES


def cap(params: BlockingParams) -> Column:
    out = F.lit(params.max_df)
    for name, n in params.caps.items():
        out = F.when(F.col("ttype") == name, n).otherwise(out)
    return out


def token_frequency(tokens: DataFrame) -> DataFrame:
    """(country, ttype, token, df) over the records of sources 2 and 3."""
    return tokens.filter("source <> 1").groupBy("country", "ttype", "token").agg(F.count(F.lit(1)).alias("df"))


def blocking_idf(records: DataFrame, tokens: DataFrame, params: BlockingParams = BlockingParams()) -> DataFrame:
    """(country, ttype, token, df, idf): ln(n / df) of the tokens within the cap; n: records of sources 2 and 3."""
    n = records.filter("source <> 1").groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    kept = token_frequency(tokens).filter(F.col("df") <= cap(params))
    return kept.join(n, "country").select("country", "ttype", "token", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def met_idf(records: DataFrame, tokens: DataFrame, params: BlockingParams = BlockingParams()) -> DataFrame:
    """blocking_idf() of the tokens that a query has as well."""
    n = records.filter("source <> 1").groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    both = tokens.groupBy("country", "ttype", "token").agg(F.count_if(F.col("source") != 1).alias("df"), F.count_if(F.col("source") == 1).alias("nq"))
    kept = both.filter((F.col("df") > 0) & (F.col("nq") > 0) & (F.col("df") <= cap(params)))
    return kept.join(n, "country").select("country", "ttype", "token", F.log(F.col("n") / F.col("df")).alias("idf"))


def scored_pairs(records: DataFrame, params: BlockingParams = BlockingParams(), sample: DataFrame | None = None) -> DataFrame:
    """(q, r, source, addr_empty, score) of pairs that share a token: all that best_of_channels() can keep, and no more than the
    best of each tile. sample restricts the queries to its row_ids."""
    weights = met_idf(records, explode_tokens(records, params.types), params)
    return best_pairs(records, weights, channel(params), params.k, params.k_empty, params.types, sample)


def channel(params: BlockingParams) -> Column:
    """Whether a record goes by the limit of those without an address."""
    return F.col("addr_empty") if params.k_empty else F.lit(False)


def best_of_channels(pairs: DataFrame, records: DataFrame, params: BlockingParams = BlockingParams()) -> DataFrame:
    """(q, r, score, rank): rank restarts for each query, source and channel; ties go to the smaller record. Pairs with source
    and addr_empty, as scored_pairs gives them, are not joined with the records."""
    if "source" not in pairs.columns:
        pairs = pairs.join(records.filter("source <> 1").select(F.col("row_id").alias("r"), "source", channel(params).alias("addr_empty")), "r")
    line = Window.partitionBy("q", "source", "addr_empty").orderBy(F.desc("score"), "r")
    # a constant bound on the number itself lets Spark drop the rest of a group before the exchange
    ranked = pairs.withColumn("number", F.row_number().over(line)).filter(F.col("number") <= max(params.k, params.k_empty))
    if params.k_empty:
        ranked = ranked.filter(F.col("number") <= F.when(F.col("addr_empty"), params.k_empty).otherwise(params.k))
    return ranked.select("q", "r", "score", (F.col("number") - 1).alias("rank"))


def block(records: DataFrame, params: BlockingParams = BlockingParams(), sample: DataFrame | None = None) -> DataFrame:
    return best_of_channels(scored_pairs(records, params, sample), records, params)


def block_by_keys(records: DataFrame, max_df: int = 5000) -> DataFrame:
    """(q, r, score): pairs that share a plain key of records with `keys`; score is the number of shared keys, none is cut."""
    each = records.select("row_id", "source", "country", F.explode("keys").alias("token")).distinct()
    rare = each.filter("source <> 1").groupBy("country", "token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= max_df).drop("df")
    ours = each.filter("source = 1").select(F.col("row_id").alias("q"), "country", "token").join(rare, ["country", "token"])
    theirs = each.filter("source <> 1").select(F.col("row_id").alias("r"), "country", "token")
    return ours.join(theirs, ["country", "token"]).groupBy("q", "r").agg(F.count(F.lit(1)).alias("score"))


def with_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds y: whether (q, r) is in truth."""
    return pairs.join(truth.select("q", "r").distinct().withColumn("y", F.lit(True)), ["q", "r"], "left").withColumn("y", F.coalesce("y", F.lit(False)))
