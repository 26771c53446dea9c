"""Strict tab-separated sources, ground truth and result files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("entity_id", "business_name", "business_address", "country")
TRUTH_FIELDS = ("source1_entity_id", "matched_entity_ids")
ID_STEP = 10**12


def _lines(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows of exactly these fields: no quoting, no null words. The header is the file's first line and must be right."""
    header = "\t".join(fields)
    lines = spark.read.text(path, lineSep="\n").select(F.regexp_replace("value", "\r$", "").alias("value"))
    first = lines.first()
    if first is None or first["value"] != header:
        raise ValueError(f"{path}: the header must be {header!r}")
    if lines.filter(F.col("value") == header).limit(2).count() > 1:
        raise ValueError(f"{path}: the header stands again further down")
    parts = F.split("value", "\t", -1)
    ok = F.raise_error(F.concat(F.lit(f"{path}: not {len(fields)} fields: "), F.col("value")))
    checked = lines.filter(F.col("value") != header).select(F.when(F.size(parts) == len(fields), parts).otherwise(ok.cast("array<string>")).alias("p"))
    return checked.select(*[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(fields)])


def id_key(entity_id: Column) -> Column:
    """S<d>-<digits> as d * 10^12 + digits; any other id fails."""
    good = F.substring(entity_id, 2, 1).cast("long") * ID_STEP + F.substring(entity_id, 4, 12).cast("long")
    return F.when(entity_id.rlike(r"^S[0-9]-[0-9]{1,12}$"), good).otherwise(F.raise_error(F.concat(F.lit("malformed id: "), entity_id)).cast("long"))


def with_keys(rows: DataFrame) -> DataFrame:
    """Adds row_id and source."""
    return rows.withColumn("row_id", id_key(F.col("entity_id"))).withColumn("source", F.floor(F.col("row_id") / ID_STEP).cast("int"))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return with_keys(_lines(spark, path, FIELDS))


def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """All three sources of a split."""
    one, two, three = (read_source(spark, f"{folder}/{split}_source{i}.tsv") for i in (1, 2, 3))
    return one.unionByName(two).unionByName(three)


def id_list(ids: Column) -> Column:
    return F.filter(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: x != "")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, matches): every S1 id with the array of its matches, which may be empty."""
    rows = _lines(spark, path, TRUTH_FIELDS)
    return rows.select(F.col(TRUTH_FIELDS[0]).alias("entity_id"), id_list(F.col(TRUTH_FIELDS[1])).alias("matches"))


def truth_pairs(truth: DataFrame, records: DataFrame) -> DataFrame:
    """(q, r) row ids. Fails when an id is unknown or stands twice in the records."""
    pairs = truth.select(F.col("entity_id"), F.explode("matches").alias("match"))
    ids = records.select("entity_id", "row_id")
    known = ids.groupBy("entity_id").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))
    good = lambda c, row: F.when(F.col("n") == 1, F.col(row)).otherwise(F.raise_error(F.concat(F.lit("unknown or repeated id: "), F.col(c))).cast("long"))
    out = pairs.join(known, "entity_id", "left").select("match", good("entity_id", "row_id").alias("q"))
    out = out.join(known.withColumnRenamed("entity_id", "match"), "match", "left")
    return out.select("q", good("match", "row_id").alias("r"))


def id_lists(records: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """(source1_entity_id, name): one row for each S1, its pairs' ids joined by commas in row order, empty where none."""
    named = pairs.join(records.select(F.col("row_id").alias("r"), F.col("entity_id").alias("id")), "r")
    lists = named.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]), ",").alias(name))
    ones = records.filter("source = 1").select(F.col("row_id").alias("q"), F.col("entity_id").alias("source1_entity_id"))
    return ones.join(lists, "q", "left").select("source1_entity_id", F.coalesce(name, F.lit("")).alias(name), "q")


def write_lists(lists: DataFrame, path: str) -> None:
    """Sorted by S1 into part files of one folder, each with the header."""
    name = lists.columns[1]
    lists.orderBy("q").select("source1_entity_id", name).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")


def check_lists(lists: DataFrame, column: str) -> DataFrame:
    """(problem, n): S1 ids that repeat, lists with repeated ids, ids of a wrong kind."""
    ids = id_list(F.col(column))
    repeated = lists.groupBy("source1_entity_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated_s1").alias("problem"), "n")
    inner = lists.agg(F.count_if(F.size(ids) != F.size(F.array_distinct(ids))).alias("repeated_match"), F.count_if(F.exists(ids, lambda x: ~x.rlike("^S[23]-"))).alias("wrong_kind"))
    return repeated.unionByName(inner.select(F.expr("stack(2, 'repeated_match', repeated_match, 'wrong_kind', wrong_kind) as (problem, n)")))
