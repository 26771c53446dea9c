"""The training-data pipeline: documents through five operators, each stage written as Parquet and read by the next.

Defined results: each stage keeps the rules of its operator for nulls, empty texts, ties and repeated rows (see the
operators' docstrings); an empty table goes through all stages and gives no pieces.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlode.llm import common, exact_dedup, mixing, near_dedup, packing, quality
from kinlode.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL can express neither the logistic model nor XXH64 fingerprints nor the tokenizer; tests/llm holds run() against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.filter_quality(docs, common.read_table(spark, sf_dir, "labels")).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_rows(docs).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard at least 0.8."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, shuffled."""
    return mixing.mix(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select(*[F.col(c) for c in COLUMNS])
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        common.release(spark)
    return docs
