"""The corpus operators as queries over the test tables, and DuckDB SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession

from kinlode.llm import exact_dedup, license_scan, lm_score, mixing, packing, quality, simhash, substring_dedup, tiff, training_order
from kinlode.llm.common import read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"))


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.document_media(read_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return mixing.replicate(read_table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.owners(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT rid, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35),
w AS (SELECT rid, i, sha256(array_to_string(list_slice(words, i, i + 34), ' ')) AS h FROM i),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS pos FROM w SEMI JOIN twice USING (h)),
p AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict:
    ops = (op1_substring_dedup, op2_tiff_media, op3_simhash, op4_quality, op5_mixing, op6_training_order, op7_license_scan, op8_lm_score, op9_exact_dedup, op10_packing, pipeline)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": SUBSTRING_SQL,
        "op5_mixing": mixing.mix_sql() + "SELECT doc_id, text, lang, source, n_chars, repeats, round(rate, 6) AS rate, unnest(range(repeats)) AS replica FROM k",
        "op7_license_scan": license_scan.scan_sql(),
        "op9_exact_dedup": EXACT_SQL,
    }
