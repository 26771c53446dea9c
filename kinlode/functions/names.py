"""Business names: identity words, legal forms, trade names, domains, and words run together. Column expressions, but for
folding and the split of run-together words."""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlode.functions import conventions as C
from kinlode.functions.script import fold, has_indic

# Patterns of names.
ALIAS = r"\s(?:f\s?/\s?k\s?/\s?a|fka|formerly(?:\s+known\s+as)?|d\s?/\s?b\s?/\s?a|dba|doing\s+business\s+as|a\s?/\s?k\s?/\s?a|aka|also\s+known\s+as|t\s?/\s?a|trading\s+as)\b\s*:?\s*"
DOMAIN = r"^\s*(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9.\-]*?)\s*\.\s*(?:com|net|org|in|co\.in|co|fr|biz|info|us|io)\s*$"
BARE_COM = r"^([a-z0-9]{6,})com$"
DOTTED = r"(?<![a-z0-9])((?:[a-z]\.){1,5}[a-z])\.?(?![a-z0-9])"
MAX_WORD, LEAST_SPLIT = 24, 8


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def phonetic_key(token: Column) -> Column:
    """Consonant classes without vowels, h, w and y, repeats collapsed, 0 in front of a first vowel; numbers stay."""
    code = F.regexp_replace(F.translate(token, C.SOUNDS[0] + C.SILENT, C.SOUNDS[1]), r"(.)\1+", "$1")
    return F.when((token == "") | token.rlike("^[0-9]+$"), token).otherwise(F.concat(F.when(F.substring(token, 1, 1).rlike(f"[{C.VOWELS}]"), "0").otherwise(""), code))


def undot(text: Column) -> Column:
    """l.l.c. -> llc. A dotted run is at most six letters long; dots go one by one where a letter stands on both sides."""
    marked = F.regexp_replace(text, DOTTED, "\x01$1\x02")
    for _ in range(5):
        marked = F.regexp_replace(marked, "(\x01[a-z]+)\\.([a-z.]*\x02)", "$1$2")
    return F.translate(marked, "\x01\x02", "")


def name_tokens(text: Column) -> Column:
    t = F.regexp_replace(F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and ")), r"#\s*\d+", " ")
    t = F.replace(F.translate(undot(t), "'’`", ""), F.lit("m/s"), F.lit(" "))
    tokens = F.filter(words(F.regexp_replace(t, r"[^a-z0-9\s]", " ")), lambda w: ~w.rlike("^[0-9]{4,}$"))
    mixed = lambda w: w.rlike("[0-9]") & w.rlike("[a-z]")
    return F.transform(tokens, lambda w: F.when(mixed(w), F.translate(w, *C.LEET)).otherwise(w))


def legal_of(tokens: Column) -> Column:
    forms = lookup(C.LEGAL_FORMS)
    return F.filter(F.transform(tokens, lambda w: F.element_at(forms, w)), lambda w: w.isNotNull())


def core_of(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*C.LEGAL_FORMS, *C.NAME_STOP))


def canonical_legal(tokens: Column) -> Column:
    forms = lookup(C.LEGAL_FORMS)
    return F.transform(tokens, lambda w: F.coalesce(F.element_at(forms, w), w))


def is_domain(text: Column) -> Column:
    return text.rlike(DOMAIN) | text.rlike(BARE_COM)


def without_domain(text: Column) -> Column:
    return F.when(text.rlike(DOMAIN), F.translate(F.regexp_extract(text, DOMAIN, 1), ".-", "  ")).when(text.rlike(BARE_COM), F.regexp_extract(text, BARE_COM, 1)).otherwise(text)


def name_and_alias(text: Column) -> Column:
    """Array of the name and, after the first fka / dba / aka, the other name."""
    return F.split(F.concat(F.lit(" "), text, F.lit(" ")), ALIAS, 2)


def needs_split(tokens: Column) -> Column:
    return (F.size(tokens) == 1) & F.get(tokens, 0).rlike(f"^[a-z]{{{LEAST_SPLIT},}}$")


def word_counts(names: DataFrame) -> DataFrame:
    """(word, c) over name_core and name_full."""
    return names.select(F.explode(F.concat(words(F.col("name_core")), words(F.col("name_full")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))


def vocabulary(counts: DataFrame, least: int = 2) -> DataFrame:
    """(word, logp): known words, and legal forms at the weight of one occurrence."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(1)).alias("t")).first()["t"] or 1
    known = counts.filter((F.col("c") >= least) & F.col("word").rlike("^[a-z]{2,}$")).select("word", F.log(F.col("c") / total).alias("logp"))
    forms = counts.sparkSession.createDataFrame([(w, math.log(1 / total)) for w in C.LEGAL_FORMS], "word string, logp double")
    return known.unionByName(forms.join(known.select("word"), "word", "left_anti"))


def best_split(token: str, logp: dict[str, float]) -> list[str] | None:
    """The most probable cut into known words (the longest last word among equals); None unless there are two or more."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for end in range(1, len(token) + 1):
        for start in range(max(0, end - MAX_WORD), end):
            value = best[start][0] + logp.get(token[start:end], -math.inf)
            if value > best[end][0]:
                best[end] = (value, start)
    if best[-1][0] == -math.inf:
        return None
    out, end = [], len(token)
    while end:
        start = best[end][1]
        out.append(token[start:end])
        end = start
    return out[::-1] if len(out) > 1 else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(tokens: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([best_split(t, dict(zip(k["w"], k["p"], strict=True)) if isinstance(k, dict) else {x["word"]: x["logp"] for x in k}) for t, k in zip(tokens, known, strict=True)], dtype=object)


def split_table(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, pieces) of run-together names (token). All substrings meet the vocabulary in a join, so the vocabulary is never
    broadcast; a name then carries only the words found in it."""
    size = F.length("token")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), size - i + 1)), lambda n: F.substring(F.col("token"), i, n))))
    unknown = tokens.distinct().join(vocab.select(F.col("word").alias("token")), "token", "left_anti")
    found = unknown.select("token", F.explode(F.array_distinct(cuts)).alias("word")).join(vocab, "word")
    grouped = found.groupBy("token").agg(F.collect_list(F.struct("word", "logp")).alias("known"))
    return grouped.select("token", _split("token", "known").alias("pieces")).filter("pieces is not null")


def normalize_names(df: DataFrame, column: str = "business_name", vocab: DataFrame | None = None) -> DataFrame:
    """Adds name_full, name_core, name_alias, legal, is_domain, is_indic."""
    text = F.trim(F.regexp_replace(F.col("_folded"), r"\s+", " "))
    out = df.withColumn("is_indic", has_indic(F.col(column))).withColumn("_folded", fold(F.col(column))).withColumn("_text", text)
    out = out.withColumn("is_domain", is_domain(F.col("_text"))).withColumn("_parts", name_and_alias(without_domain(F.col("_text"))))
    out = out.withColumn("_tokens", F.array_distinct(name_tokens(F.get("_parts", F.lit(0)))))
    out = out.withColumn("_other", F.array_distinct(name_tokens(F.coalesce(F.get("_parts", F.lit(1)), F.lit("")))))
    if vocab is not None:
        single = F.when(needs_split(F.col("_tokens")), F.get("_tokens", F.lit(0)))
        out = out.withColumn("_single", single)
        pieces = split_table(out.filter("_single is not null").select(F.col("_single").alias("token")), vocab)
        out = out.join(pieces.withColumnRenamed("token", "_single"), "_single", "left")
        out = out.withColumn("_tokens", F.coalesce(F.array_distinct("pieces"), "_tokens")).drop("_single", "pieces")
    core = core_of(F.col("_tokens"))
    plain = F.filter("_tokens", lambda w: ~w.isin(*C.NAME_STOP))
    core = F.when(F.size(core) > 0, core).when(F.size(plain) > 0, plain).otherwise(F.col("_tokens"))
    return out.withColumns({
        "name_full": joined(canonical_legal(F.col("_tokens"))), "name_core": joined(core), "name_alias": joined(core_of(F.col("_other"))),
        "legal": joined(F.array_sort(F.array_distinct(F.concat(legal_of(F.col("_tokens")), legal_of(F.col("_other")))))),
    }).drop("_folded", "_text", "_parts", "_tokens", "_other")
