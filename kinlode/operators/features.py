"""Features of candidate pairs; unknown values are null."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlode.functions.names import joined, phonetic_key, words
from kinlode.functions.similarity import similarity
from kinlode.functions.tokens import explode_tokens

IDF_TYPES = ("name", "phon", "addrw", "addrc", "street")
ATTRIBUTES = ("name_core", "name_full", "name_alias", "legal", "addr_norm", "state", "nums", "codes", "is_domain", "is_indic", "addr_empty", "source")


def feature_idf(records: DataFrame, types: tuple[str, ...] = IDF_TYPES) -> DataFrame:
    """(country, ttype, token, idf): ln((n + 1) / df) over the records of all sources."""
    tokens = explode_tokens(records, types)
    df = tokens.groupBy("country", "ttype", "token").agg(F.count(F.lit(1)).alias("df"))
    n = records.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return df.join(n, "country").select("country", "ttype", "token", F.log((F.col("n") + 1) / F.col("df")).alias("idf"))


def weighted_tokens(records: DataFrame, types: tuple[str, ...] = IDF_TYPES) -> DataFrame:
    """(row_id, w_<type>...): arrays of (token, idf), so that a pair needs no further join."""
    idf = feature_idf(records, types)
    rows = explode_tokens(records, types).join(idf, ["country", "ttype", "token"])
    lists = [F.array_sort(F.collect_list(F.when(F.col("ttype") == t, F.struct("token", "idf")))).alias(f"w_{t}") for t in types]
    return rows.groupBy("row_id").agg(*lists)


def idf_overlap(q: Column, r: Column) -> dict[str, Column]:
    """shared, frac_q, frac_r, max_shared, miss_q, miss_r of two arrays of (token, idf)."""
    none = F.array().cast("array<struct<token:string,idf:double>>")
    q, r = F.coalesce(q, none), F.coalesce(r, none)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["idf"])
    top = lambda a: F.coalesce(F.array_max(F.transform(a, lambda x: x["idf"])), F.lit(0.0))
    both = F.array_intersect(q, r)
    share = lambda a: F.when(total(a) > 0, total(both) / total(a))
    return {"idf_shared": total(both), "idf_frac_q": share(q), "idf_frac_r": share(r), "idf_max_shared": top(both), "idf_miss_q": top(F.array_except(q, r)), "idf_miss_r": top(F.array_except(r, q))}


def legal_relation(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    inside = lambda s, t: F.size(F.array_except(s, t)) == 0
    return F.when((a == "") & (b == ""), 0).when((a == "") | (b == ""), 4).when(inside(x, y) & inside(y, x), 1).when(inside(x, y) | inside(y, x), 2).otherwise(3)


def number_features(qn: Column, rn: Column, qc: Column, rc: Column) -> dict[str, Column]:
    a, b, c, d = (words(x) for x in (qn, rn, qc, rc))
    known, coded = (qn != "") & (rn != ""), (qc != "") & (rc != "")
    jaccard = lambda x, y: F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    flag = lambda x: x.cast("double")
    return {
        "num_first_q_in_r": F.when(known, flag(F.array_contains(b, F.get(a, 0)))), "num_first_r_in_q": F.when(known, flag(F.array_contains(a, F.get(b, 0)))), "num_jacc": F.when(known, jaccard(a, b)),
        "num_q_missing": F.when(known, flag(F.size(F.array_except(a, b)))), "num_r_extra": F.when(known, flag(F.size(F.array_except(b, a)))),
        "code_first_lev": F.when(coded, flag(F.levenshtein(F.get(c, 0), F.get(d, 0)))), "code_first_eq": F.when(coded, flag(F.get(c, 0) == F.get(d, 0))), "code_jacc": F.when(coded, jaccard(c, d)),
    }


def context_features(pairs: DataFrame) -> DataFrame:
    """Adds blk_frac_qmax, r_ncand, r_rank, blk_frac_rmax from the candidate graph (q, r, score, rank)."""
    q, r = Window.partitionBy("q"), Window.partitionBy("r")
    share = lambda w: F.when(F.max("score").over(w) > 0, F.col("score") / F.max("score").over(w)).otherwise(0.0)
    return pairs.withColumns({"blk_frac_qmax": share(q), "r_ncand": F.count(F.lit(1)).over(r), "r_rank": F.row_number().over(r.orderBy(F.desc("score"), "q")) - 1, "blk_frac_rmax": share(r)})


def record_keys(records: DataFrame, *more: str) -> DataFrame:
    """(row_id, code, compact, address): first code, name and address without spaces; null where missing. more: other columns."""
    known = lambda c: F.when(c != "", c)
    return records.select("row_id", known(F.get(F.split("codes", " "), F.lit(0))).alias("code"), known(F.replace("name_core", F.lit(" "), F.lit(""))).alias("compact"), known(F.replace("addr_norm", F.lit(" "), F.lit(""))).alias("address"), *more)


def _key_of_query(pairs: DataFrame, records: DataFrame) -> DataFrame:
    return pairs.join(record_keys(records).select(F.col("row_id").alias("q"), F.col("code").alias("q_code")), "q")


def _keys_of_record(pairs: DataFrame, records: DataFrame, *more: str) -> DataFrame:
    names = {"row_id": "r", "code": "r_code", "compact": "r_name", "address": "r_addr"}
    keys = record_keys(records, *more)
    return pairs.join(keys.select(*[F.col(c).alias(names.get(c, f"r_{c}")) for c in keys.columns]), "r")


def with_keys(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Adds r_code, r_name, r_addr and q_code."""
    return _key_of_query(_keys_of_record(pairs, records), records)


def with_facts(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """with_keys(), r_source and r_addr_empty. The pairs go by q while they are narrow, then once by r: a join or window on r
    that follows needs no further exchange."""
    return _keys_of_record(_key_of_query(pairs, records), records, "source", "addr_empty")


def support_features(keyed: DataFrame) -> DataFrame:
    """Adds code_support, code_support_s1 and name_support: how many candidates of the same query agree."""
    same = lambda c: F.when(F.col(c).isNotNull(), F.count(F.lit(1)).over(Window.partitionBy("q", c)) - 1)
    agree = F.sum(F.when(F.col("r_code") == F.col("q_code"), 1).otherwise(0)).over(Window.partitionBy("q"))
    return keyed.withColumns({"code_support": same("r_code"), "code_support_s1": agree, "name_support": same("r_name")})


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """All 54 features of (q, r, score, rank); records carry normalised columns and token arrays."""
    base = support_features(with_keys(context_features(pairs), records)).withColumnsRenamed({"score": "blk_score", "rank": "blk_rank"})
    weights = weighted_tokens(records)
    side = records.select("row_id", *ATTRIBUTES).join(weights, "row_id", "left")
    for p in ("q", "r"):
        base = base.join(side.select(F.col("row_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in side.columns if c != "row_id"]), p)
    q, r = (lambda c: F.col(f"q_{c}")), (lambda c: F.col(f"r_{c}"))
    compact = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    phon = lambda c: joined(F.transform(words(c), phonetic_key))
    if_address = lambda c: F.when(~r("addr_empty"), c)
    flag = lambda c: c.cast("double")
    out = {
        "n_ratio": similarity("ratio", q("name_core"), r("name_core")), "n_tsort": similarity("token_sort", q("name_core"), r("name_core")), "n_tset": similarity("token_set", q("name_core"), r("name_core")),
        "n_partial": similarity("partial", q("name_core"), r("name_core")), "n_jw": similarity("jaro_winkler", q("name_core"), r("name_core")),
        "n_compact_ratio": similarity("ratio", compact(q("name_core")), compact(r("name_core"))), "n_compact_partial": similarity("partial", compact(q("name_core")), compact(r("name_core"))),
        "n_full_ratio": similarity("ratio", q("name_full"), r("name_full")), "n_alias_tset": similarity("token_set", q("name_core"), F.when(r("name_alias") != "", r("name_alias"))),
        "n_phon_ratio": similarity("ratio", phon(q("name_core")), phon(r("name_core"))),
        "n_first_eq": flag((q("name_core") != "") & F.get(words(q("name_core")), 0).eqNullSafe(F.get(words(r("name_core")), 0))), "n_tok_q": F.size(words(q("name_core"))), "n_tok_r": F.size(words(r("name_core"))),
        "legal_rel": legal_relation(q("legal"), r("legal")), "r_has_alias": flag(r("name_alias") != ""),
        "a_ratio": similarity("ratio", q("addr_norm"), if_address(r("addr_norm"))), "a_tsort": similarity("token_sort", q("addr_norm"), if_address(r("addr_norm"))), "a_tset": similarity("token_set", q("addr_norm"), if_address(r("addr_norm"))),
        "state_eq": F.when((q("state") != "") & (r("state") != ""), flag(q("state") == r("state"))),
    }
    out |= {f"n_{k}": v for k, v in idf_overlap(q("w_name"), r("w_name")).items()}
    take = lambda t, prefix, *names: {f"{prefix}_{n}": idf_overlap(q(f"w_{t}"), r(f"w_{t}"))[n] for n in names}
    out |= take("phon", "p", "idf_frac_q", "idf_frac_r") | take("addrw", "a", "idf_frac_q", "idf_frac_r", "idf_miss_q") | take("addrc", "c", "idf_frac_q", "idf_frac_r")
    out["street_shared"] = idf_overlap(q("w_street"), r("w_street"))["idf_shared"]
    out |= number_features(q("nums"), r("nums"), q("codes"), r("codes"))
    kept = ["blk_score", "blk_rank", "blk_frac_qmax", "r_ncand", "r_rank", "blk_frac_rmax", "code_support", "code_support_s1", "name_support"]
    return base.select("q", "r", *[v.alias(k) for k, v in out.items()], *[flag(r(c)).alias(f"r_{c}") for c in ("is_domain", "is_indic", "addr_empty", "source")], *kept)


def rule_score(name: Column, domain: Column, compact_partial: Column, alias: Column, indic: Column, phon: Column, addr_empty: Column, addr: Column, code_eq: Column) -> Column:
    """0.55 name + 0.30 address + 0.15 number, each from 0 to 1."""
    best = F.greatest(name, F.when(domain > 0, compact_partial), F.coalesce(alias, F.lit(0.0)))
    best = F.greatest(best, F.when(indic > 0, phon))
    return 0.55 * best / 100 + 0.30 * F.when(addr_empty > 0, 50.0).otherwise(addr) / 100 + 0.15 * F.coalesce(code_eq, F.lit(0.5))


def with_rule_score(features: DataFrame) -> DataFrame:
    c = F.col
    return features.withColumn("p", rule_score(c("n_tset"), c("r_is_domain"), c("n_compact_partial"), c("n_alias_tset"), c("r_is_indic"), c("n_phon_ratio"), c("r_addr_empty"), c("a_tset"), c("code_first_eq")))
