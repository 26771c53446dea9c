"""The matching operators as queries over a record view of `documents`, with the same in DuckDB SQL.

The view makes a record of each document: source 1 + id mod 3, the language as country, the first six words as the name,
the length and the next four words as the address. Names and addresses are cut at everything but ASCII letters and digits,
which both engines do alike. Two documents with one text and language in different sources are a true pair.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlode.functions import addresses, names, script, tokens
from kinlode.functions.similarity import similarity
from kinlode.operators import blocking, decide, evaluate, features, graph_features, model
from kinlode.plans import features_sql, normaliser_sql, scratch
from kinlode.sources import tsv

PARAMS = blocking.BlockingParams()  # as in production: best 20 and 8, all types, tokens of at most 5000 records
SPACE = r"[\x09-\x0D\x20]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rec_view(spark, sf_dir):
    ws = F.filter(F.split("text", SPACE), lambda w: w != "")
    d = documents(spark, sf_dir).select("doc_id", "lang", F.col("source").alias("src"), "n_chars", ws.alias("ws"))
    source = (F.col("doc_id") % 3 + 1).cast("int")
    address = F.concat(F.col("n_chars").cast("string"), F.lit(" "), F.array_join(F.slice("ws", 7, 4), " "), F.lit(", "), F.col("src"))
    return d.select(
        (source * F.lit(10**12) + F.col("doc_id")).alias("row_id"), F.concat(F.lit("S"), source.cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), source.alias("source"), F.col("lang").alias("country"),
        F.array_join(F.slice("ws", 1, 6), " ").alias("business_name"), F.when(F.col("doc_id") % 25 == 0, "").otherwise(address).alias("business_address"),
    )


def records(spark, sf_dir):
    """Records in the light normal form, with tokens."""
    cut = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    address = F.filter(F.split(F.lower("business_address"), "[^a-z0-9]+"), lambda w: w != "")
    numbers = F.array_join(F.filter(address, lambda w: w.rlike("[0-9]")), " ")
    r = rec_view(spark, sf_dir).withColumns({"name_core": F.array_join(cut("business_name"), " "), "addr_norm": F.array_join(address, " "), "codes": numbers, "nums": numbers})
    r = r.withColumns({"name_alias": F.lit(""), "state": F.lit(""), "legal": F.lit(""), "name_full": F.col("name_core"), "is_domain": F.lit(False), "is_indic": F.lit(False), "addr_empty": F.col("addr_norm") == ""})
    return tokens.with_tokens(r)


def truth(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "lang", F.sha2("text", 256).alias("h"), ((F.col("doc_id") % 3 + 1) * F.lit(10**12) + F.col("doc_id")).alias("id"), (F.col("doc_id") % 3 + 1).alias("s"))
    a, b = d.filter("s = 1").select(F.col("id").alias("q"), "lang", "h"), d.filter("s <> 1").select(F.col("id").alias("r"), "lang", "h")
    return a.join(b, ["lang", "h"]).select("q", "r")


def entities(spark, sf_dir):
    return rec_view(spark, sf_dir).filter("source = 1").select(F.col("row_id").alias("q"), F.col("country").alias("grp"))


def blocked(spark, sf_dir):
    return blocking.block(records(spark, sf_dir), PARAMS)


def cands(spark, sf_dir):
    """The candidates from a table of their own: what follows reads them twice or more, and blocking's shuffle files can go."""
    return scratch.written(blocked(spark, sf_dir), "candidates")


def with_p(pairs):
    return pairs.withColumn("p", F.round(F.col("score") / (F.col("score") + 20), 6))


def graph(spark, sf_dir):
    """Candidates with a stand-in probability, keys and record facts."""
    return features.with_facts(with_p(cands(spark, sf_dir)), records(spark, sf_dir))


def round_all(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def token_query(kind):
    return lambda spark, sf_dir: records(spark, sf_dir).select("row_id", F.explode(kind).alias("token"))


def light_tokens(spark, sf_dir):
    return tokens.explode_tokens(records(spark, sf_dir), PARAMS.types)


def sided(spark, sf_dir, *columns):
    """Candidates with columns of both records."""
    r = records(spark, sf_dir)
    out = cands(spark, sf_dir)
    for side in ("q", "r"):
        out = out.join(r.select(F.col("row_id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
    return out


def pick(*names):
    return lambda df: df.select(*names)


def q_overlap(spark, sf_dir):
    w = features.weighted_tokens(records(spark, sf_dir), ("name", "addrw"))
    out = cands(spark, sf_dir)
    for side in ("q", "r"):
        out = out.join(w.select(F.col("row_id").alias(side), F.col("w_name").alias(f"{side}_w")), side, "left")
    return round_all(out.select("q", "r", *[c.alias(k) for k, c in features.idf_overlap(F.col("q_w"), F.col("r_w")).items()]))


def q_numbers(spark, sf_dir):
    s = sided(spark, sf_dir, "nums", "codes")
    return round_all(s.select("q", "r", *[c.alias(k) for k, c in features.number_features(F.col("q_nums"), F.col("r_nums"), F.col("q_codes"), F.col("r_codes")).items()]))


def q_jw(spark, sf_dir):
    s = sided(spark, sf_dir, "name_core").filter("q_name_core <> '' and r_name_core <> ''")
    return s.select("q", "r", F.round(similarity("jaro_winkler", F.col("q_name_core"), F.col("r_name_core")) / 100, 5).alias("jw"), F.levenshtein("q_name_core", "r_name_core").cast("long").alias("lev"))


def q_ratios(spark, sf_dir):
    s = sided(spark, sf_dir, "name_core", "addr_norm")
    return round_all(s.select("q", "r", *[similarity(k, F.col("q_name_core"), F.col("r_name_core")).alias(k) for k in ("ratio", "token_sort", "token_set", "partial")], similarity("token_set", F.col("q_addr_norm"), F.col("r_addr_norm")).alias("addr_token_set")))


def q_features(spark, sf_dir):
    return round_all(features.with_rule_score(features.pair_features(cands(spark, sf_dir), records(spark, sf_dir))))


def q_neighbours(spark, sf_dir):
    return graph_features.neighbour_pairs(graph(spark, sf_dir))


def q_gbt(spark, sf_dir):
    r = records(spark, sf_dir)
    base = blocking.with_labels(features.context_features(cands(spark, sf_dir)), truth(spark, sf_dir)).select("q", "r", "y", "score", F.col("rank").alias("place"), "blk_frac_qmax", "r_ncand", "r_rank", "blk_frac_rmax")
    keyed = features.support_features(features.with_keys(base, r)).drop("r_code", "r_name", "r_addr", "q_code")
    return model.cross_fit(keyed, folds=2, share=1.0, rounds=3, depth=3)


NAME_COLUMNS = ["row_id", "name_full", "name_core", "name_alias", "legal", "is_domain", "is_indic"]
ADDRESS_COLUMNS = ["row_id", "addr_norm", "state", "nums", "codes", "addr_empty"]
# What names and address components are written with, by row.
NAME_ENDS = (" L.L.C.", " (Pvt.) Ltd", " & Sons #12", " d/b/a Other Name, Inc.", " t0ols 4you 12345", ".com", " a/k/a The Q.R. Company")
ADDRESS_ENDS = (("US", ", New Mexico"), ("India", ", 2nd Floor, Orissa"), ("France", ", 007 R. du Moulin bis, Hauts-de-France"), ("us", ", Apt.No 12-B, TX, NM"), ("India", ", 12 Goa, null, Nagar Rd"), ("Nowhere", ", P.O. Box 0040, tx"))


def q_names(spark, sf_dir):
    return names.normalize_names(rec_view(spark, sf_dir)).select(*NAME_COLUMNS)


def q_name_forms(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, NAME_ENDS)), F.pmod("row_id", F.lit(len(NAME_ENDS))).cast("int") + 1)
    return names.normalize_names(rec_view(spark, sf_dir).select("row_id", F.concat("business_name", end).alias("business_name"))).select(*NAME_COLUMNS)


def q_address_forms(spark, sf_dir):
    pick = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in ADDRESS_ENDS]), F.pmod("row_id", F.lit(len(ADDRESS_ENDS))).cast("int") + 1)
    r = rec_view(spark, sf_dir).select("row_id", F.concat("business_address", pick(1)).alias("business_address"), pick(0).alias("country"))
    return addresses.normalize_addresses(r).select(*ADDRESS_COLUMNS)


def whole_texts(spark, sf_dir, column):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("row_id"), F.col("text").alias(column), F.col("lang").alias("country"))


def q_segmenter(spark, sf_dir):
    r = rec_view(spark, sf_dir)
    vocab = names.vocabulary(names.word_counts(names.normalize_names(r.filter("source = 1"))))
    glued = r.filter("source <> 1").select("row_id", F.array_join(F.slice(F.filter(F.split(F.lower("business_name"), "[^a-z]+"), lambda w: w != ""), 1, 2), "").alias("business_name"))
    return names.normalize_names(glued, vocab=vocab).select("row_id", "business_name", "name_core")


def q_legal(spark, sf_dir):
    forms = F.element_at(F.array(*map(F.lit, ("llc", "limited", "sarl", "gmbh", "the company"))), F.pmod("row_id", F.lit(5)).cast("int") + 1)
    r = records(spark, sf_dir).select("row_id", F.split(F.concat_ws(" ", "name_core", forms), " ").alias("t"))
    t = F.filter("t", lambda w: w != "")
    return r.select("row_id", names.joined(names.core_of(t)).alias("core"), names.joined(names.legal_of(t)).alias("legal"))


def q_alias(spark, sf_dir):
    form = F.element_at(F.array(*map(F.lit, (" fka ", " d/b/a ", " aka ", " formerly known as ", " ; "))), F.pmod("row_id", F.lit(5)).cast("int") + 1)
    parts = names.name_and_alias(F.concat("name_core", form, F.lit("other name")))
    return records(spark, sf_dir).select("row_id", F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("alias"))


def q_domain(spark, sf_dir):
    ends = F.element_at(F.array(*map(F.lit, (".com", "com", ".co.in", ".xyz", ""))), F.pmod("row_id", F.lit(5)).cast("int") + 1)
    r = records(spark, sf_dir).select("row_id", F.concat(F.replace("name_core", F.lit(" "), F.lit("-")), ends).alias("t"))
    return r.select("row_id", names.is_domain(F.col("t")).alias("is_domain"), names.without_domain(F.col("t")).alias("name"))


def q_lists(name, pairs):
    return lambda spark, sf_dir: tsv.id_lists(rec_view(spark, sf_dir), pairs(spark, sf_dir), name).drop("q")


def kept(spark, sf_dir, found=None):
    return decide.decide(with_p(found or cands(spark, sf_dir)), decide.DecisionParams(True, "threshold", 0.6)).select("q", "r")


def q_errors(spark, sf_dir):
    found = cands(spark, sf_dir)
    return evaluate.errors(entities(spark, sf_dir), found, kept(spark, sf_dir, found), truth(spark, sf_dir))


def queries() -> dict:
    keyed = lambda s, d: tokens.key_tokens(records(s, d))
    out = {
        "rec_view": rec_view,
        "light_records": lambda s, d: records(s, d).select("row_id", "name_core", "addr_norm", "codes", "addr_empty"),
        "legal_split": q_legal, "alias_split": q_alias, "domain_detect": q_domain,
        "phonetic_key": lambda s, d: records(s, d).select(F.explode("name").alias("word")).distinct().select("word", names.phonetic_key(F.col("word")).alias("key")),
        **{f"tokens_{k}": token_query(k) for k in tokens.TYPES},
        "token_df": lambda s, d: blocking.token_frequency(light_tokens(s, d)),
        "token_idf_blocking": lambda s, d: round_all(blocking.blocking_idf(records(s, d), light_tokens(s, d), PARAMS)),
        "token_idf_feature": lambda s, d: round_all(features.feature_idf(records(s, d), ("name", "addrw"))),
        "block_key_a": lambda s, d: blocking.block_by_keys(keyed(s, d), PARAMS.max_df),
        "block_meta_b": lambda s, d: blocked(s, d).withColumn("score", F.round("score", 6)),
        "block_one_channel": lambda s, d: blocking.block(records(s, d), blocking.BlockingParams(k=5, k_empty=0)).select("q", "r", "rank"),
        "block_sample": lambda s, d: blocking.block(records(s, d), PARAMS, model.sample_queries(entities(s, d), 0.5).select(F.col("q").alias("row_id"))).select("q", "r", "rank"),
        "pair_labels": lambda s, d: blocking.with_labels(cands(s, d), truth(s, d)).select("q", "r", "y"),
        "truth_pairs": truth,
        "ctx_features": lambda s, d: round_all(features.context_features(cands(s, d))),
        "support_features": lambda s, d: features.support_features(features.with_keys(cands(s, d), records(s, d))).select("q", "r", "code_support", "code_support_s1", "name_support"),
        "idf_overlap": q_overlap, "number_features": q_numbers,
        "token_counts": lambda s, d: sided(s, d, "name_core").select("q", "r", F.size(names.words(F.col("q_name_core"))).alias("n_tok_q"), F.size(names.words(F.col("r_name_core"))).alias("n_tok_r")),
        "jaro_winkler": q_jw, "ratio_family": q_ratios, "pair_features_rules": q_features,
        "competition": lambda s, d: round_all(graph_features.competition(with_p(cands(s, d)).drop("score", "rank"))),
        "mass": lambda s, d: round_all(graph_features.mass(graph(s, d)).select("q", "r", "code_mass", "name_mass", "addr_mass", "other_cluster_mass", "own_cluster_is_q_code", "xsrc_code_p", "p1_rank_q_src", "q_src_sum_p1", "q_sum_p1_empty", "q_sum_p1_nonempty", "r_n_claim_01")),
        "neighbour_pairs": q_neighbours,
        "neighbour_features": lambda s, d: round_all(graph_features.neighbours(graph(s, d), records(s, d)), 9),
        "exclusive": lambda s, d: decide.exclusive(with_p(cands(s, d))).select("q", "r"),
        "decide_threshold": kept,
        "decide_expected_f": lambda s, d: decide.by_expected_f(decide.exclusive(with_p(cands(s, d))), 0.02, 1.25).select("q", "r"),
        "tune_grid": lambda s, d: round_all(evaluate.tuning_grid(entities(s, d), with_p(cands(s, d)), truth(s, d))),
        "f05_entity": lambda s, d: round_all(evaluate.entity_f05(entities(s, d), kept(s, d), truth(s, d))),
        "f05_macro": lambda s, d: round_all(evaluate.macro_f05(entities(s, d), kept(s, d), truth(s, d))),
        "f05_breakdown": lambda s, d: round_all(evaluate.breakdown(entities(s, d), kept(s, d), truth(s, d))),
        "blocking_report": lambda s, d: round_all(evaluate.blocking_report(entities(s, d), cands(s, d), truth(s, d))),
        "blocking_report_groups": lambda s, d: round_all(evaluate.blocking_report(entities(s, d), cands(s, d), truth(s, d), "grp")),
        "error_kinds": q_errors,
        "folds": lambda s, d: entities(s, d).select("q", model.bucket(F.col("q"), 3).alias("fold")),
        "s1_sample": lambda s, d: model.sample_queries(entities(s, d), 0.4).select("q"),
        "matching_results": q_lists("matched_entity_ids", kept), "candidate_pairs": q_lists("candidate_entity_ids", lambda s, d: cands(s, d).select("q", "r")),
        "output_check": lambda s, d: tsv.check_lists(q_lists("matched_entity_ids", kept)(s, d), "matched_entity_ids"),
        "fold_text": lambda s, d: documents(s, d).select("doc_id", script.fold(F.col("text")).alias("folded")),
        "names_full": q_names, "segmenter": q_segmenter, "name_forms": q_name_forms, "address_forms": q_address_forms,
        "addresses_full": lambda s, d: addresses.normalize_addresses(rec_view(s, d)).select(*ADDRESS_COLUMNS),
        "names_text": lambda s, d: names.normalize_names(whole_texts(s, d, "business_name")).select(*NAME_COLUMNS),
        "addresses_text": lambda s, d: addresses.normalize_addresses(whole_texts(s, d, "business_address")).select(*ADDRESS_COLUMNS),
        "gbt_oof": q_gbt,
    }
    return {name: _long(query) for name, query in out.items()}


def _long(query):
    """Whole numbers as 64 bits, as in the SQL."""

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])

    return run


def _chain(*names: str) -> str:
    """The named steps and all that they read, as common table expressions."""
    wanted, todo = [], list(names)
    while todo:
        n = todo.pop()
        if n not in wanted:
            wanted.append(n)
            todo += [m for m in STEPS if m != n and f" {m} " in f" {STEPS[n]} ".replace("(", " ").replace(")", " ").replace(",", " ").replace("\n", " ")]
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in STEPS if n in wanted) + "\n"


_collapse = "translate(w, 'bfpvcgjkqsxzdtlmnraeiouyhw', '111122222222334556')"
for _d in "0123456789":
    _collapse = f"regexp_replace({_collapse}, '{_d}+', '{_d}', 'g')"
KEY = f"CASE WHEN w = '' OR regexp_full_match(w, '[0-9]+') THEN w ELSE (CASE WHEN regexp_matches(w, '^[aeiouy]') THEN '0' ELSE '' END) || {_collapse} END"
_key_of = lambda column: f"list_transform({column}, lambda w: {KEY})"
_pairs_of = lambda column: f"CASE WHEN len({column}) > 1 THEN list_transform(range(1, len({column})), lambda i: least({column}[i], {column}[i + 1]) || ' ' || greatest({column}[i], {column}[i + 1])) ELSE [] END"
_cross_of = lambda a, b: f"flatten(list_transform({a}, lambda x: list_transform({b}, lambda y: x || '|' || y)))"
_GLUED = "SELECT row_id, array_to_string(list_filter(string_split_regex(lower(business_name), '[^a-z]+'), lambda x: x <> '')[1:2], '') AS business_name FROM rec WHERE source <> 1"
_cut = lambda column: f"list_filter(string_split_regex(lower({column}), '[^a-z0-9]+'), lambda x: x <> '')"
_prob = "round(score / (score + 20), 6)"

STEPS = {
    "rec": f"""SELECT (1 + doc_id % 3) * 1000000000000 + doc_id AS row_id, 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, (1 + doc_id % 3) AS source, lang AS country, array_to_string(ws[1:6], ' ') AS business_name,
      CASE WHEN doc_id % 25 = 0 THEN '' ELSE n_chars || ' ' || array_to_string(ws[7:10], ' ') || ', ' || src END AS business_address
      FROM (SELECT doc_id, lang, source AS src, n_chars, list_filter(string_split_regex(text, '{SPACE}'), lambda x: x <> '') AS ws FROM documents)""",
    "cut": f"SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS name, list_filter(addr, lambda x: regexp_matches(x, '[0-9]')) AS nums, len(addr) = 0 AS addr_empty FROM (SELECT *, {_cut('business_name')} AS raw, {_cut('business_address')} AS addr FROM rec )",
    "lists": f"""SELECT *, {_cross_of('phon', 'addrw')} AS pa, {_cross_of('addrc', 'addrw')} AS ca FROM (SELECT *, array_to_string(name, '') AS compact,
      list_distinct({_key_of("list_filter(name, lambda x: length(x) > 2 AND NOT regexp_full_match(x, '[0-9]+'))")}) AS phon,
      list_distinct(list_concat(list_transform(list_filter(name, lambda x: length(x) >= 5), lambda x: x[1:5]), CASE WHEN length(array_to_string(name, '')) >= 5 THEN [array_to_string(name, '')[1:5]] ELSE [] END)) AS pref,
      list_distinct(list_filter(addr, lambda x: NOT regexp_matches(x, '[0-9]'))) AS addrw, list_distinct(nums) AS addrc,
      list_distinct(list_transform(list_filter(range(1, len(addr)), lambda i: regexp_matches(addr[i], '[0-9]') AND NOT regexp_matches(addr[i + 1], '[0-9]')), lambda i: addr[i] || '|' || addr[i + 1])) AS street,
      list_distinct(list_concat(CASE WHEN len(name) > 0 THEN ['=' || array_to_string(name, '')] ELSE [] END, {_pairs_of('name')})) AS nb,
      list_distinct(list_concat(CASE WHEN len(name) > 0 THEN ['=' || array_to_string(keys, ' ')] ELSE [] END, {_pairs_of('keys')})) AS pb FROM (SELECT *, {_key_of('name')} AS keys FROM cut ))""",
    "tok": "SELECT DISTINCT row_id, source, country, ttype, token FROM (" + " UNION ALL ".join(f"SELECT row_id, source, country, '{k}' AS ttype, unnest({k}) AS token FROM lists " for k in tokens.TYPES) + ")",
    "freq": "SELECT country, ttype, token, count(*) AS df FROM tok WHERE source <> 1 GROUP BY ALL",
    "idf": "SELECT freq.*, ln(n / df) AS idf FROM freq JOIN (SELECT country, count(*) AS n FROM rec WHERE source <> 1 GROUP BY country) USING (country) WHERE df <= 5000",
    "scored": "SELECT a.row_id AS q, b.row_id AS r, round(sum(idf), 9) AS score FROM tok a JOIN idf USING (country, ttype, token) JOIN tok b USING (country, ttype, token) WHERE a.source = 1 AND b.source <> 1 GROUP BY ALL",
    "cands": "SELECT q, r, score, rank FROM (SELECT s.*, addr_empty, row_number() OVER (PARTITION BY q, source, addr_empty ORDER BY score DESC, r) - 1 AS rank FROM scored s JOIN cut ON r = row_id) WHERE rank < CASE WHEN addr_empty THEN 8 ELSE 20 END",
    "probs": f"SELECT *, {_prob} AS p FROM cands",
    "truth": "SELECT (a.doc_id % 3 + 1) * 1000000000000 + a.doc_id AS q, (b.doc_id % 3 + 1) * 1000000000000 + b.doc_id AS r FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang WHERE a.doc_id % 3 = 0 AND b.doc_id % 3 <> 0",
    "ents": "SELECT row_id AS q, country AS grp FROM rec WHERE source = 1",
    "keyed": "SELECT c.*, b.source AS r_source, b.addr_empty AS r_addr_empty, b.nums[1] AS r_code, nullif(array_to_string(b.name, ''), '') AS r_name, nullif(array_to_string(b.addr, ''), '') AS r_addr, a.nums[1] AS q_code FROM probs c JOIN cut a ON c.q = a.row_id JOIN cut b ON c.r = b.row_id",
    "single": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p DESC, q) AS nth FROM probs ) WHERE nth = 1",
    "kept": "SELECT q, r FROM single WHERE p >= 0.6",
    "counts": "SELECT q, grp, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM ents LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY q) USING (q) LEFT JOIN (SELECT q, count(*) AS n_pred, count(t.r) AS tp FROM kept k LEFT JOIN truth t USING (q, r) GROUP BY q) USING (q)",
    "scores": "SELECT *, CASE WHEN n_true = 0 THEN (n_pred = 0)::INT::DOUBLE WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END AS f05 FROM counts",
    "found": "SELECT q, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM ents LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY q) USING (q) LEFT JOIN (SELECT q, count(*) AS n_pred, count(t.r) AS tp FROM cands k LEFT JOIN truth t USING (q, r) GROUP BY q) USING (q)",
}
SUMMARY = "round(avg(f05), 6) AS macro_f05, count(*) AS n, round(sum(tp) / nullif(sum(n_pred), 0), 6) AS micro_precision, round(sum(tp) / nullif(sum(n_true), 0), 6) AS micro_recall, sum(n_pred)::BIGINT AS pred_pairs"


def _fold(n: int, seed: int = model.SEED) -> str:
    return f"(('0x' || substr(md5('{seed}:' || q), 1, 8))::BIGINT % {n})"


def _expected(floor: float, boost: float) -> str:
    return f"""SELECT q, r FROM (SELECT *, min(CASE WHEN ef = best AND ef > none THEN k END) OVER (PARTITION BY q) AS size FROM (SELECT *, max(ef) OVER (PARTITION BY q) AS best FROM (
      SELECT q, r, k, none, CASE WHEN p < {floor} THEN -1 ELSE round(1.25 * run / (0.25 * total + k), 12) END AS ef FROM (SELECT q, r, p, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS run, sum(p) OVER (PARTITION BY q) AS total,
      exp(sum(ln(greatest(1 - p, 1e-12))) OVER (PARTITION BY q)) * {boost} AS none FROM single WINDOW w AS (PARTITION BY q ORDER BY p DESC, r))))) WHERE k <= size"""


def _lists(name: str, pairs: str) -> str:
    return f"SELECT entity_id AS source1_entity_id, coalesce(ids, '') AS {name} FROM (SELECT * FROM rec WHERE source = 1) x LEFT JOIN (SELECT q, string_agg(entity_id, ',' ORDER BY r) AS ids FROM {pairs} JOIN rec ON r = row_id GROUP BY q) ON q = row_id"


def oracle_sql() -> dict[str, str]:
    jaccard = lambda a, b: f"len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)"
    have = "len(a.nums) > 0 AND len(b.nums) > 0"
    case = lambda c, x, n: f"CASE WHEN {c} THEN ({x})::DOUBLE END AS {n}"
    rnd = lambda x, n: f"round({x}, 6) AS {n}"
    both = "FROM cands c JOIN cut a ON c.q = a.row_id JOIN cut b ON c.r = b.row_id"
    form = lambda forms: "([" + ", ".join(f"'{x}'" for x in forms) + "])[row_id % 5 + 1]"
    shared = "list_filter(a.w, lambda x: list_contains(b.w, x))"
    total = lambda x: f"coalesce(list_sum(list_transform({x}, lambda t: t.idf)), 0)"
    top = lambda x: f"coalesce(list_max(list_transform({x}, lambda t: t.idf)), 0)"
    less = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
    weights = "fi AS (SELECT country, token, ln((any_value(n) + 1) / count(*)) AS idf FROM (SELECT country, row_id, unnest(name) AS token FROM cut) JOIN (SELECT country, count(*) AS n FROM rec GROUP BY country) USING (country) GROUP BY country, token), wt AS (SELECT row_id, list({'token': token, 'idf': idf}) AS w FROM (SELECT country, row_id, unnest(name) AS token FROM cut) JOIN fi USING (country, token) GROUP BY row_id), cw AS (SELECT row_id, coalesce(w, []) AS w FROM cut LEFT JOIN wt USING (row_id))"
    numbers = [case(have, "list_contains(b.nums, a.nums[1])", "num_first_q_in_r"), case(have, "list_contains(a.nums, b.nums[1])", "num_first_r_in_q"), f"CASE WHEN {have} THEN round({jaccard('a.nums', 'b.nums')}, 6) END AS num_jacc", case(have, f"len(list_distinct({less('a.nums', 'b.nums')}))", "num_q_missing"), case(have, f"len(list_distinct({less('b.nums', 'a.nums')}))", "num_r_extra"), case(have, "levenshtein(a.nums[1], b.nums[1])", "code_first_lev"), case(have, "a.nums[1] = b.nums[1]", "code_first_eq"), f"CASE WHEN {have} THEN round({jaccard('a.nums', 'b.nums')}, 6) END AS code_jacc"]
    out = {
        "rec_view": _chain("rec") + "SELECT * FROM rec",
        "light_records": _chain("cut") + "SELECT row_id, array_to_string(name, ' ') AS name_core, array_to_string(addr, ' ') AS addr_norm, array_to_string(nums, ' ') AS codes, addr_empty FROM cut",
        "phonetic_key": _chain("cut") + f"SELECT word, {KEY.replace('(w', '(word').replace('WHEN w', 'WHEN word').replace('THEN w', 'THEN word')} AS key FROM (SELECT DISTINCT unnest(name) AS word FROM cut)",
        "legal_split": _chain("cut") + f"SELECT row_id, array_to_string(list_filter(t, lambda x: NOT list_contains({list(names.C.LEGAL_FORMS) + names.C.NAME_STOP}, x)), ' ') AS core, coalesce(array_to_string(list_filter(list_transform(t, lambda x: map({list(names.C.LEGAL_FORMS)}, {list(names.C.LEGAL_FORMS.values())})[x]), lambda x: x IS NOT NULL), ' '), '') AS legal FROM (SELECT row_id, list_filter(string_split(array_to_string(name, ' ') || ' ' || {form(('llc', 'limited', 'sarl', 'gmbh', 'the company'))}, ' '), lambda x: x <> '') AS t FROM cut)",
        "alias_split": _chain("cut") + f"SELECT row_id, trim(CASE WHEN row_id % 5 < 4 THEN n ELSE n || f || 'other name' END) AS name, CASE WHEN row_id % 5 < 4 THEN 'other name' ELSE '' END AS alias FROM (SELECT row_id, array_to_string(name, ' ') AS n, {form((' fka ', ' d/b/a ', ' aka ', ' formerly known as ', ' ; '))} AS f FROM cut)",
        "domain_detect": _chain("cut") + rf"""SELECT row_id, a OR b AS is_domain, CASE WHEN a THEN translate(regexp_extract(t, '{names.DOMAIN}', 1), '.-', '  ') WHEN b THEN regexp_extract(t, '{names.BARE_COM}', 1) ELSE t END AS name FROM (SELECT row_id, t, regexp_matches(t, '{names.DOMAIN}') AS a, regexp_matches(t, '{names.BARE_COM}') AS b FROM (SELECT row_id, array_to_string(name, '-') || {form(('.com', 'com', '.co.in', '.xyz', ''))} AS t FROM cut))""",
        **{f"tokens_{k}": _chain("lists") + f"SELECT row_id, unnest({k}) AS token FROM lists" for k in tokens.TYPES},
        "token_df": _chain("freq") + "SELECT * FROM freq",
        "token_idf_blocking": _chain("idf") + "SELECT country, ttype, token, df, round(idf, 6) AS idf FROM idf",
        "token_idf_feature": _chain("tok") + "SELECT country, ttype, token, round(ln((any_value(n) + 1) / count(*)), 6) AS idf FROM tok JOIN (SELECT country, count(*) AS n FROM rec GROUP BY country) USING (country) WHERE ttype IN ('name', 'addrw') GROUP BY country, ttype, token",
        "block_key_a": _chain("lists") + ", k AS (SELECT row_id, source, country, unnest(list_distinct(list_concat(street, CASE WHEN len(name) >= 2 THEN ['k2:' || least(name[1], name[2]) || ' ' || greatest(name[1], name[2])] ELSE [] END, CASE WHEN len(name) > 0 THEN ['kc:' || compact] ELSE [] END))) AS token FROM lists), d AS (SELECT country, token FROM k WHERE source <> 1 GROUP BY ALL HAVING count(*) <= 5000) SELECT a.row_id AS q, b.row_id AS r, count(*) AS score FROM k a JOIN d USING (country, token) JOIN k b USING (country, token) WHERE a.source = 1 AND b.source <> 1 GROUP BY ALL",
        "block_meta_b": _chain("cands") + "SELECT q, r, round(score, 6) AS score, rank FROM cands",
        "block_one_channel": _chain("scored", "rec") + "SELECT q, r, rank FROM (SELECT s.*, row_number() OVER (PARTITION BY q, source ORDER BY score DESC, r) - 1 AS rank FROM scored s JOIN rec ON r = row_id) WHERE rank < 5",
        "block_sample": _chain("cands") + f"SELECT q, r, rank FROM cands WHERE {_fold(10000, model.SEED + 1)} < 5000",
        "pair_labels": _chain("cands", "truth") + "SELECT DISTINCT q, r, t.r IS NOT NULL AS y FROM cands LEFT JOIN truth t USING (q, r)",
        "truth_pairs": _chain("truth") + "SELECT * FROM truth",
        "ctx_features": _chain("cands") + "SELECT q, r, round(score, 6) AS score, rank, round(CASE WHEN max(score) OVER a > 0 THEN score / max(score) OVER a ELSE 0 END, 6) AS blk_frac_qmax, count(*) OVER b AS r_ncand, row_number() OVER (PARTITION BY r ORDER BY score DESC, q) - 1 AS r_rank, round(CASE WHEN max(score) OVER b > 0 THEN score / max(score) OVER b ELSE 0 END, 6) AS blk_frac_rmax FROM cands WINDOW a AS (PARTITION BY q), b AS (PARTITION BY r)",
        "support_features": _chain("keyed") + "SELECT q, r, CASE WHEN r_code IS NOT NULL THEN count(*) OVER (PARTITION BY q, r_code) - 1 END AS code_support, sum(CASE WHEN r_code = q_code THEN 1 ELSE 0 END) OVER (PARTITION BY q)::BIGINT AS code_support_s1, CASE WHEN r_name IS NOT NULL THEN count(*) OVER (PARTITION BY q, r_name) - 1 END AS name_support FROM keyed",
        "idf_overlap": _chain("cands", "cut") + f", {weights} SELECT q, r, {rnd(total(shared), 'idf_shared')}, CASE WHEN {total('a.w')} > 0 THEN round({total(shared)} / {total('a.w')}, 6) END AS idf_frac_q, CASE WHEN {total('b.w')} > 0 THEN round({total(shared)} / {total('b.w')}, 6) END AS idf_frac_r, {rnd(top(shared), 'idf_max_shared')}, {rnd(top(less('a.w', 'b.w')), 'idf_miss_q')}, {rnd(top(less('b.w', 'a.w')), 'idf_miss_r')} FROM cands JOIN cw a ON q = a.row_id JOIN cw b ON r = b.row_id",
        "number_features": _chain("cands", "cut") + "SELECT q, r, " + ", ".join(numbers) + " " + both,
        "token_counts": _chain("cands", "cut") + f"SELECT q, r, len(a.name) AS n_tok_q, len(b.name) AS n_tok_r {both}",
        "jaro_winkler": _chain("cands", "cut") + f"SELECT q, r, round(jaro_winkler_similarity(array_to_string(a.name, ' '), array_to_string(b.name, ' ')), 5) AS jw, levenshtein(array_to_string(a.name, ' '), array_to_string(b.name, ' ')) AS lev {both} WHERE len(a.name) > 0 AND len(b.name) > 0",
        "competition": _chain("probs") + "SELECT q, r, p, p AS p1, row_number() OVER a - 1 AS p1_rank_q, round(CASE WHEN max(p) OVER b > 0 THEN p / max(p) OVER b ELSE 0 END, 6) AS p1_frac_qmax, round(sum(p) OVER b, 6) AS q_sum_p1, (sum((p > 0.5)::INT) OVER b)::BIGINT AS q_n_above_half, round(p - coalesce(lead(p) OVER a, 0), 6) AS p1_gap_q_next, round(m, 6) AS r_max_other, place - 1 AS p1_rank_r, round(sum(p) OVER (PARTITION BY r) - p, 6) AS r_sum_p1_other, round(p - m, 6) AS p1_gap_r_other FROM (SELECT *, row_number() OVER c AS place, CASE WHEN row_number() OVER c = 1 THEN coalesce(lead(p) OVER c, 0) ELSE first_value(p) OVER c END AS m FROM probs WINDOW c AS (PARTITION BY r ORDER BY p DESC, q)) WINDOW a AS (PARTITION BY q ORDER BY p DESC, r), b AS (PARTITION BY q)",
        "mass": _chain("keyed") + """, cl AS (SELECT q, r_code, sum(p) AS m FROM keyed WHERE r_code IS NOT NULL GROUP BY ALL), x AS (SELECT k.*, (SELECT coalesce(max(m), 0) FROM cl WHERE cl.q = k.q AND cl.r_code <> k.r_code) AS oc FROM keyed k)
          SELECT q, r, CASE WHEN r_code IS NOT NULL THEN round(sum(p) OVER (PARTITION BY q, r_code) - p, 6) END AS code_mass, CASE WHEN r_name IS NOT NULL THEN round(sum(p) OVER (PARTITION BY q, r_name) - p, 6) END AS name_mass, CASE WHEN r_addr IS NOT NULL THEN round(sum(p) OVER (PARTITION BY q, r_addr) - p, 6) END AS addr_mass,
          CASE WHEN r_code IS NOT NULL THEN round(oc, 6) END AS other_cluster_mass, CASE WHEN r_code IS NOT NULL THEN coalesce(r_code = q_code, false)::BIGINT END AS own_cluster_is_q_code, CASE WHEN r_code IS NOT NULL THEN round(coalesce(CASE WHEN r_source = 2 THEN max(CASE WHEN r_source = 3 THEN p END) OVER (PARTITION BY q, r_code) ELSE max(CASE WHEN r_source = 2 THEN p END) OVER (PARTITION BY q, r_code) END, 0), 6) END AS xsrc_code_p,
          row_number() OVER (PARTITION BY q, r_source ORDER BY p DESC, r) - 1 AS p1_rank_q_src, round(sum(p) OVER (PARTITION BY q, r_source), 6) AS q_src_sum_p1, round(sum(CASE WHEN r_addr_empty THEN p ELSE 0 END) OVER (PARTITION BY q), 6) AS q_sum_p1_empty, round(sum(CASE WHEN r_addr_empty THEN 0 ELSE p END) OVER (PARTITION BY q), 6) AS q_sum_p1_nonempty, (sum((p > 0.1)::INT) OVER (PARTITION BY r))::BIGINT AS r_n_claim_01 FROM x""",
        "neighbour_pairs": _chain("keyed") + ", o AS (SELECT q, r, p, r_addr_empty, row_number() OVER (PARTITION BY q ORDER BY p DESC, r) AS n FROM keyed), t AS (SELECT q, list({'r': r, 'p': p} ORDER BY n) AS tops FROM o WHERE n <= 3 GROUP BY q) SELECT q, r, p, u[1].r AS n1, u[1].p AS p1n, u[2].r AS n2, u[2].p AS p2n FROM (SELECT o.q, o.r, o.p, list_filter(tops, lambda x: x.r <> o.r) AS u FROM o JOIN t USING (q) WHERE r_addr_empty OR (p > 0.02 AND p < 0.98))",
        "exclusive": _chain("single") + "SELECT q, r FROM single",
        "decide_threshold": _chain("kept") + "SELECT * FROM kept",
        "decide_expected_f": _chain("single") + _expected(0.02, 1.25),
        "f05_entity": _chain("scores") + "SELECT q, n_true, n_pred, tp, round(f05, 6) AS f05 FROM scores",
        "f05_macro": _chain("scores") + f"SELECT {SUMMARY} FROM scores",
        "f05_breakdown": _chain("scores") + f"SELECT slice, {SUMMARY} FROM (SELECT *, unnest(['all', CASE WHEN n_true = 0 THEN 'singleton' ELSE 'non_singleton' END, CASE WHEN n_true >= 5 THEN 'matches=5+' WHEN n_true >= 2 THEN 'matches=2-4' WHEN n_true = 1 THEN 'matches=1' END, 'group=' || grp]) AS slice FROM scores) WHERE slice IS NOT NULL GROUP BY slice",
        "blocking_report": _chain("found") + "SELECT round(sum(tp) / nullif(sum(n_true), 0), 6) AS pair_recall, round(sum((n_true > 0 AND tp = n_true)::INT) / nullif(sum((n_true > 0)::INT), 0), 6) AS entity_full_recall, round(sum(n_pred) / count(*), 6) AS pairs_per_s1, sum(n_pred)::BIGINT AS total_pairs, round(avg(CASE WHEN n_true = 0 THEN (tp = 0)::INT WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / n_true) / (0.25 + tp / n_true) END), 6) AS oracle_f05 FROM found",
        "blocking_report_groups": _chain("found", "ents") + "SELECT grp, round(sum(tp) / nullif(sum(n_true), 0), 6) AS pair_recall, round(sum((n_true > 0 AND tp = n_true)::INT) / nullif(sum((n_true > 0)::INT), 0), 6) AS entity_full_recall, round(sum(n_pred) / count(*), 6) AS pairs_per_s1, sum(n_pred)::BIGINT AS total_pairs, round(avg(CASE WHEN n_true = 0 THEN (tp = 0)::INT WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / n_true) / (0.25 + tp / n_true) END), 6) AS oracle_f05 FROM found JOIN ents USING (q) GROUP BY grp",
        "error_kinds": _chain("kept", "truth", "cands") + "SELECT q, r, CASE WHEN t.q IS NOT NULL AND k.q IS NULL THEN CASE WHEN c.q IS NULL THEN 'fn_blocking' ELSE 'fn_matcher' END WHEN q NOT IN (SELECT q FROM truth) THEN 'fp_singleton' ELSE 'fp_other' END AS kind FROM (SELECT q, r, 1 AS one FROM truth UNION SELECT q, r, 1 FROM kept) LEFT JOIN (SELECT DISTINCT q, r FROM truth) t USING (q, r) LEFT JOIN kept k USING (q, r) LEFT JOIN cands c USING (q, r) WHERE t.q IS NULL OR k.q IS NULL",
        "folds": _chain("ents") + f"SELECT q, {_fold(3)} AS fold FROM ents",
        "s1_sample": _chain("ents") + f"SELECT q FROM ents WHERE {_fold(10000, model.SEED + 1)} < 4000",
        "matching_results": _chain("kept", "rec") + _lists("matched_entity_ids", "kept"),
        "candidate_pairs": _chain("cands", "rec") + _lists("candidate_entity_ids", "cands"),
        "output_check": _chain("kept", "rec") + f", l AS ({_lists('matched_entity_ids', 'kept')}), i AS (SELECT list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') AS ids FROM l) " + """SELECT 'repeated_s1' AS problem, (SELECT count(*) FROM (SELECT 1 FROM l GROUP BY source1_entity_id HAVING count(*) > 1)) AS n
      UNION ALL SELECT 'repeated_match', (SELECT count(*) FROM i WHERE len(ids) <> len(list_distinct(ids))) UNION ALL SELECT 'wrong_kind', (SELECT count(*) FROM i WHERE len(list_filter(ids, lambda x: NOT regexp_matches(x, '^S[23]-'))) > 0)""",
    }
    out["ratio_family"] = features_sql.ratio_family(_chain("cands", "lists"))
    out["pair_features_rules"] = features_sql.pair_features(_chain("cands", "lists", "tok", "rec", "keyed"), numbers)
    out["neighbour_features"] = features_sql.neighbours(_chain("keyed", "cut"), out["neighbour_pairs"].removeprefix(_chain("keyed") + ", ").join(("WITH ", "")))
    quoted = lambda items: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"
    ends = lambda items: f"({quoted(items)})[row_id % {len(items)} + 1]"
    named, sited = f"SELECT {', '.join(NAME_COLUMNS)} FROM n", f"SELECT {', '.join(ADDRESS_COLUMNS)} FROM a"
    out |= {
        "fold_text": f"SELECT doc_id, {normaliser_sql.fold('text')} AS folded FROM documents",
        "names_full": f"{_chain('rec')}, {normaliser_sql.names_of('SELECT row_id, business_name FROM rec')} {named}",
        "name_forms": f"{_chain('rec')}, {normaliser_sql.names_of(f'SELECT row_id, business_name || {ends(NAME_ENDS)} AS business_name FROM rec')} {named}",
        "names_text": f"WITH {normaliser_sql.names_of('SELECT doc_id AS row_id, text AS business_name FROM documents')} {named}",
        "addresses_full": f"{_chain('rec')}, {normaliser_sql.addresses_of('SELECT row_id, business_address, country FROM rec')} {sited}",
        "address_forms": f"{_chain('rec')}, {normaliser_sql.addresses_of(f'SELECT row_id, business_address || {ends([e[1] for e in ADDRESS_ENDS])} AS business_address, {ends([e[0] for e in ADDRESS_ENDS])} AS country FROM rec')} {sited}",
        "addresses_text": f"WITH {normaliser_sql.addresses_of('SELECT doc_id AS row_id, text AS business_address, lang AS country FROM documents')} {sited}",
        "segmenter": f"{_chain('rec')}, {normaliser_sql.segmented('SELECT row_id, business_name FROM rec WHERE source = 1', _GLUED)} SELECT row_id, business_name, name_core FROM n",
    }
    settings = ", ".join(f"({i}, {str(p.exclusive).lower()}, '{p.method}', {p.threshold}, {p.singleton_boost})" for i, p in enumerate(decide.grid()))
    expected = " UNION ALL ".join(f"SELECT {i} AS setting, q, r FROM ({_expected(p.threshold, p.singleton_boost)})" for i, p in enumerate(decide.grid()) if p.method == "expected_f")
    out["tune_grid"] = _chain("single", "truth", "ents") + f""", g(setting, exclusive, method, threshold, boost) AS (VALUES {settings}),
      pred AS (SELECT setting, q, r FROM g JOIN probs ON p >= threshold AND NOT exclusive AND method = 'threshold' UNION ALL SELECT setting, q, r FROM g JOIN single ON p >= threshold AND exclusive AND method = 'threshold' UNION ALL {expected}),
      t AS (SELECT q, coalesce(n_true, 0) AS n_true FROM ents LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY q) USING (q)),
      c AS (SELECT setting, q, count(*) AS n_pred, count(u.r) AS tp FROM pred LEFT JOIN truth u USING (q, r) GROUP BY setting, q),
      f AS (SELECT setting, CASE WHEN n_true = 0 THEN (coalesce(n_pred, 0) = 0)::INT WHEN coalesce(tp, 0) = 0 THEN 0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END AS f FROM (SELECT g.setting, t.q, t.n_true, c.n_pred, c.tp FROM g CROSS JOIN t LEFT JOIN c ON c.setting = g.setting AND c.q = t.q))
      SELECT g.setting::BIGINT AS setting, exclusive, method, threshold::DOUBLE AS threshold, boost::DOUBLE AS boost, round(avg(f), 6) AS macro_f05 FROM g JOIN f USING (setting) GROUP BY g.setting, exclusive, method, threshold, boost"""
    return out
