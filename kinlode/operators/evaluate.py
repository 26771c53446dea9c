"""Exact macro F0.5 and its parts. An entity without matches scores 1 if nothing is predicted, else 0; queries without
candidates count."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlode.operators.decide import DecisionParams, exclusive, expected_f, grid, prefix_order, prefix_sums


def f05(n_true: Column, n_pred: Column, tp: Column) -> Column:
    precision, recall = tp / F.greatest(n_pred, F.lit(1)), tp / F.greatest(n_true, F.lit(1))
    return F.when(n_true == 0, (n_pred == 0).cast("double")).when(tp == 0, 0.0).otherwise(1.25 * precision * recall / (0.25 * precision + recall))


def pair_counts(queries: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, n_true, n_pred, tp) of every query (q), from distinct pairs."""
    pred, truth = pred.select("q", "r").distinct(), truth.select("q", "r").distinct()
    both = pred.withColumn("p", F.lit(1)).join(truth.withColumn("t", F.lit(1)), ["q", "r"], "full_outer")
    counts = both.groupBy("q").agg(F.count("t").alias("n_true"), F.count("p").alias("n_pred"), F.count(F.col("p") * F.col("t")).alias("tp"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return queries.select("q").distinct().join(counts, "q", "left").select("q", zero("n_true"), zero("n_pred"), zero("tp"))


def entity_f05(queries: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    return pair_counts(queries, pred, truth).withColumn("f05", f05(F.col("n_true"), F.col("n_pred"), F.col("tp")))


def macro_f05(queries: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(macro_f05, n, micro_precision, micro_recall, pred_pairs), one row."""
    return entity_f05(queries, pred, truth).agg(*_summary())


def _summary() -> list[Column]:
    share = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    return [F.avg("f05").alias("macro_f05"), F.count(F.lit(1)).alias("n"), share("tp", "n_pred").alias("micro_precision"), share("tp", "n_true").alias("micro_recall"), F.sum("n_pred").alias("pred_pairs")]


def breakdown(queries: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """The summary for all, for entities with and without matches, by number of matches, and for each group of queries (q, grp)."""
    each = entity_f05(queries, pred, truth).join(queries.select("q", "grp"), "q")
    slices = F.array(F.lit("all"), F.when(F.col("n_true") == 0, "singleton").otherwise("non_singleton"), F.when(F.col("n_true") >= 5, "matches=5+").when(F.col("n_true") >= 2, "matches=2-4").when(F.col("n_true") == 1, "matches=1"), F.concat(F.lit("group="), F.coalesce("grp", F.lit("?"))))
    return each.withColumn("slice", F.explode(slices)).filter("slice is not null").groupBy("slice").agg(*_summary())


def blocking_report(queries: DataFrame, candidates: DataFrame, truth: DataFrame, *by: str) -> DataFrame:
    """(pair_recall, entity_full_recall, pairs_per_s1, total_pairs, oracle_f05): what blocking leaves possible, for all or for
    each value of the columns `by` of queries."""
    c = pair_counts(queries, candidates, truth).withColumn("oracle", f05(F.col("n_true"), F.col("tp"), F.col("tp")))
    c = (c.join(queries.select("q", *by), "q") if by else c).groupBy(*by)
    full = F.sum(F.when((F.col("n_true") > 0) & (F.col("tp") == F.col("n_true")), 1).otherwise(0))
    return c.agg(F.try_divide(F.sum("tp"), F.sum("n_true")).alias("pair_recall"), F.try_divide(full, F.count_if(F.col("n_true") > 0)).alias("entity_full_recall"), (F.sum("n_pred") / F.count(F.lit(1))).alias("pairs_per_s1"), F.sum("n_pred").alias("total_pairs"), F.avg("oracle").alias("oracle_f05"))


def _prefix_counts(single: DataFrame, settings: list[tuple]) -> DataFrame:
    """(setting, q, n_pred, tp) of expected-F settings (setting, floor, boost) over exclusive pairs with t. Order and running
    sums do not depend on the setting, so one window serves all; the best prefix of each is the largest (value, -size)."""
    ranked = prefix_sums(single).withColumn("hits", F.sum("t").over(prefix_order()))
    each = ranked.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("floor"), F.lit(float(b)).alias("boost")) for i, f, b in settings])))
    value = F.struct(expected_f(F.col("s.floor")).alias("ef"), (-F.col("k")).alias("k"), F.col("hits"), (F.col("none") * F.col("s.boost")).alias("none"))
    best = each.groupBy(F.col("s.i").alias("setting"), "q").agg(F.max(value).alias("best")).filter("best.ef > best.none")
    return best.select("setting", "q", (-F.col("best.k")).cast("long").alias("n_pred"), F.col("best.hits").alias("tp"))


def tuning_grid(queries: DataFrame, scored: DataFrame, truth: DataFrame, tried: list[DecisionParams] | None = None) -> DataFrame:
    """(setting, exclusive, method, threshold, boost, macro_f05) of the settings tried (by default all 82; those by expected
    F0.5 are exclusive), in one aggregation for each kind: a pair
    counts for every threshold up to its p, and each expected-F setting picks a prefix of one ranking."""
    spark = queries.sparkSession
    truth = truth.select("q", "r").distinct()
    n_true = queries.select("q").distinct().join(truth.groupBy("q").agg(F.count(F.lit(1)).alias("n_true")), "q", "left").fillna(0, ["n_true"])
    settings = [(i, p.exclusive, p.method, float(p.threshold), float(p.singleton_boost)) for i, p in enumerate(tried or grid())]
    labelled = scored.select("q", "r", "p").join(truth.withColumn("t", F.lit(1)), ["q", "r"], "left").fillna(0, ["t"])
    single = exclusive(labelled)
    parts = []
    if prefixes := [(i, floor, boost) for i, _, method, floor, boost in settings if method == "expected_f"]:
        parts.append(_prefix_counts(single, prefixes))
    for e, base in ((False, labelled), (True, single)):
        if limits := [F.struct(F.lit(s[0]).alias("i"), F.lit(s[3]).alias("t")) for s in settings if s[1] == e and s[2] == "threshold"]:
            each = base.withColumn("s", F.explode(F.filter(F.array(*limits), lambda x: F.col("p") >= x["t"])))
            parts.append(each.groupBy(F.col("s.i").alias("setting"), "q").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("t").alias("tp")))
    counts = reduce(DataFrame.unionByName, parts)
    value = f05(F.col("n_true"), F.col("n_pred"), F.col("tp")) - (F.col("n_true") == 0).cast("double")
    sums = counts.join(n_true, "q").groupBy("setting").agg(F.sum(value).alias("f"))  # queries without predictions score 1 if alone, else 0
    n, alone = n_true.agg(F.count(F.lit(1)), F.count_if(F.col("n_true") == 0)).first()
    table = spark.createDataFrame(settings, "setting int, exclusive boolean, method string, threshold double, boost double")
    return table.join(sums, "setting", "left").select("setting", "exclusive", "method", "threshold", "boost", ((F.coalesce("f", F.lit(0.0)) + alone) / max(n, 1)).alias("macro_f05"))


def best_setting(tuned: DataFrame) -> DecisionParams:
    row = tuned.orderBy(F.desc(F.round("macro_f05", 12)), "setting").first()
    return DecisionParams(row["exclusive"], row["method"], row["threshold"], row["boost"])


def errors(queries: DataFrame, candidates: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(q, r, kind): missed by blocking, missed by the matcher, or wrongly matched for an entity with or without matches."""
    c, p, t = (x.select("q", "r").distinct().withColumn(n, F.lit(True)) for x, n in ((candidates, "c"), (pred, "p"), (truth, "t")))
    alone = truth.select("q").distinct().withColumn("some", F.lit(True))
    all_ = t.join(p, ["q", "r"], "full_outer").join(c, ["q", "r"], "left").join(alone, "q", "left")
    kind = F.when(F.col("t").isNotNull() & F.col("p").isNull(), F.when(F.col("c").isNull(), "fn_blocking").otherwise("fn_matcher")).when(F.col("t").isNull(), F.when(F.col("some").isNull(), "fp_singleton").otherwise("fp_other"))
    return all_.select("q", "r", kind.alias("kind")).filter("kind is not null").join(queries.select("q").distinct(), "q", "left_semi")


def error_samples(found: DataFrame, each: int = 25, seed: int = 2026) -> DataFrame:
    """The same few errors of each kind every time."""
    from pyspark.sql import Window

    order = Window.partitionBy("kind").orderBy(F.xxhash64("q", "r", F.lit(seed)), "q", "r")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= each).drop("_n")


def error_traits(found: DataFrame, traits: DataFrame) -> DataFrame:
    """(kind, n, and the share of each boolean trait) of errors (q, r, kind); traits: (q, r, trait...). Unknown traits do not count."""
    names = [c for c in traits.columns if c not in ("q", "r")]
    shares = [F.avg(F.col(c).cast("int")).alias(c) for c in names]
    return found.join(traits, ["q", "r"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *shares)
