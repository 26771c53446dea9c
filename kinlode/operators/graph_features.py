"""Second-stage features over scored pairs (q, r, p): competition, mass of agreeing candidates, neighbours."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlode.functions.similarity import similarity


def competition(pairs: DataFrame) -> DataFrame:
    """Adds the ten competition features; ties go to the smaller record or query."""
    q, r = Window.partitionBy("q"), Window.partitionBy("r")
    by_q, by_r = q.orderBy(F.desc("p"), "r"), r.orderBy(F.desc("p"), "q")
    best = F.max("p").over(q)
    place = F.row_number().over(by_r)
    top, second = F.first("p").over(by_r), F.lead("p").over(by_r)
    out = pairs.withColumns({
        "p1": F.col("p"), "p1_rank_q": F.row_number().over(by_q) - 1, "p1_frac_qmax": F.when(best > 0, F.col("p") / best).otherwise(0.0), "q_sum_p1": F.sum("p").over(q),
        "q_n_above_half": F.sum(F.when(F.col("p") > 0.5, 1).otherwise(0)).over(q), "p1_gap_q_next": F.col("p") - F.coalesce(F.lead("p").over(by_q), F.lit(0.0)),
        "r_max_other": F.when(place == 1, F.coalesce(second, F.lit(0.0))).otherwise(top), "p1_rank_r": place - 1, "r_sum_p1_other": F.sum("p").over(r) - F.col("p"),
    })
    return out.withColumn("p1_gap_r_other", F.col("p") - F.col("r_max_other"))


def mass(pairs: DataFrame) -> DataFrame:
    """Adds the eleven mass features to (q, r, p, r_code, r_name, r_addr, q_code, r_source, r_addr_empty). The window on r comes
    first, then the pairs go by q once, which serves every window of a query and of its parts."""
    q, code, source = Window.partitionBy("q"), Window.partitionBy("q", "r_code"), Window.partitionBy("q", "r_source")
    part = lambda c: F.sum(F.when(c, F.col("p")).otherwise(0.0))
    out = pairs.withColumn("r_n_claim_01", F.sum(F.when(F.col("p") > 0.1, 1).otherwise(0)).over(Window.partitionBy("r")))
    out = out.withColumns({"q_sum_p1_empty": part(F.col("r_addr_empty")).over(q), "q_sum_p1_nonempty": part(~F.col("r_addr_empty")).over(q)})
    coded = lambda c: F.when(F.col("r_code").isNotNull(), c)
    of = lambda s: F.max(F.when(F.col("r_source") == s, F.col("p"))).over(code)
    across = F.coalesce(F.when(F.col("r_source") == 2, of(3)).otherwise(of(2)), F.lit(0.0))
    out = out.withColumns({"_m": coded(F.sum("p").over(code)), "xsrc_code_p": coded(across)})
    # the heaviest code of the query, and the heaviest but for that; of equal ones any serves
    out = out.withColumn("_top", F.max(coded(F.struct("_m", "r_code"))).over(q))
    own = F.col("r_code") == F.col("_top.r_code")
    out = out.withColumn("_second", F.max(F.when(~own, F.col("_m"))).over(q))
    other = F.greatest(F.coalesce(F.when(own, F.col("_second")).otherwise(F.col("_top._m")), F.lit(0.0)), F.lit(0.0))
    agree = lambda key: F.when(F.col(key).isNotNull(), F.sum("p").over(Window.partitionBy("q", key)) - F.col("p"))
    out = out.withColumns({
        "code_mass": F.col("_m") - F.col("p"), "name_mass": agree("r_name"), "addr_mass": agree("r_addr"), "other_cluster_mass": coded(other),
        "own_cluster_is_q_code": coded(F.coalesce(F.col("r_code") == F.col("q_code"), F.lit(False)).cast("int")),
        "p1_rank_q_src": F.row_number().over(source.orderBy(F.desc("p"), "r")) - 1, "q_src_sum_p1": F.sum("p").over(source),
    })
    added = ("code_mass", "name_mass", "addr_mass", "other_cluster_mass", "own_cluster_is_q_code", "xsrc_code_p", "p1_rank_q_src", "q_src_sum_p1", "q_sum_p1_empty", "q_sum_p1_nonempty", "r_n_claim_01")
    return out.select(*pairs.columns, *added)


def _uncertain(pairs: DataFrame, low: float, high: float, *facts: str) -> DataFrame:
    """Uncertain pairs with n1 and n2, the two most probable other candidates of the same query: structs of r, p and facts."""
    line = Window.partitionBy("q").orderBy(F.desc("p"), "r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    three = {f"_{i}": F.nth_value(F.struct("r", "p", *facts), i).over(line) for i in (1, 2, 3)}
    unsure = pairs.select("q", "r", "p", "r_addr_empty", *facts).withColumns(three).filter(F.col("r_addr_empty") | ((F.col("p") > low) & (F.col("p") < high)))
    others = F.filter(F.array(*three), lambda x: x["r"] != F.col("r"))
    return unsure.withColumns({"n1": F.get(others, F.lit(0)), "n2": F.get(others, F.lit(1))}).drop(*three)


def neighbour_pairs(pairs: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(q, r, p, n1, p1n, n2, p2n) of uncertain pairs: the two most probable other candidates of the same query."""
    return _uncertain(pairs, low, high).select("q", "r", "p", F.col("n1.r").alias("n1"), F.col("n1.p").alias("p1n"), F.col("n2.r").alias("n2"), F.col("n2.p").alias("p2n"))


def neighbours(pairs: DataFrame, records: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(q, r, nb1_name, nb1_p, nb2_name, nb2_p, nb1_addr, nb_name_max_w) of uncertain pairs; others have no row. Candidates have
    their names before they go by q, so that neighbours need no join of their own."""
    facts = records.select(F.col("row_id").alias("r"), F.col("name_core").alias("name"), F.when(~F.col("addr_empty"), F.col("addr_norm")).alias("addr"))
    out = _uncertain(pairs.select("q", "r", "p", "r_addr_empty").join(facts, "r", "left"), low, high, "name", "addr")
    out = out.select("q", "r", similarity("token_set", F.col("name"), F.col("n1.name")).alias("nb1_name"), F.col("n1.p").alias("nb1_p"), similarity("token_set", F.col("name"), F.col("n2.name")).alias("nb2_name"), F.col("n2.p").alias("nb2_p"), similarity("token_set", F.col("addr"), F.col("n1.addr")).alias("nb1_addr"))
    weighted = lambda i: F.coalesce(F.col(f"nb{i}_name") * F.col(f"nb{i}_p"), F.lit(0.0))
    return out.withColumn("nb_name_max_w", F.greatest(weighted(1), weighted(2)))
