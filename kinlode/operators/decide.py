"""Decisions over scored pairs (q, r, p): exclusivity, a threshold, or the prefix of best expected F0.5."""

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlode.sources.files import read_text, write_text


@dataclass(frozen=True)
class DecisionParams:
    exclusive: bool = True
    method: str = "threshold"
    threshold: float = 0.5
    singleton_boost: float = 1.0

    def save(self, path: str) -> None:
        write_text(path, json.dumps(asdict(self)))

    @classmethod
    def load(cls, path: str) -> "DecisionParams":
        return cls(**json.loads(read_text(path)))


def exclusive(pairs: DataFrame) -> DataFrame:
    """Each record stays with its most probable query, the smaller one among equals."""
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("p"), "q"))).filter("_n = 1").drop("_n")


def prefix_order():
    """A query's pairs up to the current one, in order of p."""
    return Window.partitionBy("q").orderBy(F.desc("p"), "r").rowsBetween(Window.unboundedPreceding, 0)


def prefix_sums(pairs: DataFrame) -> DataFrame:
    """Adds k (place in the query's order), run and total (sums of p), none (the chance that nothing matches)."""
    q = Window.partitionBy("q")
    none = F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)))).over(q))
    return pairs.withColumns({"k": F.row_number().over(q.orderBy(F.desc("p"), "r")), "run": F.sum("p").over(prefix_order()), "total": F.sum("p").over(q), "none": none})


def expected_f(floor):
    """Expected F0.5 of the prefix that ends here, rounded so that equal values tie; -1 below the floor."""
    return F.when(F.col("p") < floor, -1.0).otherwise(F.round(1.25 * F.col("run") / (0.25 * F.col("total") + F.col("k")), 12))


def by_expected_f(pairs: DataFrame, floor: float, boost: float) -> DataFrame:
    """Of each query's pairs, in order of p, the smallest prefix of the best expected F0.5, if that exceeds the chance that
    nothing matches. Pairs below the floor end a prefix but count in the expected number of matches."""
    q = Window.partitionBy("q")
    out = prefix_sums(pairs).withColumn("ef", expected_f(F.lit(floor)))
    out = out.withColumn("best", F.max("ef").over(q))
    out = out.withColumn("size", F.min(F.when((F.col("ef") == F.col("best")) & (F.col("ef") > F.col("none") * boost), F.col("k"))).over(q))
    return out.filter("k <= size").drop("k", "run", "total", "none", "ef", "best", "size")


def decide(pairs: DataFrame, params: DecisionParams) -> DataFrame:
    """The pairs kept."""
    left = exclusive(pairs) if params.exclusive else pairs
    if params.method == "threshold":
        return left.filter(F.col("p") >= params.threshold)
    if params.method == "expected_f":
        return by_expected_f(left, params.threshold, params.singleton_boost)
    raise ValueError(f"unknown method {params.method!r}")


THRESHOLDS = [round(0.2 + 0.025 * i, 3) for i in range(29)]
FLOORS, BOOSTS = (0.02, 0.05, 0.1, 0.2), (0.8, 1.0, 1.25, 1.5, 2.0, 2.5)


def grid() -> list[DecisionParams]:
    """The 82 settings that tuning tries, in order."""
    plain = [DecisionParams(e, "threshold", t) for e in (False, True) for t in THRESHOLDS]
    return plain + [DecisionParams(True, "expected_f", f, b) for f in FLOORS for b in BOOSTS]
