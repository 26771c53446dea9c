"""Gradient-boosted trees over pair features, cross-fitted by query."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, SAMPLE, SEED = 3, 0.4, 2026
_KEYS = ("q", "r", "y", "p", "rank")


def bucket(q: Column, n: int, seed: int = SEED) -> Column:
    """0..n-1 by a hash of the query, so that all pairs of a query move together."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), q.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def sample_queries(queries: DataFrame, share: float, seed: int = SEED) -> DataFrame:
    return queries.filter(bucket(F.col("q"), 10_000, seed + 1) < int(share * 10_000))


def feature_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in _KEYS]


def _filled(features: DataFrame, columns: list[str]) -> DataFrame:
    """Trees of this library take no nulls: a null becomes -1 beside an indicator."""
    return features.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"_v_{c}") for c in columns], *[F.col(c).isNull().cast("double").alias(f"_n_{c}") for c in columns])


def fit(features: DataFrame, rounds: int = 100, depth: int = 7, step: float = 0.05, least: int = 20) -> PipelineModel:
    """features carry a boolean y."""
    columns = feature_columns(features)
    data = _filled(features, columns).withColumn("label", F.col("y").cast("double"))
    inputs = [f"_v_{c}" for c in columns] + [f"_n_{c}" for c in columns]
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=step, minInstancesPerNode=least, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxBins=64, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), trees]).fit(data)


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """(q, r, p)."""
    out = model.transform(_filled(features, feature_columns(features)))
    return out.select("q", "r", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def cross_fit(features: DataFrame, folds: int = FOLDS, share: float = SAMPLE, **settings) -> DataFrame:
    """(q, r, p): each fold scored by a model of a sample of the other folds' queries."""
    fold = bucket(F.col("q"), folds)
    out = None
    for k in range(folds):
        model = fit(sample_queries(features.filter(fold != k), share), **settings)
        part = predict(model, features.filter(fold == k))
        out = part if out is None else out.unionByName(part)
    return out


def final_fit(features: DataFrame, folds: int = FOLDS, share: float = SAMPLE, **settings) -> PipelineModel:
    """One model of as many queries as a fold's model had."""
    return fit(sample_queries(features, share * (folds - 1) / folds), **settings)
