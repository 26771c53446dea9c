"""The matcher from records to result files: normalise, tokenise, block, describe, score in two stages, decide, evaluate."""

import json
import time
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlode.functions import addresses, conventions, names, script, similarity, tokens
from kinlode.operators import blocking, evaluate, features, graph_features, model
from kinlode.operators.decide import DecisionParams, decide
from kinlode.plans.stages import Stages, fingerprint, input_state
from kinlode.sources import tsv
from kinlode.sources.files import write_text

TEXT_RULES = (addresses, conventions, names, script, tokens, tsv)


@dataclass
class Settings:
    work_dir: str
    params: blocking.BlockingParams = field(default_factory=blocking.BlockingParams)
    folds: int = model.FOLDS
    share: float = model.SAMPLE
    rounds: int = 100


def normalize(records: DataFrame) -> DataFrame:
    """Source-1 names are taken as they are and give the vocabulary by which names of the other sources are split."""
    ones = names.normalize_names(records.filter("source = 1"))
    vocab = names.vocabulary(names.word_counts(ones))
    others = names.normalize_names(records.filter("source <> 1"), vocab=vocab)
    return addresses.normalize_addresses(ones.unionByName(others))


def prepare(records: DataFrame, stages: Stages) -> DataFrame:
    return stages.table("records", lambda: tokens.with_tokens(normalize(records)), "source", TEXT_RULES)


def second_stage(base: DataFrame, scored: DataFrame, records: DataFrame) -> DataFrame:
    """First-stage features, and competition, mass and neighbour features of the first-stage p."""
    keyed = features.with_facts(scored, records)
    drop = ("p", "r_code", "r_name", "r_addr", "q_code", "r_source", "r_addr_empty")
    more = graph_features.mass(graph_features.competition(keyed)).drop(*drop)
    near = graph_features.neighbours(keyed, records)
    return base.join(more, ["q", "r"]).join(near, ["q", "r"], "left")


def candidates(records: DataFrame, settings: Settings, stages: Stages) -> DataFrame:
    return stages.table("candidates", lambda: blocking.block(records, settings.params), "records", (blocking,), params=asdict(settings.params))


def describe(pairs: DataFrame, records: DataFrame, stages: Stages) -> DataFrame:
    return stages.table("features", lambda: features.pair_features(pairs, records), "candidates", (features, similarity))


def train(records: DataFrame, truth: DataFrame, settings: Settings, source: str | None = None) -> dict:
    """Both stages, their tuned decisions and the reports. truth: (q, r). Models and settings are saved in work_dir. `source`
    is a fingerprint of records and truth; with it, the tables of an earlier run are used again."""
    stages = Stages(records.sparkSession, settings.work_dir, source)
    table = prepare(records, stages)
    queries = table.filter("source = 1").select(F.col("row_id").alias("q"), F.col("country").alias("grp"))
    pairs = candidates(table, settings, stages)
    base = blocking.with_labels(describe(pairs, table, stages), truth)
    report = {"blocking": evaluate.blocking_report(queries, pairs, truth).first().asDict(), "blocking_groups": [r.asDict() for r in evaluate.blocking_report(queries, pairs, truth, "grp").collect()]}
    boosted = {"folds": settings.folds, "share": settings.share, "rounds": settings.rounds}
    scored = {"rules": features.with_rule_score(base).select("q", "r", "p")}
    scored["stage1"] = stages.table("stage1", lambda: model.cross_fit(base, **boosted), "features", (model,), **boosted)
    second = stages.table("second", lambda: second_stage(base, scored["stage1"], table), "stage1", (graph_features, similarity))
    scored["stage2"] = stages.table("stage2", lambda: model.cross_fit(second, **boosted), "second", (model,), **boosted)
    for name, p in scored.items():
        best = evaluate.best_setting(evaluate.tuning_grid(queries, p, truth))
        kept = decide(p, best)
        report[name] = evaluate.macro_f05(queries, kept, truth).first().asDict() | {"decision": vars(best)}
    for name, data in (("stage1", base), ("stage2", second)):
        model.final_fit(data, **boosted).write().overwrite().save(f"{settings.work_dir}/model-{name}")
    DecisionParams(**report["stage2"]["decision"]).save(f"{settings.work_dir}/decision.json")
    report["made"] = stages.made
    write_text(f"{settings.work_dir}/report.json", json.dumps(report, indent=1, default=str))
    return report


def score(records: DataFrame, settings: Settings, source: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, candidates, matches) of unlabelled records by saved models."""
    spark, saved = records.sparkSession, [f"{settings.work_dir}/model-stage{i}" for i in (1, 2)]
    stages = Stages(spark, settings.work_dir, source)
    table = prepare(records, stages)
    pairs = candidates(table, settings, stages)
    base = describe(pairs, table, stages)
    p1 = stages.table("stage1", lambda: model.predict(PipelineModel.load(saved[0]), base), "features", (model,), model=input_state(spark, saved[0]))
    second = stages.table("second", lambda: second_stage(base, p1, table), "stage1", (graph_features, similarity))
    p2 = stages.table("stage2", lambda: model.predict(PipelineModel.load(saved[1]), second), "second", (model,), model=input_state(spark, saved[1]))
    return table, pairs, decide(p2, DecisionParams.load(f"{settings.work_dir}/decision.json"))


def _files(data_dir: str, split: str) -> list[str]:
    return [f"{data_dir}/{split}_source{i}.tsv" for i in (1, 2, 3)]


def run_train(spark: SparkSession, data_dir: str, settings: Settings) -> dict:
    answers = f"{data_dir}/train_ground_truth.tsv"
    records = tsv.read_split(spark, data_dir, "train")
    source = fingerprint(files=input_state(spark, *_files(data_dir, "train"), answers))
    return train(records, tsv.truth_pairs(tsv.read_truth(spark, answers), records), settings, source)


def run_test(spark: SparkSession, data_dir: str, settings: Settings, output_dir: str) -> None:
    source = fingerprint(files=input_state(spark, *_files(data_dir, "test")))
    table, pairs, matches = score(tsv.read_split(spark, data_dir, "test"), settings, source)
    tsv.write_lists(tsv.id_lists(table, pairs.select("q", "r"), "candidate_entity_ids"), f"{output_dir}/candidate_pairs")
    tsv.write_lists(tsv.id_lists(table, matches.select("q", "r"), "matched_entity_ids"), f"{output_dir}/matching_results")


def blocking_experiments(records: DataFrame, truth: DataFrame, settings: Settings, grid: list[blocking.BlockingParams], share: float = 0.1) -> list[dict]:
    """Blocking reports of a sample of queries against all records, one for each setting, for all and for each country."""
    stages = Stages(records.sparkSession, settings.work_dir)
    table = prepare(records, stages)
    queries = model.sample_queries(table.filter("source = 1").select(F.col("row_id").alias("q"), F.col("country").alias("grp")), share)
    known = truth.join(queries, "q", "left_semi")
    out = []
    for i, params in enumerate(grid):
        began = time.time()
        pairs = stages.table(f"grid{i}", lambda params=params: blocking.block(table, params, queries.select(F.col("q").alias("row_id"))), "records", (blocking,), params=asdict(params), share=share)
        report = evaluate.blocking_report(queries, pairs, known).first().asDict() | {"groups": [r.asDict() for r in evaluate.blocking_report(queries, pairs, known, "grp").collect()]}
        out.append({"params": params, "seconds": round(time.time() - began, 1)} | report)
    return out


def held_out_experiment(features: DataFrame, queries: DataFrame, truth: DataFrame, columns: list[str] | None = None, fold: int = 0, folds: int = model.FOLDS, share: float = 0.15, tried: list[DecisionParams] | None = None, **settings) -> dict:
    """One model of a sample of the other folds' queries, and its best decision and macro F0.5 on all queries of `fold`.
    features: (q, r, y, ...), whose second-stage columns must come from cross-fitted probabilities."""
    kept = features.select("q", "r", "y", *(columns or model.feature_columns(features)))
    away = model.bucket(F.col("q"), folds) != fold
    fitted = model.fit(model.sample_queries(kept.filter(away), share), **settings)
    p = model.predict(fitted, kept.filter(~away)).persist()
    ours, known = queries.filter(~away), truth.filter(~away)
    try:
        best = evaluate.best_setting(evaluate.tuning_grid(ours, p, known, tried))
        return {"decision": best} | evaluate.macro_f05(ours, decide(p, best), known).first().asDict()
    finally:
        p.unpersist()


def feature_experiments(base: DataFrame, queries: DataFrame, truth: DataFrame, subsets: dict[str, list[str]], **settings) -> dict[str, dict]:
    """The held-out result of each subset of the columns; all subsets have the same folds and sample."""
    return {name: held_out_experiment(base, queries, truth, columns, **settings) for name, columns in subsets.items()}
