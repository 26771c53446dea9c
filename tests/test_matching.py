"""Matching operators against goldens and brute force."""

import collections
import hashlib
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from kinlode.functions import similarity, tokens
from kinlode.operators import blocking, decide, evaluate, features, graph_features, model
from kinlode.operators.decide import DecisionParams
from kinlode.plans import matching, stages
from kinlode.sources import package, tsv

PAIRS = "q long, r long, p double"
RECORDS = [
    ("S1-1", "Quillon Marsh Bakery LLC", "88 Tolver Avenue, Pemberly, OR"),
    ("S2-10", "QUILLON MARSH BAKERY, [L.L.C.]", "* 88 TOLVER AVE, PEMBERLY, OR"),
    ("S2-11", "Ostrava Kites", "7 Canal Rd, Dunmore, VT"),
    ("S3-20", "Quillon Marsh Bakery", ""),
    ("S3-21", "Tin Drum Cinema", "301 Hill St, Laredo, TX"),
]


@pytest.fixture(scope="module")
def universe(spark):
    rows = tsv.with_keys(spark.createDataFrame([(*r, "US") for r in RECORDS], "entity_id string, business_name string, business_address string, country string"))
    return tokens.with_tokens(matching.normalize(rows)).cache()


def random_pairs(seed, n=300, nq=30, nr=50):
    rng = random.Random(seed)
    keys = {(rng.randrange(nq), rng.randrange(nr)) for _ in range(n)}
    return [(q, r, round(rng.betavariate(0.6, 0.6), 6)) for q, r in sorted(keys)]


def test_blocking_universe(universe):
    ids = {r.row_id: r.entity_id for r in universe.select("row_id", "entity_id").collect()}
    got = {(ids[r.q], ids[r.r]) for r in blocking.block(universe, blocking.BlockingParams(k=1, k_empty=1)).collect()}
    assert {("S1-1", "S2-10"), ("S1-1", "S3-20")} <= got
    keys = {(ids[r.q], ids[r.r]): r.score for r in blocking.block_by_keys(tokens.key_tokens(universe)).collect()}
    assert keys == {("S1-1", "S2-10"): 3, ("S1-1", "S3-20"): 2}


def test_pair_features(universe):
    pairs = blocking.block(universe)
    out = features.with_rule_score(features.pair_features(pairs, universe))
    assert len(out.columns) == 2 + 54 + 1
    row = {r.r: r for r in out.collect()}
    copy, bare = row[2 * 10**12 + 10], row[3 * 10**12 + 20]
    assert copy.n_tset == copy.n_ratio == copy.a_ratio == 100 and copy.legal_rel == 1 and copy.code_first_eq == copy.num_jacc == copy.state_eq == 1 and abs(copy.p - 1) < 1e-9
    assert bare.a_tset is None and bare.code_first_lev is None and bare.code_support is None and bare.legal_rel == 4 and abs(bare.p - (0.55 + 0.15 + 0.075)) < 1e-9


def test_top_k_with_ties(spark):
    rng = random.Random(1)
    pairs = [(q, r, float(rng.randrange(5))) for q in range(8) for r in range(40) if rng.random() < 0.7]
    recs = [(r, 2 + r % 2, r % 7 == 0) for r in range(40)]
    got = blocking.best_of_channels(spark.createDataFrame(pairs, "q long, r long, score double"), spark.createDataFrame(recs, "row_id long, source int, addr_empty boolean"), blocking.BlockingParams(k=4, k_empty=2))
    want = set()
    for q in range(8):
        for s in (2, 3):
            for e in (False, True):
                mine = sorted((-x, r) for qq, r, x in pairs if qq == q and recs[r][1] == s and recs[r][2] == e)
                want |= {(q, r, i) for i, (_, r) in enumerate(mine[: 2 if e else 4])}
    assert {(r.q, r.r, r.rank) for r in got.collect()} == want


def test_support(spark):
    codes, names = ["100", "102 5", "102", "100", ""], ["acme", "acme", "acme", "acme co", "acme"]
    recs = spark.createDataFrame([(i, c, n, "") for i, (c, n) in enumerate(zip(codes, names, strict=True))], "row_id long, codes string, name_core string, addr_norm string")
    pairs = spark.createDataFrame([(0, r) for r in (1, 2, 3, 4)], "q long, r long")
    got = [(r.code_support, r.code_support_s1, r.name_support) for r in features.support_features(features.with_keys(pairs, recs)).orderBy("r").collect()]
    assert got == [(1, 1, 2), (1, 1, 2), (0, 1, 0), (None, 1, 2)]


def test_exclusive_and_threshold(spark):
    df = spark.createDataFrame([(0, 10, 0.9), (1, 10, 0.8), (1, 11, 0.3), (2, 11, 0.7)], PAIRS)
    assert {(r.q, r.r) for r in decide.exclusive(df).collect()} == {(0, 10), (2, 11)}
    df = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.4), (1, 3, 0.6)], PAIRS)
    assert {(r.q, r.r) for r in decide.decide(df, decide.DecisionParams(False, "threshold", 0.5)).collect()} == {(0, 1), (1, 3)}
    with pytest.raises(ValueError):
        decide.decide(df, decide.DecisionParams(method="other"))


@pytest.mark.parametrize("floor, boost", [(0, 1), (0.2, 1), (0.1, 1.5)])
def test_expected_f(spark, floor, boost):
    rng = random.Random(7)
    groups = {g: sorted((round(rng.betavariate(0.6, 0.6), 6) for _ in range(rng.randint(1, 7))), reverse=True) for g in range(400)}
    df = spark.createDataFrame([(g, i, p) for g, ps in groups.items() for i, p in enumerate(ps)], PAIRS)
    got = collections.Counter(r.q for r in decide.by_expected_f(df, float(floor), float(boost)).collect())
    for g, ps in groups.items():
        none = math.prod(max(1 - p, 1e-12) for p in ps) * boost
        ef = [1.25 * sum(ps[:k]) / (0.25 * sum(ps) + k) if ps[k - 1] >= floor else -1 for k in range(1, len(ps) + 1)]
        best = max(ef)
        k = next(i for i, x in enumerate(ef, 1) if x >= best - 1e-11) if best > none else 0
        assert got[g] == k


def test_metric(spark):
    q = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b")], "q long, grp string")
    truth = spark.createDataFrame([(1, 47), (1, 812)], "q long, r long")
    pred = spark.createDataFrame([(1, 47), (1, 193), (1, 812), (3, 5)], "q long, r long")
    got = {r.q: r.f05 for r in evaluate.entity_f05(q, pred, truth).collect()}
    assert abs(got[1] - 0.7142857) < 1e-6 and (got[2], got[3], got[4]) == (1, 0, 1)
    row = evaluate.macro_f05(q, pred, truth).first()
    assert abs(row.macro_f05 - (0.7142857 + 2) / 4) < 1e-6 and row.pred_pairs == 4
    slices = {r.slice: r.n for r in evaluate.breakdown(q, pred, truth).collect()}
    assert slices == {"all": 4, "singleton": 3, "non_singleton": 1, "matches=2-4": 1, "group=a": 2, "group=b": 2}
    report = evaluate.blocking_report(q, pred.filter("r <> 812"), truth).first()
    assert report.pair_recall == 0.5 and report.entity_full_recall == 0 and report.total_pairs == 3
    groups = {r.grp: r for r in evaluate.blocking_report(q, pred.filter("r <> 812"), truth, "grp").collect()}
    assert groups["a"].pair_recall == 0.5 and groups["a"].pairs_per_s1 == 1 and groups["b"].pair_recall is None and groups["b"].oracle_f05 == 1
    kinds = collections.Counter(r.kind for r in evaluate.errors(q, pred, pred.filter("r <> 812"), truth).collect())
    assert kinds == {"fn_matcher": 1, "fp_other": 1, "fp_singleton": 1}


def test_tuning_is_the_decision(spark):
    data = random_pairs(3)
    df, q = spark.createDataFrame(data, PAIRS), spark.createDataFrame([(i,) for i in range(32)], "q long")
    rng = random.Random(5)
    truth = spark.createDataFrame([(a, b) for a, b, p in data if rng.random() < p], "q long, r long")
    tuned = {r.setting: r.macro_f05 for r in evaluate.tuning_grid(q, df, truth).collect()}
    assert len(tuned) == len(decide.grid()) == 82
    for i in (0, 10, 28, 29, 45, 58, 70, 81):
        assert math.isclose(tuned[i], evaluate.macro_f05(q, decide.decide(df, decide.grid()[i]), truth).first().macro_f05, abs_tol=1e-9)


def test_competition(spark):
    data = random_pairs(11)
    by_q, by_r = collections.defaultdict(list), collections.defaultdict(list)
    for q, r, p in data:
        by_q[q].append((-p, r))
        by_r[r].append((-p, q))
    for x in graph_features.competition(spark.createDataFrame(data, PAIRS)).collect():
        mine, claims = sorted(by_q[x.q]), sorted(by_r[x.r])
        i = mine.index((-x.p, x.r))
        assert x.p1_rank_q == i and x.p1_rank_r == claims.index((-x.p, x.q))
        assert math.isclose(x.p1_gap_q_next, x.p + (mine[i + 1][0] if i + 1 < len(mine) else 0), abs_tol=1e-9)
        rest = [-p for p, q in claims if q != x.q]
        assert math.isclose(x.r_max_other, max(rest, default=0)) and math.isclose(x.r_sum_p1_other, sum(rest), abs_tol=1e-9)
        assert x.q_n_above_half == sum(-p > 0.5 for p, _ in mine)


def test_mass_and_neighbours(spark):
    rng = random.Random(13)
    code = {r: rng.choice([None, "1", "2", "3"]) for r in range(50)}
    data = [(q, r, p, code[r], f"n{r % 4}", None, rng.choice([None, "1"]), 2 + r % 2, r % 5 == 0) for q, r, p in random_pairs(17)]
    df = spark.createDataFrame(data, "q long, r long, p double, r_code string, r_name string, r_addr string, q_code string, r_source int, r_addr_empty boolean")
    for x in graph_features.mass(df).collect():
        mine = [d for d in data if d[0] == x.q]
        near = lambda a, b: math.isclose(a, b, abs_tol=1e-9)
        assert near(x.name_mass, sum(d[2] for d in mine if d[4] == x.r_name) - x.p) and x.addr_mass is None
        if x.r_code is None:
            assert x.code_mass is None and x.other_cluster_mass is None and x.xsrc_code_p is None
            continue
        sums = collections.Counter()
        for d in mine:
            if d[3]:
                sums[d[3]] += d[2]
        assert near(x.code_mass, sums[x.r_code] - x.p) and near(x.other_cluster_mass, max((v for k, v in sums.items() if k != x.r_code), default=0))
        assert near(x.xsrc_code_p, max((d[2] for d in mine if d[3] == x.r_code and d[7] != x.r_source), default=0)) and x.own_cluster_is_q_code == int(x.q_code == x.r_code)
    for x in graph_features.neighbour_pairs(df).collect():
        rest = sorted((-d[2], d[1]) for d in data if d[0] == x.q and d[1] != x.r)[:2]
        assert [(x.n1, x.p1n), (x.n2, x.p2n)][: len(rest)] == [(r, -p) for p, r in rest]


def test_similarities():
    s = similarity
    assert s.ratio("", "") == 100 and s.common_length("wilson", "wilsno") == 5
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert s.common_length(a, b) == table[-1][-1]
    assert s.token_set("acme labs", "acme") == 100 and s.token_set("", "a") == 0 and s.partial("abc", "xxabcxx") == 100
    assert round(s.jaro_winkler("martha", "marhta"), 2) == 96.11 and s.token_sort("b a", "a b") == 100


def test_batches_of_similarities():
    """A batch gives the very values of the functions of two strings: empty strings, 64 letters and more, other scripts."""
    s, rng = similarity, random.Random(4)
    pairs = [("", ""), ("", "a"), ("a", ""), ("a" * 64, "a" * 63 + "b"), ("ab" * 32, "ba" * 32), ("x" * 65, "x" * 200), ("a" * 9, "b" * (s.WINDOWED + 1)), ("\0a", "a\0"), ("a b", "a b c")]
    for letters, most in (("ab ", 12), ("abcdefgh ", 40), ("abc d", 90), ("aé\u0915\U0001d4b3 b", 20)):
        pairs += [tuple("".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(2)) for _ in range(300)]
    assert set(s.KINDS) == {"ratio", "token_sort", "token_set", "partial", "jaro_winkler"}
    for kind, batch in s.KINDS.items():
        assert batch(pairs) == [getattr(s, kind)(*p) for p in pairs] and batch([]) == []


def test_similarity_of_nulls_and_repeats(spark):
    rows = [(0, "ab", "abc"), (1, None, "x"), (2, "ab", "abc"), (3, "x", None), (4, None, None)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r.i: r.x for r in df.select("i", similarity.similarity("ratio", F.col("a"), F.col("b")).alias("x")).collect()}
    assert got == {0: 80.0, 1: None, 2: 80.0, 3: None, 4: None}


def write(path, lines):
    path.write_text("".join("\t".join(x) + "\n" for x in lines))
    return str(path)


def test_sources(spark, tmp_path):
    good = write(tmp_path / "a.tsv", [tsv.FIELDS, ("S1-1", 'NA "x"', "", "US"), ("S1-22", "b", "c", "")])
    rows = tsv.read_source(spark, good).orderBy("row_id").collect()
    assert [(r.business_name, r.business_address, r.row_id, r.source) for r in rows] == [('NA "x"', "", 10**12 + 1, 1), ("b", "c", 10**12 + 22, 1)]
    with pytest.raises(ValueError):
        tsv.read_source(spark, write(tmp_path / "b.tsv", [("id", "x")]))
    for bad in ([("S1-1", "a", "b")], [("X1-1", "a", "b", "US")]):
        with pytest.raises(Exception, match="not 4 fields|malformed id"):
            tsv.read_source(spark, write(tmp_path / "c.tsv", [tsv.FIELDS, *bad])).collect()
    with pytest.raises(ValueError):
        tsv.read_source(spark, write(tmp_path / "twice.tsv", [tsv.FIELDS, ("S1-1", "a", "b", "US"), tsv.FIELDS]))
    truth = tsv.read_truth(spark, write(tmp_path / "t.tsv", [tsv.TRUTH_FIELDS, ("S1-1", "S1-22,"), ("S1-22", "")]))
    assert {r.entity_id: r.matches for r in truth.collect()} == {"S1-1": ["S1-22"], "S1-22": []}
    assert [(r.q, r.r) for r in tsv.truth_pairs(truth, tsv.read_source(spark, good)).collect()] == [(10**12 + 1, 10**12 + 22)]
    with pytest.raises(Exception, match="unknown or repeated"):
        tsv.truth_pairs(truth.withColumn("matches", F.array(F.lit("S2-9"))), tsv.read_source(spark, good)).collect()


def test_train_and_test(spark, tmp_path):
    rng = random.Random(21)
    parts = ["north", "lake", "stone", "river", "amber", "cedar", "orbit", "delta", "maple", "quartz", "summit", "harbor"]
    one, rest, truth = [], {2: [], 3: []}, []
    for i in range(60):
        name, street = " ".join(rng.sample(parts, 3)), f"{rng.randint(1, 900)} {rng.choice(parts)} street, {rng.choice(parts)}, TX"
        one.append((f"S1-{i}", f"{name} LLC", street, "US"))
        mine = []
        for s in (2, 3):
            if rng.random() < 0.7:
                rest[s].append((f"S{s}-{i}", name.upper(), street.replace("street", "st"), "US"))
                mine.append(f"S{s}-{i}")
        truth.append((f"S1-{i}", ",".join(mine)))
    for split in ("train", "test"):
        for s, rows in ((1, one), (2, rest[2]), (3, rest[3])):
            write(tmp_path / f"{split}_source{s}.tsv", [tsv.FIELDS, *rows])
    write(tmp_path / "train_ground_truth.tsv", [tsv.TRUTH_FIELDS, *truth])
    settings = matching.Settings(str(tmp_path / "work"), folds=2, share=1.0, rounds=3)
    report = matching.run_train(spark, str(tmp_path), settings)
    assert report["blocking"]["pair_recall"] == 1 and report["rules"]["macro_f05"] > 0.95 and report["stage2"]["macro_f05"] > 0.8
    matching.run_test(spark, str(tmp_path), settings, str(tmp_path / "out"))
    lists = spark.read.csv(str(tmp_path / "out" / "matching_results"), sep="\t", header=True)
    assert lists.count() == 60 and all(r.n == 0 for r in tsv.check_lists(lists, "matched_entity_ids").collect())
    sums = package.pack_results(spark, str(tmp_path / "out"), str(tmp_path / "results.zip"))
    with zipfile.ZipFile(tmp_path / "results.zip") as z:
        body = z.read("matching_results.tsv")
        assert body.count(b"\n") == 61 and body.count(b"source1_entity_id") == 1 and hashlib.sha256(body).hexdigest() == sums["matching_results.tsv"]
        assert z.read("MANIFEST.sha256").decode().splitlines()[0] == f"{sums['candidate_pairs.tsv']}  candidate_pairs.tsv"
    files = [str(tmp_path / f"train_source{i}.tsv") for i in (1, 2, 3)] + [str(tmp_path / "train_ground_truth.tsv")]
    again = stages.Stages(spark, settings.work_dir, stages.fingerprint(files=stages.input_state(spark, *files)))
    table = matching.prepare(tsv.read_split(spark, str(tmp_path), "train"), again)
    matching.describe(matching.candidates(table, settings, again), table, again)
    assert report["made"] == ["records", "candidates", "features", "stage1", "second", "stage2"] and again.made == []


def test_stages(spark, tmp_path):
    def run(source, step, code=()):
        s = stages.Stages(spark, str(tmp_path), source)
        a = s.table("a", lambda: spark.range(3), "source", ())
        s.table("b", lambda: a.select((F.col("id") * step).alias("x")), "a", code, step=step)
        return s.made

    assert run("one", 2) == ["a", "b"] and run("one", 2) == [] and run("one", 3) == ["b"]
    assert run("one", 3, (model,)) == ["b"] and run("two", 3) == ["a", "b"] and run(None, 3) == ["a", "b"]
    broken = stages.Stages(spark, str(tmp_path), "three")
    path = tmp_path / f"a-{stages.fingerprint(name='a', after='three', code={}, settings={})}"
    path.mkdir()
    (path / "part-0.parquet").write_text("half")
    assert broken.table("a", lambda: spark.range(3), "source", ()).count() == 3 and broken.made == ["a"]


def test_packing_fails_on_wrong_lists(spark, tmp_path):
    for name, column, ids in (("candidate_pairs", "candidate_entity_ids", "S2-1,S2-1"), ("matching_results", "matched_entity_ids", "")):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "part-0.csv", [("source1_entity_id", column), ("S1-1", ids)])
    with pytest.raises(ValueError, match="repeated_match"):
        package.check_results(spark, str(tmp_path))
    write(tmp_path / "candidate_pairs" / "part-0.csv", [("source1_entity_id", "candidate_entity_ids"), ("S1-2", "S2-1")])
    with pytest.raises(ValueError, match="different S1 ids"):
        package.check_results(spark, str(tmp_path))


def test_held_out_experiments(spark):
    rows = spark.range(240).select((F.col("id") / 2).cast("long").alias("q"), F.col("id").alias("r"), (F.col("id") % 2 == 0).alias("y"), (F.col("id") % 2).alias("tells"), (F.col("id") % 7).alias("noise"))
    truth, queries = rows.filter("y").select("q", "r"), rows.select("q").distinct()
    out = matching.feature_experiments(rows, queries, truth, {"good": ["tells"], "bad": ["noise"]}, share=1.0, rounds=2, least=1)
    assert out["good"]["macro_f05"] == 1 > out["bad"]["macro_f05"]
    assert out["good"]["n"] == queries.filter(model.bucket(F.col("q"), 3) == 0).count()


def test_tuning_of_given_settings(spark):
    q, t = spark.createDataFrame([(1,), (2,)], "q long"), spark.createDataFrame([(1, 5)], "q long, r long")
    p = spark.createDataFrame([(1, 5, 0.9), (2, 5, 0.6)], "q long, r long, p double")
    for tried, want in (([DecisionParams(False, "threshold", 0.5)], 0.5), ([DecisionParams(True, "threshold", 0.5)], 1.0), ([DecisionParams(True, "expected_f", 0.02, 1.0)], 1.0)):
        assert [r.macro_f05 for r in evaluate.tuning_grid(q, p, t, tried).collect()] == [want]


def test_folds_keep_queries_together(spark):
    q = spark.range(300).select(F.col("id").alias("q"))
    n = collections.Counter(r.f for r in q.select(model.bucket(F.col("q"), 3).alias("f")).collect())
    assert set(n) == {0, 1, 2} and min(n.values()) > 60 and 80 < model.sample_queries(q, 0.4).count() < 160


def test_error_samples_and_traits(spark):
    found = spark.createDataFrame([(i, i, "fn_matcher" if i % 2 else "fp_other") for i in range(80)], "q long, r long, kind string")
    first, again = ([tuple(r) for r in evaluate.error_samples(found, 5).orderBy("q").collect()] for _ in range(2))
    assert first == again and len(first) == 10
    traits = spark.createDataFrame([(i, i, i < 40) for i in range(60)], "q long, r long, early boolean")
    got = {r.kind: (r.n, round(r.early, 4)) for r in evaluate.error_traits(found, traits).collect()}
    assert got == {"fn_matcher": (40, 0.6667), "fp_other": (40, 0.6667)}
