"""Rules on one valid claim, changed one field at a time; ingestion, models, streams."""

import json
import re

import pytest
from pyspark.sql import functions as F

from claimlens import schema as S
from claimlens.functions import columns as C
from claimlens.operators import evaluate, metrics, model, profile, rules, similar, triage
from claimlens.sources import ingest
from claimlens.streaming import jobs

from .helpers import rows as rounded

VALID = dict(
    Month="May", WeekOfMonth=2, DayOfWeek="Tuesday", Make="Toyota", AccidentArea="Rural", DayOfWeekClaimed="Thursday", MonthClaimed="May", WeekOfMonthClaimed=3, Sex="Female",
    MaritalStatus="Single", Age=49, Fault="Third Party", PolicyType="Utility - All Perils", VehicleCategory="Utility", VehiclePrice="30000 to 39000", FraudFound_P=0, PolicyNumber=1,
    RepNumber=12, Deductible=500, DriverRating=2, Days_Policy_Accident="more than 30", Days_Policy_Claim="more than 30", PastNumberOfClaims="none", AgeOfVehicle="5 years",
    AgeOfPolicyHolder="41 to 50", PoliceReportFiled="Yes", WitnessPresent="Yes", AgentType="Internal", NumberOfSuppliments="1 to 2", AddressChange_Claim="4 to 8 years",
    NumberOfCars="2 vehicles", Year=1995, BasePolicy="All Perils",
)
CASES = [
    ({}, set()),
    ({"Make": None}, {"V01"}),
    ({"Make": "Trabant"}, {"V02"}),
    ({"Age": 0, "AgeOfPolicyHolder": "16 to 17"}, {"V03"}),
    ({"AgeOfPolicyHolder": "over 65"}, {"V04"}),
    ({"PolicyType": "Sport - Collision"}, {"V05"}),
    ({"PolicyType": "Sedan - Liability", "VehicleCategory": "Sport", "BasePolicy": "Liability"}, {"V05B"}),
    ({"WeekOfMonth": 4, "WeekOfMonthClaimed": 2}, {"V06"}),
    ({"Month": "Dec", "WeekOfMonth": 5, "MonthClaimed": "Jan", "WeekOfMonthClaimed": 1}, set()),
    ({"Month": "Jan", "MonthClaimed": "Aug"}, {"V07"}),
    ({"Days_Policy_Accident": "1 to 7"}, {"V08"}),
    ({"Days_Policy_Claim": "15 to 30"}, {"V09"}),
    ({"Days_Policy_Accident": "15 to 30", "Days_Policy_Claim": "15 to 30", "Month": "Jan", "MonthClaimed": "Apr"}, {"V10"}),
    ({"Age": 18, "AgeOfPolicyHolder": "21 to 25"}, {"V11"}),
    ({"Age": 18, "AgeOfPolicyHolder": "21 to 25", "AgeOfVehicle": "new", "PastNumberOfClaims": "more than 4"}, {"V12"}),
]


def frame(spark, changes):
    return spark.createDataFrame([tuple({**VALID, **c, "PolicyNumber": i}[k] for k in S.COLUMNS) for i, c in enumerate(changes)], S.CLAIMS)


def test_rules_one_change_at_a_time(spark):
    got = {}
    for r in rules.validate(frame(spark, [c for c, _ in CASES]), "PolicyNumber").where("not passed").collect():
        got.setdefault(r.claim_id, set()).add(r.rule_id.split("_")[0])
        assert "{" not in r.message
    assert [got.get(i, set()) for i in range(len(CASES))] == [e for _, e in CASES]


def test_blocking_and_catalogue(spark):
    df = rules.run_rules(frame(spark, [{}, {"Age": 0, "AgeOfPolicyHolder": "16 to 17"}, {"Sex": None}]))
    assert [r[0] for r in df.orderBy("PolicyNumber").select(rules.blocking_failures(df)).collect()] == [False, True, True]
    rules.check_catalogue()
    with pytest.raises(ValueError):
        rules.check_catalogue(flags=[rules.RedFlag("X", "info", {"NoSuch": [1]})])
    assert rules.catalogue(spark).count() == len(rules.RULES) + len(rules.RED_FLAGS)


def test_features(spark):
    row = frame(spark, [{"Month": "Dec", "MonthClaimed": "Jan", "WeekOfMonth": 5, "WeekOfMonthClaimed": 1}]).withColumns(C.engineered()).first()
    assert row.claim_lag_months == 1 and row.lag_bucket == "1 month" and row.age_band == "41-50"
    assert round(row.claim_lag_weeks, 4) == round(52 / 12 - 4, 4)


def test_week_dates_stay_in_the_month(spark):
    import calendar
    from datetime import date, timedelta

    cells = [(y, m, w, d) for y in (1994, 1996) for m in (2, 5, 12) for w in range(1, 7) for d in S.WEEKDAYS] + [(1994, 13, 1, "Monday"), (1994, 1, 1, "0")]
    df = spark.createDataFrame(cells, "y long, m long, w long, d string").select("*", C.week_date(F.col("y"), F.col("m"), F.col("w"), F.col("d")).alias("r"))

    def brute(y, m, w, d):
        if d not in S.WEEKDAYS or not 1 <= m <= 12:
            return None
        days = [date(y, m, k) for k in range(1, calendar.monthrange(y, m)[1] + 1) if date(y, m, k).weekday() == S.WEEKDAYS.index(d)]
        monday = date(y, m, 1) - timedelta(days=date(y, m, 1).weekday())
        want = monday + timedelta(days=7 * (w - 1) + S.WEEKDAYS.index(d))
        return min(days, key=lambda x: abs((x - want).days))

    for r in df.collect():
        assert r.r == brute(r.y, r.m, r.w, r.d)


def test_ingest(spark, tmp_path):
    path = tmp_path / "claims.csv"
    line = ",".join(str(VALID[c]) for c in S.COLUMNS)
    path.write_text("﻿" + ",".join(S.COLUMNS) + "\n" + line + "\n", encoding="utf-8")
    assert ingest.read_claims(spark, str(path)).first().Month == VALID["Month"]
    path.write_text(",".join(reversed(S.COLUMNS)) + "\n" + line + "\n")
    with pytest.raises(ValueError):
        ingest.read_claims(spark, str(path))
    raw = ingest.parse_claims(spark, [{"policy number": "12.0", "make": " honda ", "AGE": "old"}, {"make": "NaN"}])
    rows = ingest.normalize_claims(raw).select("Make", "Age", "claim_id", "invalid", F.size("missing").alias("m")).collect()
    assert (rows[0].Make, rows[0].claim_id, rows[0].invalid) == ("Honda", "PN-12", ["Age"])
    assert (rows[1].Make, rows[1].claim_id, rows[1].m) == (None, "unidentified", len(S.COLUMNS))
    (tmp_path / "c.json").write_text(json.dumps([{"Make": "Ford", "Age": 3}]))
    assert ingest.parse_claims(spark, str(tmp_path / "c.json")).first().Age == "3"
    assert set(S.COLUMNS) <= set(ingest.ensure_columns(raw).columns)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "P7.json").write_text(json.dumps({"versions": [{"version": "a", "deductible": 400}]}))
    doc = ingest.read_policy_documents(spark, str(tmp_path / "docs")).first()
    assert doc.policy_id == "P7" and doc.versions[0].deductible == 400
    (tmp_path / "h.csv").write_text("policy_id,claim_id\n1,c1\n")
    assert ingest.read_history(spark, str(tmp_path / "h.csv")).first().outcome is None
    clauses = spark.createDataFrame([("a", ["x", "y"])], "clause_id string, coverage array<string>")
    assert ingest.clause_table(clauses).count() == 2
    df = spark.createDataFrame([(1, 0), (2, 1)], "PolicyNumber long, is_synthetic int")
    ingest.write_real_train(df, str(tmp_path / "t"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).columns == ["PolicyNumber"]


def test_metrics_small(spark):
    df = spark.createDataFrame([(i, int(y), p) for i, (y, p) in enumerate([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)])], "id long, y int, p double")
    r = metrics.ranking_metrics(df, "y", "p").first()
    assert r.roc_auc == pytest.approx(0.625) and r.pr_auc == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    n = spark.range(2313).select("id", (F.col("id") % 17 == 0).cast("int").alias("y"), (F.col("id") / 2313).alias("p"))
    assert [x.n for x in metrics.reliability_table(n, "id", "y", "p").orderBy("bin").collect()] == [232, 231, 231, 231, 232, 231, 231, 231, 231, 232]
    assert [x.n for x in metrics.lift_table(n, "id", "y", "p").orderBy("decile").collect()] == [232, 231, 231, 232, 231, 231, 232, 231, 231, 231]
    assert metrics.threshold_metrics(df.where("false"), "y", "p", 0.5).first().precision == 0.0


def test_sampling_is_exact_and_ignores_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    a = {r.id for r in model.subsample(df, "id", ["y"], 50).collect()}
    assert a == {r.id for r in model.subsample(df.repartition(7), "id", ["y"], 50).collect()} and len(a) == 100
    s = evaluate.stratified_sample(df, "id", "y", 20, 2).groupBy("y").agg(F.count("*").alias("n"), F.first("weight").alias("w")).orderBy("y").collect()
    assert [(r.n, r.w) for r in s] == [(40, 750 / 40), (20, 250 / 20)]


def test_guards(spark):
    with pytest.raises(ValueError):
        model.guard_features(["PolicyNumber"])
    with pytest.raises(ValueError):
        similar.real_rows_only(spark.createDataFrame([("synthetic",)], "split string"), "split")


def test_matching_bands_find_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(3)
    rows = [(i, *[rng.choice("ab") for _ in range(6)]) for i in range(60)]
    cols = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame(rows, ["id", *cols])
    got = {(r.a, r.b) for r in similar.matching_at_least(df, df, "id", cols, 1).collect()}
    want = {(x[0], y[0]) for x, y in itertools.permutations(rows, 2) if sum(p == q for p, q in zip(x[1:], y[1:])) >= 5}
    assert got == want


def test_grounding(spark):
    source = {"ok": True, "status": "completed", "p": 0.1234, "n": 5, "flags": ["RF01_PH_FAULT"]}
    rows = [(1, source, source | {"ok": False}, source | {"status": "unavailable"})]
    shape = "struct<ok:boolean,status:string,p:double,n:int,flags:array<string>>"
    src = spark.createDataFrame(rows, f"id int, score {shape}, failed {shape}, history {shape}")
    expected = {
        ("score", "probability 0.123"): True, ("score", "probability 0.1234"): True, ("score", "probability 0.124"): False, ("score", "12.3% risk"): True, ("score", "12% risk"): True, ("score", "12.7% risk"): False,
        ("score", "rate 0.05"): True, ("score", "5 claims"): True, ("score", "9 hits"): False, ("score", "RF01_PH_FAULT fired"): True, ("score", "RF02 fired"): False, ("score", "fine"): True, ("score", "x5y and v1.5"): True,
        ("failed", "5 claims"): False, ("failed", "unavailable"): False, ("history", "5 claims"): False, ("history", "history is not on file"): True, ("history", "5 are missing"): True, ("none", "5"): False,
    }
    facts = spark.createDataFrame([(1, s, f) for s, f in expected], "id int, source string, fact string")
    got = {(r.source, r.fact): r.grounded for r in triage.grounded_facts(facts, src, "id", ["score", "failed", "history"]).collect()}
    assert got == expected


def test_guardrails(spark):
    rows = [("approve", "high", False, 0), ("flag", "low", False, 0), ("deny", "low", True, 0), ("approve", None, False, 0), ("approve", "low", False, 1)]
    df = spark.createDataFrame(rows, "proposed string, risk_band string, blocking boolean, record_fails long")
    got = [(r.decision, r.category) for r in triage.apply_guardrails(df).collect()]
    assert got == [("FLAG_FOR_INVESTIGATION", "FRAUD_RISK"), ("APPROVE", None), ("REQUEST_MORE_INFORMATION", None), ("FLAG_FOR_INVESTIGATION", "SYSTEM_FAILURE"), ("REQUEST_MORE_INFORMATION", None)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], S.CLAIMS)
    assert rules.rule_hit_summary(empty, "FraudFound_P").count() == 0
    assert profile.frequency_table(empty, ["Make"], "Year").count() == 0


def test_streams(spark, tmp_path):
    claims = tmp_path / "claims"
    claims.mkdir()
    (claims / "a.json").write_text("\n".join(json.dumps({**VALID, "PolicyNumber": i, "Age": 47 if i else 0}) for i in range(3)))
    score = lambda df: df.withColumns({"risk_band": F.lit("low"), "fraud_probability": F.lit(0.1)})
    for n in ("1", "2"):  # the second run sees the same files again and adds nothing
        jobs.stream_triage(spark, str(claims), S.CLAIMS, score, str(tmp_path / "out"), str(tmp_path / f"cp{n}")).awaitTermination()
    out = jobs.sink(spark, str(tmp_path / "out"), "PolicyNumber", "bigint").read()
    assert out.count() == 3 and out.where("decision = 'REQUEST_MORE_INFORMATION'").count() == 1
    rec = spark.createDataFrame([("r1", "APPROVE"), ("r2", "APPROVE")], "run_id string, decision string")
    rec.write.parquet(str(tmp_path / "rec"))
    reviews = tmp_path / "rev"
    reviews.mkdir()
    rows = [(1, "r1", "DENY", " "), (2, "r1", "DENY", "seen"), (3, "r1", "APPROVE", ""), (4, "r2", "APPROVE", "")]
    (reviews / "a.json").write_text("\n".join(json.dumps(dict(zip(("review_id", "run_id", "decision", "reason"), r))) for r in rows))
    jobs.stream_reviews(spark, str(reviews), str(tmp_path / "rec"), str(tmp_path / "audit"), str(tmp_path / "cp3")).awaitTermination()
    got = {r.review_id: r.status for r in jobs.reviews(spark, str(tmp_path / "audit")).read().collect()}
    assert got == {1: "override without reason", 2: "accepted", 3: "already reviewed", 4: "accepted"}


def test_large_query_sets_are_dealt_into_blocks(spark, monkeypatch):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3] if i % 7 else None, i * 37 % 101 / 101, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b string, x double, v array<double>")
    q, r = df.where("id % 2 = 0"), df.where("id % 3 = 1")
    runs = [
        lambda: similar.gower_dcr(q, r, "id", ["a", "b"], ["x"]), lambda: similar.max_matching(q, r, "id", ["a", "b", "x"]),
        lambda: similar.similar_claims(q, df, "id", "v", 3), lambda: similar.similar_claims(q, df, "id", "v", 3, "a"),
    ]
    whole = [sorted(map(tuple, f().collect())) for f in runs]
    monkeypatch.setattr(similar, "MAX_QUERIES", 7)
    assert [sorted(map(tuple, f().collect())) for f in runs] == whole


def test_grouped_gower_equals_all_pairs(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3] if i % 7 else None, None if i % 11 == 10 else i * 37 % 101 / 101) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, a string, b string, x double")
    q, r = df.where("id % 2 = 0"), df.where("id % 3 = 1")
    want = {i: d for i, d in similar.gower_dcr(q, r, "id", ["a", "b"], ["x"]).collect()}
    for cells in (1, 4, 4096):
        got = {i: d for i, d in similar.gower_dcr_grouped(q, r, "id", ["a", "b"], "x", cells).collect()}
        assert got.keys() == want.keys() and all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-12 for i in want)


def test_distances_for_every_synthetic_row(spark, sf_dir):
    from claimlens.plans.registry import QUERIES
    from claimlens.plans import scoring_queries  # noqa: F401
    from claimlens.sources import adapters

    n = adapters.cases(spark, sf_dir).where("split = 'synthetic'").count()
    assert QUERIES["f02_gower_all"](spark, sf_dir).count() == QUERIES["f04_max_matching_all"](spark, sf_dir).count() == n


def test_adversarial_validation_scores_the_surplus(spark):
    rows = [(i, "r" if i % 3 == 0 else "s", "ab"[i % 2], float(i % 3) + i / 90) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, split string, a string, x double")
    out = model.adversarial_validation(df, "id", "split", "r", "s", ["a"], ["x"], 2).collect()
    assert sorted(r.id for r in out) == list(range(90)) and all(r.p is not None for r in out)
    surplus = [r for r in out if r.fold is None]
    assert len(surplus) == 30 and {r.is_right for r in surplus} == {1}


def test_percentiles_match_numpy(spark):
    import numpy as np

    from claimlens.operators import metrics

    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=501), "b": np.repeat([0.5], 300), "c": np.concatenate([np.zeros(900), rng.random(7)]), "d": np.array([3.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)], "g string, v double")
    got = {r.g: r for r in metrics.exact_percentiles(df, "v", [0.0, 0.1, 0.5, 0.975, 1.0], ["g"]).collect()}
    many = {r.g: r.q for r in metrics.even_percentiles(df, "v", 40, ["g"]).collect()}
    assert set(got) == set(many) == set(groups)
    for k, vs in groups.items():
        assert list(got[k])[1:] == pytest.approx(list(np.percentile(vs, [0, 10, 50, 97.5, 100])))
        assert many[k] == pytest.approx(list(np.percentile(vs, np.arange(41) * 2.5)))


def test_core_does_not_import_the_training_operators():
    from pathlib import Path

    root = Path(similar.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_matching_counts_with_copies_and_nulls(spark):
    rows = [(i, "ab"[i % 2], None if i % 7 == 0 else "xyz"[i % 3], i % 4) for i in range(40)] + [(100 + i, "a", "x", 0) for i in range(9)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c int")
    q = df.where("id % 5 <> 1")
    for misses in (0, 1, 2):
        want = {r[0]: sum(s[0] != r[0] and sum(x == y for x, y in zip(r[1:], s[1:])) >= 3 - misses for s in rows) for r in rows if r[0] % 5 != 1}
        assert {r.id: r.n for r in similar.matching_counts(q, df, "id", ["a", "b", "c"], misses).collect()} == want
    assert similar.matching_counts(q, df.limit(0), "id", ["a", "b", "c"], 1).agg(F.sum("n")).first()[0] == 0


def test_dcr_quantiles_match_numpy(spark):
    import numpy as np

    values = [0.0, 0.0, 0.1, 0.25, 0.7, None]
    got = similar.dcr_quantiles(spark.createDataFrame([(v,) for v in values], "dcr double")).first().asDict()
    for q in (1, 5, 25, 50):
        assert abs(got[f"p{q}"] - np.percentile([v for v in values if v is not None], q)) < 1e-12
    assert abs(got["zero_share"] - 0.4) < 1e-12


def test_drop_top_and_importances(spark):
    rows = [(i, "r" if i % 2 else "s", "ab"[i // 2 % 2], float(i % 2) * 10 + i % 5, float(i * 37 % 11)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, split string, a string, x double, y double")
    shares = {r.feature: r.share for r in model.adversarial_importance(df, "id", "split", "r", "s", ["a"], ["x", "y"], 2).collect()}
    assert max(shares, key=shares.get) == "x" and abs(sum(shares.values()) - 1) < 1e-9
    out = model.adversarial_drop_top(df, "id", "split", "r", "s", ["a"], ["x", "y"], ["x", "y", "a"], 3, 2).orderBy("step").collect()
    assert [(r.step, r.dropped) for r in out] == [(1, "x"), (2, "y")] and out[0].auc_mean < 0.9


def test_data_mix_and_early_stopping(spark):
    rows = [(i, "real_train" if i % 3 else "synthetic", int(i % 4 == 0), float(i % 4 == 0) + (i * 37 % 10) / 8, "ab"[i % 2]) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, split string, y int, x double, a string")
    out = model.data_mix(df, df, [(0.0, 1.0, True), (0.5, 0.3, True), (1.0, 1.0, False)], "id", "split", "y", ["a"], ["x"], "logistic").orderBy("mix").collect()
    assert [(r.train_rows, r.synthetic_rows) for r in out] == [(160, 0), (200, 40), (80, 80)]
    assert sum(r.chosen for r in out) == 1 and not out[2].chosen and all(0 < r.pr_auc_mean <= 1 and r.pr_auc_sd >= 0 for r in out)
    stopped = model.fit_scorer(df.withColumn("held", F.col("id") % 5 == 0), ["a"], ["x"], "y", "boosted", held="held").stages[-1]
    assert 1 <= stopped.getNumTrees <= 20


def test_stream_joins_static_tables(spark, tmp_path):
    claims = tmp_path / "claims"
    claims.mkdir()
    (claims / "a.json").write_text("\n".join(json.dumps({**VALID, "PolicyNumber": i}) for i in range(4)))
    policies = spark.createDataFrame([(1, "high"), (2, "low")], "PolicyNumber long, risk_band string")
    score = lambda df: df.withColumn("fraud_probability", F.lit(0.1))
    jobs.stream_triage(spark, str(claims), S.CLAIMS, score, str(tmp_path / "out"), str(tmp_path / "cp"), context=[(policies, ["PolicyNumber"])]).awaitTermination()
    got = {r.PolicyNumber: (r.decision, r.flag_category) for r in jobs.sink(spark, str(tmp_path / "out"), "PolicyNumber", "bigint").read().collect()}
    assert got == {0: ("FLAG_FOR_INVESTIGATION", "SYSTEM_FAILURE"), 1: ("FLAG_FOR_INVESTIGATION", "FRAUD_RISK"), 2: ("APPROVE", None), 3: ("FLAG_FOR_INVESTIGATION", "SYSTEM_FAILURE")}


def test_chi2_survival_equals_known_values(spark, duck):
    """Closed forms (dof 2 and 4), tabulated points, and a power series in SQL, to 1e-9."""
    import math

    from claimlens.functions.columns import chi2_survival
    from claimlens.plans.claims_queries import p_value

    grid = [(x, k) for k in (1, 2, 3, 4, 7, 30, 301, 10_000) for x in (0.0, 1e-8, 0.3, 1.0, 5.0, k - 0.5, k + 0.0, k + 1.0, 1.3 * k + 5, 3.0 * k)]
    df = spark.createDataFrame([(float(x), k) for x, k in grid], "x double, k long")
    found = {(r.x, r.k): r.p for r in df.withColumn("p", chi2_survival(F.col("x"), F.col("k"))).collect()}
    for (x, k), p in found.items():
        expected = duck.sql(f"SELECT {p_value(f'{x!r}::DOUBLE', k)}").fetchall()[0][0]
        assert abs(p - expected) < 1e-9, (x, k, p, expected)
        if k == 2:
            assert abs(p - math.exp(-x / 2)) < 1e-12
        if k == 4:
            assert abs(p - math.exp(-x / 2) * (1 + x / 2)) < 1e-12
        if k == 1:
            assert abs(p - math.erfc(math.sqrt(x / 2))) < 1e-11
    edge = spark.createDataFrame([(0.0, 0, 1.0), (3.0, 0, 1.0), (-1e-12, 5, 1.0), (None, 3, None), (2.0, None, None), (1e6, 4, 0.0), (11.070497693516351, 5, 0.05)], "x double, k long, e double")
    for r in edge.withColumn("p", chi2_survival(F.col("x"), F.col("k"))).collect():
        assert r.p == r.e or abs(r.p - r.e) < 1e-9


def test_history_window_equals_all_pairs(spark):
    import datetime
    import random

    from claimlens.operators import policy

    rng, day = random.Random(3), datetime.date(2020, 1, 1)
    rows = [(i, rng.choice(["a", "b", "c", None]), day + datetime.timedelta(rng.randint(0, 60)) if rng.random() < 0.95 else None) for i in range(200)]
    old = [(i, e, d) for i, e, d in rows if rng.random() < 0.8] + [(5, "a", day), (5, "b", day), (1000, "a", day), (1000, "a", day), (None, "a", day)]
    claims = spark.createDataFrame(rows, "case_id long, entity_id string, on_day date")
    history = spark.createDataFrame(old, "old_id long, entity_id string, old_day date")
    days = int(365.25 * 0.05)
    expected = {}
    for i, e, d in rows:
        near = sorted((od, o) for o, oe, od in old if None not in (e, d, o, oe, od) and oe == e and d - datetime.timedelta(days) <= od < d and o != i)
        expected[i] = (len(near), ",".join(str(o) for _, o in near), "available") if e and d else (None, None, "unavailable")
    for chunk in (1, 3, 256):
        found = policy.claim_history(claims, history, "case_id", "entity_id", "on_day", "old_id", "old_day", 0.05, chunk=chunk)
        assert {r[0]: tuple(r[1:]) for r in found.collect()} == expected
    counted = policy.claim_history(claims, history, "case_id", "entity_id", "on_day", "old_id", "old_day", 0.05, listed=False)
    assert {r.case_id: (r.n_previous, r.status) for r in counted.collect()} == {i: (n, s) for i, (n, _, s) in expected.items()}


def test_history_of_one_entity_with_many_claims_is_linear(spark):
    """100,000 claims of one entity with 1,825 to 5,475 before each: the plan forms no pairs."""
    import time

    from claimlens.operators import policy

    claims = spark.range(100_000).select("id", F.lit(7).alias("entity_id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") % 20_000).cast("int")).alias("on_day"))
    took = time.time()
    out = policy.claim_history(claims, claims, "id", "entity_id", "on_day", "id", "on_day", 3.0, listed=False)
    total = out.agg(F.sum("n_previous"), F.max("n_previous")).first()
    expected = sum(5 * min(d, 1095) for d in range(20_000)) * 5
    assert (total[0], total[1]) == (expected, 5 * 1095)
    assert time.time() - took < 60
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_k_is_exact_and_compares_less_than_all(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    data = np.concatenate([centres[rng.integers(0, 12, 900)] + 0.15 * rng.normal(size=(900, 16)), np.repeat(centres[:1], 40, axis=0), np.zeros((3, 16))])
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(data)] + [(2000, None, "a"), (2001, [1.0, None] * 8, "a"), (2002, [1.0], "a"), (2003, data[0].tolist(), None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, a string")
    unit = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-12)
    cosine = np.round(unit @ unit.T, 12)
    for options in ({}, {"same": "a"}, {"block": 50}, {"pivots": 1}, {"pivots": 5, "block": 200}):
        tally = []
        out = similar.similar_claims(df.where("id % 3 = 0"), df, "id", "v", 7, tally=tally, **options)
        found = {}
        for r in out.collect():
            found.setdefault(r["query"], {})[r["rank"]] = (r.neighbour, r.similarity)
        if not options:
            found.pop(2001, None)
        assert set(found) >= set(range(0, len(data), 3))
        for i in range(0, len(data), 3):
            others = [j for j in range(len(data)) if j != i and (not options.get("same") or j % 2 == i % 2)] + ([2003] if "same" not in options else [])
            value = lambda j: cosine[i, j if j < len(data) else 0]
            best = sorted((-value(j), j) for j in others)[:7]
            assert [found[i][k + 1][1] for k in range(7)] == pytest.approx([-s for s, _ in best], abs=1.01e-4)
            clear = [j for s, j in best if s < best[-1][0] - 1e-6]
            assert set(clear) <= {j for j, _ in found[i].values()}
        if not options:
            assert sum(tally) < 0.5 * (len(data) + 1) * len(found)
    assert similar.similar_claims(df, df.limit(0), "id", "v", 3).count() == 0
    assert similar.similar_claims(df.limit(0), df, "id", "v", 3).count() == 0


def test_top_k_breaks_ties_by_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "id long, v array<double>")
    out = similar.similar_claims(df, df, "id", "v", 3, block=4)
    assert all(r.neighbour == [x for x in range(30) if x != r["query"]][r["rank"] - 1] for r in out.collect())


def test_nearest_number_of_skewed_amounts(spark):
    """Log-normal numbers, one tuple that holds half of all, out-of-range queries and tuples that nobody shares."""
    import numpy as np

    rng = np.random.default_rng(2)
    amounts = rng.lognormal(0, 2, 3000) / 300
    rows = [(i, "a" if i % 2 else "abcdefg"[i % 7], None if i % 13 == 0 else "xy"[i % 3 % 2], float(x)) for i, x in enumerate(amounts)]
    rows += [(4000, "zz", "zz", 0.3), (4001, "zz", "x", 5.0), (4002, "a", "zz", -3.0), (4003, "a", "x", None)]
    df = spark.createDataFrame(rows, "id int, a string, b string, x double")
    q, r = df.where("id % 4 = 0 or id >= 4000"), df.where("id % 4 = 1")
    want = {i: d for i, d in similar.gower_dcr(q, r, "id", ["a", "b"], ["x"]).collect()}
    for buckets in (1, 64):
        got = {i: d for i, d in similar.gower_dcr_grouped(q, r, "id", ["a", "b"], "x", buckets).collect()}
        assert got.keys() == want.keys() and all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-12 for i in want)


def test_most_matching_columns_equal_all_pairs(spark):
    import random

    rng = random.Random(6)
    names = list("abcdefg")
    data = [(i, *[rng.choice([None, *"uvwxyz"[: 2 + c]]) for c in range(7)]) for i in range(160)] + [(900, *["?"] * 7)]
    df = spark.createDataFrame(data, "id int, " + ", ".join(f"{c} string" for c in names))
    q, r = df.where("id % 3 = 0"), df.where("id % 3 = 1")
    want = {x[0]: max(sum(a == b for a, b in zip(x[1:], y[1:])) for y in data if y[0] % 3 == 1) for x in data if x[0] % 3 == 0}
    best = similar.max_matching(q, r, "id", names)
    assert {i: m for i, m in best.collect()} == want and want[900] == 0
    assert similar.max_matching(q, r.limit(0), "id", names).count() == 0
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    line = {x.most: x for x in similar.matching_histogram(best, 7).collect()}
    assert sum(x.n for x in line.values()) == len(want) and line[0].at_least == 1.0 and line[0].n == 1


def test_scratch_deletes_what_is_not_kept(spark):
    from pathlib import Path

    from claimlens.sources.shared import materialise, scratch

    with scratch() as keep:
        gone = materialise(spark.range(3), "gone")
        with scratch() as inner:
            kept, lost = inner(materialise(gone.select("id"), "kept")), materialise(spark.range(1), "lost")
        assert not Path(lost.written_to).exists() and gone.count() == 3
        last = keep(materialise(kept, "last"))
    assert last.count() == 3
    assert not Path(gone.written_to).exists() and not Path(kept.written_to).exists() and Path(last.written_to).exists()


def test_calibrators_are_fitted_once_and_applied_to_any_rows(spark):
    import math
    import random

    rng = random.Random(7)
    rows = [(i, p, int(rng.random() < p * p)) for i, p in enumerate(rng.random() for _ in range(1500))]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    iso = model.fit_calibrator(df, "y", "p", "isotonic")
    blocks = []  # pool adjacent violators by hand
    for _, p, y in sorted(rows, key=lambda r: r[1]):
        blocks.append([y, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
    fitted = [s / n for s, n in blocks for _ in range(n)]
    got = {r.id: r.calibrated for r in model.apply_calibrator(df, "p", iso).collect()}
    assert all(abs(got[r[0]] - v) < 1e-9 for r, v in zip(sorted(rows, key=lambda r: r[1]), fitted))
    other = model.apply_calibrator(spark.createDataFrame([(-1.0,), (2.0,), (None,), (0.5,)], "p double"), "p", iso, cells=7).collect()
    assert other[0].calibrated == fitted[0] and other[1].calibrated == fitted[-1] and other[2].calibrated is None and 0.1 < other[3].calibrated < 0.4
    table = model.fit_calibrator(df, "y", "p", "platt")
    line, platt = table.first(), model.apply_calibrator(df, "p", table, "c").where("id = 3").first()
    logit = math.log(platt.p / (1 - platt.p))
    assert abs(platt.c - 1 / (1 + math.exp(-(line.at_low * logit + line.at_high)))) < 1e-12 and 1.0 < line.at_low < 3.0
    report = {r.kind: r for r in model.calibration_report(df, "id", "y", "p", 3).collect()}
    assert sum(r.chosen for r in report.values()) == 1 and not report["none"].chosen and min(report["platt"].brier, report["isotonic"].brier) < report["none"].brier
    out, best = model.calibrate(df, "id", "y", "p", 3)
    assert report[best].chosen and out.count() == len(rows)


def test_many_rows_of_one_score_are_numbered_by_ranges(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 10 < 9, 0.5).otherwise(F.col("id") / 3000).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.when(F.col("id") % 2 == 0, "a").alias("g"))
    runs = [lambda: metrics.lift_table(df, "id", "y", "s"), lambda: metrics.reliability_table(df, "id", "y", "s"), lambda: metrics.precision_at_top(df.where("g = 'a'"), "id", "y", "s", 0.3, ["g"])]
    plain = [rounded(f().collect()) for f in runs]  # means depend on the order of sums in their last digits
    monkeypatch.setattr(metrics, "MOST_TIES", 50)
    assert [rounded(f().collect()) for f in runs] == plain


def test_runs_with_a_cut_last_line_resume(spark, tmp_path):
    lines = [json.dumps({"case": i, "run_index": 0, "decision": "APPROVE"}) for i in range(5)]
    (tmp_path / "runs.jsonl").write_text("\n".join(lines)[:-12])
    runs, damaged = ingest.read_runs(spark, str(tmp_path / "runs.jsonl"), "case long, run_index long, decision string")
    assert sorted(r["case"] for r in runs.collect()) == [0, 1, 2, 3] and damaged.first().n_damaged == 1
    wanted = spark.range(6).select(F.col("id").alias("case"), F.lit(0).cast("long").alias("run_index"))
    assert sorted(r["case"] for r in evaluate.open_runs(wanted, runs, ["case", "run_index"]).collect()) == [4, 5]


def test_bootstrap_by_counts_of_scores(spark):
    import random

    rng = random.Random(3)
    rows = [(i, "ab"[i % 2], int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, y int, s double")
    drawn = metrics.bootstrap_counts(df, "y", ["s"], 20, "b", ["g"])
    sizes = {(r.g, r.y): r["count"] for r in df.groupBy("g", "y").count().collect()}
    totals = drawn.groupBy("g", "y", "replicate").agg(F.sum("weight").alias("n")).collect()
    assert len(totals) == 4 * 20 and all(r.n == sizes[r.g, r.y] for r in totals)
    held = {(r.g, r.y, r.s): r["count"] for r in df.groupBy("g", "y", "s").count().collect()}
    got = drawn.groupBy("g", "y", "s").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 20 * held[r.g, r.y, r.s]) < 6 * (20 * held[r.g, r.y, r.s]) ** 0.5 + 1 for r in got)
    again = metrics.bootstrap_counts(df.repartition(7), "y", ["s"], 20, "b", ["g"])
    assert sorted(map(str, again.collect())) == sorted(map(str, drawn.collect()))
    # the intervals are those of drawn rows but for chance, and the shuffle holds no row for each draw
    wide = {d: {(r.g, r.metric): r for r in metrics.metrics_with_ci(df, "id", "y", "s", 0.4, 40, by=["g"], draw=d).collect()} for d in ("rows", "scores")}
    for k, r in wide["rows"].items():
        other = wide["scores"][k]
        assert r.value == other.value and other.low <= r.value <= other.high and abs(r.low - other.low) < 0.04 and abs(r.high - other.high) < 0.04
    pair = metrics.paired_bootstrap(df.withColumn("t", 1 - F.col("s")), "id", "y", "s", "t", 0.4, 20, by=["g"], draw="scores")
    assert pair.count() == 2 and all(r.low <= r.mean_diff <= r.high for r in pair.collect())


def test_utility_over_seeds_and_masks(spark):
    import random

    rng = random.Random(11)
    rows = []
    for i in range(900):
        y = int(rng.random() < 0.4)
        origin = ("real_train", "synthetic", "real_validation")[i % 3]
        noise = origin == "synthetic" and i % 2 == 1  # half of the synthetic rows tell the wrong label
        rows.append((i, origin, y, (1 - y if noise else y) + rng.gauss(0, 0.8), noise, "c"))
    df = spark.createDataFrame(rows, "id long, split string, y int, x double, noise boolean, c string")
    mixes = [("all", 1.0, 1.0, False), ("clean", 1.0, 1.0, False)]
    out = model.utility_seeds(df, df.where("split = 'real_validation'"), mixes, "id", "split", "y", ["c"], ["x"], seeds=(1, 2), masks={"clean": ~F.col("noise")}, replicates=20)
    found = {(r.mix, r.metric): r for r in out.collect()}
    assert len(found) == 6 and all(r.low <= r.value <= r.high for r in found.values())
    assert found["clean", "roc_auc"].value > 0.7 and found["clean", "brier"].value < found["all", "brier"].value
    assert abs(found["clean", "roc_auc"].seed_mean - found["clean", "roc_auc"].value) < 0.02


def test_validate_puts_messages_together_after_the_unpivot(spark):
    """Messages belong to the rows of their rules: within the generator, each claim would pay for all of them."""
    from claimlens import schema as S
    from claimlens.operators import rules

    kinds = ", ".join(f"{c} {'long' if c in S.INTEGERS else 'string'}" for c in S.COLUMNS)
    values = {"Age": 0, "PolicyNumber": 7, "Month": "Jan", "MonthClaimed": "Aug", "Make": "Unheard"}
    df = spark.createDataFrame([tuple(values.get(c) for c in S.COLUMNS)], kinds)
    out = rules.validate(df, "PolicyNumber")
    got = {r.rule_id: r for r in out.collect()}
    assert out.columns == ["claim_id", "rule_id", "severity", "passed", "message"] and list(got) == [r.id for r in rules.RULES]
    assert all(r.claim_id == 7 and (r.message is None) == r.passed for r in got.values())
    assert got["V02_DOMAIN_VALUES"].message == "Values outside the known sets: Make=Unheard."
    assert got["V07_REPORTING_DELAY"].message == "Accident in Jan, claim in Aug: six months or more."
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("Generate" in line and "Accident in" in line for line in plan.splitlines())
