"""Queries over scores, decisions, policies, history and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluate, metrics, model, policy, rules, similar, triage
from ..sources import adapters as A
from . import claims_queries
from .claims_queries import CASES, CLAIMS, r6, wilson
from .registry import query

T = 0.4
_CM = f"count(*) FILTER (score >= {T} AND label = 1) AS tp, count(*) FILTER (score >= {T} AND label = 0) AS fp, count(*) FILTER (score < {T} AND label = 1) AS fn, count(*) FILTER (score < {T} AND label = 0) AS tn"
_SPLIT = "cases c"
_H = "('0x' || substr(md5('{s}:' || {k}), 1, 8))::BIGINT"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE 0.0 END"


def _metrics_sql(by: str, table: str) -> str:
    p, r = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
    return f"SELECT {by}, tp, fp, fn, tn, round({ratio('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round({p}, 6) AS precision, round({r}, 6) AS recall, round({ratio('2 * p * r', 'p + r')}, 6) AS f1, round({ratio('5 * p * r', '4 * p + r')}, 6) AS f2, round({ratio('fp', 'fp + tn')}, 6) AS fpr, round({ratio('tp + fp', 'tp + fp + fn + tn')}, 6) AS flag_rate FROM (SELECT *, {p} AS p, {r} AS r FROM {table})"


@query("g01_threshold_metrics", f"WITH {CASES}, g AS (SELECT split, {_CM} FROM cases GROUP BY 1) {_metrics_sql('split', 'g')}")
def threshold_metrics(spark, d):
    return r6(metrics.threshold_metrics(A.cases(spark, d), "label", "score", T, ["split"]))


_ROUNDED = "r AS (SELECT case_id, split, label, round(score, 2)::DOUBLE AS s, priority, segment FROM cases)"
_CURVE = "d AS (SELECT split, s, count(*) AS n, sum(label) AS p FROM r GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY s DESC) AS ng, sum(p) OVER (PARTITION BY split ORDER BY s DESC) AS pg, sum(n) OVER (PARTITION BY split) AS na, sum(p) OVER (PARTITION BY split) AS pa FROM d)"


@query("g02_ranking_metrics", f"WITH {CASES}, {_ROUNDED}, {_CURVE} SELECT split, round((sum((n - p) * (pg - p + p / 2.0::DOUBLE)) / max(pa::DOUBLE * (na - pa)))::DOUBLE, 6) AS roc_auc, round(sum(p::DOUBLE / pa * pg / ng), 6) AS pr_auc, (SELECT round(avg((least(1, greatest(0, s)) - label) ** 2), 6) FROM r WHERE r.split = c.split) AS brier FROM c GROUP BY split")
def ranking(spark, d):
    df = A.cases(spark, d).withColumn("s", C.rounded(F.col("score"), 2))
    return r6(metrics.ranking_metrics(df, "label", "s", ["split"]))


@query("g05_recall_at_precision", f"WITH {CASES}, {_ROUNDED}, {_CURVE} SELECT split, round(coalesce(max(pg::DOUBLE / pa) FILTER (pg::DOUBLE / ng >= 0.33), 0.0), 6) AS recall FROM c GROUP BY split")
def recall_at_precision(spark, d):
    df = A.cases(spark, d).withColumn("s", C.rounded(F.col("score"), 2))
    return r6(metrics.recall_at_precision(df, "label", "s", 0.33, ["split"]))


_RANKED = "k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY s DESC, case_id) AS rd, row_number() OVER (PARTITION BY split ORDER BY s, case_id) AS ra, count(*) OVER (PARTITION BY split) AS na FROM r)"


@query("g06_precision_at_top", f"WITH {CASES}, {_ROUNDED}, {_RANKED} SELECT split, count(*) AS k, round(avg(label), 6) AS precision FROM k WHERE rd <= greatest(1, round_even(0.1 * na, 0)) GROUP BY split")
def precision_at_top(spark, d):
    df = A.cases(spark, d).withColumn("s", C.rounded(F.col("score"), 2))
    return r6(metrics.precision_at_top(df, "case_id", "label", "s", 0.1, ["split"]))


@query("g07_cost_threshold", f"""WITH {CASES}, s AS (SELECT split, label, round(score, 2)::DOUBLE AS s FROM cases), q AS (SELECT DISTINCT split, t FROM (SELECT split, unnest(quantile_cont(s, [i / 400.0::DOUBLE FOR i IN range(0, 401)])) AS t FROM s GROUP BY split UNION ALL SELECT DISTINCT split, 1 + 1e-9 FROM s)),
 x AS (SELECT q.split, t, 10 * (count(*) FILTER (s < t AND label = 1)) + count(*) FILTER (s >= t AND label = 0) AS cost FROM q JOIN s ON s.split = q.split GROUP BY 1, 2) SELECT split, round(t, 6) AS threshold, cost::BIGINT AS cost, round(1 / 11.0::DOUBLE, 6) AS bayes FROM x QUALIFY row_number() OVER (PARTITION BY split ORDER BY x.cost, t DESC) = 1""")
def cost_threshold(spark, d):
    df = A.cases(spark, d).withColumn("s", C.rounded(F.col("score"), 2))
    return r6(metrics.cost_threshold(df, "label", "s", 10, by=["split"]).withColumn("cost", F.col("cost").cast("long")))


@query("g08_capacity_threshold", f"WITH {CASES} SELECT split, round(quantile_cont(score::DOUBLE, 0.9), 6) AS threshold FROM cases GROUP BY split")
def capacity(spark, d):
    return r6(metrics.capacity_threshold(A.cases(spark, d).withColumn("score", F.col("score").cast("double")), "score", 0.1, ["split"]))


_LO, _HI = wilson("p", "n")


@query("g09_reliability", f"WITH {CASES}, {_ROUNDED}, {_RANKED}, g AS (SELECT split, (greatest(ceil((ra - 1) * 10 / (na - 1)::DOUBLE), 1) - 1)::BIGINT AS bin, count(*) AS n, avg(s) AS m, sum(label)::BIGINT AS p FROM k GROUP BY 1, 2) SELECT split, bin, n, round(m, 6) AS mean_score, round(p::DOUBLE / n, 6) AS observed, round({_LO}, 6) AS ci_low, round({_HI}, 6) AS ci_high FROM g")
def reliability(spark, d):
    df = A.cases(spark, d).withColumn("s", C.rounded(F.col("score"), 2))
    return r6(metrics.reliability_table(df, "case_id", "label", "s", 10, ["split"]))


@query("g10_lift", f"WITH {CASES}, {_ROUNDED}, {_RANKED}, g AS (SELECT split, (floor((rd - 1) * 10 / na::DOUBLE) + 1)::BIGINT AS decile, count(*) AS n, sum(label)::BIGINT AS p, min(s) AS m FROM k GROUP BY 1, 2), t AS (SELECT split, sum(n) AS tn, sum(p) AS tp FROM g GROUP BY 1) SELECT g.split, decile, n, p AS positives, m AS min_score, round(p::DOUBLE / n, 6) AS rate, round((p::DOUBLE / n / (tp::DOUBLE / tn::DOUBLE))::DOUBLE, 6) AS lift, round((sum(p) OVER (PARTITION BY g.split ORDER BY decile))::DOUBLE / tp::DOUBLE, 6) AS cum_recall FROM g JOIN t ON t.split = g.split")
def lift(spark, d):
    df = A.cases(spark, d).withColumn("s", C.rounded(F.col("score"), 2))
    return r6(metrics.lift_table(df, "case_id", "label", "s", ["split"]))


_SEG = f"SELECT attribute, value, tp + fp + fn + tn AS n, tp + fn AS positives, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, 6) AS recall, round({ratio('tp', 'tp + fp')}, 6) AS precision, round({ratio('fp', 'fp + tn')}, 6) AS fpr, round((tp + fp)::DOUBLE / (tp + fp + fn + tn), 6) AS flag_rate FROM g"
_SEGG = f"g AS (SELECT attribute, value, {_CM} FROM (SELECT 'priority' AS attribute, priority AS value, label, score FROM cases UNION ALL SELECT 'nation', nation, label, score FROM cases) GROUP BY 1, 2)"


@query("g12_group_metrics", f"WITH {CASES}, {_SEGG} {_SEG}")
def group_metrics(spark, d):
    return r6(metrics.group_metrics(A.cases(spark, d), ["priority", "nation"], "label", "score", T))


@query("g18_worst_segments", f"WITH {CASES}, {_SEGG} SELECT attribute, value, round(tp::DOUBLE / (tp + fn), 6) AS recall FROM g WHERE tp + fp + fn + tn >= 50 AND tp + fn > 0 ORDER BY tp::DOUBLE / (tp + fn), attribute, value LIMIT 8")
def worst(spark, d):
    low, _ = metrics.worst_segments(metrics.group_metrics(A.cases(spark, d), ["priority", "nation"], "label", "score", T))
    return r6(low.select("attribute", "value", "recall"))


def _numbered(seed: str, table: str, key: str, strata: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {_H.format(s=seed, k=key)}, {key}) AS _row, count(*) OVER (PARTITION BY {strata}) AS _size FROM {table}"


_DRAWS = f"""n AS ({_numbered('s', 'cases', 'case_id', 'split, label')}),
 dr AS (SELECT split, label, rep, floor(('0x' || substr(md5('b:' || rep || ':' || label || ':' || _row), 1, 8))::BIGINT / 4294967296.0::DOUBLE * _size) + 1 AS _row FROM n, range(1, 21) x(rep)),
 bs AS (SELECT dr.rep, n.* FROM dr JOIN n ON n.split = dr.split AND n.label = dr.label AND n._row = dr._row)"""


@query("g13_bootstrap_ci", f"""WITH {CASES}, {_DRAWS}, m AS (SELECT split, rep, count(*) FILTER (score >= {T} AND label = 1) AS tp, count(*) FILTER (score >= {T} AND label = 0) AS fp, count(*) FILTER (score < {T} AND label = 1) AS fn FROM bs GROUP BY 1, 2),
 q AS (SELECT split, {ratio('tp', 'tp + fn')} AS r, {ratio('tp', 'tp + fp')} AS p FROM m) SELECT split, round(quantile_cont(r, 0.025), 6) AS recall_low, round(quantile_cont(r, 0.975), 6) AS recall_high, round(quantile_cont(p, 0.025), 6) AS precision_low, round(quantile_cont(p, 0.975), 6) AS precision_high FROM q GROUP BY split""")
def bootstrap(spark, d):
    return r6(metrics.bootstrap_rate_ci(A.cases(spark, d), "case_id", "label", "score", T, 20, by=["split"]))


@query("g14_paired_bootstrap", f"""WITH {CASES}, {_DRAWS}, m AS (SELECT split, rep, avg((1 - score >= {T})::INT) - avg((score >= {T})::INT) AS d FROM bs WHERE label = 1 GROUP BY 1, 2)
 SELECT split, round(avg(d), 6) AS mean_diff, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM m GROUP BY split""")
def paired(spark, d):
    df = A.cases(spark, d).withColumn("other", 1 - F.col("score"))
    return r6(metrics.paired_bootstrap(df, "case_id", "label", "score", "other", T, 20, by=["split"]))


_CI_RATES = {"accuracy": ratio("tp + tn", "tp + fp + fn + tn"), "precision": "p", "recall": "r", "f1": ratio("2 * p * r", "p + r"), "f2": ratio("5 * p * r", "4 * p + r"), "fpr": ratio("fp", "fp + tn"), "flag_rate": ratio("tp + fp", "tp + fp + fn + tn")}
_CI_ROWS = " UNION ALL ".join([f"SELECT split, rep, '{k}' AS metric, {v} AS x FROM u" for k, v in _CI_RATES.items()] + [f"SELECT split, rep, '{k}', {k} FROM z" for k in ("roc_auc", "pr_auc", "brier")])


@query("g15_metrics_with_ci", f"""WITH {CASES}, {_DRAWS}, a AS (SELECT split, label, round(score, 2)::DOUBLE AS s, score, rep FROM bs UNION ALL SELECT split, label, round(score, 2)::DOUBLE, score, 0 FROM cases),
 g AS (SELECT split, rep, {_CM.replace('score', 's')} FROM a GROUP BY 1, 2), u AS (SELECT *, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS r FROM g),
 d AS (SELECT split, rep, s, count(*) AS n, sum(label) AS p FROM a GROUP BY 1, 2, 3), c AS (SELECT *, sum(n) OVER w AS ng, sum(p) OVER w AS pg, sum(n) OVER v AS na, sum(p) OVER v AS pa FROM d WINDOW w AS (PARTITION BY split, rep ORDER BY s DESC), v AS (PARTITION BY split, rep)),
 z AS (SELECT c.split, c.rep, (sum((n - p) * (pg - p + p / 2.0::DOUBLE)) / max(pa::DOUBLE * (na - pa)))::DOUBLE AS roc_auc, sum(p::DOUBLE / pa * pg / ng) AS pr_auc, (SELECT avg((least(1, greatest(0, s)) - label) ** 2) FROM a WHERE a.split = c.split AND a.rep = c.rep) AS brier FROM c GROUP BY 1, 2),
 l AS ({_CI_ROWS}) SELECT split, metric, round(max(x) FILTER (rep = 0), 6) AS value, round(quantile_cont(x, 0.025) FILTER (rep > 0), 6) AS low, round(quantile_cont(x, 0.975) FILTER (rep > 0), 6) AS high FROM l GROUP BY 1, 2""")
def with_intervals(spark, d):
    df = A.cases(spark, d).withColumn("s", C.rounded(F.col("score"), 2))
    return r6(metrics.metrics_with_ci(df, "case_id", "label", "s", T, 20, by=["split"]))


@query("g17_success_criterion", f"""WITH {CASES}, {_DRAWS}, m AS (SELECT split, rep, count(*) FILTER (score >= {T} AND label = 1) AS tp, count(*) FILTER (score >= {T} AND label = 0) AS fp, count(*) FILTER (score < {T} AND label = 1) AS fn FROM bs GROUP BY 1, 2),
 q AS (SELECT split, quantile_cont({ratio('tp', 'tp + fn')}, 0.025) AS r, quantile_cont({ratio('tp', 'tp + fp')}, 0.025) AS p FROM m GROUP BY split), b AS (SELECT split, avg(label) AS base, avg((score >= {T})::INT) AS flag FROM cases GROUP BY split)
 SELECT split, p > 1.05 * base AS precision_ok, r > 1.05 * flag AS recall_ok, p > 1.05 * base AND r > 1.05 * flag AS success FROM q JOIN b USING (split)""")
def success(spark, d):
    c = A.cases(spark, d)
    base = c.groupBy("split").agg(F.avg("label").alias("base_rate"), F.avg((F.col("score") >= T).cast("int")).alias("flag_rate"))
    return metrics.success_criterion(metrics.bootstrap_rate_ci(c, "case_id", "label", "score", T, 20, by=["split"]), base, "flag_rate", ["split"], 1.05)


@query("g16_comparison", f"WITH {CASES}, l AS (SELECT 'score' AS model, label, score::DOUBLE AS p FROM cases UNION ALL SELECT 'lines', label, coalesce(n_lines, 0)::DOUBLE FROM cases), t AS (SELECT model, quantile_cont(p, 0.8) AS t FROM l GROUP BY 1), g AS (SELECT l.model, count(*) FILTER (p >= t AND label = 1) AS tp, count(*) FILTER (p >= t AND label = 0) AS fp, count(*) FILTER (p < t AND label = 1) AS fn, count(*) FILTER (p < t AND label = 0) AS tn FROM l JOIN t ON t.model = l.model GROUP BY 1) {_metrics_sql('model', 'g')}")
def comparison(spark, d):
    df = A.cases(spark, d).withColumn("lines", F.coalesce("n_lines", F.lit(0)))
    return r6(metrics.comparison(df, "label", ["score", "lines"], 0.2))


# --- training data and scores --------------------------------------------------------------


@query("h01_training_data", f"WITH {CASES}, n AS ({_numbered('s', '(SELECT * FROM cases WHERE split = ' + chr(39) + 'synthetic' + chr(39) + ')', 'case_id', 'split')}) SELECT case_id, 1.0::DOUBLE AS weight FROM cases WHERE split = 'real_train' UNION ALL SELECT case_id, 0.3::DOUBLE FROM n WHERE _row <= floor(0.25 * _size)")
def training_data(spark, d):
    return model.training_data(A.cases(spark, d), "case_id", "split", 0.25, 0.3).select("case_id", "weight")


@query("h02_class_weight", f"WITH {CASES} SELECT (sum(n_lines) FILTER (label = 1))::BIGINT AS positive, (sum(n_lines) FILTER (label = 0))::BIGINT AS negative, round((sum(n_lines) FILTER (label = 0))::DOUBLE / (sum(n_lines) FILTER (label = 1))::DOUBLE, 6) AS ratio FROM cases")
def class_weight(spark, d):
    return r6(model.class_weight(A.cases(spark, d), "label", "n_lines"))


@query("h04_families")
def families(spark, d):
    df = A.cases(spark, d).withColumn("amount", F.col("amount").cast("double"))
    return model.compare_families(df.where("split = 'real_train'"), df.where("split = 'real_validation'"), ["priority", "segment"], ["amount"], "label", "case_id", ("logistic", "forest", "boosted"))


@query("h10_calibrate")
def calibrate(spark, d):
    df = A.cases(spark, d).where("split = 'real_validation'").withColumn("p", F.col("score").cast("double"))
    out, best = model.calibrate(df.select("case_id", "label", "p"), "case_id", "label", "p", 3)
    return out.withColumn("kind", F.lit(best))


_POINTS = ([0.0, 0.1, 0.25, 0.6, 0.95], [0.02, 0.05, 0.3, 0.55, 0.9])
_STEPS_SQL = " ".join(f"WHEN s <= {b!r} THEN {c!r}::DOUBLE + ({d!r}::DOUBLE - {c!r}::DOUBLE) * (s - {a!r}::DOUBLE) / ({b!r}::DOUBLE - {a!r}::DOUBLE)" for a, b, c, d in zip(_POINTS[0], _POINTS[0][1:], _POINTS[1], _POINTS[1][1:]))


@query("h10_apply", f"WITH {CASES}, p AS (SELECT *, CASE WHEN case_id % 9 > 0 THEN score::DOUBLE END AS s FROM cases), c AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN s <= 0.0 THEN 0.02 {_STEPS_SQL} ELSE 0.9 END AS c FROM p) SELECT split, count(c) AS n, round(avg(c), 6) AS mean, round(max(c), 6) AS highest, round(avg((c - label) ** 2), 6) AS brier, round(avg((s - label) ** 2), 6) AS uncalibrated FROM c GROUP BY 1")
def apply_calibration(spark, d):
    c = A.cases(spark, d).withColumn("s", F.when(F.col("case_id") % 9 > 0, F.col("score").cast("double")))
    out = model.apply_calibrator(c, "s", model.break_points(spark, *_POINTS))
    square = lambda p: F.avg(F.pow(F.col(p) - F.col("label"), F.lit(2.0)))
    return r6(out.groupBy("split").agg(F.count("calibrated").alias("n"), F.avg("calibrated").alias("mean"), F.max("calibrated").alias("highest"), square("calibrated").alias("brier"), square("s").alias("uncalibrated")))


@query("h10_platt", f"WITH {CASES}, l AS (SELECT *, greatest(0.000001, least(0.999999, score::DOUBLE)) AS q FROM cases), c AS (SELECT case_id, 1 / (1 + exp(-(1.5 * ln(q / (1 - q)) - 0.25))) AS c FROM l) SELECT case_id, round(c, 6) AS calibrated FROM c")
def apply_platt(spark, d):
    line = spark.createDataFrame([("platt", None, None, 1.5, -0.25)], "kind string, low double, high double, at_low double, at_high double")
    return r6(model.apply_calibrator(A.cases(spark, d).withColumn("s", F.col("score").cast("double")), "s", line).select("case_id", "calibrated"))


_P12 = "round(amount::DOUBLE / 300007, 6)"


@query("h12_score_claims", f"WITH {CASES} SELECT case_id, {_P12} AS fraud_probability, CASE WHEN {_P12} >= 0.6 THEN 'high' WHEN {_P12} >= 0.3 THEN 'medium' ELSE 'low' END AS risk_band, ({_P12} >= 0.6)::BIGINT AS predicted FROM cases")
def score_claims(spark, d):
    return model.score_claims(A.cases(spark, d).withColumn("p", F.col("amount").cast("double") / 300007), "p", 0.6, 0.6).select("case_id", "fraud_probability", "risk_band", "predicted")


def _adversarial(spark, d):
    df = A.cases(spark, d).withColumn("amount", F.col("amount").cast("double"))
    return model.adversarial_validation(df, "case_id", "split", "real_train", "synthetic", ["priority", "segment"], ["amount"], 2)


@query("h13_adversarial")
def adversarial(spark, d):
    # the surplus of the larger split is of one class and has no curve
    return metrics.ranking_metrics(_adversarial(spark, d).where("fold is not null"), "is_right", "p", ["fold"])


@query("h13_adversarial_rows")
def adversarial_rows(spark, d):
    return _adversarial(spark, d)


@query("h15_utility")
def utility(spark, d):
    df = A.cases(spark, d).withColumn("amount", F.col("amount").cast("double"))
    mixes = [("real", 0.0, 1.0, True), ("synthetic", 1.0, 1.0, False), ("mixed", 0.5, 0.3, True)]
    return model.utility_experiment(df, df.where("split = 'real_validation'"), mixes, "case_id", "split", "label", ["priority", "segment"], ["amount"])


@query("h07_data_mix")
def data_mix(spark, d):
    df = A.cases(spark, d).withColumn("amount", F.col("amount").cast("double"))
    mixes = [(0.0, 1.0, True), (1.0, 0.3, True), (1.0, 1.0, False)]
    return model.data_mix(df, df.where("split = 'real_validation'"), mixes, "case_id", "split", "label", ["priority", "segment"], ["amount"], "logistic")


@query("h13_importance")
def adversarial_importance(spark, d):
    df = A.cases(spark, d).withColumn("amount", F.col("amount").cast("double"))
    return model.adversarial_importance(df, "case_id", "split", "real_train", "synthetic", ["priority", "segment"], ["amount"], 2)


@query("h14_drop_top")
def drop_top(spark, d):
    df = A.cases(spark, d).withColumn("amount", F.col("amount").cast("double"))
    return model.adversarial_drop_top(df, "case_id", "split", "real_train", "synthetic", ["priority", "segment"], ["amount"], ["amount"], 1, 2)


@query("h16_utility_differences", f"""WITH {CASES}, {_DRAWS}, l AS (SELECT split, rep, 'score' AS mix, label, round(score, 2)::DOUBLE AS s FROM bs UNION ALL SELECT split, rep, 'lines', label, coalesce(n_lines, 0)::DOUBLE FROM bs),
 d AS (SELECT split, rep, mix, s, count(*) AS n, sum(label) AS p FROM l GROUP BY 1, 2, 3, 4), c AS (SELECT *, sum(n) OVER w AS ng, sum(p) OVER w AS pg, sum(p) OVER (PARTITION BY split, rep, mix) AS pa FROM d WINDOW w AS (PARTITION BY split, rep, mix ORDER BY s DESC)),
 z AS (SELECT split, rep, mix, sum(p::DOUBLE / pa * pg / ng) AS v FROM c GROUP BY 1, 2, 3) SELECT a.split, a.mix, round(avg(a.v - b.v), 6) AS mean_diff, round(quantile_cont(a.v - b.v, 0.025), 6) AS low, round(quantile_cont(a.v - b.v, 0.975), 6) AS high FROM z a JOIN z b USING (split, rep) WHERE a.mix = 'lines' AND b.mix = 'score' GROUP BY 1, 2""")
def differences(spark, d):
    c = A.cases(spark, d)
    p = {"score": C.rounded(F.col("score"), 2), "lines": F.coalesce("n_lines", F.lit(0)).cast("double")}
    long = c.select("split", "case_id", "label", F.explode(F.array(*[F.struct(F.lit(m).alias("mix"), x.alias("p")) for m, x in p.items()])).alias("m")).select("split", "case_id", "label", "m.*")
    return r6(model.utility_differences(long, "case_id", "label", "score", 20, by=["split"]))


_COEF = {"amount": 0.00001, "lines": -0.2, "delay": 0.001}
_CON = "x AS (SELECT case_id, amount::DOUBLE AS amount, coalesce(n_lines, 0)::DOUBLE AS lines, coalesce(date_diff('day', event_date, report_date), 0)::DOUBLE AS delay FROM cases), m AS (SELECT avg(amount) AS a, avg(lines) AS l, avg(delay) AS d FROM x), con AS (SELECT case_id, 'amount' AS label, (amount - a) * 0.00001 AS c FROM x, m UNION ALL SELECT case_id, 'timing', (lines - l) * -0.2 + (delay - d) * 0.001 FROM x, m)"


def _contributions(spark, d):
    df = A.cases(spark, d).select("case_id", F.col("amount").cast("double").alias("amount"), F.coalesce("n_lines", F.lit(0)).cast("double").alias("lines"), F.coalesce(F.datediff("report_date", "event_date"), F.lit(0)).cast("double").alias("delay"))
    return model.linear_contributions(df, "case_id", list(_COEF), _COEF)


@query("h18_top_contributions", f"WITH {CASES}, {_CON} SELECT case_id, label, round(c, 6) AS contribution, CASE WHEN c >= 0 THEN 'increases' ELSE 'decreases' END AS direction FROM con QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY abs(c) DESC, label) = 1")
def contributions(spark, d):
    return r6(model.top_contributions(_contributions(spark, d), "case_id", 1, {"lines": "timing", "delay": "timing"}).drop("rank"))


_SIGNED = f"{_CON}, s AS (SELECT case_id, label, c, row_number() OVER (PARTITION BY case_id, c > 0 ORDER BY abs(c) DESC, label) AS k FROM con WHERE c <> 0)"
_UP, _DOWN = (f"coalesce(string_agg(label, ',' ORDER BY k) FILTER (c {x} 0), '')" for x in "><")


@query("h18_reasons", f"WITH {CASES}, {_SIGNED} SELECT case_id, {_UP} AS increases, {_DOWN} AS decreases, concat_ws('; ', max(label) FILTER (c > 0 AND k = 1) || ' raises the score most', max(label) FILTER (c < 0 AND k = 1) || ' lowers it most') AS reason FROM s GROUP BY 1")
def reasons(spark, d):
    out = model.contribution_reasons(_contributions(spark, d), "case_id", 3, {"lines": "timing", "delay": "timing"})
    return out.select("case_id", F.array_join("increases", ",").alias("increases"), F.array_join("decreases", ",").alias("decreases"), "reason")


@query("h19_importance", f"WITH {CASES}, {_CON} SELECT 'amount' AS feature, round(avg(abs((amount - a) * 0.00001)), 6) AS importance FROM x, m UNION ALL SELECT 'lines', round(avg(abs((lines - l) * -0.2)), 6) FROM x, m UNION ALL SELECT 'delay', round(avg(abs((delay - d) * 0.001)), 6) FROM x, m")
def importance(spark, d):
    return r6(model.global_importance(_contributions(spark, d), "case_id"))


@query("h20_local_examples", f"WITH {CASES}, x AS (SELECT case_id, score, CASE WHEN score >= {T} AND label = 1 THEN 'TP' WHEN score >= {T} THEN 'FP' WHEN label = 1 THEN 'FN' END AS \"case\" FROM cases) SELECT \"case\", case_id, row_number() OVER (PARTITION BY \"case\" ORDER BY CASE WHEN \"case\" = 'FN' THEN score ELSE -score END, case_id) AS rank FROM x WHERE \"case\" IS NOT NULL QUALIFY rank <= 2")
def local_examples(spark, d):
    return model.local_examples(A.cases(spark, d), "case_id", "label", "score", T).select("case", "case_id", "rank")


@query("h20_explained", f"WITH {CASES}, {_SIGNED}, hx AS (SELECT case_id, score, CASE WHEN score >= {T} AND label = 1 THEN 'TP' WHEN score >= {T} THEN 'FP' WHEN label = 1 THEN 'FN' END AS \"case\" FROM cases), e AS (SELECT \"case\", case_id, row_number() OVER (PARTITION BY \"case\" ORDER BY CASE WHEN \"case\" = 'FN' THEN score ELSE -score END, case_id) AS rank FROM hx WHERE \"case\" IS NOT NULL QUALIFY rank <= 2) SELECT \"case\", e.case_id, rank, con.label AS factor, round(c, 6) AS contribution FROM e JOIN con ON con.case_id = e.case_id")
def explained_examples(spark, d):
    near = model.local_examples(A.cases(spark, d), "case_id", "label", "score", T).select("case", "case_id", F.col("rank").alias("place"))
    top = model.top_contributions(_contributions(spark, d).join(F.broadcast(near.select("case_id")), "case_id", "left_semi"), "case_id", 5, {"lines": "timing", "delay": "timing"})
    return r6(near.join(top, "case_id").select("case", "case_id", F.col("place").alias("rank"), F.col("label").alias("factor"), "contribution"))


# --- similarity ----------------------------------------------------------------------------


@query("f02_gower", f"WITH {CASES}, s AS (SELECT case_id, split, priority, segment, (amount - min(amount) OVER ()) / (max(amount) OVER () - min(amount) OVER ()) AS a FROM cases) SELECT q.case_id, round(min(((q.priority <> r.priority)::INT + (q.segment <> r.segment)::INT + abs(q.a - r.a)) / 3), 6) AS dcr FROM s q, s r WHERE q.case_id % 20 = 0 AND r.split = 'synthetic' GROUP BY 1")
def gower(spark, d):
    df = similar.scaled(A.cases(spark, d), ["amount"])
    return r6(similar.gower_dcr_grouped(df.where("case_id % 20 = 0"), df.where("split = 'synthetic'"), "case_id", ["priority", "segment"], "amount"))


@query("f04_max_matching", f"WITH {CASES} SELECT q.case_id, max((q.priority = r.priority)::INT + (q.segment = r.segment)::INT + (q.nation = r.nation)::INT + (q.n_lines IS NOT DISTINCT FROM r.n_lines)::INT) AS most FROM cases q, cases r WHERE q.case_id % 20 = 0 AND r.split = 'synthetic' GROUP BY 1")
def max_matching(spark, d):
    df = A.cases(spark, d)
    return similar.max_matching(df.where("case_id % 20 = 0"), df.where("split = 'synthetic'"), "case_id", ["priority", "segment", "nation", "n_lines"])


# the two above search for the ids divisible by 20 (all real) among all synthetic rows, these for every synthetic row among the real ones
@query("f02_gower_all", f"WITH {CASES}, s AS (SELECT case_id, split, priority, segment, (amount - min(amount) OVER ()) / (max(amount) OVER () - min(amount) OVER ()) AS a FROM cases) SELECT q.case_id, round(min(((q.priority <> r.priority)::INT + (q.segment <> r.segment)::INT + abs(q.a - r.a)) / 3), 6) AS dcr FROM s q, s r WHERE q.split = 'synthetic' AND r.split = 'real_train' GROUP BY 1")
def gower_all(spark, d):
    df = similar.scaled(A.cases(spark, d), ["amount"])
    return r6(similar.gower_dcr_grouped(df.where("split = 'synthetic'"), df.where("split = 'real_train'"), "case_id", ["priority", "segment"], "amount"))


@query("f04_max_matching_all", f"WITH {CASES} SELECT q.case_id, max((q.priority = r.priority)::INT + (q.segment = r.segment)::INT + (q.nation = r.nation)::INT + (q.n_lines IS NOT DISTINCT FROM r.n_lines)::INT) AS most FROM cases q, cases r WHERE q.split = 'synthetic' AND r.split = 'real_train' GROUP BY 1")
def max_matching_all(spark, d):
    df = A.cases(spark, d)
    return similar.max_matching(df.where("split = 'synthetic'"), df.where("split = 'real_train'"), "case_id", ["priority", "segment", "nation", "n_lines"])


_BEST = "SELECT q.case_id, max((q.priority = r.priority)::INT + (q.segment = r.segment)::INT + (q.nation = r.nation)::INT + (q.n_lines IS NOT DISTINCT FROM r.n_lines)::INT) AS most FROM cases q, cases r WHERE q.split = 'synthetic' AND r.split = 'real_train' GROUP BY 1"


@query("f04_histogram", f"WITH {CASES}, b AS ({_BEST}), c AS (SELECT m.most, count(b.most) AS n FROM range(5) m(most) LEFT JOIN b ON b.most = m.most GROUP BY 1) SELECT most::INT AS most, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share, round((sum(n) OVER (ORDER BY most DESC))::DOUBLE / sum(n) OVER (), 6) AS at_least FROM c")
def matching_histogram(spark, d):
    return r6(similar.matching_histogram(max_matching_all(spark, d), 4))


_DCR = "SELECT q.case_id, min(((q.priority <> r.priority)::INT + (q.segment <> r.segment)::INT + abs(q.a - r.a)) / 3) AS dcr FROM s q, s r WHERE q.split = '{q}' AND r.split = 'real_train' GROUP BY 1"
_PAIRINGS = ("synthetic", "real_validation")


@query("f03_dcr_quantiles", f"WITH {CASES}, s AS (SELECT case_id, split, priority, segment, (amount - min(amount) OVER ()) / (max(amount) OVER () - min(amount) OVER ()) AS a FROM cases), x AS ({' UNION ALL '.join(f'SELECT {chr(39)}{q}{chr(39)} AS pairing, dcr::DOUBLE AS dcr FROM (' + _DCR.format(q=q) + ')' for q in _PAIRINGS)}) SELECT pairing, {', '.join(f'round(quantile_cont(dcr, {q}), 6) AS p{round(100 * q)}' for q in (0.01, 0.05, 0.25, 0.5))}, round(avg((dcr = 0)::INT), 6) AS zero_share FROM x GROUP BY 1")
def dcr_quantiles(spark, d):
    df = similar.scaled(A.cases(spark, d), ["amount"])
    parts = [similar.gower_dcr_grouped(df.where(F.col("split") == q), df.where("split = 'real_train'"), "case_id", ["priority", "segment"], "amount").withColumn("pairing", F.lit(q)) for q in _PAIRINGS]
    return r6(similar.dcr_quantiles(parts[0].unionByName(parts[1]), ["pairing"]))


@query("f04_matching_counts", "SELECT q.p_partkey, count(*) FILTER (q.p_partkey <> r.p_partkey AND (q.p_brand = r.p_brand)::INT + (q.p_type = r.p_type)::INT + (q.p_size = r.p_size)::INT >= 2) AS n FROM part q, part r GROUP BY 1")
def matching_counts(spark, d):
    p = A.read(spark, d, "part")
    return similar.matching_counts(p, p, "p_partkey", ["p_brand", "p_type", "p_size"], 1)


@query("f06_similar", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), n AS (SELECT vec_id, label, [x / sqrt(list_sum([y * y FOR y IN e])) FOR x IN e] AS u FROM v) SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_dot_product(q.u, r.u), 4) AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, r.u) DESC, r.vec_id) AS rank FROM n q JOIN n r ON q.vec_id <> r.vec_id AND q.label = r.label WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5")
def similar_vectors(spark, d):
    v = A.read(spark, d, "embeddings")
    return similar.similar_claims(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5, "label")


@query("f08_neighbour_summary", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), n AS (SELECT vec_id, label, [x / sqrt(list_sum([y * y FOR y IN e])) FOR x IN e] AS u FROM v), t AS (SELECT q.vec_id AS query, (r.label = 3)::INT AS y FROM n q JOIN n r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, r.u) DESC, r.vec_id) <= 10) SELECT query, count(*) AS k, sum(y)::BIGINT AS frauds, round(sum(y)::DOUBLE / count(*), 3) AS rate, 0.1::DOUBLE AS base_rate FROM t GROUP BY 1")
def neighbours(spark, d):
    v = A.read(spark, d, "embeddings").withColumn("y", (F.col("label") == 3).cast("int"))
    near = similar.similar_claims(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 10)
    return similar.neighbour_summary(near, v, "vec_id", "y", 0.1)


_NEAR10 = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), n AS (SELECT vec_id, label, vec_id % 3 AS third, [x / sqrt(list_sum([y * y FOR y IN e])) FOR x IN e] AS u FROM v), t AS (SELECT q.vec_id AS query, q.label AS ql, q.third AS qt, r.label, r.third FROM n q JOIN n r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u, r.u) DESC, r.vec_id) <= 10)"


@query("f08_differing_fields", f"WITH {_NEAR10}, l AS (SELECT query, 'label' AS field, ql::VARCHAR AS own, label::VARCHAR AS value FROM t UNION ALL SELECT query, 'third', qt::VARCHAR, third::VARCHAR FROM t), g AS (SELECT query, field, own, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY query, field) AS total FROM l GROUP BY 1, 2, 3, 4), m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY query, field ORDER BY n DESC, value) = 1) SELECT query, field, own, value, n FROM m WHERE n >= floor((total + 1) / 2) AND value <> own")
def differing(spark, d):
    v = A.read(spark, d, "embeddings").withColumn("third", F.col("vec_id") % 3)
    q = v.where("vec_id % 20 = 0")
    return similar.differing_fields(similar.similar_claims(q, v, "vec_id", "embedding", 10), q, v, "vec_id", ["label", "third"])

@query("f08_shared_fields", f"WITH {_NEAR10}, g AS (SELECT query, bool_and(label IS NOT DISTINCT FROM ql) AS l, bool_and(third IS NOT DISTINCT FROM qt) AS t FROM t GROUP BY 1) SELECT query, concat_ws(',', CASE WHEN l THEN 'label' END, CASE WHEN t THEN 'third' END) AS shared FROM g")
def shared_by_all(spark, d):
    v = A.read(spark, d, "embeddings").withColumn("third", F.col("vec_id") % 3)
    q = v.where("vec_id % 20 = 0")
    return similar.shared_fields(similar.similar_claims(q, v, "vec_id", "embedding", 10), q, v, "vec_id", ["label", "third"])



# --- policies and history ------------------------------------------------------------------


@query("i01_policy_in_force", f"WITH {CASES}, v AS (SELECT DISTINCT o_custkey AS e, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) < 2001), m AS (SELECT e, count(*) AS many, max(y) AS solo FROM v GROUP BY 1) SELECT case_id, CASE WHEN m.many = 1 THEN 'v' || m.solo WHEN v.y IS NOT NULL THEN 'v' || v.y END AS version, CASE WHEN m.many IS NULL THEN 'no policy' WHEN m.many = 1 THEN 'only version' WHEN v.y IS NULL THEN 'no version in force' ELSE 'in force' END AS reason FROM cases LEFT JOIN m ON m.e = entity_id LEFT JOIN v ON v.e = entity_id AND v.y = year(event_date)")
def in_force(spark, d):
    o = A.read(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), F.year("o_orderdate").alias("y")).where("y < 2001").distinct()
    v = o.groupBy("entity_id").agg(F.array_sort(F.collect_list("y")).alias("ys"))
    made = F.transform("ys", lambda y: F.struct(F.concat(F.lit("v"), y.cast("string")).alias("version"), F.make_date(y, F.lit(1), F.lit(1)).alias("effective_from"), F.make_date(y, F.lit(12), F.lit(31)).alias("effective_to")))
    return policy.policy_in_force(A.cases(spark, d), v.select("entity_id", made.alias("versions")), "case_id", "entity_id", "event_date")


@query("i02_retrieve_policy", "SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unavailable' WHEN c_acctbal < 0 THEN 'partial' ELSE 'found' END AS status, CASE WHEN c_custkey IS NULL THEN 'limits,segment' WHEN c_acctbal < 0 THEN 'limits' ELSE '' END AS missing FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON c_custkey = o_custkey")
def retrieve(spark, d):
    p = A.read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("limits"), F.col("c_mktsegment").alias("segment"))
    out = policy.retrieve_policy(A.read(spark, d, "orders").select("o_orderkey", "o_custkey"), p, "o_custkey", ["limits", "segment"])
    return out.select("o_orderkey", "status", F.array_join("missing", ",").alias("missing"))


_CHECKS = """ck AS (SELECT case_id, 'C1' AS check_id, CASE WHEN lag IS NULL THEN 'UNKNOWN' WHEN lag <= 300 THEN 'PASS' ELSE 'FAIL' END AS result FROM x WHERE segment IN ('BUILDING', 'MACHINERY')
 UNION ALL SELECT case_id, 'C2', CASE WHEN priority IN ('1-URGENT') THEN 'FAIL' ELSE 'PASS' END FROM x WHERE segment = 'BUILDING' UNION ALL SELECT case_id, 'C3', 'UNKNOWN' FROM x WHERE segment = 'BUILDING')"""
_LAGX = "x AS (SELECT *, date_diff('day', event_date, report_date) AS lag FROM cases)"


def _checks(spark, d):
    clauses = spark.createDataFrame(
        [("C1", "BUILDING", ("reporting_within_days", 300, None, None)), ("C1", "MACHINERY", ("reporting_within_days", 300, None, None)), ("C2", "BUILDING", ("field_not_in", None, "priority", ["1-URGENT"])), ("C3", "BUILDING", ("something", None, None, None)), ("C4", "BUILDING", None)],
        "clause_id string, base_policy string, test struct<type:string,days:int,field:string,values:array<string>>",
    )
    df = A.cases(spark, d).withColumn("lag_days", F.datediff("report_date", "event_date"))
    return policy.clause_checks(df, clauses, "case_id", "segment", ["priority"])


@query("i08_clause_checks", f"WITH {CASES}, {_LAGX}, {_CHECKS} SELECT * FROM ck")
def clause_checks(spark, d):
    return _checks(spark, d)


@query("i09_verification_summary", f"WITH {CASES}, {_LAGX}, {_CHECKS} SELECT case_id, count(*) FILTER (result = 'PASS') AS n_pass, count(*) FILTER (result = 'FAIL') AS n_fail, count(*) FILTER (result = 'UNKNOWN') AS n_unknown, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (result = 'FAIL'), '') AS failed, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (result = 'UNKNOWN'), '') AS unknown, CASE WHEN bool_or(result = 'FAIL') THEN 'FAIL' WHEN bool_or(result = 'UNKNOWN') THEN 'UNKNOWN' ELSE 'PASS' END AS overall FROM ck GROUP BY 1")
def verification(spark, d):
    return policy.verification_summary(_checks(spark, d), "case_id")


@query("i10_clause_report", f"WITH {CASES}, {_LAGX}, {_CHECKS} SELECT check_id, count(*) FILTER (result = 'PASS') AS n_pass, count(*) FILTER (result = 'FAIL') AS n_fail, count(*) FILTER (result = 'UNKNOWN') AS n_unknown, round(100 * avg((result = 'FAIL')::INT), 6) AS fail_pct, round(avg(label) FILTER (result = 'FAIL'), 6) AS fail_rate FROM ck JOIN cases USING (case_id) GROUP BY 1")
def clause_report(spark, d):
    return r6(policy.clause_report(_checks(spark, d), A.cases(spark, d), "case_id", "label"))


@query("i11_claim_history", f"WITH {CASES} SELECT c.case_id, count(h.case_id) AS n_previous, coalesce(string_agg(h.case_id::VARCHAR, ',' ORDER BY h.event_date, h.case_id), '') AS previous, 'available' AS status FROM cases c LEFT JOIN cases h ON h.entity_id = c.entity_id AND h.case_id <> c.case_id AND h.event_date < c.event_date AND h.event_date >= c.event_date - 365 GROUP BY c.case_id")
def history(spark, d):
    c = A.cases(spark, d)
    return policy.claim_history(c, c, "case_id", "entity_id", "event_date", "case_id", "event_date", 1.0)


@query("i12_contradiction", f"WITH {CASES}, n AS (SELECT c.case_id, count(h.case_id) AS n FROM cases c LEFT JOIN cases h ON h.entity_id = c.entity_id AND h.case_id <> c.case_id AND h.event_date < c.event_date AND h.event_date >= c.event_date - 365 GROUP BY 1) SELECT CASE case_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN '1' WHEN 2 THEN '2 to 4' ELSE 'more than 4' END AS bin, count(*) FILTER (n > CASE case_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 999 END) AS contradicted FROM n GROUP BY 1")
def contradiction(spark, d):
    k = F.col("case_id") % 4
    h = history(spark, d).withColumn("bin", F.when(k == 0, "none").when(k == 1, "1").when(k == 2, "2 to 4").otherwise("more than 4"))
    return h.groupBy("bin").agg(F.count_if(policy.history_contradiction(F.col("n_previous"), F.col("bin"))).alias("contradicted"))


@query("i13_policy_term", f"WITH {CASES}, i AS (SELECT entity_id, min(event_date) AS inc FROM cases GROUP BY 1), y AS (SELECT case_id, event_date AS e, inc, year(event_date) - year(inc) - CASE WHEN inc + to_years((year(event_date) - year(inc))::INT) > event_date THEN 1 ELSE 0 END AS k FROM cases JOIN i USING (entity_id)) SELECT case_id, (inc + to_years(k::INT))::DATE AS term_from, ((inc + to_years((k + 1)::INT))::DATE - 1)::DATE AS term_to FROM y")
def term(spark, d):
    c = A.cases(spark, d)
    inc = c.groupBy("entity_id").agg(F.min("event_date").alias("inc"))
    start, end = policy.policy_term(F.col("inc"), F.col("event_date"))
    return c.join(inc, "entity_id").select("case_id", start.alias("term_from"), end.alias("term_to"))


# --- triage --------------------------------------------------------------------------------


def _evidence(spark, d):
    c = A.cases(spark, d)
    k = F.col("case_id")
    return c.select(
        "case_id", "label", "split", k.cast("int").alias("k_"), (k % 50 == 0).alias("blocking"), F.when(k % 41 != 0, model.risk_bands(F.col("score").cast("double"), 0.6, 0.3)).alias("risk_band"), F.col("score").cast("double").alias("fraud_probability"),
        (k % 3 == 0).cast("long").alias("warning_flags"), (k % 29 == 0).cast("long").alias("record_fails"), (k % 7 == 0).cast("long").alias("policy_fails"), (k % 2).alias("unknown_checks"), F.lit(10).cast("long").alias("k"), (k % 5).alias("frauds"), ((k % 5) / 10).alias("neighbour_rate"), F.lit(0.1).alias("base_rate"),
        F.when(k % 4 == 0, "unavailable").otherwise("available").alias("history_status"), (k % 37 == 0).alias("history_contradiction"), (k % 6 == 0).alias("strong_driver"), (k % 31 == 0).cast("long").alias("tools_failed"), F.lit(False).alias("simulated"),
    )


_EV = "ev AS (SELECT case_id, label, split, case_id % 50 = 0 AS blk, CASE WHEN case_id % 41 <> 0 THEN CASE WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END END AS band, case_id % 3 = 0 AS wf, case_id % 29 = 0 AS rf, case_id % 7 = 0 AS pf, case_id % 5 AS fr, case_id % 37 = 0 AS hc, case_id % 31 = 0 AS tf, case_id % 2 = 1 AS uk, case_id % 4 = 0 AS hu, case_id % 6 = 0 AS sd FROM cases)"
_CAT = "CASE WHEN blk OR rf THEN NULL WHEN band IS NULL THEN 'SYSTEM_FAILURE' WHEN band = 'high' THEN 'FRAUD_RISK' WHEN pf THEN 'POLICY_CONDITION' WHEN tf THEN 'SYSTEM_FAILURE' END"
_DEC = f"dc AS (SELECT *, {_CAT} AS cat, CASE WHEN blk OR rf THEN 'REQUEST_MORE_INFORMATION' WHEN {_CAT} IS NOT NULL THEN 'FLAG_FOR_INVESTIGATION' ELSE 'APPROVE' END AS dec, CASE WHEN blk THEN 'REQUEST_MORE_INFORMATION' WHEN band IS NULL OR band = 'high' THEN 'FLAG_FOR_INVESTIGATION' ELSE 'APPROVE' END AS mo FROM ev)"
_CONF = "((band = 'high' AND fr <= 1) OR (band = 'low' AND fr >= 4) OR (band = 'low' AND wf) OR (band IN ('low', 'medium') AND pf) OR hc)"


def _codes_sql():
    el = "(fr >= 2)"
    parts = [("blk", "BLOCKING_VALIDATION"), ("band = 'high'", "HIGH_MODEL_RISK"), ("band = 'medium'", "MEDIUM_MODEL_RISK"), ("band = 'low'", "LOW_MODEL_RISK"), ("band IS NOT NULL AND wf", "RED_FLAGS_PRESENT"), ("band IS NULL", "MODEL_SCORE_UNAVAILABLE"), ("rf", "CLAIM_RECORD_CONTRADICTION"), ("pf", "POLICY_CONDITION_FAILED"), ("uk", "POLICY_TERMS_UNVERIFIED"), (el, "SIMILAR_CLAIMS_ELEVATED_FRAUD"), ("fr = 0", "SIMILAR_CLAIMS_NO_FRAUD"), ("band IN ('medium', 'high') AND sd", "STRONG_SHAP_DRIVER"), ("hu", "CLAIM_HISTORY_UNAVAILABLE"), ("hc", "HISTORY_CONTRADICTION"), (_CONF, "CONFLICTING_EVIDENCE"), ("tf", "TOOL_FAILURE"), ("NOT blk AND (tf OR band IS NULL)", "INCOMPLETE_INVESTIGATION"), (f"dec = 'APPROVE' AND band = 'low' AND NOT (wf OR pf OR {el} OR hc OR tf OR rf OR coalesce({_CONF}, false))", "NO_MATERIAL_CONCERNS")]
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in parts) + "], lambda x: x IS NOT NULL), ',')"


@query("j08_decide", f"WITH {CASES}, {_EV}, {_DEC} SELECT case_id, dec AS decision, cat AS category, mo AS model_only FROM dc")
def decide(spark, d):
    e = _evidence(spark, d)
    return triage.decide(e).select("case_id", "decision", "category").join(triage.model_only(e).select("case_id", F.col("decision").alias("model_only")), "case_id")


@query("j13_triage", f"WITH {CASES}, {_EV}, {_DEC} SELECT case_id, dec AS decision, cat AS flag_category, {_codes_sql()} AS reason_codes, CASE WHEN blk THEN 'blocked' WHEN tf OR band IS NULL THEN 'incomplete' ELSE 'complete' END AS investigation_status, round((3 + (band IS NOT NULL)::INT + (NOT hu)::INT) / 5.0::DOUBLE, 6) AS completeness FROM dc")
def triaged(spark, d):
    return r6(triage.triage(_evidence(spark, d), "case_id").select("case_id", "decision", "flag_category", "reason_codes", "investigation_status", "completeness"))


_PROPOSED = "CASE WHEN case_id % 11 = 0 THEN NULL WHEN case_id % 5 = 0 THEN 'flag' WHEN case_id % 5 = 1 THEN 'deny' WHEN case_id % 5 = 2 THEN 'more info' ELSE 'approve' END"
_FRAUD = "(band = 'high' OR hc OR (band = 'low' AND (wf OR fr >= 2)))"
_FLAGCAT = f"CASE WHEN band = 'high' THEN 'FRAUD_RISK' WHEN band IS NULL THEN 'SYSTEM_FAILURE' WHEN {_FRAUD} THEN 'FRAUD_RISK' WHEN pf THEN 'POLICY_CONDITION' WHEN tf THEN 'SYSTEM_FAILURE' ELSE 'FRAUD_RISK' END"
_BASELESS = f"((band = 'low' AND NOT (blk OR wf OR rf OR pf OR fr >= 2 OR hc OR tf OR coalesce({_CONF}, false))) OR (band = 'medium' AND NOT (pf OR rf OR hc)))"
_STEPS = [
    ("fallback", "x IS NULL", "dec", "cat"), ("allowed_decisions", "x NOT IN ('APPROVE', 'FLAG_FOR_INVESTIGATION', 'REQUEST_MORE_INFORMATION')", "dec", "cat"),
    ("blocking_validation", "blk AND x <> 'REQUEST_MORE_INFORMATION'", "'REQUEST_MORE_INFORMATION'", "NULL"), ("request_info_not_claim_level", "x = 'REQUEST_MORE_INFORMATION' AND NOT (blk OR rf)", "dec", "cat"),
    ("high_risk_not_approve", "x = 'APPROVE' AND band = 'high'", "'FLAG_FOR_INVESTIGATION'", "'FRAUD_RISK'"), ("approve_needs_score", "x = 'APPROVE' AND band IS NULL", "'FLAG_FOR_INVESTIGATION'", "'SYSTEM_FAILURE'"),
    ("approve_needs_consistent_claim", "x = 'APPROVE' AND rf", "'REQUEST_MORE_INFORMATION'", "NULL"), ("approve_needs_policy_pass", "x = 'APPROVE' AND pf", "'FLAG_FOR_INVESTIGATION'", "'POLICY_CONDITION'"),
    ("approve_needs_tools", "x = 'APPROVE' AND tf", "'FLAG_FOR_INVESTIGATION'", "'SYSTEM_FAILURE'"), ("", "x = 'FLAG_FOR_INVESTIGATION' AND y IS NULL", "x", _FLAGCAT),
    ("unsupported_fraud_flag", f"x = 'FLAG_FOR_INVESTIGATION' AND y = 'FRAUD_RISK' AND {_BASELESS}", "dec", "cat"),
]
_GUARDED = f"w0 AS (SELECT *, CASE {_PROPOSED} WHEN 'flag' THEN 'FLAG_FOR_INVESTIGATION' WHEN 'more info' THEN 'REQUEST_MORE_INFORMATION' WHEN 'approve' THEN 'APPROVE' WHEN 'deny' THEN 'DENY' END AS x, NULL::VARCHAR AS y, []::VARCHAR[] AS i FROM dc)"
for _n, (_name, _when, _x, _y) in enumerate(_STEPS):
    _hit = f"coalesce({_when}, false)"
    _GUARDED += f", w{_n + 1} AS (SELECT * REPLACE (CASE WHEN {_hit} THEN {_x} ELSE x END AS x, CASE WHEN {_hit} THEN {_y} ELSE y END AS y, CASE WHEN {_hit} AND '{_name}' <> '' THEN list_append(i, '{_name}') ELSE i END AS i) FROM w{_n})"


@query("j10_guardrails", f"WITH {CASES}, {_EV}, {_DEC}, {_GUARDED} SELECT case_id, x AS decision, CASE WHEN x = 'FLAG_FOR_INVESTIGATION' THEN y END AS category, array_to_string(i, '; ') AS interventions FROM w{len(_STEPS)}")
def guardrails(spark, d):
    k = F.col("case_id") % 5
    proposed = F.when(F.col("case_id") % 11 == 0, None).when(k == 0, "flag").when(k == 1, "deny").when(k == 2, "more info").otherwise("approve")
    e = _evidence(spark, d).withColumn("proposed", proposed)
    return triage.apply_guardrails(e).select("case_id", "decision", "category", F.array_join("interventions", "; ").alias("interventions"))


_SRC = "st AS (SELECT *, case_id % 50 = 0 AS blk, CASE case_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'partial' END AS a, CASE case_id % 3 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'completed' END AS b FROM cases), dn AS (SELECT *, coalesce(a IN ('completed', 'partial'), false)::INT + coalesce(b IN ('completed', 'unavailable'), false)::INT AS k FROM st)"


@query("j04_sources", f"WITH {CASES}, {_SRC} SELECT case_id, round(k / 2.0::DOUBLE, 3) AS fraction, CASE WHEN blk THEN 'blocked' WHEN k < 2 THEN 'incomplete' ELSE 'complete' END AS investigation_status, concat_ws('; ', CASE WHEN a IS NULL THEN 'fraud_score was not run' END, CASE WHEN b IS NULL THEN 'history was not run' END, CASE WHEN a = 'failed' THEN 'fraud_score failed' END) AS gaps FROM dn")
def sources(spark, d):
    k = F.col("case_id")
    a = F.when(k % 4 == 0, "completed").when(k % 4 == 1, "failed").when(k % 4 == 2, "partial")
    b = F.when(k % 3 == 0, "unavailable").when(k % 3 == 1, "completed")
    both = F.map_filter(F.create_map(F.lit("fraud_score"), a, F.lit("history"), b), lambda _, v: v.isNotNull())
    out = triage.source_summary(A.cases(spark, d).select("case_id", both.alias("statuses"), (k % 50 == 0).alias("blocking")), "statuses", ["fraud_score", "history"], "blocking")
    return out.select("case_id", "fraction", "investigation_status", F.array_join("gaps", "; ").alias("gaps"))


@query("j01_tool_status", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not_run' WHEN event_id % 5 = 1 THEN 'failed' WHEN event_id % 3 = 0 THEN 'completed' WHEN event_id % 3 = 1 THEN 'completed' ELSE 'partial' END AS status FROM events")
def tool_status(spark, d):
    k = F.col("event_id")
    said = F.when(k % 3 == 0, "found").when(k % 3 == 2, "partial")
    return A.read(spark, d, "events").select("event_id", triage.tool_status(F.when(k % 5 > 0, k % 5 > 1), said).alias("status"))


@query("j12_label_simulated", f"WITH {CASES} SELECT case_id, CASE WHEN case_id % 2 = 0 THEN nation || ' of ' || segment || ' (simulated reference data)' ELSE nation || ' of ' || segment END AS fact FROM cases")
def labelled(spark, d):
    c = A.cases(spark, d)
    return c.select("case_id", triage.label_simulated(F.concat_ws(" of ", "nation", "segment"), F.col("case_id") % 2 == 0).alias("fact"))


# what each fact states: its text, and in SQL the value and decimals that it must find, by case_id % 10
_RATE = "round(score::DOUBLE, 4)::DECIMAL(6, 4)"
_STATED = [
    ("coalesce(n_lines, 0)::DOUBLE", 0), ("NULL::DOUBLE", 0), ("NULL::DOUBLE", 0), ("(coalesce(n_lines, 0) + 900)::DOUBLE", 0), ("round(score::DOUBLE, 2)::DECIMAL(6, 2)::DOUBLE", 2),
    ("round(score::DOUBLE, 3)::DECIMAL(6, 3)::DOUBLE + 0.002::DOUBLE", 3), ("round(100 * score::DOUBLE, 1)::DECIMAL(6, 1)::DOUBLE", 1), ("round(100 * score::DOUBLE, 0)::DECIMAL(6, 0)::DOUBLE + 2", 0), ("(coalesce(n_lines, 0) / 100.0)::DECIMAL(6, 2)::DOUBLE", 2), ("NULL::DOUBLE", 0),
]


def _places(x: str, d: str) -> str:
    return f"floor({x} * pow(10::DOUBLE, {d}) + 0.5::DOUBLE)"


def _near(v: str, d: str) -> str:
    return f"(coalesce({_places('n_lines::DOUBLE', d)} = {_places(v, d)}, false) OR {_places('rate::DOUBLE', d)} = {_places(v, d)})"


_VALUE, _DECIMALS = (f"CASE case_id % 10 {' '.join(f'WHEN {i} THEN {s[j]}' for i, s in enumerate(_STATED))} END" for j in (0, 1))


@query("j11_grounding", f"""WITH {CASES}, s AS (SELECT *, {_RATE} AS rate, {_VALUE} AS v, {_DECIMALS} AS dec, case_id % 10 IN (6, 7) AS pct FROM cases)
 SELECT case_id, case_id % 13 > 0 AND (case_id % 17 > 0 OR case_id % 10 = 9) AND (case_id % 10 <> 2 OR case_id % 20 = 2) AND (v IS NULL OR {_near('v', 'dec')} OR (pct AND {_near('v / 100', '(dec + 2)')}) OR (NOT pct AND v <= 1 AND dec > 0 AND {_near('v * 100', 'greatest(dec - 2, 0)')})) AS grounded FROM s""")
def grounding(spark, d):
    c = A.cases(spark, d).withColumns({"rate": C.rounded(F.col("score"), 4).cast("decimal(6,4)"), "lines": F.coalesce("n_lines", F.lit(0))})
    k, score = F.col("case_id"), F.col("score").cast("double")
    said = lambda x, kind: F.when(F.col("case_id").isNotNull(), x.cast(kind).cast("string"))
    texts = [
        F.concat(said(F.col("lines"), "long"), F.lit(" lines")), F.lit("no number"), F.when(k % 20 == 2, "RF01_A fired").otherwise("RF02 fired"), F.concat(said(F.col("lines") + 900, "long"), F.lit(" lines")), F.concat(F.lit("rate "), said(C.rounded(score, 2), "decimal(6,2)")),
        F.concat(F.lit("rate "), said(C.rounded(score, 3) + 0.002, "decimal(6,3)")), F.concat(said(C.rounded(100 * score, 1), "decimal(6,1)"), F.lit("% risk")), F.concat(said(C.rounded(100 * score, 0) + 2, "decimal(6,0)"), F.lit("% risk")), F.concat(F.lit("a share of "), said(F.col("lines") / 100, "decimal(6,2)")), F.lit("history not available"),
    ]
    fact = F.coalesce(*[F.when(k % 10 == i, x) for i, x in enumerate(texts)])
    facts = c.select("case_id", F.lit("score").alias("source"), fact.alias("fact"))
    out = c.select("case_id", F.struct((k % 13 > 0).alias("ok"), F.when(k % 17 == 0, "unavailable").otherwise("completed").alias("status"), F.col("n_lines").alias("lines"), "rate", F.lit("RF01_A").alias("flag")).alias("score"))
    return triage.grounded_facts(facts, out, "case_id", ["score"]).select("case_id", "grounded")


_LO2, _HI2 = wilson("p", "n")


@query("j14_factors", f"WITH {CASES}, {_EV}, l AS (SELECT 'strong_driver' AS factor, sd AS on_, label FROM ev WHERE band = 'medium' UNION ALL SELECT 'history_contradiction', hc, label FROM ev WHERE band = 'medium'), g AS (SELECT factor, count(*) AS t, count(*) FILTER (on_) AS n, count(*) FILTER (on_ AND label = 1) AS p, avg(label) FILTER (NOT on_) AS w FROM l GROUP BY 1) SELECT factor, t AS n, n AS n_with, round(p::DOUBLE / n, 6) AS rate_with, round({_LO2}, 6) AS ci_low, round({_HI2}, 6) AS ci_high, round(w, 6) AS rate_without FROM g")
def factors(spark, d):
    e = _evidence(spark, d).where("risk_band = 'medium'")
    return r6(triage.factor_report(e, ["strong_driver", "history_contradiction"], "label"))


# --- evaluation and audit ------------------------------------------------------------------


@query("k01_stratified_sample", f"WITH {CASES}, n AS ({_numbered('k1', 'cases', 'case_id', 'label')}) SELECT case_id, round(_size::DOUBLE / least(_size, q), 6) AS weight FROM (SELECT *, CASE WHEN label = 1 THEN 100 ELSE 300 END AS q FROM n) WHERE _row <= q")
def stratified(spark, d):
    return r6(evaluate.stratified_sample(A.cases(spark, d), "case_id", "label", 100, 3).select("case_id", "weight"))


@query("k02_band_sample", f"""WITH {CASES}, {_EV}, n AS ({_numbered('k2', '(SELECT * FROM ev WHERE band IS NOT NULL)', 'case_id', 'band, label')}), z AS (SELECT band, CASE band WHEN 'medium' THEN 34 ELSE 33 END AS q, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM ev WHERE band IS NOT NULL GROUP BY 1),
 t AS (SELECT band, q, n, least(p, greatest(ceil(q / 2.0), q - n)) AS tp FROM z) SELECT case_id, n.band AS risk_band, n.label FROM n JOIN t ON t.band = n.band WHERE _row <= CASE WHEN n.label = 1 THEN tp ELSE least(t.n, q - tp) END""")
def band_sample(spark, d):
    return evaluate.band_sample(_evidence(spark, d), "case_id", "risk_band", "label", 100).select("case_id", "risk_band", "label")


@query("k03_open_runs", "SELECT event_id, user_id FROM events WHERE NOT (event_id % 3 = 0)")
def open_runs(spark, d):
    e = A.read(spark, d, "events").select("event_id", "user_id")
    return evaluate.open_runs(e, e.where("event_id % 3 = 0"), ["event_id", "user_id"])


@query("k04_quality", f"WITH {CASES}, {_EV}, {_DEC}, l AS (SELECT 'agent' AS policy, dec AS x, label FROM dc UNION ALL SELECT 'model_only', mo, label FROM dc), g AS (SELECT policy, count(*) AS t, count(*) FILTER (label = 1) AS n, count(*) FILTER (label = 0) AS q, count(*) FILTER (x = 'FLAG_FOR_INVESTIGATION' AND label = 1) AS p, count(*) FILTER (x = 'FLAG_FOR_INVESTIGATION' AND label = 0) AS fp, avg((x = 'APPROVE')::INT) AS a, avg((x = 'REQUEST_MORE_INFORMATION')::INT) AS i FROM l GROUP BY 1) SELECT policy, t AS n, round(p::DOUBLE / n, 6) AS recall, round({_LO2}, 6) AS recall_low, round({_HI2}, 6) AS recall_high, round(a, 6) AS approve_rate, round(fp::DOUBLE / q, 6) AS false_flag_rate, round(i, 6) AS info_rate, round(p::DOUBLE / (p + fp), 6) AS precision, round(p::DOUBLE / (p + fp), 6) AS weighted_precision FROM g")
def quality(spark, d):
    return r6(evaluate.decision_quality(decide(spark, d).join(A.cases(spark, d).select("case_id", "label"), "case_id"), "label", {"agent": "decision", "model_only": "model_only"}))


@query("k05_agreement", f"WITH {CASES}, {_EV}, {_DEC} SELECT coalesce(dec, 'all') AS a, coalesce(mo, 'all') AS b, count(*) AS n FROM dc GROUP BY CUBE (dec, mo)")
def agreement(spark, d):
    return evaluate.agreement_table(decide(spark, d), "decision", "model_only")


@query("k06_process", "SELECT event_type, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def process(spark, d):
    return r6(evaluate.process_metrics(A.read(spark, d, "events"), "event_type", "value"))


@query("k06_code_counts", f"WITH {CASES}, {_EV}, {_DEC} SELECT code, count(*) AS n FROM (SELECT unnest(string_split({_codes_sql()}, ',')) AS code FROM dc) WHERE code <> '' GROUP BY 1")
def code_counts(spark, d):
    e = triage.decide(_evidence(spark, d))
    return evaluate.code_counts(e.select(triage.reason_codes(F.col("decision")).alias("codes")), "codes")


_RUNS = """runs AS (SELECT event_id, event_id % 3 AS run_index, list_filter([CASE WHEN event_id % 2 = 0 THEN 'fraud_score' END, CASE WHEN event_id % 5 = 0 THEN 'claim_history' END], lambda x: x IS NOT NULL) AS tools_called, CASE WHEN event_id % 7 > 0 THEN list_filter([CASE WHEN event_id % 4 = 0 THEN 'claim_history' END], lambda x: x IS NOT NULL) ELSE []::VARCHAR[] END AS auto_tools,
 CASE event_type WHEN 'view' THEN 'APPROVE' WHEN 'signup' THEN 'REQUEST_MORE_INFORMATION' ELSE 'FLAG_FOR_INVESTIGATION' END AS decision, CASE WHEN event_type = 'click' THEN 'POLICY_CONDITION' ELSE 'FRAUD_RISK' END AS flag_category, CASE WHEN value < 5 THEN 'low' WHEN value < 20 THEN 'medium' ELSE 'high' END AS risk_band, event_id % 2 AS label, user_id, event_type, value FROM events), f AS (SELECT * FROM runs WHERE run_index = 0)"""
_MEASURES = {
    "claims": "count(*)", "errors": "count(*) FILTER (event_type = 'error')", "claims_with_conflicts": "count(*) FILTER (event_id % 11 = 0)", "mean_tool_calls": "avg(len(tools_called))", "mean_agent_steps": "avg(event_id % 6)", "max_steps_hits": "count(*) FILTER (event_id % 6 = 5)", "fallback_rate": "avg((event_id % 13 = 0)::INT)",
    "llm_failure_claims": "count(*) FILTER (event_id % 17 = 0)", "claims_with_grounding_removals": "count(*) FILTER (event_id % 4 > 0)", "evidence_items_removed": "sum(event_id % 4)", "mean_evidence_kept": "avg(event_id % 8)", "mean_input_tokens": "avg(100 + event_id % 50)", "mean_output_tokens": "avg(20 + event_id % 30)", "mean_cost_usd": "avg((event_id % 100) / 1000.0::DOUBLE)",
    "latency_p50_s": "quantile_cont(value, 0.5)", "latency_p95_s": "quantile_cont(value, 0.95)",
}
_REPORT = " UNION ALL ".join([f"SELECT '{m}' AS metric, '' AS name, round(({x})::DOUBLE, 6) AS value FROM f" for m, x in _MEASURES.items()] + [f"SELECT '{m}', '{t}', round(avg(list_contains({c}, '{t}')::INT), 6) FROM f" for m, c in (("tool_use_rate", "tools_called"), ("auto_run_rate", "auto_tools")) for t in ("fraud_score", "claim_history")] + [
    "SELECT 'reason_code_counts', event_type, count(*)::DOUBLE FROM f GROUP BY 2", "SELECT 'guardrail_interventions', 'fallback', count(*)::DOUBLE FROM f WHERE event_id % 13 = 0", "SELECT 'flag_categories', flag_category, count(*)::DOUBLE FROM f WHERE decision = 'FLAG_FOR_INVESTIGATION' GROUP BY 2",
    "SELECT 'fraud_risk_flags_by_band', risk_band, count(*)::DOUBLE FROM f WHERE decision = 'FLAG_FOR_INVESTIGATION' AND flag_category = 'FRAUD_RISK' GROUP BY 2", "SELECT 'fraud_risk_hits_by_band', risk_band, count(*)::DOUBLE FROM f WHERE decision = 'FLAG_FOR_INVESTIGATION' AND flag_category = 'FRAUD_RISK' AND label = 1 GROUP BY 2", "SELECT 'total_cost_usd', '', round(sum((event_id % 100) / 1000.0::DOUBLE), 6) FROM runs"])


@query("k06_report", f"WITH {_RUNS} {_REPORT}")
def process_report(spark, d):
    k, kind = F.col("event_id"), F.col("event_type")
    some = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))
    runs = A.read(spark, d, "events").select(
        (k % 3).alias("run_index"), some((k % 2 == 0, "fraud_score"), (k % 5 == 0, "claim_history")).alias("tools_called"), F.when(k % 7 > 0, some((k % 4 == 0, "claim_history"))).alias("auto_tools"), F.array(kind).alias("reason_codes"), some((k % 11 == 0, "c")).alias("conflicts"), some((k % 13 == 0, "fallback")).alias("interventions"),
        F.when(kind == "view", "APPROVE").when(kind == "signup", "REQUEST_MORE_INFORMATION").otherwise("FLAG_FOR_INVESTIGATION").alias("decision"), F.when(kind == "click", "POLICY_CONDITION").otherwise("FRAUD_RISK").alias("flag_category"), F.when(F.col("value") < 5, "low").when(F.col("value") < 20, "medium").otherwise("high").alias("risk_band"), (k % 2).alias("label"),
        F.when(kind == "error", "x").alias("error"), (k % 6).alias("agent_steps"), (k % 6 == 5).alias("max_steps_reached"), F.when(k % 13 == 0, "rule_fallback").alias("decided_by"), F.when(k % 17 == 0, 1).alias("llm_failures"), (k % 4).alias("grounding_removed"), (k % 8).alias("n_evidence"), F.col("value").alias("latency_s"), (100 + k % 50).alias("input_tokens"), (20 + k % 30).alias("output_tokens"), ((k % 100) / 1000.0).alias("cost_usd"),
    )
    return r6(evaluate.process_report(runs, ["fraud_score", "claim_history"]))


@query("k07_unstable", "SELECT user_id, count(*) AS runs, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS decisions FROM events GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT event_type) > 1")
def unstable(spark, d):
    return evaluate.unstable_keys(A.read(spark, d, "events"), "user_id", "event_type")


@query("k07_consistency", "WITH p AS (SELECT user_id, count(*) AS r, count(DISTINCT event_type) AS k FROM events GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS n_keys, count(*) FILTER (k = 1) AS n_stable, round(avg((k = 1)::INT), 6) AS share FROM p")
def consistency(spark, d):
    return r6(evaluate.consistency(A.read(spark, d, "events"), "user_id", "event_type"))


@query("k08_review_sample", f"WITH n AS ({_numbered('k8', 'events', 'event_id', 'event_type')}) SELECT event_id, event_type FROM n ORDER BY (_row > 5)::INT, md5('k8:' || event_id), event_id LIMIT 60")
def review_sample(spark, d):
    return evaluate.manual_review_sample(A.read(spark, d, "events").select("event_id", "event_type"), "event_id", ["event_type"], 5, 60)


@query("k09_check_shares", f"WITH {CASES}, {_LAGX}, {_CHECKS} SELECT check_id, count(*) FILTER (result = 'PASS') AS pass, count(*) FILTER (result = 'FAIL') AS fail, count(*) FILTER (result = 'UNKNOWN') AS unknown FROM ck GROUP BY 1")
def check_shares(spark, d):
    m = _checks(spark, d).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("check_id", "result"))).alias("checks"))
    return evaluate.policy_check_shares(m, "checks")


@query("k10_compare_modes", f"WITH {CASES}, {_EV}, {_DEC} SELECT dec AS before, mo AS after, count(*) AS n FROM dc WHERE dec IS DISTINCT FROM mo GROUP BY 1, 2")
def modes(spark, d):
    x = decide(spark, d)
    return evaluate.compare_modes(x.select("case_id", "decision"), x.select("case_id", F.col("model_only").alias("decision")), "case_id", "decision")


@query("k10_changed", f"""WITH {CASES}, {_EV}, {_DEC}, {_LAGX}, {_CHECKS}, f AS (SELECT case_id, string_agg(check_id, ', ' ORDER BY check_id) FILTER (result = 'FAIL') AS failed FROM ck GROUP BY 1)
 SELECT case_id, dec AS before, mo AS after, coalesce(cat, '') AS category_before, '' AS category_after, coalesce(nullif(concat_ws(', ', failed, CASE WHEN case_id % 5 > 0 THEN (case_id % 5)::VARCHAR || ' previous claims' END), ''), 'judgement') AS cause FROM dc LEFT JOIN f USING (case_id) WHERE dec IS DISTINCT FROM mo OR coalesce(cat, '') <> ''""")
def changed(spark, d):
    x = decide(spark, d)
    m = _checks(spark, d).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("check_id", "result"))).alias("checks"))
    on = x.select("case_id", F.col("model_only").alias("decision"), F.lit(None).cast("string").alias("category"), (F.col("case_id") % 5).alias("n_previous")).join(m, "case_id", "left")
    return evaluate.changed_decisions(x, on, "case_id", "decision", "category", "checks", "n_previous")


@query("k10_mode_deltas", f"WITH {CASES}, {_EV}, {_DEC}, l AS (SELECT 'l' AS m, dec AS x, label FROM dc UNION ALL SELECT 'r', mo, label FROM dc), c AS (SELECT 'recall' AS metric, m, avg((x = 'FLAG_FOR_INVESTIGATION')::INT) AS v FROM l WHERE label = 1 GROUP BY 2 UNION ALL SELECT 'false_flag_rate', m, avg((x = 'FLAG_FOR_INVESTIGATION')::INT) FROM l WHERE label = 0 GROUP BY 2 UNION ALL SELECT 'approve_rate', m, avg((x = 'APPROVE')::INT) FROM l GROUP BY 2 UNION ALL SELECT 'info_rate', m, avg((x = 'REQUEST_MORE_INFORMATION')::INT) FROM l GROUP BY 2) SELECT metric, round(max(v) FILTER (m = 'l'), 6) AS \"left\", round(max(v) FILTER (m = 'r'), 6) AS \"right\", round(max(v) FILTER (m = 'r') - max(v) FILTER (m = 'l'), 6) AS delta FROM c GROUP BY 1")
def deltas(spark, d):
    x = decide(spark, d).join(A.cases(spark, d).select("case_id", "label"), "case_id")
    return r6(evaluate.mode_deltas(x.select("label", "decision"), x.select("label", F.col("model_only").alias("decision")), "label", "decision"))


@query("k04_flags_by_category", f"WITH {CASES}, {_EV}, {_DEC} SELECT cat AS category, count(*) AS n, count(*) FILTER (label = 1) AS positives FROM dc WHERE dec = 'FLAG_FOR_INVESTIGATION' GROUP BY 1")
def by_category(spark, d):
    x = decide(spark, d).join(A.cases(spark, d).select("case_id", "label"), "case_id")
    return evaluate.flags_by_category(x, "label", "decision", "category")


@query("k12_judge_means", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(user_id % 5 + 1), 6) AS mean_clarity FROM events GROUP BY 1")
def judged(spark, d):
    return r6(evaluate.judge_means(A.read(spark, d, "events").withColumn("clarity", F.col("user_id") % 5 + 1), "event_type", ["value", "clarity"]))


@query("l08_verification_rows", f"WITH {CASES}, {_LAGX}, {_CHECKS} SELECT case_id, check_id, result FROM ck")
def verification_rows(spark, d):
    m = _checks(spark, d).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("check_id", "result"))).alias("checks"))
    return evaluate.verification_rows(m, ["case_id"], "checks")


@query("k11_usage", "SELECT count(*) AS n_runs, round(avg(value), 6) AS mean_value FROM events WHERE event_id % 3 > 0")
def usage(spark, d):
    return r6(evaluate.usage(A.read(spark, d, "events").withColumn("calls", F.col("event_id") % 3), "calls", ["value"]))


@query("k13_decision_shares", f"WITH {CASES}, {_EV}, {_DEC}, l AS (SELECT 'agent' AS policy, dec AS x, label FROM dc UNION ALL SELECT 'model_only', mo, label FROM dc) SELECT label::INT AS label, policy, d AS decision, round(avg((x = d)::INT), 6) AS share FROM l, (VALUES ('APPROVE'), ('DENY'), ('FLAG_FOR_INVESTIGATION')) v(d) GROUP BY 1, 2, 3")
def shares(spark, d):
    x = decide(spark, d).join(A.cases(spark, d).select("case_id", "label"), "case_id")
    return r6(evaluate.decision_shares(x, "label", {"agent": "decision", "model_only": "model_only"}, ["APPROVE", "DENY", "FLAG_FOR_INVESTIGATION"]))


def _reviews(spark, d):
    e, k = A.read(spark, d, "events"), F.col("event_id")
    rev = e.select(k.alias("review_id"), F.col("user_id").cast("string").alias("run_id"), F.when(k % 5 == 0, "DENY").when(k % 5 == 1, "maybe").otherwise("APPROVE").alias("decision"), F.when(k % 2 == 0, "seen").otherwise(" ").alias("reason"))
    rec = e.select(F.col("user_id").cast("string").alias("run_id"), F.lit("APPROVE").alias("decision")).where("cast(run_id as int) % 7 <> 0").distinct()
    return rev, rec


_REV = "rv AS (SELECT event_id AS k, user_id AS u, CASE event_id % 5 WHEN 0 THEN 'DENY' WHEN 1 THEN 'maybe' ELSE 'APPROVE' END AS dec, event_id % 2 = 0 AS has FROM events), rr AS (SELECT *, CASE WHEN u % 7 = 0 THEN 'unknown run' WHEN dec = 'maybe' THEN 'unknown decision' WHEN dec <> 'APPROVE' AND NOT has THEN 'override without reason' END AS no FROM rv), rs AS (SELECT k, u, dec, coalesce(no, CASE WHEN row_number() OVER (PARTITION BY u, no IS NULL ORDER BY k) > 1 THEN 'already reviewed' ELSE 'accepted' END) AS status FROM rr)"


@query("l02_accept_reviews", f"WITH {_REV} SELECT k AS review_id, u::VARCHAR AS run_id, status FROM rs")
def accept(spark, d):
    rev, rec = _reviews(spark, d)
    return evaluate.accept_reviews(rev, rec).select("review_id", "run_id", "status")


@query("l03_pending", f"WITH {_REV} SELECT DISTINCT u::VARCHAR AS run_id FROM rs WHERE u % 7 <> 0 AND u NOT IN (SELECT u FROM rs WHERE status = 'accepted')")
def pending(spark, d):
    rev, rec = _reviews(spark, d)
    return evaluate.pending(rec, evaluate.accept_reviews(rev, rec).where("status = 'accepted'")).select("run_id")


@query("l04_latest", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def latest(spark, d):
    return evaluate.latest(A.read(spark, d, "events"), "ts", 25, "event_id").select("event_id")


@query("l05_kpis", f"WITH {CASES}, {_EV}, {_DEC} SELECT count(*) AS investigations, round(avg((dec = 'FLAG_FOR_INVESTIGATION')::INT), 6) AS flag_rate, round(avg((dec = 'APPROVE')::INT), 6) AS approval_rate, count(*) FILTER (dec <> mo) AS overrides FROM dc")
def kpis(spark, d):
    return r6(evaluate.kpis(decide(spark, d).withColumn("o", F.col("decision") != F.col("model_only")), "decision", "o"))


@query("l06_distribution", f"WITH {CASES}, {_EV}, {_DEC} SELECT 'decision' AS \"column\", dec AS value, count(*) AS n FROM dc GROUP BY 2 UNION ALL SELECT 'risk_band', band, count(*) FROM dc GROUP BY 2")
def distribution(spark, d):
    return evaluate.distribution(triage.decide(_evidence(spark, d)), ["decision", "risk_band"])


@query("l07_history_listing", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND event_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 40")
def listing(spark, d):
    e = A.read(spark, d, "events").withColumn("o", F.col("event_id") % 2 == 0)
    return evaluate.history_listing(e, "event_type", ["click", "view"], "o", True, "ts", "event_id", 40).select("event_id", "event_type")


_ANY = " OR ".join(f"coalesce(({claims_queries._in_sql(f)}), false)" for f in rules.RED_FLAGS if f.severity == "warning")
_WEIGHED = " + ".join(f"coalesce(({claims_queries._in_sql(f)}), false)::INT * {rules.WEIGHTS[f.severity]}" for f in rules.RED_FLAGS)


@query("e19_rules_only", f"WITH {CLAIMS}, r AS (SELECT split, \"FraudFound_P\" AS label, ({_WEIGHED})::DOUBLE AS s, ({_ANY}) AS warned FROM claims), {_CURVE} SELECT split, round((sum((n - p) * (pg - p + p / 2.0::DOUBLE)) / max(pa::DOUBLE * (na - pa)))::DOUBLE, 6) AS roc_auc, round(sum(p::DOUBLE / pa * pg / ng), 6) AS pr_auc, (SELECT round(avg(warned::INT), 6) FROM r WHERE r.split = c.split) AS warned FROM c GROUP BY split")
def rules_only(spark, d):
    warned = C.any_of([rules.condition_mask(f.when) for f in rules.RED_FLAGS if f.severity == "warning"])
    c = A.claims(spark, d).select("split", "FraudFound_P", rules.red_flag_score().cast("double").alias("s"), warned.cast("int").alias("w"))
    curve = metrics.ranking_metrics(c, "FraudFound_P", "s", ["split"]).drop("brier")
    return r6(curve.join(c.groupBy("split").agg(F.avg("w").alias("warned")), "split"))
