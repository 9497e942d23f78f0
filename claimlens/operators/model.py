"""Training data, Spark ML scorers, calibration, scoring and linear explanations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.shared import discard, materialise


def md5_number(*parts: Column) -> Column:
    """32 bits of md5: an order that every engine and every partitioning agrees on."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def stratum_numbers(df: DataFrame, key: str, strata: Sequence[str], seed: str = "s", buckets: int = 64) -> DataFrame:
    """``_row`` (1..n in md5 order) and ``_size`` of each stratum.

    A stratum may hold most of the table, so rows are numbered within ``buckets`` ranges of the
    hash, and the counts of the lower ranges (one row each) are added; they go to every task, so strata must be few, such as classes and splits.
    """
    h = md5_number(F.lit(seed), F.col(key).cast("string"))
    out = df.withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / (4294967296 // buckets)).cast("int"))
    sizes = out.groupBy(*strata, "_b").agg(F.count("*").alias("_c"))
    part = Window.partitionBy(*strata)
    sizes = sizes.select(*strata, "_b", F.coalesce(F.sum("_c").over(part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_c").over(part).alias("_size"))
    inside = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key))
    return out.withColumn("_i", inside).join(F.broadcast(sizes), [*strata, "_b"]).withColumn("_row", (F.col("_i") + F.col("_o")).cast("long")).drop("_h", "_b", "_i", "_o")


def training_data(df: DataFrame, key: str, split: str, fraction: float, weight: float, include_real: bool = True, real: str = "real_train", other: str = "synthetic", seed: str = "s") -> DataFrame:
    """Real rows of weight 1 and exactly ``floor(fraction * n)`` of the others with ``weight``."""
    chosen = stratum_numbers(df.where(F.col(split) == other), key, [split], seed).where(F.col("_row") <= F.floor(fraction * F.col("_size"))).drop("_row", "_size").withColumn("weight", F.lit(float(weight)))
    if not include_real:
        return chosen
    return df.where(F.col(split) == real).withColumn("weight", F.lit(1.0)).unionByName(chosen)


def subsample(df: DataFrame, key: str, strata: Sequence[str], most: int, seed: str = "s") -> DataFrame:
    """At most ``most`` rows of each stratum, exactly and repeatably."""
    return stratum_numbers(df, key, strata, seed).where(F.col("_row") <= most).drop("_row", "_size")


def class_weight(df: DataFrame, label: str, weight: str) -> DataFrame:
    pos, neg = F.sum(F.when(F.col(label) == 1, F.col(weight))), F.sum(F.when(F.col(label) == 0, F.col(weight)))
    return df.agg(pos.alias("positive"), neg.alias("negative"), (neg / pos).alias("ratio"))


def guard_features(features: Sequence[str], never: Sequence[str] = (*S.NEVER_FEATURES, *S.DISPLAY_ONLY, S.TARGET)) -> None:
    """Ids, origin, display columns and the target never become features."""
    if found := set(features) & set(never):
        raise ValueError(f"not allowed as features: {sorted(found)}")


def feature_pipeline(nominal: Sequence[str], numeric: Sequence[str], kind: str = "linear"):
    """Spark ML stages to ``features``: one-hot and scaled for linear models, indexed for trees."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    guard_features([*nominal, *numeric])
    stages = [StringIndexer(inputCols=list(nominal), outputCols=[f"{c}_i" for c in nominal], handleInvalid="keep", stringOrderType="alphabetAsc")] if nominal else []
    inputs = [f"{c}_i" for c in nominal]
    if kind == "linear" and nominal:
        stages.append(OneHotEncoder(inputCols=inputs, outputCols=[f"{c}_v" for c in nominal], handleInvalid="keep"))
        inputs = [f"{c}_v" for c in nominal]
    stages.append(VectorAssembler(inputCols=[*inputs, *numeric], outputCol="raw_features", handleInvalid="keep"))
    if kind == "linear":
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=False))
    else:
        stages[-1] = stages[-1].setOutputCol("features")
    return Pipeline(stages=stages)


def fit_scorer(df: DataFrame, nominal: Sequence[str], numeric: Sequence[str], label: str, family: str = "logistic", weight: str | None = None, seed: int = 1, held: str | None = None):
    """A fitted pipeline: ``logistic``, ``forest`` or ``boosted``.  Boosted trees learn only from rows whose boolean column
    ``held`` is false, if it is given, and stop when its other rows gain no more."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier

    common = {"labelCol": label, "featuresCol": "features"} | ({"weightCol": weight} if weight else {})
    model = {
        "logistic": lambda: LogisticRegression(maxIter=50, regParam=1e-3, **common),
        "forest": lambda: RandomForestClassifier(numTrees=40, maxDepth=8, maxBins=64, seed=seed, **common),
        "boosted": lambda: GBTClassifier(maxIter=20, maxDepth=4, maxBins=64, stepSize=0.2, seed=seed, **common, **({"validationIndicatorCol": held} if held else {})),
    }[family]()
    return Pipeline(stages=[*feature_pipeline(nominal, numeric, "linear" if family == "logistic" else "tree").getStages(), model]).fit(df)


def score(model, df: DataFrame, name: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    keep = df.columns
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias(name))


def seed_ensemble(models: Sequence, df: DataFrame, key: str) -> DataFrame:
    """Average probability of the same model over seeds."""
    parts = [score(m, df).select(key, "p") for m in models]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(key).agg(F.avg("p").alias("p"))


def _written(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """``df`` with these columns alone, written once: a fit reads its rows many times, and what they come from (joins and their
    broadcasts) must not run again for each of its passes."""
    return materialise(df.select(*dict.fromkeys(columns)), name)


def _fitted(train: DataFrame, *given, **named):
    """``fit_scorer`` on rows that are written before and deleted after."""
    train = materialise(train, "train")
    try:
        return fit_scorer(train, *given, **named)
    finally:
        discard(train)


def compare_families(train: DataFrame, valid: DataFrame, nominal, numeric, label: str, key: str, families=("logistic", "forest", "boosted")) -> DataFrame:
    """ROC-AUC, PR-AUC and Brier score of each family on the validation rows, and the precision of its top 10 %."""
    from .metrics import precision_at_top, ranking_metrics

    columns, scored = (key, label, *nominal, *numeric), None
    train, valid = _written(train, "train", *columns), _written(valid, "valid", *columns)
    for family in families:
        part = score(fit_scorer(train, nominal, numeric, label, family), valid).select(F.lit(family).alias("model"), key, label, "p")
        scored = part if scored is None else scored.unionByName(part)
    scored = materialise(scored, "scored")
    top = precision_at_top(scored, key, label, "p", 0.1, ["model"]).select("model", F.col("precision").alias("precision_top10"))
    return ranking_metrics(scored, label, "p", ["model"]).join(top, "model")


def _logit(p: Column) -> Column:
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(clipped / (1 - clipped))


def fit_calibrator(df: DataFrame, label: str, p: str, kind: str) -> DataFrame:
    """A calibrator as a small table ``kind, low, high, at_low, at_high``.

    ``isotonic``: intervals of the score between the fit's break points with the values at their ends, the first and last open.  ``platt``: one row
    with slope and intercept of the logit as ``at_low`` and ``at_high``.  ``none``: one row that changes nothing.
    """
    spark, shape = df.sparkSession, "kind string, low double, high double, at_low double, at_high double"
    rows = df.where(F.col(p).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    if kind == "none" or not rows.limit(1).count():
        return spark.createDataFrame([("none", None, None, None, None)], shape)
    if kind == "platt":
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        fit = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=1000, tol=1e-10).fit(VectorAssembler(inputCols=["_l"], outputCol="_x").transform(rows.withColumn("_l", _logit(F.col("_p")))))
        slope = float(fit.coefficients[0]) if len(fit.coefficients) else 0.0
        return spark.createDataFrame([("platt", None, None, slope, float(fit.intercept))], shape)
    from pyspark.ml.regression import IsotonicRegression

    fit = IsotonicRegression(featuresCol="_p", labelCol="_y").fit(rows)
    return break_points(spark, list(map(float, fit.boundaries)), list(map(float, fit.predictions)))


def break_points(spark, x: Sequence[float], y: Sequence[float]) -> DataFrame:
    """An isotonic calibrator from rising break points and their values."""
    ends = [(None, x[0], y[0], y[0]), *[(a, b, c, d) for a, b, c, d in zip(x[:-1], x[1:], y[:-1], y[1:]) if a < b], (x[-1], None, y[-1], y[-1])]
    return spark.createDataFrame([("isotonic", *e) for e in ends], "kind string, low double, high double, at_low double, at_high double")


def apply_calibrator(df: DataFrame, p: str, calibrator: DataFrame, name: str = "calibrated", cells: int = 256) -> DataFrame:
    """``df`` with the calibrated score, linear between break points.  A null score stays null.

    Intervals and rows meet under the cells of 0..1 that an interval overlaps, so a row meets those of its own cell only.
    """
    kind = calibrator.select("kind").first()[0]
    if kind == "none":
        return df.withColumn(name, F.col(p).cast("double"))
    if kind == "platt":
        line = F.broadcast(calibrator.select(F.col("at_low").alias("_a"), F.col("at_high").alias("_b")))  # one row
        return df.join(line).withColumn(name, 1 / (1 + F.exp(-(F.col("_a") * _logit(F.col(p)) + F.col("_b"))))).drop("_a", "_b")
    cell = lambda c: F.when(c.isNotNull(), F.least(F.greatest(F.floor(c * cells), F.lit(0)), F.lit(cells - 1)).cast("int"))
    spread = calibrator.select("low", "high", "at_low", "at_high", F.explode(F.sequence(F.coalesce(cell(F.col("low")), F.lit(0)), F.coalesce(cell(F.col("high")), F.lit(cells - 1)))).alias("_cell"))
    spread = spread.select("_cell", *[F.col(c).alias(f"_{c}") for c in ("low", "high", "at_low", "at_high")])
    x = F.col(p).cast("double")
    inside = (F.col("_low").isNull() | (x > F.col("_low"))) & (F.col("_high").isNull() | (x <= F.col("_high")))
    met = df.withColumn("_own", cell(x)).join(spread, (F.col("_own") == F.col("_cell")) & inside, "left")
    value = F.when(F.col("_low").isNull() | F.col("_high").isNull(), F.col("_at_low")).otherwise(F.col("_at_low") + (F.col("_at_high") - F.col("_at_low")) * (x - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return met.withColumn(name, value).select(*df.columns, name)


def _folded(df: DataFrame, key: str, label: str, folds: int) -> DataFrame:
    return stratum_numbers(df, key, [label]).withColumn("_fold", F.pmod("_row", F.lit(folds))).drop("_row", "_size")


def _calibration(rows: DataFrame, label: str, p: str, folds: int, kinds: Sequence[str]) -> tuple[DataFrame, dict[str, list[DataFrame]]]:
    """The report on folded and written rows, and the calibrators of each kind by the fold that they have not seen."""
    fits, out = {}, None
    for kind in kinds:
        fits[kind] = [fit_calibrator(rows.where(F.col("_fold") != k), label, p, kind) for k in range(folds if kind != "none" else 1)]
        for k, fit in enumerate(fits[kind]):
            held = rows if kind == "none" else rows.where(F.col("_fold") == k)
            part = apply_calibrator(held, p, fit, "_c").select(F.lit(kind).alias("kind"), F.pow(F.col("_c") - F.col(label), F.lit(2.0)).alias("e"))
            out = part if out is None else out.unionByName(part)
    each = out.groupBy("kind").agg(F.avg("e").alias("brier"))
    best = each.where("kind <> 'none'").agg(F.min_by("kind", F.struct("brier", F.col("kind") != "platt")).alias("_best"))
    return each.join(F.broadcast(best)).select("kind", "brier", F.coalesce(F.col("kind") == F.col("_best"), F.lit(False)).alias("chosen")), fits


def calibration_report(df: DataFrame, key: str, label: str, p: str, folds: int = 5, kinds: Sequence[str] = ("none", "platt", "isotonic")) -> DataFrame:
    """``kind, brier, chosen``: the Brier score of each kind on rows that its fit has not seen, and of the scores as they are; the
    lowest of the kinds that change something is chosen."""
    return _calibration(_written(_folded(df, key, label, folds), "folded", key, label, p, "_fold"), label, p, folds, kinds)[0]


def calibrate(df: DataFrame, key: str, label: str, p: str, folds: int = 5):
    """Cross-fitted calibration: ``(rows with calibrated, name)``, where the kind with the lower out-of-fold Brier score wins
    (``fit_calibrator`` of that kind then serves new rows)."""
    rows, out = materialise(_folded(df, key, label, folds), "folded"), None
    report, fits = _calibration(rows, label, p, folds, ("none", "platt", "isotonic"))
    best = report.where("chosen").first()["kind"]
    for k, fit in enumerate(fits[best]):
        part = apply_calibrator(rows.where(F.col("_fold") == k), p, fit).select(*df.columns, "calibrated")
        out = part if out is None else out.unionByName(part)
    return out, best


def risk_bands(p: Column, high: float, medium: float) -> Column:
    """high, medium or low; the medium cut is at most the high one, and half of it if equal."""
    medium = min(medium, high)
    if medium == high:
        medium = high / 2
    return F.when(p >= high, "high").when(p >= medium, "medium").when(p.isNotNull(), "low")


def score_claims(df: DataFrame, p: str, high: float, medium: float) -> DataFrame:
    """Probability to 6 places, band and class."""
    c = F.round(F.col(p), 6)
    return df.withColumns({"fraud_probability": c, "risk_band": risk_bands(c, high, medium), "predicted": F.when(c.isNotNull(), (c >= high).cast("long"))})


def _adversarial_models(df: DataFrame, key: str, split: str, left: str, right: str, nominal, numeric, folds: int, seed: int):
    """As many rows of each split with their ``fold``, the surplus of the larger split, and one model for each fold left out."""
    guard_features([*nominal, *numeric])
    both = df.where(F.col(split).isin(left, right)).withColumn("is_right", (F.col(split) == right).cast("int"))
    both = both.select(*dict.fromkeys((key, "is_right", *nominal, *numeric)))
    numbered = materialise(stratum_numbers(both, key, ["is_right"]), "numbered")
    least = numbered.agg(F.min("_size")).first()[0] or 0
    rows = numbered.where(F.col("_row") <= least).withColumn("fold", F.pmod("_row", F.lit(folds))).drop("_row", "_size")
    rest = numbered.where(F.col("_row") > least).drop("_row", "_size")
    return rows, rest, [fit_scorer(rows.where(F.col("fold") != k), nominal, numeric, "is_right", "boosted", seed=seed) for k in range(folds)]


def adversarial_validation(df: DataFrame, key: str, split: str, left: str, right: str, nominal, numeric, folds: int = 3, seed: int = 1) -> DataFrame:
    """Probability that a row belongs to ``right``, for all rows of both splits: ``key, fold, is_right, p``.

    The fold models learn from as many rows of each split; those rows get an out-of-fold value.  The
    surplus of the larger split is learned by no model: it gets the mean of all of them and a null ``fold``.
    """
    rows, rest, models = _adversarial_models(df, key, split, left, right, nominal, numeric, folds, seed)
    out = None
    for k, model in enumerate(models):
        part = score(model, rows.where(F.col("fold") == k)).select(key, "fold", "is_right", "p")
        out = part if out is None else out.unionByName(part)
        rest = score(model, rest, f"_p{k}")
    mean = sum((F.col(f"_p{k}") for k in range(1, folds)), F.col("_p0")) / folds
    return out.unionByName(rest.select(key, F.lit(None).cast(out.schema["fold"].dataType).alias("fold"), "is_right", mean.alias("p")))


def importance_shares(models: Sequence, features: Sequence[str], spark) -> DataFrame:
    """``feature, share``: the mean of the models' importances, which sum to 1 (or 0 where no tree splits)."""
    found = sum(m.stages[-1].featureImportances.toArray() for m in models)
    total = float(found.sum())
    return spark.createDataFrame([(f, float(x) / total if total else 0.0) for f, x in zip(features, found)], "feature string, share double")


def adversarial_importance(df: DataFrame, key: str, split: str, left: str, right: str, nominal, numeric, folds: int = 3, seed: int = 1) -> DataFrame:
    """``feature, share`` of the fold models that tell ``right`` from ``left``."""
    _, _, models = _adversarial_models(df, key, split, left, right, nominal, numeric, folds, seed)
    return importance_shares(models, [*nominal, *numeric], df.sparkSession)


def adversarial_drop_top(df: DataFrame, key: str, split: str, left: str, right: str, nominal, numeric, ranked: Sequence[str], k: int = 3, folds: int = 3, seed: int = 1) -> DataFrame:
    """``step, dropped, auc_mean``: the mean AUC over folds after the first 1..k of ``ranked`` are left out; at
    least one feature stays."""
    from .metrics import ranking_metrics

    df, out = _written(df, "rows", key, split, *nominal, *numeric), None
    for step in range(1, min(k, len(ranked), len([*nominal, *numeric]) - 1) + 1):
        gone = set(ranked[:step])
        left_in = [[c for c in side if c not in gone] for side in (nominal, numeric)]
        scored = adversarial_validation(df, key, split, left, right, *left_in, folds, seed).where("fold is not null")
        scored = materialise(scored, "scored")
        part = ranking_metrics(scored, "is_right", "p", ["fold"]).agg(F.lit(step).alias("step"), F.lit(ranked[step - 1]).alias("dropped"), F.avg("roc_auc").alias("auc_mean"))
        out = part if out is None else out.unionByName(part)
    return out


def data_mix(df: DataFrame, valid: DataFrame, mixes: Sequence[tuple[float, float, bool]], key: str, split: str, label: str, nominal, numeric, family: str = "boosted", seeds: Sequence[int] = (1, 2), real: str = "real_train", other: str = "synthetic") -> DataFrame:
    """PR-AUC on ``valid`` for each mix ``(fraction, weight, include real)``: rows of training data, mean and deviation over
    seeds, the value of the scores averaged over seeds, and ``chosen`` for the best mean among mixes with real rows (the first of equals)."""
    from .metrics import ranking_metrics

    columns, scored, rows = (key, label, *nominal, *numeric), None, []
    df, valid = _written(df, "rows", split, *columns), _written(valid, "valid", *columns)
    for number, (fraction, weight, with_real) in enumerate(mixes):
        for at, seed in enumerate(seeds):
            train = materialise(training_data(df, key, split, fraction, weight, with_real, real, other, f"s{seed}"), "train")
            part = score(fit_scorer(train, nominal, numeric, label, family, "weight", seed), valid).select(F.lit(number).alias("mix"), F.lit(seed).alias("seed"), key, label, "p")
            scored = part if scored is None else scored.unionByName(part)
            if not at:  # every seed takes as many rows
                size = train.agg(F.count("*"), F.count_if(F.col(split) == other)).first()
                rows.append((number, float(fraction), float(weight), with_real, *size))
            discard(train)
    scored = materialise(scored, "scored")
    rows = df.sparkSession.createDataFrame(rows, "mix int, fraction double, weight double, include_real boolean, train_rows long, synthetic_rows long")
    per = ranking_metrics(scored, label, "p", ["mix", "seed"]).groupBy("mix").agg(F.avg("pr_auc").alias("pr_auc_mean"), F.stddev_pop("pr_auc").alias("pr_auc_sd"))
    mean = ranking_metrics(scored.groupBy("mix", key, label).agg(F.avg("p").alias("p")), label, "p", ["mix"]).select("mix", F.col("pr_auc").alias("pr_auc_seed_mean"))
    table = rows.join(per, "mix").join(mean, "mix")
    best = table.where("include_real").agg(F.max_by("mix", F.struct("pr_auc_mean", -F.col("mix"))).alias("_best"))  # one row
    return table.join(F.broadcast(best)).withColumn("chosen", F.coalesce(F.col("mix") == F.col("_best"), F.lit(False))).drop("_best")


def utility_experiment(df: DataFrame, valid: DataFrame, mixes: Sequence[tuple[str, float, float, bool]], key: str, split: str, label: str, nominal, numeric, family: str = "logistic") -> DataFrame:
    """Metrics on real validation rows of a scorer trained on each mix ``(name, fraction, weight,
    include real)``."""
    from .metrics import ranking_metrics

    columns, scored = (key, label, *nominal, *numeric), None
    df, valid = _written(df, "rows", split, *columns), _written(valid, "valid", *columns)
    for name, fraction, weight, real in mixes:
        model = _fitted(training_data(df, key, split, fraction, weight, real), nominal, numeric, label, family, "weight")
        part = score(model, valid).select(F.lit(name).alias("mix"), key, label, "p")
        scored = part if scored is None else scored.unionByName(part)
    return ranking_metrics(materialise(scored, "scored"), label, "p", ["mix"])


def utility_seeds(df: DataFrame, valid: DataFrame, mixes: Sequence[tuple[str, float, float, bool]], key: str, split: str, label: str, nominal, numeric, family: str = "logistic", seeds: Sequence[int] = (1, 2, 3), masks: Mapping[str, Column] | None = None, real: str = "real_train", replicates: int = 50) -> DataFrame:
    """``utility_experiment`` over several seeds of the sample and the fit: ``mix, metric, value, low, high, seed_mean, seed_sd``.

    ``value`` and its percentile interval are those of the score averaged over the seeds.  ``masks`` (mix -> condition) keep only the
    other rows that meet it, such as those that pass the rules; real rows always stay.
    """
    from .metrics import metrics_with_ci, ranking_metrics
    from .rules import unpivot

    names, columns, scored = ("roc_auc", "pr_auc", "brier"), (key, label, *nominal, *numeric), None
    kept = {name: f"_kept{i}" for i, name in enumerate(masks or {})}
    df = _written(df.withColumns({c: masks[name] for name, c in kept.items()}), "rows", split, *columns, *kept.values())
    valid = _written(valid, "valid", *columns)
    for name, fraction, weight, with_real in mixes:
        rows = df.where((F.col(split) == real) | F.col(kept[name])) if name in kept else df
        for seed in seeds:
            train = training_data(rows, key, split, fraction, weight, with_real, real, seed=f"s{seed}")
            part = score(_fitted(train, nominal, numeric, label, family, "weight", seed), valid).select(F.lit(name).alias("mix"), F.lit(seed).alias("seed"), key, label, "p")
            scored = part if scored is None else scored.unionByName(part)
    scored = materialise(scored, "scored")
    per = unpivot(ranking_metrics(scored, label, "p", ["mix", "seed"]), names, ["mix", "seed"], "metric", "x", "double")
    per = per.groupBy("mix", "metric").agg(F.avg("x").alias("seed_mean"), F.stddev_pop("x").alias("seed_sd"))
    mean = scored.groupBy("mix", key, label).agg(F.avg("p").alias("p"))
    wide = metrics_with_ci(mean, key, label, "p", 0.5, replicates, by=["mix"], draw="scores").where(F.col("metric").isin(*names))
    return wide.join(per, ["mix", "metric"]).select("mix", "metric", "value", "low", "high", "seed_mean", "seed_sd")


def utility_differences(scored: DataFrame, key: str, label: str, reference: str, replicates: int = 50, seed: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """PR-AUC of each ``mix`` less that of ``reference`` on the same resamples: ``by, mix, mean_diff, low, high``.

    ``scored`` holds each ``mix`` with ``p`` for the same rows.  The resamples are drawn once, and counted by the scores
    of all mixes together.
    """
    from .metrics import bootstrap_cells, ranking_metrics

    scored = materialise(scored.select(*by, "mix", key, label, "p"), "scored")
    mixes = sorted(r[0] for r in scored.where("mix is not null").select("mix").distinct().collect())
    at = {m: f"_m{i}" for i, m in enumerate(mixes)}  # a struct, which is null where the mix lacks the row
    wide = scored.groupBy(*by, key, label).agg(F.bool_or(F.col("mix") == reference).alias("_own"), *[F.max(F.when(F.col("mix") == m, F.struct("p"))).alias(c) for m, c in at.items()])
    drawn = bootstrap_cells(wide.where("_own"), key, label, list(at.values()), replicates, seed, by)
    group = [*by, "replicate"]
    long = drawn.select(*group, label, "weight", F.explode(F.array(*[F.struct(F.lit(m).alias("mix"), F.col(c).alias("at")) for m, c in at.items()])).alias("m"))
    long = long.where("m.at is not null").select(*group, label, "weight", "m.mix", "m.at.p")
    per = ranking_metrics(materialise(long, "drawn"), label, "p", [*group, "mix"], "weight").select(*group, "mix", "pr_auc")
    base = per.where(F.col("mix") == reference).select(*group, F.col("pr_auc").alias("_base"))
    diff = per.where(F.col("mix") != reference).join(base, group).withColumn("d", F.col("pr_auc") - F.col("_base"))
    return diff.groupBy(*by, "mix").agg(F.avg("d").alias("mean_diff"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))


def linear_contributions(df: DataFrame, key: str, features: Sequence[str], coefficients: Mapping[str, float], means: Mapping[str, float] | None = None) -> DataFrame:
    """``key, feature, contribution``: (x - mean) * coefficient; means of the table unless given."""
    if means is None:
        means = df.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()
    cells = [F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.lit(float(means[c]))) * F.lit(float(coefficients[c]))).alias("contribution")) for c in features]
    return df.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*")


def top_contributions(long: DataFrame, key: str, k: int, labels: Mapping[str, str] | None = None) -> DataFrame:
    """The k largest by absolute value, after summing features under their readable label."""
    name = F.col("feature")
    if labels:
        name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), name), name)
    summed = long.groupBy(key, name.alias("label")).agg(F.sum("contribution").alias("contribution"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "label"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("direction", F.when(F.col("contribution") >= 0, "increases").otherwise("decreases"))


def contribution_reasons(long: DataFrame, key: str, k: int = 3, labels: Mapping[str, str] | None = None) -> DataFrame:
    """One row per key: ``increases`` and ``decreases``, the k largest contributions of each direction as labels in order, and
    ``reason``, a sentence on the largest of each.  A contribution of zero is in neither."""
    ranked = top_contributions(long.where("contribution <> 0"), key, 1 << 30, labels).where("contribution <> 0")  # a few labels a key
    side = Window.partitionBy(key, "direction").orderBy("rank")
    ranked = ranked.withColumn("_n", F.row_number().over(side)).where(F.col("_n") <= k)
    names = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("_n", "label")))), lambda x: x["label"])
    out = ranked.groupBy(key).agg(names("increases").alias("increases"), names("decreases").alias("decreases"))
    said = lambda c, text: F.when(F.size(c) > 0, F.concat(F.col(c)[0], F.lit(text)))
    return out.withColumn("reason", F.concat_ws("; ", said("increases", " raises the score most"), said("decreases", " lowers it most")))


def global_importance(long: DataFrame, key: str) -> DataFrame:
    """Mean absolute contribution per feature, after summing signed within each row."""
    per = long.groupBy(key, "feature").agg(F.sum("contribution").alias("c"))
    return per.groupBy("feature").agg(F.avg(F.abs("c")).alias("importance"))


def local_examples(df: DataFrame, key: str, label: str, p: str, threshold: float, k: int = 2) -> DataFrame:
    """k rows of each kind: true and false positives of the highest score, missed positives of the lowest."""
    hit, y = F.col(p) >= threshold, F.col(label) == 1
    kind = F.when(hit & y, "TP").when(hit & ~y, "FP").when(~hit & y, "FN")
    order = F.when(F.col("case") == "FN", F.col(p)).otherwise(-F.col(p))
    rows = df.withColumn("case", kind).where("case is not null").select("case", key, p, order.alias("o"))
    rank = F.row_number().over(Window.partitionBy("case").orderBy("o", key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("case", "rank", key, p)
