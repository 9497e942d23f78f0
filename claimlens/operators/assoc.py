"""Association statistics and rule mining from contingency counts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .rules import unpivot


def base_rate(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group): count and rate."""
    return df.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(target).alias("_base"))


def rate_table(df: DataFrame, column: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Per value (null is one): n, positives, rate, Wilson interval and lift over the base."""
    out = df.groupBy(*by, F.col(column).alias("value")).agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("positives"))
    base = base_rate(df, target, by)
    out = out.join(base, list(by)) if by else out.join(F.broadcast(base))  # one row
    low, high = C.wilson(F.col("positives"), F.col("n"))
    rate = F.col("positives") / F.col("n")
    return out.select(*by, "value", "n", "positives", rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high"), F.when(F.col("_base") > 0, rate / F.col("_base")).alias("lift"))


def contingency(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """``column, value, y, n`` for all columns at once, without null values."""
    long = unpivot(df.withColumn("y", F.col(target)), columns, ["y"], kind="string")
    return long.where("value is not null and y is not null").groupBy("column", "value", "y").agg(F.count("*").alias("n"))


def _margins(counts: DataFrame) -> DataFrame:
    rows = counts.groupBy("column", "value").agg(F.sum("n").alias("r"))
    cols = counts.groupBy("column", "y").agg(F.sum("n").alias("c"))
    all_ = counts.groupBy("column").agg(F.sum("n").alias("t"), F.count_distinct("value").alias("levels"), F.count_distinct("y").alias("classes"))
    return counts.join(rows, ["column", "value"]).join(cols, ["column", "y"]).join(all_, "column")


def association_ranking(df: DataFrame, columns: Sequence[str], target: str, smoothing: float = 0.5) -> DataFrame:
    """Per column: levels, chi2 (no correction), dof, its p-value, Cramer's V, information value and its band.

    chi2 = n * (sum o^2 / (r c) - 1) needs no cells of zero; V is 0 below two levels.
    """
    counts = contingency(df, columns, target)
    m = _margins(counts)
    chi = m.groupBy("column").agg(F.max("t").alias("n"), F.max("levels").alias("levels"), F.max("classes").alias("classes"), (F.sum(F.col("n").cast("double") * F.col("n") / (F.col("r").cast("double") * F.col("c"))) - 1).alias("phi2"))
    wide = counts.groupBy("column", "value").agg(F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("n"))), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("neg"))
    sums = wide.groupBy("column").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"), F.count("*").alias("k"))
    p = (F.col("pos") + smoothing) / (F.col("tp") + smoothing * F.col("k"))
    q = (F.col("neg") + smoothing) / (F.col("tn") + smoothing * F.col("k"))
    iv = wide.join(sums, "column").groupBy("column").agg(F.sum((p - q) * F.ln(p / q)).alias("iv"))
    out = chi.join(iv, "column")
    small = F.least(F.col("levels"), F.col("classes")) - 1
    v = F.when(small > 0, F.sqrt(F.greatest(F.col("phi2"), F.lit(0.0)) / small)).otherwise(0.0)
    band = F.when(F.col("iv") <= 0.02, "negligible").when(F.col("iv") <= 0.1, "weak").when(F.col("iv") <= 0.3, "medium").when(F.col("iv") <= 0.5, "strong").otherwise("very strong")
    chi2, dof = F.greatest(F.col("phi2"), F.lit(0.0)) * F.col("n"), (F.col("levels") - 1) * (F.col("classes") - 1)
    return out.select("column", "levels", chi2.alias("chi2"), dof.alias("dof"), C.chi2_survival(chi2, dof).alias("p_value"), v.alias("cramers_v"), "iv", band.alias("strength"))


def pair_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``a, b, va, vb, n`` of all column pairs from one explode and one aggregate."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb")) for a, b in combinations(sorted(columns), 2)]
    long = df.select(*by, F.explode(F.array(*cells)).alias("p")).select(*by, "p.*")
    return long.where("va is not null and vb is not null").groupBy(*by, "a", "b", "va", "vb").agg(F.count("*").alias("n"))


def cramers_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Cramer's V of each unordered column pair (``a < b``)."""
    counts = pair_counts(df, columns, by)
    key = [*by, "a", "b"]
    rows, cols = counts.groupBy(*key, "va").agg(F.sum("n").alias("r")), counts.groupBy(*key, "vb").agg(F.sum("n").alias("c"))
    m = counts.join(rows, [*key, "va"]).join(cols, [*key, "vb"])
    out = m.groupBy(*key).agg(F.sum(F.col("n").cast("double") * F.col("n") / (F.col("r").cast("double") * F.col("c"))).alias("s"), F.count_distinct("va").alias("ka"), F.count_distinct("vb").alias("kb"))
    small = F.least("ka", "kb") - 1
    return out.select(*key, F.when(small > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / small)).otherwise(0.0).alias("v"))


def matrix_difference(df: DataFrame, columns: Sequence[str], split: str, left: str, right: str) -> DataFrame:
    """Cramer's V of both splits and their difference, per pair."""
    both = cramers_matrix(df.where(F.col(split).isin(left, right)), columns, [split])
    pick = lambda s, n: both.where(F.col(split) == s).select("a", "b", F.col("v").alias(n))
    return pick(left, "v_left").join(pick(right, "v_right"), ["a", "b"]).withColumn("difference", F.col("v_right") - F.col("v_left"))


def largest_differences(difference: DataFrame, k: int = 10) -> DataFrame:
    return difference.orderBy(F.abs("difference").desc(), "a", "b").limit(k)


def interaction_table(df: DataFrame, row: str, col: str, target: str) -> DataFrame:
    out = df.groupBy(row, col).agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("positives"))
    low, high = C.wilson(F.col("positives"), F.col("n"))
    return out.select(row, col, "n", "positives", (F.col("positives") / F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"))


def interaction_by_origin(df: DataFrame, row: str, col: str, target: str, split: str, left: str, right: str) -> DataFrame:
    """``interaction_table`` of two splits side by side; a cell that one lacks has nulls there."""
    cells = df.where(F.col(split).isin(left, right)).groupBy(row, col)
    side = lambda s, n: [F.count_if(F.col(split) == s).alias(f"n_{n}"), F.avg(F.when(F.col(split) == s, F.col(target))).alias(f"rate_{n}")]
    out = cells.agg(*side(left, "left"), *side(right, "right"))
    return out.withColumn("difference", F.col("rate_right") - F.col("rate_left"))


def mine_conditions(df: DataFrame, columns: Sequence[str], target: str, min_support: float = 0.01, min_lift: float = 1.2, max_order: int = 2) -> DataFrame:
    """Single and paired ``column=value`` conditions whose Wilson lower bound exceeds the base
    rate and whose lift reaches the minimum.  Pairs are formed inside the row, without a self-join."""
    columns = sorted(columns)
    items = {c: F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in columns}
    found = list(items.values())
    if max_order > 1:
        found += [F.concat(items[a], F.lit(" & "), items[b]) for a, b in combinations(columns, 2)]
    long = df.select(target, F.explode(F.array_compact(F.array(*found))).alias("condition"))
    counts = long.groupBy("condition").agg(F.count("*").alias("n"), F.sum(target).cast("long").alias("positives"))
    low, _ = C.wilson(F.col("positives"), F.col("n"))
    out = counts.join(F.broadcast(base_rate(df, target))).withColumn("ci_low", low)
    rate = F.col("positives") / F.col("n")
    keep = (F.col("n") >= min_support * F.col("_n")) & (F.col("ci_low") > F.col("_base")) & (rate / F.col("_base") >= min_lift)
    return out.where(keep).select("condition", "n", "positives", rate.alias("rate"), "ci_low", (rate / F.col("_base")).alias("lift"))


def functional_dependency(df: DataFrame, x: str, y: str) -> DataFrame:
    """Whether each value of x has one value of y; the most values that one has."""
    per = df.groupBy(x).agg(F.count_distinct(y).alias("k"))
    return per.agg(F.count("*").alias("n_values"), F.max("k").alias("most"), (F.max("k") <= 1).alias("holds"))


def dependency_strength(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """For each pair ``x, y``: ``n_values`` of x, the ``most`` values of y that one has, whether y follows from x (``holds``), and
    Cramer's V.  Rows with a null in either count in neither."""
    cells = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(a).cast("string").alias("vx"), F.col(b).cast("string").alias("vy")) for a, b in pairs]
    counts = df.select(F.explode(F.array(*cells)).alias("p")).select("p.*").where("vx is not null and vy is not null").groupBy("x", "y", "vx", "vy").agg(F.count("*").alias("n"))
    rows, cols = counts.groupBy("x", "y", "vx").agg(F.sum("n").alias("r"), F.count("*").alias("k")), counts.groupBy("x", "y", "vy").agg(F.sum("n").alias("c"))
    n = F.col("n").cast("double")
    phi = counts.join(rows, ["x", "y", "vx"]).join(cols, ["x", "y", "vy"]).groupBy("x", "y").agg((F.sum(n * n / (F.col("r").cast("double") * F.col("c"))) - 1).alias("phi2"))
    wide = rows.groupBy("x", "y").agg(F.count("*").alias("n_values"), F.max("k").alias("most")).join(cols.groupBy("x", "y").agg(F.count("*").alias("ky")), ["x", "y"]).join(phi, ["x", "y"])
    small = F.least("n_values", "ky") - 1
    return wide.select("x", "y", "n_values", "most", (F.col("most") <= 1).alias("holds"), F.when(small > 0, F.sqrt(F.greatest(F.col("phi2"), F.lit(0.0)) / small)).otherwise(0.0).alias("v"))


def tvd_and_chi2(df: DataFrame, columns: Sequence[str], split: str, left: str, right: str) -> DataFrame:
    """Per column: distance and chi2 of two splits as a two-row table, with its dof and p-value."""
    long = unpivot(df.where(F.col(split).isin(left, right)), columns, [split], kind="string").where("value is not null")
    wide = long.groupBy("column", "value").agg(F.count_if(F.col(split) == left).alias("l"), F.count_if(F.col(split) == right).alias("r"))
    sums = wide.groupBy("column").agg(F.sum("l").alias("tl"), F.sum("r").alias("tr"))
    m = wide.join(sums, "column")
    l, r, tl, tr = (F.col(c).cast("double") for c in ("l", "r", "tl", "tr"))
    cell = lambda o, t: o * o / ((l + r) * t)
    out = m.groupBy("column").agg((0.5 * F.sum(F.abs(l / tl - r / tr))).alias("tvd"), ((F.sum(cell(l, tl) + cell(r, tr)) - 1) * F.max(tl + tr)).alias("chi2"), (F.count("*") - 1).alias("dof"))
    out = out.withColumn("chi2", F.greatest("chi2", F.lit(0.0)))
    return out.withColumn("p_value", C.chi2_survival(F.col("chi2"), F.col("dof")))


def rate_agreement(df: DataFrame, columns: Sequence[str], split: str, left: str, right: str, target: str, min_n: int = 30) -> DataFrame:
    """Rates of both splits per category with at least ``min_n`` rows on the left, and lifts."""
    both = df.where(F.col(split).isin(left, right))
    long = unpivot(both, columns, [split, target], kind="string").where("value is not null")
    is_l = F.col(split) == left
    out = long.groupBy("column", "value").agg(F.count_if(is_l).alias("n_left"), F.count_if(~is_l).alias("n_right"), F.avg(F.when(is_l, F.col(target))).alias("rate_left"), F.avg(F.when(~is_l, F.col(target))).alias("rate_right"))
    base = both.agg(F.avg(F.when(is_l, F.col(target))).alias("bl"), F.avg(F.when(~is_l, F.col(target))).alias("br"))
    out = out.where(F.col("n_left") >= min_n).join(F.broadcast(base))
    return out.select("column", "value", "n_left", "n_right", "rate_left", "rate_right", (F.col("rate_left") / F.col("bl")).alias("lift_left"), (F.col("rate_right") / F.col("br")).alias("lift_right"))


def flipped_signals(agreement: DataFrame) -> DataFrame:
    """Categories whose lift lies on different sides of 1."""
    return agreement.where("(lift_left - 1) * (lift_right - 1) < 0")


def rate_correlation(agreement: DataFrame) -> DataFrame:
    return agreement.agg(F.count("*").alias("n"), F.corr("rate_left", "rate_right").alias("correlation"))


def mutual_information(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """In nats, less the bias (R-1)(C-1)/2n, and the average rank (descending, cut to an integer)."""
    m = _margins(contingency(df, columns, target))
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    mi = m.groupBy("column").agg((F.sum(n / t * F.ln(n * t / (F.col("r").cast("double") * F.col("c")))) - F.max((F.col("levels") - 1) * (F.col("classes") - 1) / (2 * t))).alias("mi"))
    others = mi.select(F.round("mi", 12).alias("other"))  # one row per column of the table: small
    me = mi.withColumn("mi", F.round("mi", 12))
    out = me.join(F.broadcast(others), F.col("other") >= F.col("mi")).groupBy("column", "mi").agg(F.count_if(F.col("other") > F.col("mi")).alias("above"), F.count_if(F.col("other") == F.col("mi")).alias("tied"))
    return out.select("column", "mi", F.floor(F.col("above") + 1 + (F.col("tied") - 1) / 2).cast("long").alias("rank"))


def category_coverage(df: DataFrame, columns: Sequence[str], split: str, real: str, other: str) -> DataFrame:
    """Per column: values that one split has and the other lacks."""
    long = unpivot(df.where(F.col(split).isin(real, other)), columns, [split], kind="string").where("value is not null")
    seen = long.groupBy("column", "value").agg(F.max(F.col(split) == real).alias("in_real"), F.max(F.col(split) == other).alias("in_other"))
    return seen.groupBy("column").agg(F.count_if(F.col("in_real") & ~F.col("in_other")).alias("n_missing"), F.count_if(F.col("in_other") & ~F.col("in_real")).alias("n_novel"))


def unseen_pairs(df: DataFrame, key: str, columns: Sequence[str], split: str, real: str, other: str) -> DataFrame:
    """Rows of the other split and how many hold a value pair that no real row has."""
    cells = [F.struct(F.lit(f"{a}|{b}").alias("pair"), F.concat_ws("|", a, b).alias("v")) for a, b in combinations(sorted(columns), 2)]
    long = df.select(key, split, F.explode(F.array(*cells)).alias("p")).select(key, split, "p.*")
    known = long.where(F.col(split) == real).select("pair", "v").distinct()
    fresh = long.where(F.col(split) == other).join(known, ["pair", "v"], "left_anti").agg(F.count_distinct(key).alias("n_unseen"))
    return df.where(F.col(split) == other).agg(F.count("*").alias("n_rows")).join(F.broadcast(fresh)).select("n_rows", "n_unseen", (100 * F.col("n_unseen") / F.col("n_rows")).alias("pct"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(df.agg(F.count("*").alias("_t")))).select("value", "n", (F.col("n") / F.col("_t")).alias("share"))
