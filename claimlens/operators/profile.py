"""Profiles and audits of a split table: one unpivot, one shuffle for each report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .rules import RULES, Rule, rule_hit_summary, run_rules, unpivot


def profile_columns(df: DataFrame, columns: Sequence[str], most_values: int = 20) -> DataFrame:
    """Per column: type, distinct values, nulls, smallest and largest value as text, and the
    sorted values where there are at most ``most_values``."""
    kinds = dict(df.dtypes)
    long = unpivot(df, columns, [], kind="string").groupBy("column", "value").agg(F.count("*").alias("n"))
    # counts by value first: the second step sees each value once
    out = long.groupBy("column").agg(F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.array_sort(F.slice(F.array_sort(F.collect_set(F.when(F.length("value") <= 100, F.col("value")))), 1, most_values + 1)).alias("v"))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, kinds[c])]), F.col("column"))
    return out.select("column", kind.alias("type"), "n_distinct", "n_null", "lowest", "highest", F.when(F.col("n_distinct") <= most_values, F.array_join("v", "|")).alias("values_list"))


def frequency_table(df: DataFrame, columns: Sequence[str], split: str, target: str | None = None) -> DataFrame:
    """Long form: ``column, value, split, n, pct`` of the split's rows (nulls are a value of
    their own) and ``rate`` of the target."""
    keys = [split] + ([target] if target else [])
    long = unpivot(df, columns, keys, kind="string").groupBy("column", "value", split).agg(F.count("*").alias("n"), *([F.avg(target).alias("rate")] if target else []))
    totals = df.groupBy(F.col(split).alias("_s")).agg(F.count("*").alias("_n"))
    out = long.join(F.broadcast(totals), F.col(split).eqNullSafe(F.col("_s")))
    return out.select("column", "value", split, "n", (100 * F.col("n") / F.col("_n")).alias("pct"), *(["rate"] if target else []))


def describe(df: DataFrame, column: str, by: str) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum per group."""
    from .metrics import exact_percentiles

    out = df.groupBy(by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("lowest"), F.max(column).alias("highest"))
    quartiles = exact_percentiles(df, column, [0.25, 0.5, 0.75], [by], ["q25", "q50", "q75"]).withColumnRenamed(by, "_by")
    met = out.join(quartiles, F.col(by).eqNullSafe(F.col("_by")), "left")  # none for a group of nulls
    return met.select(by, "n", "mean", "sd", "lowest", "q25", "q50", "q75", "highest")


def tvd_table(df: DataFrame, columns: Sequence[str], split: str, reference: str) -> DataFrame:
    """Total variation distance of each column and split from the reference split."""
    shares = frequency_table(df, columns, split).select("column", "value", split, (F.col("pct") / 100).alias("p"))
    ref = shares.where(F.col(split) == reference).select(F.col("column").alias("rc"), F.col("value").alias("rv"), F.col("p").alias("rp"))
    other = shares.where(F.col(split) != reference)
    met = other.join(ref, (F.col("column") == F.col("rc")) & F.col("value").eqNullSafe(F.col("rv")), "left")
    # what the reference has beyond the met values completes its mass of 1
    out = met.groupBy("column", split).agg(F.sum(F.abs(F.col("p") - F.coalesce("rp", F.lit(0.0)))).alias("d"), F.sum(F.coalesce("rp", F.lit(0.0))).alias("m"))
    return out.select("column", split, (0.5 * (F.col("d") + 1 - F.col("m"))).alias("tvd"))


def split_summary(df: DataFrame, split: str, target: str, key: str) -> DataFrame:
    out = df.groupBy(split).agg(F.count("*").alias("n"), F.sum(target).alias("positives"), F.min(key).alias("min_id"), F.max(key).alias("max_id"))
    low, high = C.wilson(F.col("positives"), F.col("n"))
    return out.select(split, "n", "positives", (F.col("positives") / F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"), "min_id", "max_id")


def id_overlap(df: DataFrame, key: str, split: str) -> DataFrame:
    """Number of keys that two splits share, for each pair of splits that share any."""
    sets = df.select(key, split).distinct().groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n_shared"))


def ids_nowhere(all_ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return all_ids.select(key).distinct().join(df.select(key), key, "left_anti")


def changed_rows(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose rows differ in any column, null-safe."""
    other = right.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    differs = ~C.all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return left.select(key, *columns).join(other, key).where(differs).select(key)


def id_gaps(df: DataFrame, key: str) -> DataFrame:
    """Smallest and largest id, distinct ids, and how many are missing in between."""
    out = df.agg(F.min(key).alias("min_id"), F.max(key).alias("max_id"), F.count_distinct(key).alias("n_ids"))
    return out.select("min_id", "max_id", "n_ids", (F.col("max_id") - F.col("min_id") + 1 - F.col("n_ids")).alias("n_missing"))


def copies_of(df: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` that ``other`` has as well, on all columns, null-safe."""
    right = other.select([F.col(c).alias(f"_{c}") for c in columns]).distinct()
    return df.join(right, C.all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]), "left_semi")


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, distinct rows and surplus copies over ``columns``."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("c"))
    return groups.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.col("c") - 1).alias("n_surplus"))


def conditional_share(df: DataFrame, given: Column, holds: Column) -> DataFrame:
    """How often ``holds`` is true where ``given`` is."""
    return df.where(given).agg(F.count("*").alias("n"), F.avg(C.flag(holds)).alias("share"))


def verify_facts(observed: DataFrame, facts: DataFrame) -> DataFrame:
    """``check_name, expected, observed, ok``: facts (``check_name, expected, tolerance``) held against
    observed values (``check_name, observed``); an absent value is not ok."""
    out = facts.join(observed, "check_name", "left")
    near = F.abs(F.col("observed") - F.col("expected")) <= F.col("tolerance")
    return out.select("check_name", "expected", "observed", F.coalesce(near, F.lit(False)).alias("ok"))


def signal_check(df: DataFrame, target: str, stated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Observed against stated rates (``column, value, stated_rate``)."""
    rates = unpivot(df, columns, [target], kind="string").groupBy("column", "value").agg(F.count("*").alias("n"), F.avg(target).alias("observed_rate"))
    return stated.join(rates, ["column", "value"], "left").select("column", "value", "stated_rate", F.coalesce("n", F.lit(0)).alias("n"), "observed_rate")


def rule_violations(df: DataFrame, split: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    long = unpivot(run_rules(df, rules), [r.id for r in rules], [split], "rule_id", "passed")
    out = long.groupBy("rule_id", split).agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("violations"))
    return out.select("rule_id", split, "violations", (100 * F.col("violations") / F.col("n")).alias("pct"))


def rule_rates(df: DataFrame, split: str, target: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Violators' and passers' rates per rule and split, with the violators' interval and lift."""
    out = rule_hit_summary(df, target, rules, [split])
    return out.select("rule_id", split, "violations", "violator_rate", "ci_low", "ci_high", "pass_rate", F.when(F.col("pass_rate") > 0, F.col("violator_rate") / F.col("pass_rate")).alias("lift"))
