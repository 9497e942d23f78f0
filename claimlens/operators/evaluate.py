"""Evaluation of recommendations, the audit store's reports, and samples for review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .metrics import exact_percentiles, safe_ratio
from .model import stratum_numbers
from .rules import unpivot

FLAG, INFO, OK = "FLAG_FOR_INVESTIGATION", "REQUEST_MORE_INFORMATION", "APPROVE"


def stratified_sample(df: DataFrame, key: str, label: str, positives: int, ratio: int, seed: str = "k1") -> DataFrame:
    """``positives`` positive rows and ``ratio`` times as many negatives, with prevalence weights."""
    rows = stratum_numbers(df, key, [label], seed)
    quota = F.when(F.col(label) == 1, positives).otherwise(positives * ratio)
    return rows.where(F.col("_row") <= quota).withColumn("weight", F.col("_size") / F.least(F.col("_size"), quota)).drop("_row", "_size")


def band_sample(df: DataFrame, key: str, band: str, label: str, n: int, bands: Sequence[str] = ("medium", "high", "low"), seed: str = "k2") -> DataFrame:
    """About ``n`` rows over the bands (the remainder to the first bands), half positives and half
    negatives in each; what one label lacks the other tops up."""
    share = {b: n // len(bands) + (1 if i < n % len(bands) else 0) for i, b in enumerate(bands)}
    quota = F.try_element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col(band))
    rows = stratum_numbers(df.where(F.col(band).isin(list(bands))), key, [band, label], seed).withColumn("_q", quota)
    sizes = rows.groupBy(band).agg(F.max("_q").alias("_q"), F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_n"))
    half = F.ceil(F.col("_q") / 2)
    pos = F.least(F.col("_p"), F.greatest(half, F.col("_q") - F.col("_n")))
    sizes = sizes.select(band, pos.alias("_tp"), F.least(F.col("_n"), F.col("_q") - pos).alias("_tn"))
    out = rows.drop("_q").join(F.broadcast(sizes), band)
    return out.where(F.col("_row") <= F.when(F.col(label) == 1, F.col("_tp")).otherwise(F.col("_tn"))).drop("_row", "_size", "_tp", "_tn")


def open_runs(wanted: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that are not recorded yet."""
    return wanted.join(recorded.select(*keys).distinct(), list(keys), "left_anti")


def decision_quality(df: DataFrame, label: str, policies: dict[str, str], weight: str | None = None) -> DataFrame:
    """Per policy (name -> decision column): recall with interval, approval, false-flag and request
    rates, and precision in the sample and re-weighted to prevalence."""
    w = F.col(weight) if weight else F.lit(1.0)
    cells = [F.struct(F.lit(n).alias("policy"), F.col(c).alias("decision")) for n, c in policies.items()]
    long = df.select(F.col(label).alias("y"), w.alias("w"), F.explode(F.array(*cells)).alias("p")).select("y", "w", "p.*")
    flag, pos = F.col("decision") == FLAG, F.col("y") == 1
    out = long.groupBy("policy").agg(F.count("*").alias("n"), F.count_if(pos).alias("p"), F.count_if(~pos).alias("q"), F.count_if(flag & pos).alias("tp"), F.count_if(flag & ~pos).alias("fp"), F.avg((F.col("decision") == OK).cast("double")).alias("approve_rate"), F.avg((F.col("decision") == INFO).cast("double")).alias("info_rate"), F.coalesce(F.sum(F.when(flag & pos, F.col("w"))), F.lit(0.0)).alias("wtp"), F.coalesce(F.sum(F.when(flag, F.col("w"))), F.lit(0.0)).alias("wf"))
    low, high = C.wilson(F.col("tp"), F.col("p"))
    return out.select("policy", "n", safe_ratio(F.col("tp"), F.col("p")).alias("recall"), low.alias("recall_low"), high.alias("recall_high"), "approve_rate", safe_ratio(F.col("fp"), F.col("q")).alias("false_flag_rate"), "info_rate", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe_ratio(F.col("wtp"), F.col("wf")).alias("weighted_precision"))


def agreement_table(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of decision pairs with margins (``all``)."""
    out = df.select(F.col(a).alias("a"), F.col(b).alias("b")).cube("a", "b").agg(F.count("*").alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
    return out.select(F.when(F.col("ga") == 1, "all").otherwise(F.col("a")).alias("a"), F.when(F.col("gb") == 1, "all").otherwise(F.col("b")).alias("b"), "n")


def process_metrics(df: DataFrame, by: str, latency: str) -> DataFrame:
    """Runs, their share, and mean, median and 95 % latency."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.avg(latency).alias("mean")).join(exact_percentiles(df, latency, [0.5, 0.95], [by], ["p50", "p95"]), by, "left")
    return out.join(F.broadcast(df.agg(F.count("*").alias("_t")))).select(by, "n", (F.col("n") / F.col("_t")).alias("share"), "mean", "p50", "p95")


def process_report(runs: DataFrame, tools: Sequence[str], label: str = "label") -> DataFrame:
    """``metric, name, value`` over the first run of each claim (total cost over all runs): use of tools, reason codes, conflicts,
    flags by category and their true ones by band, steps, fallbacks, guardrails, grounding, latency, tokens and cost.

    ``runs`` have ``run_index, decision, flag_category, risk_band``, the label, the arrays ``tools_called, auto_tools, reason_codes, conflicts`` and
    ``interventions``, and ``error, agent_steps, max_steps_reached, decided_by, llm_failures, grounding_removed, n_evidence, latency_s,
    input_tokens, output_tokens, cost_usd``.  A null array is empty.
    """
    first = runs.where("run_index = 0")
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    rate = lambda c: F.avg(c.cast("double"))
    num = lambda c: F.col(c).cast("double")
    whole = {
        "claims": F.count("*"), "errors": F.count("error"), "claims_with_conflicts": F.count_if(F.size(some("conflicts")) > 0), "mean_tool_calls": F.avg(F.size(some("tools_called"))), "mean_agent_steps": F.avg("agent_steps"),
        "max_steps_hits": F.count_if(F.col("max_steps_reached")), "fallback_rate": rate(F.coalesce(F.col("decided_by") == "rule_fallback", F.lit(False))), "llm_failure_claims": F.count_if(F.col("llm_failures") > 0),
        "claims_with_grounding_removals": F.count_if(F.col("grounding_removed") > 0), "evidence_items_removed": F.sum("grounding_removed"), "mean_evidence_kept": F.avg("n_evidence"),
        "mean_input_tokens": F.avg("input_tokens"), "mean_output_tokens": F.avg("output_tokens"), "mean_cost_usd": F.avg("cost_usd"),
    }
    flag = F.col("decision") == FLAG
    use = {("tool_use_rate", t): rate(F.array_contains(some("tools_called"), t)) for t in tools} | {("auto_run_rate", t): rate(F.array_contains(some("auto_tools"), t)) for t in tools}
    cells = {(m, ""): c for m, c in whole.items()} | use
    row = first.agg(*[c.cast("double").alias(f"m{i}") for i, c in enumerate(cells.values())])
    spread = row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(n).alias("name"), F.col(f"m{i}").alias("value")) for i, (m, n) in enumerate(cells)])).alias("x")).select("x.*")
    named = [  # what occurs by name: one pass over all of it
        (F.lit(True), "reason_code_counts", some("reason_codes")), (F.lit(True), "guardrail_interventions", some("interventions")), (flag, "flag_categories", F.array("flag_category")),
        (flag & (F.col("flag_category") == "FRAUD_RISK"), "fraud_risk_flags_by_band", F.array("risk_band")), (flag & (F.col("flag_category") == "FRAUD_RISK") & (F.col(label) == 1), "fraud_risk_hits_by_band", F.array("risk_band")),
    ]
    under = lambda m: lambda x: F.struct(F.lit(m).alias("metric"), x.alias("name"))
    items = F.flatten(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.transform(names, under(m))).otherwise(F.array().cast("array<struct<metric:string,name:string>>")) for c, m, names in named]))
    counts = first.select(F.explode(items).alias("x")).where("x.name is not null").groupBy("x.metric", "x.name").agg(F.count("*").cast("double").alias("value"))
    late = exact_percentiles(first.withColumn("_all", F.lit(1)), "latency_s", [0.5, 0.95], ["_all"], ["latency_p50_s", "latency_p95_s"])
    late = late.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("").alias("name"), F.col(c).cast("double").alias("value")) for c in ("latency_p50_s", "latency_p95_s")])).alias("x")).select("x.*")
    cost = runs.agg(F.sum(num("cost_usd")).alias("value")).select(F.lit("total_cost_usd").alias("metric"), F.lit("").alias("name"), "value")
    return spread.unionByName(counts).unionByName(late).unionByName(cost)


def code_counts(df: DataFrame, codes: str) -> DataFrame:
    return df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def consistency(df: DataFrame, key: str, decision: str) -> DataFrame:
    """Keys with several runs, and how many of them always got one decision."""
    per = df.groupBy(key).agg(F.count("*").alias("runs"), F.count_distinct(decision).alias("k")).where("runs > 1")
    return per.agg(F.count("*").alias("n_keys"), F.count_if(F.col("k") == 1).alias("n_stable"), F.avg((F.col("k") == 1).cast("double")).alias("share"))


def unstable_keys(df: DataFrame, key: str, decision: str) -> DataFrame:
    """The keys with several runs that did not always get one decision: ``key, runs, decisions`` (sorted)."""
    per = df.groupBy(key).agg(F.count("*").alias("runs"), F.array_sort(F.collect_set(decision)).alias("d"))
    return per.where((F.col("runs") > 1) & (F.size("d") > 1)).select(key, "runs", F.array_join("d", ",").alias("decisions"))


def manual_review_sample(df: DataFrame, key: str, strata: Sequence[str], per: int, n: int, seed: str = "k8") -> DataFrame:
    """``per`` rows of each stratum, topped up in md5 order to ``n`` rows."""
    rows = stratum_numbers(df, key, strata, seed)
    order = [F.when(F.col("_row") <= per, 0).otherwise(1), F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    return rows.orderBy(*order).limit(n).drop("_row", "_size")


def policy_check_shares(df: DataFrame, checks: str) -> DataFrame:
    """Counts of results per check of a map column."""
    long = df.select(F.explode(checks).alias("check_id", "result"))
    return long.groupBy("check_id").agg(*[F.count_if(F.col("result") == r).alias(r.lower()) for r in ("PASS", "FAIL", "UNKNOWN")])


def compare_modes(left: DataFrame, right: DataFrame, key: str, decision: str) -> DataFrame:
    """Keys in both modes: counts of each change of decision, null-safe."""
    met = left.select(key, F.col(decision).alias("before")).join(right.select(key, F.col(decision).alias("after")), key)
    return met.where(~F.col("before").eqNullSafe(F.col("after"))).groupBy("before", "after").agg(F.count("*").alias("n"))


def changed_decisions(left: DataFrame, right: DataFrame, key: str, decision: str, category: str, checks: str, previous: str, other: str = "judgement") -> DataFrame:
    """``key, before, after, category_before, category_after, cause`` of the keys whose decision or category differs between two modes.

    The cause names the checks (a map of ``right``) that fail and the previous claims found; ``other`` where there
    are neither.  A null category counts as none and a key that only one mode holds is left out.
    """
    was = left.select(key, F.col(decision).alias("before"), F.coalesce(category, F.lit("")).alias("category_before"))
    now = right.select(key, F.col(decision).alias("after"), F.coalesce(category, F.lit("")).alias("category_after"), checks, previous)
    met = was.join(now, key).where(~F.col("before").eqNullSafe(F.col("after")) | (F.col("category_before") != F.col("category_after")))
    failed = F.array_sort(F.map_keys(F.map_filter(F.coalesce(checks, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda _, v: v == "FAIL")))
    found = F.when(F.col(previous) > 0, F.array(F.concat(F.col(previous).cast("long").cast("string"), F.lit(" previous claims")))).otherwise(F.array().cast("array<string>"))
    causes = F.concat(failed, found)
    return met.select(key, "before", "after", "category_before", "category_after", F.when(F.size(causes) > 0, F.array_join(causes, ", ")).otherwise(other).alias("cause"))


def mode_deltas(left: DataFrame, right: DataFrame, label: str, decision: str) -> DataFrame:
    """Recall, false-flag, approval and request rates under two modes, and right less left."""
    parts = left.select(label, F.lit("left").alias("mode"), decision).unionByName(right.select(label, F.lit("right").alias("mode"), decision))
    cells = {"recall": (F.col(label) == 1, FLAG), "false_flag_rate": (F.col(label) == 0, FLAG), "approve_rate": (F.lit(True), OK), "info_rate": (F.lit(True), INFO)}
    mean = lambda mode, on, what: F.avg(F.when((F.col("mode") == mode) & on, (F.col(decision) == what).cast("double")))
    row = parts.agg(*[mean(m, *cells[c]).alias(f"{c}_{m}") for c in cells for m in ("left", "right")])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_left").alias("left"), F.col(f"{c}_right").alias("right"), (F.col(f"{c}_right") - F.col(f"{c}_left")).alias("delta")) for c in cells])).alias("x")).select("x.*")


def flags_by_category(df: DataFrame, label: str, decision: str, category: str) -> DataFrame:
    """Flags of each category, and how many of them are true."""
    flags = df.where(F.col(decision) == FLAG)
    return flags.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"))


def judge_means(df: DataFrame, by: str, scores: Sequence[str]) -> DataFrame:
    """Rows and mean of every score column of existing judgements."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in scores])


def verification_rows(df: DataFrame, keys: Sequence[str], checks: str) -> DataFrame:
    """The audit store's long table: one row for each check of a map column ``checks``."""
    return df.select(*keys, F.explode(checks).alias("check_id", "result"))


def investigation_rows(df: DataFrame, keys: Sequence[str], statuses: str) -> DataFrame:
    """The audit store's table of investigations: one row for each source of a map column ``statuses`` that was run."""
    return df.select(*keys, F.explode(statuses).alias("source", "status"))


def usage(df: DataFrame, calls: str, columns: Sequence[str]) -> DataFrame:
    """Means over the runs that made calls."""
    return df.where(F.col(calls) > 0).agg(F.count("*").alias("n_runs"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def decision_shares(df: DataFrame, label: str, policies: dict[str, str], decisions: Sequence[str]) -> DataFrame:
    """Share of each decision by true label and policy; absent decisions are 0."""
    cells = [F.struct(F.lit(n).alias("policy"), F.col(c).alias("d")) for n, c in policies.items()]
    long = df.select(F.col(label).alias("label"), F.explode(F.array(*cells)).alias("p")).select("label", "p.*")
    out = long.groupBy("label", "policy").agg(F.count("*").alias("t"), *[F.count_if(F.col("d") == d).alias(d) for d in decisions])
    return out.select("label", "policy", F.explode(F.array(*[F.struct(F.lit(d).alias("decision"), (F.col(d) / F.col("t")).alias("share")) for d in decisions])).alias("x")).select("label", "policy", "x.*")


def accept_reviews(reviews: DataFrame, recommendations: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """Reviews (``review_id, run_id, decision, reason``) with ``status`` and ``overrides``.

    A decision must be known, an override needs a reason that is not blank, and a run is
    reviewed once: the first valid review counts, refused ones keep the run pending.
    """
    allowed = ["APPROVE", "DENY", FLAG, INFO]
    met = reviews.join(recommendations.select("run_id", F.col("decision").alias("recommended")), "run_id", "left")
    overrides = ~F.col("decision").eqNullSafe(F.col("recommended"))
    refusal = F.when(F.col("recommended").isNull(), "unknown run").when(~F.coalesce(F.col("decision").isin(allowed), F.lit(False)), "unknown decision").when(overrides & (F.length(F.trim(F.coalesce("reason", F.lit("")))) == 0), "override without reason")
    met = met.withColumns({"overrides": overrides, "refusal": refusal})
    if reviewed is not None:
        met = met.join(reviewed.select("run_id", F.lit(True).alias("_done")).distinct(), "run_id", "left").withColumn("refusal", F.coalesce("refusal", F.when(F.col("_done"), "already reviewed"))).drop("_done")
    first = F.row_number().over(Window.partitionBy(F.when(F.col("refusal").isNull(), F.col("run_id")), F.when(F.col("refusal").isNotNull(), F.col("review_id"))).orderBy("review_id"))  # a refused review is alone
    met = met.withColumn("_n", first)
    return met.withColumn("status", F.coalesce("refusal", F.when(F.col("_n") > 1, "already reviewed"), F.lit("accepted"))).drop("_n", "refusal", "recommended")


def pending(recommendations: DataFrame, reviewed: DataFrame) -> DataFrame:
    return recommendations.join(reviewed.select("run_id"), "run_id", "left_anti")


def latest(df: DataFrame, order: str, n: int, tie: str) -> DataFrame:
    """The newest n rows: a top-k, not a sort."""
    return df.orderBy(F.desc(order), tie).limit(n)


def kpis(df: DataFrame, decision: str, overrides: str) -> DataFrame:
    d = F.col(decision)
    return df.agg(F.count("*").alias("investigations"), F.avg((d == FLAG).cast("double")).alias("flag_rate"), F.avg((d == OK).cast("double")).alias("approval_rate"), F.count_if(F.col(overrides)).alias("overrides"))


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return unpivot(df, columns, [], kind="string").groupBy("column", "value").agg(F.count("*").alias("n"))


def history_listing(df: DataFrame, decision: str, decisions: Sequence[str], overrides: str, only_overrides: bool, order: str, tie: str, n: int) -> DataFrame:
    out = df.where(F.col(decision).isin(list(decisions)))
    out = out.where(F.col(overrides)) if only_overrides else out
    return latest(out, order, n, tie)
