"""Triage: evidence columns to reason codes, decisions and guarded proposals.

The evidence of a claim is one row: ``blocking`` (Boolean), ``risk_band``, ``fraud_probability``,
``warning_flags`` (count), ``record_fails`` and ``policy_fails`` (counts), ``unknown_checks``,
``k, frauds, neighbour_rate, base_rate`` of the neighbours, ``history_status``,
``history_contradiction``, ``strong_driver`` and ``tools_failed``.  Absent columns count as null.
Where it is known which sources were required, ``required_failed`` counts those of them that failed and ``open_sources`` those that are
not done (``with_sources`` gives both); else every failed tool counts as required.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

EVIDENCE = {
    "blocking": "boolean", "risk_band": "string", "fraud_probability": "double", "warning_flags": "long", "record_fails": "long", "policy_fails": "long",
    "unknown_checks": "long", "k": "long", "frauds": "long", "neighbour_rate": "double", "base_rate": "double", "history_status": "string",
    "history_contradiction": "boolean", "strong_driver": "boolean", "tools_failed": "long", "simulated": "boolean",
    "required_failed": "long", "open_sources": "long",
}
FLAG, INFO, OK = "FLAG_FOR_INVESTIGATION", "REQUEST_MORE_INFORMATION", "APPROVE"


def with_evidence(df: DataFrame) -> DataFrame:
    out = df.withColumns({c: F.lit(None).cast(t) for c, t in EVIDENCE.items() if c not in df.columns and c != "required_failed"})
    return out if "required_failed" in df.columns else out.withColumn("required_failed", F.col("tools_failed"))


def with_sources(df: DataFrame, statuses: str, required: Sequence[str]) -> DataFrame:
    """``tools_failed, required_failed`` and ``open_sources`` from a map ``statuses`` (source -> status)."""
    have = lambda s: F.coalesce(F.try_element_at(F.col(statuses), s), F.lit("not_run"))
    wanted = F.array(*[F.lit(s) for s in required]).cast("array<string>")
    count = lambda found: F.size(found).cast("long")
    return df.withColumns({
        "tools_failed": count(F.filter(F.map_values(statuses), lambda s: s == "failed")), "required_failed": count(F.filter(wanted, lambda s: have(s) == "failed")),
        "open_sources": count(F.filter(wanted, lambda s: ~have(s).isin("completed", "partial", "unavailable"))),
    })


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _some(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) > 0


def _listed(*parts: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(_true(c), F.lit(t)) for c, t in parts]))


def tool_status(ok: Column, status: Column) -> Column:
    """not_run (null), failed, or its own status, where found means completed."""
    own = F.coalesce(status, F.lit("completed"))
    return F.when(ok.isNull(), "not_run").when(~ok, "failed").when(own == "found", "completed").otherwise(own)


def similar_elevated() -> Column:
    base = F.when(F.coalesce("base_rate", F.lit(0.0)) != 0, F.col("base_rate")).otherwise(F.lit(1.0))  # unknown: as if all were
    return _true((F.col("frauds") >= 2) & (F.coalesce("neighbour_rate", F.lit(0.0)) >= 2 * base))


def conflicts() -> Column:
    """Evidence that disagrees, as a list."""
    enough = F.col("k") >= 5
    rate, base = (F.coalesce(c, F.lit(0.0)) for c in ("neighbour_rate", "base_rate"))
    return _listed(
        ((F.col("risk_band") == "high") & enough & (rate <= base), "high band, neighbours at or below base"),
        ((F.col("risk_band") == "low") & enough & (rate >= 0.4), "low band, neighbours elevated"),
        ((F.col("risk_band") == "low") & _some("warning_flags"), "low band, warning flags"),
        (F.col("risk_band").isin("low", "medium") & _some("policy_fails"), "band below high, policy failed"),
        (F.col("history_contradiction"), "history contradicts the claim"),
    )


def missing_information() -> Column:
    return _listed(
        (F.col("blocking"), "valid claim fields"),
        (F.col("risk_band").isNull(), "fraud score"),
        (_some("unknown_checks"), "policy terms"),
        (F.coalesce(F.col("history_status"), F.lit("unavailable")) == "unavailable", "claim history"),
        (F.col("k").isNull(), "similar claims"),
    )


def completeness() -> Column:
    """Share of the five sources that are there, and the state of the investigation."""
    have = [F.col("blocking").isNotNull(), F.col("risk_band").isNotNull(), F.col("unknown_checks").isNotNull(), F.col("k").isNotNull(), F.coalesce(F.col("history_status") != "unavailable", F.lit(False))]
    return sum((h.cast("double") for h in have), F.lit(0.0)) / len(have)


def investigation_status() -> Column:
    return F.when(_true(F.col("blocking")), "blocked").when(F.coalesce(F.col("open_sources") > 0, _some("tools_failed") | F.col("risk_band").isNull()), "incomplete").otherwise("complete")


def fraud_evidence() -> Column:
    """A signal beyond the band: always when high, in the medium band only a contradicting
    history, in the low band also warning flags and neighbours."""
    history = _true(F.col("history_contradiction"))
    return F.when((F.col("risk_band") == "high") | history, True).when(F.col("risk_band") == "medium", False).otherwise((F.col("risk_band").isNotNull() & _some("warning_flags")) | similar_elevated())


def flag_category() -> Column:
    return (
        F.when(F.col("risk_band") == "high", "FRAUD_RISK").when(F.col("risk_band").isNull(), "SYSTEM_FAILURE").when(fraud_evidence(), "FRAUD_RISK")
        .when(_some("policy_fails"), "POLICY_CONDITION").when(_some("required_failed"), "SYSTEM_FAILURE").otherwise("FRAUD_RISK")
    )


def decide(df: DataFrame) -> DataFrame:
    """The rule-based ``decision`` and ``category`` of each claim."""
    e = with_evidence(df)
    asks = _true(F.col("blocking")) | _some("record_fails")
    category = F.when(asks, None).when(F.col("risk_band").isNull(), "SYSTEM_FAILURE").when(F.col("risk_band") == "high", "FRAUD_RISK").when(_some("policy_fails"), "POLICY_CONDITION").when(_some("required_failed"), "SYSTEM_FAILURE")
    e = e.withColumn("category", category)
    return e.withColumn("decision", F.when(asks, INFO).when(F.col("category").isNotNull(), FLAG).otherwise(OK))


def model_only(df: DataFrame) -> DataFrame:
    """The same with nothing but validation and score."""
    keep = {"blocking", "risk_band", "fraud_probability"}
    return decide(df.drop(*[c for c in EVIDENCE if c not in keep]))


def reason_codes(decision: Column) -> Column:
    """Codes in their fixed order; a clean approval says so."""
    band = F.col("risk_band")
    codes = _listed(
        (F.col("blocking"), "BLOCKING_VALIDATION"), (band == "high", "HIGH_MODEL_RISK"), (band == "medium", "MEDIUM_MODEL_RISK"), (band == "low", "LOW_MODEL_RISK"),
        (band.isNotNull() & _some("warning_flags"), "RED_FLAGS_PRESENT"), (band.isNull(), "MODEL_SCORE_UNAVAILABLE"), (_some("record_fails"), "CLAIM_RECORD_CONTRADICTION"),
        (_some("policy_fails"), "POLICY_CONDITION_FAILED"), (_some("unknown_checks"), "POLICY_TERMS_UNVERIFIED"), (_some("k") & similar_elevated(), "SIMILAR_CLAIMS_ELEVATED_FRAUD"),
        (_some("k") & ~similar_elevated() & (F.col("frauds") == 0), "SIMILAR_CLAIMS_NO_FRAUD"), (band.isin("medium", "high") & _true(F.col("strong_driver")), "STRONG_SHAP_DRIVER"),
        (F.col("history_status") == "unavailable", "CLAIM_HISTORY_UNAVAILABLE"), (F.col("history_contradiction"), "HISTORY_CONTRADICTION"), (F.size(conflicts()) > 0, "CONFLICTING_EVIDENCE"),
        (_some("tools_failed"), "TOOL_FAILURE"), (investigation_status() == "incomplete", "INCOMPLETE_INVESTIGATION"), (F.col("simulated"), "SIMULATED_DATA_USED"),
    )
    harmless = F.array(*[F.lit(c) for c in ("LOW_MODEL_RISK", "POLICY_TERMS_UNVERIFIED", "SIMILAR_CLAIMS_NO_FRAUD", "CLAIM_HISTORY_UNAVAILABLE", "SIMULATED_DATA_USED")])
    clean = (decision == OK) & (F.size(F.array_except(codes, harmless)) == 0)
    return F.concat(codes, F.when(clean, F.array(F.lit("NO_MATERIAL_CONCERNS"))).otherwise(F.array().cast("array<string>")))


def triage(df: DataFrame, key: str) -> DataFrame:
    """The recommendation row of each claim."""
    d = decide(df)
    return d.select(key, "decision", F.col("category").alias("flag_category"), "fraud_probability", "risk_band", investigation_status().alias("investigation_status"), completeness().alias("completeness"), F.array_join(reason_codes(F.col("decision")), ",").alias("reason_codes"), F.array_join(conflicts(), "; ").alias("conflicts"), F.array_join(missing_information(), "; ").alias("missing"))


# Codes that are no risk signal of their own, and those that justify a flag in the medium band.
LOW_RISK_CODES = ("LOW_MODEL_RISK", "POLICY_TERMS_UNVERIFIED", "CLAIM_HISTORY_UNAVAILABLE", "SIMILAR_CLAIMS_NO_FRAUD", "SIMULATED_DATA_USED", "NO_MATERIAL_CONCERNS")
MEDIUM_BAND_CODES = ("POLICY_CONDITION_FAILED", "CLAIM_RECORD_CONTRADICTION", "HISTORY_CONTRADICTION")


def apply_guardrails(df: DataFrame, proposed: str = "proposed", concrete: Sequence[str] = MEDIUM_BAND_CODES) -> DataFrame:
    """Correct proposed decisions in a fixed order: ``decision, category`` and ``interventions`` (names in
    the order in which they applied).

    No proposal, or one that is not allowed, gives way to the rule-based decision, and so do a request
    without a claim-level reason and a fraud flag that rests on no risk signal.  A category that a
    step sets stays; a flag without one gets ``flag_category``.
    """
    e = decide(df).withColumnsRenamed({"decision": "_rule", "category": "_rule_category"})
    label = F.regexp_replace(F.upper(F.trim(F.col(proposed))), "[ -]", "_")
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in S.DECISION_ALIASES.items() for x in kv]), label), label)
    e = e.withColumns({"decision": label, "category": F.lit(None).cast("string"), "interventions": F.array().cast("array<string>")})
    now, rule, none = F.col("decision"), (F.col("_rule"), F.col("_rule_category")), F.lit(None).cast("string")
    blocked, grounds = _true(F.col("blocking")), _true(F.col("blocking")) | _some("record_fails")
    flagged = lambda name: (F.lit(FLAG), F.lit(name))
    codes = reason_codes(now)
    baseless = (F.size(F.array_except(codes, F.array(*map(F.lit, LOW_RISK_CODES)))) == 0) | ((F.col("risk_band") == "medium") & ~F.arrays_overlap(codes, F.array(*map(F.lit, concrete))))
    steps = [
        ("fallback", now.isNull(), rule),
        ("allowed_decisions", ~now.isin(*S.DECISIONS), rule),
        ("blocking_validation", blocked & (now != INFO), (F.lit(INFO), none)),
        ("request_info_not_claim_level", (now == INFO) & ~grounds, rule),
        ("high_risk_not_approve", (now == OK) & (F.col("risk_band") == "high"), flagged("FRAUD_RISK")),
        ("approve_needs_score", (now == OK) & F.col("risk_band").isNull(), flagged("SYSTEM_FAILURE")),
        ("approve_needs_consistent_claim", (now == OK) & _some("record_fails"), (F.lit(INFO), none)),
        ("approve_needs_policy_pass", (now == OK) & _some("policy_fails"), flagged("POLICY_CONDITION")),
        ("approve_needs_tools", (now == OK) & _some("required_failed"), flagged("SYSTEM_FAILURE")),
        (None, (now == FLAG) & F.col("category").isNull(), (now, flag_category())),
        ("unsupported_fraud_flag", (now == FLAG) & (F.col("category") == "FRAUD_RISK") & baseless, rule),
    ]
    for name, applies, (decision, category) in steps:
        e = e.withColumn("_hit", _true(applies))
        change = {"decision": F.when(F.col("_hit"), decision).otherwise(now), "category": F.when(F.col("_hit"), category).otherwise(F.col("category"))}
        if name:
            change["interventions"] = F.when(F.col("_hit"), F.concat("interventions", F.array(F.lit(name)))).otherwise(F.col("interventions"))
        e = e.withColumns(change)
    return e.withColumn("category", F.when(now == FLAG, F.col("category"))).drop("_hit", "_rule", "_rule_category")


def source_summary(df: DataFrame, statuses: str, required: Sequence[str], blocking: str) -> DataFrame:
    """Completeness over the required sources, from a map ``statuses`` (source -> status): ``completed``
    (sorted), ``fraction`` (to 3 places), ``investigation_status`` and ``gaps`` (sources that were not
    run or failed).  A source is done if it completed, in part or not at all for want of data."""
    have = lambda s: F.coalesce(F.try_element_at(F.col(statuses), s), F.lit("not_run"))
    wanted = F.array(*[F.lit(s) for s in sorted(required)])
    done = F.filter(wanted, lambda s: have(s).isin("completed", "partial", "unavailable"))
    gaps = F.concat(F.transform(F.filter(wanted, lambda s: have(s) == "not_run"), lambda s: F.concat(s, F.lit(" was not run"))), F.transform(F.array_sort(F.map_keys(F.map_filter(F.col(statuses), lambda k, v: v == "failed"))), lambda s: F.concat(s, F.lit(" failed"))))
    out = df.withColumns({"completed": done, "gaps": gaps})
    share = F.round(F.size("completed") / len(required), 3) if required else F.lit(1.0)
    status = F.when(_true(F.col(blocking)), "blocked").when(F.size("completed") < len(required), "incomplete").otherwise("complete")
    return out.withColumns({"fraction": share, "investigation_status": status})


def label_simulated(fact: Column, simulated: Column, label: str = "simulated reference data", most: int = 400) -> Column:
    """Facts drawn from simulated data say so at their end, within ``most`` characters."""
    mark = f" ({label})"
    return F.when(_true(simulated) & ~F.contains(F.lower(fact), F.lit(label)), F.concat(F.substring(fact, 1, most - len(mark)), F.lit(mark))).otherwise(fact)


# Words with which a fact may cite a source whose data are unavailable.
ABSENCE = r"(?i)unavailable|not available|no (?:authori[sz]ed|linked)|cannot|could not|unknown|not (?:configured|recorded|on file)|missing"
NUMBER = r"(?<![\w.])\d+(?:\.\d+)?"


def grounded_facts(facts: DataFrame, sources: DataFrame, key: str, source_columns: Sequence[str]) -> DataFrame:
    """Facts (``key, source, fact``) with ``grounded``, from one struct column for each source.

    The source must have run (its field ``ok`` is true); one whose ``status`` is unavailable grounds only words of absence.  Every
    number of the fact must occur in the source's JSON: rounded to the decimals that the fact states, or a percentage as its
    fraction (two decimals more), or a fraction as its percentage (two decimals less).  Every rule or flag id must occur too.
    Facts on an absent source are not grounded.
    """
    fields = {c: set(sources.schema[c].dataType.names) for c in source_columns}
    ran = lambda c: F.coalesce(F.col(f"{c}.ok"), F.lit(False)) if "ok" in fields[c] else F.lit(False)
    status = lambda c: F.col(f"{c}.status").cast("string") if "status" in fields[c] else F.lit(None).cast("string")
    cells = [F.struct(F.lit(c).alias("source"), F.to_json(c).alias("_json"), ran(c).alias("_ran"), status(c).alias("_status")) for c in source_columns]
    long = sources.select(key, F.explode(F.array(*cells)).alias("s")).select(key, "s.*")
    met = facts.join(long, [key, "source"], "left")
    have = F.transform(F.regexp_extract_all("_json", F.lit(f"({NUMBER})"), 1), lambda x: x.cast("double"))

    def known(n: Column) -> Column:
        percent, text = F.endswith(n, F.lit("%")), F.regexp_replace(n, "%", "")
        value, decimals = text.cast("double"), F.when(F.contains(text, F.lit(".")), F.length(F.substring_index(text, ".", -1))).otherwise(0)
        places = lambda x, d: F.floor(x * F.pow(F.lit(10.0), d) + 0.5)
        near = lambda v, d: F.exists(have, lambda x: places(x, d) == places(v, d))
        as_fraction = percent & near(value / 100, decimals + 2)
        as_percent = ~percent & (value <= 1) & (decimals > 0) & near(value * 100, F.greatest(decimals - 2, F.lit(0)))
        return near(value, decimals) | as_fraction | as_percent

    numbers = F.regexp_extract_all("fact", F.lit(f"({NUMBER}%?)"), 1)
    ids = F.regexp_extract_all("fact", F.lit(r"\b((?:RF\d{2}|V\d{2}B?)(?:_[A-Z0-9_]+)?)\b"), 1)
    named = F.forall(ids, lambda i: F.contains(F.col("_json"), i))
    there = _true(F.col("_ran")) & (~_true(F.col("_status") == "unavailable") | F.col("fact").rlike(ABSENCE))
    return met.withColumn("grounded", there & F.forall(numbers, known) & named).drop("_json", "_ran", "_status")


def factor_report(df: DataFrame, factors: Sequence[str], label: str) -> DataFrame:
    """Per Boolean factor: share with it, and the positive rate with (and its interval) and without."""
    from ..functions import columns as C
    from .rules import unpivot

    long = unpivot(df, factors, [label], "factor", "present", "boolean")
    on = F.coalesce(F.col("present"), F.lit(False))
    out = long.groupBy("factor").agg(F.count("*").alias("n"), F.count_if(on).alias("n_with"), F.count_if(on & (F.col(label) == 1)).alias("pos_with"), F.avg(F.when(~on, F.col(label))).alias("rate_without"))
    low, high = C.wilson(F.col("pos_with"), F.col("n_with"))
    return out.select("factor", "n", "n_with", F.when(F.col("n_with") > 0, F.col("pos_with") / F.col("n_with")).alias("rate_with"), low.alias("ci_low"), high.alias("ci_high"), "rate_without")
