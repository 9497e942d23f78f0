"""Declarative rules over claims: every check is one Boolean Column, all of them one pass.

A check whose inputs are null passes, except the one for required fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C

SEVERITIES, TYPES = ("blocking", "warning", "info"), ("validation", "consistency", "red_flag")


def passes(bad: Column) -> Column:
    return ~F.coalesce(bad, F.lit(False))


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    check: Callable[[], Column]
    message: str = ""
    type: str = "consistency"


@dataclass(frozen=True)
class RedFlag:
    id: str
    severity: str
    when: Mapping[str, Sequence] = field(default_factory=dict)


# Orders and lower bounds that the checks compare.
POLICY_DAYS = ["none", "1 to 7", "8 to 15", "15 to 30", "more than 30"]
VEHICLE_YEARS = {"new": 0, "2 years": 2, "3 years": 3, "4 years": 4, "5 years": 5, "6 years": 6, "7 years": 7, "more than 7": 8}
ALIAS = {"PolicyType": "Sedan - Liability", "VehicleCategory": "Sport", "BasePolicy": "Liability"}


def domain_ok(name: str) -> Column:
    c = F.col(name)
    if name == "Age":
        inside = (c == 0) | c.between(16, 100)
    elif name in S.INTEGERS:
        inside = c.isin(S.INTEGERS[name]) if S.INTEGERS[name] else F.lit(True)
    else:
        inside = c.isin(S.DOMAINS[name])
    return F.coalesce(inside, F.lit(True))


#: What several checks compare.  ``run_rules`` computes each once as a column of the table; elsewhere it is an expression.
SHARED: dict[str, Callable[[], Column]] = {
    "_lag": lambda: C.lag_months(F.col("Month"), F.col("MonthClaimed")), "_alias": lambda: F.coalesce(C.all_of([F.col(k) == v for k, v in ALIAS.items()]), F.lit(False)),
    "_to_accident": lambda: C.place(F.col("Days_Policy_Accident"), POLICY_DAYS), "_to_claim": lambda: C.place(F.col("Days_Policy_Claim"), POLICY_DAYS),
    "_young": lambda: F.col("Age").isNotNull() & (F.col("Age") != 0) & (F.col("Age") <= 20),
}
_as_columns: list[bool] = []


def shared(name: str) -> Column:
    return F.col(name) if _as_columns else SHARED[name]()


@contextmanager
def shared_columns():
    """Within it the checks read what they share from the columns of the table."""
    _as_columns.append(True)
    try:
        yield
    finally:
        _as_columns.pop()


def _lag() -> Column:
    return shared("_lag")


def _alias() -> Column:
    return shared("_alias")


def _mismatch() -> Column:
    return F.coalesce(F.concat("VehicleCategory", F.lit(" - "), "BasePolicy") != F.col("PolicyType"), F.lit(False))


def _in(name: str, values: Sequence) -> Column:
    return F.coalesce(F.col(name).isin(list(values)), F.lit(False))


def _young() -> Column:
    return shared("_young")


def _years() -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in VEHICLE_YEARS.items() for x in kv]), F.col("AgeOfVehicle"))


RULES: tuple[Rule, ...] = (
    Rule("V01_REQUIRED_FIELDS", "blocking", lambda: C.all_of([F.col(c).isNotNull() for c in S.COLUMNS]), "Missing fields: {missing_fields}.", "validation"),
    Rule("V02_DOMAIN_VALUES", "blocking", lambda: C.all_of([domain_ok(c) for c in S.COLUMNS]), "Values outside the known sets: {invalid_values}.", "validation"),
    Rule("V03_AGE_MISSING", "blocking", lambda: passes(F.col("Age") == 0), "Age is not recorded.", "validation"),
    Rule("V04_AGE_HOLDER_BIN", "warning", lambda: F.coalesce(C.holder_bin(F.col("Age")) == F.col("AgeOfPolicyHolder"), F.lit(True)), "Age {Age} implies holder bin {expected_holder_bin}, recorded is {AgeOfPolicyHolder}."),
    Rule("V05_POLICYTYPE_CONSISTENT", "warning", lambda: ~(_mismatch() & ~_alias()), "Policy type {PolicyType} disagrees with {VehicleCategory} and {BasePolicy}."),
    Rule("V05B_POLICYTYPE_KNOWN_ALIAS", "info", lambda: ~_alias(), "Known labelling quirk: {PolicyType} for a {VehicleCategory}."),
    Rule("V06_CLAIM_AFTER_ACCIDENT", "warning", lambda: passes((_lag() == 0) & (F.col("WeekOfMonthClaimed") < F.col("WeekOfMonth"))), "Claimed in week {WeekOfMonthClaimed} of {MonthClaimed}, accident in week {WeekOfMonth} of {Month}."),
    Rule("V07_REPORTING_DELAY", "info", lambda: passes(_lag() >= 6), "Accident in {Month}, claim in {MonthClaimed}: six months or more."),
    Rule("V08_EARLY_POLICY_INCIDENT", "warning", lambda: ~(_in("Days_Policy_Accident", ["none", "1 to 7"]) | _in("Days_Policy_Claim", ["none"])), "Incident at the start of the policy: {Days_Policy_Accident} and {Days_Policy_Claim} days."),
    Rule("V09_POLICY_DAYS_ORDER", "warning", lambda: passes(shared("_to_claim") < shared("_to_accident")), "Days to claim {Days_Policy_Claim} are fewer than days to accident {Days_Policy_Accident}."),
    Rule("V10_POLICY_DAYS_VS_LAG", "warning", lambda: passes(_in("Days_Policy_Claim", ["none", "8 to 15", "15 to 30"]) & (_lag() >= 2)), "Claim {Days_Policy_Claim} days into the policy, yet {Month} to {MonthClaimed}."),
    Rule("V11_VEHICLE_VS_DRIVER_AGE", "info", lambda: passes(_young() & (_years() > F.col("Age") - 16)), "Holder aged {Age} with a vehicle aged {AgeOfVehicle}."),
    Rule("V12_YOUNG_HOLDER_HISTORY", "info", lambda: passes(_young() & (_in("PastNumberOfClaims", ["more than 4"]) | _in("NumberOfCars", ["5 to 8", "more than 8"]))), "Holder aged {Age} with {PastNumberOfClaims} claims and {NumberOfCars}."),
)

# The shipped red flags.
RED_FLAGS: tuple[RedFlag, ...] = (
    RedFlag("RF01_PH_FAULT_ALL_PERILS", "warning", {"Fault": ["Policy Holder"], "BasePolicy": ["All Perils"]}),
    RedFlag("RF02_PH_FAULT_COLLISION", "info", {"Fault": ["Policy Holder"], "BasePolicy": ["Collision"]}),
    RedFlag("RF03_DEDUCTIBLE_500", "info", {"Deductible": [500]}),
    RedFlag("RF04_THIRD_PARTY_DEDUCTIBLE_500", "warning", {"Fault": ["Third Party"], "Deductible": [500]}),
    RedFlag("RF05_ADDRESS_CHANGE_2_3Y", "warning", {"AddressChange_Claim": ["2 to 3 years"]}),
    RedFlag("RF07_EARLY_POLICY_INCIDENT", "warning", {"Days_Policy_Accident": ["none", "1 to 7"]}),
    RedFlag("RF08_MISSING_AGE_ALL_PERILS", "warning", {"Age": [0], "BasePolicy": ["All Perils"]}),
    RedFlag("RF09_YOUNG_HOLDER_AT_FAULT", "info", {"Age": [16, 17, 18, 19, 20], "Fault": ["Policy Holder"]}),
    RedFlag("RF10_SPORT_COLLISION", "info", {"VehicleCategory": ["Sport"], "BasePolicy": ["Collision"]}),
    RedFlag("RF11_SEDAN_PRICE_EXTREME", "info", {"VehicleCategory": ["Sedan"], "VehiclePrice": ["less than 20000", "more than 69000"]}),
    RedFlag("RF12_UTILITY_ALL_PERILS", "info", {"VehicleCategory": ["Utility"], "BasePolicy": ["All Perils"]}),
    RedFlag("RF13_MAKE_ACCURA", "info", {"Make": ["Accura"]}),
)
WEIGHTS = {"warning": 2, "info": 1}


def check_catalogue(rules: Sequence[Rule] = RULES, flags: Sequence[RedFlag] = RED_FLAGS, columns: Sequence[str] = S.COLUMNS) -> None:
    """Refuse repeated ids, unknown severities or types, rules without a check and flags on
    columns that do not exist."""
    ids = [r.id for r in rules] + [f.id for f in flags]
    if len(ids) != len(set(ids)):
        raise ValueError("rule ids repeat")
    for r in rules:
        if r.severity not in SEVERITIES or r.type not in TYPES or not callable(r.check):
            raise ValueError(f"bad rule {r.id}")
    for f in flags:
        if f.severity not in SEVERITIES or not f.when or set(f.when) - set(columns):
            raise ValueError(f"bad red flag {f.id}")


def catalogue(spark, rules: Sequence[Rule] = RULES, flags: Sequence[RedFlag] = RED_FLAGS) -> DataFrame:
    rows = [(r.id, r.type, r.severity, r.message) for r in rules] + [(f.id, "red_flag", f.severity, "") for f in flags]
    return spark.createDataFrame(rows, "rule_id string, type string, severity string, message string")


def run_rules(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The table with one Boolean column per rule: true where it passes."""
    with shared_columns():
        return df.withColumns({n: c() for n, c in SHARED.items()}).withColumns({r.id: r.check() for r in rules}).drop(*SHARED)


def _message(rule: Rule, columns: Sequence[str]) -> Column:
    """The message with the claim's values; an unknown placeholder or null value gives ``?``."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", rule.message)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece == "missing_fields":
            parts.append(F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns if c in S.COLUMNS])), ", "))
        elif piece == "invalid_values":
            parts.append(F.array_join(F.array_compact(F.array(*[F.when(~domain_ok(c), F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in columns if c in S.COLUMNS])), ", "))
        elif piece == "expected_holder_bin":
            parts.append(F.coalesce(C.holder_bin(F.col("Age")), F.lit("?")))
        elif piece in columns:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("?")))
        else:
            parts.append(F.lit("?"))
    return F.concat(*parts)


def validate(df: DataFrame, id_column: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Long form: ``claim_id, rule_id, severity, passed, message`` (null where it passes).

    Results are unpivoted first, so a message is put together only in the row of its rule, and only where that fails.
    """
    df = run_rules(df, rules)
    cells = [F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.col(r.id).alias("passed")) for r in rules]
    long = df.select("*", F.col(id_column).alias("_id"), F.posexplode(F.array(*cells)).alias("_place", "_r"))
    message = reduce(lambda done, x: done.when(F.col("_place") == x[0], _message(x[1], df.columns)), enumerate(rules), F.when(F.lit(False), ""))
    return long.select(F.col("_id").alias("claim_id"), "_r.*", F.when(~F.col("_r.passed"), message).alias("message"))


def blocking_failures(df: DataFrame, rules: Sequence[Rule] = RULES) -> Column:
    """True where a blocking rule fails (on the result of ``run_rules``)."""
    return ~C.all_of([F.col(r.id) for r in rules if r.severity == "blocking"])


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str], name: str = "column", value: str = "value", kind: str | None = None) -> DataFrame:
    """Long form by one generator: no scan for each column."""
    cells = [F.struct(F.lit(c).alias(name), (F.col(c).cast(kind) if kind else F.col(c)).alias(value)) for c in columns]
    return df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, f"_c.{name}", f"_c.{value}")


def rule_hit_summary(df: DataFrame, target: str, rules: Sequence[Rule] = RULES, by: Sequence[str] = ()) -> DataFrame:
    """Per rule (and ``by``): rows, violations, their share, and the target's rate among
    violators and passers with the violators' Wilson interval."""
    long = unpivot(run_rules(df, rules), [r.id for r in rules], [*by, target], "rule_id", "passed")
    bad = ~F.col("passed")
    out = long.groupBy("rule_id", *by).agg(F.count("*").alias("n"), F.count_if(bad).alias("violations"), F.count_if(bad & (F.col(target) == 1)).alias("bad_positives"), F.avg(F.when(F.col("passed"), F.col(target))).alias("pass_rate"))
    low, high = C.wilson(F.col("bad_positives"), F.col("violations"))
    rate = F.when(F.col("violations") > 0, F.col("bad_positives") / F.col("violations"))
    return out.select("rule_id", *by, "n", "violations", (100 * F.col("violations") / F.col("n")).alias("violation_pct"), rate.alias("violator_rate"), low.alias("ci_low"), high.alias("ci_high"), "pass_rate")


def condition_mask(when: Mapping[str, Sequence]) -> Column:
    """True where every column holds one of its values; null is no match."""
    return C.all_of([F.coalesce(F.col(c).isin(list(v)), F.lit(False)) for c, v in when.items()])


def red_flag_frame(df: DataFrame, flags: Sequence[RedFlag] = RED_FLAGS) -> DataFrame:
    return df.withColumns({f.id: condition_mask(f.when) for f in flags})


def fired_flags(flags: Sequence[RedFlag] = RED_FLAGS) -> Column:
    """The flags that fire, as an array of ``rule_id, severity``."""
    return F.array_compact(F.array(*[F.when(condition_mask(f.when), F.struct(F.lit(f.id).alias("rule_id"), F.lit(f.severity).alias("severity"))) for f in flags]))


def red_flag_score(flags: Sequence[RedFlag] = RED_FLAGS) -> Column:
    return sum((C.flag(condition_mask(f.when)) * WEIGHTS[f.severity] for f in flags), F.lit(0)).cast("long")


def consistency_failures(rules: Sequence[Rule] = RULES) -> Column:
    """Number of consistency rules that fail, without the known alias."""
    return sum((C.flag(~r.check()) for r in rules if r.type == "consistency" and r.id != "V05B_POLICYTYPE_KNOWN_ALIAS"), F.lit(0)).cast("long")


def red_flag_stats(df: DataFrame, target: str, by: str, flags: Sequence[RedFlag] = RED_FLAGS) -> DataFrame:
    """Per flag and ``by``: n, support %, rate with Wilson interval, lift and recall."""
    long = unpivot(red_flag_frame(df, flags), [f.id for f in flags], [by, target], "flag", "fired")
    fired = F.col("fired")
    out = long.groupBy("flag", by).agg(F.count("*").alias("rows"), F.sum(target).alias("positives"), F.count_if(fired).alias("n"), F.count_if(fired & (F.col(target) == 1)).alias("hits"))
    low, high = C.wilson(F.col("hits"), F.col("n"))
    rate = F.when(F.col("n") > 0, F.col("hits") / F.col("n"))
    return out.select("flag", by, "n", (100 * F.col("n") / F.col("rows")).alias("support_pct"), rate.alias("rate"), low.alias("ci_low"), high.alias("ci_high"), (rate / (F.col("positives") / F.col("rows"))).alias("lift"), F.when(F.col("positives") > 0, F.col("hits") / F.col("positives")).alias("recall"))
