"""Queries over the claim and case views: ingestion, rules, features, profiles, associations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..operators import assoc, profile, rules
from ..sources import adapters as A
from ..sources import ingest
from .registry import query

CASES, CLAIMS = f"cases AS ({A.CASES_SQL})", f"claims AS ({A.CLAIMS_SQL})"
Z = C.Z95
CATS = ["priority", "segment", "nation"]
CL = ["Fault", "BasePolicy", "VehicleCategory", "AddressChange_Claim", "Make"]


def wilson(k: str, n: str) -> tuple[str, str]:
    """The interval as SQL text."""
    p, z2 = f"({k} * 1.0::DOUBLE / {n})", Z * Z
    half = f"({Z} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0::DOUBLE * {n} * {n})))"
    return tuple(f"CASE WHEN {n} > 0 THEN {f}({b}, ({p} + {z2} / (2.0::DOUBLE * {n}) {s} {half}) / (1 + {z2} / {n}::DOUBLE)) END" for f, b, s in (("greatest", "0.0::DOUBLE", "-"), ("least", "1.0::DOUBLE", "+")))


def long(columns, keys, table="cases", name="column") -> str:
    return " UNION ALL ".join(f"SELECT {''.join(k + ', ' for k in keys)}'{c}' AS \"{name}\", CAST({c} AS VARCHAR) AS value FROM {table}" for c in columns)


def r6(df, *skip):
    """Floating columns to 6 places, as the reference SQL gives them."""
    return df.select([F.round(c, 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def cases6(spark, d):
    return A.cases(spark, d)


# --- ingestion -----------------------------------------------------------------------------


@query("a02_load_splits", "SELECT split, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 >= 5 THEN 'synthetic' ELSE 'real_train' END AS split FROM orders WHERE o_orderkey % 10 > 1 UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'real_validation' ELSE 'real_test' END FROM orders WHERE o_orderkey % 10 < 2) GROUP BY split")
def load_splits(spark, d):
    o = A.read(spark, d, "orders").select("o_orderkey").withColumn("k", F.col("o_orderkey") % 10)
    out = ingest.load_splits(o, o.where("k > 1").withColumn("is_synthetic", (F.col("k") >= 5).cast("byte")), o.where("k = 1"), o.where("k = 0"), include_test=True)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("a05_normalize", """
SELECT 'PN-' || o_orderkey AS claim_id, o_orderpriority AS "OrderPriority", CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END AS "CustKey",
 CASE WHEN o_orderkey % 7 = 0 THEN 'CustKey' ELSE '' END AS missing, CASE WHEN o_orderkey % 7 = 0 THEN 'CustKey' ELSE '' END AS invalid FROM orders""")
def normalize(spark, d):
    o = A.read(spark, d, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("policy_number"), F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("order priority"), F.when(F.col("o_orderkey") % 7 == 0, "n.a.").otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0"))).alias("CUST_KEY"))
    domain = {"OrderPriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]}
    out = ingest.normalize_claims(raw, domain, ["PolicyNumber", "CustKey"])
    return out.select("claim_id", "OrderPriority", "CustKey", F.array_join("missing", ",").alias("missing"), F.array_join("invalid", ",").alias("invalid"))


@query("a07_read_inputs", "SELECT l_orderkey, l_partkey, l_quantity::DOUBLE AS l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1")
def read_inputs(spark, d):
    line = A.read(spark, d, "lineitem")
    return ingest.read_inputs(line, "l_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"], ["l_partkey", "l_quantity"]).withColumn("l_quantity", F.col("l_quantity").cast("double"))


@query("a11_load_results", """
SELECT d AS decision, CASE WHEN d = 'FLAG_FOR_INVESTIGATION' THEN 'FRAUD_RISK' END AS flag_category, count(*) AS n FROM (
 SELECT CASE event_id % 4 WHEN 0 THEN 'FLAG_FOR_INVESTIGATION' WHEN 1 THEN 'REQUEST_MORE_INFORMATION' WHEN 2 THEN 'APPROVE' ELSE upper(event_type) END AS d FROM events) GROUP BY 1, 2""")
def load_results(spark, d):
    e = A.read(spark, d, "events")
    k = F.col("event_id") % 4
    runs = e.select(F.when(k == 0, "investigate").when(k == 1, "more-info").when(k == 2, " approve ").otherwise(F.col("event_type")).alias("decision"))
    return ingest.load_results(runs).groupBy("decision", "flag_category").agg(F.count("*").alias("n"))


@query("a13_table_hash", "SELECT count(*) AS n, sum(('0x' || substr(md5(concat_ws('|', o_orderkey::VARCHAR, o_orderpriority, o_orderstatus)), 1, 8))::BIGINT)::BIGINT AS content FROM orders")
def table_hash(spark, d):
    return ingest.table_hash(A.read(spark, d, "orders"), ["o_orderkey", "o_orderpriority", "o_orderstatus"])


# --- rules ---------------------------------------------------------------------------------

_LAG = "(((list_position(['{m}'], c.\"MonthClaimed\") - list_position(['{m}'], c.\"Month\")) % 12 + 12) % 12)".replace("{m}", "','".join(A.S.MONTHS))
_POL = "list_position(['none','1 to 7','8 to 15','15 to 30','more than 30'], {})"
_VEH = "CASE c.\"AgeOfVehicle\" WHEN 'new' THEN 0 WHEN 'more than 7' THEN 8 ELSE substr(c.\"AgeOfVehicle\", 1, 1)::INT END"
_BIN = "CASE WHEN c.\"Age\" = 0 THEN '16 to 17' WHEN c.\"Age\" <= 17 THEN '18 to 20' WHEN c.\"Age\" <= 20 THEN '21 to 25' WHEN c.\"Age\" <= 25 THEN '26 to 30' WHEN c.\"Age\" <= 35 THEN '31 to 35' WHEN c.\"Age\" <= 45 THEN '36 to 40' WHEN c.\"Age\" <= 55 THEN '41 to 50' WHEN c.\"Age\" <= 65 THEN '51 to 65' ELSE 'over 65' END"
_ALIAS = "(c.\"PolicyType\" = 'Sedan - Liability' AND c.\"VehicleCategory\" = 'Sport' AND c.\"BasePolicy\" = 'Liability')"
RULE_SQL = {
    "V01_REQUIRED_FIELDS": 'c."MonthClaimed" IS NOT NULL',
    "V02_DOMAIN_VALUES": "true",
    "V03_AGE_MISSING": 'c."Age" <> 0',
    "V04_AGE_HOLDER_BIN": f'{_BIN} = c."AgeOfPolicyHolder"',
    "V05_POLICYTYPE_CONSISTENT": f'(c."VehicleCategory" || \' - \' || c."BasePolicy" = c."PolicyType" OR {_ALIAS})',
    "V05B_POLICYTYPE_KNOWN_ALIAS": f"NOT {_ALIAS}",
    "V06_CLAIM_AFTER_ACCIDENT": f'NOT coalesce({_LAG} = 0 AND c."WeekOfMonthClaimed" < c."WeekOfMonth", false)',
    "V07_REPORTING_DELAY": f"NOT coalesce({_LAG} >= 6, false)",
    "V08_EARLY_POLICY_INCIDENT": "NOT (c.\"Days_Policy_Accident\" IN ('none', '1 to 7') OR c.\"Days_Policy_Claim\" = 'none')",
    "V09_POLICY_DAYS_ORDER": f"{_POL.format('c.\"Days_Policy_Claim\"')} >= {_POL.format('c.\"Days_Policy_Accident\"')}",
    "V10_POLICY_DAYS_VS_LAG": f"NOT coalesce(c.\"Days_Policy_Claim\" <> 'more than 30' AND {_LAG} >= 2, false)",
    "V11_VEHICLE_VS_DRIVER_AGE": f'NOT (c."Age" BETWEEN 1 AND 20 AND {_VEH} > c."Age" - 16)',
    "V12_YOUNG_HOLDER_HISTORY": "NOT (c.\"Age\" BETWEEN 1 AND 20 AND (c.\"PastNumberOfClaims\" = 'more than 4' OR c.\"NumberOfCars\" IN ('5 to 8', 'more than 8')))",
}
_RULED = "ruled AS (SELECT c.*, " + ", ".join(f"{v} AS {k}" for k, v in RULE_SQL.items()) + " FROM claims c)"
_RULE_LONG = "rl AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, {k} AS passed, \"PolicyNumber\", \"FraudFound_P\" AS y, split FROM ruled" for k in RULE_SQL) + ")"


@query("b13_run_rules", f'WITH {CLAIMS}, {_RULED} SELECT "PolicyNumber", {", ".join(RULE_SQL)} FROM ruled')
def run_rules(spark, d):
    return rules.run_rules(A.claims(spark, d)).select("PolicyNumber", *RULE_SQL)


@query("b14_validate", f"WITH {CLAIMS}, {_RULED}, {_RULE_LONG} SELECT \"PolicyNumber\" AS claim_id, rule_id, passed, CASE WHEN NOT passed AND rule_id = 'V07_REPORTING_DELAY' THEN 'message' END AS message FROM rl")
def validate(spark, d):
    out = rules.validate(A.claims(spark, d), "PolicyNumber")
    return out.select("claim_id", "rule_id", "passed", F.when((F.col("rule_id") == "V07_REPORTING_DELAY") & F.col("message").isNotNull(), "message").alias("message"))


def _message_sql(r) -> str:
    """The rule's message with the claim's values, as SQL."""
    absent = ", ".join(f"CASE WHEN c.\"{x}\" IS NULL THEN '{x}' END" for x in S.COLUMNS)
    special = {"missing_fields": f"concat_ws(', ', {absent})", "invalid_values": "''", "expected_holder_bin": f"coalesce({_BIN}, '?')"}
    pieces = re.split(r"\{(\w+)\}", r.message)
    return " || ".join(special.get(x) or f"coalesce(c.\"{x}\"::VARCHAR, '?')" if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(pieces) if i % 2 or x)


_MESSAGES = " UNION ALL ".join(f"SELECT \"PolicyNumber\" AS claim_id, '{r.id}' AS rule_id, '{r.severity}' AS severity, {_message_sql(r)} AS message FROM ruled c WHERE NOT {r.id}" for r in rules.RULES if r.id in RULE_SQL)


@query("b14_messages", f"WITH {CLAIMS}, {_RULED} {_MESSAGES}")
def messages(spark, d):
    return rules.validate(A.claims(spark, d), "PolicyNumber").where("not passed").select("claim_id", "rule_id", "severity", "message")


@query("b15_blocking", f'WITH {CLAIMS}, {_RULED} SELECT NOT (V01_REQUIRED_FIELDS AND V02_DOMAIN_VALUES AND V03_AGE_MISSING) AS blocking, count(*) AS n FROM ruled GROUP BY 1')
def blocking(spark, d):
    df = rules.run_rules(A.claims(spark, d))
    return df.groupBy(rules.blocking_failures(df).alias("blocking")).agg(F.count("*").alias("n"))


_LO, _HI = wilson("bp", "v")


@query("b17_rule_hits", f"WITH {CLAIMS}, {_RULED}, {_RULE_LONG}, g AS (SELECT rule_id, count(*) AS n, count(*) FILTER (NOT passed) AS v, count(*) FILTER (NOT passed AND y = 1) AS bp, avg(y) FILTER (passed) AS pass_rate FROM rl GROUP BY rule_id) SELECT rule_id, n, v AS violations, round(100.0::DOUBLE * v / n, 6) AS violation_pct, round(CASE WHEN v > 0 THEN bp::DOUBLE / v END, 6) AS violator_rate, round({_LO}, 6) AS ci_low, round({_HI}, 6) AS ci_high, round(pass_rate, 6) AS pass_rate FROM g")
def rule_hits(spark, d):
    return r6(rules.rule_hit_summary(A.claims(spark, d), "FraudFound_P"))


def _in_sql(f):
    return " AND ".join(f'"{c}" IN ({", ".join(repr(x) for x in v)})' for c, v in f.when.items())


_FLAGS = "fl AS (" + " UNION ALL ".join(f"SELECT '{f.id}' AS flag, {_in_sql(f)} AS fired, {rules.WEIGHTS[f.severity]} AS w, \"PolicyNumber\", \"FraudFound_P\" AS y, split FROM claims" for f in rules.RED_FLAGS) + ")"


@query("b19_red_flags", f'WITH {CLAIMS}, {_FLAGS} SELECT "PolicyNumber", coalesce(string_agg(flag, \',\' ORDER BY flag) FILTER (fired), \'\') AS flags, coalesce(sum(w) FILTER (fired), 0)::BIGINT AS score FROM fl GROUP BY 1')
def red_flags(spark, d):
    return A.claims(spark, d).select("PolicyNumber", F.array_join(F.transform(rules.fired_flags(), lambda f: f["rule_id"]), ",").alias("flags"), rules.red_flag_score().alias("score"))


@query("b21_consistency_count", f"WITH {CLAIMS}, {_RULED} SELECT k, count(*) AS n FROM (SELECT ({' + '.join(f'(NOT {k})::INT' for k in RULE_SQL if k[:3] not in ('V01', 'V02', 'V03') and not k.startswith('V05B'))})::BIGINT AS k FROM ruled) GROUP BY k")
def consistency_count(spark, d):
    return A.claims(spark, d).select(rules.consistency_failures().alias("k")).groupBy("k").agg(F.count("*").alias("n"))


# --- features ------------------------------------------------------------------------------

_BAND = "CASE WHEN c.\"Age\" = 0 THEN 'missing' " + " ".join(f"WHEN c.\"Age\" <= {u} THEN '{v}'" for u, v in C.AGE_BANDS) + " END"


@query("c01_engineered", f"""WITH {CLAIMS} SELECT "PolicyNumber", ("Age" = 0)::BIGINT AS age_missing, {_BAND} AS age_band, {_LAG}::DOUBLE AS claim_lag_months,
 round({_LAG} * (52.0::DOUBLE / 12) + ("WeekOfMonthClaimed" - "WeekOfMonth"), 6) AS claim_lag_weeks, ("DayOfWeek" IN ('Saturday', 'Sunday'))::BIGINT AS accident_weekend,
 coalesce("DayOfWeekClaimed" IN ('Saturday', 'Sunday'), false)::BIGINT AS claim_weekend, ("Days_Policy_Accident" IN ('none', '1 to 7') OR "Days_Policy_Claim" = 'none')::BIGINT AS early_policy_incident,
 ("VehiclePrice" IN ('less than 20000', 'more than 69000'))::BIGINT AS price_extreme, ("Fault" = 'Policy Holder')::BIGINT AS policyholder_fault, ("BasePolicy" = 'Liability')::BIGINT AS liability_only,
 CASE WHEN {_LAG} = 0 THEN 'same month' WHEN {_LAG} = 1 THEN '1 month' WHEN {_LAG} >= 2 THEN '2+ months' ELSE 'unknown' END AS lag_bucket FROM claims c""")
def engineered(spark, d):
    return r6(A.claims(spark, d).withColumns(C.engineered()).select("PolicyNumber", *C.engineered()))


def _wd(y, m, w, dow):
    days, months = "['" + "','".join(A.S.WEEKDAYS) + "']", "['" + "','".join(A.S.MONTHS) + "']"
    first = f"make_date({y}, list_position({months}, {m}), 1)"
    dd = f"({first} - (isodow({first}) - 1)::INT + (7 * ({w} - 1) + list_position({days}, {dow}) - 1)::INT)"
    last = f"last_day({first})"
    return f"CASE WHEN {m} IS NULL THEN NULL WHEN {dd} < {first} THEN {dd} + (7 * ceil(date_diff('day', {dd}::DATE, {first}) / 7.0))::INT WHEN {dd} > {last} THEN {dd} - (7 * ceil(date_diff('day', {last}, {dd}::DATE) / 7.0))::INT ELSE {dd} END"


_ACC = _wd('"Year"', '"Month"', '"WeekOfMonth"', '"DayOfWeek"')
_MP = "list_position(['" + "','".join(A.S.MONTHS) + "'], {})"
_CLM = _wd(f"(\"Year\" + CASE WHEN {_MP.format('\"MonthClaimed\"')} < {_MP.format('\"Month\"')} THEN 1 ELSE 0 END)", '"MonthClaimed"', '"WeekOfMonthClaimed"', '"DayOfWeekClaimed"')


@query("c05_dates", f"""WITH {CLAIMS}, x AS (SELECT "PolicyNumber", ({_ACC})::DATE AS accident, ({_CLM})::DATE AS claimed FROM claims)
 SELECT "PolicyNumber", accident, claimed, CASE WHEN claimed IS NOT NULL THEN greatest(0, date_diff('day', accident + (7 - isodow(accident))::INT, claimed - (isodow(claimed) - 1)::INT)) END::BIGINT AS lag_days FROM x""")
def dates(spark, d):
    df = A.claims(spark, d).select("PolicyNumber", C.accident_date().alias("accident"), C.claim_date().alias("claimed"))
    return df.withColumn("lag_days", C.reporting_lag_days(F.col("accident"), F.col("claimed")))


@query("c08_codes", f"""WITH {CLAIMS} SELECT "PolicyNumber", coalesce(list_position(['{"','".join(A.S.DOMAINS['VehiclePrice'])}'], "VehiclePrice"), 0) - 1 AS price_code,
 round(coalesce(sin(2 * pi() * ({_MP.format('"MonthClaimed"')} - 1) / 12), 0), 6) AS month_sin, round(coalesce(cos(2 * pi() * ({_MP.format('"MonthClaimed"')} - 1) / 12), 0), 6) AS month_cos, coalesce("MonthClaimed", 'missing') AS month_nominal FROM claims""")
def codes(spark, d):
    sin, cos = C.cyclic(F.col("MonthClaimed"), A.S.MONTHS)
    return A.claims(spark, d).select("PolicyNumber", C.ordinal(F.col("VehiclePrice"), A.S.DOMAINS["VehiclePrice"]).alias("price_code"), F.round(sin, 6).alias("month_sin"), F.round(cos, 6).alias("month_cos"), C.nominal(F.col("MonthClaimed")).alias("month_nominal"))


_LEVELS = ["BUILDING", "MACHINERY"]


@query("c11_one_hot", f"WITH {CASES} SELECT case_id, (segment = 'BUILDING')::INT AS building, (segment = 'MACHINERY')::INT AS machinery, (segment NOT IN ('BUILDING', 'MACHINERY'))::INT AS other FROM cases")
def one_hot(spark, d):
    out = C.one_hot(A.cases(spark, d).select("case_id", "segment"), "segment", _LEVELS)
    return out.select("case_id", *[F.col(f"`segment={v}`").cast("int").alias(v.lower()) for v in [*_LEVELS, "other"]])


@query("a10_clause_table", "SELECT s_suppkey, unnest(CASE s_nationkey % 3 WHEN 0 THEN ['Collision'] WHEN 1 THEN ['Collision', 'Liability'] ELSE ['All Perils', 'Collision', 'Liability'] END) AS base_policy FROM supplier")
def clause_table(spark, d):
    k = F.col("s_nationkey") % 3
    covers = F.when(k == 0, F.array(F.lit("Collision"))).when(k == 1, F.array(F.lit("Collision"), F.lit("Liability"))).otherwise(F.array(F.lit("All Perils"), F.lit("Collision"), F.lit("Liability")))
    return ingest.clause_table(A.read(spark, d, "supplier").select("s_suppkey", covers.alias("coverage"))).select("s_suppkey", "base_policy")


@query("c11_pooled_codes", f"WITH {CASES}, lv AS (SELECT nation AS value, row_number() OVER (ORDER BY nation) - 1 AS code FROM cases GROUP BY nation HAVING count(*) >= 590) SELECT coalesce(code, -1)::BIGINT AS code, count(*) AS n FROM cases LEFT JOIN lv ON nation = value GROUP BY 1")
def pooled_codes(spark, d):
    df = A.cases(spark, d)
    levels = F.broadcast(C.pooled_levels(df, "nation", 590))
    return df.join(levels, F.col("nation") == F.col("value"), "left").groupBy(F.coalesce("code", F.lit(-1).cast("long")).alias("code")).agg(F.count("*").alias("n"))


@query("c12_scaled", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice_scaled FROM orders")
def scaled(spark, d):
    return C.standard_scaled(A.read(spark, d, "orders"), ["o_totalprice"]).select("o_orderkey", F.round("o_totalprice_scaled", 6).alias("o_totalprice_scaled"))


# --- profiles ------------------------------------------------------------------------------


@query("d01_profile", f"WITH {CASES}, l AS ({long(['priority', 'segment', 'nation', 'n_lines'], [])}), g AS (SELECT \"column\", value, count(*) AS n FROM l GROUP BY 1, 2) SELECT \"column\", count(value) AS n_distinct, coalesce(sum(n) FILTER (value IS NULL), 0)::BIGINT AS n_null, min(value) AS lowest, max(value) AS highest, CASE WHEN count(value) <= 20 THEN string_agg(value, '|' ORDER BY value) END AS values_list FROM g GROUP BY 1")
def profile_columns(spark, d):
    return profile.profile_columns(A.cases(spark, d), ["priority", "segment", "nation", "n_lines"]).drop("type")


@query("d02_frequencies", f"WITH {CASES}, l AS ({long(CATS, ['split', 'label'])}), t AS (SELECT split, count(*) AS t FROM cases GROUP BY 1) SELECT \"column\", value, l.split, count(*) AS n, round(100.0::DOUBLE * count(*) / any_value(t), 6) AS pct, round(avg(label), 6) AS rate FROM l JOIN t ON l.split = t.split GROUP BY 1, 2, 3")
def frequencies(spark, d):
    return r6(profile.frequency_table(A.cases(spark, d), CATS, "split", "label"))


@query("d04_describe", f"WITH {CASES} SELECT split, count(amount) AS n, round(avg(amount), 4) AS mean, round(stddev_samp(amount), 4) AS sd, min(amount) AS lowest, round(quantile_cont(amount, 0.25), 4) AS q25, round(quantile_cont(amount, 0.5), 4) AS q50, round(quantile_cont(amount, 0.75), 4) AS q75, max(amount) AS highest FROM cases GROUP BY split")
def describe(spark, d):
    out = profile.describe(A.cases(spark, d), "amount", "split")
    return out.select([F.round(c, 4).alias(c) if c in ("mean", "sd", "q25", "q50", "q75") else F.col(c) for c in out.columns])


@query("d05_tvd", f"WITH {CASES}, l AS ({long(CATS, ['split'])}), t AS (SELECT split, count(*) AS t FROM cases GROUP BY 1), p AS (SELECT \"column\" AS c, value AS v, l.split AS s, count(*)::DOUBLE / any_value(t) AS p FROM l JOIN t ON l.split = t.split GROUP BY 1, 2, 3), k AS (SELECT DISTINCT a.c, a.v, b.split AS s FROM p a, t b WHERE b.split <> 'real_train') SELECT k.c AS \"column\", k.s AS split, round(0.5 * sum(abs(coalesce(x.p, 0) - coalesce(y.p, 0))), 6) AS tvd FROM k LEFT JOIN p x ON x.c = k.c AND x.v = k.v AND x.s = k.s LEFT JOIN p y ON y.c = k.c AND y.v = k.v AND y.s = 'real_train' GROUP BY 1, 2")
def tvd(spark, d):
    return r6(profile.tvd_table(A.cases(spark, d), CATS, "split", "real_train"))


_LO, _HI = wilson("p", "n")


@query("d10_split_summary", f"WITH {CASES}, g AS (SELECT split, count(*) AS n, sum(label)::BIGINT AS p, min(case_id) AS min_id, max(case_id) AS max_id FROM cases GROUP BY 1) SELECT split, n, p AS positives, round(p::DOUBLE / n, 6) AS rate, round({_LO}, 6) AS ci_low, round({_HI}, 6) AS ci_high, min_id, max_id FROM g")
def split_summary(spark, d):
    return r6(profile.split_summary(A.cases(spark, d), "split", "label", "case_id"))


@query("d06b_id_overlap", f"WITH {CASES}, s AS (SELECT DISTINCT entity_id, split FROM cases) SELECT x.split AS a, y.split AS b, count(*) AS n_shared FROM s x JOIN s y ON x.entity_id = y.entity_id AND x.split < y.split GROUP BY 1, 2")
def id_overlap(spark, d):
    return profile.id_overlap(A.cases(spark, d), "entity_id", "split")


@query("d06c_ids_nowhere", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ids_nowhere(spark, d):
    return profile.ids_nowhere(A.read(spark, d, "customer").select(F.col("c_custkey").alias("k")), A.read(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("d06d_changed_rows", "SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0")
def changed_rows(spark, d):
    o = A.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    other = o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")))
    return profile.changed_rows(o, other, "o_orderkey", ["o_orderpriority", "o_totalprice"])


@query("d06e_id_gaps", "SELECT min(l_orderkey) AS min_id, max(l_orderkey) AS max_id, count(DISTINCT l_orderkey) AS n_ids, max(l_orderkey) - min(l_orderkey) + 1 - count(DISTINCT l_orderkey) AS n_missing FROM lineitem")
def id_gaps(spark, d):
    return profile.id_gaps(A.read(spark, d, "lineitem"), "l_orderkey")


@query("d06f_copies", f"WITH {CASES} SELECT count(*) AS n FROM cases a WHERE split = 'synthetic' AND EXISTS (SELECT 1 FROM cases b WHERE b.split = 'real_train' AND b.priority = a.priority AND b.nation = a.nation AND b.segment = a.segment AND b.n_lines IS NOT DISTINCT FROM a.n_lines)")
def copies(spark, d):
    c = A.cases(spark, d)
    return profile.copies_of(c.where("split = 'synthetic'"), c.where("split = 'real_train'"), [*CATS, "n_lines"]).agg(F.count("*").alias("n"))


@query("d06g_duplicates", f"WITH {CASES}, g AS (SELECT count(*) AS c FROM cases GROUP BY priority, segment, nation, n_lines) SELECT sum(c)::BIGINT AS n_rows, count(*) AS n_distinct, sum(c - 1)::BIGINT AS n_surplus FROM g")
def duplicates(spark, d):
    return profile.duplicate_rows(A.cases(spark, d), [*CATS, "n_lines"])


@query("d06h_conditional_share", f"WITH {CASES} SELECT count(*) AS n, round(avg(coalesce(report_date >= event_date, false)::INT), 6) AS share FROM cases WHERE priority = '1-URGENT'")
def conditional_share(spark, d):
    return r6(profile.conditional_share(A.cases(spark, d), F.col("priority") == "1-URGENT", F.col("report_date") >= F.col("event_date")))


@query("d06_facts", "SELECT 'n_orders' AS check_name, 15000.0::DOUBLE AS expected, count(*)::DOUBLE AS observed, count(*) = 15000 AS ok FROM orders UNION ALL SELECT 'share_F', 0.5, round(avg((o_orderstatus = 'F')::INT), 6), abs(avg((o_orderstatus = 'F')::INT) - 0.5) <= 0.2 FROM orders UNION ALL SELECT 'absent', 1.0, NULL, false")
def facts(spark, d):
    o = A.read(spark, d, "orders").agg(F.count("*").cast("double").alias("n_orders"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_F"))
    seen = rules.unpivot(o, ["n_orders", "share_F"], [], "check_name", "observed")
    known = spark.createDataFrame([("n_orders", 15000.0, 0.0), ("share_F", 0.5, 0.2), ("absent", 1.0, 0.0)], "check_name string, expected double, tolerance double")
    return r6(profile.verify_facts(seen, known))


@query("d07_signal_check", f"WITH {CASES} SELECT 'priority' AS \"column\", p AS value, 0.3::DOUBLE AS stated_rate, count(label) AS n, round(avg(label), 6) AS observed_rate FROM (VALUES ('1-URGENT'), ('5-LOW'), ('none')) v(p) LEFT JOIN cases ON priority = p GROUP BY p")
def signal_check(spark, d):
    stated = spark.createDataFrame([("priority", v, 0.3) for v in ("1-URGENT", "5-LOW", "none")], "column string, value string, stated_rate double")
    return r6(profile.signal_check(A.cases(spark, d), "label", stated, ["priority"]))


@query("d08_rule_violations", f"WITH {CLAIMS}, {_RULED}, {_RULE_LONG} SELECT rule_id, split, count(*) FILTER (NOT passed) AS violations, round(100.0::DOUBLE * count(*) FILTER (NOT passed) / count(*), 6) AS pct FROM rl GROUP BY 1, 2")
def rule_violations(spark, d):
    return r6(profile.rule_violations(A.claims(spark, d), "split"))


@query("d09_rule_rates", f"WITH {CLAIMS}, {_RULED}, {_RULE_LONG}, g AS (SELECT rule_id, split, count(*) FILTER (NOT passed) AS n, count(*) FILTER (NOT passed AND y = 1) AS p, avg(y) FILTER (passed) AS pr FROM rl GROUP BY 1, 2) SELECT rule_id, split, n AS violations, round(CASE WHEN n > 0 THEN p::DOUBLE / n END, 6) AS violator_rate, round({_LO}, 6) AS ci_low, round({_HI}, 6) AS ci_high, round(pr, 6) AS pass_rate, round(CASE WHEN n > 0 AND pr > 0 THEN p::DOUBLE / n / pr END, 6) AS lift FROM g")
def rule_rates(spark, d):
    return r6(profile.rule_rates(A.claims(spark, d), "split", "FraudFound_P"))


# --- associations --------------------------------------------------------------------------

_RATE = f"n, p AS positives, round(p::DOUBLE / n, 6) AS rate, round({_LO}, 6) AS ci_low, round({_HI}, 6) AS ci_high"


@query("e02_rate_table", f"WITH {CASES}, g AS (SELECT n_lines::VARCHAR AS value, count(*) AS n, sum(label)::BIGINT AS p FROM cases GROUP BY 1) SELECT value, {_RATE}, round(p::DOUBLE / n / (SELECT avg(label) FROM cases), 6) AS lift FROM g")
def rate_table(spark, d):
    return r6(assoc.rate_table(A.cases(spark, d).withColumn("n_lines", F.col("n_lines").cast("string")), "n_lines", "label"))


@query("e03_rates_by_origin", f"WITH {CASES}, g AS (SELECT split, segment AS value, count(*) AS n, sum(label)::BIGINT AS p FROM cases GROUP BY 1, 2), b AS (SELECT split, avg(label) AS b FROM cases GROUP BY 1) SELECT g.split, value, {_RATE}, round(p::DOUBLE / n / b, 6) AS lift FROM g JOIN b ON g.split = b.split")
def rates_by_origin(spark, d):
    return r6(assoc.rate_table(A.cases(spark, d), "segment", "label", ["split"]))


_CONT = f"l AS ({long(CATS, ['label'])}), o AS (SELECT \"column\" AS c, value AS v, label AS y, count(*) AS n FROM l GROUP BY 1, 2, 3), r AS (SELECT c, v, sum(n) AS r FROM o GROUP BY 1, 2), q AS (SELECT c, y, sum(n) AS q FROM o GROUP BY 1, 2), t AS (SELECT c, sum(n) AS t, count(DISTINCT v) AS k, count(DISTINCT y) AS m FROM o GROUP BY 1), x AS (SELECT o.c, o.v, o.y, n::DOUBLE AS n, r::DOUBLE AS r, q::DOUBLE AS q, t::DOUBLE AS t, k, m FROM o JOIN r ON r.c = o.c AND r.v = o.v JOIN q ON q.c = o.c AND q.y = o.y JOIN t ON t.c = o.c)"


def p_value(chi2: str, dof: str) -> str:
    """Chi-square survival as one less the sum of a power series, each term by its logarithm."""
    a, z = f"({dof} / 2.0::DOUBLE)", f"(({chi2})::DOUBLE / 2)"
    return f"CASE WHEN {dof} = 0 OR {chi2} <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0, 1 - list_sum([exp(({a} + i) * ln({z}) - {z} - lgamma({a} + i + 1)) FOR i IN range(0, ({z} + 20 * sqrt({z} + {a}) + 200)::BIGINT)])) END"


@query("e06_association", f"WITH {CASES}, {_CONT}, chi AS (SELECT c, any_value(k) AS k, any_value(m) AS m, greatest(sum(n * n / (r * q)) - 1, 0) AS phi, any_value(t) AS t FROM x GROUP BY c), w AS (SELECT c, v, sum(n) FILTER (y = 1) AS a, sum(n) FILTER (y = 0) AS b FROM o GROUP BY 1, 2), s AS (SELECT c, sum(a) AS ta, sum(b) AS tb, count(*) AS k FROM w GROUP BY 1), iv AS (SELECT w.c, sum(((a + .5) / (ta + .5 * k) - (b + .5) / (tb + .5 * k)) * ln(((a + .5) / (ta + .5 * k))::DOUBLE / ((b + .5) / (tb + .5 * k))))::DOUBLE AS iv FROM w JOIN s ON s.c = w.c GROUP BY 1) SELECT chi.c AS \"column\", k AS levels, round(phi * t, 6) AS chi2, (k - 1) * (m - 1) AS dof, round({p_value('phi * t', '((k - 1) * (m - 1))')}, 6) AS p_value, round(sqrt(phi / least(k - 1, m - 1)), 6) AS cramers_v, round(iv, 6) AS iv, CASE WHEN iv <= 0.02 THEN 'negligible' WHEN iv <= 0.1 THEN 'weak' ELSE 'more' END AS strength FROM chi JOIN iv ON iv.c = chi.c")
def association(spark, d):
    return r6(assoc.association_ranking(A.cases(spark, d), CATS, "label"))


@query("e07_cramers_matrix", f"WITH {CASES}, p AS ({' UNION ALL '.join(f'''SELECT split, '{a}' AS a, '{b}' AS b, {a} AS va, {b} AS vb FROM cases''' for a, b in (('nation', 'priority'), ('nation', 'segment'), ('priority', 'segment')))}), o AS (SELECT split, a, b, va, vb, count(*)::DOUBLE AS n FROM p GROUP BY ALL), r AS (SELECT split, a, b, va, sum(n) AS r FROM o GROUP BY ALL), q AS (SELECT split, a, b, vb, sum(n) AS q FROM o GROUP BY ALL), v AS (SELECT o.split, o.a, o.b, sqrt(greatest(sum(n * n / (r * q)) - 1, 0) / (least(count(DISTINCT o.va), count(DISTINCT o.vb)) - 1)) AS v FROM o JOIN r USING (split, a, b, va) JOIN q USING (split, a, b, vb) GROUP BY 1, 2, 3) SELECT x.a, x.b, round(x.v, 6) AS v_left, round(y.v, 6) AS v_right, round(y.v - x.v, 6) AS difference FROM v x JOIN v y ON x.a = y.a AND x.b = y.b AND x.split = 'real_train' AND y.split = 'synthetic'")
def cramers(spark, d):
    return r6(assoc.largest_differences(assoc.matrix_difference(A.cases(spark, d), CATS, "split", "real_train", "synthetic")))


@query("e08_interaction", f"WITH {CASES}, g AS (SELECT priority, segment, count(*) AS n, sum(label)::BIGINT AS p FROM cases GROUP BY 1, 2) SELECT priority, segment, {_RATE} FROM g")
def interaction(spark, d):
    return r6(assoc.interaction_table(A.cases(spark, d), "priority", "segment", "label"))


@query("e08_by_origin", f"WITH {CASES}, g AS (SELECT priority, segment, count(*) FILTER (split = 'real_train') AS n_left, avg(label) FILTER (split = 'real_train') AS a, count(*) FILTER (split = 'synthetic') AS n_right, avg(label) FILTER (split = 'synthetic') AS b FROM cases WHERE split IN ('real_train', 'synthetic') GROUP BY 1, 2) SELECT priority, segment, n_left, round(a, 6) AS rate_left, n_right, round(b, 6) AS rate_right, round(b - a, 6) AS difference FROM g")
def interaction_by_origin(spark, d):
    return r6(assoc.interaction_by_origin(A.cases(spark, d), "priority", "segment", "label", "split", "real_train", "synthetic"))


@query("e09_mine_conditions", f"WITH {CASES}, i AS ({' UNION ALL '.join(f'''SELECT label, '{c}=' || {c} AS condition FROM cases''' for c in sorted(CATS))} UNION ALL {' UNION ALL '.join(f'''SELECT label, '{a}=' || {a} || ' & {b}=' || {b} FROM cases''' for a, b in (('nation', 'priority'), ('nation', 'segment'), ('priority', 'segment')))}), g AS (SELECT condition, count(*) AS n, sum(label)::BIGINT AS p FROM i GROUP BY 1), b AS (SELECT avg(label) AS base, count(*) AS t FROM cases), x AS (SELECT g.*, base, t, {_LO} AS lo FROM g, b) SELECT condition, n, p AS positives, round(p::DOUBLE / n, 6) AS rate, round(lo, 6) AS ci_low, round(p::DOUBLE / n / base, 6) AS lift FROM x WHERE n >= 0.001 * t AND lo > base AND p::DOUBLE / n / base >= 1.01")
def mine(spark, d):
    return r6(assoc.mine_conditions(A.cases(spark, d), CATS, "label", 0.001, 1.01))


@query("e10_red_flag_stats", f"WITH {CLAIMS}, {_FLAGS}, g AS (SELECT flag, split, count(*) AS t, sum(y) AS ty, count(*) FILTER (fired) AS n, count(*) FILTER (fired AND y = 1) AS p FROM fl GROUP BY 1, 2) SELECT flag, split, n, round(100.0::DOUBLE * n / t, 6) AS support_pct, round(CASE WHEN n > 0 THEN p::DOUBLE / n END, 6) AS rate, round({_LO}, 6) AS ci_low, round({_HI}, 6) AS ci_high, round(CASE WHEN n > 0 THEN (p::DOUBLE / n) / (ty::DOUBLE / t) END, 6) AS lift, round(p::DOUBLE / ty::DOUBLE, 6) AS recall FROM g")
def flag_stats(spark, d):
    return r6(rules.red_flag_stats(A.claims(spark, d), "FraudFound_P", "split"))


@query("e11_dependency", "SELECT count(*) AS n_values, max(k) AS most, max(k) <= 1 AS holds FROM (SELECT c_custkey, count(DISTINCT c_nationkey) AS k FROM customer GROUP BY 1)")
def dependency(spark, d):
    return assoc.functional_dependency(A.read(spark, d, "customer"), "c_custkey", "c_nationkey")


_DEPENDS = [("segment", "priority"), ("nation", "segment"), ("priority", "split")]
_DEP_SQL = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {a} AS vx, {b} AS vy FROM cases" for a, b in _DEPENDS)


@query("e11_strength", f"WITH {CASES}, p AS ({_DEP_SQL}), o AS (SELECT x, y, vx, vy, count(*)::DOUBLE AS n FROM p GROUP BY ALL), r AS (SELECT x, y, vx, sum(n) AS r, count(*) AS k FROM o GROUP BY ALL), c AS (SELECT x, y, vy, sum(n) AS c FROM o GROUP BY ALL), f AS (SELECT x, y, sum(n * n / (r * c)) - 1 AS phi FROM o JOIN r USING (x, y, vx) JOIN c USING (x, y, vy) GROUP BY ALL) SELECT x, y, count(*) AS n_values, max(k) AS most, max(k) <= 1 AS holds, round(sqrt(greatest(any_value(phi), 0) / (least(count(*), (SELECT count(*) FROM c c2 WHERE c2.x = r.x AND c2.y = r.y)) - 1)), 6) AS v FROM r JOIN f USING (x, y) GROUP BY x, y")
def dependency_strength(spark, d):
    return r6(assoc.dependency_strength(A.cases(spark, d), _DEPENDS))


@query("e12_tvd_chi2", f"WITH {CASES}, l AS ({long(CATS, ['split'])}), w AS (SELECT \"column\" AS c, value, (count(*) FILTER (split = 'real_train'))::DOUBLE AS l, (count(*) FILTER (split = 'synthetic'))::DOUBLE AS r FROM l WHERE split IN ('real_train', 'synthetic') GROUP BY 1, 2), s AS (SELECT c, sum(l) AS tl, sum(r) AS tr FROM w GROUP BY 1), z AS (SELECT w.c AS \"column\", 0.5 * sum(abs(l / tl - r / tr)) AS tvd, (sum(l * l / ((l + r) * tl) + r * r / ((l + r) * tr)) - 1) * any_value(tl + tr) AS chi2, count(*) - 1 AS dof FROM w JOIN s ON s.c = w.c GROUP BY 1) SELECT \"column\", round(tvd, 6) AS tvd, round(chi2, 6) AS chi2, dof, round({p_value('chi2', 'dof')}, 6) AS p_value FROM z")
def tvd_chi2(spark, d):
    return r6(assoc.tvd_and_chi2(A.cases(spark, d), CATS, "split", "real_train", "synthetic"))


_AGREE = f"l AS ({long(CATS, ['split', 'label'])}), g AS (SELECT \"column\" AS c, value AS v, count(*) FILTER (split = 'real_train') AS nl, count(*) FILTER (split = 'synthetic') AS nr, avg(label) FILTER (split = 'real_train') AS rl, avg(label) FILTER (split = 'synthetic') AS rr FROM l GROUP BY 1, 2), b AS (SELECT avg(label) FILTER (split = 'real_train') AS bl, avg(label) FILTER (split = 'synthetic') AS br FROM cases), ag AS (SELECT c, v, nl, nr, rl, rr, rl / bl AS ll, rr / br AS lr FROM g, b WHERE nl >= 30)"


@query("e13_rate_agreement", f"WITH {CASES}, {_AGREE} SELECT c AS \"column\", v AS value, nl AS n_left, nr AS n_right, round(rl, 6) AS rate_left, round(rr, 6) AS rate_right, round(ll, 6) AS lift_left, round(lr, 6) AS lift_right FROM ag")
def agreement(spark, d):
    return r6(assoc.rate_agreement(A.cases(spark, d), CATS, "split", "real_train", "synthetic", "label"))


@query("e14_flipped", f"WITH {CASES}, {_AGREE} SELECT c AS \"column\", v AS value, (SELECT round(corr(rl, rr), 6) FROM ag) AS correlation FROM ag WHERE (ll - 1) * (lr - 1) < 0")
def flipped(spark, d):
    a = assoc.rate_agreement(A.cases(spark, d), CATS, "split", "real_train", "synthetic", "label")
    return r6(assoc.flipped_signals(a).select("column", "value").join(F.broadcast(assoc.rate_correlation(a).select("correlation"))))


@query("e15_mutual_information", f"WITH {CASES}, {_CONT}, mi AS (SELECT c, sum(n / t * ln(n * t / (r * q))) - max((k - 1) * (m - 1) / (2 * t)) AS mi FROM x GROUP BY 1) SELECT c AS \"column\", round(mi, 9) AS mi, rank() OVER (ORDER BY mi DESC) AS rank FROM mi")
def mutual_information(spark, d):
    return assoc.mutual_information(A.cases(spark, d), CATS, "label").withColumn("mi", F.round("mi", 9))


@query("e16_unseen_pairs", f"WITH {CASES}, p AS ({' UNION ALL '.join(f'''SELECT case_id, split, '{a}|{b}' AS pair, concat_ws('|', {a}::VARCHAR, {b}::VARCHAR) AS v FROM cases''' for a, b in (('amount_band', 'nation'),)).replace('amount_band::VARCHAR', 'floor(amount / 1000)::BIGINT::VARCHAR').replace('FROM cases', 'FROM cases')}), u AS (SELECT count(DISTINCT case_id) AS u FROM p WHERE split = 'synthetic' AND NOT EXISTS (SELECT 1 FROM p q WHERE q.split = 'real_train' AND q.v = p.v)) SELECT count(*) AS n_rows, (SELECT u FROM u) AS n_unseen, round(100.0::DOUBLE * (SELECT u FROM u) / count(*), 6) AS pct FROM cases WHERE split = 'synthetic'")
def unseen(spark, d):
    df = A.cases(spark, d).withColumn("amount_band", F.floor(F.col("amount") / 1000))
    return r6(assoc.unseen_pairs(df, "case_id", ["amount_band", "nation"], "split", "real_train", "synthetic"))


@query("e16_coverage", f"WITH {CASES}, v AS (SELECT 'band' AS \"column\", floor(amount / 1000)::BIGINT AS v, bool_or(split = 'real_train') AS a, bool_or(split = 'synthetic') AS b FROM cases GROUP BY 2) SELECT \"column\", count(*) FILTER (a AND NOT b) AS n_missing, count(*) FILTER (b AND NOT a) AS n_novel FROM v GROUP BY 1")
def coverage(spark, d):
    return assoc.category_coverage(A.cases(spark, d).withColumn("band", F.floor(F.col("amount") / 1000)), ["band"], "split", "real_train", "synthetic")


@query("e17_lag_shares", f"WITH {CLAIMS} SELECT {_LAG}::BIGINT AS value, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM claims), 6) AS share FROM claims c GROUP BY 1")
def lag_shares(spark, d):
    df = A.claims(spark, d).select(C.lag_months(F.col("Month"), F.col("MonthClaimed")).cast("long").alias("lag"))
    return r6(assoc.value_shares(df, "lag"))
