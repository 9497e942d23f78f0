"""Policy terms and claim history: range joins under an equi key, and verification checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..sources.shared import discard, materialise

# Most earlier claims that a recorded bin allows.
HISTORY_CAPS = {"none": 0, "1": 1, "2 to 4": 4}


def policy_in_force(claims: DataFrame, policies: DataFrame, claim_key: str, policy_key: str, on_date: str) -> DataFrame:
    """The version of the policy that applies: the only one, else the first listed whose open or
    closed interval holds the first day of the accident's month.

    ``policies`` has ``versions``, an array of structs with ``version, effective_from, effective_to``
    (dates).  Returns ``claim_key, version, reason``; a claim without policy is not_found.
    """
    versions = policies.select(policy_key, F.size("versions").alias("many"), F.posexplode("versions").alias("pos", "v"))
    day = F.trunc(F.col(on_date), "month")
    met = claims.select(claim_key, policy_key, on_date).join(versions, policy_key, "left")
    holds = (F.col("v.effective_from").isNull() | (F.col("v.effective_from") <= day)) & (F.col("v.effective_to").isNull() | (F.col("v.effective_to") >= day))
    fits = (F.col("many") == 1) | F.coalesce(holds, F.lit(False))
    out = met.groupBy(claim_key).agg(F.min_by("v.version", F.when(fits, F.col("pos"))).alias("version"), F.max("many").alias("many"))
    reason = F.when(F.col("many").isNull(), "no policy").when(F.col("version").isNull(), "no version in force").when(F.col("many") == 1, "only version").otherwise("in force")
    return out.select(claim_key, "version", reason.alias("reason"))


def version_in_force(versions: Column, day: Column) -> Column:
    """Of an array of structs with ``effective_from`` and ``effective_to`` (dates, open if null) the only one, else the first
    whose closed interval holds the day; null if none does.  Nothing is exploded."""
    holds = lambda v: (v["effective_from"].isNull() | (v["effective_from"] <= day)) & (v["effective_to"].isNull() | (v["effective_to"] >= day))
    return F.when(F.size(versions) == 1, versions[0]).when(day.isNotNull(), F.try_element_at(F.filter(versions, holds), F.lit(1)))


def document_terms(documents: DataFrame, policy_key: str) -> DataFrame:
    """Policy documents as read (``policy_id, versions``) with what the checks compare: ``policy_key, versions``, each a struct of
    ``version``, dates, ``deductible, conditions, exclusions`` and ``max_months``.  A date that is none counts as open."""
    date = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    one = lambda v: F.struct(
        v["version"].alias("version"), date(v["effective_from"]).alias("effective_from"), date(v["effective_to"]).alias("effective_to"), v["deductible"].alias("deductible"),
        v["conditions"].alias("conditions"), v["exclusions"].alias("exclusions"), v["reporting_requirements"]["max_months_after_accident"].alias("max_months"))
    return documents.select(F.col("policy_id").alias(policy_key), F.transform("versions", one).alias("versions"))


def retrieve_policy(claims: DataFrame, policies: DataFrame, policy_key: str, categories: Sequence[str]) -> DataFrame:
    """Claims with ``status`` (found, partial or unavailable) and the categories that are missing."""
    have = policies.select(policy_key, *[F.col(c).alias(f"_{c}") for c in categories], F.lit(True).alias("_found"))
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{c}").isNull(), F.lit(c)) for c in categories]))
    out = claims.join(have, policy_key, "left").withColumn("missing", missing)
    status = F.when(F.col("_found").isNull(), "unavailable").when(F.size("missing") > 0, "partial").otherwise("found")
    return out.withColumn("status", status).drop("_found", *[f"_{c}" for c in categories])


def verdict(ok: Column) -> Column:
    """PASS, FAIL, or UNKNOWN where the inputs do not tell."""
    return F.when(ok.isNull(), "UNKNOWN").when(ok, "PASS").otherwise("FAIL")


def term_check(month_start: Column, term_from: Column, term_to: Column) -> Column:
    """The accident is known by month only: PASS if the month lies inside the term, FAIL if outside,
    UNKNOWN if it straddles a border."""
    month_end = F.last_day(month_start)
    inside, outside = (month_start >= term_from) & (month_end <= term_to), (month_end < term_from) | (month_start > term_to)
    return F.when(inside, "PASS").when(outside, "FAIL").otherwise("UNKNOWN")


def _matches(pairs: Column, claim: Column) -> Column:
    """1 if every field takes one of its values; else 0 or -1 as the first field that does not is absent or differs."""
    own = lambda kv: F.when(F.try_element_at(claim, kv["key"]).isNull(), 0).when(F.array_contains(kv["value"], F.try_element_at(claim, kv["key"])), 1).otherwise(-1)
    return F.aggregate(pairs, F.lit(1), lambda acc, kv: F.when(acc != 1, acc).otherwise(own(kv)))


def exclusions_check(items: Column, claim: Column) -> Column:
    """FAIL if all of some item's ``when`` holds; else UNKNOWN where a field is absent or there are no items."""
    found = F.transform(items, lambda item: _matches(F.map_entries(item["when"]), claim))
    return F.when(items.isNull() | (F.size(items) == 0), "UNKNOWN").when(F.array_contains(found, 1), "FAIL").when(F.array_contains(found, 0), "UNKNOWN").otherwise("PASS")


# The checks, their categories, and those that are about the claim's own record.
CHECKS = {
    "PV01_POLICY_IDENTIFIED": "applicability",
    "PV02_POLICY_TYPE_CONSISTENT": "applicability",
    "PV03_INCIDENT_IN_COVERAGE_PERIOD": "effective_date",
    "PV04_CLAIM_TIMELINE": "reporting",
    "PV05_DEDUCTIBLE_MATCHES_POLICY": "coverage_limits",
    "PV06_COVERAGE_CONDITIONS": "coverage_conditions",
    "PV07_EXCLUSIONS": "exclusions",
    "PV08_COVERAGE_LIMITS": "coverage_limits",
    "PV09_REPORTING_REQUIREMENT": "reporting",
}
CLAIM_RECORD_CHECKS = ("PV02_POLICY_TYPE_CONSISTENT", "PV04_CLAIM_TIMELINE")


def claim_record_results() -> dict[str, Column]:
    """PV02 and PV04: the policy type agrees with its parts, and the dates and policy-day bins agree."""
    from .rules import RULES

    passed = {r.id[:3]: r.check() for r in RULES if r.id != "V05B_POLICYTYPE_KNOWN_ALIAS"}
    timeline = passed["V06"] & passed["V09"] & passed["V10"]
    return {"PV02_POLICY_TYPE_CONSISTENT": verdict(F.coalesce(passed["V05"], F.lit(True))), "PV04_CLAIM_TIMELINE": verdict(F.coalesce(timeline, F.lit(True)))}


def verify_policy(claims: DataFrame, documents: DataFrame, key: str, policy_key: str, fields: Sequence[str]) -> DataFrame:
    """The nine checks of each claim, a row each: ``key, check_id, level, category, result``."""
    return policy_results(claims, documents, policy_key, fields).select(key, F.explode("checks").alias("c")).select(key, "c.*")


def policy_results(claims: DataFrame, documents: DataFrame, policy_key: str, fields: Sequence[str]) -> DataFrame:
    """The claims with ``document_found`` and their nine ``checks`` as an array of ``check_id, level, category, result``.

    ``documents`` has one row per policy: ``effective_from, effective_to`` (open if null) of the version that
    applies, ``deductible, conditions`` (``id, requires``), ``exclusions`` (``id, when``) and ``max_months``.
    Instead it may have ``versions`` as ``document_terms`` gives them; the one in force in the month of the accident is
    picked inside the row, and a document without such a version has no terms.
    Without a document only the claim's own record can be judged; what cannot be told is UNKNOWN.  The
    claimed amount is not recorded, so limits are always UNKNOWN.  Claims have the columns of the schema.
    """
    terms = ["effective_from", "effective_to", "deductible", "conditions", "exclusions", "max_months"]
    versioned = "versions" in documents.columns
    docs = documents.select(policy_key, (F.col("versions") if versioned else F.struct(*terms)).alias("_doc"))
    own = claims.join(docs, policy_key, "left").withColumn("_values", F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]))
    months = F.array(*[F.lit(m) for m in S.MONTHS])
    index = lambda c: F.nullif(F.array_position(months, F.col(c)), F.lit(0).cast("long"))
    start = F.make_date("Year", index("Month").cast("int"), F.lit(1))
    if versioned:
        bare = F.from_json(F.lit("{}"), own.schema["_doc"].dataType.elementType)
        own = own.withColumn("_doc", F.when(F.col("_doc").isNotNull(), F.coalesce(version_in_force(F.col("_doc"), start), bare)))
    doc, low, high = F.col("_doc"), F.col("_doc.effective_from"), F.col("_doc.effective_to")
    early, late = F.coalesce(low, F.lit("0001-01-01").cast("date")), F.coalesce(high, F.lit("9999-12-31").cast("date"))
    dated = doc.isNotNull() & start.isNotNull() & (low.isNotNull() | high.isNotNull())
    lag = F.pmod(index("MonthClaimed") - index("Month"), F.lit(12))
    results = claim_record_results() | {
        "PV01_POLICY_IDENTIFIED": F.when(doc.isNotNull(), "PASS").otherwise("UNKNOWN"),
        "PV03_INCIDENT_IN_COVERAGE_PERIOD": F.when(dated, term_check(start, early, late)).when(F.col("Days_Policy_Accident") == "none", "UNKNOWN").otherwise("PASS"),
        "PV05_DEDUCTIBLE_MATCHES_POLICY": verdict(doc["deductible"] == F.col("Deductible")),
        "PV06_COVERAGE_CONDITIONS": conditions_check(doc["conditions"], F.col("_values")),
        "PV07_EXCLUSIONS": exclusions_check(doc["exclusions"], F.col("_values")),
        "PV08_COVERAGE_LIMITS": F.lit("UNKNOWN"),
        "PV09_REPORTING_REQUIREMENT": verdict(lag <= doc["max_months"]),
    }
    cells = [F.struct(F.lit(c).alias("check_id"), F.lit("claim_record" if c in CLAIM_RECORD_CHECKS else "policy_condition").alias("level"), F.lit(CHECKS[c]).alias("category"), results[c].alias("result")) for c in CHECKS]
    return own.withColumns({"document_found": doc.isNotNull(), "checks": F.array(*cells)}).drop("_doc", "_values")


def failures_by_level(checks: DataFrame, key: str) -> DataFrame:
    """Failed checks of each claim, those of its own record and those of policy conditions apart."""
    listed = lambda level: F.array_join(F.array_sort(F.collect_set(F.when((F.col("result") == "FAIL") & (F.col("level") == level), F.col("check_id")))), ",")
    return checks.groupBy(key).agg(listed("claim_record").alias("claim_record_failures"), listed("policy_condition").alias("policy_condition_failures"))


def reference_lookup(claims: DataFrame, policies: DataFrame, clauses: DataFrame, key: str, policy_key: str, coverage: str, limits: Sequence[str]) -> DataFrame:
    """Each claim with its policy's ``clauses`` (ids in order, by coverage) and ``limits`` (a map of the
    columns that are recorded); ``found`` tells whether there is a policy.  The clauses by coverage are broadcast."""
    ids = clauses.groupBy(coverage).agg(F.array_sort(F.collect_set("clause_id")).alias("clauses"))
    filled = F.map_filter(F.create_map(*[x for c in limits for x in (F.lit(c), F.col(c).cast("string"))]), lambda _, v: v.isNotNull())
    have = policies.select(policy_key, coverage, filled.alias("limits"), F.lit(True).alias("found")).join(F.broadcast(ids), coverage, "left")
    return claims.select(key, policy_key).join(have, policy_key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def reference_consistency(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """``test, n, violations`` of Boolean tests over a reference table; null counts as a violation."""
    cells = [F.struct(F.lit(n).alias("test"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in tests.items()]
    long = df.select(F.explode(F.array(*cells)).alias("t")).select("t.*")
    return long.groupBy("test").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("violations"))


def conditions_check(items: Column, claim: Column) -> Column:
    """All of ``requires`` (field -> allowed values) hold for a claim given as a map; a field that is
    absent, or no items, leaves it UNKNOWN."""
    def one(item):
        pairs = F.map_entries(item["requires"])
        return _matches(pairs, claim)

    worst = F.array_min(F.transform(items, one))
    return F.when(worst.isNull() | (worst == 0), "UNKNOWN").when(worst > 0, "PASS").otherwise("FAIL")


def clause_checks(claims: DataFrame, clauses: DataFrame, claim_key: str, base_policy: str, fields: Sequence[str]) -> DataFrame:
    """One row per claim and clause with a test: ``claim_key, check_id, result``.

    Clauses have ``clause_id, base_policy`` and ``test`` with ``type, days, field, values``.  Tests:
    reporting_within_days (on ``lag_days``), deductible_matches (on ``deductible`` and
    ``policy_deductible``), vehicle_category_matches, term_contains_accident (on ``accident, term_from,
    term_to``) and field_not_in.  Clauses of wording only are skipped; an unknown type is UNKNOWN.  The clauses, a
    catalogue, are broadcast: few policy types hold all claims, so a shuffle by them would gather the claims in as few tasks.
    """
    values = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f).cast("string"))])
    own = claims.withColumn("_m", values)
    tests = clauses.where("test is not null and test.type is not null").withColumnRenamed("base_policy", "_bp")
    met = own.join(F.broadcast(tests), F.col(base_policy) == F.col("_bp"))
    has = set(claims.columns)
    kind, result = F.col("test.type"), F.lit("UNKNOWN")
    result = F.when(kind == "field_not_in", verdict(~F.array_contains(F.col("test.values"), F.try_element_at(F.col("_m"), F.col("test.field")))))
    if "lag_days" in has:
        result = result.when(kind == "reporting_within_days", verdict(F.col("lag_days") <= F.col("test.days")))
    if {"deductible", "policy_deductible"} <= has:
        result = result.when(kind == "deductible_matches", verdict(F.col("deductible") == F.col("policy_deductible")))
    if {"vehicle_category", "policy_vehicle"} <= has:
        result = result.when(kind == "vehicle_category_matches", verdict(F.col("vehicle_category") == F.col("policy_vehicle")))
    if {"accident", "term_from", "term_to"} <= has:
        result = result.when(kind == "term_contains_accident", verdict(F.col("accident").between(F.col("term_from"), F.col("term_to"))))
    return met.select(claim_key, F.col("clause_id").alias("check_id"), result.otherwise("UNKNOWN").alias("result"))


def verification_summary(checks: DataFrame, claim_key: str) -> DataFrame:
    """Counts, overall result (FAIL before UNKNOWN before PASS) and the failed and unknown lists."""
    is_ = lambda r: F.col("result") == r
    listed = lambda r: F.array_join(F.array_sort(F.collect_set(F.when(is_(r), F.col("check_id")))), ",")
    out = checks.groupBy(claim_key).agg(F.count_if(is_("PASS")).alias("n_pass"), F.count_if(is_("FAIL")).alias("n_fail"), F.count_if(is_("UNKNOWN")).alias("n_unknown"), listed("FAIL").alias("failed"), listed("UNKNOWN").alias("unknown"))
    return out.withColumn("overall", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_unknown") > 0, "UNKNOWN").otherwise("PASS"))


def clause_report(checks: DataFrame, labels: DataFrame, claim_key: str, label: str) -> DataFrame:
    """Per check: results, share of FAIL and the positive rate among FAIL."""
    met = checks.join(labels.select(claim_key, label), claim_key)
    fail = F.col("result") == "FAIL"
    return met.groupBy("check_id").agg(F.count_if(F.col("result") == "PASS").alias("n_pass"), F.count_if(fail).alias("n_fail"), F.count_if(F.col("result") == "UNKNOWN").alias("n_unknown"), (100 * F.avg(fail.cast("double"))).alias("fail_pct"), F.avg(F.when(fail, F.col(label))).alias("fail_rate"))


def claim_history(claims: DataFrame, history: DataFrame | None, key: str, entity: str, on_date: str, hist_key: str, hist_date: str, years: float = 3.0, listed: bool = True, chunk: int = 256, steps: bool = False) -> DataFrame:
    """Earlier claims of the same entity in ``[date - int(365.25 * years) days, date)``, the claim
    itself left out: ``n_previous, previous`` (ids in date order) and ``status``.  Without a source or
    a key the history is unavailable, which is not an empty one.

    No pairs of claims are formed.  Earlier claims are counted by day, and the running count of an entity (one row a day, so no more than
    the calendar has) gives the places at which a claim's window begins and ends in the entity's list.  The list lies in chunks of
    ``chunk`` ids, and a day with claims fetches the chunks of its own window only.  Without ``listed`` just the count is made.
    With ``steps`` days, windows and lists are written as tables, so what one of them shuffles is gone before the next.
    """
    written = materialise if steps else lambda df, _: df
    base = claims.select(key, entity, on_date).distinct()
    none = F.lit(None).cast("string")
    if history is None:
        return base.select(key, F.lit(None).cast("long").alias("n_previous"), none.alias("previous"), F.lit("unavailable").alias("status"))
    days = int(365.25 * years)
    h = history.select(F.col(entity).alias("_e"), F.col(hist_key).alias("_k"), F.to_date(hist_date).alias("_d")).where("_e is not null and _k is not null and _d is not null")
    per_day = h.groupBy("_e", "_d").agg(F.count("*").alias("_n"))
    points = base.select(F.col(entity).alias("_e"), F.to_date(on_date).alias("_to")).where("_e is not null and _to is not null").distinct()
    marks = points.select("_e", F.col("_to").alias("_d")).union(points.select("_e", F.date_sub("_to", days)))
    line = per_day.union(marks.withColumn("_n", F.lit(0).cast("long"))).groupBy("_e", "_d").agg(F.sum("_n").alias("_n"))
    sofar = Window.partitionBy("_e").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    line = written(line.select("_e", "_d", F.coalesce(F.sum("_n").over(sofar), F.lit(0)).alias("_before")), "days")
    at = lambda day, name: line.select("_e", F.col("_d").alias(day), F.col("_before").alias(name))
    spans = points.withColumn("_from", F.date_sub("_to", days)).join(at("_from", "_low"), ["_e", "_from"]).join(at("_to", "_high"), ["_e", "_to"]).select("_e", "_to", "_low", "_high")
    spans = written(spans, "windows")
    known = F.col(entity).isNotNull() & F.col(on_date).isNotNull()
    status = F.when(known, "available").otherwise("unavailable").alias("status")
    met = lambda table: base.join(table, (F.col(entity) == F.col("_e")) & (F.to_date(on_date) == F.col("_to")), "left").drop("_e", "_to")
    if not listed:
        own = h.withColumnRenamed("_k", "_own").groupBy("_own", "_e", "_d").agg(F.count("*").alias("_n"))
        mine = base.join(own, (F.col(key) == F.col("_own")) & (F.col(entity) == F.col("_e")) & (F.col("_d") >= F.date_sub(on_date, days)) & (F.col("_d") < F.to_date(on_date)))
        mine = mine.groupBy(F.col(key).alias("_own"), F.col(entity).alias("_oe"), F.col(on_date).alias("_od")).agg(F.sum("_n").alias("_mine"))
        out = met(spans).join(mine, (F.col(key) == F.col("_own")) & (F.col(entity) == F.col("_oe")) & (F.col(on_date) == F.col("_od")), "left")
        n = F.col("_high") - F.col("_low") - F.coalesce("_mine", F.lit(0))
        return out.select(key, F.when(known, n).alias("n_previous"), none.alias("previous"), status)
    inside = F.row_number().over(Window.partitionBy("_e", "_d").orderBy("_k")) - 1
    placed = h.withColumn("_i", inside).join(line, ["_e", "_d"]).select("_e", "_k", (F.col("_before") + F.col("_i")).alias("_place")).withColumn("_chunk", F.expr(f"_place div {chunk}"))
    chunks = placed.groupBy("_e", "_chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_k"))), lambda x: x["_k"].cast("string")).alias("_ids"))
    chunks = written(chunks, "chunks")
    wanted = spans.where("_high > _low").withColumn("_chunk", F.explode(F.sequence(F.expr(f"_low div {chunk}"), F.expr(f"(_high - 1) div {chunk}"))))
    first = F.greatest(F.col("_low") - F.col("_chunk") * chunk, F.lit(0))
    last = F.least(F.col("_high") - F.col("_chunk") * chunk, F.lit(chunk))
    parts = wanted.join(chunks, ["_e", "_chunk"]).select("_e", "_to", "_chunk", F.slice("_ids", (first + 1).cast("int"), (last - first).cast("int")).alias("_ids"))
    lists = parts.groupBy("_e", "_to").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_ids"))), lambda x: x["_ids"])).alias("_ids"))
    lists = written(lists, "lists")
    for table in (line, spans, chunks):
        discard(table)  # where it is one
    ids = F.filter(F.coalesce("_ids", F.array().cast("array<string>")), lambda x: x != F.col(key).cast("string"))
    return met(lists).select(key, F.when(known, F.size(ids).cast("long")).alias("n_previous"), F.when(known, F.array_join(ids, ",")).alias("previous"), status)


def history_contradiction(found: Column, recorded: Column, caps: Mapping[str, int] = HISTORY_CAPS) -> Column:
    """More earlier claims were found than the claim's own bin allows; open bins have no cap."""
    cap = F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), recorded)
    return F.coalesce(found > cap, F.lit(False))


def policy_term(inception: Column, accident: Column) -> tuple[Column, Column]:
    """The yearly term, from anniversary to the day before the next, that holds the accident
    (29 February counts as 28 in common years)."""
    years = F.year(accident) - F.year(inception)
    years = F.when(F.add_months(inception, (12 * years).cast("int")) > accident, years - 1).otherwise(years)
    return F.add_months(inception, (12 * years).cast("int")), F.date_sub(F.add_months(inception, (12 * (years + 1)).cast("int")), 1)
