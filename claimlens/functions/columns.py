"""Scalar functions of claims, as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S

Z95 = 1.959963984540054
# Upper bounds of the age bands, and the holder bin that an age implies.
AGE_BANDS = [(20, "16-20"), (25, "21-25"), (30, "26-30"), (35, "31-35"), (40, "36-40"), (50, "41-50"), (65, "51-65"), (200, "66+")]
HOLDER_BINS = [(17, "18 to 20"), (20, "21 to 25"), (25, "26 to 30"), (35, "31 to 35"), (45, "36 to 40"), (55, "41 to 50"), (65, "51 to 65")]


def ordinal(column: Column, order: Sequence[str]) -> Column:
    """Place in a declared order from 0; unknown or null gives -1."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in order]), column) - 1, F.lit(-1)).cast("long")


def place(column: Column, order: Sequence[str], start: int = 0) -> Column:
    """Place in a declared order; unknown or null gives null."""
    at = ordinal(column, order)
    return F.when(at >= 0, at + start)


def age_band(age: Column) -> Column:
    out = F.when(age == 0, "missing")
    for upper, label in AGE_BANDS:
        out = out.when((age > 0) & (age <= upper), label)
    return out


def holder_bin(age: Column) -> Column:
    """The holder bin that the age implies; 0 (not recorded) belongs to the lowest."""
    out = F.when(age.isNull(), F.lit(None)).when(age == 0, "16 to 17")
    for upper, label in HOLDER_BINS:
        out = out.when(age <= upper, label)
    return out.otherwise("over 65")


def lag_months(first: Column, second: Column, months: Sequence[str] = S.MONTHS) -> Column:
    """Months from the first to the second, 0 to 11."""
    return F.pmod(place(second, months) - place(first, months), F.lit(12))


def lag_bucket(lag: Column) -> Column:
    return F.when(lag == 0, "same month").when(lag == 1, "1 month").when(lag >= 2, "2+ months").otherwise("unknown")


def week_date(year: Column, month: Column, week: Column, weekday: Column) -> Column:
    """The date of a weekday in a week of a month, where week 1 holds day 1 and weeks start on
    Monday; moved into the month by whole weeks.  Null for a bad weekday or month."""
    day = place(weekday, S.WEEKDAYS)
    first = F.when(month.between(1, 12), F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))
    d = F.date_add(F.date_sub(first, F.weekday(first)), (7 * (week - 1) + day).cast("int"))
    last = F.last_day(first)
    up = F.date_add(d, (7 * F.ceil(F.datediff(first, d) / 7)).cast("int"))
    down = F.date_sub(d, (7 * F.ceil(F.datediff(d, last) / 7)).cast("int"))
    return F.when(d < first, up).when(d > last, down).otherwise(d)


def accident_date() -> Column:
    return week_date(F.col("Year"), place(F.col("Month"), S.MONTHS, 1), F.col("WeekOfMonth"), F.col("DayOfWeek"))


def claim_date() -> Column:
    """In the accident's year, or the next when the claim's month is earlier."""
    a, c = place(F.col("Month"), S.MONTHS, 1), place(F.col("MonthClaimed"), S.MONTHS, 1)
    return week_date(F.col("Year") + F.when(c < a, 1).otherwise(0), c, F.col("WeekOfMonthClaimed"), F.col("DayOfWeekClaimed"))


def reporting_lag_days(accident: Column, claim: Column) -> Column:
    """Monday of the claim's week minus Sunday of the accident's week, at least 0."""
    sunday, monday = F.date_add(accident, 6 - F.weekday(accident)), F.date_sub(claim, F.weekday(claim))
    days = F.datediff(monday, sunday)
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0))).cast("long")


def flag(condition: Column) -> Column:
    """1 where true, 0 where false or null."""
    return F.coalesce(condition, F.lit(False)).cast("long")


def engineered() -> dict[str, Column]:
    """The engineered columns of a claim."""
    lag = lag_months(F.col("Month"), F.col("MonthClaimed"))
    weekend = ["Saturday", "Sunday"]
    return {
        "age_missing": flag(F.col("Age") == 0),
        "age_band": age_band(F.col("Age")),
        "claim_lag_months": lag.cast("double"),
        "claim_lag_weeks": lag * (52 / 12) + (F.col("WeekOfMonthClaimed") - F.col("WeekOfMonth")),
        "accident_weekend": flag(F.col("DayOfWeek").isin(weekend)),
        "claim_weekend": flag(F.col("DayOfWeekClaimed").isin(weekend)),
        "early_policy_incident": flag(F.coalesce(F.col("Days_Policy_Accident").isin("none", "1 to 7"), F.lit(False)) | F.coalesce(F.col("Days_Policy_Claim") == "none", F.lit(False))),
        "price_extreme": flag(F.col("VehiclePrice").isin("less than 20000", "more than 69000")),
        "policyholder_fault": flag(F.col("Fault") == "Policy Holder"),
        "liability_only": flag(F.col("BasePolicy") == "Liability"),
        "lag_bucket": lag_bucket(lag),
    }


def cyclic(column: Column, order: Sequence[str]) -> tuple[Column, Column]:
    """Sine and cosine of the place in a cycle; unknown gives 0 for both."""
    angle = 2 * F.pi() * place(column, order) / len(order)
    return F.coalesce(F.sin(angle), F.lit(0.0)), F.coalesce(F.cos(angle), F.lit(0.0))


def nominal(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("missing"))


def rounded(x: Column, places: int) -> Column:
    """A double to decimal places as SQL engines round binary numbers: scaled first, halves away from zero.  ``F.round`` goes by the
    shortest decimal text instead, which differs where scaling meets a half."""
    scale = F.lit(10.0**places)
    return F.round(x.cast("double") * scale) / scale


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson interval of a rate, within 0 and 1; null without rows."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), centre - half)), F.when(ok, F.least(F.lit(1.0), centre + half))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0: moved up by eight, then Stirling's series (13 digits)."""
    up = x + 8.0
    risen = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda acc, i: acc + F.ln(x + i))
    tail, power = F.lit(0.0), 1 / up
    for divisor in (12.0, -360.0, 1260.0, -1680.0, 1188.0):  # of 1/up, 1/up^3, ..
        tail, power = tail + power / divisor, power / (up * up)
    return (up - 0.5) * F.ln(up) - up + 0.5 * F.ln(2 * F.pi()) + tail - risen


def chi2_survival(chi2: Column, dof: Column) -> Column:
    """P(X >= chi2) of the chi-square distribution, the regularised upper incomplete gamma function of dof/2 and chi2/2.

    Below dof/2 + 1 one less its series, above it its continued fraction (from the back), each with as many steps as
    either needs near the middle.  1 without degrees of freedom or for chi2 <= 0; null for nulls.
    """
    a, z = dof.cast("double") / 2, F.greatest(chi2.cast("double"), F.lit(0.0)) / 2
    steps = (60 + 14 * F.sqrt(a)).cast("int")
    front = F.exp(a * F.ln(z) - z - log_gamma(a))
    grow = lambda s, n: F.struct((s["term"] * z / (a + n)).alias("term"), (s["total"] + s["term"] * z / (a + n)).alias("total"))
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
    series = F.aggregate(F.sequence(F.lit(1), steps), start, grow, lambda s: s["total"])
    back = F.aggregate(F.sequence(steps, F.lit(1)), F.lit(0.0), lambda tail, n: n * (n - a) / (z + 2 * n + 1 - a - tail))
    upper = F.when(z < a + 1, 1 - front * series).otherwise(front / (z + 1 - a - back))
    known = chi2.isNotNull() & dof.isNotNull()
    return F.when(known & ((dof <= 0) | (chi2 <= 0)), 1.0).when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), upper)))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def pooled_levels(df: DataFrame, column: str, least: int) -> DataFrame:
    """``value, code``: frequent levels in their sort order; the rest is pooled by the join."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where((F.col("n") >= least) & F.col("value").isNotNull())
    from pyspark.sql import Window

    # levels of a closed domain: few rows, one small window
    return counts.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("long").alias("code"))


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per level and one for everything else."""
    made = {f"{column}={v}": flag(F.col(column) == v) for v in levels}
    made[f"{column}=other"] = 1 - flag(F.col(column).isin(list(levels)))
    return df.withColumns(made)


def standard_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation, by a one-row aggregate joined to every row."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stats))
    made = {f"{c}_scaled": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return out.withColumns(made).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])
