"""The driver's tables as claims and cases.

Both views are one SQL text each; only the weekday function differs between engines, so
the same text serves as the first CTE of the reference SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schema as S

_CASES = """SELECT o.o_orderkey AS case_id, o.o_custkey AS entity_id,
 CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
 CASE WHEN o.o_orderkey % 10 = 0 THEN 'real_test' WHEN o.o_orderkey % 10 = 1 THEN 'real_validation'
      WHEN o.o_orderkey % 10 < 5 THEN 'real_train' ELSE 'synthetic' END AS split,
 o.o_orderpriority AS priority, c.c_mktsegment AS segment, n.n_name AS nation,
 CAST(o.o_orderdate AS DATE) AS event_date, CAST(l.first_ship AS DATE) AS report_date, l.n_lines,
 o.o_totalprice AS amount, o.o_totalprice / 500000.0 AS score
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, MIN(l_shipdate) AS first_ship, COUNT(*) AS n_lines FROM {lineitem} GROUP BY l_orderkey) l
 ON l.l_orderkey = o.o_orderkey"""


def pick(values: list, index: str) -> str:
    """The value at a place that an expression computes."""
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _claims() -> str:
    spread = lambda n, a, b=0: f"((o.o_orderkey * {a} + o.o_custkey + {b}) % {n})"
    week = lambda d: f"CAST(floor((day({d}) + 6) / 7) AS BIGINT)"
    d, r = "CAST(o.o_orderdate AS DATE)", "CAST(l.first_ship AS DATE)"
    made = {
        "Month": pick(S.MONTHS, f"month({d}) - 1"), "WeekOfMonth": week(d), "DayOfWeek": pick(S.WEEKDAYS, f"{{dow:{d}}}"),
        "MonthClaimed": pick(S.MONTHS, f"month({r}) - 1"), "WeekOfMonthClaimed": week(r), "DayOfWeekClaimed": pick(S.WEEKDAYS, f"{{dow:{r}}}"),
        "Age": f"CASE WHEN o.o_orderkey % 17 = 0 THEN 0 ELSE 16 + {spread(70, 7)} END",
        "FraudFound_P": "CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END", "PolicyNumber": "o.o_orderkey",
        "RepNumber": f"1 + {spread(16, 3)}", "Deductible": f"CASE {spread(4, 5)} WHEN 0 THEN 300 WHEN 1 THEN 400 WHEN 2 THEN 500 ELSE 700 END",
        "DriverRating": f"1 + {spread(4, 11)}", "Year": f"1994 + year({d}) % 3",
    }
    for i, (name, domain) in enumerate(S.DOMAINS.items()):
        made.setdefault(name, pick(domain, spread(len(domain), 2 * i + 3, i)))
    columns = ", ".join(f"{made[c] if c not in S.INTEGERS else f'CAST({made[c]} AS BIGINT)'} AS {c}" for c in S.COLUMNS)
    return f"SELECT {columns}, CASE WHEN o.o_orderkey % 10 < 5 THEN 'real_train' ELSE 'synthetic' END AS split FROM {{orders}} o LEFT JOIN (SELECT l_orderkey, MIN(l_shipdate) AS first_ship FROM {{lineitem}} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"


def _render(text: str, weekday: str, names: bool) -> str:
    import re

    text = re.sub(r"\{dow:(.*?)\}", lambda m: weekday.format(m[1]), text)
    return re.sub(r"\{(\w+)\}", r"\1", text) if names else text


CASES_SQL = _render(_CASES, "", True)
CLAIMS_SQL = _render(_claims(), "(isodow({}) - 1)", True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    import re

    tables = {t: read(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **tables)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ids, label, split, categories, dates, amount and score."""
    return _view(spark, sf_dir, _CASES)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order in the 33 claim columns, with ``split``.  Orders without a line have no
    claim date, which gives natural nulls."""
    return _view(spark, sf_dir, _render(_claims(), "weekday({})", False))
