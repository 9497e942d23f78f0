"""Comparing a Spark result with reference SQL, whatever the row order."""


def plain(value):
    if value is None or isinstance(value, (bool, int)):
        return value
    return round(float(value), 6) if type(value).__name__ in ("float", "Decimal") else str(value)


def rows(result) -> list[tuple]:
    return sorted((tuple(plain(v) for v in r) for r in result), key=lambda t: [(v is None, str(v)) for v in t])


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert sorted(con.sql(sql).columns) == columns
    assert rows(df.select(*columns).collect()) == rows(con.sql(f"SELECT {picked} FROM ({sql})").fetchall())
