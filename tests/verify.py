"""Compare a Spark result with the DuckDB oracle: names, row count, values.

Rows are compared as a multiset after ordering the columns by name; floats
are compared exactly (the queries round on both sides).
"""

from __future__ import annotations

import math

from lexitally.sources.tables import TABLES, table_path


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        return ("f", repr(v))
    if isinstance(v, int):
        return ("i", v)
    return ("s", str(v))


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    if sorted(s_cols) != sorted(o_cols):
        return False, f"columns differ: {s_cols} vs {o_cols}"
    if len(s_rows) != len(o_rows):
        return False, f"row count {len(s_rows)} vs {len(o_rows)}"
    a, b = canonical(s_cols, s_rows), canonical(o_cols, o_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return False, f"values differ, e.g. {diff}"
    return True, f"{len(s_rows)} rows"
