"""Run a registered query in Spark and its SQL in DuckDB and compare."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kinds(types: list[str]) -> list[str]:
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    }
    return [names.get(t, t) for t in types]


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    got_cols = spark_df.columns
    types = dict(zip(got_cols, kinds([t for _, t in spark_df.dtypes]), strict=True))
    got = canonical(got_cols, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    cols = [d[0] for d in cursor.description]
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    want = canonical(cols, cursor.fetchall())
    if sorted(got_cols) != sorted(cols):
        return f"columns {sorted(got_cols)} != {sorted(cols)}"
    wrong = {c: (types[c], want_types[c]) for c in cols if types[c] != want_types[c]}
    if wrong:
        return f"types {wrong}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({sorted(cols)}), first {bad[0]}"
    return None
