"""Compare a registered query with its SQL, row by row and value by value."""

import math

import duckdb

STAR = "region nation customer supplier part orders lineitem".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in STAR:
        con.execute(f"CREATE VIEW \"{t}\" AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v).__name__), v) if v is not None else (False, "", "") for v in row)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=_key)


TYPES = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
}


def differences(df, con, sql, limit=3) -> list[str]:
    """What differs between a DataFrame and a SQL text; empty when they agree exactly."""
    got_columns, got = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    want_columns, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_columns != want_columns:
        return [f"columns {got_columns} != {want_columns}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}", f"{got[:1]}", f"{want[:1]}"]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    out = [f"{c}: {t} is not {kinds[c]}" for c, t in df.dtypes if TYPES.get(t) != kinds[c]]
    for g, w in zip(got, want):
        for c, a, b in zip(got_columns, g, w):
            if type(a) is not type(b) or a != b or (isinstance(a, float) and math.isnan(a)):
                out.append(f"{c}: {a!r} != {b!r}")
        if len(out) >= limit:
            break
    return out
