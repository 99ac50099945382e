"""Row comparison of a Spark result with DuckDB on the same files."""

from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sql, folder=SF):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    con.execute("SET TimeZone = 'UTC'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return sorted(columns), rows_of(columns, got.fetchall())
