"""Holds a query's rows against DuckDB's for its SQL."""

import os

import duckdb

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def present() -> bool:
    return os.path.isfile(f"{DATA}/lineitem.parquet")


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return ""
    if isinstance(value, float):
        return f"{value:.5f}".rstrip("0").rstrip(".").replace("-0", "0") if abs(value) < 5e-6 else f"{value:.5f}".rstrip("0").rstrip(".")
    return str(value)


def same(con, sql: str, df) -> None:
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)
