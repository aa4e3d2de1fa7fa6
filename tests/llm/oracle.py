"""Running registered queries beside their SQL."""

import glob
import os

import duckdb


def views(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def oracle_rows(sf_dir: str, sql: str) -> list[tuple]:
    result = views(sf_dir).sql(sql)
    order = [result.columns.index(c) for c in sorted(result.columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
