"""Runs oracle SQL in DuckDB over a directory of tables, or over given rows."""

import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def run(sql, sf_dir):
    df = connect(sf_dir).execute(sql).fetch_df()
    return sorted(map(tuple, df[sorted(df.columns)].itertuples(index=False)), key=repr)


def run_exact(sql, sf_dir):
    """As ``run``, with Python's own numbers and nulls."""
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
