"""Compares a query with its SQL form: same columns, same rows as a multiset."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DATA = os.environ.get("TEST_DATA", "/root/testdata")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def differences(spark, query, sql, sf_dir):
    """Columns of both, rows of one that the other lacks, and back."""
    got = query(spark, sf_dir)
    wanted = connect(sf_dir).execute(sql)
    names = [d[0] for d in wanted.description]
    ours, theirs = rows_of(got.columns, got.collect()), rows_of(names, wanted.fetchall())
    return sorted(got.columns), sorted(names), ours - theirs, theirs - ours, sum(ours.values())
