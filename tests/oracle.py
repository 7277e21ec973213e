"""Runs a registered query and its SQL and compares the rows."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def compare(df, con, sql):
    """Differences between a Spark frame and an SQL result; empty when equal."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    spark_types = dict(df.dtypes)
    for n in names:
        if _TYPES.get(types[n], types[n]) != spark_types[n]:
            problems.append(f"type of {n}: {spark_types[n]} != {types[n]}")
    order = sorted(names)
    left = sorted((tuple(_cell(r[n]) for n in order) for r in df.collect()), key=repr)
    at = [names.index(n) for n in order]
    right = sorted((tuple(_cell(r[i]) for i in at) for r in want), key=repr)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows != {len(right)}")
    if left != right:
        pairs = [(a, b) for a, b in zip(left, right) if a != b][:3]
        problems.append(f"rows differ: {str(pairs)[:1500]}")
    return problems
