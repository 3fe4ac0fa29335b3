"""Compare a report with its SQL, order-insensitively."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


KINDS = {
    "bigint": "int", "int": "int", "double": "float", "string": "text", "boolean": "bool", "timestamp": "time",
    "timestamp_ntz": "time", "BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool",
    "TIMESTAMP": "time",
}


def difference(spark, con, report, sf_dir: str):
    """None when equal, else a short description; also the Spark seconds."""
    start = time.time()
    df = report.run(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    seconds = time.time() - start
    if report.sql is None:
        return (None if got else "no rows"), seconds, len(got)
    cursor = con.execute(report.sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}", seconds, len(got)
    order = [names.index(c) for c in columns]
    spark_types = dict(df.dtypes)
    kinds = {c: (KINDS.get(spark_types[c], spark_types[c]), KINDS.get(str(d[1]), str(d[1])))
             for c, d in ((d[0], d) for d in cursor.description)}
    odd = {c: pair for c, pair in kinds.items() if pair[0] != pair[1]}
    if odd:
        return f"types (spark, sql) differ: {odd}", seconds, len(got)
    want = sorted(tuple(canonical(row[i]) for i in order) for row in cursor.fetchall())
    if got == want:
        return None, seconds, len(got)
    only_spark, only_sql = set(got) - set(want), set(want) - set(got)
    return (f"rows {len(got)} vs {len(want)}; differing {len(only_spark)}/{len(only_sql)}\n  columns {columns}\n"
            f"  spark {sorted(only_spark)[:2]}\n  sql   {sorted(only_sql)[:2]}"), seconds, len(got)
