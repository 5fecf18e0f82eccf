"""Run a catalogue query in Spark and in DuckDB and compare columns, types and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_SPARK_TO_DUCK = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else (repr(v + 0.0) if isinstance(v, float) else str(v))) for v in row)


def differences(connection, spark_frame, sql: str) -> list[str]:
    """Empty if both sides agree."""
    relation = connection.sql(sql)
    duck_types = dict(zip(relation.columns, map(str, relation.types)))
    spark_types = {f.name: _SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in spark_frame.schema.fields}
    found = []
    if duck_types != spark_types:
        found.append(f"types differ: spark {spark_types}, duckdb {duck_types}")
        if set(duck_types) != set(spark_types):
            return found
    columns = sorted(spark_types)
    left = sorted((tuple(r) for r in spark_frame.select(*columns).collect()), key=_key)
    quoted = ", ".join(f'"{c}"' for c in columns)
    right = sorted(connection.sql(f"SELECT {quoted} FROM ({sql})").fetchall(), key=_key)
    if len(left) != len(right):
        found.append(f"row counts differ: spark {len(left)}, duckdb {len(right)}")
        return found
    for a, b in zip(left, right):
        if a != b and not all(
            x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            for x, y in zip(a, b)
        ):
            found.append(f"first difference: spark {str(a)[:300]}, duckdb {str(b)[:300]}")
            break
    if not left:
        found.append("empty result")
    return found
