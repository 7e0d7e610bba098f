"""Order-insensitive comparison of a Spark frame with a DuckDB query on the same parquet tables."""

import glob
import os

import duckdb
import pyarrow as pa


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=lambda r: [(v is not None, str(type(v)), v) for v in r])


def types(table: pa.Table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def difference(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    if types(spark_table) != types(duck_table):
        return f"types {sorted(set(types(spark_table).items()) ^ set(types(duck_table).items()))}"
    left, right = rows(spark_table), rows(duck_table)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return f"{len(bad)} of {len(left)} rows differ, first {bad[0]}" if bad else None
