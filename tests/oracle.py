"""Compare registered queries with their SQL: columns, types and rows in any order.

Run as a script to check all or some of them: python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402

# DuckDB's names for the types Spark results may have.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns, rows):
    """Cells in column name order; rows sorted, by their other cells before their doubles."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def key(row):
        # repr tells 0.0 from -0.0 and makes NULL comparable.
        exact = [repr(v) for v in row if not isinstance(v, float)]
        return exact, [repr(v) for v in row]

    return sorted((tuple(row[i] for i in order) for row in rows), key=key)


def _same(left, right, tolerance: float) -> bool:
    return all(
        repr(a) == repr(b)
        or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= tolerance)
        for a, b in zip(left, right)
    )


def difference(spark: SparkSession, connection, name: str, sf_dir: str, tolerance: float = 0.0) -> str | None:
    """None when both sides agree, else the first thing that differs.

    Results are rounded to six places. A value that ends in a 5 at the seventh
    is rounded up or down by its last bit, so a tolerance of one unit in the
    sixth place lets such ties pass.
    """
    df = entry.queries()[name](spark, sf_dir)
    relation = connection.sql(entry.oracle_sql()[name])
    ours = {c: TYPES[t] for c, t in df.dtypes}
    theirs = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    if ours != theirs:
        return f"schema {sorted(ours.items() ^ theirs.items())}"
    left = _rows(df.columns, df.collect())
    right = _rows(relation.columns, relation.fetchall())
    if len(left) != len(right):
        return f"{len(left)} rows, SQL has {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if not _same(a, b, tolerance)]
    return f"{len(wrong)} of {len(left)} rows differ, first {wrong[0]}" if wrong else None


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> None:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    for name in names or entry.queries():
        start = time.time()
        try:
            if name in entry.oracle_sql():
                problem = difference(spark, connection, name, sf_dir)
            else:
                problem = f"no SQL, {entry.queries()[name](spark, sf_dir).count()} rows"
        except Exception as error:  # keep going: one report for all queries
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {problem or 'ok'} ({time.time() - start:.1f} s)", flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
