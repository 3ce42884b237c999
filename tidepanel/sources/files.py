"""Readers and writers: CSV panels, prepared bundles, fitted tables, models, JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


# Standard quoting: a quote inside a quoted value is doubled.
QUOTING = {"header": True, "quote": '"', "escape": '"'}
KEPT_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """A CSV file with a header line. An empty value is a missing one.

    Without a schema the types are inferred, which reads the file twice;
    declare them for large files, and a line that does not fit them raises.
    ``multi_line`` allows line breaks inside quoted values; a file can then not
    be split between tasks.
    """
    reader = spark.read.options(**QUOTING, multiLine=multi_line)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.option("mode", "FAILFAST").schema(schema).csv(path)


def split_csv(
    spark: SparkSession, path: str, schema: StructType | str, out: str, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): the lines of a CSV file that fit the schema, and the others as they stand.

    A line is rejected if a value does not fit its type or if it has too few or
    too many values. The file is read once: both sides are written to ``out``,
    in a folder each. ``rejected`` has one column, ``line``; an empty file gives
    two empty tables.
    """
    columns = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    line, fits = "line", "fits"
    while {line, fits} & {c.lower() for c in columns.names}:
        line, fits = f"{line}_", f"{fits}_"
    whole = StructType([StructField(c.name, c.dataType) for c in columns]).add(line, "string")
    reader = spark.read.options(**QUOTING, multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=line)
    read = reader.schema(whole).csv(path).withColumn(fits, F.col(line).isNull())
    read.write.mode("overwrite").partitionBy(fits).parquet(out)
    both = spark.read.schema(read.schema).parquet(out)
    return both.where(F.col(fits)).select(*columns.names), both.where(~F.col(fits)).select(F.col(line).alias("line"))


def write_csv(df: DataFrame, path: str, multi_line: bool = False) -> None:
    """Write with standard quoting. A value with a line break raises unless ``multi_line``
    allows it, since other readers of split files would see two lines."""
    if not multi_line:
        broken = F.raise_error(F.lit("a value holds a line break: write and read it with multi_line"))
        df = df.withColumns(
            {
                c: F.when(F.col(c).rlike("[\r\n]"), broken.cast("string")).otherwise(F.col(c))
                for c, kind in df.dtypes
                if kind == "string"
            }
        )
    df.write.mode("overwrite").options(**QUOTING, **KEPT_BLANKS).csv(path)


def write_bundle(prepared: DataFrame, path: str) -> None:
    """Prepared rows, one folder per side of the split, so a reader of one side skips the other."""
    prepared.write.mode("overwrite").partitionBy("split").parquet(path)


def read_bundle(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    bundle = spark.read.parquet(path)
    return bundle.where(F.col("split") == split) if split else bundle


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def write_json(df: DataFrame, path: str) -> None:
    """Metric and settings tables of a few rows, as one file; large tables belong to ``write_table``."""
    df.repartition(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema else spark.read.json(path)


def write_params(spark: SparkSession, params: Mapping[str, object], path: str) -> None:
    write_json(spark.createDataFrame([dict(params)]), path)


def read_params(spark: SparkSession, path: str) -> dict[str, object]:
    """One row of settings; columns without a value are left out."""
    row = read_json(spark, path).first()
    return {k: v for k, v in row.asDict().items() if v is not None} if row else {}
