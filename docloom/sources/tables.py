"""Reading and writing tables: Parquet, JSON lines and CSV, with a schema where the format has none."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from docloom.functions.text import guard_formula


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a task that sorts or groups whole tables, about.
ROWS_A_TASK = 200_000


def tasks_for(table: DataFrame, rows: int = ROWS_A_TASK) -> int:
    """How many tasks a table's rows are dealt to, so that a task's share stays the same as the table grows. Counting a table
    of Parquet reads its footers only."""
    return max(table.sparkSession.sparkContext.defaultParallelism, math.ceil(table.count() / rows))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed lines become rows of nulls with the line in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With headers; text that a spreadsheet would run as a formula is quoted."""
    out = df.select(*(guard_formula(df[c]).alias(c) if t == "string" else df[c] for c, t in df.dtypes))
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """One folder a key value; rows of a key meet first, so each folder gets few files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
