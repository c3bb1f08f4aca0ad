"""Intents in JSON lines, datasets of several files, reports in JSON, batches of rows."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pgq.operators.corpus import SCHEMA


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_raw(spark: SparkSession, path: str, column: str = "raw") -> DataFrame:
    """Lines as they are, for normal.normalize(): each line of a file is one JSON text."""
    return spark.read.text(path).withColumnRenamed("value", column)


def read_parts(spark: SparkSession, files: dict[str, str], schema: str | None = None) -> DataFrame:
    """Files by the name of their part (train, validation, ..) as one table with a column `split`.  Without a schema,
    lines stay JSON text in `raw`."""
    one = lambda p: read(spark, p, schema) if schema else read_raw(spark, p)
    return reduce(DataFrame.unionByName, [one(p).withColumn("split", F.lit(k)) for k, p in files.items()])


def write(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame | dict, path: str, most: int = 10_000) -> None:
    """A small table, or a report that is a dict, as one JSON file on the driver; larger tables are refused."""
    rows = df
    if isinstance(df, DataFrame):
        rows = [json.loads(x) for x in df.limit(most + 1).toJSON().take(most + 1)]
        if len(rows) > most:
            raise ValueError(f"a report has {most} rows at most")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=2)


def batches(df: DataFrame, n: int) -> DataFrame:
    """Add `batch`: n rows of a partition at a time, in their order; nothing is counted or moved first."""
    at = F.monotonically_increasing_id()
    task, row = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("batch", F.shiftleft(task, 33) + F.floor(row / F.lit(n)).cast("long"))
