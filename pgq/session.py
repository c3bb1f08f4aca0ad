"""Session set-up."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the driver was started in another folder."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")), ROOT) if x)
    return spark


def dealt(rows: DataFrame, *keys: str, most: int = 100_000) -> DataFrame:
    """Rows dealt out by their keys to every core, and to more partitions the more there are: for steps bound by CPU, as a
    file comes in few splits however many its rows.  To be called before rows grow wide; counting reads file footers."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(n, *keys)
