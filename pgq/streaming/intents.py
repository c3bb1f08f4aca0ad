"""Intents that arrive as files: checked row by row, counted by regime and reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pgq.operators import checks, corpus
from pgq.plans.catalog import DRIVER, Catalog


def checked(spark: SparkSession, folder: str, catalog: Catalog = DRIVER) -> DataFrame:
    rows = spark.readStream.schema(corpus.SCHEMA).json(folder)
    return rows.withColumn("reason", checks.reason({k: v.properties for k, v in catalog.labels.items()}, list(catalog.patterns)))


def rejections(checked: DataFrame) -> DataFrame:
    return checked.groupBy("regime", F.coalesce("reason", F.lit("ok")).alias("reason")).count()
