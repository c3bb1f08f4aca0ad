"""Connected components of a large graph as star contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs -> (node, root): every node that has an edge to another one, with the smallest node of its
    component (roots themselves are left out).

    Alternates large-star and small-star steps: each links the neighbours of a node to the smallest among them, so a path
    halves with every round.  Every round is one written table; a hub costs a row an edge, never a gathered list.  A hub's
    edges share a join key, which AQE's skew join splits.

    Defined results: loops and repeated edges count once; nodes without an edge to another, and no edges at all, give no
    rows; a null end never joins, so such edges have no effect.
    """
    e = C.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"), F.col("a").alias("hub")).where("a > hub and a <> b").select("a", "b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = C.materialize(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(now)
