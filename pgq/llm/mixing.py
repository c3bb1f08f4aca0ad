"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document has the key -ln(u)/w, with u a hash of its id in (0, 1) and w its quality weight.  A source's target is
met by whole epochs first; what is left goes to the documents with the smallest keys until their sizes add up to it
(the document at the edge is taken if that brings the sum nearer).  Prefix sums run in two levels: keys fall into
narrow ranges whose sums are added up first, so no task holds a whole source.  Documents meet the plan of their source
without a shuffle: the plan is broadcast when its counted size is small, and beyond that the sources with many rows are,
of which there are few, while the rest join by source.  Sources themselves are ranked in one task: a row each.

Defined results: null and empty texts have size 0; very long texts count whole, and one that is larger than what is left of
its source's target is taken if that brings the sum nearer; a null source is a source of its own, after all others; a source of
size 0 has target 0; rows with equal source, id and key are taken together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
RANGES = 2048  # of keys, in a unit of the key
SMALL = 4 << 20  # bytes of a plan that is broadcast whole
SYMBOLS = "#$%&*|<>{}\\^~"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(text: Column) -> Column:
    """Quality weight in (0, 1]: fewer symbols, more weight."""
    n = F.length(text)
    return F.when(n > 0, 1.0 / (1.0 + 10.0 * (n - F.length(F.translate(text, SYMBOLS, ""))) / n)).otherwise(F.lit(1.0))


def key_of(doc_id: Column, text: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":mix"))), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return -F.log(u) / weight_of(text)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target by source: the level up to which weights fill the sources is the largest of the
    levels that come out when the sources are filled in order of size by weight."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    w = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    level = w.withColumn("level", (SHARE * F.sum("source_size").over(every) - MOST * before) / after)
    return level.select("source", "source_size", F.least(F.col("weight") * F.max("level").over(every), F.lit(float(MOST)) * F.col("source_size")).alias("target"))


def plan(sizes: DataFrame) -> DataFrame:
    """For each source: source_size, target, epochs, and the cut (key, doc_id) up to which documents are taken once more."""
    goal = targets(sizes).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    ranged = sizes.withColumn("range", F.floor(F.col("key") * RANGES))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("held"))
    run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(run), F.lit(0)))
    edge = sums.alias("s").join(goal.alias("g"), F.expr("s.source <=> g.source and s.before < g.rest")).select("s.source", "s.range", "s.before", "g.rest")
    edge = edge.groupBy("source").agg(F.max_by(F.struct("range", "before", "rest"), "range").alias("x")).select("source", "x.*")
    own = Window.partitionBy("e.source", "e.range").orderBy("r.key", F.asc_nulls_last("r.doc_id")).rowsBetween(Window.unboundedPreceding, -1)
    near = ranged.alias("r").join(edge.alias("e"), F.expr("r.source <=> e.source and r.range = e.range"))
    near = near.select("e.source", "e.before", "e.rest", "e.range", "r.key", "r.doc_id", "r.size", F.coalesce(F.sum("r.size").over(own), F.lit(0)).alias("inner"))
    cut = near.groupBy("source").agg(F.max(F.when(F.expr("before + inner + size / 2 <= rest"), F.struct("key", F.coalesce("doc_id", F.lit(C.NO_ID)).alias("id")))).alias("cut"), F.max("range").alias("range"))
    return goal.alias("g").join(cut.alias("c"), F.expr("g.source <=> c.source"), "left").select(
        "g.source", "source_size", "target", "epochs", F.coalesce(F.col("cut"), F.struct((F.col("range") / RANGES).alias("key"), F.lit(-(2**63)).alias("id"))).alias("cut")
    )


def with_plan(rows: DataFrame, sizes: DataFrame, small: int = SMALL) -> DataFrame:
    """rows with the columns of their source's plan; sizes: what sized() gave for them."""
    goal = C.materialize(plan(sizes).withColumnRenamed("source", "_pgq_source"))
    same = F.expr("source <=> _pgq_source")
    held = goal.agg(F.sum(F.coalesce(F.octet_length("_pgq_source"), F.lit(0)) + 100)).first()[0] or 0
    if held <= small:
        return rows.join(F.broadcast(goal), same)
    parts = C.partitions(rows.sparkSession)
    count = sizes.groupBy("source").agg(F.count("*").alias("n"))
    many = count.crossJoin(F.broadcast(sizes.agg(F.count("*").alias("every")))).where(F.col("n") * parts >= F.col("every")).select("source")  # `parts` rows at most
    hot = C.materialize(goal.join(F.broadcast(many), same, "left_semi"))
    cold = goal.join(F.broadcast(hot.select(F.col("_pgq_source").alias("source"))), same, "left_anti")
    return rows.join(F.broadcast(hot), same).unionByName(rows.join(F.broadcast(hot), same, "left_anti").join(cold, same))


def copies(cut: str = "cut") -> Column:
    """How often a document is taken, from its key and its source's plan."""
    once = F.col(cut).isNotNull() & (F.struct(F.col("key"), F.coalesce("doc_id", F.lit(C.NO_ID)).alias("id")) <= F.col(cut))
    return F.col("epochs") + F.when(once, 1).otherwise(0)


def sized(docs: DataFrame) -> DataFrame:
    return C.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), F.col("text")).alias("key")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    sizes = sized(docs)
    return with_plan(sizes, sizes).select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def op8(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it (0 to 2 times).  Documents of size 0 stay once: they
    weigh nothing."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.col("doc_id"), F.col("source"), key_of(F.col("doc_id"), F.col("text")).alias("key"), size_of(F.col("text")).alias("size"))
    both = with_plan(rows, sized(docs)).withColumn("n", F.when(F.col("size") > 0, copies()).otherwise(1).cast("int"))
    return both.where("n > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln(((('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / CASE WHEN length(text) > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * (length(text) - length(translate(text, '#$%&*|<>{}\^~', ''))) / length(text)) ELSE 1.0::DOUBLE END AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(weight * max(level) OVER (), 2.0::DOUBLE * source_size) AS target FROM v
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t
), p AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (size * (epochs + CASE WHEN before + size / 2::DOUBLE <= rest AND before < rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""
