"""Intents in bulk: generation, checks, buckets, balancing, splits, reports and evaluation, as DataFrame steps.

A corpus row: id long, regime string, target string, path array<struct<src,rel,dst>>, filters
array<struct<node_label,attribute,operator,value>>, aggregate struct<function,attribute>, order_by
struct<node_label,attribute,direction>, limit int, return_attributes array<string>.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = (
    "id long, regime string, target string, path array<struct<src:string,rel:string,dst:string>>, filters array<struct<node_label:string,attribute:string,operator:string,value:string>>, "
    "aggregate struct<function:string,attribute:string>, order_by struct<node_label:string,attribute:string,direction:string>, `limit` int, return_attributes array<string>"
)


def rank_hash(seed: int, *cols: str) -> Column:
    """A reproducible stand-in for chance: rows in its order are shuffled."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


# -- generation ---------------------------------------------------------------------------------------------------------


def paths(spark: SparkSession, triples: Sequence[tuple[str, str, str]], depth: int, cycles: bool = False) -> DataFrame:
    """Every path of 1 to depth steps along the patterns; without cycles no label comes twice."""
    edges = spark.createDataFrame(list(triples), "src string, rel string, dst string")
    step = edges.select(F.array(F.struct("src", "rel", "dst")).alias("path"), F.array("src", "dst").alias("labels"))
    if not cycles:
        step = step.where("labels[0] <> labels[1]")
    out, now = step, step
    for _ in range(depth - 1):
        nxt = now.join(edges, F.element_at("labels", -1) == edges.src)
        if not cycles:
            nxt = nxt.where(~F.expr("array_contains(labels, dst)"))
        now = nxt.select(F.concat("path", F.array(F.struct("src", "rel", "dst"))).alias("path"), F.concat("labels", F.array("dst")).alias("labels"))
        out = out.unionByName(now)
    return out


def combinations(candidates: DataFrame, group: str, key: str, most: int, cap: int, seed: int = 0) -> DataFrame:
    """Sets of 1 to `most` candidates of a group, as sorted arrays of keys.  A group gives `cap` candidates at most (by hash
    order), before sets grow, so a group makes fewer than (cap + 1) ^ most sets."""
    w = Window.partitionBy(group).orderBy(rank_hash(seed, group, key), key)
    base = candidates.select(group, key).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")
    now = base.select(group, F.array(key).alias("set"))
    out = now
    for _ in range(most - 1):
        now = now.join(base, group).where(F.col(key) > F.element_at("set", -1)).select(group, F.concat("set", F.array(key)).alias("set"))
        out = out.unionByName(now)
    return out


def expand_aggregates(intents: DataFrame, policy: DataFrame) -> DataFrame:
    """Each intent with every (function, attribute) its target allows, with and without its filters.

    A policy has a few rows for each label of a catalog: it goes to the intents, as a join dealt by target would give each
    label's intents to one task."""
    both = intents.join(F.broadcast(policy.withColumnRenamed("label", "target")), "target").withColumn("aggregate", F.struct("function", "attribute")).drop("function", "attribute")
    bare = F.slice("filters", 1, 0)
    return both.withColumn("filters", F.explode(F.when(F.size("filters") > 0, F.array("filters", bare)).otherwise(F.array("filters")))).select(both.columns)


def expand_ranking(intents: DataFrame, policy: DataFrame, limits: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Each intent with every order (attribute x direction) its target allows and every limit; the policy goes to the intents."""
    both = intents.join(F.broadcast(policy.withColumnRenamed("label", "target")), "target")
    both = both.withColumn("direction", F.explode(F.array(F.lit("asc"), F.lit("desc")))).withColumn("limit", F.explode(F.array(*map(F.lit, limits))))
    return both.withColumn("order_by", F.struct(F.col("target").alias("node_label"), "attribute", "direction")).drop("attribute", "direction")


def with_mandatory(intents: DataFrame, label: str, attribute: str, operator: str, value: str | Column) -> DataFrame:
    """Filters on a label always come with one on a certain attribute."""
    needs = F.exists("filters", lambda f: f["node_label"] == label) & ~F.exists("filters", lambda f: (f["node_label"] == label) & (f["attribute"] == attribute))
    more = F.array(F.struct(F.lit(label).alias("node_label"), F.lit(attribute).alias("attribute"), F.lit(operator).alias("operator"), (value if isinstance(value, Column) else F.lit(value)).alias("value")))
    return intents.withColumn("filters", F.when(needs, F.concat("filters", more)).otherwise(F.col("filters")))


def compatible(filters: str = "filters", by_label: bool = False, typed: bool = False, numeric: Sequence[str] | None = None) -> Column:
    """No attribute has a lower bound above an upper one.

    Generated filters are compared by attribute alone, whatever their label (of the attributes in `numeric`, if given);
    by_label: bounds of one node only, as in the checks before a plan is made.  typed: values in value_int and value_float."""
    own = lambda x: F.coalesce(x["value_float"], x["value_int"].cast("double")) if typed else x["value"].try_cast("double")
    label = lambda x: F.coalesce(F.when(x["node_label"] != "", x["node_label"]), F.col("target"))
    same = lambda x, f: (x["attribute"] == f["attribute"]) & (label(x).eqNullSafe(label(f)) if by_label else F.lit(True))
    bound = lambda ops, f: F.transform(F.filter(filters, lambda x: same(x, f) & x["operator"].isin(*ops)), own)
    counts = lambda f: f["attribute"].isin(*numeric) if numeric is not None else F.lit(True)
    return ~F.exists(filters, lambda f: counts(f) & F.coalesce(F.array_max(bound((">", ">="), f)) > F.array_min(bound(("<", "<="), f)), F.lit(False)))


def dedup_structures(intents: DataFrame) -> DataFrame:
    """One row (smallest id) of those that are alike but for their id."""
    body = F.to_json(F.struct(*[c for c in intents.columns if c != "id"]), {"ignoreNullFields": "false"})
    return intents.withColumn("_k", F.sha2(body, 256)).groupBy("_k").agg(F.min_by(F.struct(*intents.columns), "id").alias("x")).select("x.*")


# -- curation -----------------------------------------------------------------------------------------------------------


def bucket() -> Column:
    n = F.size("return_attributes")
    flag = lambda name, c: F.concat(F.lit(name + "="), F.when(c, 1).otherwise(0).cast("string"))
    return F.concat_ws(
        ";", "regime", F.concat(F.lit("depth_"), F.least(F.size("path"), F.lit(2)).cast("string")), flag("filter", F.size("filters") > 0), flag("agg", F.col("aggregate.function").isNotNull()),
        flag("order", F.col("order_by.attribute").isNotNull()), flag("limit", F.col("limit").isNotNull()), F.when(n > 2, "proj_many").otherwise(F.concat(F.lit("proj_"), n.cast("string"))),
    )


def per_group(df: DataFrame, group: str, most: int, seed: int = 0, key: str = "id") -> DataFrame:
    """At most `most` rows of each group, in hash order."""
    w = Window.partitionBy(group).orderBy(rank_hash(seed, key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def balance(df: DataFrame, least: int, most: int | None, seed: int = 0) -> DataFrame:
    """Rows by bucket: min(n, max(least, most)); all without a most."""
    b = df.withColumn("bucket", bucket())
    return b if most is None else per_group(b, "bucket", max(least, most), seed)


def top_regimes(df: DataFrame, k: int) -> DataFrame:
    best = df.groupBy("regime").count().orderBy(F.desc("count"), "regime").limit(k).select("regime")
    return df.join(best, "regime", "left_semi")


def features(df: DataFrame, key: str = "id") -> DataFrame:
    """(id, feature): labels, relationships, label.attribute and operators of each row."""
    label = lambda f: F.coalesce(f["node_label"], F.col("target"))
    every = F.array_distinct(F.concat(
        F.array(F.concat(F.lit("label:"), F.col("target"))), F.transform("path", lambda p: F.concat(F.lit("label:"), p["src"])), F.transform("path", lambda p: F.concat(F.lit("label:"), p["dst"])),
        F.transform("path", lambda p: F.concat(F.lit("rel:"), p["rel"])), F.transform("filters", lambda f: F.concat(F.lit("attr:"), label(f), F.lit("."), f["attribute"])), F.transform("filters", lambda f: F.concat(F.lit("op:"), f["operator"])),
    ))
    return df.select(key, F.explode(every).alias("feature"))


def split(df: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Add `part`: a row is in train if it is the first, in hash order, with one of its features; then rows move from the
    front of the rest, or from the back of train, until train has int(n * ratio) rows."""
    ranked = df.withColumn("_h", rank_hash(seed, "id"))
    first = features(df).groupBy("feature").agg(F.min(F.struct(rank_hash(seed, "id").alias("h"), "id"))["id"].alias("id")).select("id").distinct().withColumn("_first", F.lit(1))
    both = ranked.join(first, "id", "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
    total = df.agg(F.count("*").alias("_n")).withColumn("_goal", F.floor(F.col("_n") * ratio).cast("long"))
    # global ranks in two levels: ranges of the hash are counted before rows are ranked inside them
    both = both.withColumn("_g", F.substring("_h", 1, 3))
    counts = both.groupBy("_first", "_g").count()
    base = counts.withColumn("_base", F.coalesce(F.sum("count").over(Window.partitionBy("_first").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inner = F.row_number().over(Window.partitionBy("_first", "_g").orderBy("_h", "id"))
    both = both.withColumn("_i", inner).join(base, ["_first", "_g"]).withColumn("_rank", F.col("_base") + F.col("_i"))
    sizes = both.agg(F.sum("_first").alias("_t")).crossJoin(total)  # one row
    both = both.crossJoin(F.broadcast(sizes))
    train = F.when(F.col("_first") == 1, F.col("_rank") <= F.greatest(F.col("_goal"), F.lit(0))).otherwise(F.col("_rank") <= F.col("_goal") - F.col("_t"))
    return both.withColumn("part", F.when(train, "train").otherwise("validation")).select(*df.columns, "part")


def missing(df: DataFrame) -> DataFrame:
    """Features of the corpus that train lacks."""
    return features(df).select("feature").distinct().join(features(df.where("part = 'train'")).select("feature").distinct(), "feature", "left_anti")


def insert_before(rows: DataFrame, block: DataFrame, regime: str, order: str = "id") -> DataFrame:
    """`block` before the first row of a regime, at the end if there is none; adds `pos` (two numbers) to sort by."""
    at = rows.agg(F.min(F.when(F.col("regime") == regime, F.col(order))).alias("at"))
    old = rows.withColumn("pos", F.struct(F.col(order).cast("double").alias("a"), F.lit(1).alias("b")))
    new = block.crossJoin(F.broadcast(at)).withColumn("pos", F.struct(F.coalesce(F.col("at").cast("double"), F.lit(math.inf)).alias("a"), F.lit(0).alias("b"))).drop("at")
    return old.unionByName(new)


# -- reports ------------------------------------------------------------------------------------------------------------


def path_text() -> Column:
    return F.when(F.size("path") == 0, F.lit("[]")).otherwise(F.array_join(F.transform("path", lambda p: F.concat(p["src"], F.lit("-"), p["rel"], F.lit("->"), p["dst"])), "|"))


def counted(df: DataFrame, what: Column, name: str) -> DataFrame:
    return df.groupBy(what.alias(name)).agg(F.count("*").alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    p = F.col("n") / F.col("total")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).agg(F.coalesce(F.round(-F.sum(p * F.log2(p)), 4), F.lit(0.0)).alias("entropy"))


def node_coverage(df: DataFrame) -> DataFrame:
    """How often a label is a step's end or a target, by the number of intents."""
    nodes = df.select(F.explode(F.concat(F.transform("path", lambda p: p["src"]), F.transform("path", lambda p: p["dst"]), F.array("target"))).alias("label"))
    total = df.agg(F.count("*").alias("total"))
    return nodes.groupBy("label").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("total"), 3).alias("rate"))


def top_paths(df: DataFrame, k: int = 5) -> DataFrame:
    """The k paths with most intents."""
    return counted(df, path_text(), "path").orderBy(F.desc("n"), "path").limit(k)


def rates(counts: DataFrame, total: DataFrame) -> DataFrame:
    """counts with rate: n by the one number of `total`, to three places."""
    return counts.crossJoin(F.broadcast(total.toDF("_total"))).withColumn("rate", F.round(F.col("n") / F.col("_total"), 3)).drop("_total")


def coverage_report(df: DataFrame) -> dict:
    """All counts and rates of a corpus as one dict, for a JSON file; what it gathers has a row for each label or path
    of a catalog, never for each intent."""
    total = df.agg(F.count("*").alias("n"))
    n = total.first()[0]
    by = lambda d, k: {str(r[k]): r["n"] for r in d.orderBy(F.desc("n"), k).limit(10_000).collect()}
    path, target = counted(df, path_text(), "path"), counted(df, F.col("target"), "target")
    targets = by(target, "target")
    return {
        "total_intents": n, "unique_paths": path.count(), "top_paths": [[r["path"], r["n"]] for r in top_paths(df).collect()], "start_nodes": targets,
        "node_coverage": {r["label"]: r["rate"] for r in node_coverage(df).collect()}, "relationship_usage": by(counted(df.select(F.explode("path").alias("p")), F.col("p.rel"), "rel"), "rel"),
        "depth_distribution": by(counted(df, F.size("path"), "depth"), "depth"), "unique_targets": len(targets), "target_distribution": targets,
        "target_rate": {r["target"]: r["rate"] for r in rates(target, total).collect()}, "path_entropy": entropy(path).first()[0], "target_entropy": entropy(target).first()[0],
    }


def rejections(reasoned: DataFrame) -> DataFrame:
    """n by regime and reason; rows without a reason are kept, and not counted."""
    return reasoned.where("reason is not null").groupBy("regime", "reason").agg(F.count("*").alias("n"))


def for_augmentation(df: DataFrame) -> DataFrame:
    """Aggregations without filters: the rows that get more questions."""
    return df.where("regime in ('simple_aggregation_query', 'relational_aggregation_query') and size(filters) = 0")


def covered(df: DataFrame) -> DataFrame:
    """A split whose train part has every feature, or ValueError that names some that it lacks."""
    lacks = missing(df).orderBy("feature").limit(10).collect()
    if lacks:
        raise ValueError(f"train lacks {', '.join(r[0] for r in lacks)}")
    return df
