"""Intents made from policy tables, as one chain of projections: tables are literal maps, expansion is explode, chance is a
rank by hash.

paths -> projections -> filter sets -> aggregates -> orders -> limits -> distinct structures.  All regimes go through each
step at once; their knobs are looked up by name.  Nothing is joined after the paths and nothing shuffles before the last
step.  Chance is md5 of the seed and a row's own text, so reruns agree.  Caps come before sets grow: members of a product of
labels' filter sets are drawn by number, without making the product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pgq.operators import corpus as K
from pgq.plans.policies import DEFAULT, PLACE_PATTERNS, PLACES, Config, Policy

STEP = "array<struct<src:string,rel:string,dst:string>>"
FILTERS = "array<struct<node_label:string,attribute:string,operator:string,value:string>>"


def chance(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def number(seed: int, *parts: Column) -> Column:
    """A whole number from the first 13 hexadecimal digits of chance()."""
    return F.conv(F.substring(chance(seed, *parts), 1, 13), 16, 10).cast("long")


def some(items: Column, most: Column | int, seed: int, *parts: Column) -> Column:
    """`most` of a list by chance (all, if it has no more), in the order drawn."""
    drawn = F.array_sort(F.transform(items, lambda x: F.struct(chance(seed, *parts, x.cast("string")).alias("h"), x.alias("x"))))
    return F.transform(F.slice(drawn, F.lit(1), F.lit(most) if isinstance(most, int) else most), lambda s: s["x"])


def lookup(rows: dict, key: Column, kind: str) -> Column:
    """What a small table of plain values (strings, numbers, truth values, lists and tuples of them) says of a key, as a
    literal map; null if nothing."""

    def lit(x):
        return F.array(*map(lit, x)) if isinstance(x, list) else F.struct(*map(lit, x)) if isinstance(x, tuple) else F.lit(x)

    if not rows:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), lit(v).cast(kind))]), key)


def knob(config: Config, name: str, regime: Column | None = None) -> Column:
    kind = {bool: "boolean", int: "int"}
    rows = {k: getattr(v, name) for k, v in config.regimes.items()}
    return lookup(rows, F.col("regime") if regime is None else regime, kind[type(next(iter(rows.values()), 0))])


def path_rows(spark: SparkSession, labels: Sequence[str], patterns: Sequence[tuple[str, str, str]], policy: Policy = PLACES, config: Config = DEFAULT) -> DataFrame:
    """regime, target, labels, path: lone labels for simple regimes, else every path of one step or more that patterns
    and policy allow, up to the smaller of the regime's depth and that of its first label."""
    names = list(config.regimes)
    free = lambda l: policy.paths.get(l, ([], 0, False))
    edges = [(s, r, d, bool(free(s)[2])) for s, r, d in patterns if not free(s)[0] or d in free(s)[0]]
    steps = F.broadcast(spark.createDataFrame(edges, "src string, rel string, dst string, again boolean").coalesce(1))
    now = spark.createDataFrame([(l, int(policy.paths[l][1]) if l in policy.paths else 99) for l in labels], "label string, most int").coalesce(1)
    now = now.select("most", F.array("label").alias("labels"), F.array().cast(STEP).alias("path"))
    by = lambda kind: F.explode(F.array(*[F.lit(r) for r in names if r.startswith(kind)]).cast("array<string>")).alias("regime")
    out = now.select(by("simple"), "labels", "path")
    for d in range(1, max([0, *(r.depth for r in config.regimes.values())]) + 1):
        nxt = now.join(steps, F.element_at("labels", -1) == steps["src"]).where("again or not array_contains(labels, dst)")
        now = nxt.select("most", F.concat("labels", F.array("dst")).alias("labels"), F.concat("path", F.array(F.struct("src", "rel", "dst"))).alias("path"))
        out = out.unionByName(now.select(by("relational"), "labels", "path", "most").where(F.lit(d) <= F.least("most", knob(config, "depth"))).drop("most"))
    rank = F.row_number().over(Window.partitionBy("regime").orderBy(chance(config.seed, F.col("regime"), F.to_json("labels"), F.to_json("path")), F.to_json("path")))
    return out.withColumn("r", rank).where(F.col("r") <= knob(config, "paths")).select("regime", F.element_at("labels", -1).alias("target"), F.array_distinct("labels").alias("labels"), "path")


def base_rows(paths: DataFrame, policy: Policy = PLACES, config: Config = DEFAULT) -> DataFrame:
    """One row for each path and projection of its target, under a key of its own."""
    every = sorted({*policy.returns, *policy.filterable, *policy.paths})
    allowed = F.coalesce(lookup({l: policy.projections_of(l) for l in every}, F.col("target"), "array<array<string>>"), F.array(F.array(F.lit("name"))))
    drawn = paths.withColumn("return_attributes", F.explode(some(allowed, knob(config, "projections"), config.seed, F.col("regime"), F.to_json("path"))))
    key = F.md5(F.concat_ws("|", "regime", "target", F.to_json("path"), F.to_json("return_attributes")))
    return drawn.select(key.alias("base"), "regime", "target", "labels", "path", "return_attributes")


def drawn_value(policy: Policy, pairs: Sequence[tuple[str, str]], seed: int, label: Column, attribute: Column, *parts: Column) -> Column:
    """A value that the policy allows an attribute, by chance."""
    rows = {}
    for l, a in pairs:
        v = policy.values_of(l, a)
        rows[f"{l}.{a}"] = (v[0], v[1] - v[0] + 1, []) if isinstance(v, tuple) else (0, len(v), [str(x) for x in v])
    how = lookup(rows, F.concat(label, F.lit("."), attribute), "struct<least:bigint,span:bigint,choices:array<string>>")
    at = number(seed, *parts) % how["span"]
    return F.coalesce(F.get(how["choices"], at.cast("int")), (how["least"] + at).cast("string"))


def _candidates(label: Column, policy: Policy, config: Config) -> Column:
    """Filters that a label of a row may have: its attributes with a few of their operators, each with a value, in order."""
    pairs = [(l, a) for l, attrs in policy.filterable.items() for a in attrs if policy.operators_of(l, a)]
    table = {l: [(a, policy.operators_of(l, a)) for k, a in pairs if k == l] for l in dict(pairs)}
    seed, base = config.seed, F.col("base")

    def one(x: Column) -> Column:
        ops = some(x["operators"], config.operators_per_attribute, seed, base, label, x["attribute"])
        value = lambda o: drawn_value(policy, pairs, seed, label, x["attribute"], F.lit("value"), base, label, x["attribute"], o)
        return F.transform(ops, lambda o: F.struct(label.alias("node_label"), x["attribute"].alias("attribute"), o.alias("operator"), value(o).alias("value")))

    none = F.array().cast("array<struct<attribute:string,operators:array<string>>>")
    return F.array_sort(F.flatten(F.transform(F.coalesce(lookup(table, label, "array<struct<attribute:string,operators:array<string>>>"), none), one)))


def candidates(base: DataFrame, policy: Policy = PLACES, config: Config = DEFAULT) -> DataFrame:
    """base, label, attribute, operator, value: the filters that the labels of each row may have, a row each."""
    rows = base.select("base", F.explode(F.flatten(F.transform("labels", lambda l: _candidates(l, policy, config)))).alias("f"))
    return rows.select("base", F.col("f.node_label").alias("label"), "f.attribute", "f.operator", "f.value")


MOST = 16  # candidates that a label may have: there are 2 ^ MOST sets of them


def _sets(found: Column, config: Config) -> Column:
    """Sets of one to the regime's number of candidates, capped by size; each number's bits pick the members of a set."""
    largest = max([1, *(r.filters for r in config.regimes.values())])
    most = F.least(knob(config, "filters"), F.when(knob(config, "multiple") | ~F.col("regime").startswith("simple"), F.lit(largest)).otherwise(F.lit(1)))
    members = lambda m: F.filter(found, lambda c, i: F.call_function("getbit", m, i) == 1)
    numbers = F.filter(F.sequence(F.lit(1), F.pow(F.lit(2), F.size(found)).cast("int") - 1), lambda m: F.bit_count(m) <= most)
    of = lambda k: F.transform(F.filter(numbers, lambda m: F.bit_count(m) == k), members)
    cap = lambda k: F.when(F.col("regime").startswith("simple") & F.lit(k == 1), F.lit(1 << MOST)).otherwise(knob(config, "combinations"))
    drawn = F.concat(*[some(of(k), cap(k), config.seed, F.lit("set"), F.col("base")) for k in range(1, largest + 1)])
    return F.when(F.size(found) > 0, drawn).otherwise(F.array().cast(f"array<{FILTERS}>"))


def _together(sets: str, config: Config) -> Column:
    """Filters of a row: the sets of a lone label each, or one set of every label together.

    Of a product with more members than the regime's cap, members are drawn by number; a label without sets leaves its
    row without any."""
    size = F.transform(sets, lambda x: F.size(x).cast("long"))
    total = F.aggregate(size, F.lit(1).cast("long"), lambda a, b: a * b)
    cap, base = knob(config, "combinations"), F.col("base")
    tries = F.transform(F.sequence(F.lit(0), cap * 4), lambda i: number(config.seed, F.lit("product"), base, i.cast("string")) % total)
    drawn = F.when((F.size(sets) == 1) | (total <= cap), F.sequence(F.lit(0).cast("long"), total - 1)).otherwise(F.slice(F.array_distinct(tries), F.lit(1), cap))

    def member(m: Column) -> Column:
        """The sets whose numbers are the digits of m, in a number system whose bases are the sizes."""
        start = F.struct(m.alias("rest"), F.array().cast(FILTERS).alias("found"))
        step = lambda s, x: F.struct(F.floor(s["rest"] / F.size(x)).cast("long").alias("rest"), F.concat(s["found"], F.get(x, (s["rest"] % F.size(x)).cast("int"))).alias("found"))
        return F.aggregate(sets, start, step)["found"]

    return F.when(total > 0, F.transform(drawn, member)).otherwise(F.array().cast(f"array<{FILTERS}>"))


def distinct_attributes(filters: str = "filters") -> Column:
    """No (label, attribute) twice."""
    pair = F.transform(filters, lambda f: F.concat_ws("|", f["node_label"], f["attribute"]))
    return F.size(F.array_distinct(pair)) == F.size(filters)


def with_mandatory(rows: DataFrame, policy: Policy = PLACES, config: Config = DEFAULT) -> DataFrame:
    """Labels that are filtered always carry the filters that the policy demands."""
    for label, rules in policy.mandatory.items():
        for attribute, operator in rules:
            value = drawn_value(policy, [(label, attribute)], config.seed, F.lit(label), F.lit(attribute), F.lit("mandatory"), F.col("base"), F.to_json("filters"))
            rows = K.with_mandatory(rows, label, attribute, operator, value)
    return rows


def filtered(base: DataFrame, policy: Policy = PLACES, config: Config = DEFAULT) -> DataFrame:
    """Base rows with every filter set they take.  A policy that gives a label more than MOST candidates is refused."""
    most = max((sum(min(len(policy.operators_of(l, a)), config.operators_per_attribute) for a in attrs) for l, attrs in policy.filterable.items()), default=0)
    if most > MOST:
        raise ValueError(f"a label has {most} filter candidates, more than {MOST}: fewer attributes or operators_per_attribute")
    rows = base.withColumn("_c", F.transform("labels", lambda l: _candidates(l, policy, config))).withColumn("_s", F.transform("_c", lambda c: _sets(c, config)))
    rows = rows.withColumn("filters", F.explode(_together("_s", config))).drop("_c", "_s")
    return with_mandatory(rows.where(distinct_attributes() & K.compatible(numeric=policy.numeric)), policy, config)


def _variants(rows: DataFrame, kept: Column, name: str) -> DataFrame:
    """A row for each element of `kept`, with its filters and, where it has any, without them."""
    rows = rows.withColumn(name, F.explode(kept)).withColumn("_keep", F.explode(F.when((F.size("filters") > 0) & F.col("_twice"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    return rows.withColumn("filters", F.when(F.col("_keep"), F.col("filters")).otherwise(F.array().cast(FILTERS))).drop("_keep", "_twice")


def aggregated(rows: DataFrame, policy: Policy = PLACES) -> DataFrame:
    """Counts for count regimes; for aggregation regimes each function and attribute of the target, with the filters and
    without; other rows as they are."""
    kind = "struct<function:string,attribute:string>"
    table = {l: [(f, a) for a in attrs for f in policy.functions_of(a) if f != "count"] for l, attrs in policy.aggregatable.items()}
    sums = F.coalesce(lookup(table, F.col("target"), f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    count, lone = F.array(F.struct(F.lit("count").alias("function"), F.lit(None).cast("string").alias("attribute"))), F.array(F.lit(None).cast(kind))
    is_count, is_sum = F.col("regime").contains("count"), F.col("regime").contains("aggregation")
    done = _variants(rows.withColumn("_twice", is_sum), F.when(is_count, count).when(is_sum, sums).otherwise(lone), "aggregate")
    return done.withColumn("return_attributes", F.when(is_count | is_sum, F.array().cast("array<string>")).otherwise(F.col("return_attributes")))


def ordered(rows: DataFrame, policy: Policy = PLACES, config: Config = DEFAULT) -> DataFrame:
    """Rows of regimes with an order: attributes of the target (as many as the regime takes) in each direction, with the
    filters and without."""
    kind = "struct<node_label:string,attribute:string,direction:string>"
    every = F.coalesce(lookup(policy.orderable, F.col("target"), "array<string>"), F.array().cast("array<string>"))
    most = F.when(knob(config, "orders") > 0, knob(config, "orders")).otherwise(F.size(every))
    drawn = some(every, most, config.seed, F.lit("order"), F.col("base"), F.to_json("filters"))
    both = F.flatten(F.transform(drawn, lambda a: F.transform(F.array(*map(F.lit, config.directions)), lambda d: F.struct(F.col("target").alias("node_label"), a.alias("attribute"), d.alias("direction")))))
    has = knob(config, "order")
    return _variants(rows.withColumn("_twice", has), F.when(has, both).otherwise(F.array(F.lit(None).cast(kind))), "order_by")


def limited(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows of regimes with a limit: as many of the limit values as the regime takes."""
    every = F.array(*map(F.lit, config.limit_values))
    most = F.when(knob(config, "limits") > 0, knob(config, "limits")).otherwise(F.size(every))
    drawn = some(every, most, config.seed, F.lit("limit"), F.col("base"), F.to_json(F.struct("filters", "order_by")))
    return rows.withColumn("limit", F.explode(F.when(knob(config, "limit"), drawn).otherwise(F.array(F.lit(None).cast("int")))))


def modifiers() -> Column:
    """What a row has been given, once each.  Rows whose filters were taken off again keep `filter`, as the steps do."""
    return F.array_compact(F.array(
        F.lit("filter"), F.when(F.col("aggregate.function") == "count", "count").when(F.col("aggregate.function").isNotNull(), "aggregate"),
        F.when(F.col("order_by").isNotNull(), "order_by"), F.when(F.col("limit").isNotNull(), "limit"),
    ))


def generate(spark: SparkSession, labels: Sequence[str] = ("Place", "Neighborhood"), patterns: Sequence[tuple[str, str, str]] = tuple(PLACE_PATTERNS), policy: Policy = PLACES, config: Config = DEFAULT) -> DataFrame:
    """Distinct intents of all regimes of a configuration: id, regime, modifiers, target, path, filters, aggregate,
    order_by, limit, return_attributes."""
    base = base_rows(path_rows(spark, labels, patterns, policy, config), policy, config)
    rows = limited(ordered(aggregated(filtered(base, policy, config), policy), policy, config), config)
    rows = rows.select("regime", modifiers().alias("modifiers"), "target", "path", "filters", "aggregate", "order_by", "limit", "return_attributes")
    rows = rows.withColumn("id", F.xxhash64(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})))
    rows = rows.select("id", *[c for c in rows.columns if c != "id"])
    return rows.dropDuplicates(["id"]) if config.deduplicate else rows


def dataset(spark: SparkSession, labels: Sequence[str] = ("Place", "Neighborhood"), patterns: Sequence[tuple[str, str, str]] = tuple(PLACE_PATTERNS), policy: Policy = PLACES, config: Config = DEFAULT, top: int = 6) -> DataFrame:
    """The whole way to a corpus: generate, keep what passes the checks, the regimes with most rows, buckets balanced."""
    from pgq.operators import checks

    made = generate(spark, labels, patterns, policy, config)
    good = made.where(checks.intent_reason(policy).isNull())
    return K.balance(K.top_regimes(good, top), config.min_per_bucket, config.max_per_bucket, config.seed)
