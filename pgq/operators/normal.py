"""The normal form of raw intents in bulk: JSON text in, typed columns out, as expressions over variants.

It never fails: text that isn't JSON, and parts of a type that can't be read, become the default of their field.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES = ("value_str", "value_int", "value_float", "value_bool")


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is worked out once: inside a lambda nothing else keeps Spark from doing so for each mention."""
    return F.get(F.transform(F.array(x), f), 0)


def _kind(v: Column) -> Column:
    """The type of a scalar: a cast would turn "5" into 5.  Of an object or list it walks all of it; they are told by _held()
    and _listed(), which look at one level."""
    return F.schema_of_variant(v)


def _held(v: Column) -> Column:
    """The keys and values of an object, null of anything else."""
    return _get(v, "$", "map<string,variant>")


def _listed(v: Column) -> Column:
    """The elements of a list, null of anything else."""
    return _get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", _get(v, "$", "string"))


def _first(v: Column, *paths: str) -> Column:
    return F.coalesce(*[_text(_get(v, p)) for p in paths])


def _items(v: Column, *single: str) -> Column:
    """The elements of a list; a lone element of one of the types `single` counts as a list of one, if not empty."""
    full = {"OBJECT": lambda x: F.size(_held(x)) > 0, "STRING": lambda x: _text(x) != ""}
    one = lambda x: reduce(lambda a, b: a | b, [F.coalesce(full[k](x), F.lit(False)) for k in single])
    return _let(v, lambda x: F.coalesce(_listed(x), F.when(one(x), F.array(x)), F.array().cast("array<variant>")))


def _filter(f: Column) -> Column:
    """Every value that a filter gives, in the field of its own type; `value` counts if it gives no other."""
    names = ("node_label", "attribute", "operator")
    kinded = lambda v: F.struct(v.alias("v"), _kind(v).alias("k"))

    def typed(x: Column, given: Column) -> Column:
        of = lambda test, kind: _get(F.get(F.filter(given, lambda g: test(g["k"])), 0)["v"], "$", kind)
        real = lambda k: k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT")
        return F.struct(
            *[_text(x[n]).alias(n) for n in names], of(lambda k: k == "STRING", "string").alias("value_str"), of(lambda k: k == "BIGINT", "long").alias("value_int"),
            of(real, "double").alias("value_float"), of(lambda k: k == "BOOLEAN", "boolean").alias("value_bool"),
        )

    def fields(x: Column) -> Column:
        given = F.filter(F.transform(F.array(*[x[k] for k in VALUES]), kinded), lambda g: g["k"] != "VOID")
        return _let(_let(given, lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(kinded(x["value"])))), lambda g: typed(x, g))

    return _let(_get(f, "$", f"struct<{','.join(f'{k}:variant' for k in (*names, *VALUES, 'value'))}>"), fields)


def _step(s: Column) -> Column:
    """All encodings of a path step: a triple, {source, relationship, target}, {from, relationship | rel, to}."""
    name = lambda *keys: _first(s, *[p for k in keys for p in (f"$.{k}.label", f"$.{k}")])
    part = lambda a, i, other: F.when(a.isNotNull(), _text(F.get(a, i))).otherwise(other)
    return _let(_listed(s), lambda a: F.struct(part(a, 0, name("source", "from")).alias("src"), part(a, 1, _first(s, "$.relationship", "$.rel")).alias("rel"), part(a, 2, name("target", "to")).alias("dst")))


def normalize(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Replace a column of JSON text by regime, modifiers, target, path, filters (typed values), aggregate, order_by, limit
    and return_attributes."""
    rest = [c for c in raw.columns if c != column]
    v = F.try_parse_json(F.col(column))
    d = raw.select(*rest, v.alias("_v"))
    schema = [F.when(_held(_get(F.col("_v"), p)).isNotNull(), _get(F.col("_v"), p)) for p in ("$.schema", "$.schema_spec")]
    d = d.withColumn("_s", F.coalesce(*schema, F.when(_get(F.col("_v"), "$.target").isNotNull(), F.col("_v"))))
    s, x = F.col("_s"), F.col("_v")
    limit = _get(s, "$.limit")
    limit = F.when(_held(limit).isNotNull(), _get(s, "$.limit.value")).otherwise(limit)
    returns = F.coalesce(_get(s, "$.return_attributes"), _get(s, "$.return"))
    held = lambda p: F.size(_held(_get(s, p))) > 0
    texts = lambda a: F.filter(F.transform(a, _text), lambda t: t.isNotNull())
    return d.select(
        *rest, _first(x, "$.intent.regime", "$.regime", "$.user_intent").alias("regime"), texts(_items(F.coalesce(_get(x, "$.intent.modifiers"), _get(x, "$.modifiers")), "STRING")).alias("modifiers"),
        _first(s, "$.target.label", "$.target").alias("target"),
        F.transform(F.filter(_items(_get(s, "$.path"), "OBJECT"), lambda e: _held(e).isNotNull() | F.coalesce(F.size(_listed(e)) == 3, F.lit(False))), _step).alias("path"),
        F.transform(F.filter(_items(_get(s, "$.filters"), "OBJECT"), lambda e: _held(e).isNotNull()), _filter).alias("filters"),
        F.when(held("$.aggregate"), F.struct(_first(s, "$.aggregate.function").alias("function"), _first(s, "$.aggregate.attribute").alias("attribute"))).alias("aggregate"),
        F.when(held("$.order_by"), F.struct(*[_first(s, f"$.order_by.{k}").alias(k) for k in ("node_label", "attribute", "direction")])).alias("order_by"),
        F.when(_kind(limit) == "BIGINT", _get(limit, "$", "int")).alias("limit"), texts(_items(returns, "STRING")).alias("return_attributes"),
    )
