"""An intent as a DataFrame plan: scans, equi-joins along the path, predicates, then aggregate or order, limit, project."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pgq.plans import intent as I
from pgq.plans.catalog import DRIVER, Catalog, Edge


def scan(spark: SparkSession, sf_dir: str, label: str, at: int, catalog: Catalog) -> DataFrame:
    """A label's table, columns named by position: a label can be on a path twice.  Properties kept under another column's
    name come under their own; a column of that name is hidden by them."""
    known = catalog.labels[label]
    df = spark.read.parquet(f"{sf_dir}/{known.table}.parquet")
    named = {p: c for p, c in known.columns.items() if c in df.columns}
    return df.select(*[F.col(c).alias(f"n{at}_{c}") for c in df.columns if c not in named], *[F.col(c).alias(f"n{at}_{p}") for p, c in named.items()])


def node_columns(df: DataFrame, at: int, label: str, catalog: Catalog) -> list[str]:
    """All columns of a node: its properties where a mapping names them, else those of its table."""
    have = [c for c in df.columns if c.startswith(f"n{at}_")]
    known = catalog.labels[label]
    return [f"n{at}_{p}" for p in known.properties if f"n{at}_{p}" in have] if known.columns else have


def usable(df: DataFrame, at: int, label: str, attribute: str) -> Column:
    name = f"n{at}_{attribute}"
    if name not in df.columns:
        raise I.IntentError("unmapped", f"no column holds {attribute!r} of {label}")
    return F.col(name)


def traverse(spark: SparkSession, sf_dir: str, df: DataFrame, step: tuple, i: int, catalog: Catalog) -> tuple[DataFrame, list[str]]:
    """df, which ends in node i, with node i + 1; also the columns that tell one relationship of this step from another."""
    how = catalog.patterns[tuple(step)]
    right = scan(spark, sf_dir, step[2], i + 1, catalog)
    every = lambda pairs, l, r: reduce(lambda a, b: a & b, [F.col(l + a) == F.col(r + b) for a, b in pairs])
    if isinstance(how, Edge):
        edge = spark.read.parquet(f"{sf_dir}/{how.table}.parquet")
        edge = edge.select(*[F.col(c).alias(f"e{i}_{c}") for c in edge.columns if not how.key or c in how.key or c in {b for _, b in (*how.start, *how.end)}])
        df = df.join(edge, every(how.start, f"n{i}_", f"e{i}_")).join(right, every(how.end, f"n{i + 1}_", f"e{i}_"))
        return df, [f"e{i}_{c}" for c in how.key] or edge.columns
    if not how:
        raise I.IntentError("unmapped", f"nothing says how to join {' '.join(step)}")
    keys = [f"n{i + k}_{c}" for k in (0, 1) for c in catalog.labels[step[2 * k]].key]
    return df.join(right, every(how, f"n{i}_", f"n{i + 1}_")), keys


def predicate(col: Column, op: str, value, kind: str) -> Column:
    if kind == "date":
        day = isinstance(value, str)
        lo = F.to_timestamp(F.lit(value if day else f"{value:04d}-01-01"))
        hi = F.to_timestamp(F.lit(str(date.fromordinal(date.fromisoformat(value).toordinal() + 1)) if day else f"{value + 1:04d}-01-01"))
        return {"=": (col >= lo) & (col < hi), "!=": (col < lo) | (col >= hi), ">": col >= hi, "<": col < lo, ">=": col >= lo, "<=": col < hi}[op]
    v = F.lit(value)
    return {"=": lambda: col == v, "!=": lambda: col != v, ">": lambda: col > v, "<": lambda: col < v, ">=": lambda: col >= v, "<=": lambda: col <= v, "contains": lambda: col.contains(v)}[op]()


def exact_sum(col: Column) -> Column:
    """A sum of doubles that does not depend on the order of its rows: of their decimal digits, if all of them have twelve
    places or fewer and 26 digits before the point, else of the doubles as they come."""
    digits = col.try_cast("decimal(38,12)")
    whole = F.count_if(col.isNotNull() & ~digits.cast("double").eqNullSafe(col.cast("double"))) == 0
    return F.when(whole, F.coalesce(F.try_sum(digits).cast("double"), F.sum(col.cast("double")))).otherwise(F.sum(col.cast("double")))


def plan(spark: SparkSession, sf_dir: str, raw: dict, catalog: Catalog = DRIVER, tie_break: bool = True) -> DataFrame:
    ir = I.normalize(raw)
    I.validate(ir, catalog)
    s, labels = ir["schema"], I.positions(ir)
    df = scan(spark, sf_dir, labels[0], 0, catalog)
    used: list[tuple[tuple, list[str]]] = []
    for i, step in enumerate(s["path"]):
        df, keys = traverse(spark, sf_dir, df, step, i, catalog)
        # a match uses no relationship twice: the same edge, or the same pair of nodes by the same pattern, met again
        for other, theirs in used:
            if other == tuple(step) and keys:
                df = df.where(~reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(keys, theirs, strict=True)]))
        used.append((tuple(step), keys))
    for f in s["filters"]:
        at = I.position_of(ir, f["node_label"])
        df = df.where(predicate(usable(df, at, labels[at], f["attribute"]), f["operator"], I.value_of(f), catalog.attributes(labels[at])[f["attribute"]]))
    t = I.position_of(ir, None)
    own = node_columns(df, t, labels[t], catalog)
    g = s["aggregate"]
    if g:
        if g["function"] == "count":
            return df.agg(F.count("*").alias("count"))
        col, name = usable(df, t, labels[t], g["attribute"]), f"{g['function']}_{g['attribute']}"
        whole = catalog.attributes(labels[t])[g["attribute"]] == "int"
        agg = {"sum": lambda: F.sum(col).cast("long") if whole else exact_sum(col), "avg": lambda: exact_sum(col) / F.count(col), "min": lambda: F.min(col), "max": lambda: F.max(col)}
        return df.agg(agg[g["function"]]().alias(name))
    if s["order_by"]:
        o = s["order_by"]
        at = I.position_of(ir, o["node_label"])
        col = usable(df, at, labels[at], o["attribute"])
        first = col.desc_nulls_first() if str(o["direction"] or "asc").lower() == "desc" else col.asc_nulls_last()
        keys = [c for k, l in enumerate(labels) for c in ([f"n{k}_{x}" for x in catalog.labels[l].key] or [x for x in df.columns if x.startswith(f"n{k}_")])]
        df = df.orderBy(first, *([F.col(c) for c in keys] if tie_break else []))
    if s["limit"] is not None:
        df = df.limit(s["limit"])
    if s["return_attributes"]:
        return df.select(*[usable(df, t, labels[t], a).alias(a) for a in s["return_attributes"]])
    return df.select(*[F.col(c).alias(c.split("_", 1)[1]) for c in own])
