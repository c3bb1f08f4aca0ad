"""Evaluation of predicted intents: two JSON trees side by side.

Rows hold the expected and the predicted schema as JSON text.  Trees of any shape and depth are compared with types kept
(1, 1.0, true and "1" all differ), which no built-in function does, so batches of rows go through Arrow to a walk in Python;
all sums, rankings and rates are DataFrame steps on what it returns.

Lists are put in order first, since order says nothing in an intent: objects by their JSON text with keys in order, scalars by
value.  Then each pair of nodes is judged by what it is: types that differ, or a key that one side lacks, are one error for
the whole branch; scalars are an error if they differ; lists are an error if their sizes differ, and are compared element by
element as far as both go.

*Fields* count scalars: those that agree, of all; a branch that one side lacks counts its leaves, a clash of types those of
the expected side, surplus list elements nothing.  *Components* count by path: a list as a whole and, if sizes agree, by
element; filters pair by label, attribute, operator and value there.  Text that isn't JSON counts as null.

Errors, components and fields are each a function of their own, so a query runs the one it asks for.  Under two objects each
key is a walk of its own; what it found is kept in the worker, within bounds, for a branch that comes again.
"""

from __future__ import annotations

import json
import marshal
from collections.abc import Callable
from itertools import accumulate
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "<missing>"
_ABSENT = ...  # marshal takes it, JSON never gives it
KEPT, LONGEST = 8 << 20, 2048  # bytes of the branches that a worker remembers, and of one of them
_IN_ORDER = json.JSONEncoder(sort_keys=True)


def parsed(text: str | None) -> Any:
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def ordered(tree: Any) -> Any:
    """The tree with every list in order; a list of scalars that do not compare stays as it is."""
    if isinstance(tree, dict):
        return {k: ordered(v) for k, v in tree.items()}
    if not isinstance(tree, list):
        return tree
    by_text = bool(tree) and isinstance(tree[0], dict)
    try:
        return sorted(map(ordered, tree), key=_IN_ORDER.encode) if by_text else sorted(tree)
    except TypeError:
        return tree


def leaves(tree: Any) -> int:
    """Scalars in a tree; empty objects and lists have none."""
    todo, n = [tree], 0
    while todo:
        x = todo.pop()
        if isinstance(x, (dict, list)):
            todo.extend(x.values() if isinstance(x, dict) else x)
        else:
            n += 1
    return n


def shown(x: Any) -> str:
    """A value in an error: JSON with keys in order for objects and lists, else as Python prints it."""
    return MISSING if x is _ABSENT else json.dumps(x, sort_keys=True, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x)


def _by_key(path: str, g: dict, p: dict) -> list[tuple]:
    return [(f"{path}.{k}" if path else k, g.get(k, _ABSENT), p.get(k, _ABSENT)) for k in sorted(g.keys() | p.keys())]


def _by_index(path: str, g: list, p: list) -> list[tuple]:
    return [(f"{path}[{i}]", a, b) for i, (a, b) in enumerate(zip(g, p, strict=False))]


def differences(gold: Any, predicted: Any, at: str = "") -> tuple[list[tuple[str, str, str]], int, int]:
    """(path, expected, predicted) of every error, and how many fields there are and agree."""
    errors, total, right, todo = [], 0, 0, [(at, gold, predicted)]
    while todo:
        path, g, p = todo.pop()
        lone = g is _ABSENT or p is _ABSENT
        if lone or type(g) is not type(p):
            errors.append((path, shown(g), shown(p)))
            total += leaves(p if g is _ABSENT else g)
        elif isinstance(g, dict):
            todo += _by_key(path, g, p)
        elif isinstance(g, list):
            if len(g) != len(p):
                errors.append((path, str(len(g)), str(len(p))))
            todo += _by_index(path, g, p)
        else:
            total += 1
            right += g == p
            if g != p:
                errors.append((path, shown(g), shown(p)))
    return errors, total, right


def _paired(x: list) -> list:
    """Filters in the order in which components pair them."""
    return sorted(x, key=lambda f: [str(f.get(k)) for k in ("node_label", "attribute", "operator", "value")] if isinstance(f, dict) else [str(f)])


def components(gold: Any, predicted: Any, at: str = "") -> list[tuple[str, int]]:
    """(path, 1 if it agrees) of every component."""
    found, todo = [], [(at, gold, predicted)]
    while todo:
        path, g, p = todo.pop()
        if g is _ABSENT or p is _ABSENT or type(g) is not type(p):
            found.append((path, 0))
        elif isinstance(g, dict):
            todo += _by_key(path, g, p)
        elif isinstance(g, list):
            g, p = (_paired(g), _paired(p)) if path == "filters" else (g, p)
            found.append((path, int(g == p)))
            todo += _by_index(path, g, p) if len(g) == len(p) else []
        else:
            found.append((path, int(g == p)))
    return found


class Remembered:
    """A step on a pair of branches, whose lists it is given in order; pairs that come again are looked up."""

    def __init__(self, step: Callable[[Any, Any, str], Any]):
        self.step, self.known, self.size = step, {}, 0

    def __call__(self, at: str, g: Any, p: Any) -> Any:
        try:
            key = marshal.dumps((at, g, p), 2)  # tells 1, 1.0 and true apart
        except ValueError:  # nested too deeply for it
            return self.step(ordered(g), ordered(p), at)
        found = self.known.get(key)
        if found is None:
            found = self.step(ordered(g), ordered(p), at)
            if len(key) <= LONGEST:
                if self.size > KEPT:
                    self.known.clear()
                    self.size = 0
                self.known[key] = found
                self.size += len(key)
        return found

    def each(self, gold: pa.Array, predicted: pa.Array):
        """What the step finds in the branches of each pair of texts, the last key first, as a walk from the root takes them."""
        for a, b in zip(gold, predicted, strict=True):
            g, p = parsed(a.as_py()), parsed(b.as_py())
            both = isinstance(g, dict) and isinstance(p, dict)
            yield [self(*x) for x in reversed(_by_key("", g, p))] if both else [self("", g, p)]


_of_errors = Remembered(lambda g, p, at: differences(g, p, at)[0])
_of_components = Remembered(components)
_of_fields = Remembered(lambda g, p, at: (lambda e, total, right: (total, right, len(e)))(*differences(g, p, at)))


def _listed(rows: list[list], columns: Callable[[list], dict[str, pa.Array]]) -> pa.Array:
    """A list of structs for each row, from what its branches gave."""
    ends = pa.array([0, *accumulate(sum(map(len, r)) for r in rows)], pa.int32())
    made = columns([x for r in rows for found in r for x in found])
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(made.values()), list(made)))


def _errors(gold: pa.Array, predicted: pa.Array) -> pa.Array:
    at = lambda flat, i: pa.array([x[i] for x in flat], pa.string())
    return _listed(list(_of_errors.each(gold, predicted)), lambda flat: {k: at(flat, i) for i, k in enumerate(("path", "expected", "predicted"))})


def _components(gold: pa.Array, predicted: pa.Array) -> pa.Array:
    made = lambda flat: {"path": pa.array([x[0] for x in flat], pa.string()), "total": pa.array([1] * len(flat), pa.int64()), "correct": pa.array([x[1] for x in flat], pa.int64())}
    return _listed(list(_of_components.each(gold, predicted)), made)


def _fields(gold: pa.Array, predicted: pa.Array) -> pa.Array:
    rows = [tuple(map(sum, zip(*r, strict=True))) or (0, 0, 0) for r in _of_fields.each(gold, predicted)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["total", "correct", "errors"])


def _count(text: pd.Series) -> pd.Series:
    return text.map(lambda t: leaves(parsed(t))).astype("int64")


def leaf_count(text: Column) -> Column:
    """Scalars of JSON text."""
    return F.pandas_udf(_count, "bigint")(text)  # made here: a worker that imports this module has no session


def judged(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", deal: bool = True) -> DataFrame:
    """rows with errors array<struct<path, expected, predicted>>, components array<struct<path, total, correct>>, fields
    struct<total, correct> and exact boolean.

    The walk is bound by CPU: rows of a few partitions, as of one small file, are dealt out first, unless the caller has done so
    (deal=False), before they had their texts."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    spread = rows.repartition(cores) if deal and rows.rdd.getNumPartitions() < cores else rows
    of = lambda f, kind: F.arrow_udf(f, kind)(F.col(gold), F.col(predicted))
    errors = of(_errors, "array<struct<path:string,expected:string,predicted:string>>")
    parts = of(_components, "array<struct<path:string,total:bigint,correct:bigint>>")
    df = spread.select(*rows.columns, errors.alias("errors"), parts.alias("components"), of(_fields, "struct<total:bigint,correct:bigint,errors:bigint>").alias("_f"))
    return df.select(*rows.columns, "errors", "components", F.struct("_f.total", "_f.correct").alias("fields"), (F.col("_f.errors") == 0).alias("exact"))


def beside(gold: DataFrame, predicted: DataFrame, key: str = "id") -> DataFrame:
    """Rows of two corpora joined on their key, each whole row but its key and regime as one JSON text."""
    body = lambda d, name: d.select(key, F.to_json(F.struct(*[c for c in d.columns if c not in (key, "regime")]), {"ignoreNullFields": "false"}).alias(name))
    return body(gold, "gold").join(body(predicted, "predicted"), key)


def percent(right: Column, total: Column) -> Column:
    return F.coalesce(F.round(F.lit(100.0) * right / F.nullif(total, F.lit(0)), 2), F.lit(0.0))


def _each(done: DataFrame, what: Column | str, *also: str) -> DataFrame:
    """A row `e` for each element of a list.  Outer, as an inner explode asks for the size of the list before rows are dealt out:
    the whole walk twice, once in few tasks."""
    return done.select(*also, F.explode_outer(what).alias("e")).where("e is not null")


def errors(done: DataFrame, key: str = "id") -> DataFrame:
    return _each(done, "errors", key).select(key, "e.*")


def error_values(done: DataFrame) -> DataFrame:
    """Every distinct pair of what was expected and what predicted."""
    return _each(done, "errors").select("e.expected", "e.predicted").distinct()


def error_ranking(done: DataFrame) -> DataFrame:
    """path, expected, predicted, n: every distinct error, most frequent first."""
    found = _each(done, "errors").select("e.*")
    return found.groupBy("path", "expected", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path", "expected", "predicted")


def error_paths(done: DataFrame, k: int = 20) -> DataFrame:
    """The k paths with most errors."""
    found = _each(done, "errors").select("e.path")
    return found.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(k)


def component_accuracy(done: DataFrame) -> DataFrame:
    c = _each(done, "components").select("e.*")
    c = c.groupBy(F.col("path").alias("component")).agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    return c.withColumn("accuracy", percent(F.col("correct"), F.col("total")))


def field_accuracy(done: DataFrame) -> DataFrame:
    f = done.agg(F.coalesce(F.sum("fields.correct"), F.lit(0)).alias("correct"), F.coalesce(F.sum("fields.total"), F.lit(0)).alias("total"))
    return f.withColumn("accuracy", percent(F.col("correct"), F.col("total")))


def exact_match(done: DataFrame) -> DataFrame:
    return done.agg(F.count_if("exact").alias("exact"), F.count("*").alias("total")).withColumn("accuracy", percent(F.col("exact"), F.col("total")))


def regime_accuracy(done: DataFrame, regime: str = "regime", predicted: str = "predicted_regime") -> DataFrame:
    right = F.coalesce(F.col(regime) == F.col(predicted), F.lit(False))
    return done.agg(F.count_if(right).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", percent(F.col("correct"), F.col("total")))


def report(done: DataFrame, k: int = 20) -> dict:
    """All measures as one dict, for a JSON file: what it gathers are a few counts and `k` paths."""
    one = lambda d: d.first().asDict()
    exact, regime, fields = one(exact_match(done)), one(regime_accuracy(done)), one(field_accuracy(done))
    parts = component_accuracy(done).orderBy("component").limit(10_000).collect()
    return {
        "total_examples": exact["total"], "regime_accuracy": regime["accuracy"], "exact_schema_match": exact["accuracy"], "field_accuracy": fields["accuracy"],
        "component_accuracy": {r["component"]: r["accuracy"] for r in parts}, "most_common_errors": [{"path": r["path"], "count": r["n"]} for r in error_paths(done, k).collect()],
    }
