"""Checks over rows of intents, as one expression each: the first reason to reject a row, or null.

`reason` is what plans/intent.validate() says of one intent, in the same order, for filters with typed values (as
normal.normalize() makes them) or with values as text, which fit a number or a truth value if they read as one.
`intent_reason` is the check of generated intents against a policy: what questions can speak of.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pgq.operators.corpus import compatible
from pgq.plans.intent import ACCEPTS, FUNCTIONS, MAX_HOPS, OPERATORS, REGIMES, VALUES
from pgq.plans.policies import Policy

TRUTH = ("true", "false", "1", "0", "yes", "no")


def _table(rows: dict[str, list[str]]) -> Column:
    """label -> list, as a map."""
    return F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))]) if rows else F.create_map().cast("map<string,array<string>>")


def _kinds(rows: dict[str, dict[str, str]]) -> Column:
    """label.attribute -> kind, as a map."""
    flat = [x for l, a in rows.items() for k, t in a.items() for x in (F.lit(f"{l}\x1f{k}"), F.lit(t))]
    return F.create_map(*flat) if flat else F.create_map().cast("map<string,string>")


def _kind_of(kinds: Column, label: Column, attribute: Column) -> Column:
    return F.try_element_at(kinds, F.concat(label, F.lit("\x1f"), attribute))


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def reads_as_number(text: Column) -> Column:
    """Text that is a number; with single underscores between digits, and nan and inf, as in the checks' own rules."""
    t = F.lower(F.trim(text))
    return F.coalesce(t.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$") | t.rlike(r"^[+-]?(nan|inf|infinity)$"), F.lit(False))


def reads_as_truth(text: Column) -> Column:
    return F.coalesce(F.lower(text).isin(*TRUTH), F.lit(False))


def _typed_misfit(f: Column, kind: Column) -> Column:
    """Not exactly one value, or one that does not fit the kind of its attribute."""
    given = sum((F.when(f[v].isNotNull(), 1).otherwise(0) for v in VALUES[1:]), F.when(f[VALUES[0]].isNotNull(), 1).otherwise(0))
    own = F.when(f["value_str"].isNotNull(), "str").when(f["value_int"].isNotNull(), "int").when(f["value_float"].isNotNull(), "float").otherwise("bool")
    fits = F.coalesce(F.array_contains(F.try_element_at(_table({k: list(v) for k, v in ACCEPTS.items()}), kind), own), F.lit(False))
    is_day = f["value_str"].rlike(r"^\d{4}-\d{2}-\d{2}\z") & f["value_str"].try_cast("date").between("0001-01-01", "9998-12-31")
    day = (kind == "date") & F.when(own == "str", ~F.coalesce(is_day, F.lit(False))).otherwise(~f["value_int"].between(1, 9998))
    return (given != 1) | ~fits | day


def _text_misfit(f: Column, kind: Column) -> Column:
    v = f["value"]
    return v.isNull() | (kind.isin("int", "float", "number") & ~reads_as_number(v)) | ((kind == "bool") & ~reads_as_truth(v)) | ((kind == "date") & ~F.coalesce(v.rlike(r"^\d{4}(-\d{2}-\d{2})?$"), F.lit(False)))


def reason(attributes: dict[str, dict[str, str]], triples: Sequence[tuple[str, str, str]], typed: bool = False) -> Column:
    """The first reason to reject a row for a catalog, or null."""
    kinds, labels_known = _kinds(attributes), F.array(*map(F.lit, attributes)).cast("array<string>")
    legal = F.array(*[F.lit("\x1f".join(t)) for t in triples]).cast("array<string>")
    regime, target, g, o, path = F.col("regime"), F.col("target"), F.col("aggregate"), F.col("order_by"), F.col("path")
    rank, simple, relational = regime.contains("ranking"), regime.startswith("simple"), regime.startswith("relational")
    needs, lookup = regime.contains("count") | regime.contains("aggregation"), regime.contains("lookup")
    yes = lambda c: F.coalesce(c, F.lit(False))
    labels = F.when(F.size(path) > 0, F.concat(F.array(F.get(path, 0)["src"]), F.transform(path, lambda p: p["dst"]))).otherwise(F.array(target))
    on_path = lambda l: yes(F.array_contains(labels, l))
    known = lambda l, a: _kind_of(kinds, l, a).isNotNull()

    def of_filter(f: Column) -> Column:
        at = F.coalesce(F.when(f["node_label"] != "", f["node_label"]), target)
        kind = _kind_of(kinds, at, f["attribute"])
        misfit = (_typed_misfit if typed else _text_misfit)(f, kind)
        bad = _no(f["operator"].isin(*OPERATORS)) | misfit | (yes(f["operator"] == "contains") & (kind != "string"))
        return F.when(kind.isNull(), "filters").when(~on_path(at), "label_not_in_pattern").when(bad, "filters")

    o_at = F.coalesce(F.when(o["node_label"] != "", o["node_label"]), target)
    chained = F.forall(F.sequence(F.lit(1), F.size(path) - 1), lambda i: yes(F.get(path, i - 1)["dst"] == F.get(path, i)["src"]))
    bad_agg = (
        _no(g["function"].isin(*FUNCTIONS)) | (g["function"] == "count") & g["attribute"].isNotNull()
        | (g["function"] != "count") & _no(_kind_of(kinds, target, g["attribute"]).isin("int", "float"))
    )
    return F.coalesce(
        F.when(regime.isNotNull() & ~regime.isin(*REGIMES), "intent_meta"),
        F.when(_no(F.array_contains(labels_known, target)), "target"),
        F.when(F.exists("return_attributes", lambda a: ~known(target, a)), "return_attributes"),
        F.get(F.array_compact(F.transform("filters", of_filter)), 0),
        F.when(~compatible(by_label=True, typed=typed), "filters"),
        F.when(yes(rank) & o.isNull() | o.isNotNull() & (~on_path(o_at) | _kind_of(kinds, o_at, o["attribute"]).isNull() | ~F.lower(F.coalesce(o["direction"], F.lit("asc"))).isin("asc", "desc", "")), "order_by"),
        F.when(yes(rank) & F.col("limit").isNull() | yes(F.col("limit") <= 0), "limit"),
        F.when((F.size(path) > MAX_HOPS) | F.exists(path, lambda p: _no(F.array_contains(legal, F.concat_ws("\x1f", p["src"], p["rel"], p["dst"])))) | (F.size(path) > 1) & ~chained | (F.size(path) > 0) & ~on_path(target), "path"),
        F.when(g.isNotNull() & yes(lookup | rank) | g.isNull() & yes(needs) | g.isNotNull() & yes(bad_agg), "aggregate"),
        F.when(yes(simple) & (F.size(path) > 0) | yes(relational) & (F.size(path) == 0), "regime_path"),
    )


def intent_reason(policy: Policy) -> Column:
    """The first reason to reject a generated row (values as text, modifiers in a list), or null."""
    kinds = _kinds(policy.visible)
    regime, target, g, o, path = F.col("regime"), F.col("target"), F.col("aggregate"), F.col("order_by"), F.col("path")
    rank, needs = regime.contains("ranking"), regime.contains("count") | regime.contains("aggregation")
    seen = lambda l, a: _kind_of(kinds, l, a)

    def bad_filter(f: Column) -> Column:
        kind, v = seen(f["node_label"], f["attribute"]), f["value"]
        number = kind.isin("int", "number") & ~reads_as_number(v)
        number_as_text = (kind == "str") & (f["attribute"] == "date") & F.coalesce(v.rlike(r"^\d+$"), F.lit(False))  # a year is a number, and no text
        return kind.isNull() | v.isNull() | number | (kind == "bool") & ~reads_as_truth(v) | number_as_text

    bad_agg = (g["function"] == "count") & (g["attribute"].isNotNull() | _no(target.isin(*policy.count_labels))) | (g["function"] != "count") & _no(seen(target, g["attribute"]).isin("int", "number"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.coalesce(
        F.when(regime.isNull() | F.col("modifiers").isNull(), "intent_meta"),
        F.when(target.isNull(), "target"),
        F.when(F.exists("return_attributes", lambda a: seen(target, a).isNull()), "return_attributes"),
        F.when(F.exists("filters", bad_filter), "filters"),
        F.when(yes(rank) & o.isNull() | o.isNotNull() & (seen(target, o["attribute"]).isNull() | _no(o["direction"].isin("asc", "desc"))), "order_by"),
        F.when(yes(rank) & F.col("limit").isNull() | yes(F.col("limit") <= 0), "limit"),
        F.when((F.size(path) > MAX_HOPS) | F.exists(path, lambda p: p["rel"].isNull() | p["dst"].isNull()), "path"),
        F.when(g.isNotNull() & yes(~needs) | g.isNull() & yes(needs) | g.isNotNull() & yes(bad_agg), "aggregate"),
        F.when(regime.startswith("simple") & (F.size(path) > 0) | regime.startswith("relational") & (F.size(path) == 0), "regime_path"),
    )
