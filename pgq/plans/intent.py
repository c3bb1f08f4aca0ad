"""Normal form of an intent, and checks with reason codes.  Plain dicts in, plain dicts out."""

from __future__ import annotations

import re
from datetime import date
from typing import Any

from .catalog import Catalog

REGIMES = [f"{a}_{b}_query" for a in ("simple", "relational") for b in ("lookup", "count", "aggregation", "ranking")]
OPERATORS = ("=", "!=", ">", "<", ">=", "<=", "contains")
VALUES = ("value_str", "value_int", "value_float", "value_bool")
ACCEPTS = {"float": ("float", "int"), "int": ("int",), "string": ("str",), "bool": ("bool",), "date": ("str", "int", "date")}
FUNCTIONS = ("count", "avg", "sum", "min", "max")
MAX_HOPS = 3


class IntentError(ValueError):
    def __init__(self, reason: str, message: str):
        super().__init__(message)
        self.reason = reason


def _kind(v: Any) -> str | None:
    return "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str" if isinstance(v, str) else None


def _items(v: Any) -> list:
    return v if isinstance(v, list) else [v] if isinstance(v, (dict, str)) and v else []


def _text(v: Any) -> str | None:
    return v if isinstance(v, str) else None


def _name(v: Any) -> str | None:
    return _text(v.get("label") if isinstance(v, dict) else v)


def _step(s: Any) -> tuple | None:
    """All encodings of a path step: a triple, {source, relationship, target}, {from, relationship | rel, to}."""
    if isinstance(s, (list, tuple)) and len(s) == 3:
        return tuple(map(_text, s))
    if isinstance(s, dict):
        got = (_name(s.get("source", s.get("from"))), _text(s.get("relationship", s.get("rel"))), _name(s.get("target", s.get("to"))))
        return got
    return None


def _filter(f: dict) -> dict:
    """Every value that a filter gives, in the field of its own type; `value` counts if it gives no other."""
    out = {k: _text(f.get(k)) for k in ("node_label", "attribute", "operator")} | dict.fromkeys(VALUES)
    given = [f[k] for k in VALUES if f.get(k) is not None] or [f.get("value")]
    for v in given:
        if (kind := _kind(v)) and out[f"value_{kind}"] is None:
            out[f"value_{kind}"] = v
    return out


def normalize(raw: Any) -> dict:
    """Never raises: what can't be read becomes the default of its field.  Idempotent."""
    raw = raw if isinstance(raw, dict) else {}
    schema = next((raw[k] for k in ("schema", "schema_spec") if isinstance(raw.get(k), dict)), {k: v for k, v in raw.items() if k != "intent"} if "target" in raw else {})
    meta = raw.get("intent") if isinstance(raw.get("intent"), dict) else {}
    limit = schema.get("limit")
    limit = limit.get("value") if isinstance(limit, dict) else limit
    order = schema.get("order_by")
    agg = schema.get("aggregate")
    returns = schema.get("return_attributes", schema.get("return"))
    return {
        "regime": next((x for x in (meta.get("regime"), raw.get("regime"), raw.get("user_intent")) if isinstance(x, str)), None),
        "modifiers": [m for m in _items(meta.get("modifiers", raw.get("modifiers"))) if isinstance(m, str)],
        "schema": {
            "target": {"label": _name(schema.get("target"))},
            "path": [s for s in map(_step, [schema["path"]] if isinstance(schema.get("path"), dict) and schema["path"] else schema.get("path") if isinstance(schema.get("path"), list) else []) if s],
            "filters": [_filter(f) for f in _items(schema.get("filters")) if isinstance(f, dict)],
            "aggregate": {k: _text(agg.get(k)) for k in ("function", "attribute")} if isinstance(agg, dict) and agg else None,
            "order_by": {k: _text(order.get(k)) for k in ("node_label", "attribute", "direction")} if isinstance(order, dict) and order else None,
            "limit": limit if isinstance(limit, int) and not isinstance(limit, bool) else None,
            "return_attributes": [a for a in _items(returns) if isinstance(a, str)],
        },
    }


def value_of(f: dict) -> Any:
    return next((f[k] for k in VALUES if f.get(k) is not None), None)


def positions(ir: dict) -> list[str]:
    """Labels by position on the path; the target alone without one."""
    s = ir["schema"]
    return [s["path"][0][0], *(p[2] for p in s["path"])] if s["path"] else [s["target"]["label"]]


def position_of(ir: dict, label: str | None) -> int:
    """The last position of a label (the target's, if none is named).  Where a label stands on a path twice, as in a
    self-relationship, an intent names its last node: the first can't be filtered, ordered by or returned."""
    labels = positions(ir)
    label = label or ir["schema"]["target"]["label"]
    return len(labels) - 1 - labels[::-1].index(label)


def contradicts(filters: list[dict], target: str | None = None) -> bool:
    """Some attribute of a node must be above a bound and below a smaller one."""
    low, high = {}, {}
    for f in filters:
        v, k = value_of(f), (f["node_label"] or target, f["attribute"])
        if _kind(v) in ("int", "float"):
            if f["operator"] in (">", ">="):
                low[k] = max(low.get(k, v), v)
            if f["operator"] in ("<", "<="):
                high[k] = min(high.get(k, v), v)
    return any(low[k] > high[k] for k in low.keys() & high.keys())


def is_day(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text)) and date.fromisoformat(text) < date(9999, 1, 1)
    except ValueError:
        return False


def validate(ir: dict, catalog: Catalog) -> None:
    """Raise IntentError with the first reason that applies, in the order of the checks below."""
    s, regime = ir["schema"], ir["regime"]

    def fail(reason: str, message: str):
        raise IntentError(reason, message)

    if regime is not None and regime not in REGIMES:
        fail("intent_meta", f"unknown regime {regime!r}")
    label = s["target"]["label"]
    if not isinstance(label, str) or label not in catalog.labels:
        fail("target", f"unknown target {label!r}")
    for a in s["return_attributes"]:
        if a not in catalog.attributes(label):
            fail("return_attributes", f"{label} has no attribute {a!r}")
    labels = positions(ir) if s["path"] else [label]
    for f in s["filters"]:
        at = f["node_label"] or label
        if at not in catalog.labels or f["attribute"] not in catalog.attributes(at):
            fail("filters", f"no attribute {f['attribute']!r} of {at!r}")
        if at not in labels:
            fail("label_not_in_pattern", f"{at} is not on the path")
        if f["operator"] not in OPERATORS:
            fail("filters", f"unknown operator {f['operator']!r}")
        given = [k for k in VALUES if f[k] is not None]
        if len(given) != 1:
            fail("filters", "exactly one value is needed")
        kind, want = _kind(f[given[0]]), catalog.attributes(at)[f["attribute"]]
        if kind not in ACCEPTS[want] or f["operator"] == "contains" and want != "string":
            fail("filters", f"{kind} does not fit {want} of {f['attribute']}")
        if want == "date" and not (is_day(f[given[0]]) if kind == "str" else 1 <= f[given[0]] <= 9998):
            fail("filters", "a date is YYYY-MM-DD or a year")
    if contradicts(s["filters"], label):
        fail("filters", "bounds exclude each other")
    ranking = bool(regime) and "ranking" in regime
    o = s["order_by"]
    if ranking and not o:
        fail("order_by", "a ranking needs order_by")
    if o:
        at = o["node_label"] or label
        if at not in labels or o["attribute"] not in catalog.attributes(at):
            fail("order_by", f"no attribute {o['attribute']!r} of {at!r} on the path")
        if str(o["direction"] or "asc").lower() not in ("asc", "desc"):
            fail("order_by", "direction is asc or desc")
    if ranking and s["limit"] is None:
        fail("limit", "a ranking needs a limit")
    if s["limit"] is not None and s["limit"] <= 0:
        fail("limit", "limit is above 0")
    if len(s["path"]) > MAX_HOPS:
        fail("path", f"{MAX_HOPS} steps at most")
    for i, step in enumerate(s["path"]):
        if tuple(step) not in catalog.patterns:
            fail("path", f"no pattern {step}")
        if i and s["path"][i - 1][2] != step[0]:
            fail("path", "steps do not chain")
    if s["path"] and label not in labels:
        fail("path", "the target is not on the path")
    g = s["aggregate"]
    if g and regime and ("lookup" in regime or ranking):
        fail("aggregate", f"{regime} takes no aggregate")
    if not g and regime and ("count" in regime or "aggregation" in regime):
        fail("aggregate", f"{regime} needs an aggregate")
    if g:
        if g["function"] not in FUNCTIONS:
            fail("aggregate", f"unknown function {g['function']!r}")
        if g["function"] == "count" and g["attribute"] is not None:
            fail("aggregate", "count takes no attribute")
        if g["function"] != "count" and catalog.attributes(label).get(g["attribute"]) not in ("int", "float"):
            fail("aggregate", f"{g['attribute']!r} is not a number of {label}")
    if regime and regime.startswith("simple") and s["path"]:
        fail("regime_path", "a simple query has no path")
    if regime and regime.startswith("relational") and not s["path"]:
        fail("regime_path", "a relational query has a path")


def respond(raw: Any, catalog: Catalog, then) -> dict:
    """{status: success, result} or {status: error, stage, message}."""
    try:
        ir = normalize(raw)
        validate(ir, catalog)
        return {"status": "success", "result": then(ir)}
    except IntentError as e:
        return {"status": "error", "stage": "validation", "reason": e.reason, "message": str(e)}
    except Exception as e:
        return {"status": "error", "stage": "unknown", "message": str(e)}


def to_cypher(ir: dict) -> str:
    """Text of the intent in Cypher: one variable a position, literals escaped."""
    s, labels = ir["schema"], positions(ir)
    lit = lambda v: "true" if v is True else "false" if v is False else str(v) if not isinstance(v, str) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    text = "MATCH (n0:" + labels[0] + ")" + "".join(f"-[:{p[1]}]->(n{i + 1}:{p[2]})" for i, p in enumerate(s["path"]))
    if s["filters"]:
        word = {"contains": "CONTAINS", "!=": "<>"}
        text += "\nWHERE " + " AND ".join(f"n{position_of(ir, f['node_label'])}.{f['attribute']} {word.get(f['operator'], f['operator'])} {lit(value_of(f))}" for f in s["filters"])
    t = f"n{position_of(ir, None)}"
    g = s["aggregate"]
    if g:
        return text + "\nRETURN " + ("count(*) AS count" if g["function"] == "count" else f"{g['function']}({t}.{g['attribute']}) AS {g['function']}_{g['attribute']}")
    text += "\nRETURN " + (", ".join(f"{t}.{a} AS {a}" for a in s["return_attributes"]) or t)
    if s["order_by"]:
        text += f"\nORDER BY n{position_of(ir, s['order_by']['node_label'])}.{s['order_by']['attribute']} {str(s['order_by']['direction'] or 'asc').upper()}"
    return text + (f"\nLIMIT {s['limit']}" if s["limit"] is not None else "")
