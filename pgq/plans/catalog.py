"""A property graph over tables: labels with typed properties, and patterns that say how two labels join."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Label:
    table: str
    properties: dict[str, str]
    key: tuple[str, ...] = ()
    #: property -> column, where they differ; a property without a column of the table can't be used
    columns: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    """A relationship kept in a table of its own: (node column, edge column) pairs at its start and at its end.  `key` tells
    one relationship from another (all columns, if none)."""

    table: str
    start: tuple[tuple[str, str], ...]
    end: tuple[tuple[str, str], ...]
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Catalog:
    labels: dict[str, Label]
    #: (start, relationship, end) -> [(start column, end column)], an Edge, or [] where nothing says how to join
    patterns: dict[tuple[str, str, str], list[tuple[str, str]] | Edge] = field(default_factory=dict)

    def outgoing(self, label: str) -> list[tuple[str, str]]:
        return sorted((r, e) for s, r, e in self.patterns if s == label)

    def attributes(self, label: str) -> dict[str, str]:
        return self.labels[label].properties


def _pairs(x) -> tuple[tuple[str, str], ...]:
    return tuple((a, b) for a, b in x)


def load(path: str, mapping: dict | str | None = None) -> Catalog:
    """Read either shape of schema file: typed properties with pattern triples, or property lists with pattern objects.

    mapping (a dict, or the path of a JSON file) says where the graph is kept:
    {"labels": {label: {"table", "key": [..], "columns": {property: column}, "types": {property: type}}},
     "patterns": [{"start", "relationship", "end", "on": [[start column, end column]]}
               or {.., "edge": table, "from": [[node column, edge column]], "to": [[node column, edge column]], "key": [..]}]}.
    Without one, a label's table is its name in lower case, and no pattern can be traversed."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if isinstance(mapping, str):
        with open(mapping, encoding="utf-8") as f:
            mapping = json.load(f)
    own, joins = (mapping or {}).get("labels", {}), {}
    for m in (mapping or {}).get("patterns", []):
        to = Edge(m["edge"], _pairs(m["from"]), _pairs(m["to"]), tuple(m.get("key", ()))) if "edge" in m else list(_pairs(m["on"]))
        joins[m["start"], m["relationship"], m["end"]] = to
    labels = {}
    for name, spec in raw.get("nodes", {}).items():
        props, at = spec.get("properties", {}), own.get(name, {})
        typed = dict(props) if isinstance(props, dict) else dict.fromkeys(props, "string")
        labels[name] = Label(at.get("table", name.lower()), typed | at.get("types", {}), tuple(at.get("key", ())), dict(at.get("columns", {})))
    triples = [tuple(p) for p in raw.get("patterns", [])] + [(p["start"], p["relationship"], p["end"]) for p in raw.get("allowed_patterns", [])]
    return Catalog(labels, {t: joins.get(t, []) for t in triples})


DRIVER = Catalog(
    {
        "Region": Label("region", {"r_regionkey": "int", "r_name": "string"}, ("r_regionkey",)),
        "Nation": Label("nation", {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, ("n_nationkey",)),
        "Customer": Label("customer", {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "string"}, ("c_custkey",)),
        "Supplier": Label("supplier", {"s_suppkey": "int", "s_name": "string", "s_nationkey": "int", "s_acctbal": "float"}, ("s_suppkey",)),
        "Part": Label("part", {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float"}, ("p_partkey",)),
        "Order": Label("orders", {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "date", "o_orderpriority": "string"}, ("o_orderkey",)),
        "LineItem": Label("lineitem", {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int", "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "date"}),
        "Event": Label("events", {"event_id": "int", "ts": "date", "user_id": "int", "event_type": "string", "value": "float", "props": "string"}, ("event_id",)),
        "Document": Label("documents", {"doc_id": "int", "text": "string", "lang": "string", "source": "string", "n_chars": "int"}, ("doc_id",)),
        "Label": Label("labels", {"doc_id": "int", "quality": "int", "toxic": "int"}, ("doc_id",)),
    },
    {
        ("Region", "CONTAINS", "Nation"): [("r_regionkey", "n_regionkey")],
        ("Nation", "HAS_CUSTOMER", "Customer"): [("n_nationkey", "c_nationkey")],
        ("Nation", "HAS_SUPPLIER", "Supplier"): [("n_nationkey", "s_nationkey")],
        ("Customer", "PLACED", "Order"): [("c_custkey", "o_custkey")],
        ("Order", "HAS_ITEM", "LineItem"): [("o_orderkey", "l_orderkey")],
        ("Part", "SOLD_AS", "LineItem"): [("p_partkey", "l_partkey")],
        ("Supplier", "SUPPLIED", "LineItem"): [("s_suppkey", "l_suppkey")],
        ("Document", "HAS_LABEL", "Label"): [("doc_id", "doc_id")],
        ("Nation", "SAME_REGION", "Nation"): [("n_regionkey", "n_regionkey")],
    },
)
