"""Reports over every component and row, against brute force in Python."""

import json
import os
import re
from collections import Counter

import pytest

from pgq import catalog_queries as Q
from pgq.operators import evaluation as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict(recursive=True) for r in Q.intents(spark, SF).collect()]


def by_hand(g, p, path=""):
    """Errors by recursion, of trees whose lists are in order."""
    if type(g) is not type(p):
        return [(path, g, p)]
    if isinstance(g, dict):
        under = lambda k: f"{path}.{k}" if path else k
        lone = [(under(k), g.get(k, "<missing>"), p.get(k, "<missing>")) for k in g.keys() ^ p.keys()]
        return lone + [e for k in g.keys() & p.keys() for e in by_hand(g[k], p[k], under(k))]
    if isinstance(g, list):
        size = [(path, len(g), len(p))] if len(g) != len(p) else []
        return size + [e for i, (a, b) in enumerate(zip(g, p, strict=False)) for e in by_hand(a, b, f"{path}[{i}]")]
    return [] if g == p else [(path, g, p)]


def test_every_error_of_every_row(spark):
    done = Q.judged(spark, SF).select("id", "gold", "predicted", "errors", "exact").collect()
    kinds = Counter()
    for r in done:
        trees = [E.ordered(json.loads(t)) for t in (r.gold, r.predicted)]
        want = sorted((path, E.shown(a), E.shown(b)) for path, a, b in by_hand(*trees))
        assert sorted(map(tuple, r.errors)) == want and r.exact == (not want)
        kinds.update(re.sub(r"\[\d+\]", "", w[0]) for w in want)
    assert {"target.label", "path", "filters", "filters.value", "aggregate", "order_by.node_label", "limit", "return_attributes"} <= kinds.keys()
    assert any(e.path == "limit" and e.predicted == "<missing>" for r in done for e in r.errors)


@pytest.mark.parametrize("gold, predicted, errors, fields, components", [
    ('{"a": 1}', '{"a": 1.0}', {("a", "1", "1.0")}, (1, 0), {("a", 0)}),
    ('{"a": true}', '{"a": 1}', {("a", "True", "1")}, (1, 0), {("a", 0)}),
    ('{"a": null}', '{"a": null}', set(), (1, 1), {("a", 1)}),
    ('{"a": {"b": 1, "c": [2, 3]}}', "{}", {("a", '{"b": 1, "c": [2, 3]}', "<missing>")}, (3, 0), {("a", 0)}),
    ('{"a": [3, 1]}', '{"a": [1, 3, 9]}', {("a", "2", "3")}, (2, 2), {("a", 0)}),
    ('{"a": [3, 1]}', '{"a": [1, 3]}', set(), (2, 2), {("a", 1), ("a[0]", 1), ("a[1]", 1)}),
    ("{}", "no json", {("", "{}", "None")}, (0, 0), {("", 0)}),
    ('{"a": []}', '{"a": {}}', {("a", "[]", "{}")}, (0, 0), {("a", 0)}),
])
def test_rules_of_the_comparison(gold, predicted, errors, fields, components):
    g, p = E.ordered(E.parsed(gold)), E.ordered(E.parsed(predicted))
    found, total, right = E.differences(g, p)
    assert set(found) == errors and (total, right) == fields and set(E.components(g, p)) == components


def test_structures_and_insertion_take_every_row(spark, rows):
    least = {}
    for r in rows:
        k = repr({n: v for n, v in r.items() if n != "id"})
        least[k] = min(least.get(k, r["id"]), r["id"])
    assert sorted(r.id for r in Q.QUERIES["dedup_structures"](spark, SF).collect()) == sorted(least.values())
    at = min((float(r["id"]) for r in rows if r["regime"] == "simple_ranking_query"), default=float("inf"))
    want = [(r["id"], float(r["id"]), 1) for r in rows] + [(r["id"], at, 0) for r in rows]
    assert sorted(map(tuple, Q.QUERIES["insert_before_regime"](spark, SF).collect())) == sorted(want)
