import json
import math

import pytest
from pyspark.sql import functions as F

from pgq.operators import corpus as K
from pgq.operators import evaluation as E
from pgq.operators.planner import plan
from pgq.plans import intent as I
from pgq.plans.catalog import DRIVER, Catalog, Label, load


def ir(**schema):
    return {"schema": {"target": {"label": "Customer"}, **schema}}


@pytest.mark.parametrize("raw", [None, 3, [], {}, {"schema": 1}, {"schema": {"filters": "x", "path": {}, "order_by": [], "limit": "5"}}, {"schema": {"limit": True}}, {"schema": {"limit": 5.0, "return_attributes": ["a", 1]}}])
def test_normal_form_never_fails_and_is_idempotent(raw):
    once = I.normalize(raw)
    assert I.normalize(once) == once
    assert once["schema"]["limit"] is None


def test_aliases():
    got = I.normalize({"user_intent": "simple_lookup_query", "schema": {"target": "Customer", "filters": {"attribute": "c_acctbal", "operator": ">", "value": 4}, "limit": {"value": 3}, "return": "c_name"}})
    assert got["regime"] == "simple_lookup_query" and got["schema"]["target"] == {"label": "Customer"}
    assert got["schema"]["filters"][0]["value_int"] == 4 and got["schema"]["limit"] == 3 and got["schema"]["return_attributes"] == ["c_name"]
    assert I.normalize(ir(filters=[{"attribute": "x", "operator": "=", "value": True}]))["schema"]["filters"][0]["value_bool"] is True


@pytest.mark.parametrize("step", [["Nation", "HAS_CUSTOMER", "Customer"], {"source": {"label": "Nation"}, "relationship": "HAS_CUSTOMER", "target": {"label": "Customer"}}, {"from": "Nation", "relationship": "HAS_CUSTOMER", "to": "Customer"}, {"from": "Nation", "rel": "HAS_CUSTOMER", "to": "Customer"}])
def test_path_encodings(step):
    assert I.normalize(ir(path=[step]))["schema"]["path"] == [("Nation", "HAS_CUSTOMER", "Customer")]


P = [["Nation", "HAS_CUSTOMER", "Customer"]]
F_OK = {"node_label": "Customer", "attribute": "c_acctbal", "operator": ">", "value": 1}


@pytest.mark.parametrize(
    "reason, regime, schema",
    [
        ("intent_meta", "odd", {}),
        ("target", None, {"target": {"label": "Nobody"}}),
        ("return_attributes", None, {"return_attributes": ["zzz"]}),
        ("filters", None, {"filters": [{**F_OK, "attribute": "zzz"}]}),
        ("filters", None, {"filters": [{**F_OK, "operator": "~"}]}),
        ("filters", None, {"filters": [{**F_OK, "value": "x"}]}),
        ("filters", None, {"filters": [{**F_OK, "value": None}]}),
        ("filters", None, {"filters": [{**F_OK, "value": 9}, {**F_OK, "operator": "<", "value": 2}]}),
        ("label_not_in_pattern", None, {"filters": [{**F_OK, "node_label": "Part", "attribute": "p_size"}]}),
        ("order_by", "simple_ranking_query", {"limit": 3}),
        ("order_by", None, {"order_by": {"attribute": "c_acctbal", "direction": "up"}}),
        ("limit", "simple_ranking_query", {"order_by": {"attribute": "c_acctbal", "direction": "asc"}}),
        ("limit", None, {"limit": 0}),
        ("path", None, {"path": [["Nation", "OWNS", "Customer"]]}),
        ("path", None, {"path": P + [["Part", "SOLD_AS", "LineItem"]]}),
        ("aggregate", "simple_lookup_query", {"aggregate": {"function": "count"}}),
        ("aggregate", "simple_count_query", {}),
        ("aggregate", None, {"aggregate": {"function": "count", "attribute": "c_acctbal"}}),
        ("aggregate", None, {"aggregate": {"function": "avg", "attribute": "c_name"}}),
        ("regime_path", "simple_lookup_query", {"path": P}),
        ("regime_path", "relational_lookup_query", {}),
    ],
)
def test_reasons(reason, regime, schema):
    got = I.respond({"regime": regime, **ir(**schema)}, DRIVER, lambda x: x)
    assert (got["status"], got["stage"], got["reason"]) == ("error", "validation", reason)


def test_cypher_text():
    x = I.normalize(ir(path=[["Region", "CONTAINS", "Nation"], *P], filters=[{"node_label": "Region", "attribute": "r_name", "operator": "!=", "value": "O'X"}], return_attributes=["c_name"], order_by={"attribute": "c_acctbal", "direction": "desc"}, limit=2))
    assert I.to_cypher(x) == "MATCH (n0:Region)-[:CONTAINS]->(n1:Nation)-[:HAS_CUSTOMER]->(n2:Customer)\nWHERE n0.r_name <> 'O\\'X'\nRETURN n2.c_name AS c_name\nORDER BY n2.c_acctbal DESC\nLIMIT 2"


def test_schema_files(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    a.write_text(json.dumps({"nodes": {"A": {"properties": {"x": "int"}}}, "patterns": [["A", "R", "A"]]}))
    b.write_text(json.dumps({"nodes": {"A": {"properties": ["x"]}}, "allowed_patterns": [{"start": "A", "relationship": "R", "end": "A"}]}))
    assert load(str(a)).patterns == load(str(b)).patterns and load(str(b)).outgoing("A") == [("R", "A")]


def test_nulls_are_largest_and_aggregates_skip_them(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "k int, v double").write.parquet(str(tmp_path / "t.parquet"))
    c = Catalog({"T": Label("t", {"k": "int", "v": "float"}, ("k",))})
    run = lambda **s: [tuple(r) for r in plan(spark, str(tmp_path), {"schema": {"target": "T", **s}}, c).collect()]
    order = lambda d: {"attribute": "v", "direction": d}
    assert run(order_by=order("asc"), limit=3, return_attributes=["k"]) == [(3,), (1,), (2,)]
    assert run(order_by=order("desc"), limit=3, return_attributes=["k"]) == [(2,), (1,), (3,)]
    assert run(aggregate={"function": "avg", "attribute": "v"}) == [(1.5,)]
    assert run(filters=[{"attribute": "k", "operator": ">", "value": 9}], aggregate={"function": "sum", "attribute": "v"}) == [(None,)]


def rows(spark, data):
    return spark.createDataFrame(data, K.SCHEMA)


def one(i, regime="simple_lookup_query", target="A", path=(), filters=()):
    return (i, regime, target, list(path), [(None, a, o, v) for a, o, v in filters], None, None, None, [])


def test_golden_coverage(spark):
    step = [("Neighborhood", "CONTAINS", "Place")]
    data = [one(i, target="Neighborhood" if i < 82 else "Place", path=step if i >= 358 else ()) for i in range(583)]
    d = rows(spark, data).cache()
    assert K.entropy(K.counted(d, K.path_text(), "path")).first()[0] == 0.9621
    assert K.entropy(K.counted(d, F.col("target"), "target")).first()[0] == 0.5859
    assert {r.label: r.rate for r in K.node_coverage(d).collect()} == {"Neighborhood": 0.527, "Place": 1.245}
    assert K.entropy(K.counted(d.limit(0), F.col("target"), "target")).first()[0] == 0.0


@pytest.mark.parametrize("ratio", [0.1, 0.5, 0.9])
def test_split_is_the_greedy_one(spark, ratio):
    import hashlib
    import random

    rng = random.Random(1)
    data = [one(i, target=rng.choice("ABCDEFG"), filters=[(rng.choice("xyzuvw"), rng.choice("<>="), "1") for _ in range(rng.randrange(3))]) for i in range(60)]
    d = rows(spark, data)
    feats: dict = {}
    for r in K.features(d).collect():
        feats.setdefault(r.id, set()).add(r.feature)
    order = sorted(range(60), key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))
    train, rest, seen = [], [], set()
    for i in order:
        (train if feats[i] - seen else rest).append(i)
        seen |= feats[i]
    goal = int(60 * ratio)
    if len(train) < goal:
        train, rest = train + rest[: goal - len(train)], rest[goal - len(train) :]
    else:
        train = train[:goal]
    assert {r.id for r in K.split(d, ratio, 5).collect() if r.part == "train"} == set(train)


def test_evaluation_of_itself_is_perfect(spark):
    d = rows(spark, [one(1, filters=[("a", "=", "1"), ("b", "<", "2")]), one(2)])
    against = lambda other: E.judged(E.beside(d, other))
    assert E.exact_match(against(d)).first()[:] == (2, 2, 100.0)
    assert E.errors(against(d.withColumn("filters", F.reverse("filters")))).count() == 0  # order of filters does not count
    assert [tuple(r) for r in E.errors(against(d.withColumn("filters", F.slice("filters", 1, 1)))).collect()] == [(1, "filters", "2", "1")]
    assert E.report(against(d).withColumn("regime", F.lit("a")).withColumn("predicted_regime", F.lit("a")))["field_accuracy"] == 100.0


def test_stream_of_intents(spark, tmp_path):
    from pgq.sources import intents as S
    from pgq.streaming import intents as T

    src = str(tmp_path / "in")
    S.write(rows(spark, [one(1, target="Customer"), one(2)]), src)
    assert S.read(spark, src).count() == 2
    q = T.rejections(T.checked(spark, src)).writeStream.outputMode("complete").format("memory").queryName("got").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.reason, r["count"]) for r in spark.table("got").collect()} == {("ok", 1), ("target", 1)}


def test_insert_before(spark):
    d = rows(spark, [one(1), one(2, "simple_ranking_query"), one(3)])
    got = K.insert_before(d, rows(spark, [one(9)]), "simple_ranking_query").orderBy("pos", "id")
    assert [r.id for r in got.collect()] == [1, 9, 2, 3]
    assert K.insert_before(d, rows(spark, [one(9)]), "none").where("id = 9").first().pos.a == math.inf


def test_bulk_normal_form_is_that_of_one_intent(spark):
    from pgq.operators import normal as N

    step = {"source": {"label": "A"}, "relationship": "R", "target": {"label": "B"}}
    some = [
        None, 3, [], {}, "x", {"schema": 1}, {"schema": {"filters": "x", "path": {}, "order_by": [], "limit": "5"}}, {"schema": {"limit": True}}, {"schema": {"limit": 5.0, "return_attributes": ["a", 1]}},
        ir(path=[["A", "R", "B"], step, {"from": "A", "relationship": "R", "to": "B"}, {"from": "A", "rel": "R", "to": "B"}, ["A"], 7]), ir(path=step), ir(filters={"attribute": "x", "operator": "=", "value": 4}),
        ir(filters=[{"attribute": "x", "operator": "=", "value": v} for v in (True, False, 0, 5.0, 2.5, "4", "", None)] + [3, "f", {"node_label": "A", "attribute": "x", "operator": "<", "value_float": 1.5, "value_str": None}]),
        ir(aggregate={"function": "avg", "attribute": "q"}, order_by={"attribute": "q", "direction": "asc"}, limit={"value": 3}), {"intent": {"regime": "r", "modifiers": ["filter", 2]}, "schema_spec": {"target": "Customer", "return": "c_name"}},
        {"user_intent": "u", "target": "Customer", "limit": 2}, ir(limit=-1),
    ]
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(some)] + [(99, "{broken"), (100, None)], "id long, raw string")
    got = {r.id: r for r in N.normalize(raw).collect()}
    for i, x in [*enumerate(some), (99, None), (100, None)]:
        want, r = I.normalize(x), got[i].asDict(recursive=True)
        s = want["schema"]
        assert (r["regime"], r["modifiers"], r["target"], r["limit"], r["return_attributes"]) == (want["regime"], want["modifiers"], s["target"]["label"], s["limit"], s["return_attributes"]), x
        assert [tuple(p.values()) for p in r["path"]] == s["path"] and r["filters"] == s["filters"] and r["aggregate"] == s["aggregate"] and r["order_by"] == s["order_by"], x
