"""Generation, checks, text, configuration and sources."""

import json
import os
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pgq.functions import text as T
from pgq.operators import checks, generate
from pgq.operators import corpus as K
from pgq.operators import normal as N
from pgq.operators.planner import plan
from pgq.plans import intent as I
from pgq.plans import policies as P
from pgq.plans.catalog import DRIVER, load
from pgq.sources import config
from pgq.sources import intents as S


@pytest.fixture(scope="module")
def made(spark):
    return [r.asDict(recursive=True) for r in generate.generate(spark).collect()]


def test_generated_intents_keep_the_policies(made):
    assert {r["regime"] for r in made} == set(P.CAPS) and len({r["id"] for r in made}) == len(made)
    for r in made:
        knobs, fs, target = P.CAPS[r["regime"]], r["filters"], r["target"]
        labels = {target} | {p[k] for p in r["path"] for k in ("src", "dst")}
        assert len(r["path"]) <= knobs.depth and (r["path"] == []) == r["regime"].startswith("simple") and not r["path"] or r["path"][-1]["dst"] == target
        assert len({(f["node_label"], f["attribute"]) for f in fs}) == len(fs) and {f["node_label"] for f in fs} <= labels
        for f in fs:
            v = P.PLACES.values_of(f["node_label"], f["attribute"])
            assert f["operator"] in P.PLACES.operators_of(f["node_label"], f["attribute"])
            assert v[0] <= int(f["value"]) <= v[1] if isinstance(v, tuple) else f["value"] in map(str, v)
        if any(f["node_label"] == "Place" for f in fs):
            assert any((f["node_label"], f["attribute"]) == ("Place", "type") for f in fs)
        for label in labels:
            assert sum(f["node_label"] == label for f in fs) <= knobs.filters + 1
        if fs and len(labels) > 1:
            assert {f["node_label"] for f in fs} == labels  # every label of a path is filtered
        if "lookup" in r["regime"] or "count" in r["regime"]:
            assert fs
        assert (r["order_by"] is not None) == knobs.order and (r["limit"] in (5, 10, 20)) == knobs.limit and (r["aggregate"] is not None) == knobs.aggregation
        assert "filter" in r["modifiers"] and ("limit" in r["modifiers"]) == knobs.limit and ("count" in r["modifiers"]) == ("count" in r["regime"])
    twin = lambda kind: {bool(r["filters"]) for r in made if kind in r["regime"]}
    assert twin("aggregation") == twin("ranking") == {True, False}


def test_generation_is_the_same_again_and_other_with_another_seed(spark, made):
    again = {r.id for r in generate.generate(spark).select("id").collect()}
    other = {r.id for r in generate.generate(spark, config=replace(P.DEFAULT, seed=7)).select("id").collect()}
    assert again == {r["id"] for r in made} != other


def test_caps_hold_and_products_are_drawn_without_making_them(spark):
    tight = P.overlay(P.DEFAULT, {"relational_lookup_query": {"max_filter_combinations": 3, "max_depth": 3}, "simple_lookup_query": {"max_filter_combinations": 2, "allow_multiple_filters": False}})
    labels, patterns = ["Place", "Neighborhood", "Road"], [("Neighborhood", "CONTAINS", "Road"), ("Road", "CONTAINS", "Place")]
    base = generate.base_rows(generate.path_rows(spark, labels, patterns, P.PLACES, tight), P.PLACES, tight).where("regime like '%lookup%'")
    rows = generate.filtered(base, P.PLACES, tight)
    assert rows.where("regime like 'relational%'").groupBy("base").count().agg(F.max("count")).first()[0] <= 3
    assert rows.where("regime like 'relational%' and size(path) = 2").count() > 0
    assert rows.where("regime like 'simple%' and size(filter(filters, f -> f.attribute <> 'type')) > 1").count() == 0


def test_a_policy_with_too_many_candidates_is_refused(spark):
    wide = replace(P.PLACES, filterable={"Place": [f"a{i}" for i in range(9)]}, operators={"Place": {f"a{i}": [">", "<"] for i in range(9)}})
    base = generate.base_rows(generate.path_rows(spark, ["Place"], [], wide), wide)
    with pytest.raises(ValueError, match="18 filter candidates"):
        generate.filtered(base, wide)


def test_dataset_passes_the_checks_and_balances(spark):
    d = generate.dataset(spark, config=replace(P.DEFAULT, min_per_bucket=3, max_per_bucket=5), top=4)
    got = d.withColumn("why", checks.intent_reason(P.PLACES)).collect()
    assert got and all(r.why is None for r in got) and len({r.regime for r in got}) == 4
    assert max(d.groupBy("bucket").count().toPandas()["count"]) <= 5


def test_aggregates_that_pass_are_the_six_of_the_published_file(spark):
    good = generate.generate(spark).where(checks.intent_reason(P.PLACES).isNull()).where("regime = 'simple_aggregation_query'")
    assert {tuple(r) for r in good.select("target", "aggregate.function", "aggregate.attribute").distinct().collect()} == {
        ("Neighborhood", "avg", "area_km2"), ("Neighborhood", "sum", "area_km2"), ("Neighborhood", "avg", "average_monthly_income"), ("Neighborhood", "sum", "total_resident_population"), ("Place", "avg", "rating"), ("Place", "sum", "num_reviews"),
    }


def random_intent(rng):
    labels = list(DRIVER.labels)
    pick = lambda *x: rng.choice(x)
    path, at = [], rng.choice(labels)
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
        out = DRIVER.outgoing(at)
        step = [at, *rng.choice(out)] if out and rng.random() < 0.9 else [rng.choice(labels), "CONTAINS", rng.choice(labels)]
        path.append(step)
        at = step[2]
    target = at if rng.random() < 0.9 else rng.choice([*labels, "Nobody", None])
    nodes = [target] + [p[0] for p in path]
    attr = lambda l: rng.choice([*DRIVER.labels[l].properties, "zzz"] if l in DRIVER.labels and rng.random() < 0.97 else ["zzz", None])
    value = lambda: rng.choice([1, 5, 1996, 0, 70000, 2.5, True, "x", "12", "1996-02-30", "1996-02-28", "0000-01-01", None])

    def flt():
        l = rng.choice(nodes + labels[:1])
        f = {"node_label": rng.choice([l, None, l, l]), "attribute": attr(l), "operator": rng.choice([*I.OPERATORS, ">", "<", "~", None])}
        return f | rng.choice([{"value": value()}, {"value_int": rng.randrange(9)}, {"value_int": 3, "value_str": "q"}, {"value_str": "BUILDING"}, {"value_float": 1.5}])

    regime = rng.choice([*I.REGIMES, *I.REGIMES, "odd", None])
    agg = {"function": pick("count", "avg", "sum", "best", None), "attribute": pick(None, None, attr(target))} if rng.random() < (0.8 if regime and ("count" in regime or "agg" in regime) else 0.05) else None
    order = {"node_label": pick(None, target), "attribute": attr(target), "direction": pick("asc", "DESC", "up", None, "")} if rng.random() < (0.8 if regime and "rank" in regime else 0.1) else None
    return {"regime": regime, "schema": {"target": {"label": target}, "path": path, "filters": [flt() for _ in range(rng.choice([0, 0, 1, 2, 3]))], "aggregate": agg, "order_by": order, "limit": pick(None, 3, 5, 5, 0, -1), "return_attributes": [attr(target) for _ in range(rng.choice([0, 0, 1]))]}}


def test_checks_in_bulk_are_those_of_one_intent(spark):
    rng = random.Random(11)
    some = [random_intent(rng) for _ in range(10_000)]
    raw = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(some)], "id long, raw string")
    found = N.normalize(raw).withColumn("why", checks.reason({k: v.properties for k, v in DRIVER.labels.items()}, list(DRIVER.patterns), typed=True))
    got, seen = {r.id: r.why for r in found.select("id", "why").collect()}, set()
    for i, x in enumerate(some):
        try:
            I.validate(I.normalize(x), DRIVER)
            want = None
        except I.IntentError as e:
            want = e.reason
        seen.add(want)
        assert got[i] == want, x
    assert seen == {None, "intent_meta", "target", "return_attributes", "filters", "label_not_in_pattern", "order_by", "limit", "path", "aggregate", "regime_path"}


def test_text_that_reads_as_a_number_or_a_truth_value(spark):
    words = ["4.5", " 4 ", "1_0", "1__0", "nan", "-inf", "1e5", "x", "", "yes", "TRUE", "0", "maybe", ".5", "5.", "."]

    def number(w):
        try:
            float(w)
            return True
        except ValueError:
            return False

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", checks.reads_as_number(F.col("w")).alias("n"), checks.reads_as_truth(F.col("w")).alias("b")).collect()
    assert {r.w: r.n for r in got} == {w: number(w) for w in words} and {r.w for r in got if r.b} == {"yes", "TRUE", "0"}


def test_a_pattern_without_a_mapping_is_refused(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"nodes": {"A": {"properties": {"x": "int"}}}, "patterns": [["A", "R", "A"]]}))
    spark.range(3).selectExpr("cast(id as int) as x").write.parquet(str(tmp_path / "a.parquet"))
    raw = {"schema": {"target": "A", "path": [["A", "R", "A"]]}}
    with pytest.raises(I.IntentError) as e:
        plan(spark, str(tmp_path), raw, load(str(tmp_path / "s.json")))
    assert e.value.reason == "unmapped"
    both = load(str(tmp_path / "s.json"), {"labels": {"A": {"table": "a", "key": ["x"]}}, "patterns": [{"start": "A", "relationship": "R", "end": "A", "on": [["x", "x"]]}]})
    assert plan(spark, str(tmp_path), raw, both).count() == 3


@pytest.mark.parametrize("values", [[0.00001, 0.00002], [1e15, 1e15, 0.25], [1e30, 1.0], [None, 0.1, 0.2], [1 / 3, 2 / 3]])
def test_sums_lose_nothing(spark, tmp_path, values):
    from fractions import Fraction

    from pgq.operators.planner import exact_sum

    got = spark.createDataFrame([(v,) for v in values], "v double").agg(exact_sum(F.col("v"))).first()[0]
    real = [v for v in values if v is not None]
    digits = float(sum(Fraction(repr(v)) for v in real))
    assert got == pytest.approx(digits, rel=1e-15) and (got == digits or 1 / 3 in real)


def test_first_object_and_answers(spark):
    texts = ['so {"a": {"b": 1}} and {}', "} {x} y", "{ open", "", None, "a}b{c{d}e}f", "{}{1}"]

    def by_hand(t):
        depth = start = 0
        for i, c in enumerate(t or ""):
            if c == "{":
                start = start if depth else i
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    return t[start : i + 1]

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(T.first_object(F.col("t"))).collect()] == [by_hand(t) for t in texts]
    said = spark.createDataFrame([("p ### Answer: one\n### Answer:\n two <END> rest",), ("plain",)], "t string").select(T.answer(F.col("t"))).collect()
    assert [r[0].strip() for r in said] == ["two", "plain"]
    lists = spark.createDataFrame([('["a", "b"]',), ('Here: ["c"] ok',), ("none",)], "t string").select(T.string_array(F.col("t"))).collect()
    assert [r[0] for r in lists] == [["a", "b"], ["c"], None]


def test_questions_paraphrases_and_training_rows(spark):
    rows = generate.generate(spark).where("regime = 'simple_count_query'").limit(6)
    asked = T.process(rows, lambda prompts: [None if "Moema" in p else f" How many? {len(p)} " for p in prompts]).cache()
    assert asked.count() == 6 and all("[USER]" in r[0] for r in rows.select(T.question_prompt()).collect())
    more = T.paraphrased(asked.where("question is not null").select("question", "regime"), lambda prompts: [json.dumps(["a", "b"]) if i % 2 == 0 else "no list" for i, _ in enumerate(prompts)], {"simple_count_query": "Keep it."}, 2)
    n = asked.where("question is not null").count()
    assert n < more.count() <= 3 * n
    kinds = P.PLACES.visible
    done = T.training_rows(asked, "question", kinds).withColumn("target", T.target_json(F.col("regime"), F.col("schema"))).collect()
    for r in done:
        body, stop = r.target.rsplit("\n", 1)
        tree = json.loads(body)
        assert stop == "<END>" and tree == {"regime": r.regime, "schema": json.loads(r.schema)} and body == json.dumps(tree, indent=2, sort_keys=True, ensure_ascii=False)
        assert r.question == r.question.strip()
        for f in tree["schema"]["filters"]:
            given = {k for k in ("value_str", "value_int", "value_float") if f[k] is not None}
            assert given == ({"value_str"} if kinds[f["node_label"]][f["attribute"]] == "str" else {"value_int"})


def test_configuration_files(spark, tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    a, b, env = tmp_path / "a.yaml", tmp_path / "b.yaml", tmp_path / ".env"
    a.write_text("max_operators_per_attribute: 1\nmin_per_bucket: 3\nmax_per_bucket: 9\nlimit_values: [1, 2]\n")
    b.write_text("regimes:\n  simple_lookup_query:\n    max_depth: 0\n    max_filters_per_node: 1\n")
    got = config.generation(str(a), str(b))
    assert (got.operators_per_attribute, got.min_per_bucket, got.limit_values, list(got.regimes), got.regimes["simple_lookup_query"].filters) == (1, 3, (1, 2), ["simple_lookup_query"], 1)
    assert config.generation(str(a)).regimes == P.CAPS
    for bad in ({"limit_values": [0]}, {"order_by_directions": ["up"]}, {"max_operators_per_attribute": 0}, {"min_per_bucket": 0}, {"max_per_bucket": 0}, {"target_per_regime": 0}):
        with pytest.raises(ValueError):
            P.configured(bad)
    for bad in ({"odd": {}}, {"simple_lookup_query": {"max_depth": -1}}, {"simple_lookup_query": {"what": 1}}):
        with pytest.raises(ValueError):
            P.overlay(P.Config(), bad)
    env.write_text("# c\nexport PGQ_T1='x y'\nPGQ_T2=2\n")
    monkeypatch.setenv("PGQ_T2", "kept")
    monkeypatch.delenv("PGQ_T1", raising=False)
    assert config.environment(str(env)) == {"PGQ_T1": "x y", "PGQ_T2": "2"} and os.environ["PGQ_T1"] == "x y" and os.environ["PGQ_T2"] == "kept"
    monkeypatch.setenv("PGQ_ROOT", "/r/")
    assert config.paths(spark).datasets__augmented == "/r/datasets/augmented"


def test_files_batches_and_reports(spark, tmp_path):
    d = generate.generate(spark).where("regime like '%count%'").limit(25)
    for part in ("train", "validation"):
        S.write(d, str(tmp_path / part))
    both = S.read_parts(spark, {p: str(tmp_path / p) for p in ("train", "validation")}, K.SCHEMA)
    assert {(r.split, r["count"]) for r in both.groupBy("split").count().collect()} == {("train", 25), ("validation", 25)}
    assert S.read_parts(spark, {"train": str(tmp_path / "train")}).where("raw like '{%'").count() == 25
    sizes = [r["count"] for r in S.batches(both, 4).groupBy("batch").count().collect()]
    assert max(sizes) <= 4 and sum(sizes) == 50
    S.write_report(K.coverage_report(d), str(tmp_path / "r.json"))
    got = json.loads((tmp_path / "r.json").read_text())
    assert got["total_intents"] == 25 and sum(n for _, n in got["top_paths"]) <= 25 and got["target_rate"]
    S.write_report(d.select("regime"), str(tmp_path / "s.json"))
    assert len(json.loads((tmp_path / "s.json").read_text())) == 25
    with pytest.raises(ValueError):
        S.write_report(d, str(tmp_path / "t.json"), 3)


def test_a_train_part_that_lacks_a_feature_is_refused(spark):
    row = lambda i, t: (i, "simple_lookup_query", t, [], [], None, None, None, [])
    d = spark.createDataFrame([row(1, "A"), row(2, "B")], K.SCHEMA)
    assert K.covered(d.withColumn("part", F.lit("train"))).count() == 2
    with pytest.raises(ValueError, match="label:B"):
        K.covered(d.withColumn("part", F.when(F.col("id") == 1, "train").otherwise("validation")))
