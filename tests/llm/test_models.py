"""Neighbours, classifiers, page text, mixing, packing and LM scores: brute force, exact round trips, held-out accuracy."""

import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pgq.llm import html_main, lm, mixing, neighbours, packing, quality, registry, toxicity
from pgq.llm import common as C

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("dims, copies", [(64, 0), (20, 400)])
def test_neighbours_recall_and_exact_scores(spark, dims, copies):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(40, dims))
    x = (centres[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, dims))) * rng.uniform(0.5, 2, (1500, 1))
    x[:copies] = x[0]
    x = x.astype("f4").astype("f8")
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 1500, 20))
    hit = 0
    for q, rows in by.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hit += len(set(best.tolist()) & {r.vec_id for r in rows})
        assert [r.rank for r in rows] == list(range(1, 21)) and q not in {r.vec_id for r in rows}
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        assert np.allclose([r.score for r in rows], s[[r.vec_id for r in rows]], rtol=1e-12)
    assert hit / (20 * len(by)) >= 0.9


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name, column, mod, rest, least", [("op4_toxicity", "toxic", 5, 0, 0.95), ("op6_quality", "quality", 3, 1, 0.95)])
def test_held_out_accuracy(spark, tables, name, column, mod, rest, least):
    got = {r.doc_id: r for r in registry.QUERIES[name](spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % mod == rest) for i, r in got.items())
    known = [(got[i], y) for i, y in tables.sql(f"select doc_id, {column} from labels").fetchall() if got[i].held_out]
    right = sum(r.predicted == y for r, y in known) / len(known)
    assert right >= least and right > max(np.mean([y for _, y in known]), 1 - np.mean([y for _, y in known]))


@needs_data
@pytest.mark.parametrize("train, column, mod, rest", [(toxicity.train, "toxic", 5, 0), (quality.train, "quality", 3, 1)])
def test_held_out_labels_change_no_score(spark, train, column, mod, rest):
    docs, labels = C.table(spark, SF, "documents").where("doc_id < 300"), C.table(spark, SF, "labels")
    flipped = labels.withColumn(column, F.when(C.held_out(F.col("doc_id"), mod, rest), 1 - F.col(column)).otherwise(F.col(column)))
    a, b = train(docs, labels), train(docs, flipped)
    if column == "toxic":
        assert a.words == b.words and np.array_equal(a.w, b.w) and a.b == b.b
    else:
        assert np.array_equal(a[0], b[0]) and all(map(np.array_equal, a[1].layers, b[1].layers))


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.2
    say = lambda right: np.where(rng.random(len(y)) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    good, fair, poor = say(0.95), say(0.8), say(0.55)
    votes = np.stack([good, fair, poor, poor], 1)
    pattern, at = np.unique(votes, axis=0, return_inverse=True)
    known = np.zeros((len(pattern), 2))  # 200 rows with labels: without any, it may take the repeated voter for the truth
    np.add.at(known, (at[:200], y[:200].astype("i8")), 1)
    m = toxicity.LabelModel().fit(pattern, np.bincount(at[200:], minlength=len(pattern)).astype("f8"), known)
    assert ((m.posterior(pattern)[at] >= 0.5) == y).mean() > 0.93
    assert m.weight[2] < 0.7 < m.weight[0]  # the repeated voter counts less


def test_main_text_of_a_plain_page():
    trees = html_main.model()
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav class='menu'><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li></ul></nav>"
        "<article><h1>A  title\nhere</h1><p>First paragraph &amp; more words, enough of them to count.</p><p>Second one with <b>bold</b> text &eacute;.</p></article>"
        "<div class='comments'><div class='comment'><p>Nice article, thanks!</p></div></div><footer><p>&copy; 2020 Somebody. All rights reserved.</p></footer><script>var x = '<p>no</p>';</script></body></html>"
    )
    assert html_main.extract(page, trees) == "A title here First paragraph & more words, enough of them to count. Second one with bold text é."


def test_main_text_on_unseen_layouts():
    trees, rng, scores = html_main.model(), np.random.default_rng(77), []
    for _ in range(60):
        src, want = html_main.page(rng)
        got, want = Counter(html_main.extract(src.replace(" data-y>", ">"), trees).split()), Counter(want.split())
        both = sum((got & want).values())
        scores.append(2 * both / max(1, sum(got.values()) + sum(want.values())))
    assert np.mean(scores) > 0.9


def test_decoding_never_keeps_a_child_of_a_dropped_element():
    t = html_main.parse("<div><p>a</p><div><p>b</p></div></div><section><p>c</p></section>")
    for seed in range(20):
        z = np.random.default_rng(seed).normal(size=len(t.tag)) * 2
        keep = html_main.decode(t, z)
        assert all(keep[t.parent[i]] or not keep[i] for i in range(1, len(keep)))
        n = len(z) - 1
        legal = [m for m in itertools.product([0, 1], repeat=n) if all(not m[i - 1] or t.parent[i] == 0 or m[t.parent[i] - 1] for i in range(1, n + 1))]
        assert np.isclose(z[1:] @ keep[1:], max(z[1:] @ np.array(m) for m in legal))


def test_targets_fill_by_weight_up_to_twice(spark):
    rng = random.Random(2)
    for _ in range(4):
        size = {f"s{i}": rng.choice([0, 5, 80, 1000, 40_000]) for i in range(7)} | {None: 300}
        order = sorted(k for k in size if k) + [None]
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
        want, full, left = {}, set(), 1.5 * sum(size.values())
        while True:
            room = left - sum(2 * size[k] for k in full)
            w = sum(weight[k] for k in size if k not in full)
            over = {k for k in size if k not in full and room * weight[k] / w > 2 * size[k]}
            if not over:
                break
            full |= over
        want = {k: 2 * size[k] if k in full else room * weight[k] / w for k in size}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, size long")).collect()}
        assert got == pytest.approx(want)


@needs_data
def test_mixing_gives_the_rows_of_its_sql_with_any_way_to_join(spark, tables):
    want = sorted(tables.sql(mixing.ORACLE).select("doc_id, size, source_size, target, taken").fetchall())
    sizes = mixing.sized(C.table(spark, SF, "documents"))
    for small in (mixing.SMALL, 0):
        got = mixing.with_plan(sizes, sizes, small).select("doc_id", "size", "source_size", "target", (F.col("size") * mixing.copies()).alias("taken"))
        assert sorted(map(tuple, got.collect())) == want


def test_fullest_combination_is_the_best():
    rng = random.Random(5)
    for _ in range(60):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(6))}
        room = rng.randrange(60)
        use = packing.fullest(room, counts)
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(a * b for a, b in zip(c, counts, strict=True))) <= room)
        assert sum(n * t for n, t in use) == best and all(t <= counts[n] for n, t in use)


@needs_data
def test_packing_is_an_exact_round_trip(spark, tables):
    from tokenizers import Tokenizer

    path, odd = packing.default_tokenizer(), ["İstanbul ǅ <|endoftext|> a<b ''s'll", "x" * 9000, "1234567 ½ ²  word‍", "퟿\U0001f469‍\U0001f680 ﬁ", ""]
    rows = tables.sql("select doc_id, text from documents where doc_id < 200").fetchall() + list(enumerate(odd, 10_000))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), with_ids=True).collect()
    t = Tokenizer.from_file(path)
    for i, text in rows:
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]
        assert all(r.start == 2048 * r.piece and r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in mine) and all(r.length == 2048 for r in mine[:-1])
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= 1.04 * -(-sum(bins.values()) // 2048)  # few pieces: 94 bins, 92 by size


def test_as_few_bins_as_sizes_allow():
    rng = np.random.default_rng(9)
    counts = Counter(np.minimum(2048, 1 + rng.gamma(0.8, 500, 20_000).astype("i8")).tolist())
    plan = packing.bins(counts, 2048)
    used = Counter()
    for often, use in plan:
        assert sum(n * t for n, t in use) <= 2048
        used.update({n: often * t for n, t in use})
    assert used == counts and sum(often for often, _ in plan) == -(-sum(n * c for n, c in counts.items()) // 2048)


def test_lm_counts_equal_brute_force_and_the_model_beats_them(spark):
    rng = random.Random(6)
    nouns, verbs = [f"n{i}oun" for i in range(30)], [f"v{i}erb" for i in range(30)]
    rows = [(i, " ".join(f"{rng.choice(nouns)} {rng.choice(verbs).upper()}" for _ in range(rng.randrange(40)))) for i in range(400)] + [(900, None), (901, "Ä\x0bß  unseen" + "z" * 700)]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(x for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for x in tok(t))
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        x, r = tok(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(x), sum(w in c for w in x), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_classes_sum_to_one():
    rng = np.random.default_rng(8)
    w = rng.normal(size=(lm.LEAST_ROWS, lm.WIDE))
    p = np.exp(lm.log_classes(w, rng.integers(0, lm.LEAST_ROWS, (50, lm.FIELDS))))
    assert np.allclose(p.sum(1), 1)


@needs_data
def test_pipeline_stages_match_what_they_are_judged_by(spark):
    docs = C.materialize(C.table(spark, SF, "documents"))
    stage, ids = dict(corpus_pipeline.STAGES), lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    assert list(stage) == ["toxicity", "near_dedup", "suffix_dedup", "mix", "pack"]
    clean = C.materialize(stage["toxicity"](spark, docs, SF))
    assert ids(clean) == {r.doc_id for r in toxicity.op4(spark, SF).collect() if not r.predicted}
    fps = {r.doc_id: r.component_id for r in registry.simhash.components(clean).collect()}
    one = C.materialize(stage["near_dedup"](spark, clean, SF))
    assert ids(one) == set(fps.values())
    cut = C.materialize(stage["suffix_dedup"](spark, one, SF))
    kept = {r.doc_id: r.kept_text for r in registry.suffix_dedup.dedup(one).collect()}
    rows = cut.collect()
    assert {r.doc_id: r.text for r in rows} == kept and all(r.n_chars == len(r.text) for r in rows)
    mixed = Counter(r.doc_id for r in stage["mix"](spark, cut, SF).collect())
    assert {r.doc_id: r.size * mixed[r.doc_id] for r in mixing.mix(cut).collect()} == {r.doc_id: r.taken for r in mixing.mix(cut).collect()}
