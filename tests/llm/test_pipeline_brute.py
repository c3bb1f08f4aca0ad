"""Each stage of the pipeline against brute force, on what the stage before it has kept."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pgq.llm import mixing, packing
from pgq.llm import common as C

from test_dedup import brute_components, brute_dedup, brute_fingerprint

INSULTS = ["idiot", "moron", "scum", "loser"]


def corpus():
    rng = random.Random(21)
    words = [a + b for a in ("ka", "lo", "mi", "ter", "an", "vo") for b in ("du", "ri", "sel", "nok", "pra")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = [prose(60), prose(80)]
    rows, labels = [], []
    for i in range(240):
        text = prose(rng.randrange(20, 120))
        if i % 6 == 0:  # toxic
            w = text.split()
            for x in rng.choices(INSULTS, k=4):
                w.insert(rng.randrange(len(w)), x)
            text = " ".join(w)
        elif i % 10 == 3:
            text += " " + rng.choice(passage)
        elif i % 10 == 7 and rows:
            text = rows[-3][1].upper() if i % 20 == 7 else rows[-3][1]
        rows.append((i * 7, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
        if i % 2:
            labels.append((i * 7, 1, 0))
        elif i % 12 == 0 or i % 4 == 2:
            labels.append((i * 7, 1, int(i % 6 == 0)))
    return rows, labels


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs, found = C.table(spark, path, "documents"), {"documents": rows}
    for name, stage in corpus_pipeline.STAGES:
        docs = C.materialize(stage(spark, docs, path))
        found[name] = [tuple(r) for r in docs.collect()]
    whole = [tuple(r) for r in corpus_pipeline.run(spark, path).collect()]
    return found, whole


def test_toxic_documents_go_and_clean_ones_stay(run):
    before, after = run[0]["documents"], {r[0] for r in run[0]["toxicity"]}
    toxic = {r[0] for r in before if set(r[1].lower().split()) & set(INSULTS)}
    assert after == {r[0] for r in before} - toxic and toxic


def test_one_of_each_near_group_stays(run):
    before = run[0]["toxicity"]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    fps = {r[0]: signed(brute_fingerprint(r[1])) for r in before}
    label = brute_components(sorted(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(least.get(label[f], i), i)
    assert sorted(r[0] for r in run[0]["near_dedup"]) == sorted(least.values()) and len(least) < len(before)


def test_repeated_passages_go(run):
    before = {r[0]: r[1].encode() for r in run[0]["near_dedup"]}
    want = brute_dedup(list(before.items()))
    got = {r[0]: r[1].encode() for r in run[0]["suffix_dedup"]}
    assert {i: hashlib.sha256(t).hexdigest() for i, t in got.items()} == {i: w[3] for i, w in want.items()}
    assert sum(w[1] for w in want.values()) > 500 and all(r[4] == len(r[1]) for r in run[0]["suffix_dedup"])


def test_the_mix_is_that_of_its_sql(run, tmp_path):
    import pyarrow as pa

    rows = run[0]["suffix_dedup"]
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": pa.array([r[3] for r in rows], pa.string())}))
    want = {i: (taken // size if size else 1) for i, size, _, _, taken in c.sql(mixing.ORACLE).select("doc_id, size, source_size, target, taken").fetchall()}
    assert Counter(r[0] for r in run[0]["mix"]) == {i: n for i, n in want.items() if n}


def test_pieces_are_the_tokens_of_the_mix(run):
    from tokenizers import Tokenizer

    t, bins, tokens = Tokenizer.from_file(packing.default_tokenizer()), defaultdict(list), Counter()
    for i, text, *_ in run[0]["mix"]:
        tokens[i] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for doc, _, _, length, _, seq, offset in run[0]["pack"]:
        got[doc] += length
        bins[seq].append((offset, length))
    assert got == tokens
    for x in bins.values():
        at = np.cumsum([0] + [n for _, n in sorted(x)])
        assert [o for o, _ in sorted(x)] == at[:-1].tolist() and at[-1] <= 2048
    assert len(bins) <= 1 + -(-sum(tokens.values()) // 2048)


def test_run_is_its_stages_in_turn(run):
    found, whole = run
    key = lambda rows: sorted((r[0], r[1], r[3], r[4]) for r in rows)  # noqa: E731  places may differ between equal pieces
    assert key(whole) == key(found["pack"])
