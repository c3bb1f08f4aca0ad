"""Next documents at odd ids, many ranges, and anchors that meet by place."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pgq.llm import syncmers


def ids(kind, n, rng):
    if kind == "clustered":
        return [i for i in range(n - 3)] + [2**62, -(2**62), 2**40]
    if kind == "sparse":
        return rng.sample(range(-(2**60), 2**60), n)
    return [None] * (n // 2) + [7] * (n // 4) + list(range(100, 100 + n - n // 2 - n // 4))


@pytest.mark.parametrize("kind", ["clustered", "sparse", "same and none"])
def test_every_row_meets_its_next(spark, monkeypatch, kind):
    monkeypatch.setattr(syncmers, "LEAST", 8)
    rng = random.Random(5)
    n = 400
    own = ids(kind, n, rng)
    rows = [(i, f"t{k} " + "w " * rng.randrange(9) if k % 50 else "same text for some") for k, i in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = syncmers.with_next(docs).select("doc_id", "text", "next_text").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((i is None, i or 0, t) for i, t in rows)
    # following the pairs visits every row once and comes back
    assert sorted(r.text for r in got) == sorted(r.next_text for r in got)
    if kind != "same and none":
        down = sorted(rows, reverse=True)
        want = {i: t for (i, _), (_, t) in zip(down, down[1:] + down[:1], strict=True)}
        assert {r.doc_id: r.next_text for r in got} == want
    parts, bounds = syncmers._ranges(docs)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(bounds) > 4 and len(sizes) == len(bounds) and max(sizes) < n / 4


def test_lone_rows_follow_themselves(spark):
    got = syncmers.fingerprints(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).first()
    assert (got.near_next, got.edited_sha256) == (1.0, hashlib.sha256(b"a b c d a b").hexdigest())


def test_places_of_shared_anchors(spark):
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    body, lead = words(60), words(7)
    df = spark.createDataFrame([(" ".join(body), " ".join(lead + body), " ".join(rng.sample(body, 60)))], "a string, b string, c string")
    for c in "abc":
        df = syncmers.sketch(df, c, f"s{c}")
    m = syncmers.matches(df.sa, df.sb)
    got = df.select("sa", m.alias("m"), syncmers.offset_of(m).alias("d"), syncmers.aligned(df.sa, df.sb, 7).alias("moved"), syncmers.aligned(df.sa, df.sb).alias("still"), syncmers.offset_of(syncmers.matches(df.sa, df.sc)).alias("none"), F.size(syncmers.matches(df.sa, df.sa)).alias("own")).first()
    assert got.d == 7 and all(x.b - x.a == 7 for x in got.m) and len(got.m) == got.own == len(got.sa)
    assert got.moved > 0.85 and got.still == 0.0 and got.none is None
