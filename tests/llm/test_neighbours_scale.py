"""Buckets follow the number of vectors, probes follow the recall that is measured, hot vectors and odd types."""

import numpy as np
import pytest

from pgq.llm import neighbours as N


def frame(spark, x, kind="float"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")


def recall(got, x, every, top=20):
    by = {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, ids in by.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), -s))[:top].tolist()) & ids)
    assert sorted(by) == list(range(0, len(x), every))
    return hit / (top * len(by))


@pytest.mark.parametrize("bucket", [512, 8, 1])
def test_recall_holds_with_one_to_three_digits(spark, monkeypatch, bucket):
    monkeypatch.setattr(N, "BUCKET", bucket)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)] + 0.5 * rng.normal(size=(3000, 32))).astype("f4").astype("f8")
    sizes = N.digits(3000, 32)
    assert len(sizes) == {512: 1, 8: 2, 1: 3}[bucket] and np.prod(sizes) * bucket >= 0.5 * 3000
    assert recall(N.search(frame(spark, x), 20).collect(), x, 20) >= 0.9


def test_digits_follow_the_table():
    sizes = [int(np.prod(N.digits(10**k, 64))) for k in range(2, 10)]
    assert sizes == sorted(sizes) and sizes[0] == 128
    assert all(0.3 < n / (10.0**k / N.BUCKET) < 3 for k, n in enumerate(sizes, 2) if n > 128)


def test_buckets_of_a_query_come_nearest_first():
    x = N._unit(np.random.default_rng(3).normal(size=(40, 16)))
    for sizes in ([32], [32, 6], [32, 32, 4]):
        own, met = N.buckets(x, sizes), N.probed(x, sizes, 64)
        assert all(set(own[i]) <= set(met[i, : N.TABLES].tolist()) for i in range(40))  # its own buckets lack nothing
        assert all(len(set(row.tolist())) == len(row) for row in met)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_tiny_and_large_doubles_and_a_vector_that_a_third_of_rows_share(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 8)).astype("f4").astype("f8")
    x[:200] = x[0]
    if kind == "double":
        x[300:] *= 1e-200
        x[300] *= 1e250
    got = N.search(frame(spark, x, kind), 20).collect()
    assert len(got) == 30 * 20
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(1)
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert np.allclose([r.score for r in mine], s[[r.vec_id for r in mine]], rtol=1e-12, atol=0) and all(r.vec_id != q for r in mine)
    assert recall(got, x, 20) >= 0.9
