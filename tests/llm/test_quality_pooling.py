"""A document is pooled over all its tokens, and word vectors are the sums of their neighbours' index vectors."""

import re

import numpy as np
import pytest

from pgq.llm import quality as Q


@pytest.mark.parametrize("text", [None, "", "one", "a b a b, c!\n\nD", "Shout LOUD " * 4000 + "quiet " * 10_000, "w x " * 150_000 + "end"])
def test_pooling_reads_every_token(text):
    v = np.random.default_rng(1).normal(size=(Q.ROWS, Q.DIMS)).astype("f4")
    rows = [Q._KNOWN[t] for t in re.findall(r"\w+|[^\w\s]|\n+", text or "")]
    got = Q.pooled(text, v)
    if not rows:
        assert not got.any()
        return
    x = v[rows].astype("f8")
    after = (x[1:] * x[:-1]).mean(0) if len(rows) > 1 else np.zeros(Q.DIMS)
    assert np.allclose(got, np.concatenate([x.mean(0), x.std(0), after]), atol=2e-3)


def test_capitals_and_line_breaks_have_rows_of_their_own():
    assert len({int(Q.rows_of(t)[0]) for t in ("loud", "LOUD", "\n", "\n\n", "!")}) == 5
    assert Q.rows_of("Loud")[0] == Q.rows_of("loud")[0]


def test_word_vectors_by_hand(spark):
    texts = ["a b c d a", "b b", "x", "", None]
    want = np.zeros((Q.ROWS, Q.DIMS))
    for t in texts:
        r = Q.rows_of(t)
        for i in range(len(r)):
            for j in range(max(0, i - Q.NEAR), min(len(r), i + Q.NEAR + 1)):
                if i != j:
                    want[r[i], Q._SPOT[r[j]]] += Q._SIGN[r[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = Q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(got, want - want.mean(0), atol=1e-6)


def test_the_temperature_calibrates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype("f8")
    net = Q.Network().fit(x[:2000], y[:2000])
    p = net.predict(x[2000:])
    loss = lambda q: -np.log(np.where(y[2000:] == 1, q, 1 - q)).mean()
    plain = 1 / (1 + np.exp(-net.logit(x[2000:])))
    assert loss(p) <= loss(np.clip(plain, 1e-9, 1 - 1e-9)) + 0.01
    for lo in (0.2, 0.4, 0.6):
        near = (p >= lo) & (p < lo + 0.2)
        assert abs(p[near].mean() - y[2000:][near].mean()) < 0.12
