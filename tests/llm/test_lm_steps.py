"""The arithmetic of a training step and of scores: equal to the plain form, without its cost, at any size of sums."""

import time

import numpy as np
import pytest

from pgq.llm import lm


def plain_update(w, seen, met, rows, k):
    """The same step by row maxima, row sums and one reduceat over all runs."""
    z = w[rows].sum(1)
    g = np.exp(z - z.max(1, keepdims=True))
    g /= -g.sum(1, keepdims=True)
    g[np.arange(len(k)), k] += 1
    order = np.argsort(rows.ravel().astype("u2"), kind="stable")
    use, head = np.unique(rows.ravel()[order], return_index=True)
    grad = np.add.reduceat(g[order // lm.FIELDS], head, axis=0)
    seen[use] += (grad**2).sum(1) / lm.WIDE
    met[use] += np.diff(np.append(head, rows.size))
    w[use] += grad * (lm.RATE / np.sqrt(seen[use]))[:, None]


def a_batch(rng, n, size):
    """One bias for all, as at the first tier; other rows once, twice, or very often."""
    rows = np.minimum(rng.geometric(0.001, (n, lm.FIELDS)), size // 2) + rng.integers(0, size // 2, (n, lm.FIELDS)) * rng.integers(0, 2, (n, lm.FIELDS))
    rows[:, 0] = 0
    return rows.astype("i4") % size, rng.integers(0, lm.WIDE, n).astype("i4")


@pytest.mark.parametrize("n", [1, 2, 5, 300, 8192])
@pytest.mark.parametrize("spread", [0.5, 100])  # sums of 100s leave the range of float exponentials
def test_an_update_equals_the_plain_form(n, spread):
    rng = np.random.default_rng(n)
    w = (rng.normal(size=(1 << 14, lm.WIDE)) * spread).astype("f4")
    rows, k = a_batch(rng, n, len(w))
    got, want = ([w.astype(t), np.ones(len(w), t), np.zeros(len(w), t)] for t in ("f4", "f8"))
    lm.update(*got, rows, k)
    plain_update(*want, rows, k)
    assert np.isfinite(got[0]).all()
    assert np.allclose(got[0] - w, want[0] - w, atol=1e-3 if spread > 1 else 1e-5)
    assert np.allclose(got[1], want[1], rtol=1e-3) and np.array_equal(got[2], want[2])


@pytest.mark.parametrize("spread", [0.5, 100])
def test_scores_equal_the_plain_form(spread):
    rng = np.random.default_rng(3)
    weights = [(rng.normal(size=(lm.LEAST_ROWS, lm.WIDE)) * spread).astype("f4") for _ in range(lm.TIERS)]
    past, leaf = [rng.integers(0, 2**32, 500, dtype="u4") for _ in range(3)], rng.integers(0, lm.LEAVES, 500).astype("u2")
    want = np.zeros(500)
    for tier, w in enumerate(weights):
        rows, k = lm.features(past, leaf, tier, len(w))
        z = w.astype("f8")[rows].sum(1)
        z -= z.max(1, keepdims=True)
        want += z[np.arange(500), k] - np.log(np.exp(z).sum(1))
    assert np.allclose(lm.log_history(weights, past, leaf), want, rtol=1e-4, atol=1e-4)


def test_an_update_costs_much_less_than_the_plain_form():
    rng = np.random.default_rng(1)
    w, (rows, k) = (rng.normal(size=(1 << 16, lm.WIDE)) * 0.1).astype("f4"), a_batch(rng, 8192, 1 << 16)

    def least(step):
        took = []
        for _ in range(15):
            own = w.copy(), np.ones(len(w), "f4"), np.zeros(len(w), "f4")
            began = time.thread_time()
            step(*own, rows, k)
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lm.update) < 0.55 * least(plain_update)
