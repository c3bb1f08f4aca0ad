"""Every training position gives the model's weights a gradient, once."""

import numpy as np
import pytest

from pgq.llm import common as C
from pgq.llm import lm


@pytest.mark.parametrize("rounds", [1, 2])
def test_every_training_position_changes_its_weights(spark, rounds):
    texts = ["aa bb cc dd ee ff gg hh ii jj kk ll", "one two three four", "", "zz " * 50]
    assert not lm.is_held_out(np.arange(1)).any()
    ids = [i for i in range(40) if not lm.is_held_out(np.array([i]))[0]][: len(texts)]
    blocks = C.blocks_of(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(2))
    tree = lm.Tree()
    w = [a - b for a, b in zip(lm.train(blocks, tree, rounds), tree.start(), strict=True)]
    for text in texts:
        raw = np.frombuffer(text.encode(), "u1")
        h, tail, doc = lm.tokens(raw, np.array([0, len(raw)]))
        assert len(h) == len(text.split()) + 1
        for tier in range(lm.TIERS):
            rows, _ = lm.features(lm.contexts(h, doc), tree.leaves(h, tail), tier, len(w[tier]))
            assert all((w[tier][rows[:, f]] != 0).any(1).all() for f in range(lm.FIELDS))


def test_an_update_is_the_gradient_of_the_log_likelihood():
    rng = np.random.default_rng(4)
    w = rng.normal(size=(600, lm.WIDE)).astype("f8") * 0.1
    rows, k = rng.integers(0, 600, (50, lm.FIELDS)), rng.integers(0, lm.WIDE, 50)
    total = lambda x: lm.log_classes(x, rows)[np.arange(50), k].sum()
    new, seen, met = w.copy(), np.ones(600), np.zeros(600)
    lm.update(new, seen, met, rows, k)
    assert met.sum() == 50 * lm.FIELDS
    for r, c in zip(rng.integers(0, 600, 40), rng.integers(0, lm.WIDE, 40), strict=True):
        up = w.copy()
        up[r, c] += 1e-5
        assert (new - w)[r, c] == pytest.approx((total(up) - total(w)) / 1e-5 * lm.RATE / np.sqrt(seen[r]), abs=1e-4)


def test_tokens_by_hand():
    texts = [b"Hello  wORLD hello", b"", b"\x0b\t", b"x", "é ß".encode(), b"end"]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    h, tail, doc = lm.tokens(np.frombuffer(b"".join(texts), "u1"), offs)
    assert doc.tolist() == [0, 0, 0, 0, 1, 2, 3, 3, 4, 4, 4, 5, 5]
    assert h[0] == h[2] and len(set(h.tolist())) == 7  # hello, world, the end, x, é, ß, end
    assert [i for i, x in enumerate(h) if x == lm.END] == [3, 4, 5, 7, 10, 12]
    alone = lm.tokens(np.frombuffer(b"q world", "u1"), np.array([0, 7]))
    assert alone[0][1] == h[1] and alone[1][1] == tail[1]


def test_probabilities_over_all_words_sum_to_one(spark):
    """Brute force: of one history, over every counted word and one unseen word a leaf."""
    rng = np.random.default_rng(7)
    words = [f"w{i:03d}x"[: 3 + i % 3] + "abcdefgh"[i % 8] for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 30))) for i in range(60)]
    n = 4
    blocks = C.blocks_of(spark.createDataFrame(rows, "doc_id long, text string"))
    told = C.dealt(blocks.mapInArrow(lm._ask(n), C.MESSAGE), n).mapInArrow(lm._answer(n), C.MESSAGE)
    sent = [r["payload"] for r in told.where("block = -1").collect()]
    old = lm.TOP
    try:
        lm.TOP = 40  # the rest share leaves
        tree = lm.Tree(sent)
    finally:
        lm.TOP = old
    weights = [rng.normal(size=(m, lm.WIDE)).astype("f4") * 0.2 for m in tree.sizes]
    seen = {}
    for i, t in rows:
        for w in [*t.split(), None]:
            if not lm.is_held_out(np.array([i]))[0]:
                seen[w] = seen.get(w, 0) + 1
    assert tree.total == sum(seen.values()) and tree.distinct == len(seen)
    known = [w for w in seen if w is not None]
    raw = " ".join(known).encode()
    h, tail, _ = lm.tokens(np.frombuffer(raw, "u1"), np.array([0, len(raw)]))  # the end is the last token
    leaf, count = tree.leaves(h, tail), np.array([seen[w] for w in [*known, None]], "f8")
    past = [np.full(lm.LEAVES + len(h), x, "u4") for x in (5, 6, 7)]
    every = np.concatenate([np.arange(lm.LEAVES), leaf]).astype("u2")
    p = np.exp(lm.log_history(weights, past, every))
    assert p[: lm.LEAVES].sum() == pytest.approx(1, abs=1e-4)
    unseen = np.where(np.arange(lm.LEAVES) < len(tree.words), 0, np.exp(tree.log_inside(np.arange(lm.LEAVES), np.zeros(lm.LEAVES))))
    inside = np.exp(tree.log_inside(leaf, count))
    whole = (p[lm.LEAVES :] * inside).sum() + (p[: lm.LEAVES] * unseen).sum()
    spare = p[len(tree.words) : 40].sum()
    assert whole == pytest.approx(1, abs=1e-3) and spare == 0
    by_leaf = np.bincount(leaf, inside, lm.LEAVES) + unseen
    assert np.allclose(by_leaf[np.unique(leaf)], 1)
