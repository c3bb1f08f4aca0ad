"""The label model against brute force, what the posteriors do to the fit, and recall at 0.5 in each language."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pgq.llm import common as C
from pgq.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_posteriors_are_those_of_the_tree_written_out():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.25
    a = np.where(y, rng.random(6000) < 0.8, rng.random(6000) < 0.1)
    votes = np.stack([a, np.where(rng.random(6000) < 0.9, a, rng.random(6000) < 0.3), np.where(y, rng.random(6000) < 0.6, rng.random(6000) < 0.05)], 1).astype("i8")
    pattern, at = np.unique(votes, axis=0, return_inverse=True)
    known = np.zeros((len(pattern), 2))
    np.add.at(known, (at[:500], y[:500].astype("i8")), 1)
    m = T.LabelModel().fit(pattern, np.bincount(at[500:], minlength=len(pattern)).astype("f8"), known)
    assert {frozenset((i, int(p))) for i, p in enumerate(m.parent) if p >= 0} >= {frozenset((0, 1))}  # the voter that repeats another hangs on it
    assert m.weight[1] < m.weight[2]
    for k, v in enumerate(pattern):
        like = [1 - m.prior, m.prior]
        for i, t in enumerate(m.table):
            for c in (0, 1):
                like[c] *= t[c][v[m.parent[i]] + 1 if m.parent[i] >= 0 else 0][v[i] + 1]
        assert m.posterior(pattern[k : k + 1])[0] == pytest.approx(like[1] / sum(like), rel=1e-9)
    for t in m.table:
        assert np.allclose(t.sum(2), 1)
    every = np.array(list(itertools.product((0, 1), repeat=3)))
    assert np.all(np.diff([m.posterior(every, np.full(8, l)).mean() for l in (0, -1, 1)]) > 0)  # a label is evidence, not the truth
    assert 0 < m.posterior(every, np.zeros(8, "i8")).max() < 1


def test_labels_are_weighed_against_votes():
    """Two hundred rows on which good voters agree and the label does not."""
    votes = np.array([[1, 1, 1], [0, 0, 0]])
    m = T.LabelModel().fit(votes, np.array([3000.0, 9000.0]), np.array([[200.0, 800.0], [2900.0, 100.0]]))
    against, with_votes = m.posterior(votes, np.array([0, 0]))
    assert m.right[1] < m.RIGHT and against > 0.1 > 0.01 > with_votes and m.posterior(votes[1:], np.array([1]))[0] < 0.9


def test_unlabelled_documents_change_the_fit(spark):
    rows = [(i, "calm words of prose number %d" % (i % 7) + (" idiot scum" if i % 5 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 60)], "doc_id long, toxic int")
    more = [(1000 + i, "calm words of prose" + (" idiot scum brazen" if i % 2 else "")) for i in range(400)]
    a = T.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    b = T.train(spark.createDataFrame(rows + more, "doc_id long, text string"), labels)
    assert a.words == b.words and not np.allclose(a.w, b.w)


def test_calibration_sets_the_cut_between_the_classes():
    rng = np.random.default_rng(5)
    y = np.array([0] * 950 + [1] * 50)
    logit = np.where(y == 1, rng.normal(-2, 0.7, 1000), rng.normal(-6, 0.7, 1000))  # all far below 0
    a, b = T.calibration(logit, y)
    p = 1 / (1 + np.exp(-(a * logit + b)))
    assert (p[y == 1] >= 0.5).mean() > 0.95 and (p[y == 0] < 0.5).mean() > 0.95
    assert T.calibration(logit, np.zeros(1000, "i8")) == (1.0, 0.0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_at_a_half_in_each_language(spark):
    docs, labels = C.table(spark, SF, "documents"), C.table(spark, SF, "labels")
    got = T.op4(spark, SF).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    both = got.groupBy("lang").agg(F.avg(F.when(F.expr("toxic = 1 and not held_out"), F.col("predicted"))).alias("train"), F.avg(F.when(F.expr("toxic = 1"), F.col("predicted"))).alias("all"), F.avg(F.when(F.expr("toxic = 0"), F.col("predicted"))).alias("wrong")).collect()
    assert {r.lang for r in both} == {"en", "fr", "de", "es"}
    assert all(r.train >= 0.9 and r["all"] >= 0.88 and r.wrong < 0.02 for r in both), both
