"""Mined lists, vocabulary and vote patterns come from all labelled training rows; the sample bounds the fit alone."""

import os

import pytest

from pgq.llm import common as C
from pgq.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_bound_changes_no_statistics(spark, monkeypatch):
    docs, labels = C.materialize(C.table(spark, SF, "documents").where("doc_id < 600")), C.table(spark, SF, "labels")
    fit, gold = toxicity.LabelModel.fit, []
    monkeypatch.setattr(toxicity.LabelModel, "fit", lambda self, votes, counts, known: (gold.append((votes.tolist(), counts.tolist(), known.tolist())), fit(self, votes, counts, known))[1])
    few, all_ = (toxicity.train(docs, labels, bound) for bound in (20, 20_000))
    assert few.words == all_.words and few.lists == all_.lists and gold[0] == gold[1]
