"""Queries whose probed buckets hold too few candidates get all that there are."""

import numpy as np
import pytest

from pgq.llm import neighbours


def few(rng):
    return rng.normal(size=(15, 64))


def opposite(rng):
    x = rng.normal(size=64)
    cluster = x + 0.01 * rng.normal(size=(600, 64))
    cluster[0] = -x
    return cluster


@pytest.mark.parametrize("make, every", [(few, 1), (opposite, 1000)])
def test_few_candidates_in_the_probed_buckets(spark, make, every):
    x = make(np.random.default_rng(3)).astype("f4").astype("f8")
    got = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), every).collect()
    for q in range(0, len(x), every):
        s = (x * x[q]).sum(1)
        want = [i for i in np.lexsort((np.arange(len(x)), -s)).tolist() if i != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(want) + 1)) and [r.vec_id for r in mine] == want
        assert np.allclose([r.score for r in mine], s[want], rtol=1e-12)
