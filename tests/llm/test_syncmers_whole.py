"""Long documents keep every anchor with its place; likeness is exact over all of them."""

import random
import struct

import pytest
import xxhash

from pgq.llm import syncmers


def brute(text):
    hashed = lambda *x: hashed_from(42, *x)

    def hashed_from(seed, *x):
        for v in x:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
            seed = seed - 2**64 if seed >= 2**63 else seed
            seed, last = seed % 2**64, seed
        return last

    w = [hashed(x.encode()) for x in text.lower().split()]
    s = [hashed(a, b) for a, b in zip(w, w[1:], strict=False)]
    return [(i, hashed(s[i], s[i + 2], s[i + 3]) & 0xFFFFFFFF) for i in range(len(s) - 3) if min(s[i], s[i + 3]) <= min(s[i + 1], s[i + 2])]


def test_long_documents_keep_all_anchors(spark):
    rng = random.Random(12)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]
    a, b = words(3000), words(2500)
    b[700:760] = a[100:160]
    rows = [(2, " ".join(a)), (1, " ".join(b))]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: brute(t) for i, t in rows}
    assert len(want[2]) > 1000
    for i, _ in rows:
        assert got[i].fingerprint == "".join(f"{at:08x}{h:08x}" for at, h in want[i])
    x, y = ({h for _, h in want[i]} for i in (2, 1))
    assert x & y and got[2].near_next == got[1].near_next == pytest.approx(len(x & y) / len(x | y), rel=1e-12)
