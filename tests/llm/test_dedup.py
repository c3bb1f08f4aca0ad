"""Suffix-array dedup, SimHash components and syncmer fingerprints against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from pgq.llm import components, simhash, suffix_dedup, syncmers


def brute_dedup(rows):
    first, want = {}, {}
    for i, b in sorted(rows):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return want


def texts(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(6)] + ["x" * 49, "y" * 50, "ab" * 80]
    out = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        out.append((i * 3 - 20, out[-1][1] if out and rng.random() < 0.1 else " ".join(parts)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_is_exact(spark, seed):
    rows = texts(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(docs).collect()}
    want = brute_dedup([(i, t.encode()) for i, t in rows])
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_deep_shallow_sort():
    rng = np.random.default_rng(0)
    buf = np.concatenate([rng.integers(97, 99, 3000, dtype="u1"), np.tile(rng.integers(97, 99, 200, dtype="u1"), 5), np.zeros(58, "u1")])
    starts = np.arange(len(buf) - 58)
    sa, group = suffix_dedup.deep_shallow(buf, starts)
    own = [buf[i : i + 50].tobytes() for i in starts]
    assert [own[i] for i in sa] == sorted(own)
    assert [own[sa[i]] == own[sa[i - 1]] for i in range(1, len(sa))] == [bool(group[i] == group[i - 1]) for i in range(1, len(sa))]


@pytest.mark.parametrize("n, letters", [(0, 2), (1, 2), (2, 2), (500, 1), (4000, 2), (4000, 200)])
def test_each_step_of_the_sort(n, letters):
    rng = np.random.default_rng(n + letters)
    text = rng.integers(0, letters, n, dtype="u1")
    buf = np.concatenate([text, np.tile(text[:300], 4), np.zeros(58, "u1")])
    starts = rng.permutation(len(buf) - 58)[:n]
    own = [buf[i : i + 50].tobytes() for i in starts]
    alike = lambda o, k: [own[a][:k] == own[b][:k] for a, b in zip(o.sa, o.sa[1:], strict=False)]
    grouped = lambda o: (o.group[1:] == o.group[:-1]).tolist()
    o = suffix_dedup.Order(buf, starts)
    slots = o.by_two_bytes()
    assert [own[i][:2] for i in o.sa] == sorted(x[:2] for x in own) and grouped(o) == alike(o, 2)
    deep = o.quicksort(slots, 16)
    assert [own[i][:16] for i in o.sa] == sorted(x[:16] for x in own) and grouped(o) == alike(o, 16)
    levels = o.tries(deep, 16, 50)
    assert [own[i] for i in o.sa] == sorted(own) and grouped(o) == alike(o, 50)
    # a blind trie branches once less often than it has distinct leaves
    leaves = len({x for i in deep for x in [own[o.sa[i]]]})
    roots = len({own[o.sa[i]][:16] for i in deep})
    assert sum(int(children - forks) for _, (children, forks) in levels) == leaves - roots


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]) if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("t", [None, "", " \t", "A b", "Ärger A\x0bB c c c c", "a b c d e f a b c", "x " * 5000])
def test_fingerprint(t):
    assert simhash.fingerprint(t) % 2**64 == brute_fingerprint(t)


def brute_components(fps):
    label = {f: f for f in fps}
    u = np.array(fps, "i8").view("u8")
    while True:
        before = dict(label)
        for i, f in enumerate(fps):
            near = [fps[j] for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 2)]
            low = min(label[x] for x in near)
            for x in near:
                label[x] = min(label[x], low)
        if label == before:
            return label


def test_links_connect_all_within_two_bits_even_in_crowds(spark):
    rng = np.random.default_rng(3)
    fps = set()
    for k in range(40):
        f = int(rng.integers(0, 2**63))
        for _ in range(12):
            fps.add(f)
            for b in rng.integers(0, 63, rng.integers(0, 4)):
                f ^= 1 << int(b)
    base = int(rng.integers(0, 2**63))
    fps |= {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (400, 2))}  # crowds of more than _SMALL
    fps |= {base ^ int(x) for x in rng.integers(0, 2**20, 300)}
    fps = sorted(fps)
    want = brute_components(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = {r.node: r.root for r in components.stars(edges).collect()}
    assert {f: roots.get(f, f) for f in fps} == want and len(set(want.values())) < len(fps)


def test_components_along_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(-50, 50)] + [(7, 7), (200, 201)], "a long, b long")
    got = {r.node: r.root for r in components.stars(edges).collect()}
    assert got == {**{i: -50 for i in range(-49, 51)}, 201: 200}


def test_syncmers_edits_and_order(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i * 5000, " ".join(word() for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    rows[7] = (rows[7][0], rows[9][1])
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    down = sorted(rows, reverse=True)
    for (i, t), (_, u) in zip(down, down[1:] + down[:1], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + u[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
        if len(t) > 400:
            assert got[i].near_edited > 0.3 > got[i].near_next
    assert got[rows[7][0]].fingerprint == got[rows[9][0]].fingerprint


def test_syncmers_equal_brute_force_jaccard(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(a, a + " thirteen fourteen", "")], "a string, b string, c string")
    for c in "abc":
        df = syncmers.sketch(df, c, f"s{c}")
    sa, sb, ab, ac, cc = df.select("sa", "sb", syncmers.likeness(df.sa, df.sb), syncmers.likeness(df.sa, df.sc), syncmers.likeness(df.sc, df.sc)).first()
    assert sa and set(sa) <= set(sb) and ab == len(set(sa) & set(sb)) / len(set(sa) | set(sb)) and (ac, cc) == (0.0, 1.0)
