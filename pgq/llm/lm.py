"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

Tokens are words of lower-case letters A-Z folded, and one end for each document.  Every word stands at a leaf of a tree of
classes, `WIDE` at each of three tiers: P(token | history) = P(class | history) x P(class in it | history) x P(leaf in that |
history) x P(token | leaf).  Classes come from counts: the `TOP` most frequent words have leaves of their own, in order of
frequency, so the first class holds the most frequent words; all others share the leaves that are left by how they end, and
there P(token | leaf) is what the counts of all training tokens give, one unseen word included, with 0.5 added to each count.
Each of the three factors is a maximum-entropy model over hashed features together with the class reached so far: a bias,
the word before, the one before that (skip) and both (bigram).  So history tells frequent words apart to the last, and rare
ones down to their leaf.

Counts.  Blocks of documents ask, for each of their distinct words, how often all training documents hold it: an entry a
block and word, by hash (64 bits of each word's bytes).  The tables of weights grow with the tokens counted, one row for
every `PER_ROW` of them, from `LEAST_ROWS` up to `MOST_ROWS` by tier: what an executor's cache holds.

Biases start from the counts.  Weights are trained by distributed gradient updates, every training position once: in each of `ROUNDS` rounds tasks run over
their part of the blocks, and start from the means of the round before.  A row's mean weighs tasks by how often they have met
it, so what one task alone has seen is not thinned by the others.  Scores are made in sparse numpy batches: a token reads the
rows of its own few features.

Defined results: null and empty texts have the end as their one token; very long texts are scored whole, in one block;
repeated rows count and are scored each; a row without doc_id is never held out; without training tokens N = V = 0; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDE, TIERS, TOP = 16, 3, 3072
LEAVES, BIAS = WIDE**TIERS, 512  # rows of a table that are biases
PER_ROW, LEAST_ROWS, MOST_ROWS = 8, 1 << 12, (1 << 14, 1 << 14, 1 << 16)
ROUNDS, BATCH, RATE, SLICES, FIELDS = 2, 8192, 0.2, 32, 4
STEADY, DIRECT = 60, 3  # of the arithmetic alone: sums up to which no exponential overflows; rows of a run added directly
_rng = np.random.default_rng(99)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD6E8FEB86659FD93
_R = {1: np.uint64(_STEP), -1: np.uint64(pow(_STEP, -1, 2**64))}
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_BYTE = _rng.integers(0, 2**64, 256, dtype="u8")[_LOWER]
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_ENDS = (TOP + _rng.integers(0, LEAVES - TOP, 65536)).astype("u2")
END = np.uint64(0xE4D0F7E47)
_POWERS: dict[int, np.ndarray] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    for k, r in _R.items():
        if k not in _POWERS or len(_POWERS[k]) < n:
            x = np.full(max(n, 1 << 21), r, "u8")
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype="u8")
    return _POWERS[1], _POWERS[-1]


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, leaf by ending, document) of every token of a block, each document's end last.

    A word's hash is a polynomial of its bytes: the difference of two running sums, brought back to power zero."""
    n, n_docs = len(buf), len(offs) - 1
    inside = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, "u8")
    np.cumsum(_BYTE[buf] * up[:n], out=sums[1:])
    h = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype("u8"))
    low = _LOWER[buf]
    prior = np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0).astype("i8") if n else np.zeros(0, "i8")
    tail = _ENDS[prior * 256 + low[end - 1]] if n else np.zeros(0, "u2")
    at = np.searchsorted(start, offs[1:]) + np.arange(n_docs)  # where each document's end goes
    word = np.ones(len(h) + n_docs, bool)
    word[at] = False
    out = np.full(len(word), END, "u8"), np.full(len(word), LEAVES - 1, "u2"), np.zeros(len(word), "i4")
    out[0][word], out[1][word] = h, tail
    out[2][word], out[2][at] = np.searchsorted(offs, start, "right") - 1, np.arange(n_docs)
    return out


def is_held_out(ids: np.ndarray, mod: int = 5, rest: int = 1) -> np.ndarray:
    return np.array([i != C.NO_ID and zlib.crc32(str(i).encode()) % mod == rest for i in ids.tolist()], bool)


def _bucket(value: np.ndarray, n: int) -> np.ndarray:
    return (value >> np.uint64(40)).astype("i8") * n >> 24


def _ask(n: int):
    """Each block's distinct tokens with their leaf by ending and their number in training documents."""

    def one(row):
        b = C.Block(row)
        h, tail, doc = tokens(b.buf, b.offs)
        if not len(h):
            return
        train = ~is_held_out(b.ids)[doc]
        value, at, back = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(back, train, len(value)).astype("u4")
        cut = np.searchsorted(_bucket(value, n), np.arange(n + 1))  # value is in order, and so are buckets
        full = np.flatnonzero(np.diff(cut))
        yield C.messages(b.id, full.tolist(), [C.pack(np.array([cut[j + 1] - cut[j]], "i8").tobytes() + value[cut[j] : cut[j + 1]].tobytes() + count[cut[j] : cut[j + 1]].tobytes() + tail[at[cut[j] : cut[j + 1]]].tobytes()) for j in full])

    return C.by_row(one)


def _parts(payload: bytes):
    raw = C.unpack(payload)
    n = int(np.frombuffer(raw[:8], "i8")[0])
    return np.frombuffer(raw[8 : 8 + 8 * n], "u8"), np.frombuffer(raw[8 + 8 * n : 8 + 12 * n], "u4"), np.frombuffer(raw[8 + 12 * n :], "u2")


def _answer(n: int):
    """Counts of all blocks' tokens; under block -1, training tokens and distinct ones by leaf of their ending, and the most
    frequent words of the bucket: more than its share of the `TOP` of all, which hashes spread evenly."""
    share = 2 * TOP // n + 64

    def one(bucket: int, rows: list[dict]):
        parts = [_parts(r["payload"]) for r in rows]
        value, at, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        total = np.bincount(back, np.concatenate([p[1] for p in parts]).astype("f8"), len(value)).astype("u8")
        tail = np.concatenate([p[2] for p in parts])[at]
        best = np.lexsort((value, -total.astype("i8")))[:share]
        best = best[total[best] > 0]
        sums = np.stack([np.bincount(tail, total, LEAVES), np.bincount(tail, total > 0, LEAVES)]).astype("i8")
        yield C.messages(-1, [bucket], [C.pack(sums.tobytes() + value[best].tobytes() + total[best].tobytes() + tail[best].astype("u8").tobytes())])
        lo = 0
        for r, p in zip(rows, parts, strict=True):
            yield C.messages(r["block"], [bucket], [C.pack(total[back[lo : lo + len(p[0])]])])
            lo += len(p[0])

    return C.by_bucket(one)


class Tree:
    """Leaves of words, and what the counts say of them: fitted from what the buckets send under block -1."""

    def __init__(self, sent: list[bytes] = ()):
        sums, words = np.zeros((2, LEAVES), "i8"), []
        for raw in map(C.unpack, sent):
            sums += np.frombuffer(raw[: 16 * LEAVES], "i8").reshape(2, LEAVES)
            words.append(np.frombuffer(raw[16 * LEAVES :], "u8").reshape(3, -1))
        value, count, tail = np.concatenate(words, 1) if words else np.zeros((3, 0), "u8")
        self.total, self.distinct = int(sums[0].sum()), int(sums[1].sum())
        best = np.lexsort((value, -count.astype("i8")))[:TOP]
        np.subtract.at(sums[0], tail[best].astype("i8"), count[best].astype("i8"))
        np.subtract.at(sums[1], tail[best].astype("i8"), 1)
        self.held, self.kinds = sums
        self.mass = sums[0] + 0.5  # tokens by leaf
        self.mass[: len(best)] += count[best]
        order = np.argsort(value[best])
        self.words, self.leaf = value[best][order], order.astype("u2")
        size = 1 << max(0, self.total // PER_ROW).bit_length()
        self.sizes = [min(max(size, LEAST_ROWS), m) for m in MOST_ROWS]
        self.batch = min(BATCH, max(256, 1 << (self.total // 1024).bit_length()))  # small corpora need more steps

    def start(self) -> list[np.ndarray]:
        """Weights whose biases give each class its share of the tokens of the class above it."""
        weights = []
        for tier, n in enumerate(self.sizes):
            own = np.log(self.mass.reshape(WIDE ** (tier + 1), -1).sum(1)).reshape(-1, WIDE)
            w = np.zeros((n, WIDE), "f4")
            first = sum(WIDE**t for t in range(tier))
            w[first : first + len(own)] = own - own.mean(1, keepdims=True)
            weights.append(w)
        return weights

    def leaves(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return tail
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.leaf[at], tail)

    def log_inside(self, leaf: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Natural log of P(token | leaf)."""
        return np.where(leaf < len(self.words), 0.0, np.log((count + 0.5) / (self.held[leaf] + 0.5 * (self.kinds[leaf] + 1))))


def contexts(h: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """32-bit hashes of the history of each token: the word before, the one before that, both."""
    one, two = np.zeros(len(h), "u8"), np.zeros(len(h), "u8")
    same1, same2 = np.flatnonzero(doc[1:] == doc[:-1]) + 1, np.flatnonzero(doc[2:] == doc[:-2]) + 2
    one[same1], two[same2] = h[same1 - 1], h[same2 - 2]
    return [(x >> np.uint64(32)).astype("u4") for x in (_mixed(one ^ np.uint64(11)), _mixed(two ^ np.uint64(22)), _mixed(one * _MIX + two))]


_SALT = _rng.integers(0, 2**32, BIAS, dtype="u4")


def features(seen: list[np.ndarray], leaf: np.ndarray, tier: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a tier's weights for each token, FIELDS of them; the class taken there)."""
    below = leaf // np.uint16(WIDE ** (TIERS - 1 - tier))
    node = below // np.uint16(WIDE) + np.uint16(sum(WIDE**t for t in range(tier)))  # the class reached so far
    rows, salt = np.empty((len(leaf), FIELDS), "i4"), _SALT[node]
    rows[:, 0] = node
    for i, x in enumerate(seen):
        mixed = (x + salt) * np.uint32(0x2545F491)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        rows[:, i + 1] = ((mixed >> np.uint32(16)) * np.uint32(size - BIAS) >> np.uint32(16)) + np.uint32(BIAS)
    return rows, (below % np.uint16(WIDE)).astype("i4")


def _scores(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each token's sums of its rows, shifted by their largest only where an exponential could leave the range of floats."""
    z = np.take(w, rows[:, 0], axis=0)
    for i in range(1, rows.shape[1]):
        z += np.take(w, rows[:, i], axis=0)
    if z.size and max(z.max(), -z.min()) > STEADY:
        z -= z.max(1, keepdims=True)
    return z


def _over_classes(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(WIDE, z.dtype)  # adds up short rows several times as fast as sum()


def log_classes(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log of P(class | history) at one tier."""
    z = _scores(w, rows)
    return z - np.log(_over_classes(np.exp(z)))[:, None]


def _run_sums(g: np.ndarray, who: np.ndarray, head: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Sums of g[who] over its runs, which begin at head and hold `often` rows each.  Most are short: their first `DIRECT` rows
    are added for all runs at once.  reduceat, which costs a call a run and column, gets the rest, two columns as a complex one."""
    out = np.take(g, who[head], axis=0)
    left, runs = np.ones(len(who), bool), np.arange(len(head))
    left[head] = False
    for i in range(1, DIRECT):
        runs = runs[often[runs] > i]
        at = head[runs] + i
        left[at] = False
        out[runs] += np.take(g, who[at], axis=0)
    runs = runs[often[runs] > DIRECT]
    if len(runs):
        pairs = np.take(g, who[left], axis=0).view(np.result_type(g, "c8"))
        out[runs] += np.add.reduceat(pairs, np.append(0, np.cumsum(often[runs] - DIRECT)[:-1]), axis=0).view(g.dtype)
    return out


def update(w: np.ndarray, seen: np.ndarray, met: np.ndarray, rows: np.ndarray, k: np.ndarray) -> None:
    """One gradient step for a batch, scaled by row as Adagrad does; met counts how often a row was read."""
    g = _scores(w, rows)
    np.exp(g, out=g)
    g /= -_over_classes(g)[:, None]
    g[np.arange(len(k)), k] += 1
    key = rows.ravel().astype("u2")
    order = np.argsort(key, kind="stable")  # two bytes are sorted by radix
    flat = key[order]
    new = np.empty(len(flat), bool)
    new[0] = True
    np.not_equal(flat[1:], flat[:-1], out=new[1:])
    head = np.flatnonzero(new)
    use, often = flat[head].astype("i8"), np.diff(head, append=len(flat))
    grad = _run_sums(g, order // FIELDS, head, often)
    scale = seen[use] + np.einsum("ij,ij->i", grad, grad) / WIDE
    seen[use] = scale
    met[use] += often
    grad *= (RATE / np.sqrt(scale))[:, None]
    grad += np.take(w, use, axis=0)
    w[use] = grad


def _gradients(weights: list[np.ndarray], tree: Tree):
    """What a task makes of the weights, in slices of rows: change and how often each row was met."""

    def run(batches):
        own = [w.copy() for w in weights]
        seen, met, positions = [np.ones(len(w), "f4") for w in own], [np.zeros(len(w), "f4") for w in own], 0
        for row in C.rows_of(batches):
            b = C.Block(row)
            h, tail, doc = tokens(b.buf, b.offs)
            if not len(h):
                continue
            leaf, past, pick = tree.leaves(h, tail), contexts(h, doc), np.flatnonzero(~is_held_out(b.ids)[doc])
            positions += len(pick)
            past, leaf = [x[pick] for x in past], leaf[pick]
            for tier, w in enumerate(own):
                rows, k = features(past, leaf, tier, len(w))
                for lo in range(0, len(k), tree.batch):
                    update(w, seen[tier], met[tier], rows[lo : lo + tree.batch], k[lo : lo + tree.batch])
        if positions:
            change = np.concatenate([(a - b).astype("f2") for a, b in zip(own, weights, strict=True)])
            count = np.concatenate(met)
            for j, (x, n) in enumerate(zip(np.array_split(change, SLICES), np.array_split(count, SLICES), strict=True)):
                yield C.messages(positions, [j], [C.pack(n.tobytes() + x.tobytes())])

    return run


def _means(batches):
    """For each slice of rows, the mean change of all tasks by how often they have met a row; added up as they come."""
    sums: dict[int, list] = {}
    for b in batches:
        for r in b.to_pylist():
            raw = C.unpack(r["payload"])
            n = len(raw) // (4 + 2 * WIDE)
            met, change = np.frombuffer(raw[: 4 * n], "f4"), np.frombuffer(raw[4 * n :], "f2").reshape(n, WIDE).astype("f8")
            had = sums.setdefault(r["bucket"], [np.zeros(n), np.zeros((n, WIDE))])
            had[0] += met
            had[1] += change * met[:, None]
    for k, (met, change) in sums.items():
        yield C.messages(0, [k], [C.pack((change / np.maximum(met, 1)[:, None]).astype("f4"))])


def train(blocks: DataFrame, tree: Tree, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Weights by tier.  Each block is in one round; what reaches the driver is the mean of each slice of rows."""
    weights = tree.start()
    for k in range(rounds):
        mine = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == k)
        got = C.dealt(mine.mapInArrow(_gradients(weights, tree), C.MESSAGE), min(SLICES, C.partitions(blocks.sparkSession))).mapInArrow(_means, C.MESSAGE).collect()
        if got:
            change = np.concatenate([C.unpack(r["payload"], "f4").reshape(-1, WIDE) for r in sorted(got, key=lambda r: r["bucket"])])
            weights = [w + x for w, x in zip(weights, np.split(change, np.cumsum(tree.sizes)[:-1]), strict=True)]
    return weights


def log_history(weights: list[np.ndarray], past: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
    """Natural log of P(leaf | history)."""
    out = np.zeros(len(leaf))
    for lo in range(0, len(leaf), BATCH):
        s = slice(lo, lo + BATCH)
        for tier, w in enumerate(weights):
            rows, k = features([x[s] for x in past], leaf[s], tier, len(w))
            z = _scores(w, rows)
            taken = z[np.arange(len(k)), k]
            out[s] += taken - np.log(_over_classes(np.exp(z, out=z)))
    return out


def _score(weights: list[np.ndarray], tree: Tree, n: int):
    def one(row):
        b = C.Block(row)
        h, tail, doc = tokens(b.buf, b.offs)
        value, back = np.unique(h, return_inverse=True)
        count = np.zeros(len(value), "u8")
        cut = np.searchsorted(_bucket(value, n), np.arange(n + 1))
        for r in row["replies"] or ():
            got = C.unpack(r["payload"], "u8")
            count[cut[r["bucket"]] : cut[r["bucket"]] + len(got)] = got
        c = count[back].astype("f8")
        base = np.log10((c + 0.5) / (tree.total + 0.5 * (tree.distinct + 1)))
        ending = np.empty(len(value), "u2")
        ending[back] = tail
        leaf = tree.leaves(value, ending)[back]
        own = (log_history(weights, contexts(h, doc), leaf) + tree.log_inside(leaf, c)) / np.log(10)
        docs = len(b.ids)
        out = {
            "doc_id": pa.array([None if i == C.NO_ID else i for i in b.ids.tolist()], pa.int64()), "held_out": pa.array(is_held_out(b.ids)), "n_tokens": pa.array(np.bincount(doc, minlength=docs).astype("i8")),
            "n_known": pa.array(np.bincount(doc, c > 0, docs).astype("i8")), "train_tokens": pa.array(np.full(docs, tree.total, "i8")),
            "base_score": pa.array(np.bincount(doc, base, docs)), "score": pa.array(np.bincount(doc, own, docs)),
        }
        yield pa.RecordBatch.from_pydict(out)

    return C.by_row(one)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    n = C.partitions(spark)
    blocks = C.blocks_of(docs)
    told = C.materialize(C.dealt(blocks.mapInArrow(_ask(n), C.MESSAGE), n).mapInArrow(_answer(n), C.MESSAGE))
    tree = Tree([r["payload"] for r in told.where("block = -1").select("payload").collect()])  # one row a partition
    weights = train(blocks, tree)
    found = C.with_replies(blocks, told.where("block <> -1"))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return found.mapInArrow(_score(weights, tree, n), schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"))
