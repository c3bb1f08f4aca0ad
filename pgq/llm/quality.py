"""Quality classifier: random-indexing word vectors pooled by document, a two-layer network, calibrated probabilities.

Each token (a word, a sign or a run of line breaks, hashed to `ROWS` rows) has a sparse random index vector; its word vector
is the sum of the index vectors of its neighbours over the whole corpus.  Tasks send their sums in slices that are added up
on the executors, so what reaches the driver has a fixed size (`ROWS` x `DIMS`).  A document is pooled as the mean and the
spread of its word vectors and the mean product of vectors that follow each other, which is what repetition shows in;
nothing else about it is an input.  The network is fitted on a bounded sample (`SAMPLE` labelled training rows, the smallest
by a hash of their id), and a temperature on a part that the fit has not seen.

Defined results: null and empty texts get the score of a text without words; whole texts are read, however long, a slice of
`SLICE` tokens at a time; repeated rows are scored each; a row without doc_id is never held out and never learned from;
without labels of both classes every score is the share of label 1 (0.5 without any); an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .toxicity import bounded_labels

ROWS, DIMS, NEAR, SAMPLE, HIDDEN, SLICES, SLICE = 4096, 24, 2, 20_000, 32, 8, 8192
_TOKEN = re.compile(r"\w+|[^\w\s]|\n+")
_rng = np.random.default_rng(11)
_SPOT = np.stack([_rng.permutation(DIMS)[:2] for _ in range(ROWS)])
_SIGN = _rng.choice([-1.0, 1.0], size=(ROWS, 2))


class _Rows(dict):
    """Row of a token: its lower-case form, apart from that of tokens all in capitals; line breaks by how many follow."""

    def __missing__(self, t: str) -> int:
        key = t.lower() + ("\x00" if len(t) > 1 and t.isupper() else "")
        if len(self) > 200_000:
            self.clear()
        got = self[t] = zlib.crc32(key.encode()) % ROWS
        return got


_KNOWN = _Rows()


def rows_of(text: str | None) -> np.ndarray:
    return np.array([_KNOWN[t] for t in _TOKEN.findall(text or "")], "i8")


def neighbours(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Sum of the index vectors beside each token, by row; words of other documents are no neighbours."""
    out = np.zeros(ROWS * DIMS)
    for s in range(1, NEAR + 1):
        if len(rows) <= s:
            break
        same = doc[s:] == doc[:-s]
        a, b = rows[:-s][same], rows[s:][same]
        for x, y in ((a, b), (b, a)):
            for j in range(2):
                out += np.bincount(x * DIMS + _SPOT[y, j], _SIGN[y, j], ROWS * DIMS)
    return out.reshape(ROWS, DIMS)


def _sums(batches):
    total = np.zeros((ROWS, DIMS))
    for b in batches:
        held, docs, n = [], [], 0
        texts = b.column(0).to_pylist()
        for i, t in enumerate(texts):
            r = rows_of(t)
            held.append(r)
            docs.append(np.full(len(r), i))
            n += len(r)
            if n > 500_000 or i + 1 == len(texts):
                total += neighbours(np.concatenate(held), np.concatenate(docs))
                held, docs, n = [], [], 0
    if total.any():
        for k, x in enumerate(np.split(total.astype("f4"), SLICES)):
            yield C.messages(0, [k], [C.pack(x)])


def _add(bucket, rows):
    yield C.messages(0, [bucket], [C.pack(sum(C.unpack(r["payload"], "f4").astype("f8") for r in rows))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    spark = C.prepare(docs.sparkSession)
    del spark
    parts = C.dealt(docs.select("text").mapInArrow(_sums, C.MESSAGE), SLICES).mapInArrow(C.by_bucket(_add), C.MESSAGE).collect()
    v = np.zeros((SLICES, ROWS // SLICES, DIMS))
    for r in parts:
        v[r["bucket"]] = C.unpack(r["payload"], "f8").reshape(ROWS // SLICES, DIMS)
    v = v.reshape(ROWS, DIMS)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v -= v.mean(0)
    return v.astype("f4")


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word vectors, and the mean product of each with the next."""
    rows = rows_of(text)
    n, total = len(rows), np.zeros((3, DIMS))
    if not n:
        return total.ravel().astype("f4")
    for lo in range(0, n, SLICE):
        v = vectors[rows[lo : lo + SLICE + 1]].astype("f8")  # one more: it follows the last
        own = v[:SLICE]
        total += own.sum(0), np.einsum("ij,ij->j", own, own), np.einsum("ij,ij->j", v[:-1], v[1:])
    mean, square, after = total[0] / n, total[1] / n, total[2] / max(1, n - 1)
    return np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), after]).astype("f4")


class Network:
    """Two layers; a temperature divides the logit."""

    def __init__(self, share: float = 0.5):
        self.layers, self.temperature, self.share = None, 1.0, share

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5) -> Network:
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-6
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(x))
        part = order[: len(x) // 6] if len(x) >= 60 else order
        fit = order[len(x) // 6 :] if len(x) >= 60 else order
        z = (x - self.mean) / self.sd
        p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                h = np.tanh(z[rows] @ p[0] + p[1])
                g = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
                back = np.outer(g, p[2]) * (1 - h**2)
                grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                t += 1
                for i, d in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                    p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.layers = p
        logit, want = self.logit(x[part]), y[part]
        losses = [(np.logaddexp(0, -np.where(want == 1, 1, -1) * logit / s).mean(), s) for s in np.geomspace(0.25, 8, 61)]
        self.temperature = float(min(losses)[1])
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        p = self.layers
        return np.tanh((x - self.mean) / self.sd @ p[0] + p[1]) @ p[2] + p[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _sampled(vectors: np.ndarray):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "y": b.column(1), "x": pa.array([pooled(t, vectors).tolist() for t in b.column(2).to_pylist()], pa.list_(pa.float32()))})

    return run


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs)
    known = bounded_labels(labels, "quality", 3, 1, bound)
    rows = []
    if known:  # `bound` labels at most are broadcast
        few = F.broadcast(docs.sparkSession.createDataFrame(list(known.items()), "doc_id long, y int"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few, "doc_id").select("doc_id", "y", "text")
        done = C.materialize(texts.mapInArrow(_sampled(vectors), "doc_id long, y int, x array<float>"))
        rows = C.hash_sample(done, 2 * bound, "doc_id", "x").collect()  # ids that repeat come by their hash, not by chance
    y = np.array([r["y"] for r in rows], "f8")
    net = Network(float(y.mean()) if len(y) else 0.5)
    return vectors, net.fit(np.array([r["x"] for r in rows]), y) if len(set(y)) == 2 else net


def _score(vectors: np.ndarray, net: Network):
    def run(batches):
        for b in batches:
            x = np.stack([pooled(t, vectors) for t in b.column(1).to_pylist()]) if b.num_rows else np.zeros((0, 3 * DIMS))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(net.predict(x).astype("f8"))})

    return run


def scores(docs: DataFrame, vectors: np.ndarray, net: Network) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(vectors, net), "doc_id long, score double")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = scores(docs, *train(docs, C.table(spark, sf_dir, "labels")))
    return done.select("doc_id", C.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
