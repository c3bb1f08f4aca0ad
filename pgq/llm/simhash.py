"""SimHash near-dedup with multi-index hashing.

Fingerprints that are two or fewer bits apart are linked.  Each 32-bit half is a segment.  Two such fingerprints agree in
one half, or differ by one bit in each.  So small Hamming balls are enumerated in a segment (radius 0 in either half,
radius 1 in the upper one), and what is left of the distance picks pieces of the other half that must agree as well:
three pieces for two bits, two for one.  A table bucket therefore fixes 42 bits or more, which bounds how many distinct
fingerprints it can hold whatever the corpus.  Matches are verified on all 64 bits.  Large buckets are searched by
flipping their free bits, and yield a spanning star for each of their components, not pairs.

Defined results: texts without words (null, empty, white space) have fingerprint zero, linked like any other; equal rows
each get a row; a null doc_id takes part but never names a component unless all ids there are null; very long texts are
hashed whole, all shingles at once; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .components import stars

SHINGLE, RADIUS, SEED = 3, 2, 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SMALL = 48
#: Pieces of the other half by what is left of the distance: (shift, bits).
_PIECES = {2: ((0, 11), (11, 11), (22, 10)), 1: ((0, 16), (16, 16))}


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= SHINGLE:
        h = [xxhash.xxh64_intdigest(whole, SEED)]
    else:
        end = np.cumsum([len(w) + 1 for w in words])
        start = np.concatenate([[0], end[: -SHINGLE]]).tolist()
        digest = xxhash.xxh64_intdigest
        h = [digest(whole[a:b], SEED) for a, b in zip(start, (end[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(h, "<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).cast(pa.int64()), "fp": pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())})


def _marked(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).cast(pa.int64()), "h": b.column(1), "fp": pa.array([fingerprint(t) for t in b.column(2).to_pylist()], pa.int64())})


def fingerprints(docs: DataFrame) -> DataFrame:
    C.prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each fingerprint and its index: kind 2 bits, segment 32, piece 2, value 16, probe 1."""
    u = fp.view("u8")
    hi, lo = u >> np.uint64(32), u & np.uint64(0xFFFFFFFF)
    keys, at, every = [], [], np.arange(len(u))

    def put(kind, seg, other, left, probe, rows):
        for j, (shift, bits) in enumerate(_PIECES[left]):
            v = (other >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
            keys.append((((np.uint64(kind) << np.uint64(32) | seg) << np.uint64(2) | np.uint64(j)) << np.uint64(16) | v) << np.uint64(1) | np.uint64(probe))
            at.append(rows)

    put(0, hi, lo, 2, 0, every)
    put(1, lo, hi, 2, 0, every)
    put(2, hi, lo, 1, 0, every)
    for bit in range(32):
        free = np.flatnonzero((hi >> np.uint64(bit)) & np.uint64(1) == 0)
        put(2, hi[free] | np.uint64(1 << bit), lo[free], 1, 1, free)
    return np.concatenate(keys), np.concatenate(at)


def _send(n: int):
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype("i8")
            for lo in range(0, len(fp), 4096):
                key, at = _keys(fp[lo : lo + 4096])
                mixed = (key >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(((mixed >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype("i4")), "key": pa.array(key.astype("i8")), "fp": pa.array(fp[lo : lo + 4096][at])})

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def _crowd(fp: np.ndarray, table: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components of one large bucket; masks: what partners can differ by."""
    fp, at = np.unique(fp, return_index=True)
    table = table[at]
    label = np.arange(len(fp))
    for m in masks:
        want = fp ^ m
        to = np.minimum(np.searchsorted(fp, want), len(fp) - 1)
        a = np.flatnonzero((fp[to] == want) & (fp < want) & (table | table[to]))
        b = to[a]
        while len(a):
            la, lb = label[a], label[b]
            if (la == lb).all():
                break
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label = label[label]
    off = label != np.arange(len(fp))
    return fp[off], fp[label[off]]


def _links(batches):
    rows = [(b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
    if not rows:
        return
    key, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
    rows.clear()
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order].view("u8")
    bucket, table = key >> 1, key & 1 == 0
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(head, len(bucket)))
    use = np.repeat((size > 1) & table[head], size)  # tables sort before probes
    bucket, table, fp, size = bucket[use], table[use], fp[use], np.repeat(size, size)[use]
    few = size <= _SMALL
    b, t, f, left, right = bucket[few], table[few], fp[few], [], []
    for s in range(1, _SMALL):
        i = np.flatnonzero(b[s:] == b[:-s])
        if not len(i):
            break
        i = i[t[i] & _near(f[i], f[i + s])]
        left.append(f[i])
        right.append(f[i + s])
    big = np.flatnonzero(~few)
    for rows_of in np.split(big, np.flatnonzero(np.diff(bucket[big])) + 1) if len(big) else ():
        k = int(bucket[rows_of[0]])
        kind, j = k >> 50, (k >> 16) & 3
        shift, bits = _PIECES[2 if kind < 2 else 1][j]
        free = [np.uint64(1 << (i + 32 * (kind == 1))) for i in range(32) if not shift <= i < shift + bits]
        if kind == 2:  # one bit in the upper half, none or one in the lower
            up = [np.uint64(1 << i) for i in range(32, 64)]
            masks = up + [x | y for x in up for y in free]
        else:
            masks = free + [x | y for x, y in combinations(free, 2)]
        a, c = _crowd(fp[rows_of], table[rows_of], np.array(masks, "u8"))
        left.append(a)
        right.append(c)
    if left:
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1).view("i8"), axis=0)
        yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect what pairs within RADIUS bits connect; fps: distinct fp."""
    n = C.partitions(fps.sparkSession)
    sent = C.dealt(fps.mapInArrow(_send(n), "bucket int, key long, fp long"), n)
    return sent.mapInArrow(_links, "a long, b long")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id."""
    marked = C.materialize(fingerprints(docs))
    nodes = C.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = stars(links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "root").join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op7(spark, sf_dir: str) -> DataFrame:
    return components(C.table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: exactly one row of each component stays, one with the smallest id; of texts that share that id, the
    one with the smallest fingerprint.  Rows without a doc_id stay.

    Rows are chosen by id where an id comes once, which moves no text; only rows whose id comes again are looked at whole.
    """
    narrow = C.materialize(components(docs).where("doc_id is not null"))
    by_id = narrow.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("component_id").alias("least"))
    many = C.materialize(by_id.where("n > 1").select("doc_id"))
    done = by_id.where("n > 1 or doc_id <> least").select("doc_id")
    once = docs.join(done, "doc_id", "left_anti")
    again = docs.join(many, "doc_id", "left_semi")
    if many.isEmpty():
        return once.select(*[F.col(f"`{c}`") for c in docs.columns])
    best = narrow.where("doc_id = component_id").groupBy("doc_id").agg(F.min("fp").alias("fp"))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # of one id the texts of one fingerprint: a hash of the text stands for it
    h = F.xxhash64("text")
    fps = again.select("doc_id", "text", h.alias("h")).groupBy("doc_id", "h").agg(F.min("text").alias("text")).mapInArrow(_marked, "doc_id long, h long, fp long")
    marked = again.select(own, F.col("doc_id").cast("long").alias("doc_id"), h.alias("h")).join(fps, ["doc_id", "h"])
    first = F.row_number().over(Window.partitionBy("doc_id", "fp").orderBy("h"))
    chosen = marked.join(best, ["doc_id", "fp"], "left_semi").withColumn("_n", first).where("_n = 1").select("row.*")
    return once.unionByName(chosen).select(*[F.col(f"`{c}`") for c in docs.columns])
