"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a Hadamard transform, and the nearest signed axis is a digit of
its bucket.  A bucket has as many digits, each by a rotation of its own, as the table needs to keep about `BUCKET` vectors in
one; the last rotation looks at its first few axes only, so that the number of buckets follows the number of vectors.  Each
of `TABLES` tables holds every distinct vector once.  A query probes a number of buckets over all tables, those whose axes
fall least short of its nearest ones, and everything in them is scored exactly on the original vectors.  How many is
measured: `TRIAL` vectors are searched in the whole table by brute force, and as many buckets are probed as it takes to hold
`RECALL` of what that finds.  So vectors that hash well are searched in few buckets, however large the table, and recall holds
where they do not; at `MOST` probes it ends.  Queries whose probed buckets hold fewer than `top` candidates are then scored
against all blocks.

Equal vectors are one entry, with their `top` + 1 smallest ids, so copies cannot fill a bucket; queries that share one vector
with many others meet it by a broadcast of such vectors, of which there are fewer than shuffle partitions.  Buckets are split
into salted blocks of `BLOCK_ROWS`; a query meets every block of a bucket it probes.  A task reads its blocks in turn, the
vectors first and then the queries that meet them, so what it holds is one block.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without vec_id; shorter vectors count as padded with zeros; equal scores go by smaller vec_id; a query never finds its own
id; fewer candidates than `top` give all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

TABLES, TOP, BLOCK_ROWS, BUCKET, NEAR = 4, 20, 4096, 512, 12
TRIAL, RECALL, LEAST, MOST = 256, 0.97, 32, 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turned(x: np.ndarray, table: int) -> np.ndarray:
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(1000 + table).choice([-1.0, 1.0], size=(3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat, size = column.flatten().to_numpy(zero_copy_only=False).astype("f8"), np.diff(column.offsets.to_numpy())
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def digits(n: int, width: int) -> list[int]:
    """How many signed axes each digit of a bucket chooses from: as many buckets as n vectors need, the last digit cut."""
    whole = 2 << max(0, width - 1).bit_length()
    need, found = n / BUCKET, [whole]
    while need > np.prod(found, dtype="f8") and len(found) < 4:
        found.append(int(min(whole, max(2, 2 * round(need / np.prod(found, dtype="f8") / 2)))))
    return found


def axes(x: np.ndarray, sizes: list[int], table: int) -> list[np.ndarray]:
    """For each digit how near unit vectors are to the axes it chooses from."""
    turns = (turned(x, table + TABLES * d)[:, : n // 2] for d, n in enumerate(sizes))
    return [np.concatenate([t, -t], 1) for t in turns]


def buckets(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The bucket of each unit vector in every table, tables numbered on."""
    out = np.zeros((len(x), TABLES), "i8")
    for k in range(TABLES):
        out[:, k] = k
        for a, n in zip(axes(x, sizes, k), sizes, strict=True):
            out[:, k] = out[:, k] * n + a.argmax(1)
    return out


def probed(x: np.ndarray, sizes: list[int], probes: int) -> np.ndarray:
    """The buckets, over all tables, whose axes fall least short of the nearest ones, those first."""
    found, loss = [], []
    for k in range(TABLES):
        cell, short = np.full((len(x), 1), k, "i8"), np.zeros((len(x), 1))
        for a, n in zip(axes(x, sizes, k), sizes, strict=True):
            few = n if len(sizes) == 1 else min(n, max(NEAR, probes // NEAR))
            near = np.argpartition(-a, few - 1, axis=1)[:, :few] if few < n else np.broadcast_to(np.arange(n), a.shape)
            less = (a.max(1, keepdims=True) - np.take_along_axis(a, near, 1)) ** 2
            cell = (cell[:, :, None] * n + near[:, None, :]).reshape(len(x), -1)
            short = (short[:, :, None] + less[:, None, :]).reshape(len(x), -1)
            if cell.shape[1] > probes:
                keep = np.argpartition(short, probes - 1, axis=1)[:, :probes]
                cell, short = np.take_along_axis(cell, keep, 1), np.take_along_axis(short, keep, 1)
        found.append(cell)
        loss.append(short)
    cell, short = np.concatenate(found, 1), np.concatenate(loss, 1)
    return np.take_along_axis(cell, np.argsort(short, axis=1, kind="stable")[:, :probes], 1)


def _trial(width: int, sizes: list[int], who: np.ndarray, q: np.ndarray, top: int):
    """For each trial query the best of what a task reads, and after how many probes each would be met."""
    cells = probed(_unit(q), sizes, MOST)
    order = np.argsort(cells, axis=1, kind="stable")
    ranked = np.take_along_axis(cells, order, 1)

    def run(batches):
        score, met = np.full((len(who), top), -np.inf), np.full((len(who), top), MOST)
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                x, own = _matrix(part.column(1), width), part.column(0).to_numpy()
                home, s = buckets(_unit(x), sizes), np.where(own == who[:, None], -np.inf, q @ x.T)
                few = min(top, len(own))
                pick = np.argpartition(-s, few - 1, axis=1)[:, :few]
                probe = np.full((len(who), few), MOST)
                for i in range(len(who)):
                    at = np.minimum(np.searchsorted(ranked[i], home[pick[i]]), cells.shape[1] - 1)
                    probe[i] = np.where(ranked[i][at] == home[pick[i]], order[i][at], MOST).min(1)
                both, place = np.concatenate([score, np.take_along_axis(s, pick, 1)], 1), np.concatenate([met, probe], 1)
                keep = np.argsort(-both, axis=1, kind="stable")[:, :top]
                score, met = np.take_along_axis(both, keep, 1), np.take_along_axis(place, keep, 1)
        i, j = np.nonzero(np.isfinite(score))
        if len(i):
            yield pa.RecordBatch.from_pydict({"rep": pa.array(who[i]), "vec_id": pa.array(met[i, j].astype("i8")), "score": pa.array(score[i, j])})

    return run


def enough_probes(entries: DataFrame, width: int, sizes: list[int], top: int) -> int:
    """How many buckets hold RECALL of the neighbours of TRIAL vectors, found by brute force."""
    rows = C.hash_sample(entries.select("rep", "v"), TRIAL, "rep").collect()
    if not rows:
        return LEAST
    q = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        q[i, : len(r["v"])] = r["v"]
    seen = entries.select("rep", "v").mapInArrow(_trial(width, sizes, np.array([r["rep"] for r in rows]), q, top), "rep long, vec_id long, score double")
    window = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    met = sorted(r[0] for r in seen.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= top).select("vec_id").collect())  # TRIAL x top at most
    return int(np.clip(met[min(len(met) - 1, int(RECALL * len(met)))] + 1, LEAST, MOST)) if met else LEAST


def _send(width: int, sizes: list[int], salts: int, probes: int, queries: bool):
    """One row for each vector and bucket: entries go to one salted block, queries to all blocks of the buckets probed."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _unit(_matrix(part.column(1), width))
                cells = probed(x, sizes, probes) if queries else buckets(x, sizes)
                row = np.repeat(np.arange(len(x)), cells.shape[1])
                if queries:
                    bucket, row = (cells.ravel()[:, None] * salts + np.arange(salts)).ravel(), np.repeat(row, salts)
                else:
                    ids = part.column(0).to_numpy().view("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                    bucket = cells.ravel() * salts + np.repeat((ids % np.uint64(salts)).astype("i8"), TABLES)
                for lo in range(0, len(row), 20_000):
                    pick = pa.array(row[lo : lo + 20_000])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[lo : lo + 20_000]), pa.array([queries] * len(pick)), *(part.column(i).take(pick) for i in range(3))], names=["bucket", "query", "rep", "v", "ids"])

    return run


def _scored(who: np.ndarray, q: np.ndarray, held: tuple, top: int) -> pa.RecordBatch:
    """The best `top` + 1 ids of each query in one block."""
    cs, n, flat, start = held
    s = q @ cs.T
    few = min(top + 9, s.shape[1])
    edge = np.take_along_axis(s, np.argpartition(-s, few - 1, axis=1)[:, :few], 1).min(1)
    out_q, out_i, out_s = [], [], []
    for i in range(len(q)):
        # rounding of a matrix product must not decide between equals
        p = np.flatnonzero(s[i] >= edge[i] - 1e-9 * max(1.0, abs(edge[i])))
        exact = (cs[p] * q[i]).sum(1)
        p, exact = np.repeat(p, n[p]), np.repeat(exact, n[p])
        own = flat[start[p] + np.arange(len(p)) - np.searchsorted(p, p)]
        best = np.lexsort((own, -exact))[: top + 1]
        out_q.append(np.full(len(best), who[i]))
        out_i.append(own[best])
        out_s.append(exact[best])
    return pa.RecordBatch.from_pydict({"rep": pa.array(np.concatenate(out_q)), "vec_id": pa.array(np.concatenate(out_i)), "score": pa.array(np.concatenate(out_s))})


def _score(width: int, top: int):
    """Each query against the blocks it meets; rows come by bucket, a block's vectors before its queries."""

    def block(parts: list) -> tuple:
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids = rows.column("ids").to_pylist()
        cs = _matrix(rows.column("v").chunk(0), width)
        order = sorted(range(len(ids)), key=lambda i: ids[i][0])
        cs, ids = cs[order], [ids[i] for i in order]
        n = np.array([len(i) for i in ids])
        return cs, n, np.concatenate(ids), np.cumsum(n) - n

    def run(batches):
        now, held, ready = None, [], None
        for b in batches:
            bucket, query = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (query[1:] != query[:-1])) + 1
            for lo, hi in zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(bucket)).tolist(), strict=True):
                if lo == hi:
                    continue
                if bucket[lo] != now:
                    now, held, ready = bucket[lo], [], None
                if not query[lo]:
                    held.append(b.slice(lo, hi - lo))
                elif held:
                    ready = ready or block(held)
                    for at in range(lo, hi, 256):
                        part = b.slice(at, min(256, hi - at))
                        yield _scored(part.column(2).to_numpy(), _matrix(part.column(3), width), ready, top)

    return run


def _best(top: int):
    """Of what the blocks found, each query's best `top` + 1 as a list."""

    def run(batches):
        held = [[b.column(i).to_numpy() for i in range(3)] for b in batches]
        if not held:
            return
        rep, vec, score = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((vec, -score, rep))
        rep, vec, score = rep[order], vec[order], score[order]
        new = np.concatenate([[True], (rep[1:] != rep[:-1]) | (vec[1:] != vec[:-1]) | (score[1:] != score[:-1])])
        rep, vec, score = rep[new], vec[new], score[new]
        head = np.flatnonzero(np.concatenate([[True], rep[1:] != rep[:-1]]))
        for lo, hi in zip(head, np.append(head[1:], len(rep)), strict=True):
            hi = min(hi, lo + top + 1)
            yield pa.RecordBatch.from_pydict({"rep": pa.array([rep[lo]]), "found": pa.array([[{"vec_id": int(a), "score": float(s)} for a, s in zip(vec[lo:hi], score[lo:hi], strict=True)]], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))})

    return run


def _with(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined with `table` on a key; hot: those rows of it that many rows meet, few, which are broadcast."""
    some = F.broadcast(hot.select(key).distinct())
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(some, key, "left_anti").join(table.join(some, key, "left_anti"), key))


def search(vectors: DataFrame, every: int = 20, top: int = TOP, probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score; queries: rows whose vec_id is divisible by `every`.  probes: measured, if not given."""
    spark = C.prepare(vectors.sparkSession)
    parts = C.partitions(spark)
    v = F.col("embedding").cast("array<double>")
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(v, lambda x: x != 0))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    firsts = good.withColumn("_rank", rank).where(F.col("_rank") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    counts = good.where(F.col("vec_id") % every == 0).groupBy("v").agg(F.count("*").alias("asked"))
    entries = C.materialize(firsts.join(counts, "v", "left").select(F.col("ids")[0].alias("rep"), "v", "ids", F.coalesce("asked", F.lit(0)).alias("asked")))
    n, width, total, asks = entries.agg(F.count("*"), F.max(F.size("v")), F.sum(F.size("ids")), F.sum("asked")).first()
    width, total = width or 1, total or 0
    sizes = digits(n, width)
    probes = probes or enough_probes(entries, width, sizes, top)
    salts = max(1, -(-n // (2 * int(np.prod(sizes)) * BLOCK_ROWS)))
    often = entries.where(F.col("asked") * parts > F.lit(asks or 0)).select("v", "rep")  # fewer than partitions
    asked = C.materialize(_with(good.where(F.col("vec_id") % every == 0), entries.select("v", "rep"), "v", often).select("vec_id", "rep"))
    queries = entries.where("asked > 0").select("rep", "v", F.slice("ids", 1, 0).alias("ids"))
    row = f"bucket long, query boolean, rep long, v {kind}, ids array<long>"
    in_order = lambda d: C.dealt(d.withColumn("to", F.pmod(F.xxhash64("bucket"), F.lit(parts)).cast("int")), parts, "to").drop("to").sortWithinPartitions("bucket", "query")
    found = "rep long, vec_id long, score double"
    sent = entries.select("rep", "v", "ids").mapInArrow(_send(width, sizes, salts, probes, False), row).unionByName(queries.mapInArrow(_send(width, sizes, salts, probes, True), row))
    lists = "rep long, found array<struct<vec_id:long,score:double>>"
    best = C.materialize(in_order(sent).mapInArrow(_score(width, top), found).repartition(parts, "rep").mapInArrow(_best(top), lists))
    enough = best.where(F.size("found") >= min(top + 1, total))
    short = C.materialize(queries.join(enough.select("rep"), "rep", "left_anti"))
    if not short.isEmpty():  # their buckets hold too few: all blocks
        blocks = parts * max(1, -(-n // (parts * BLOCK_ROWS)))
        held = entries.select(F.pmod(F.xxhash64("rep"), F.lit(blocks)).alias("bucket"), F.lit(False).alias("query"), "rep", "v", "ids")
        asks_all = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("bucket"), F.lit(True).alias("query"), "rep", "v", "ids")
        best = enough.unionByName(in_order(held.unionByName(asks_all)).mapInArrow(_score(width, top), found).repartition(parts, "rep").mapInArrow(_best(top), lists))
    own = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    both = _with(asked.select(F.col("vec_id").alias("query_id"), "rep"), best, "rep", best.join(F.broadcast(often.select("rep")), "rep", "left_semi")).select("query_id", F.posexplode(own))
    return both.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "col.vec_id", "col.score")


def op3(spark, sf_dir: str) -> DataFrame:
    return search(C.table(spark, sf_dir, "embeddings"))
