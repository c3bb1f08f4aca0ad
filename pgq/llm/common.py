"""Shared plumbing: session set-up, tables kept in the shared folder, and blocks of documents.

A *block* is one row that holds a few MB of whole documents (ids, offsets, compressed UTF-8).  Operators that compare
every document with the corpus exchange messages between blocks instead of rows between documents: a message carries one
entry for each distinct value in a block, so a value that a third of all rows hold costs one entry a block.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id inside blocks: larger than any other
BLOCK_BYTES = 2 << 20
BLOCK_SCHEMA = "block long, ids binary, offs binary, blob binary, extra binary"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even if the driver was started in another folder."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")), ROOT) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on one machine where none is named, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        found = tempfile.mkdtemp(prefix="pgq-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders and tables that this process has written, oldest first: (path, table or None).
_MADE: list[tuple[str, str | None]] = []


def _new_path(spark: SparkSession, table: str | None = None) -> str:
    if not _MADE:
        atexit.register(_at_exit, spark)
    path = f"{shared_dir(spark)}/pgq-{uuid.uuid4().hex}"
    _MADE.append((path, table))
    return path


def made() -> int:
    """A mark for remove_since()."""
    return len(_MADE)


def remove_since(spark: SparkSession, mark: int, keep: DataFrame | None = None) -> None:
    """Remove what has been written since a mark, but for what `keep` reads: its files, if materialize() gave it.  Plans
    that still need the rest fail.  All of it goes when the process ends."""
    kept = keep.inputFiles()[:1] if keep is not None else []
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    for path, table in _MADE[mark:]:
        if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in kept):
            continue
        if table:
            spark.sql(f"drop table if exists {table}")
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    _MADE[mark:] = [x for x in _MADE[mark:] if any(f"/{x[0].rsplit('/', 1)[1]}/" in f for f in kept)]


def _at_exit(spark: SparkSession) -> None:
    try:
        remove_since(spark, 0)
    except Exception:  # the JVM is gone: nobody can be told, and the folder is the cluster's to clear
        return


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives the loss of executors."""
    path = _new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, n: int, key: str = "bucket") -> DataFrame:
    """Row with key k goes to partition k mod n."""
    return df.repartitionById(n, F.col(key).cast("int"))


def pack(x: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def unpack(x: bytes, dtype: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return np.frombuffer(raw, dtype) if dtype else raw


def blocks_of(docs: DataFrame, keep: list[str] = (), size: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole documents, in a bucketed table kept in the shared folder: joins on block read it without a shuffle.

    Null texts count as empty.  keep: further columns that each block carries as they are.
    """
    from pyspark import TaskContext

    spark, keep = prepare(docs.sparkSession), list(keep)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq, held, texts, rest = TaskContext.get().partitionId() << 32, 0, 0, [], []

        def out() -> pa.RecordBatch:
            nonlocal seq
            extra = b""
            if keep:
                sink = pa.BufferOutputStream()
                whole = pa.Table.from_batches(rest).combine_chunks()
                with pa.ipc.new_stream(sink, whole.schema) as w:
                    w.write_table(whole)
                extra = pack(sink.getvalue().to_pybytes())
            offs = np.zeros(len(texts) + 1, "i8")
            np.cumsum([len(t) for _, t in texts], out=offs[1:])
            ids = np.array([NO_ID if i is None else i for i, _ in texts], "i8")
            seq += 1
            return pa.RecordBatch.from_pydict({"block": pa.array([base + seq], pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in (("ids", ids.tobytes()), ("offs", offs.tobytes()), ("blob", pack(b"".join(t for _, t in texts))), ("extra", extra))}})

        for b in batches:
            lo = 0
            for i, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                texts.append((d, t or b""))
                held += len(t or b"")
                if held >= size or i + 1 == b.num_rows:
                    if keep:
                        rest.append(b.slice(lo, i + 1 - lo).select(list(range(2, b.num_columns))))
                    lo = i + 1
                if held >= size:
                    yield out()
                    held, texts, rest = 0, [], []
        if texts:
            yield out()

    name = f"pgq_blocks_{uuid.uuid4().hex}"
    rows = docs.select("doc_id", F.col("text"), *[F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)])  # mapInArrow can't take every name
    rows.mapInArrow(make, BLOCK_SCHEMA).write.bucketBy(partitions(spark), "block").format("parquet").option("path", _new_path(spark, name)).saveAsTable(name)
    return spark.table(name)


class Block:
    """One row of blocks_of() in numpy."""

    def __init__(self, row: dict):
        self.id = row["block"]
        self.ids, self.offs = np.frombuffer(row["ids"], "i8"), np.frombuffer(row["offs"], "i8")
        self.buf = np.frombuffer(unpack(row["blob"]), "u1")
        self.packed = row["extra"]

    def extra(self) -> pa.Table:
        return pa.ipc.open_stream(unpack(self.packed)).read_all()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def by_row(fn: Callable[[dict], Iterator[pa.RecordBatch]]):
    """mapInArrow function that works on one row at a time (rows hold blocks)."""

    def run(batches):
        for row in rows_of(batches):
            yield from fn(row)

    return run


def by_bucket(fn: Callable[[int, list[dict]], Iterator[pa.RecordBatch]]):
    """mapInArrow function over partitions made by dealt(): calls fn for each bucket with its messages."""

    def run(batches):
        held: dict[int, list[dict]] = {}
        for b in batches:
            for row in b.to_pylist():
                held.setdefault(row["bucket"], []).append(row)
        for k in sorted(held):
            yield from fn(k, sorted(held.pop(k), key=lambda r: r["block"]))

    return run


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Each block with the list of its (bucket, payload) replies; blocks without any have null."""
    own = replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "payload")).alias("replies"))
    return blocks.join(own, "block", "left")


def messages(block: int, buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "block": pa.array([block] * len(buckets), pa.int64()), "payload": pa.array(payloads, pa.binary())})


MESSAGE = "bucket int, block long, payload binary"


def ascii_lower(b: np.ndarray) -> np.ndarray:
    return np.where((b >= 65) & (b <= 90), b + 32, b).astype("u1")


def held_out(col, mod: int, rest: int):
    """crc32 of the id as text, mod `mod`, equals `rest`; a null id is never held out."""
    return F.coalesce(F.crc32(col.cast("string")) % F.lit(mod) == F.lit(rest), F.lit(False))


def hash_sample(df: DataFrame, bound: int, *keys: str) -> DataFrame:
    """The `bound` rows with the smallest hash of the first key, in its order, ties by the other keys.  Rows far beyond
    the bound are dropped where they are, so that few more than `bound` are gathered."""
    n = df.count()
    h = F.xxhash64(F.lit(17), F.col(keys[0]))
    near = int(-(2**63) + 2**64 * min(1.0, (1.2 * bound + 2000) / max(1, n)))
    few = df if near >= 2**63 - 1 else df.where(h <= F.lit(near).cast("long"))
    return few.orderBy(h, *keys).limit(bound)


def without(schema: T.StructType, *names: str) -> list[str]:
    return [f.name for f in schema if f.name not in names]
