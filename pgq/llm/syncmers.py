"""Document fingerprints from closed syncmers, in DataFrame functions only.

Words are hashed; pairs of words are the inner strings.  A run of five words is kept if the smallest of its four pairs is
the first or the last: a choice that depends on the five words alone, so equal passages yield equal anchors wherever they
stand.  The fingerprint is the list of all runs kept, in the order of the text: eight hexadecimal digits for the number of
the run's first word, eight for its 32-bit hash.  Likeness is the exact Jaccard index of the sets of hashes.  Places are
matched as well: `offset_of` finds by how many words most shared anchors are shifted, and `aligned` the share of all anchors
that meet at that shift, so a passage in the same order counts and words strewn about do not.

The next document is found in ranges of rows.  A sample of at most `SAMPLED` keys a range, by a hash, sets the bounds, so
sparse or clustered ids, ids that repeat and rows without an id fall into ranges of like size, and each range is a task.
Only rows alike in id and text stay together, whatever their number.

Defined results: fewer than five words count as one run; no words (null, empty, white space) give an empty fingerprint,
which is like an empty one (1.0) and unlike any other (0.0).  Rows are taken in order of doc_id, descending, nulls last; rows
of one id (or without any) by a hash of their text, equal texts in any order; the next of the last row is the first, of a
lone row itself.  Whole texts are read: a very long one gives an anchor for about every second word.  An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

RUN = 5
SAMPLED, LEAST = 64, 256  # keys of a range that are sampled; rows of a range on average, at least
SMALL = 16 << 20  # bytes of first rows' texts that are broadcast
_KEY = "struct<none:boolean,down:bigint,h:bigint>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the anchors of a column, first to last: number of the first word times 2^32, plus the hash of the run."""
    w, s = f"_w_{out}", f"_s_{out}"
    df = df.withColumn(w, _words(F.col(text)))
    df = df.withColumn(w, F.transform(w, lambda x: F.xxhash64(x)))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(s, pairs)
    at = lambda i, k: F.get(F.col(s), i + k)
    kept = F.transform(
        F.sequence(F.lit(0), F.size(s) - RUN + 1),
        lambda i: F.when(F.least(at(i, 0), at(i, RUN - 2)) <= F.least(at(i, 1), at(i, 2)), F.shiftleft(i.cast("long"), 32) + _low(F.xxhash64(at(i, 0), at(i, 2), at(i, 3)))),
    )
    runs = F.when(F.size(w) >= RUN, F.array_compact(kept)).when(F.size(w) > 0, F.array(_low(F.xxhash64(F.col(w))))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, runs).drop(w, s)


def text_of(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    a, b = F.transform(a, _low), F.transform(b, _low)
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def matches(a: Column, b: Column) -> Column:
    """Anchors that two fingerprints share, as array<struct<hash, a, b>> of the places of their first occurrences."""
    first = lambda x, h: F.shiftrightunsigned(F.array_min(F.filter(x, lambda y: _low(y) == h)), 32)
    both = F.array_intersect(F.transform(a, _low), F.transform(b, _low))
    return F.transform(both, lambda h: F.struct(h.alias("hash"), first(a, h).alias("a"), first(b, h).alias("b")))


def offset_of(found: Column) -> Column:
    """By how many words most of the matches are shifted (the smallest of such shifts); null without any."""
    shifts = F.array_sort(F.transform(found, lambda m: m["b"] - m["a"]))
    counted = F.transform(F.array_distinct(shifts), lambda d: F.struct(F.size(F.filter(shifts, lambda x: x == d)).alias("n"), (-d).alias("d")))
    return -F.array_max(counted)["d"]


def aligned(a: Column, b: Column, shift: Column | int = 0) -> Column:
    """Share of all anchors, by place and hash, that meet once the first fingerprint is moved on by `shift` words."""
    by = (F.lit(shift) if isinstance(shift, int) else shift).cast("long")
    moved = F.transform(a, lambda x: x + F.shiftleft(by, 32)) if not isinstance(shift, int) or shift else a
    either = F.size(F.array_union(moved, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(moved, b)) / either)


def _ranges(docs: DataFrame) -> tuple[DataFrame, list[tuple]]:
    """doc_id, text, key, part: rows in ranges of their key, numbered in order; and the key that each range starts with,
    which is one of the rows' own."""
    spark = docs.sparkSession
    i = F.col("doc_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct(i.isNull().alias("none"), F.coalesce(F.bitwise_not(i), F.lit(0).cast("long")).alias("down"), F.xxhash64("text").alias("h"))
    rows = rows.withColumn("key", key)
    n, least = rows.agg(F.count("*"), F.min("key")).first()
    parts = max(1, min(4 * C.partitions(spark), n // LEAST))
    bounds = [tuple(least)] if n else []
    if parts > 1:  # SAMPLED keys a range on average reach the driver
        near = F.pmod(F.xxhash64("key.none", "key.down", "key.h"), F.lit(n)) < SAMPLED * parts
        seen = sorted(tuple(r) for r in rows.where(near).select("key.*").collect())
        bounds = sorted({*bounds, *(seen[len(seen) * k // parts] for k in range(1, parts) if seen)})
    if len(bounds) < 2:
        return rows.withColumn("part", F.lit(0)), bounds
    table = F.array(*[F.struct(*map(F.lit, b)) for b in bounds[1:]]).cast(f"array<{_KEY}>")
    # how many bounds are not above the key, by halving: lo and hi close in on it
    above = lambda s: F.get(table, s["mid"]) <= F.col("key")
    halve = lambda s: F.struct(F.when(above(s), s["mid"] + 1).otherwise(s["lo"]).alias("lo"), F.when(above(s), s["hi"]).otherwise(s["mid"]).alias("hi"))
    with_mid = lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("mid"))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi"), F.lit((len(bounds) - 1) // 2).alias("mid"))
    step = lambda s, _: F.when(s["lo"] < s["hi"], with_mid(halve(s))).otherwise(s)
    return rows.withColumn("part", F.aggregate(F.array(*[F.lit(0)] * len(bounds).bit_length()), start, step)["lo"]), bounds


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch.

    Texts are shuffled once, by ranges of rows.  The last row of a range has the first one of the next range as its next:
    these rows, a few times the shuffle partitions at most, are found by their keys in a scan of their own, and broadcast if
    their texts are small, counted; beyond that they are joined, which shuffles the rest once more.
    """
    rows, bounds = _ranges(docs)
    held = sketch(rows.repartitionById(max(1, len(bounds)), F.col("part")), "text", "sketch")
    inner = held.withColumn("x", F.lead(F.struct("text", "sketch")).over(Window.partitionBy("part").orderBy("key")))
    starts = docs.sparkSession.createDataFrame([((k - 1) % len(bounds), b) for k, b in enumerate(bounds)], f"before int, start {_KEY}")
    first = rows.select("key", "text").join(F.broadcast(starts), F.col("key") == F.col("start")).groupBy("before").agg(F.min("text").alias("text"))
    first = C.materialize(first)
    size = first.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    heads = sketch(first, "text", "sketch").select(F.col("before").alias("part"), F.struct("text", "sketch").alias("head"))
    heads = F.broadcast(heads) if size <= SMALL else heads
    x = F.coalesce("x", "head")
    return inner.join(heads, "part").select("doc_id", "text", "sketch", x["text"].alias("next_text"), x["sketch"].alias("next_sketch"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, aligned_edited."""
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("k", F.expr("cast(n_chars div 3 as int)"))
    d = d.withColumn("edited", F.expr("concat(substr(text, 1, cast(n_chars as int) - k), substr(next_text, 1, k))"))
    d = sketch(d, "edited", "edited_sketch")
    return d.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("sketch")).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        aligned(F.col("sketch"), F.col("edited_sketch")).alias("aligned_edited"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return fingerprints(C.table(spark, sf_dir, "documents"))
