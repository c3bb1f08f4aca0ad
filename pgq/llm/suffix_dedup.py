"""Suffix-array dedup: remove every byte covered by a 50-byte string that also starts in a document with a smaller id.

Plan.  The suffixes that can matter are found first, so that no shuffle carries one row a byte:

1. every 50-byte window has one *anchor*, its 16-byte gram with the smallest hash (leftmost on ties), so equal windows
   have equal anchors at equal places; blocks send the distinct anchor hashes, four bytes each;
2. anchors met in two documents go back to their blocks, which send the *contexts* of those anchors (the bytes of all
   windows that have the anchor), each distinct context once a block with the smallest doc_id that holds it;
3. each bucket sorts the suffixes of its distinct contexts to 50 bytes with a deep-shallow sort (two bytes by radix, multikey
   quicksort over eight-byte symbols down to 16 bytes, blind tries for the groups that are left), in which equal windows
   stand side by side: each gets the smallest doc_id that holds it; blocks get these ids back and cut their documents.

Anchor hashes only choose candidates; windows are compared byte by byte.  A passage that a third of all documents hold
costs one message entry a block.

Defined results: null text counts as empty (0 bytes); a very long text is one block of its own, read in slices; a null doc_id counts as larger than any other; rows with equal
doc_id never remove each other's bytes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, GRAM = 50, 16
SPAN = WINDOW - GRAM + 1
SHALLOW = 16
SHARES = 64  # of a bucket, by anchor: what is sorted at once
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**64, 256, dtype="u8")
_STEP = _rng.integers(0, 2**63, 5, dtype="u8") * np.uint64(2) + np.uint64(1)
_POS = np.uint64((1 << 24) - 1)
_SLICE = 1 << 22


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 16 bytes from each position."""
    h = _BYTE[buf]
    for i, s in enumerate((1, 2, 4, 8)):
        h = h[:-s] * _STEP[i] + h[s:]
    h ^= h >> np.uint64(32)
    h *= _STEP[4]
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    done = 1
    while done < w:
        s = min(done, w - done)
        x = np.minimum(x[:-s], x[s:])
        done += s
    return x


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, end of windows, 40-bit key) of each run of windows that share an anchor."""
    out = []
    for lo in range(0, max(0, len(buf) - WINDOW + 1), _SLICE):
        part = buf[lo : lo + _SLICE + WINDOW - 1]
        n = len(part) - WINDOW + 1
        h = gram_hashes(part)
        best = sliding_min((h & ~_POS) | np.arange(len(h), dtype="u8"), SPAN)
        pos = (best & _POS).astype("i8")
        cross = np.zeros(n + 1, "i4")
        at = offs[1:-1][(offs[1:-1] > lo) & (offs[1:-1] < lo + len(part))] - lo
        np.add.at(cross, np.maximum(at - WINDOW + 1, 0), 1)
        np.add.at(cross, np.minimum(at, n), -1)
        ok = np.cumsum(cross[:-1]) == 0
        cut = np.flatnonzero((pos[1:] != pos[:-1]) | (ok[1:] != ok[:-1])) + 1
        first = np.concatenate([[0], cut])
        end = np.append(cut, n)
        first, end = first[ok[first]], end[ok[first]]
        key = h[pos[first]] * _STEP[3]  # the smallest of many hashes is small: mixed again, keys spread evenly
        out.append((first + lo, end + lo, (key ^ (key >> np.uint64(31))) * _STEP[4] >> np.uint64(24)))
    if not out:
        return (np.zeros(0, "i8"),) * 3 + (np.zeros(0, "u8"),)
    first, end, key = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.searchsorted(offs, first, "right") - 1, first, end, key


def split_key(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit rest of a 40-bit key; the two together keep more bits than either."""
    return ((key >> np.uint64(16)) * np.uint64(n) >> np.uint64(24)).astype("i8"), (key & np.uint64(0xFFFFFFFF)).astype("u4")


def send_anchors(n: int):
    def one(row):
        b = C.Block(row)
        doc, _, _, key = anchors(b.buf, b.offs)
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        key, own = key[order], b.ids[doc[order]]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
        bucket, rest = split_key(key[start], n)
        bucket, rest = np.repeat(bucket, 1 + many), np.repeat(rest, 1 + many)  # twice: met in two documents of the block
        order = np.argsort(bucket, kind="stable")
        bucket, rest = bucket[order], rest[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        yield C.messages(b.id, bucket[cuts].tolist(), [x.tobytes() for x in np.split(rest, cuts[1:])])

    return C.by_row(one)


def find_shared(bucket: int, rows: list[dict]):
    parts = [np.frombuffer(r["payload"], "u4") for r in rows]
    value, count = np.unique(np.concatenate(parts), return_counts=True)
    value = value[count > 1]
    if not len(value):
        return
    got = []
    for r, x in zip(rows, parts, strict=True):
        x = np.unique(x)
        at = np.minimum(np.searchsorted(value, x), len(value) - 1)
        if len(x := x[value[at] == x]):
            got.append((r["block"], x.tobytes()))
    for block, x in got:
        yield C.messages(block, [bucket], [x])


def contexts(b: C.Block, replies: list | None, n: int):
    """Runs whose anchor is shared: (document, first, end, bucket, index in the bucket), and by bucket the distinct
    contexts in order of first appearance with the smallest doc_id of each."""
    doc, first, end, key = anchors(b.buf, b.offs)
    bucket, rest = split_key(key, n)
    wide = (bucket.astype("u8") << np.uint64(32)) | rest
    shared = np.sort(np.concatenate([(np.uint64(r["bucket"]) << np.uint64(32)) | np.frombuffer(r["payload"], "u4") for r in replies or ()] or [np.zeros(0, "u8")]))
    if not len(shared):
        return (np.zeros(0, "i8"),) * 5, {}
    hit = shared[np.minimum(np.searchsorted(shared, wide), len(shared) - 1)] == wide
    doc, first, end, bucket = doc[hit], first[hit], end[hit], bucket[hit]
    raw, seen, index = b.buf.tobytes(), {}, np.zeros(len(doc), "i8")
    own = b.ids[doc].tolist()
    share = (rest[hit] % SHARES).tolist()
    for i, (lo, hi, k, d, g) in enumerate(zip(first.tolist(), end.tolist(), bucket.tolist(), own, share, strict=True)):
        mine = seen.setdefault(k, {})
        x = mine.setdefault(raw[lo : hi + WINDOW - 1], [len(mine), d, g])
        index[i] = x[0]
        if d < x[1]:
            x[1] = d
    return (doc, first, end, bucket, index), seen


def send_contexts(n: int):
    def one(row):
        b = C.Block(row)
        _, seen = contexts(b, row["replies"], n)
        out = [(k, C.pack(np.array([len(x)], "i8").tobytes() + np.array([d for _, d, _ in x.values()], "i8").tobytes() + np.array([len(t) for t in x], "u1").tobytes() + np.array([g for _, _, g in x.values()], "u1").tobytes() + b"".join(x))) for k, x in sorted(seen.items())]
        if out:
            yield C.messages(b.id, [k for k, _ in out], [p for _, p in out])

    return C.by_row(one)


def _symbols(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one big-endian symbol."""
    return np.lib.stride_tricks.sliding_window_view(buf, 8)[at].copy().view(">u8").ravel().astype("u8")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts, and its length."""
    new = np.empty(len(key), bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(key)))


def _by_small_key(key: np.ndarray) -> np.ndarray:
    """Stable order of small whole numbers; two bytes are sorted by radix."""
    return np.argsort(key.astype("u2") if len(key) and key[-1] < 65536 and key.max() < 65536 else key, kind="stable")


class Order:
    """Suffixes in the making of their order: `sa` holds them slot by slot, `group` the first slot of those still alike."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray):
        self.buf, self.starts, n = buf, starts, len(starts)
        self.sa, self.group = np.arange(n), np.zeros(n, "i8")

    def split(self, slots: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order each group's slots by `part`, a number below 256; give the order, the new groups' starts and sizes."""
        head, size = _runs(self.group[slots])
        key = np.repeat(np.arange(len(head)), size) * 256 + part
        order = _by_small_key(key)
        self.sa[slots] = self.sa[slots][order]
        head, size = _runs(key[order])
        self.group[slots] = np.repeat(slots[head], size)
        return order, head, size

    def by_two_bytes(self) -> np.ndarray:
        """The first step, a radix sort; slots of groups of more than one."""
        if not len(self.sa):
            return self.sa
        key = (self.buf[self.starts].astype("u2") << np.uint16(8)) | self.buf[self.starts + 1]
        self.sa = np.argsort(key, kind="stable")
        head, size = _runs(key[self.sa])
        self.group = np.repeat(head, size)
        return np.flatnonzero(np.repeat(size > 1, size))

    def quicksort(self, slots: np.ndarray, shallow: int) -> np.ndarray:
        """Multikey quicksort of all groups at once, down to `shallow` bytes: each takes the median of three of its symbols
        as pivot and falls into what is less, equal and greater; the equal part goes on to its next symbol.  Slots of groups
        that are equal so far."""
        at, deep = np.zeros(len(slots), "i8"), [np.zeros(0, "i8")]
        symbol = _symbols(self.buf, self.starts[self.sa[slots]]) if len(slots) else np.zeros(0, "u8")
        while len(slots):
            head, size = _runs(self.group[slots])
            a, b, c = symbol[head], symbol[head + size // 2], symbol[head + size - 1]
            pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
            side = (symbol > pivot).astype("i1") - (symbol < pivot) + 1
            order, _, size = self.split(slots, side)
            symbol, equal = symbol[order], side[order] == 1
            at = at[order] + 8 * equal
            more = np.repeat(size > 1, size)
            deep.append(slots[more & (at >= shallow)])
            more &= at < shallow
            slots, at, symbol, equal = slots[more], at[more], symbol[more], equal[more]
            on = np.flatnonzero(equal)
            if len(on):
                symbol[on] = _symbols(self.buf, self.starts[self.sa[slots[on]]] + at[on])
        return np.sort(np.concatenate(deep))

    def tries(self, slots: np.ndarray, shallow: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Blind tries over the rest of each group's suffixes, of all groups at once, a level at a time.  A node knows how
        many bytes its members share and tells them apart by the one byte that follows; the bytes skipped are never
        compared again, and what is read of a suffix is read once.  The slots are left in the order in which a walk
        meets the leaves.  By level: (bytes skipped, children) of the nodes that branch."""
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(slots):
            return levels
        rest = np.lib.stride_tricks.sliding_window_view(self.buf, depth - shallow)[self.starts[self.sa[slots]] + shallow]
        row, live = np.arange(len(slots)), np.arange(len(slots))  # the row of `rest` that stands at each slot
        while len(live):
            head, size = _runs(self.group[slots[live]])
            mine = rest[row[live]]
            differ = mine != np.repeat(mine[head], size, axis=0)
            shared = np.minimum.reduceat(np.where(differ.any(1), differ.argmax(1), depth - shallow), head)
            fork = np.repeat(shared < depth - shallow, size)  # the others are equal to the end: leaves
            live = live[fork]
            if not len(live):
                break
            byte = mine[fork][np.arange(len(live)), np.repeat(shared, size)[fork]]
            order, _, size = self.split(slots[live], byte)
            row[live] = row[live][order]
            forks = shared[shared < depth - shallow]
            levels.append((forks, np.array([len(size), len(forks)])))
            live = live[np.repeat(size > 1, size)]
        return levels


def deep_shallow(buf: np.ndarray, starts: np.ndarray, depth: int = WINDOW, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order the suffixes at `starts` by their first `depth` bytes; also the group of equal ones that each belongs to.

    Every suffix has at least `depth` bytes, and `shallow` is a multiple of eight.  Deep-shallow sort: two bytes by radix,
    multikey quicksort over eight-byte symbols down to `shallow` bytes, blind tries for the groups that are left."""
    done = Order(buf, starts)
    done.tries(done.quicksort(done.by_two_bytes(), shallow), shallow, depth)
    return done.sa, done.group


def first_holders(seen: dict[bytes, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts (bytes -> [index, smallest id]): the smallest id that holds each of their windows, where the windows
    of each context start and end, and the smallest of those ids."""
    size = np.array([len(x) for x in seen], "i8")
    buf = np.frombuffer(b"".join(seen) + bytes(8), "u1")
    offs = np.concatenate([[0], np.cumsum(size)])
    wins = size - WINDOW + 1
    w_offs = np.concatenate([[0], np.cumsum(wins)])
    owner = np.repeat(np.arange(len(size)), wins)
    starts = np.arange(w_offs[-1]) - w_offs[owner] + offs[owner]
    least = np.array([d for _, d in seen.values()], "i8")
    sa, group = deep_shallow(buf, starts)
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.empty(len(starts), "i8")
    first[sa] = np.repeat(np.minimum.reduceat(least[owner[sa]], head), np.diff(np.append(head, len(group))))
    return first, w_offs, np.minimum.reduceat(first, w_offs[:-1])


def resolve(bucket: int, rows: list[dict]):
    """For each message the contexts of which some window is held by a smaller document than any of its block.

    Contexts that share a window share its anchor, and so are in one share of the bucket; shares are sorted in turn.
    """
    seen: list[dict[bytes, list]] = [{} for _ in range(SHARES)]
    parts = []
    for r in rows:
        raw = C.unpack(r["payload"])
        n = int(np.frombuffer(raw[:8], "i8")[0])
        ids, size, share = np.frombuffer(raw[8 : 8 + 8 * n], "i8"), np.frombuffer(raw[8 + 8 * n : 8 + 9 * n], "u1"), np.frombuffer(raw[8 + 9 * n : 8 + 10 * n], "u1")
        at, own = 8 + 10 * n, []
        for d, s, g in zip(ids.tolist(), size.tolist(), share.tolist(), strict=True):
            x = seen[g].setdefault(raw[at : at + s], [len(seen[g]), d])
            own.append(x[0])
            if d < x[1]:
                x[1] = d
            at += s
        parts.append((r["block"], ids, share, np.array(own, "i4")))
        r["payload"] = None
    found: list[list] = [[] for _ in parts]
    for g in range(SHARES):
        if not seen[g]:
            continue
        first, w_offs, lowest = first_holders(seen[g])
        seen[g] = {}
        for i, (_, ids, share, own) in enumerate(parts):
            mine = np.flatnonzero(share == g)
            mine = mine[lowest[own[mine]] < ids[mine]]
            found[i].extend((int(j), first[w_offs[o] : w_offs[o + 1]]) for j, o in zip(mine, own[mine], strict=True))
    for (block, *_), got in zip(parts, found, strict=True):
        if got:
            yield C.messages(block, [bucket], [C.pack(np.array([len(got)], "i8").tobytes() + np.array([j for j, _ in got], "i8").tobytes() + np.concatenate([x for _, x in got]).tobytes())])


def covered(row: dict, n: int) -> tuple[C.Block, np.ndarray]:
    """A block and which of its bytes go."""
    b = C.Block(row)
    (doc, first, end, bucket, index), seen = contexts(b, row["shared"], n)
    size = len(b.buf)
    delta = np.zeros(size + WINDOW + 1, "i4")
    if len(doc):
        told = {}
        for r in row["replies"] or ():
            raw = C.unpack(r["payload"])
            k = int(np.frombuffer(raw[:8], "i8")[0])
            own, body, at = list(seen[r["bucket"]]), np.frombuffer(raw[8 + 8 * k :], "i8"), 0
            for i in np.frombuffer(raw[8 : 8 + 8 * k], "i8").tolist():
                m = len(own[i]) - WINDOW + 1
                told[r["bucket"], i] = body[at : at + m]
                at += m
        least = {k: np.array([d for _, d, _ in x.values()], "i8") for k, x in seen.items()}
        start = np.zeros(size, bool)
        for d, lo, hi, k, i in zip(b.ids[doc].tolist(), first.tolist(), end.tolist(), bucket.tolist(), index.tolist(), strict=True):
            got = told.get((k, i))
            if got is not None:
                start[lo:hi] = got < d
            elif least[k][i] < d:
                start[lo:hi] = True
        delta[:size] += start
        delta[WINDOW : WINDOW + size] -= start
    return b, np.cumsum(delta[:size]) > 0


def cut(n: int, keep: list[str], schema: pa.Schema):
    def one(row):
        b, gone = covered(row, n)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = b.offs[:-1][b.offs[:-1] < len(gone)]
        edge[inner] = gone[inner]
        raw, kept, removed, spans, runs = b.buf, [], [], [], []
        for lo, hi in zip(b.offs[:-1].tolist(), b.offs[1:].tolist(), strict=True):
            g = gone[lo:hi]
            kept.append(raw[lo:hi][~g].tobytes())
            removed.append(int(g.sum()))
            up = np.flatnonzero(edge[lo:hi])
            spans.append(len(up))
            ends = np.flatnonzero(g & ~np.append(g[1:], False)) + 1
            runs.append([{"start": s, "end": e} for s, e in zip(up.tolist(), ends.tolist(), strict=True)])
        cols = {
            "doc_id": [None if i == C.NO_ID else i for i in b.ids.tolist()], "n_bytes": np.diff(b.offs).tolist(), "n_removed": removed, "n_spans": spans,
            "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept_text": [x.decode("utf-8", "ignore") for x in kept], "spans": runs,
        }
        arrays = [pa.array(cols[f.name], f.type) if f.name in cols else None for f in schema]
        if keep:
            rest = b.extra()
            for i, c in enumerate(keep):
                arrays[len(cols) + i] = rest.column(i).combine_chunks()
        yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return C.by_row(one)


def dedup(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (a character cut through is dropped
    from it, never from the digest), spans (byte runs removed), and the columns named in keep, prefixed by keep_."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    spark, keep = docs.sparkSession, list(keep)
    n = C.partitions(spark)
    blocks = C.blocks_of(docs, keep)
    shared = C.materialize(C.dealt(blocks.mapInArrow(send_anchors(n), C.MESSAGE), n).mapInArrow(C.by_bucket(find_shared), C.MESSAGE))
    asked = C.with_replies(blocks, shared)
    sent = C.dealt(asked.mapInArrow(send_contexts(n), C.MESSAGE), n)
    found = sent.mapInArrow(C.by_bucket(resolve), C.MESSAGE)
    out = _parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>")
    out = StructType(out.fields + [StructField(f"keep_{c}", docs.schema[c].dataType) for c in keep])
    whole = C.with_replies(asked.withColumnRenamed("replies", "shared"), found)
    return whole.mapInArrow(cut(n, keep, to_arrow_schema(out)), out)


def op1(spark, sf_dir: str) -> DataFrame:
    return dedup(C.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with the repeated bytes taken out; every document stays, if with an empty text."""
    rest = C.without(docs.schema, "doc_id", "text")
    done = dedup(docs, rest)
    cols = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col(f"`keep_{c}`") for c in rest}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[cols[c].alias(c) for c in docs.columns])
