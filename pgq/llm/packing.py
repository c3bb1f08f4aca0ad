"""Best-fit packing by minimum bin slack.

Documents become token ids plus a closing id, cut into pieces of at most `cap` ids.  Only how many pieces have which
length matters for packing, and there are `cap` lengths at most, so the plan is made on the driver from that histogram
whatever the corpus: the longest piece left opens a bin, a subset-sum over bitsets finds the fullest combination of the
lengths available beside it, and that combination is taken out as often as the counts allow.  Pieces then find their
place by their rank among those of equal length; ranks are counted within salted groups first, so a length that a third
of all pieces have is never ranked in one task.

Defined results: null text counts as empty and gives the closing id alone; a very long text is cut into full pieces and one
that may be shorter; repeated rows are packed each; a null doc_id
is kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

CAP, END, NAME = 2048, 0, "word_bpe_49k.json"
_KEPT_WORDS = 250_000  # in each of two generations
_PLAIN = re.compile("[!-;=-~\xa1-ɏ]+")  # '<' may open an added token


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(NAME)


class Ids(dict):
    """Packed little-endian ids of each word between ASCII white space.

    The tokenizer's splits never cross white space, so a text's ids are those of its words in turn.  Words of printable
    Latin letters and signs are split and merged by the tokenizer's own model; any other goes through the whole
    tokenizer.  Words are remembered in two generations of a bounded size: when the young one is full it becomes the old
    one, and words that come again move back, so frequent words stay.
    """

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.plain, self.old, self.old_parts = False, {}, {}
        spec = json.load(open(path, encoding="utf-8"))  # the file of a tokenizer is local to every executor
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and not pre[1]["add_prefix_space"]:
            self.plain, self.find = True, regex.compile(pre[0]["pattern"]["Regex"]).findall
            self.merge, self.parts = self.tokenizer.model.tokenize, {}
            self.letters = "[\\p{L}]+" in pre[0]["pattern"]["Regex"].split("|")  # a word of letters is one part
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            self.chars = {b: chr(b) for b in printable}
            for b in range(256):
                self.chars.setdefault(b, chr(256 + len(self.chars) - len(printable)))

    def part(self, x: str) -> bytes:
        if (got := self.parts.get(x)) is None:
            if (got := self.old_parts.get(x)) is None:
                mapped = x if x.isascii() else "".join(map(self.chars.__getitem__, x.encode()))
                got = np.array([t.id for t in self.merge(mapped)], "<u4").tobytes()
            if len(self.parts) >= _KEPT_WORDS:
                self.old_parts, self.parts = self.parts, {}
            self.parts[x] = got
        return got

    def __missing__(self, word: bytes) -> bytes:
        if (got := self.old.get(word)) is None:
            s = word.decode()
            if self.plain and self.letters and word.isalpha():
                got = self.part(s.lower())
            elif self.plain and _PLAIN.fullmatch(s):
                got = b"".join(map(self.part, self.find(s.lower())))
            else:
                got = np.array(self.tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= _KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


_LOADED: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _LOADED:
        _LOADED[path] = Ids(path)
    return _LOADED[path]


def _pieces(path: str, cap: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, close = ids_of(path), np.array([end], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for d, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    raw = b"".join([known[w] for w in (t or b"").split()]) + close
                    for i, at in enumerate(range(0, len(raw), 4 * cap)):
                        x = raw[at : at + 4 * cap]
                        for k, v in zip(out, (d, i, at // 4, len(x) // 4, zlib.crc32(x), x), strict=True):
                            out[k].append(v)
                kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items() if k != "ids" or with_ids})

    return run


def pieces(docs: DataFrame, path: str, cap: int = CAP, end: int = END, with_ids: bool = False) -> DataFrame:
    C.prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, cap, end, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def fullest(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, times) of a combination with the largest sum up to room."""
    reach, steps, goal = 1, [], 1 << room
    mask = (goal << 1) - 1
    for n in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, part = min(counts[n], room // n), 1
        while left:
            take = min(part, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & mask
            left, part = left - take, part * 2
        if reach & goal:
            break
    at, found = reach.bit_length() - 1, {}
    for n, take, before in reversed(steps):
        if not before >> at & 1:
            found[n] = found.get(n, 0) + take
            at -= n * take
    return sorted(found.items(), reverse=True)


def bins(counts: dict[int, int], cap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how often, [(length, times)]) of each bin pattern, in the order in which they are taken out."""
    counts, out = {n: c for n, c in counts.items() if c}, []
    while counts:
        top = max(counts)
        counts[top] -= 1
        use = dict(fullest(cap - top, counts))
        counts[top] += 1
        use[top] = use.get(top, 0) + 1
        often = min(counts[n] // t for n, t in use.items())
        out.append((often, sorted(use.items(), reverse=True)))
        for n, t in use.items():
            counts[n] -= often * t
            if not counts[n]:
                del counts[n]
    return out


def places(plan: list) -> dict[int, np.ndarray]:
    """By length: rows (first rank, times a bin, first bin, offset), in order of rank."""
    got: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for often, use in plan:
        at = 0
        for n, t in use:
            got.setdefault(n, []).append((used.get(n, 0), t, base, at))
            used[n] = used.get(n, 0) + often * t
            at += n * t
        base += often
    return {n: np.array(x, "i8") for n, x in got.items()}


def _placed(where: dict[int, np.ndarray], names: list[str]):
    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("_rank").to_numpy()
            seq, off = np.empty(len(rank), "i8"), np.empty(len(rank), "i8")
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                w = where[int(n)]
                s = w[np.searchsorted(w[:, 0], rank[rows], "right") - 1]
                x = rank[rows] - s[:, 0]
                seq[rows] = s[:, 2] + x // s[:, 1]
                off[rows] = s[:, 3] + x % s[:, 1] * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, cap: int = CAP, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32 (and ids, as little-endian bytes), sequence_id, offset."""
    cut = C.materialize(pieces(docs, path or default_tokenizer(), cap, end, with_ids))
    spark = docs.sparkSession
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * C.partitions(spark))))
    counts = salted.groupBy("length", "_salt").count()
    where = places(bins({r[0]: r[1] for r in cut.groupBy("length").count().collect()}, cap))  # cap rows at most
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("length", "_salt", before.alias("_base"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("_own", own).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_own"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.select(*cut.columns, "_rank").mapInArrow(_placed(where, cut.columns), schema + ", sequence_id long, offset long")


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(C.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces."""
    return pack(docs)
