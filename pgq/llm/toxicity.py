"""Toxicity by weak supervision.

Voters look at a document and fire or say nothing: lists of insults in four languages, lists mined from labelled training
rows, and patterns.  A generative label model is fitted by EM to how often every combination of votes, with the training
label or without one, occurs over all documents.  Given the class, a voter depends on one other voter at most: the tree of
these links is the one that explains most (Chow-Liu), so what repeats another voter adds little to the likelihood.  A
training label is evidence of the same kind, right as often as the model finds.  A linear classifier over words and stems is
then trained on the posteriors of documents with and without labels, and a line through the logits of training rows that a
fit on the other half has not seen places 0.5 midway between the classes (both weigh the same there).

Insults come with many endings.  A feature is a word, or a stem of `STEMS` letters that two (`x*`) or three (`x**`) tokens
of the document continue.  What features and mined voters say must hold in both
halves of the training rows.

Bounds, all parameters: the fit takes `SAMPLE` documents with and as many without a label (the smallest by a hash of
their id); the classifier has the `WORDS` features that tell most; `SINGLES` mined families vote alone and up to `MINED`
share one voter more; a feature counts if `SUPPORT` training rows have it.  Counts of features, votes and labels are of all
documents.  Whole texts are read, however long; a task keeps no more than `MEMO` words in memory.

Inputs of a score are words alone: never labels, lang, source or doc_id.

Defined results: null and empty texts get the score of a text without words; repeated rows are scored each; a row without
doc_id is never held out and never learned from; without usable labels the mined lists are empty, the prior is `PRIOR` and
nothing is calibrated; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

SAMPLE, SUPPORT, MINED, WORDS, PRIOR, SINGLES, MEMO = 20_000, 4, 64, 2000, 0.1, 6, 300_000
STEMS = range(3, 9)
SMALL_LABELS = 500_000  # labels of 12 bytes that are broadcast to the documents; more are joined by id
LISTS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless clown disgusting filthy vermin hate kill jerk fool imbecile garbage freak ugly creep bastard bitch shit fuck fucking asshole crap bullshit",
    "de": "idiot idioten dumm dummkopf trottel depp arschloch scheiße scheisse abschaum versager hure wichser müll ekelhaft hass blödmann",
    "fr": "idiot idiote imbécile crétin connard connasse salaud merde ordure stupide nul abruti débile minable haine dégoûtant",
    "es": "idiota imbécil estúpido estúpida tonto basura mierda cabrón puta asqueroso inútil patético odio escoria payaso",
}
_WORD = re.compile(r"[^\W\d_]+")
_LISTED = frozenset(w for x in LISTS.values() for w in x.split())
_YOU = re.compile(r"\b(?:you|your|du|ihr|tu|vous|eres|sois)\b[^.!?]{0,40}\b(?:are|bist|seid|es|êtes)?\s*(?:" + "|".join(sorted(_LISTED)) + r")\b")
NAMES = [*LISTS, *(f"family{i}" for i in range(SINGLES)), "families", "you", "shouting"]  # 2 ^ 13 patterns of votes at most


def words_of(text: str) -> set[str]:
    """All features of a text: its distinct words, and the stems that two (*) or three (**) of its tokens continue."""
    tokens = Counter(_WORD.findall(text.lower()))
    stems: Counter = Counter()
    for w, n in tokens.items():
        for k in STEMS:
            if len(w) <= k:
                break
            stems[w[:k]] += n
    return tokens.keys() | {s + "*" for s, n in stems.items() if n > 1} | {s + "**" for s, n in stems.items() if n > 2}


def families(found: list[str]) -> list[str]:
    """Of words and stems, best first, those that neither begin nor continue a better one."""
    kept: list[str] = []
    for w in found:
        stem = w.rstrip("*")
        if not any(stem.startswith(k.rstrip("*")) or k.rstrip("*").startswith(stem) for k in kept):
            kept.append(w)
    return kept


def votes_of(text: str, hits: set[str], lists: list[frozenset]) -> tuple[int, ...]:
    """One vote (1 or 0) of each voter; hits: features of the text that are in a list or in the vocabulary."""
    listed = [0 if hits.isdisjoint(x) else 1 for x in lists]
    said = any(listed)
    you = 1 if said and _YOU.search(text.lower()) else 0
    shout = 1 if said and text.count("!") * 40 > len(text) else 0
    return (*listed, you, shout)


class LabelModel:
    """P(votes | class) as a tree over the voters, how often a label is right, and the prior.

    Rows with labels anchor the classes.  Without any, voters that repeat each other can pass for the truth.
    """

    RIGHT, STRENGTH = 0.98, 50.0  # a label is right so often, as sure as so many rows

    def fit(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 30) -> LabelModel:
        """votes: patterns x voters in {-1, 0, 1}; counts: of rows without a label; known: patterns x 2 counts of training
        rows by label."""
        kinds = self._kinds(votes)
        n = np.stack([counts, known[:, 0], known[:, 1]], 1).astype("f8")
        self.prior = float(np.clip((known[:, 1].sum() + PRIOR * 10) / (known.sum() + 10), 1e-4, 0.9))
        self.right = np.full(2, self.RIGHT)
        fires, silent = (votes > 0).any(1), (votes < 0).any(1)
        start = np.where(fires, 0.8, np.where(silent, 0.02, self.prior))
        post = np.stack([start, np.full(len(votes), 1 - self.RIGHT), np.full(len(votes), self.RIGHT)], 1)
        if known.sum():  # the first tables are those of labelled rows alone
            self._m_step(kinds, n * [0, 1, 1], post)
            post = self._posterior(kinds)
        for _ in range(rounds):
            self._m_step(kinds, n, post)
            post = self._posterior(kinds)
        return self

    @staticmethod
    def _kinds(votes: np.ndarray) -> np.ndarray:
        return np.stack([votes == v for v in (-1, 0, 1)], 2).astype("f8")

    def _m_step(self, kinds: np.ndarray, n: np.ndarray, post: np.ndarray) -> None:
        toxic, clean = (n * post).sum(1), (n * (1 - post)).sum(1)
        self.prior = float(np.clip((toxic.sum() + PRIOR) / (toxic.sum() + clean.sum() + 1), 1e-4, 0.9))
        own = [(n[:, 1] * (1 - post[:, 1])).sum(), (n[:, 2] * post[:, 2]).sum()]
        other = [(n[:, 2] * (1 - post[:, 2])).sum(), (n[:, 1] * post[:, 1]).sum()]
        self.right = np.array([(a + self.RIGHT * self.STRENGTH) / (a + b + self.STRENGTH) for a, b in zip(own, other, strict=True)])
        both = np.stack([np.einsum("p,pia,pjb->ijab", w, kinds, kinds, optimize=True) for w in (clean, toxic)])
        self._tree(both, np.array([clean.sum(), toxic.sum()]))

    def _tree(self, both: np.ndarray, size: np.ndarray) -> None:
        """Links of the voters and the tables P(vote | vote of the parent, class); both: class x voter x voter x vote x
        vote."""
        v = both.shape[1]
        alone = np.einsum("yiiaa->yia", both)
        alone = (alone + 0.5) / (size[:, None, None] + 1.5)
        joint = (both + 0.05) / (size[:, None, None, None, None] + 0.45)
        ratio = joint / np.maximum(joint.sum(4, keepdims=True) * joint.sum(3, keepdims=True), 1e-12)
        shared = np.einsum("y,yijab->ij", size / max(size.sum(), 1e-9), joint * np.log(np.maximum(ratio, 1e-12)))
        np.fill_diagonal(shared, -1)
        told = -(alone * np.log(alone)).sum(2)
        told = (told * (size / max(size.sum(), 1e-9))[:, None]).sum(0)
        #: What each voter says beyond the one it repeats most: 1 if it goes its own way, 0 if it says nothing new.
        self.weight = 1 - np.clip(shared.max(1) / np.maximum(told, 1e-9), 0, 1) if v > 1 else np.ones(v)
        parent, best, link = np.full(v, -1), shared[0].copy(), np.zeros(v, "i8")
        inside = np.zeros(v, bool)
        inside[0] = True
        self.order = [0]
        for _ in range(v - 1):
            i = int(np.where(inside, -2, best).argmax())
            if best[i] > 1e-4:  # nats; less is noise, and the voter stands alone
                parent[i] = link[i]
            inside[i] = True
            self.order.append(i)
            nearer = shared[i] > best
            best, link = np.where(nearer, shared[i], best), np.where(nearer, i, link)
        self.parent = parent
        #: voter -> class x vote of the parent (one, if none) x vote
        self.table = [(both[:, p, i] + 4 * alone[:, None, i]) / (both[:, p, i].sum(2, keepdims=True) + 4) if (p := parent[i]) >= 0 else alone[:, None, i] for i in range(v)]

    def _logit(self, kinds: np.ndarray) -> np.ndarray:
        z = np.full(len(kinds), np.log(self.prior / (1 - self.prior)))
        for i, t in enumerate(self.table):
            gain = np.log(t[1]) - np.log(t[0])
            z += np.einsum("pa,pb,ab->p", kinds[:, self.parent[i]], kinds[:, i], gain) if self.parent[i] >= 0 else kinds[:, i] @ gain[0]
        return z

    def _posterior(self, kinds: np.ndarray) -> np.ndarray:
        """P(class 1) by pattern, for rows without a label and with label 0 and 1."""
        r0, r1 = self.right
        z = self._logit(kinds)[:, None] + [0, np.log((1 - r1) / r0), np.log(r1 / (1 - r0))]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """P(class 1) of rows; labels: 0, 1, or -1 for none."""
        p = self._posterior(self._kinds(votes))
        return p[np.arange(len(votes)), (labels if labels is not None else np.full(len(votes), -1)) + 1]


def logistic(x: list[np.ndarray], y: np.ndarray, n: int, rounds: int = 300, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias over binary features given as index lists; y may be fractions."""
    flat = np.concatenate(x) if x else np.zeros(0, "i8")
    row = np.repeat(np.arange(len(x)), [len(a) for a in x])
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[flat], len(x)) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.append(np.bincount(flat, g[row], n) + l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def training_labels(labels: DataFrame, column: str, mod: int, rest: int) -> DataFrame:
    """doc_id, y of all training labels.  An id with two labels has the larger."""
    train = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~C.held_out(F.col("doc_id"), mod, rest))
    return train.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y"))


def bounded_labels(labels: DataFrame, column: str, mod: int, rest: int, bound: int) -> dict[int, int]:
    """At most `bound` training labels by doc_id, the smallest by a hash of it."""
    rows = C.hash_sample(training_labels(labels, column, mod, rest), bound, "doc_id").collect()
    return {r["doc_id"]: int(r["y"]) for r in rows}


def with_labels(texts: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Rows of texts that have one of the n labels; few labels are broadcast, more are joined by id."""
    return texts.join(F.broadcast(labels) if n <= SMALL_LABELS else labels, "doc_id")


def _count_words(batches):
    """In how many rows of each label and half (clean, clean, toxic, toxic) every feature occurs."""
    counts: dict[str, list[int]] = {}

    def out():
        words = list(counts)
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            yield pa.RecordBatch.from_pydict({"word": pa.array(part, pa.string()), "n": pa.array([counts[w] for w in part], pa.list_(pa.int64()))})
        counts.clear()

    for b in batches:
        for y, half, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            for w in words_of(t or ""):
                if (n := counts.get(w)) is None:
                    n = counts[w] = [0, 0, 0, 0]
                n[2 * y + half] += 1
            if len(counts) > 2 * MEMO:
                yield from out()
    yield from out()


class _Known(dict):
    """For each word, whether it is looked for itself, and the stems looked for that it continues."""

    def __init__(self, wanted: set[str]):
        super().__init__()
        self.words, self.stems = {w for w in wanted if "*" not in w}, {w.rstrip("*") for w in wanted if "*" in w}

    def __missing__(self, w: str) -> tuple:
        if len(self) >= MEMO:
            self.clear()
        got = self[w] = (w in self.words, tuple(w[:k] for k in STEMS if len(w) > k and w[:k] in self.stems))
        return got


_PLAIN = (False, ())


class Scorer:
    """What a task needs to score texts."""

    def __init__(self, lists: list[frozenset], words: dict[str, int]):
        self.lists, self.words, self.w, self.b, self.known = lists, words, None, 0.0, None

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def hits(self, text: str) -> set[str]:
        """Those features of a text that a list or the vocabulary names; words_of() has them all."""
        if self.known is None:
            self.known = _Known(set(self.words).union(*self.lists))
        found, stems, known = set(), {}, self.known
        for w, n in Counter(_WORD.findall(text.lower())).items():
            got = known[w]
            if got == _PLAIN:
                continue
            if got[0]:
                found.add(w)
            for s in got[1]:
                stems[s] = stems.get(s, 0) + n
        return found | {s + "*" for s, n in stems.items() if n > 1} | {s + "**" for s, n in stems.items() if n > 2}

    def features(self, text: str | None) -> tuple[tuple[int, ...], list[int]]:
        t = text or ""
        hits = self.hits(t)
        votes = votes_of(t, hits, self.lists)
        return votes, sorted(self.words[w] for w in hits if w in self.words) + [len(self.words) + i for i, v in enumerate(votes) if v]

    @property
    def size(self) -> int:
        return len(self.words) + len(NAMES)

    def score(self, text: str | None) -> float:
        _, x = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(self.w[x].sum() + self.b, -30, 30))))


def _features(scorer: Scorer):
    """Each row's votes (a byte each) and features."""

    def run(batches):
        for b in batches:
            votes, xs = [], []
            for t in b.column(1).to_pylist():
                v, x = scorer.features(t)
                votes.append(bytes(v))
                xs.append(x)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "votes": pa.array(votes, pa.binary()), "x": pa.array(xs, pa.list_(pa.int32()))})

    return run


def calibration(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of a logistic line through logits of rows with labels, either class weighing as much (Platt)."""
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    want = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        g, h = weight * (p - want), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * logit).sum() + 1e-4 * (a - 1), g.sum()])
        hess = np.array([[(h * logit**2).sum() + 1e-4, (h * logit).sum()], [(h * logit).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


def fit(x: list[np.ndarray], post: np.ndarray, labels: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias, calibrated on rows with labels (others have -1), each half by a fit on the other."""
    w, b = logistic(x, post, size)
    logits, truth = [], []
    for half in (0, 1):
        seen, left = [i for i in range(len(x)) if i % 2 != half], [i for i in range(len(x)) if i % 2 == half and labels[i] >= 0]
        if seen and left:
            v, c = logistic([x[i] for i in seen], post[seen], size)
            logits += [v[x[i]].sum() + c for i in left]
            truth += labels[left].tolist()
    slope, offset = calibration(np.array(logits), np.array(truth)) if logits else (1.0, 0.0)
    return slope * w, slope * b + offset


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Scorer:
    C.prepare(docs.sparkSession)
    every = C.materialize(training_labels(labels, "toxic", 5, 0))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    rows = {(r["y"], r["half"]): r["n"] for r in every.groupBy("y", half.alias("half")).agg(F.count("*").alias("n")).collect()}
    n_labels, mined, words = sum(rows.values()), [], {}
    if n_labels:
        counted = with_labels(texts, every, n_labels).select("y", half, "text").mapInArrow(_count_words, "word string, n array<long>")
        counted = C.materialize(counted.groupBy("word").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(4)]).where(f"n0 + n1 + n2 + n3 >= {SUPPORT}"))
        total = [max(1, rows.get((i // 2, i % 2), 0)) for i in range(4)]
        neg, pos = total[0] + total[1], total[2] + total[3]
        a, b = (F.expr("n2 + n3") + 0.1) / pos, (F.expr("n0 + n1") + 0.1) / neg
        told = counted.withColumn("odds", F.log(a / b)).withColumn("gain", F.abs(a - b) / F.sqrt((a + b) / 2))
        halves = [F.log((F.col(f"n{2 + h}") + 0.1) / total[2 + h] * total[h] / (F.col(f"n{h}") + 0.1)) for h in (0, 1)]
        top = told.where((F.col("odds") > 1.5) & (F.least(*halves) > 1)).orderBy(F.desc("gain"), F.desc(F.length("word")), "word").limit(8 * MINED).collect()
        above = lambda r: (r["n2"] + r["n3"] - (by_chance := (r["n0"] + r["n1"]) * pos / neg)) > 3 * np.sqrt(by_chance + 1)
        mined = [w for w in families([r["word"] for r in top if above(r)]) if w not in _LISTED][: SINGLES + MINED]
        words = {r["word"]: i for i, r in enumerate(told.where((F.least(*halves) > 0.5) | (F.greatest(*halves) < -0.5)).orderBy(F.desc("gain"), "word").limit(WORDS).collect())}
    lists = [frozenset(x.split()) for x in LISTS.values()] + [frozenset(mined[i : i + 1]) for i in range(SINGLES)] + [frozenset(mined[SINGLES:])]
    scorer = Scorer(lists, words)
    seen = C.materialize(texts.mapInArrow(_features(scorer), "doc_id long, votes binary, x array<int>"))
    judged = C.materialize(seen.where("doc_id is not null").join(every, "doc_id", "left").select("doc_id", "votes", "x", F.coalesce("y", F.lit(-1)).alias("y")))
    gold = {(tuple(r["votes"]), r["y"]): r["n"] for r in judged.groupBy("votes", "y").agg(F.count("*").alias("n")).collect()}  # 3 x 2 ^ voters at most
    votes = sorted({v for v, _ in gold})
    scorer.w = np.zeros(scorer.size)
    if not votes:
        scorer.b = float(np.log(PRIOR / (1 - PRIOR)))
        return scorer
    n = np.array([[gold.get((v, y), 0) for y in (-1, 0, 1)] for v in votes], "f8")
    model = LabelModel().fit(np.array(votes), n[:, 0], n[:, 1:])
    rows = [r for y in ("y >= 0", "y < 0") for r in C.hash_sample(judged.where(y), bound, "doc_id", "votes", "x", "y").collect()]
    y = np.array([r["y"] for r in rows])
    post = model.posterior(np.array([tuple(r["votes"]) for r in rows]), y)
    scorer.w, scorer.b = fit([np.array(r["x"], "i8") for r in rows], post, y, scorer.size)
    return scorer


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with a last column toxicity_score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    name = "toxicity_score"
    while name in docs.columns:
        name += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    names, at = to_arrow_schema(schema).names, docs.columns.index("text")

    def run(batches):
        for b in batches:
            s = [scorer.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=names)

    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])  # mapInArrow can't take every name
    return plain.mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = train(docs, C.table(spark, sf_dir, "labels"))
    return scored(docs, scorer).select("doc_id", C.held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("toxicity_score").alias("score"), F.when(F.col("toxicity_score") >= 0.5, 1).otherwise(0).alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of 0.5 or more go."""
    done = scored(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return done.where(F.col(done.columns[-1]) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
