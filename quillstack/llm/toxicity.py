"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a fixed lexicon and of a lexicon of word stems learned from the labels, proximity of
lexicon words to a second person, capitals, punctuation and obfuscation rates. Trees are fitted with numpy on
histograms, the scores are then calibrated by pooling adjacent violators on labelled rows that the trees haven't seen.

The fit uses a bounded sample of labelled rows: the ``sample`` (default 20,000) whose ids hash lowest, one for each
distinct text. Scoring is one pass over all rows without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm.common import extended, lowest, materialize, slices

SAMPLE = 20_000
#: Stems in the learned lexicon at most, and documents that must hold one.
STEMS, LEAST = 4000, 6
STEM_SIZES = (3, 4, 5, 6, 7, 8, 9, 10)

#: Common insults.
INSULTS = frozenset(
    b"idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool fools imbecile jerk creep pig pigs filth vermin hate kill shut ugly freak bastard coward liar".split()
)
#: Second-person words of the four languages.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi vous votre vos ton ta tes usted tú ti tus vosotros".encode().split())
#: Characters that stand for letters.
FOLD = bytes.maketrans(b"013457@$!|", b"oieastasii")

EDGES = b".,;:!?\"'()[]{}<>#$%&*|-_~`/\\"
_RUN = re.compile(rb"([!?.*#$%&@])\1")
_MIXED = re.compile(rb"[a-z][0-9@$!*|][a-z]")
_SPACED = re.compile(rb"(?:\b[a-z][ .\-_*]){3,}[a-z]\b")
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
UPPER = bytes(range(65, 91))

NAMES = (
    "log_words", "insults", "insults_density", "folded", "stem_sum", "stem_top", "stem_hits", "stem_density",
    "near_second", "second_density", "upper_rate", "upper_words", "punctuation_rate", "runs_rate", "exclaim_rate", "mixed_rate", "spaced", "non_ascii_rate",
)


def tokens(text: bytes) -> list[bytes]:
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


def stems(word: bytes) -> list[bytes]:
    """What the learned lexicon knows of a word: its proper beginnings and itself, told apart by their first byte."""
    text = word.decode(errors="replace")
    return [b"=" + word, *(b"^" + text[:n].encode() for n in STEM_SIZES if len(text) > n)]


class Features:
    """Dense features of texts, given the learned lexicon (stem to weight)."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon, self.known = lexicon, {}

    def weight(self, word: bytes) -> float:
        """The highest weight of the word's stems, 0 if none has any."""
        if len(self.known) > 300_000:
            self.known.clear()
        get = self.lexicon.get
        w = self.known[word] = max((get(s, 0.0) for s in stems(word)), default=0.0)
        return w

    def of(self, text: bytes) -> list[float]:
        """Linear in the text's length; an empty text has zeros."""
        words = tokens(text)
        n, size = max(len(words), 1), max(len(text), 1)
        known, weight = self.known, self.weight
        weights = np.array([known[w] if w in known else weight(w) for w in words], np.float64)
        insult = np.array([w in INSULTS for w in words], bool)
        hit = np.flatnonzero((weights > 0) | insult)
        second = np.array([i for i, w in enumerate(words) if w in SECOND])
        near = 0
        if len(hit) and len(second):
            at = np.searchsorted(second, hit)
            near = int((np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hit), np.abs(second[np.maximum(at - 1, 0)] - hit)) <= 5).sum())
        lower = text.lower()
        mixed = _MIXED.findall(lower)
        folded = sum(w.translate(FOLD) in INSULTS for w in words if not w.isalpha()) if mixed else 0
        raw = text.split()
        return [
            np.log1p(len(words)), float(insult.sum()), insult.sum() / n, float(folded), float(weights.sum()), float(weights.max(initial=0)), float((weights > 0).sum()), float((weights > 0).sum()) / n,
            float(near), len(second) / n, (len(text) - len(text.translate(None, UPPER))) / size, sum(w.isupper() and len(w) > 2 for w in raw) / max(len(raw), 1),
            (len(text) - len(text.translate(None, PUNCTUATION))) / size, len(_RUN.findall(text)) / n, text.count(b"!") / n, len(mixed) / n, float(len(_SPACED.findall(lower))), (len(text) - len(text.decode(errors="replace"))) / size,
        ]


def learn_lexicon(counts: list[tuple[bytes, int, int]], positives: int, negatives: int) -> dict[bytes, float]:
    """Stems with smoothed log odds over log 8, from (stem, toxic documents, clean documents)."""
    base = np.log((positives + 1) / (negatives + 1))
    out = {s: float(np.log((a + 0.5) / (b + 0.5)) - base) for s, a, b in counts}
    return {s: w for s, w in out.items() if w > np.log(8)}


class Trees:
    """Gradient-boosted trees of logistic loss on quantile histograms."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 5.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T)], 1)
        self.base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        margin, self.trees = np.full(len(y), self.base), []
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2 * inner + 1)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                gain = np.full(width, 1e-9)
                g_all, h_all = (np.bincount(node - first, w, width) for w in (grad, hess))
                split = np.full(width, -1)
                for f in range(x.shape[1]):
                    b = len(cuts[f]) + 1
                    key = (node - first) * b + binned[:, f]
                    g, h = (np.cumsum(np.bincount(key, w, width * b).reshape(width, b), 1)[:, :-1] for w in (grad, hess))
                    if not g.shape[1]:
                        continue
                    rest_g, rest_h = g_all[:, None] - g, h_all[:, None] - h
                    got = g**2 / (h + self.ridge) + rest_g**2 / (rest_h + self.ridge) - (g_all**2 / (h_all + self.ridge))[:, None]
                    got[(h < self.least / 10) | (rest_h < self.least / 10)] = 0
                    at = got.argmax(1)
                    top = got[np.arange(width), at]
                    better = top > gain
                    gain[better], feature[first : first + width][better], split[better] = top[better], f, at[better]
                for k in range(width):
                    if split[k] >= 0:
                        cut[first + k] = cuts[feature[first + k]][split[k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            g, h = (np.bincount(node, w, 2 * inner + 1) for w in (grad, hess))
            value = self.rate * g / (h + self.ridge)
            margin = margin + value[node]
            self.trees.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (margin, chance) of the increasing step function that fits best, smoothed by one half label each way."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, lowest and highest margin
    for m, t in zip(margin[order], y[order]):
        blocks.append([float(t), 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], hi]
    xs = np.array([v for b in blocks for v in (b[2], b[3])] or [0.0])
    ys = np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in (0, 1)] or [0.5])
    return xs, np.maximum.accumulate(ys)


class Model:
    """Lexicon, trees and calibration. With labels of one kind or none, every text scores that share, smoothed."""

    def __init__(self, lexicon: dict[bytes, float], x: np.ndarray, y: np.ndarray):
        self.lexicon = lexicon
        held = np.arange(len(y)) % 4 == 3
        if len(set(y[~held].tolist())) == 2:
            self.trees = Trees().fit(x[~held], y[~held])
            self.points = isotonic(self.trees.margin(x[held]), y[held])
        else:
            self.trees, self.points = None, float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.0

    def scores(self, features: Features, texts: list[bytes]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.points)
        x = np.array([features.of(t) for t in texts]).reshape(len(texts), len(NAMES))
        return np.interp(self.trees.margin(x), *self.points)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", allowed: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model of the labelled rows for which ``allowed`` (a condition on ``key``) holds.

    Null labels, keys and texts are left out; a key with several labels has their majority (a tie counts as 1), one on
    several rows the text that hashes lowest; equal texts teach once, with their smallest key. No more than ``sample``
    rows come to the driver, as features. Empty tables fit a model that scores every text 0. Other columns aren't read."""
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"))
    if allowed is not None:
        votes = votes.withColumnRenamed("_key", key).where(allowed).withColumnRenamed(key, "_key")
    votes = votes.groupBy("_key").agg((F.avg("_label") >= 0.5).cast("int").alias("_label"))
    votes = materialize(lowest(materialize(votes), F.col("_key"), sample))
    chosen = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(votes), "_key")
    # One row a key, so that no more than ``sample`` are left, then one a text.
    chosen = chosen.withColumn("_hash", F.xxhash64("text")).groupBy("_key").agg(F.min("_label").alias("_label"), F.min("_hash").alias("_hash"), F.min_by("text", "_hash").alias("text"))
    chosen = materialize(chosen)
    kept = chosen.groupBy("_hash").agg(F.min("_key").alias("_key")).select("_key")
    chosen = materialize(chosen.join(F.broadcast(kept), "_key"))

    # One half of the sample teaches the lexicon, the other the trees, which so see the lexicon as new texts do.
    half = F.pmod(F.xxhash64("_key", F.lit("half")), F.lit(2))
    teach, grow = chosen.where(half == 0), chosen.where(half == 1)

    def count(batches):
        toxic, clean = Counter(), Counter()

        def out():
            names = list(toxic.keys() | clean.keys())
            part = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([toxic[s] for s in names], pa.int64()), pa.array([clean[s] for s in names], pa.int64())], names=["stem", "a", "b"])
            toxic.clear()
            clean.clear()
            return part

        for batch, texts in slices(batches):
            for t, y in zip(texts, batch.column("_label").to_pylist()):
                (toxic if y else clean).update({s for w in set(tokens(t)) for s in stems(w)})
                if len(toxic) + len(clean) > 200_000:
                    yield out()
        yield out()

    sides = {r["_label"]: r["n"] for r in teach.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    counted = teach.select("_label", "text").mapInArrow(count, "stem binary, a bigint, b bigint").groupBy("stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    top = counted.where(F.col("a") >= LEAST).orderBy((F.col("a") / (F.col("b") + 0.5)).desc(), F.col("a").desc(), "stem").limit(STEMS).collect()
    lexicon = learn_lexicon([(bytes(r["stem"]), r["a"], r["b"]) for r in top], sides.get(1, 0), sides.get(0, 0))

    def features(batches):
        make = Features(lexicon)
        for batch, texts in slices(batches):
            x = np.array([make.of(t) for t in texts]).reshape(-1)
            yield pa.RecordBatch.from_arrays([batch.column("_key").cast(pa.string()), batch.column("_label"), pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(NAMES), pa.int32()), pa.array(x))], names=["k", "y", "x"])

    rows = sorted((r["k"], r["y"], r["x"]) for r in grow.select("_key", "_label", "text").mapInArrow(features, "k string, y int, x array<double>").collect())
    return Model(lexicon, np.array([r[2] for r in rows]).reshape(len(rows), len(NAMES)), np.array([r[1] for r in rows], np.float64))


def score(documents: DataFrame, model: Model, text: str = "text", keep: float | None = None) -> DataFrame:
    """``documents`` with the column ``score`` (0 to 1) appended, or with ``keep`` the rows that score below it, their
    columns as they were. One pass, no shuffle. Null texts count as empty; repeated rows score alike; very long texts are
    read whole; a former column ``score`` is replaced (with ``keep``, kept); an empty table gives an empty one."""
    if keep is None:
        documents = documents.drop("score")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        features = Features(shared.value.lexicon)
        for batch, texts in slices(batches, text):
            s = shared.value.scores(features, texts)
            yield batch.append_column("score", pa.array(s)) if keep is None else batch.filter(pa.array(s < keep))

    schema = documents.schema if keep is not None else extended(documents, "score", T.DoubleType())
    return documents.mapInArrow(run, schema)
