"""Quality by importance resampling of hashed n-grams.

Two generative models of hashed n-grams (tokens and pairs of tokens): the target, from labelled rows of good quality,
and the raw one, from every document. A document's log importance weight is the sum of log(target / raw) over its
n-grams. Sampling k documents without replacement in proportion to the weights is a top-k of weight plus Gumbel noise;
the noise is a function of the key, so a run repeated after a lost executor samples the same.

k is the number of documents whose weight reaches the cut that best separates the labelled rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.llm.common import extended, free_names, lowest, materialize, slices

BUCKETS = 1 << 14
#: Labelled rows that the target model and the cut are fitted on at most.
SAMPLE = 20_000
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


class Hashed:
    """Bucket counts of texts. Bucket 0 is kept for a token that repeats the one before it."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, text) of every n-gram of every text."""
        known, crc = self.known, zlib.crc32
        if len(known) > 400_000:
            known.clear()
        found, sizes = [], []
        for t in texts:
            w = _TOKEN.findall(t.lower())
            sizes.append(len(w))
            for x in w:
                h = known.get(x)
                if h is None:
                    h = known[x] = crc(x)
                found.append(h)
        h, doc = np.array(found, np.uint64), np.repeat(np.arange(len(texts)), sizes)
        one = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(self.buckets - 1) + np.uint64(1)
        pair = ((h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)) % np.uint64(self.buckets - 1) + np.uint64(1)
        pair[h[:-1] == h[1:]] = 0
        inside = doc[:-1] == doc[1:]
        return np.concatenate((one, pair[inside])).astype(np.int64), np.concatenate((doc, doc[:-1][inside]))


class Model:
    """Log ratio of each bucket. ``cut`` is the weight from which a document counts as sampled."""

    def __init__(self, target: np.ndarray, raw: np.ndarray):
        if target.sum() and raw.sum():
            smooth = lambda c: (c + 0.5) / (c.sum() + 0.5 * len(c))
            self.ratio = np.log(smooth(target)) - np.log(smooth(raw))
        else:
            self.ratio = np.zeros(len(raw))
        self.cut = -np.inf

    def weights(self, hashed: Hashed, texts: list[bytes]) -> np.ndarray:
        grams, doc = hashed.grams(texts)
        return np.bincount(doc, self.ratio[grams], len(texts))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the gap that separates the two kinds best; with one kind missing, everything passes."""
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate((good, bad)))
    edges = np.concatenate(([values[0] - 1], (values[1:] + values[:-1]) / 2))
    kept = 1 - np.searchsorted(np.sort(good), edges) / len(good)
    dropped = np.searchsorted(np.sort(bad), edges) / len(bad)
    return float(edges[int(np.argmax(kept + dropped))])


def gumbel(key: Column) -> Column:
    """Standard Gumbel noise from the key."""
    uniform = (F.pmod(F.xxhash64(key, F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, column: str, k: int, enough: int = 20_000) -> float:
    """The k-th largest value, exactly, by counts in ever narrower bins; no more than ``enough`` values, or those in the
    last bin that can be told apart, come to the driver."""
    if k <= 0:
        return np.inf
    low, high, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return -np.inf if not n else float(low)
    above, bins = 0, 1024
    while n > enough and high > low and (width := (high - low) / bins) > 0 and low + width > low:
        inside = values.where(F.col(column).between(low, high))
        bin_ = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counted = {r["b"]: r for r in inside.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counted, reverse=True):
            if above + counted[b]["n"] >= k:
                low, high, n = counted[b]["lo"], counted[b]["hi"], counted[b]["n"]
                break
            above += counted[b]["n"]
    if high == low:
        return float(high)
    left = values.where(F.col(column).between(low, high)).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc(column)).collect()
    for r in left:
        above += r["n"]
        if above >= k:
            return float(r[column])
    return float(low)


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Models and cut. The raw model counts all documents; the target and the cut use the rows of the labelled keys that
    hash lowest, ``sample`` of them; a key on several rows counts in the cut once, with its lowest weight. A key with
    several labels has their majority (a tie counts as 1); null labels and keys are left out. Without labels of both
    kinds the cut lets everything pass. Null texts are empty; very long ones are read whole; empty tables fit a model of
    no opinion. Other columns aren't read."""
    votes = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
    votes = materialize(lowest(materialize(votes), F.col("_key"), sample))
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(votes), "_key", "left").select("_key", "_label", "text")

    def count(batches):
        hashed, raw, target = Hashed(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch, texts in slices(batches):
            grams, doc = hashed.grams(texts)
            raw += np.bincount(grams, minlength=BUCKETS)
            good = np.array([x == 1 for x in batch.column("_label").to_pylist()], bool)
            target += np.bincount(grams[good[doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], names=["b", "t", "r"])

    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows.select("_label", "text").mapInArrow(count, "b bigint, t bigint, r bigint").groupBy("b").agg(F.sum("t").alias("t"), F.sum("r").alias("r")).collect():
        target[r["b"]], raw[r["b"]] = r["t"], r["r"]
    model = Model(target, raw)
    known = weigh(rows.where("_label IS NOT NULL"), model).groupBy("_key", "_label").agg(F.min("weight").alias("weight")).collect()
    model.cut = best_cut(*(np.array([r["weight"] for r in known if r["_label"] == y]) for y in (1, 0)))
    return model


def weigh(documents: DataFrame, model: Model, text: str = "text", weight: str = "weight") -> DataFrame:
    """``documents`` with their log importance weight (double). Null and empty texts weigh 0; repeated rows weigh alike;
    very long texts are read whole; a former column of the name is replaced; an empty table gives an empty one. No shuffle."""
    documents = documents.drop(weight)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        hashed = Hashed()
        for batch, texts in slices(batches, text):
            yield batch.append_column(weight, pa.array(shared.value.weights(hashed, texts)))

    return documents.mapInArrow(run, extended(documents, weight, T.DoubleType()))


def sampled(documents: DataFrame, model: Model, key: str, text: str) -> tuple[DataFrame, str, Column]:
    """(a table of the documents with their weight, the weight's column name, the condition of being sampled). Names
    that no column has are taken, so columns of any name stay."""
    weight, perturbed = free_names(documents.columns, "weight", "perturbed")
    scored = weigh(documents, model, text, weight)
    scored = materialize(scored.withColumn(perturbed, F.col(weight) + gumbel(F.coalesce(F.col(key).cast("string"), F.lit("")))))
    k = scored.where(F.col(weight) >= float(model.cut)).count()
    return scored, weight, F.col(perturbed) >= F.lit(float(kth_largest(scored, perturbed, k)))


def resample(documents: DataFrame, model: Model, columns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``columns`` of every document with ``weight`` and ``kept``, from a table in the shared folder.

    kept: among the k largest of weight plus noise, where k is the number of weights that reach the model's cut. Rows
    that tie with the k-th (repeated rows) are all kept. Null and empty texts weigh 0; null keys share one noise; an
    empty table gives an empty one. Columns named weight or kept aren't returned under those names."""
    table, weight, kept = sampled(documents.select(*dict.fromkeys([key, text, *columns])), model, key, text)
    return table.select(*(c for c in columns if c not in ("weight", "kept")), F.col(weight).alias("weight"), kept.alias("kept"))


def clean(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled documents, columns of any name as they were; nulls, ties and empty tables as in ``resample``."""
    table, _, kept = sampled(documents, model, key, text)
    return table.where(kept).select(*documents.columns)
