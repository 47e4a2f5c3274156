"""Toxicity and quality against plain loops, and on tables with odd rows and clashing names."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstack.llm import quality, toxicity

WORDS = ["you", "idiot", "hello", "Welt", "TRASH!!", "id1ot", "a.b.c.d", "du", "naïve", "s-t-u-p", "$$$", "fine", "clowns", "x", "ok?!"]


def text_of(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def naive_features(lexicon, text):
    data = text.encode()
    words = [w for w in (x.strip(toxicity.EDGES) for x in data.lower().split()) if w]
    n, size = max(len(words), 1), max(len(data), 1)
    weights = [max([lexicon.get(s, 0.0) for s in toxicity.stems(w)] + [0.0]) for w in words]
    insults = [i for i, w in enumerate(words) if w in toxicity.INSULTS]
    second = [i for i, w in enumerate(words) if w in toxicity.SECOND]
    hits = sorted({*insults, *(i for i, w in enumerate(weights) if w > 0)})
    lower, raw = data.lower(), data.split()
    mixed = toxicity._MIXED.findall(lower)
    return [
        math.log1p(len(words)), len(insults), len(insults) / n, sum(w.translate(toxicity.FOLD) in toxicity.INSULTS for w in words if not w.isalpha()) if mixed else 0,
        sum(weights), max(weights, default=0), sum(w > 0 for w in weights), sum(w > 0 for w in weights) / n, sum(any(abs(i - j) <= 5 for j in second) for i in hits), len(second) / n,
        sum(65 <= b <= 90 for b in data) / size, sum(w.isupper() and len(w) > 2 for w in raw) / max(len(raw), 1), sum(b in toxicity.PUNCTUATION for b in data) / size,
        len(toxicity._RUN.findall(data)) / n, data.count(b"!") / n, len(mixed) / n, len(toxicity._SPACED.findall(lower)), (len(data) - len(text)) / size,
    ]


def test_features_equal_plain_loops():
    r = random.Random(1)
    lexicon = {b"=trash": 2.5, b"^wel": 3.0, b"^nai": 1.0}
    made = toxicity.Features(lexicon)
    for text in ["", " \n", "é", *(text_of(r, r.randrange(1, 80)) for _ in range(200))]:
        assert made.of(text.encode()) == pytest.approx(naive_features(lexicon, text))


def test_trees_and_calibration_equal_plain_loops():
    g = np.random.default_rng(3)
    x = np.round(g.standard_normal((400, 4)), 1)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = toxicity.Trees(rounds=5).fit(x, y)

    def walk(row):
        total = trees.base
        for feature, cut, value in trees.trees:
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += value[node]
        return total

    margin = trees.margin(x)
    assert margin == pytest.approx([walk(row) for row in x])
    # The first split is the best of all cuts by plain search.
    grad, hess = y - y.mean(), np.full(len(y), y.mean() * (1 - y.mean()))
    p = (y.sum() + 1) / (len(y) + 2)
    grad, hess = y - p, np.full(len(y), p * (1 - p))

    def gain(f, c):
        left = x[:, f] <= c
        part = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + trees.ridge) if hess[m].sum() >= trees.least / 10 else -np.inf
        return part(left) + part(~left)

    cuts = [(f, c) for f in range(4) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, trees.bins + 1)[1:-1]))]
    assert gain(trees.trees[0][0][0], trees.trees[0][1][0]) == pytest.approx(max(gain(f, c) for f, c in cuts))
    # Isotonic regression: the greatest, over starts, of the least, over ends, of means.
    m, t = margin[:60], y[:60]
    order = np.argsort(m, kind="stable")
    m, t = m[order], t[order]
    xs, ys = toxicity.isotonic(m, t)
    want = [max(min(t[a : b + 1].mean() for b in range(i, len(t))) for a in range(i + 1)) for i in range(len(t))]
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all()
    steps = np.flatnonzero(np.diff(want) > 1e-12)
    assert len(xs) == 2 * (len(steps) + 1) and xs[1:-1:2] == pytest.approx(m[steps])


def test_scores_equal_the_model_row_by_row(spark):
    r = random.Random(4)
    rows = [(i, text_of(r, r.randrange(5, 60)) + (" grumbling" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    odd = [(7, rows[7][1], 1), (7, "other text", 1), (None, rows[3][1], 1), (900, None, 1), (901, "", 0), (902, text_of(r, 50_000), None)]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.drop("toxic"), d.select("doc_id", "toxic"))
    features = toxicity.Features(model.lexicon)
    for x in toxicity.score(d, model).collect():
        margin = model.trees.margin(np.array([naive_features(model.lexicon, x.text or "")]))
        assert x.score == pytest.approx(float(np.interp(margin, *model.points)[0]))
    assert features.of(b"") == pytest.approx([0.0] * len(toxicity.NAMES))


def naive_grams(text):
    w = quality._TOKEN.findall(text.encode().lower())
    mask = (1 << 64) - 1
    place = lambda v: ((v & mask) >> 40) % (quality.BUCKETS - 1) + 1
    h = [zlib.crc32(x) for x in w]
    return [place(a * 0x9E3779B97F4A7C15) for a in h] + [0 if a == b else place(a * 0xC2B2AE3D27D4EB4F + b * 0x165667B19E3779F9) for a, b in zip(h, h[1:])]


def test_quality_equals_plain_loops(spark):
    r = random.Random(5)
    rows = [(i, text_of(r, r.randrange(0, 60)) if i % 4 else "buy now " * r.randrange(1, 30), int(i % 4 > 0)) for i in range(200)]
    rows += [(500, None, 1), (501, "", 0), rows[8], rows[9], (9, "second text of nine", 1), (502, text_of(r, 40_000), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs, labels = d.drop("quality"), d.select("doc_id", "quality")
    model = quality.fit(docs, labels)
    raw, target = Counter(), Counter()
    votes: dict = {}
    for i, _, q in rows:
        if q is not None:
            votes.setdefault(i, []).append(q)
    label = {i: int(sum(v) / len(v) >= 0.5) for i, v in votes.items()}
    for i, t, _ in rows:
        raw.update(naive_grams(t or ""))
        if label.get(i) == 1:
            target.update(naive_grams(t or ""))
    n, m = sum(target.values()), sum(raw.values())
    ratio = lambda b: math.log((target[b] + 0.5) / (n + 0.5 * quality.BUCKETS)) - math.log((raw[b] + 0.5) / (m + 0.5 * quality.BUCKETS))
    weight = [sum(map(ratio, naive_grams(t or ""))) for _, t, _ in rows]
    by: dict = {}
    for (i, _, _), w in zip(rows, weight):
        if i in label:
            by[i] = min(w, by.get(i, math.inf))
    sides = [[w for i, w in by.items() if label[i] == y] for y in (1, 0)]
    share = lambda c: sum(w >= c for w in sides[0]) / len(sides[0]) + sum(w < c for w in sides[1]) / len(sides[1])
    assert share(model.cut) == pytest.approx(max(share(c) for c in [*by.values(), max(by.values()) + 1]))
    noise = {x.doc_id: x.g for x in docs.select("doc_id", quality.gumbel(F.col("doc_id").cast("string")).alias("g")).collect()}
    drawn = sorted((w + noise[i] for (i, _, _), w in zip(rows, weight)), reverse=True)
    least = drawn[sum(w >= model.cut for w in weight) - 1]
    got = sorted((x.doc_id, round(x.weight, 6), x.kept) for x in quality.resample(docs, model, ["doc_id"]).collect())
    want = sorted((i, round(w, 6), w + noise[i] >= least - 1e-9) for (i, _, _), w in zip(rows, weight))
    assert got == want


@pytest.fixture(scope="module")
def odd_documents(spark):
    r = random.Random(6)
    rows = [(i, f"plain text number {i} " + " ".join(f"w{r.randrange(500)}" for _ in range(40)), "en", "s") for i in range(60)]
    rows += [(60, None, None, None), (61, "", "en", "s"), (None, "no id " + rows[3][1], "en", "s"), rows[5], rows[5], (62, " ".join(f"v{r.randrange(90000)}" for _ in range(60_000)), "en", "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("weight", "kept", "_key", "_weight", "perturbed", "score", "_row", "_node", "_size", "_cells", "row", "h"):
        d = d.withColumn(name, F.lit(name))
    return d


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_rows_and_columns(spark, odd_documents, name, stage):
    sf = "/root/testdata/sf0.001"
    got = stage(spark, odd_documents, sf)
    rows = got.collect()
    if name != "sentencepiece":
        assert got.schema == odd_documents.schema or got.dtypes == odd_documents.dtypes
        assert all(x.weight == "weight" and x["_key"] == "_key" and x["_row"] == "_row" for x in rows)
        ids = {x.doc_id for x in rows}
        assert len(ids & set(range(60))) >= (55 if name in ("toxicity", "near_duplicates", "decontamination") else 1)
    else:
        assert len(rows) == odd_documents.count() and all(x.lossless for x in rows)
    assert stage(spark, odd_documents.limit(0), sf).count() == 0
