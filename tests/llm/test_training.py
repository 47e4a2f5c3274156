"""The language model against plain loops: what it learns from, and its scores token by token."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstack.llm import attention, languagemodel

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["alpha", "Beta", "na\u00efve", "internationalisation", "the", "of", "\u65e5\u672c", "x1", "\u2581", "don't"]


def allowed():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0


def texts_of(r, n):
    return [" ".join(r.choice(WORDS + [f"w{r.randrange(300)}"]) for _ in range(r.randrange(0, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = list(enumerate(texts_of(r, 120))) + [(500, None), (501, ""), (502, " \n"), (503, " ".join(texts_of(r, 90)))]
    rows += [(None, rows[3][1]), (None, rows[3][1]), rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module", autouse=True)
def small():
    with pytest.MonkeyPatch.context() as m:
        m.setattr(languagemodel, "WARM", 30)
        m.setattr(languagemodel, "WARM_STEPS", 60)
        m.setattr(languagemodel, "SHARD", 2000)
        m.setattr(languagemodel, "CHUNK", 500)
        m.setattr(languagemodel, "HEAD", 40)
        yield


@pytest.fixture(scope="module")
def fitted(docs, small):
    return languagemodel.fit(docs, PATH, allowed())


def words_of(text):
    return (text or "").encode().lower().split()


def test_every_token_of_every_training_row_is_learned_once(docs, fitted):
    rows = {(r.doc_id, r.text or "") for r in docs.where(allowed()).collect()}
    assert fitted[1].learned == sum(len(words_of(t)) + 1 for _, t in rows)


def naive(model, counts, text):
    """Natural log of the chance of a text, one token at a time in double precision."""
    w = {k: x.astype(float) for k, x in model.weights.items()}
    words = words_of(text)
    parts = [model.spelling.words(PATH, [x]) for x in words]
    tokens = [int(p[0][0]) for p in parts] + [1]
    total = 0.0
    for i, t in enumerate(tokens):
        window = i // attention.STRIDE * attention.STRIDE - (attention.LENGTH - attention.STRIDE)
        places = range(window, i + 1)
        inputs = [tokens[p - 1] if p > 0 else 0 for p in places]
        h = [w["embed"][x] + w["place"][p - window] for x, p in zip(inputs, places)]
        q = h[-1] @ w["query"] / attention.WIDTH**0.5
        a = np.array([np.exp(min(q @ (x @ w["key"]), 30)) for x in h])
        u = h[-1] + sum(s * (x @ w["value"]) for s, x in zip(a / a.sum(), h))
        logits = np.maximum(u @ w["hidden"] + w["shift"], 0) @ w["out"] + model.classes.prior[inputs[-1]]
        total += logits[model.classes.of[t]] - np.log(np.exp(logits).sum()) + model.classes.within[t]
        if i < len(words):
            c = counts.get(words[i], 0)
            total += np.log(np.exp(parts[i][1][0]) + c * np.exp(parts[i][2][0]))
    return total


def test_scores_equal_plain_loops(docs, fitted):
    table, model, counts = fitted
    c = {}
    for r in docs.where(allowed()).collect():
        for w in [*words_of(r.text), b""]:
            c[w] = c.get(w, 0) + 1
    assert {bytes(r.word): r.c for r in counts.collect()} == c
    total, distinct = sum(c.values()), len(c)
    got = languagemodel.scored(table, model, counts, "doc_id").collect()
    assert len(got) == docs.count() and {r.train_tokens for r in got} == {total}

    def want(r):
        w = [*words_of(r.text), b""]
        base = sum(np.log10((c.get(x, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        return str(r.doc_id), len(w), sum(x in c for x in w), base, naive(model, c, r.text) / np.log(10)

    key = lambda t: (t[0], t[1], t[2], round(t[3], 4))
    found = sorted(((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    expected = sorted(map(want, docs.collect()), key=key)
    for x, y in zip(found, expected):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], abs=1e-6) and x[4] == pytest.approx(y[4], rel=1e-4, abs=1e-3)


def test_chances_of_all_first_pieces_sum_to_one(fitted):
    _, model, _ = fitted
    one = [np.exp(languagemodel.first_scores(model, np.array([t], np.int16), np.array([1]))[0]) for t in range(1, model.spelling.n)]
    assert sum(one) == pytest.approx(1, abs=1e-4)
    words = [w.encode().lower() for w in WORDS] + [f"w{i}".encode() for i in range(300)]
    first, spelled, whole = model.spelling.words(PATH, words)
    assert (spelled < 0).all() and (first >= 2).all()


def test_scores_do_not_depend_on_partitions_or_the_head(docs, monkeypatch):
    def rows(d):
        return sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6), r.score) for r in languagemodel.score(d, PATH, allowed()).collect())

    one = rows(docs.repartition(1))
    monkeypatch.setattr(languagemodel, "HEAD", 1 << 18)
    for x, y in zip(one, rows(docs.repartition(7)), strict=True):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], abs=1e-2)


def test_empty_tables(spark, docs):
    assert languagemodel.score(docs.limit(0), PATH, allowed()).count() == 0
    got = languagemodel.score(docs, PATH, F.lit(False)).collect()
    assert len(got) == docs.count() and all(np.isfinite(r.score) and r.score < 0 and r.train_tokens == 0 for r in got)
