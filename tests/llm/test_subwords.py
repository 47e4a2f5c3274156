"""The language model over all subword pieces: against plain loops, piece by piece."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstack.llm import attention, languagemodel, queries, subwords

PATH = public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["alpha", "Beta", "naïve", "internationalisation", "the", "of", "日本", "x1", "▁", "don't"]


def allowed():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 != 0


def texts_of(r, n):
    return [" ".join(r.choice(WORDS + [f"w{r.randrange(300)}"]) for _ in range(r.randrange(0, 90))) for _ in range(n)]


@pytest.fixture(scope="module", autouse=True)
def small():
    with pytest.MonkeyPatch.context() as m:
        m.setattr(languagemodel, "WARM", 30)
        m.setattr(languagemodel, "WARM_STEPS", 60)
        m.setattr(languagemodel, "SHARD", 4000)
        m.setattr(languagemodel, "CHUNK", 500)
        m.setattr(languagemodel, "HEAD", 40)
        m.setattr(languagemodel, "BLOCK", 100)
        m.setattr(subwords, "LEAVES", 12)
        m.setattr(subwords, "BINS", 4)
        yield


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = list(enumerate(texts_of(r, 120))) + [(500, None), (501, ""), (502, " \n"), (503, " ".join(texts_of(r, 90))), (510, "quixotic zebras ☃")]
    rows += [(None, rows[3][1]), (None, rows[3][1]), rows[5], rows[5]]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def fitted(docs, small):
    return subwords.fit(docs, PATH, allowed())


def words_of(text):
    return (text or "").encode().lower().split()


def ids_of(text):
    return [i for w in words_of(text) for i in languagemodel.spell(PATH, [w])[0] or [0]]


def tokens_of(model, text):
    return [int(model.index[i]) for i in ids_of(text)] + [subwords.END]


def hidden(w, window):
    """The hidden units after a window's inputs, all of them and their places."""
    h = [w["embed"][x] + w["place"][k] for k, x in enumerate(window)]
    q = h[-1] @ w["query"] / attention.WIDTH**0.5
    a = np.array([np.exp(min(q @ (x @ w["key"]), 30)) for x in h])
    return np.maximum((h[-1] + sum(s * (x @ w["value"]) for s, x in zip(a / a.sum(), h))) @ w["hidden"] + w["shift"], 0)


def chances(model, window):
    """The chance of each piece of the tree after a window's inputs, in double precision."""
    w, tree = {k: x.astype(float) for k, x in model.weights.items()}, model.tree
    r = hidden(w, window)
    over = lambda z: np.exp(z) / np.exp(z).sum()
    top = over(r @ w["out"] + tree.prior[window[-1]])
    out = np.zeros(model.n)
    for c in range(tree.count):
        members = [t for t in range(1, model.n) if tree.of[t] == c]
        out[members] = top[c] * over(np.array([r @ w["member"][:, tree.slot[t]] + (tree.share[tree.slot[t]] if len(members) > 1 else 0) for t in members]))
    return out


def naive(model, text):
    """Natural log of the chance of a text, one piece at a time."""
    tokens, total = tokens_of(model, text), 0.0
    for i, t in enumerate(tokens):
        begin = i // attention.STRIDE * attention.STRIDE - (attention.LENGTH - attention.STRIDE)
        total += np.log(chances(model, [tokens[p - 1] if p > 0 else 0 for p in range(begin, i + 1)])[t])
        total -= model.unseen if t == subwords.UNSEEN else 0
    return total


def test_scores_equal_plain_loops(docs, fitted):
    table, model, counts = fitted
    c = {}
    for r in docs.where(allowed()).collect():
        for w in [*words_of(r.text), b""]:
            c[w] = c.get(w, 0) + 1
    total, distinct = sum(c.values()), len(c)
    got = subwords.scored(table, model, counts, "doc_id").collect()
    assert len(got) == docs.count() and {r.train_tokens for r in got} == {total}
    assert model.tree.size.max() > 5 and (510,) in {(r.doc_id,) for r in got}

    def want(r):
        w = [*words_of(r.text), b""]
        base = sum(np.log10((c.get(x, 0) + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        return str(r.doc_id), len(w), sum(x in c for x in w), base, naive(model, r.text) / np.log(10)

    few = {*range(0, 30), 500, 501, 502, 510, None}
    found = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in got if r.doc_id in few)
    for x, y in zip(found, sorted(map(want, (r for r in docs.collect() if r.doc_id in few))), strict=True):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], abs=1e-6) and x[4] == pytest.approx(y[4], rel=1e-4, abs=1e-3)


def test_every_piece_of_every_training_row_is_learned_once(docs, fitted):
    rows = {(r.doc_id, r.text or "") for r in docs.where(allowed()).collect()}
    model = fitted[1]
    assert model.learned == sum(len(ids_of(t)) + 1 for _, t in rows)
    # All ids of the training texts, however rare, are kept apart; as inputs and as targets they have weights of their own.
    ids = {i for _, t in rows for i in ids_of(t)}
    assert len({int(model.index[i]) for i in ids}) == len(ids) == model.n - subwords.FIRST and min(model.index[list(ids)]) >= subwords.FIRST
    assert len(np.unique(model.weights["embed"], axis=0)) == model.n
    binned = model.tree.slot[[t for t in range(1, model.n) if model.tree.size[model.tree.of[t]] > 1]]
    assert (np.abs(model.weights["member"][:, binned]).sum(0) > 0).all()


def test_chances_of_all_pieces_sum_to_one(fitted):
    model = fitted[1]
    for lead in ([], [5], [7, 30, 12]):
        scores = [subwords.text_scores(model, np.array([*lead, t], np.int16), np.array([len(lead) + 1]))[0] for t in range(1, model.n)]
        before = subwords.text_scores(model, np.array(lead, np.int16), np.array([len(lead)]))[0] if lead else 0.0
        shares = np.exp(np.array(scores) - before)
        shares[subwords.UNSEEN - 1] *= np.exp(model.unseen)
        assert shares.sum() == pytest.approx(1, abs=1e-4)


def test_a_piece_in_its_bin_depends_on_the_text(fitted):
    """Counts don't give it: its share of its bin changes with the pieces before."""
    model = fitted[1]
    tree = model.tree
    bin_ = int(np.argmax(tree.size))
    members = [t for t in range(1, model.n) if tree.of[t] == bin_]
    a, b = (chances(model, [0] * 20 + lead)[members] for lead in ([5, 9], [20, 3]))
    assert np.abs(a / a.sum() - b / b.sum()).max() > 1e-3


def test_gradients():
    r = np.random.default_rng(0)
    tree = subwords.Tree(r.integers(1, 50, 40).astype(float))
    assert tree.count < 39 and tree.size.sum() == 39
    tree.follow(r.integers(0, 9, (40, tree.count)).astype(float))
    w = {k: v.astype(np.float64) for k, v in subwords.start(40, tree.count).items()}
    for name in ("out", "member"):
        w[name] = r.standard_normal(w[name].shape) * 0.1
    inputs, targets = r.integers(0, 40, (2, attention.LENGTH)), r.integers(1, 40, 2 * attention.STRIDE)
    live = r.random(len(targets)) < 0.8
    targets[~live] = subwords.START
    loss, g = subwords.gradients(w, tree, inputs, targets, live)
    last = int(tree.slot[targets[tree.of[targets] >= tree.leaves][0]])
    for name in w:
        at = {"embed": (int(inputs[0, -1]), 0), "member": (3, last)}.get(name, tuple(x // 2 for x in w[name].shape))
        moved = {k: v.copy() for k, v in w.items()}
        moved[name][at] += 1e-5
        assert (subwords.gradients(moved, tree, inputs, targets, live)[0] - loss) / 1e-5 == pytest.approx(g[name][at], abs=1e-4), name


def test_later_pieces_of_a_word_are_read(spark, tmp_path):
    """Two words of the same first piece: what follows them is scored apart (the query)."""
    r = random.Random(4)
    rows = [(i, t) for i, t in enumerate(texts_of(r, 60))]
    a, b = "w112", "w297"
    first = [languagemodel.spell(PATH, [w.encode()])[0] for w in (a, b)]
    assert first[0][0] == first[1][0] and first[0][-1] != first[1][-1]
    rows += [(1000 + k, t) for k, t in enumerate((f"the {a} of", f"the {a}", f"the {b} of", f"the {b}"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    s = {x.doc_id: x.score for x in queries.op3_language_model(spark, str(tmp_path)).collect()}
    assert abs((s[1000] - s[1001]) - (s[1002] - s[1003])) > 1e-3


def test_scores_do_not_depend_on_partitions_or_the_head(docs, monkeypatch):
    def rows(d):
        return sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in subwords.score(d, PATH, allowed()).collect())

    one = rows(docs.repartition(1))
    monkeypatch.setattr(languagemodel, "HEAD", 1 << 18)
    for x, y in zip(one, rows(docs.repartition(7)), strict=True):
        assert x[:4] == y[:4] and x[4] == pytest.approx(y[4], abs=1e-2)


def test_many_pieces_are_held_in_32_bits(docs, fitted, monkeypatch):
    key = lambda r: (str(r.doc_id), r.n_tokens, round(r.base_score, 6))
    narrow = sorted(subwords.scored(*fitted, "doc_id").collect(), key=key)
    monkeypatch.setattr(subwords, "NARROW", 10)
    wide = subwords.fit(docs, PATH, allowed())
    assert wide[1].kind is np.int32 and wide[1].learned == fitted[1].learned
    for x, y in zip(narrow, sorted(subwords.scored(*wide, "doc_id").collect(), key=key), strict=True):
        assert key(x) == key(y) and x.score == pytest.approx(y.score, abs=1e-2)


def test_empty_tables(docs):
    assert subwords.score(docs.limit(0), PATH, allowed()).count() == 0
    got = subwords.score(docs, PATH, F.lit(False)).collect()
    assert len(got) == docs.count() and all(np.isfinite(r.score) and r.score < 0 and r.train_tokens == 0 for r in got)
