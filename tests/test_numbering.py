"""Jaro-Winkler in batches against a plain loop; numbers by range against sorting on one machine."""

import random

import pytest
from pyspark.sql import functions as F

from quillstack.functions import similarity
from quillstack.operators import ranking
from quillstack.operators.numbering import numbered


def plain(a, b):
    """Jaro-Winkler of one pair, character by character."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, taken, mine = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in taken and b[j] == x), None)
        if j is not None:
            taken.add(j)
            mine.append(x)
    if not mine:
        return 0.0
    m, moved = len(mine), sum(x != b[j] for x, j in zip(mine, sorted(taken))) // 2
    score = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    same = next((i for i in range(4) if a[i : i + 1] != b[i : i + 1] or not a[i : i + 1]), 4)
    return min(score + 0.1 * same * (1 - score), 1.0) if score > 0.7 else score


def test_batches_of_pairs():
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choices("abcd é漢😀", k=rnd.randint(0, n)))
    pairs = [(text(n), text(m)) for n, m in [(4, 4), (12, 12), (30, 5), (2, 40)] for _ in range(500)]
    pairs += [(a, a[1:] + a[:1]) for a, _ in pairs[:300]] + [("ab" * 700, "ba" * 650 + "c")]
    assert similarity.winkler_of(*map(list, zip(*pairs))).tolist() == pytest.approx([plain(*p) for p in pairs], abs=1e-12)
    assert similarity.winkler_of([], []).tolist() == []


def test_small_blocks(monkeypatch):
    pairs = [("martha", "marhta"), ("dixon", "dicksonx"), ("crate", "trace")] * 9
    whole = similarity.winkler_of(*map(list, zip(*pairs))).tolist()
    monkeypatch.setattr(similarity, "CELLS", 1)
    assert similarity.winkler_of(*map(list, zip(*pairs))).tolist() == whole


def test_nulls_of_pairs(spark):
    df = spark.createDataFrame([("a", None), (None, None), (None, "a"), ("a", "a"), ("", "")], "a string, b string")
    assert [r.s for r in df.select(similarity.jaro_winkler("a", "b").alias("s")).collect()] == [None, None, None, 1.0, 1.0]


def test_numbered(spark):
    """One group holds most rows, so its numbers run over several ranges; a null group is one of its own."""
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b", None]), rnd.randint(0, 10**9), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x long, _row long")
    got, _ = numbered(df, ["g"], [F.desc("x"), F.asc("_row")], "at")
    assert got.columns == ["g", "x", "_row", "at"]
    want, seen = {}, {}
    for g, x, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        seen[g] = want[i] = seen.get(g, 0) + 1
    assert {r["_row"]: r["at"] for r in got.collect()} == want
    every, _ = numbered(df, [], [F.asc("x"), F.asc("_row")], "at")
    assert [r["at"] for r in every.orderBy("x", "_row").collect()] == list(range(1, 3001))
    assert numbered(df.where("x < 0"), ["g"], [F.asc("x")], "at")[0].count() == 0


def test_places(spark):
    """Places without a limit begin with those of a limit."""
    rows = [(f"s{i % 3}" if i % 4 else "s0", i % 3, i, None, "book", f"title {i % 17}", [], None, None, None, None, None, None, i) for i in range(200)]
    c = spark.createDataFrame(rows, "source string, provider_ord int, pos int, id string, kind string, title string, families array<string>, issued string, container string, page string, volume string, publisher string, abstract string, cited_by long")
    ranked = ranking.scored(ranking.Wanted("title 3"), c)
    every, first = ranking.interleave(ranked).collect(), ranking.interleave(ranked, 20).collect()
    assert [r.place for r in every] == list(range(1, 201)) and sorted((r.turn, r.source_ord) for r in every) == [(r.turn, r.source_ord) for r in every]
    assert [(r.pos, r.source, r.turn, r.source_ord, r.place) for r in first] == [(r.pos, r.source, r.turn, r.source_ord, r.place) for r in every[:20]]
