"""The full-text index against the scan of texts."""

import random

import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.operators import fulltext
from quillstack.plans import predicates
from quillstack.plans.fixtures import corpus

SF = "/root/testdata/sf0.001"
RND = random.Random(4)
WORDS = ["a", "b", "ab", "abc", "Été", "x-y", "日本", "of", "the", "2nd"]


@pytest.fixture(scope="module")
def small(spark):
    texts = [" ".join(RND.choice(WORDS) for _ in range(RND.randrange(0, 40))) for _ in range(150)] + ["", "...", "the the the of", "a b " * 600, None]
    rows = [(f"k{i}", i % 3, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "citekey string, n int, text string").withColumn("fts_norm", tx.full_text(F.coalesce("text", F.lit(""))))
    return d.select("citekey", F.concat(F.lit("t"), F.col("n").cast("string")).alias("type"), "fts_norm").repartition(3)


@pytest.fixture(scope="module")
def index(spark, small, tmp_path_factory):
    return fulltext.build(small, str(tmp_path_factory.mktemp("fulltext") / "index"), parts=3)


QUERIES = [
    "a", "ab", '"ab"', '"a b"', '"the of"', '"the the"', '"the the the of"', "été", '"x y"', "x-y", "日", '"日本 a"', "zzz", '"zzz a"', '"!!!"', '-"!!!"', "-a", "a -b type:t1", "a OR type:t2", '("a b" OR abc) -"of the"',
    'NOT (a OR "b a")', '"a b a b a b"', '"b a b" type:t0 OR 2nd', "", '"a b" "b a"', '-(a b)',
]


@pytest.mark.parametrize("query", QUERIES)
def test_equals_scan(small, index, query):
    assert [r.citekey for r in fulltext.search(index, query, ("citekey",)).collect()] == [r.citekey for r in predicates.search(small, query, ("citekey",)).collect()]


def test_postings(index, small):
    keys = {r.slice: r.citekeys for r in index.keys.collect()}
    rows = {(r.term, keys[r.slice][r.doc]): r.at for r in fulltext.entries(index.postings).withColumn("at", fulltext.positions(F.col("gaps"))).collect()}
    want = {}
    for r in small.collect():
        for i, w in enumerate(r.fts_norm.split()):
            want.setdefault((w, r.citekey), []).append(i)
    assert rows == want
    assert [r.term for r in fulltext.vocabulary(index, "a").collect()] == ["a", "ab", "abc"]
    (t,) = index.terms.where("term = 'the'").collect()
    assert (t.documents, t.occurrences) == (sum(w == "the" for w, _ in want), sum(len(v) for (w, _), v in want.items() if w == "the"))


def test_plan_reads_no_text(index, capsys):
    fulltext.search(index, '"of the" -idiot', ("citekey",)).explain("formatted")
    plan = capsys.readouterr().out
    assert "fts_norm" not in plan and "StringStartsWith(term,idiot)" in plan and "EqualTo(term,of)" in plan and "LeftAnti" in plan and "LeftSemi" in plan


def test_empty_and_real(spark, tmp_path):
    texts = corpus(spark, SF)
    real = fulltext.build(texts, str(tmp_path / "real"))
    for query in ("th", '"of the"', '"de la" OR "in der"'):
        got = [r.citekey for r in fulltext.search(real, query, ("citekey",)).collect()]
        assert got == [r.citekey for r in predicates.search(texts, query, ("citekey",)).collect()] and got
    none = fulltext.build(texts.limit(0), str(tmp_path / "none"))
    assert fulltext.search(none, "-a", ("citekey",)).count() == fulltext.search(none, '"a b" OR c', ("citekey",)).count() == 0
