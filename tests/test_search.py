"""The search language and its golden library of three documents."""

import pytest
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.operators import sync
from quillstack.plans import predicates
from quillstack.plans import querylang as q


@pytest.fixture(scope="module")
def library(spark):
    rows = [
        ("einstein1905", "article", "On the Electrodynamics of Moving Bodies", 1905, None, "Annalen der Physik", [("author", 0, "Einstein, Albert")], ["relativity", "classic"], ["paper.pdf"], [("doi", "10.1002/andp.19053221004")]),
        ("knuth1997", "book", "The Art of Computer Programming", 1997, "Addison-Wesley", None, [("author", 0, "Knuth, Donald E.")], ["algorithms"], [], [("isbn", "0201896834")]),
        ("turing1950", "article", "Computing Machinery and Intelligence", 1950, None, "Mind", [("author", 0, "Turing, Alan M."), ("editor", 0, "Copeland, B. Jack")], [], [], []),
    ]
    df = spark.createDataFrame(rows, "citekey string, type string, title string, year bigint, publisher string, parent_title string, persons array<struct<role:string,position:int,name:string>>, tags array<string>, files array<string>, serials array<struct<kind:string,value:string>>")
    text = lambda c: F.coalesce(c, F.lit(""))
    words = F.concat_ws(" ", "citekey", text(F.col("title")), text(F.col("parent_title")), F.array_join(F.transform("persons", lambda p: p["name"]), " "), F.array_join("tags", " "))
    return df.withColumn("dir", F.col("citekey")).withColumn("fts_norm", tx.full_text(words)).cache()


CASES = {
    "": "EKT", "author:einstein": "E", "tag:relativity": "E", "file:yes": "E", "type:book": "K", "publisher:addison": "K", "year:1900-1960": "ET", "journal:Mind": "T", "editor:copeland": "T", "person:copeland": "T",
    "author:copeland": "", "year:>1900 -author:einstein": "KT", "author:knuth OR author:turing": "KT", "(author:knuth OR author:turing) year:<1990": "T", "NOT type:article": "K", "electro": "E", "algorith": "K",
    '"Computer Programming"': "K", '"Programming Computer"': "", "doi:10.1002": "E", "doi:10_1002": "", "title:%": "", "NOT publisher:x": "K", "NOT editor:x": "EKT", "has:pdf": "KT", '"!!!"': "", '-"!!!"': "EKT",
    "year:1905--1910": "", 'journal:"mind"': "", 'journal:"Mind"': "T", "date:-1950": "ET", "date:1950-": "KT", "date:>=1950 date:<=1996": "T", "by:KNUTH": "K", "id:0201": "K", "no:such": "", "phys": "E",
}


@pytest.mark.parametrize("query", CASES)
def test_golden(library, query):
    keys = [r.citekey[0].upper() for r in predicates.search(library, query).collect()]
    assert "".join(keys) == CASES[query]


def test_trees():
    assert q.parse("  ") == q.All()
    assert q.parse("a b OR c -d") == q.Or(q.And(q.Prefix("a"), q.Prefix("b")), q.And(q.Prefix("c"), q.Not(q.Prefix("d"))))
    assert q.parse("https://example.org") == q.Prefix("https://example.org")
    assert q.parse("well-known") == q.Prefix("well-known") and q.parse("-") == q.Prefix("-")
    assert q.parse("sense and") == q.And(q.Prefix("sense"), q.Prefix("and"))
    assert q.parse("title:'a b'") == q.Field("title", q.Exact("a b")) and q.parse("title:") == q.Prefix("title:")
    assert q.parse("has:ANY") == q.Field("file", q.Flag(True)) and q.parse("has:no") == q.Field("file", q.Flag(False))
    for text, low, high in (("1999", 1999, 1999), ("1990-1999", 1990, 1999), ("1990-", 1990, None), ("-1990", None, 1990), (">1990", 1991, None), (">=1990", 1990, None), ("<1990", None, 1989), ("<=1990", None, 1990)):
        assert q.parse(f"year:{text}") == q.Field("year", q.Range(low, high))


@pytest.mark.parametrize("query", ["(author:a", "author:a)", "AND author:a", "author:a AND", '"open', "'tis", 'nope:"x"', "year:abc", "OR", "()", "a OR"])
def test_malformed(query):
    with pytest.raises(q.QueryError):
        q.parse(query)


def test_lookups(library, spark):
    assert sync.by_serial(library, "doi", "10.1002/ANDP.19053221004").count() == 0
    assert sync.by_serial(library, "doi", "10.1002/andp.19053221004").count() == 1
    assert [r.citekey for r in sync.by_keys(library, ["turing1950", "einstein1905"]).collect()] == ["turing1950", "einstein1905"]


def test_full_text_agrees_with_the_query_side(spark):
    texts = ["Ünïcode–text, naïve_état 日本 x²", "ß ŒUVRE  q.e.d."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.full_text(F.col("t"))).collect()]
    assert got == [f" {tx.full_text_of(t)} " for t in texts]
