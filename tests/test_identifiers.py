"""Identifier, record, key and ranking expressions on tables of cases."""

import pytest
from pyspark.sql import functions as F

from quillstack.functions import identifiers as ids
from quillstack.functions import keys as k
from quillstack.functions import records as rec
from quillstack.functions import similarity
from quillstack.functions import text as tx
from quillstack.operators import export, identify, merge, ranking


def check(spark, function, cases):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    got = {r.i: r.y for r in df.select("i", function(F.col("x")).alias("y")).collect()}
    for i, (x, want) in enumerate(cases.items()):
        assert got[i] == want, x


def test_dois(spark):
    check(spark, ids.find_dois, {
        "see 10.1002/andp.19053221004.": ["10.1002/andp.19053221004"], "(10.1016/S0140-6736(05)12345-6)": ["10.1016/s0140-6736(05)12345-6"], "10.1/x 10.1234/a 10.123/abcdef": ["10.1234/a"], "10.1234/AB, 10.1234/ab;": ["10.1234/ab"], "10.1000/xyz 10.1000/XYZ": ["10.1000/xyz"], "none": [],
    })
    check(spark, ids.normalize_doi, {"https://doi.org/10.1000/XYZ": "10.1000/xyz", " http://dx.doi.org/10.1000/xyz. ": "10.1000/xyz", "see 10.1000/xyz": None, "www.doi.org/10.1000/xyz": "10.1000/xyz", "": None})


def test_arxiv(spark):
    check(spark, ids.find_arxiv, {"arXiv:1706.03762v5 [cs.CL]": ["1706.03762v5"], "ARXIV hep-th/9901001": ["hep-th/9901001"], "1706.03762": [], "arxiv: math.GT/0309136": ["math.GT/0309136"]})
    check(spark, ids.normalize_arxiv, {
        "https://arxiv.org/abs/1706.03762v5": "1706.03762v5", "http://www.arxiv.org/pdf/1706.03762.pdf": "1706.03762", "export.arxiv.org/format/hep-th/9901001/": "hep-th/9901001", "arXiv:1706.03762": "1706.03762",
        "1706.03762.pdf": "1706.03762", "https://arxiv.org/list/cs": None, "HEP-TH/9901001": None,
    })


def test_isbns(spark):
    check(spark, ids.normalize_isbn, {"0-201-89683-4": "9780201896831", "978-0-201-89683-1": "9780201896831", "0201896835": None, "080442957X": "9780804429573", "X804429570": None, "123": None})
    check(spark, ids.find_isbns, {"ISBN 0-201-89683-4 and ISBN-13: 978-0-201-89683-1": ["9780201896831"], "call 1234567890 now": []})


def test_parse_identifier(spark):
    check(spark, lambda c: ids.display(ids.parse_identifier(c)), {
        "doi:10.1000/XYZ": "doi:10.1000/xyz", "PMID: 123": "pmid:123", "pmid:": "pmid:", "pmid:12a": None, "arXiv:1706.03762": "arxiv:1706.03762", "isbn:0-201-89683-4": "isbn:9780201896831", "9780201896831": "isbn:9780201896831",
        "https://doi.org/10.1000/xyz": "doi:10.1000/xyz", "nothing": None,
    })


def test_repair(spark):
    check(spark, tx.repair, {"eﬃcient ﬁ­​x y 1–2": "efficient fix y 1-2"})
    check(spark, tx.join_broken_lines, {"10.1002/an- \n dp": "10.1002/andp", "peer-\nReviewed": "peer-\nReviewed", "a-b": "a-b"})
    check(spark, tx.before_references, {"a\nReferences\nb": "a\n", "a\n7. REFERENCES:\nb": "a\n", "a\nReferences :\nb": "a\nReferences :\nb", "see references\nx": "see references\nx", "a\n Works Cited \nb": "a\n"})


def test_dates_types_ranges(spark):
    check(spark, rec.iso_of_text, {"1997-06-05T00:00:00Z": "1997-06-05", "1997-06": "1997-06", "June 5, 1997": None, "June 1997": "1997", "1997-13-01": "1997", "nd": None})
    check(spark, lambda c: rec.iso_of_parts(F.split(c, ",")), {"1905": "1905", "1905,6": "1905-06", "1905,6,30": "1905-06-30", "x": None})
    check(spark, lambda c: F.concat_ws("/", rec.entry_type(c), rec.parent_type(c)), {"article-journal": "article/periodical", "paper-conference": "article/proceedings", "chapter": "chapter/anthology", "book": "book", "xyz": "misc", "legal_case": "case"})
    check(spark, rec.page_range, {"891–921": "891-921", "1 -- 2": "1-2"})
    check(spark, rec.pdf_form, {"https://arxiv.org/abs/1706.03762": "https://arxiv.org/pdf/1706.03762", "https://openreview.net/forum?id=X": "https://openreview.net/pdf?id=X", "https://www.medrxiv.org/content/10.1/2/": "https://www.medrxiv.org/content/10.1/2.full.pdf", "https://biorxiv.org/content/1.full.pdf": None})
    check(spark, rec.as_text, {'" a  b "': "a b", "322.0": "322", "1.5": "1.5", '["", "x"]': "x", '" "': None, '[["y"]]': "y"})


def test_keys(spark):
    check(spark, lambda c: k.slug(k.nostop(c)), {"The Art of Computer Programming": "art-of-computer-programming", "Ægir & Bjørnson": "aegir-bjornson", "On the": "on-the"})
    check(spark, k.titlecase, {"hello wORLD": "Hello World"})
    check(spark, lambda c: k.sanitize(c, 12), {"einstein1905:.": "einstein1905", "a b/c!": "abc", "...": "", "müller2020": "müller2020"})
    check(spark, lambda c: k.alpha_suffix(c.cast("long")), {"0": "a", "25": "z", "26": "aa", "27": "ab", "701": "zz", "702": "aaa", "18278": "aaaa", "475254": "aaaaa", "12356630": "aaaaaa"})
    check(spark, lambda c: k.normalize(c, "nfkd"), {"ﬁ": "fi"})


def test_jaro_winkler():
    assert similarity.winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.winkler("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert similarity.winkler("", "") == 1.0 and similarity.winkler("a", "") == 0.0


def test_tiers(spark):
    rows = [("d", "doi:a", 4, 1, 0, "x"), ("d", "doi:a", 6, 1, 1, "y"), ("d", "doi:b", 4, 1, 2, "z")]
    got = [(r.id, r.confidence, r.context) for r in identify.rank(spark.createDataFrame(rows, "doc string, id string, tier int, confidence int, seq int, context string")).orderBy("place").collect()]
    assert got == [("doi:a", 3, "x"), ("doi:b", 1, "z")]
    stages = [("d", "doi:a", 0, 2), ("d", "doi:b", 4, 1), ("e", "doi:a", 4, 1), ("e", "doi:a", 5, 1), ("e", "doi:c", 7, 0)]
    kept = identify.conclusive_stage(spark.createDataFrame(stages, "doc string, id string, tier int, confidence int")).collect()
    assert sorted((r.doc, r.tier) for r in kept) == [("d", 0), ("e", 4), ("e", 5)]
    pages = spark.createDataFrame([("d", "DOI 10.1234/own.doi\nReferences\n10.9999/other.doi"), ("e", "arXiv:1706.03762")], "doc string, text string")
    found = {(r.doc, r.id["value"], r.confidence) for r in identify.from_text(pages, 4, F.lit(1)).collect()}
    assert {("d", "10.1234/own.doi", 2), ("e", "1706.03762", 2)} <= found and not any("other" in v for _, v, _ in found)


def test_update_guard(spark):
    local = spark.createDataFrame([(1, "title", "old"), (1, "note", "mine"), (1, "same", "x")], "doc int, field string, value string")
    fresh = spark.createDataFrame([(1, "title", "new", "p"), (1, "note", "theirs", "p"), (1, "url", "u", "p"), (1, "same", "x", "p"), (1, "x-meta", "m", "p")], "doc int, field string, value string, source string")
    known = spark.createDataFrame([(1, "title"), (1, "same")], "doc int, field string")
    got = {r.field: (r.value, r.changed) for r in merge.update(local, fresh, known).collect()}
    assert got == {"title": ("new", True), "note": ("mine", False), "url": ("u", True), "same": ("x", False)}
    assert {r.field for r in merge.update(local, fresh, known, True).where("changed").collect()} == {"title", "note", "url"}


def test_templates(spark):
    df = spark.createDataFrame([("The Art of Things", 1997, None)], "title string, year int, author string")
    ctx = {"title": F.col("title"), "date.year": F.col("year"), "author[0].family": F.col("author")}
    line = lambda t: df.select(export.template(t, ctx)).first()[0]
    assert line("{{ title | nostop | words(1) | lower }}{{ date.year }}") == "art1997"
    assert line("{{ title | replace('Art', 'x|y') }}") == "The x|y of Things" and line("{{ author[0].family }}x") is None
    for bad in ("{{ nope }}", "{{ title | nope }}"):
        with pytest.raises(ValueError):
            line(bad)
    assert export.unescape_template(r"a\tb\n\\") == "a\tb\\n\\"


def test_ranking(spark):
    rows = [("crossref", 0, 0, "doi:1", "book", "Attention Is All You Need", ["Vaswani"], "2017", 5), ("arxiv", 1, 0, "doi:1", "book", "Attention Is All You Need", ["Vaswani"], "2017", 5), ("arxiv", 1, 1, "arxiv:2", "manuscript", "Attention Is All You Need", ["Vaswani"], "2017", 0), ("crossref", 0, 1, None, "book", "Other", [], None, 0)]
    df = spark.createDataFrame(rows, "source string, provider_ord int, pos int, id string, kind string, title string, families array<string>, issued string, cited_by bigint")
    for c in ("container", "page", "volume", "publisher", "abstract"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = [(r.source, r.id, r.score) for r in ranking.rank(ranking.Wanted("attention is all you need", limit=10), df).collect()]
    assert [g[:2] for g in got] == [("crossref", "doi:1"), ("arxiv", "arxiv:2"), ("crossref", None)] and got[0][2] == 1.0
