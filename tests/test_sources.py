"""Sources, exports and the stream on small files and recorded answers."""

import json
import os

from pyspark.sql import functions as F

from quillstack.functions import records as rec
from quillstack.operators import export, sync
from quillstack.plans import predicates
from quillstack.sources import catalogues, library, pdftext
from quillstack.streaming import watch

KNUTH = """type: book
title: The Art of Computer Programming
author: ["Knuth, Donald E."]
date: 1997-07
publisher: {name: Addison-Wesley, location: Reading}
serial-number: {isbn: 0-201-89683-4}
x-meta: {files: [a.pdf], tags: [algorithms], provenance: {title: crossref}}
"""
EINSTEIN = """type: article
title: On the Electrodynamics of Moving Bodies
author: "Einstein, Albert"
date: 1905-06-30
abstract: Light.
serial-number: {doi: 10.1002/ANDP.19053221004}
parent: [{type: periodical, title: Annalen der Physik, volume: 322, serial-number: {issn: 0003-3804}}]
"""


def write(root, key, text, name="info.yml"):
    os.makedirs(root / key, exist_ok=True)
    (root / key / name).write_text(text)


def test_library(spark, tmp_path):
    write(tmp_path, "knuth1997", KNUTH)
    write(tmp_path, "deep/einstein1905", EINSTEIN)
    write(tmp_path, "bad", "type: notarealtype")
    write(tmp_path, "worse", "a: [")
    write(tmp_path, ".hidden/x", KNUTH)
    write(tmp_path, "knuth1997", "type: misc", "info.yaml")
    docs, errors = library.documents(spark, str(tmp_path))
    got = {r.citekey: r for r in docs.collect()}
    assert sorted(got) == ["einstein1905", "knuth1997"] and sorted(r.citekey for r in errors.collect()) == ["bad", "worse"]
    e, k = got["einstein1905"], got["knuth1997"]
    assert (e.year, e.parent_title, e.persons[0].name) == (1905, "Annalen der Physik", "Einstein, Albert")
    assert [(s.kind, s.value) for s in e.serials] == [("doi", "10.1002/andp.19053221004"), ("issn", "0003-3804")]
    assert (k.type, k.publisher, k.files, k.tags, k.provenance, k.date) == ("book", "Addison-Wesley", ["a.pdf"], ["algorithms"], {"title": "crossref"}, "1997-07")
    assert [r.citekey for r in predicates.search(docs, "electro light").collect()] == ["einstein1905"]
    assert [r.citekey for r in library.paths(spark, str(tmp_path)).collect()] == ["bad", "einstein1905", "knuth1997", "worse"]
    yaml = {r.citekey: r.text for r in export.rendered(docs, "yaml").collect()}
    assert "abstract" not in yaml["einstein1905"] and "x-meta" not in yaml["knuth1997"]
    bib = {r.citekey: r.text for r in export.rendered(docs, "bibtex").collect()}
    assert "journal = {Annalen der Physik}" in bib["einstein1905"] and "volume = {322}" in bib["einstein1905"] and "month = {6}" in bib["einstein1905"]
    assert "date = {1997-07}" in {r.citekey: r.text for r in export.rendered(docs, "biblatex").collect()}["knuth1997"]


def test_sync_sequence(spark):
    snapshot = lambda rows: sync.fingerprints(spark.createDataFrame(rows, "citekey string, content string"))
    one, two = snapshot([("a", "1"), ("b", "2"), ("c", "3")]), snapshot([("a", "1"), ("b", "9"), ("d", "4")])
    got = sync.report(sync.classify(one, two)).first()
    assert (got.indexed, got.unchanged, got.removed) == (2, 1, 1)
    assert sync.report(sync.classify(one, one)).first().unchanged == 3


def test_stream(spark, tmp_path):
    root, index, state = tmp_path / "lib", str(tmp_path / "index"), str(tmp_path / "state")
    write(root, "knuth1997", KNUTH)
    watch.follow(spark, str(root), index, state).awaitTermination(120)
    assert [r.citekey for r in watch.current(spark, index).collect()] == ["knuth1997"]
    write(root, "einstein1905", EINSTEIN)
    watch.follow(spark, str(root), index, state).awaitTermination(120)
    now = watch.current(spark, index)
    assert sorted(r.citekey for r in now.collect()) == ["einstein1905", "knuth1997"]
    (root / "knuth1997" / "info.yml").unlink()
    left = watch.remove_missing(now, library.files(spark, str(root)))
    assert [r.citekey for r in left.collect()] == ["einstein1905"]


def one(spark, body):
    return spark.createDataFrame([(body if isinstance(body, str) else json.dumps(body),)], "body string")


def test_catalogues(spark):
    csl = {"type": "journal-article", "title": ["On  X"], "volume": 322, "page": "1–2", "DOI": "10.1/X", "issued": {"date-parts": [[1905, 6]]}, "author": [{"family": "Einstein", "given": "A."}], "is-referenced-by-count": 7}
    r = catalogues.crossref(one(spark, {"message": {"items": [csl]}})).first()
    assert (r.source, r.kind, r.title, r.volume, r.issued, r.authors[0].family, r.cited_by) == ("crossref", "article-journal", "On X", "322", "1905-06", "Einstein", 7)
    r = catalogues.crossref(one(spark, {"status": "ok", "message": csl | {"author": [{"family": "Beethoven", "given": "L.", "suffix": "Jr.", "non-dropping-particle": "van"}]}})).first()
    assert (r.title, r.authors[0].family, r.authors[0].suffix, r.authors[0].particle) == ("On X", "Beethoven", "Jr.", "van")
    assert catalogues.crossref(one(spark, {"status": "failed", "message": {}})).count() == 0
    assert catalogues.csl_json(one(spark, [csl])).first().kind == "journal-article"
    work = {"type": "book-chapter", "title": "T", "doi": "https://doi.org/10.1/AB", "publication_year": 2001, "authorships": [{"author": {"display_name": "Ada M. Lovelace"}}, {"author": {"display_name": "A b c d e"}}], "biblio": {"first_page": "1", "last_page": "9"}, "primary_location": {"source": {"display_name": "J"}}}
    r = catalogues.openalex(one(spark, {"results": [work]})).first()
    assert (r.kind, r.doi, r.issued, r.page, r.container, r.authors[0].given, r.authors[1].literal) == ("chapter", "10.1/ab", "2001", "1-9", "J", "Ada M.", "A b c d e")
    feed = "<feed><title>q</title><entry><id>http://arxiv.org/abs/1706.03762v5</id><title>Attention\n Is &amp; All</title><published>2017-06-12T00:00:00Z</published><author><name>A. Vaswani</name></author><arxiv:doi>10.1/Q</arxiv:doi></entry><entry><title>Error</title></entry></feed>"
    rows = catalogues.arxiv_atom(one(spark, feed)).collect()
    assert len(rows) == 1 and (rows[0].title, rows[0].url, rows[0].issued, rows[0].doi) == ("Attention Is & All", "https://arxiv.org/abs/1706.03762v5", "2017-06-12", "10.1/q")
    assert catalogues.openlibrary_books(one(spark, "{}"), F.lit("x")).count() == 0
    r = catalogues.openlibrary_books(one(spark, {"ISBN:1": {"title": "A", "subtitle": "B", "publishers": [{"name": "P"}]}}), F.lit("1")).first()
    assert (r.title, r.publisher, r.isbn) == ("A: B", "P", "1")
    assert catalogues.openlibrary_search(one(spark, {"docs": [{"title": "A", "isbn": ["1", "0201896834"], "first_publish_year": 1997}]})).first().isbn == "9780201896831"
    assert catalogues.google_books(one(spark, {"items": [{"volumeInfo": {"title": "A", "publishedDate": "1997-07-01", "authors": ["D. Knuth"]}}]})).first().issued == "1997-07-01"


def test_bibtex_and_flat(spark):
    text = '@string{pub = "Addison" # " Wesley"}\n@book{k1, author = {Knuth, Donald E. and Leslie Lamport}, title = {The {TeX}book \\& M{\\"u}ller}, year = 1984, month = jan, publisher = pub, isbn = "0-201"}\n@article{a, title={T}, journal={J}, pages={1--2}, number={3}}\n@misc{broken, title = {x'
    found = catalogues.from_texts(one(spark, text), "bibtex").collect()
    rows = {r.key: json.loads(r.body) for r in found if r.key}
    assert [r.error is None for r in found] == [True, True, False]
    twice = catalogues.from_texts(one(spark, "@misc{a, title={x}}\n@misc{a, title={y}}" + "@misc{b, title={" * 7), "bibtex").collect()
    assert [r.key for r in twice if r.key] == ["a", "a"] and [r.error for r in twice][-1] == "and 2 more"
    assert rows["k1"] == {"type": "book", "title": "The TeXbook & Müller", "author": ["Knuth, Donald E.", "Lamport, Leslie"], "date": "1984-01", "serial-number": {"isbn": "0-201"}, "publisher": "Addison Wesley"}
    assert rows["a"]["parent"] == {"type": "periodical", "title": "J", "issue": "3"} and rows["a"]["page-range"] == "1-2"
    assert len(catalogues.parse_bibtex(text)[1]) == 1
    flat = catalogues.flat_body({"type": "article", "title": "T", "author": "A and B", "year": 2001, "month": 5, "journal": "J", "volume": 7, "tags": "x y", "odd": 1})
    assert flat == {"type": "article", "title": "T", "author": ["A", "B"], "date": "2001-05", "parent": {"type": "periodical", "title": "J"}, "x-meta": {"tags": ["x", "y"], "papis": {"odd": 1}}}
    assert {r.key for r in catalogues.from_texts(one(spark, "a: {type: book, title: X}"), "yaml").collect()} == {"a"}


def test_pdf_texts(spark):
    df = spark.createDataFrame([("Title:  A: b\nPages: 12\nPages: 13\nEmpty:\nnocolon", "Page  Type          URL\n   1  Annotation    https://doi.org/10.1/x\n  17  Other  y")], "a string, b string")
    r = df.select(pdftext.info(F.col("a")).alias("i"), pdftext.urls(F.col("b")).alias("u"), pdftext.page_count(pdftext.info(F.col("a"))).alias("n")).first()
    assert r.i == {"Title": "A: b", "Pages": "13"} and [tuple(x) for x in r.u] == [(1, "https://doi.org/10.1/x")] and r.n == 13
    packet = '<x:xmpmeta><rdf:Description prism:doi="10.1/a"><dc:title><rdf:Alt><rdf:li>T &amp; U</rdf:li></rdf:Alt></dc:title><pdfx:isbn>123</pdfx:isbn><cut'
    assert pdftext.parse_xmp(packet) == {"doi": "10.1/a", "title": "T & U", "isbn": "123"}
    page = '<page width="1" height="800"><line yMin="10" yMax="30"><word>Big</word><word>Title</word></line><line yMin="32" yMax="52"><word>goes on</word></line><line yMin="60" yMax="70"><word>small</word></line></page>'
    gap = page.replace('yMin="32" yMax="52"', 'yMin="92" yMax="112"').replace("small", "tiny")
    short = '<page height="800"><line yMin="10" yMax="30"><word>Big</word></line><line yMin="700" yMax="790"><word>Low and very large</word></line></page>'
    mixed = '<page height="800"><line yMin="1" yMax="9"><word>Journal name</word></line><line yMin="10" yMax="30"><word>A long title</word></line><line yMin="31" yMax="39"><word>by</word></line><line yMin="40" yMax="60"><word>not this</word></line></page>'
    pages = spark.createDataFrame(list(enumerate([page, gap, short, mixed, "", None])), "i int, x string")
    got = {r.i: r.t for r in pages.select("i", pdftext.layout("x").alias("page")).select("i", pdftext.geometry_title(F.col("page")).alias("t")).collect()}
    assert got == {0: "Big Title goes on", 1: "Big Title", 2: None, 3: "A long title", 4: None, 5: None}
    assert spark.createDataFrame([(bytearray(b"xx%PDF-1.4"),), (bytearray(b"no"),)], "c binary").select(export.is_pdf(F.col("c"))).collect()[0][0] is True


def test_result_json(spark):
    df = spark.createDataFrame([("doi:1", "library", "k", "@k", "T", "s", None, [], None, ["t"], [], True)], "id string, source string, citekey string, cite string, title string, subtitle string, year bigint, authors array<string>, container string, tags array<string>, files array<string>, in_library boolean")
    assert set(json.loads(export.result_json(df).first()[0])) == {"id", "source", "citekey", "cite", "title", "subtitle", "tags", "in_library"}
    assert df.select(rec.encode(F.lit("a b~c*+é"))).first()[0] == "a%20b~c%2A%2B%C3%A9"
