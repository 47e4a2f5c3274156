"""Identification as one call: stages, repeated identifiers, references, titles."""

import pytest

from quillstack.operators import identification

INFO = "Title: {}\nPages: {}\n"


@pytest.fixture(scope="module")
def found(spark):
    rows = {
        "in/meta.pdf": {"info": INFO.format("A Title", 9), "info-custom": "doi: 10.1000/meta", "text-1-1-layout": "10.1000/never-read"},
        "in/stamp.pdf": {"info": "Pages: 9\n", "text-1-1-layout": "a\nr\nX\ni\nv\n:\n1\n7\n0\n6\n.\n0\n3\n7\n6\n2\n", "text-1-9": "10.1000/never-read"},
        "in/footer.pdf": {"info": "Pages: 4\n", "text-1-1-layout": "nothing", "text-4-4": "last", "text-1-4": "\f".join(f"body {i}\nsee 10.1111/other{i} .\n10.1234/own.doi\n" for i in range(4))},
        "in/cited.pdf": {"info": "Pages: 1\n", "text-1-1-layout": "Title\n\nReferences\n\n[1] 10.1002/andp.1905\n", "bbox-1": '<page height="800"><line yMin="50" yMax="80"><word>Big</word><word>Title</word></line><line yMin="300" yMax="310"><word>body</word></line></page>'},
        "in/agree.pdf": {"info": "Pages: 2\n", "text-2-2": "10.1000/both ", "text-1-2": "see 10.1000/both and 10.1000/one "},
        "in/1706.03762.pdf": {"xmp": "<x><title>From packet</title></x>"},
        "in/links.pdf": {"info": "Pages: 3\n", "urls-3": "Page Type URL\n   1 Annotation https://doi.org/10.1000/link\n   2 Annotation https://doi.org/10.1000/far\n"},
        "in/nothing.pdf": {},
    }
    runs = [(pdf, op, text, None) for pdf, ops in rows.items() for op, text in ops.items()]
    runs += [("in/nothing.pdf", "info", None, "cut"), ("in/nothing.pdf", "text-1-1-layout", "10.1000/failed", "cut"), ("in/stranger.pdf", "info", "doi: 10.1/x", None)]
    recorded = spark.createDataFrame(runs, "pdf string, op_key string, text string, error string")
    pdfs = spark.createDataFrame([(pdf.split("/")[1][:-4], pdf) for pdf in rows], "doc string, pdf string")
    return identification.identify_documents(pdfs, recorded)


def test_evidence(found):
    got = {(r.doc, r.place): (r.id.value, r.tier, r.confidence) for r in found.evidence.collect()}
    assert got[("meta", 1)] == ("10.1000/meta", 2, 2)
    assert got[("stamp", 1)][0] == "1706.03762" and got[("stamp", 1)][2] == 2
    assert got[("footer", 1)] == ("10.1234/own.doi", 6, 2)
    assert got[("agree", 1)] == ("10.1000/both", 5, 3)
    assert got[("1706.03762", 1)] == ("1706.03762", 0, 2)
    assert got[("links", 1)] == ("10.1000/link", 1, 3) and got[("links", 2)] == ("10.1000/far", 1, 0)
    docs = {doc for doc, _ in got}
    assert not docs & {"cited", "nothing", "stranger"}
    assert not any("never-read" in v for v, _, _ in got.values())


def test_later_stages_read_fewer_documents(found):
    asked = {}
    for r in found.asked.collect():
        asked.setdefault(r.stage, set()).add(r.doc)
    assert asked[4] == {"stamp", "footer", "cited", "agree", "nothing"}
    assert asked[5] == {"footer", "agree"} and asked[6] == {"footer", "agree"}
    assert asked[7] == {"cited", "nothing"}
    assert {r.op_key for r in found.asked.where("doc = 'footer'").collect()} == {"text-1-1-layout", "text-4-4", "text-1-4"}


def test_context_and_titles(found):
    context = {(r.doc, r.id.value): r.context for r in found.evidence.collect()}
    assert context["footer", "10.1234/own.doi"] == "repeated across pages (10.1234/own.doi)"
    assert context["meta", "10.1000/meta"] == "doi: 10.1000/meta"
    assert {r.doc: r.title for r in found.titles.collect()} == {"meta": "A Title", "1706.03762": "From packet", "cited": "Big Title"}


def test_empty(spark):
    pdfs = spark.createDataFrame([], "doc long, pdf string")
    out = identification.identify_documents(pdfs, spark.createDataFrame([], "pdf string, op_key string, text string, error string"))
    assert out.evidence.count() == out.asked.count() == out.titles.count() == 0
