"""The queries over documents that digest whole texts, against Python."""

import hashlib

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def title(t):
    return " ".join("".join(c if c.isalpha() or c.isnumeric() else " " for c in t.lower()).split())


@pytest.mark.parametrize("name, want", [
    ("f_47_plain_title", lambda d: sha(title(d.text or ""))),
    ("s_22_pages", lambda d: [sha(p) for p in f"{d.text or ''}\f{d.source}\f{d.lang}".split("\f")]),
])
def test_whole_texts(spark, name, want):
    docs = {d.doc_id: want(d) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {x.doc_id: x.y for x in __spark_entry__.queries()[name](spark, SF).collect()}
    assert got == docs
