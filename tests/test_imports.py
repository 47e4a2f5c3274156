"""Imports, recorded answers and pacing on small tables, against plain loops."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quillstack.operators import imports
from quillstack.sources import responses


def write(root, place, text):
    path = root / place
    os.makedirs(path.parent, exist_ok=True)
    path.write_text(text)


def test_walk(spark, tmp_path):
    write(tmp_path, "a/info.yaml", "title: One\nref: one2001\nyear: 2001\nauthor: A and B\n")
    write(tmp_path, "a/info.yml", "title: Not this\n")
    write(tmp_path, "a/inner/info.yml", "title: Below a document\n")
    write(tmp_path, "deep/b/info.yml", "title: Two\nref: 7\n")
    write(tmp_path, "ab/info.yml", "a: [")
    write(tmp_path, ".git/info.yml", "title: Hidden\n")
    got = {r.key: r for r in imports.flat_library(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["ab", "b", "one2001"]
    assert got["ab"].error and got["ab"].body is None
    body = json.loads(got["one2001"].body)
    assert (body["title"], body["author"], body["date"]) == ("One", ["A", "B"], "2001")


def test_ingest(spark):
    items = spark.createDataFrame([(1, "k", None), (2, "k", None), (3, "bad", "not an entry"), (4, None, None), (5, "k", None), (6, "free", None)], "ord int, key string, error string")
    index = spark.createDataFrame([("k",), ("ka",)], "citekey string")
    good, refused = imports.ingest(items, index)
    assert {r.ord: r.citekey for r in good.collect()} == {1: "kb", 2: "kc", 5: "kd", 6: "free"}
    assert sorted((r.key, r.reason) for r in refused.collect() if r.key) == [("bad", "not an entry")] and refused.count() == 2
    with pytest.raises(ValueError):
        imports.ingest(items.where("ord = 3"), index)
    assert imports.ingest(items.limit(0), index)[0].count() == 0


def test_take_files(spark):
    docs = spark.createDataFrame([("a", ["x/1.pdf", "2.pdf", "..", "x/3.pdf/"]), ("b", []), ("c", ["gone.pdf", "gone.pdf"])], "citekey string, files array<string>")
    listing = spark.createDataFrame([("a", "x/1.pdf"), ("a", "x/3.pdf/"), ("a", "x/1.pdf"), ("b", "2.pdf")], "citekey string, path string")
    got = {r.citekey: (r.files, r.missing) for r in imports.take_files(docs, listing).collect()}
    assert got == {"a": (["1.pdf", "3.pdf"], ["a/2.pdf"]), "b": ([], []), "c": ([], ["c/gone.pdf", "c/gone.pdf"])}


def test_answers(spark):
    asked = spark.createDataFrame([(1, "p", "u", "json"), (2, "p", "u", "bib"), (3, "p", None, "json")], "n int, provider string, url string, accept string")
    stored = spark.createDataFrame([("p", "u", "json", "old", 200, 1), ("p", "u", "json", "gone", 410, 2), ("p", "u", "bib", "@b", 200, 1), ("p", None, "json", "never", 200, 1)], "provider string, url string, accept string, body string, status int, stored int")
    assert sorted((r.n, r.outcome, r.body) for r in responses.answered(asked, stored).collect()) == [(1, "notFound", None), (2, "ok", "@b"), (3, "cacheMiss", None)]
    names = [r.c for r in asked.select(responses.cache_name(F.col("provider"), F.col("url"), F.col("accept")).alias("c"), "n").orderBy("n").collect()]
    assert names[2] is None and names[0] != names[1] and names[0].startswith("p-") and len(names[0]) == len("p-") + 16 + len(".txt")


def test_pacing(spark):
    rows = [(p, (i * 37) % 101, i) for p in ("x", "y") for i in range(60)]
    calls = spark.createDataFrame(rows, "peer string, ready long, ord long")
    got = {(r.peer, r.ord): r.start for r in responses.paced(calls, F.when(F.col("peer") == "x", 5).otherwise(0)).collect()}
    for peer, gap in (("x", 5), ("y", 0)):
        last = None
        for p, ready, i in sorted(r for r in rows if r[0] == peer):
            last = ready if last is None else max(ready, last + gap)
            assert got[peer, i] == last
