"""Keys without collisions, labels, targets, evidence, bodies and settings."""

import json

import pytest
from pyspark.sql import functions as F

from quillstack.functions import labels
from quillstack.operators import collisions, merge
from quillstack.operators import documents as docs
from quillstack.sources import catalogues, config


def serial(bases, taken, suffix):
    used, out = set(taken), []
    for b in bases:
        n, key = -1, b
        while key in used:
            n += 1
            key = b + suffix(n)
        used.add(key)
        out.append(key)
    return out


@pytest.mark.parametrize("policy", ["alpha", "numeric"])
def test_collisions_are_served_in_order(spark, policy):
    bases, taken = ["x", "xa", "x", "y", "x", "x-2", "x", "xa"], ["y", "xb"]
    suffix = (lambda n: chr(97 + n)) if policy == "alpha" else (lambda n: f"-{n + 2}")
    claims = spark.createDataFrame(list(zip(bases, range(len(bases)))), "base string, ord int")
    got = collisions.disambiguate(claims, spark.createDataFrame([(t,) for t in taken], "citekey string"), policy)
    assert [r.key for r in got.orderBy("ord").collect()] == serial(bases, taken, suffix)
    with pytest.raises(ValueError):
        collisions.disambiguate(claims, claims.select(F.lit("z").alias("citekey")), "error")


def test_labels(spark):
    assert labels.problem_of("einstein1905") is None and labels.problem_of("müller:2020-a_b.c") is None
    assert labels.problem_of("") == "empty" and labels.problem_of("a b") == "invalid-char:1: " and labels.problem_of("a.") == "trailing:."
    assert labels.folder("1905/x//y") == ["1905", "x", "y"]
    for bad in ("", "/", "a/../b"):
        with pytest.raises(ValueError):
            labels.folder(bad)
    df = spark.createDataFrame([("ok",), ("a b",), ("there",)], "citekey string")
    good, refused = collisions.new_documents(df, df.where("citekey = 'there'"))
    assert [r.citekey for r in good.collect()] == ["ok"] and {r.citekey: r.reason for r in refused.collect()} == {"a b": "invalid-char:1: ", "there": "exists"}


def test_evidence(spark):
    links = spark.createDataFrame([("d", 1, "https://doi.org/10.1000/own"), ("d", 9, "https://doi.org/10.1000/cited"), ("d", 1, "https://x.org/10.1000/no")], "doc string, page int, uri string")
    assert sorted((r.id.value, r.confidence) for r in docs.from_annotations(links).collect()) == [("10.1000/cited", 0), ("10.1000/own", 3)]
    pairs = spark.createDataFrame([("d", "Subject", "10.1000/xyz"), ("d", "doi", "10.1000/xyz")], "doc string, key string, value string")
    assert sorted(r.confidence for r in docs.from_info(pairs).collect()) == [1, 2] and sorted(r.confidence for r in docs.from_xmp(pairs).collect()) == [1, 3]
    s = spark.createDataFrame([("a" * 50 + "\nneedle\n" + "b" * 50, "needle"), ("x", "y")], "t string, n string").select(docs.snippet(F.col("t"), F.col("n"))).collect()
    assert s[0][0] == "a" * 30 + " needle " + "b" * 29 and s[1][0] == "y"


def test_bodies_and_upgrade(spark):
    feed = spark.createDataFrame([("<entry><id>x/1</id><title>Pre</title><summary>S</summary><doi>10.1/J</doi></entry>",)], "body string")
    pre = catalogues.arxiv_atom(feed).selectExpr("'r' AS record", "0 AS provider_ord", "*")
    work = spark.createDataFrame([(json.dumps({"message": {"items": [{"type": "journal-article", "title": "Published", "container-title": "J", "volume": "7", "DOI": "10.1/J"}]}}),)], "body string")
    journal = catalogues.crossref(work).selectExpr("'10.1/j' AS record", "0 AS provider_ord", "*")
    short = docs.upgraded(pre, journal)
    assert short.count() == 1  # too short to be a DOI
    long = docs.upgraded(pre.withColumn("doi", F.lit("10.1234/Jour")), journal.withColumn("record", F.lit("10.1234/jour")))
    merged = {r.field: (json.loads(r.value), r.source) for r in merge.merge(docs.body_fields(long, "record")).collect()}
    assert merged["title"] == (["Published"], "crossref") and merged["abstract"] == (["S"], "arxiv")
    assert merged["parent"][0] == {"type": "periodical", "title": "J", "volume": "7"} and merged["type"][0] == ["article"]


def test_targets(spark):
    lib = spark.createDataFrame([("a", "one", ["x/p.pdf"]), ("b", "two", [])], "citekey string, title string, files array<string>").withColumn("fts_norm", F.concat(F.lit(" "), "citekey", F.lit(" "), "title", F.lit(" ")))
    assert [r.citekey for r in docs.select(lib, ["b", "a"]).collect()] == ["b", "a"]
    assert [r.citekey for r in docs.select(lib, ["tw"]).collect()] == ["b"]
    assert docs.export_selection(lib).count() == 2
    for bad in ({"query": "zzz"}, {"keys": ["a", "q"]}):
        with pytest.raises(ValueError):
            docs.export_selection(lib, **bad)
    there = docs.attachments(lib, lib.select("citekey", F.lit("y").alias("path"))).collect()
    assert [(r.citekey, r.present) for r in there] == [("a", False)]
    assert {r.citekey: r.path for r in docs.nth_file(lib, 1).collect()} == {"a": "x/p.pdf", "b": None}
    answers = spark.createDataFrame([(1, 0, 5.0), (1, 1, 4.0), (1, 2, 1.0)], "query int, provider_ord int, seconds double")
    assert [r.used for r in docs.within_budget(answers, 8).orderBy("provider_ord").collect()] == [True, True, False]
    m = spark.range(1).select(docs.overlay_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"))).alias("m")).first().m
    assert m == {"a": "9", "b": "2"}


def test_settings():
    got = config.load(["[a]\nx = 1\ny = 2", "[a]\ny = 3"], "APP", {"APP_A__X": "7", "APP_NAME": "free text", "OTHER": "1"})
    assert got == {"a": {"x": 7, "y": 3}, "name": "free text"}
    assert config.size("100MB") == 100 << 20 and config.size("1.5 KiB") == 1536 and config.size(7) == 7
    with pytest.raises(ValueError):
        config.size("ten")
    assert config.split("""a 'b c' "" d"e f"g""") == ["a", "b c", "", "de fg"]
    assert config.fnv1a(b"") == 0xCBF29CE484222325 and config.fnv1a(b"a") == 0xAF63DC4C8601EC8C
