"""What one task holds: inputs of few bytes and much work are dealt out, sorts and batches are bounded."""

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from quillstack.functions import keys
from quillstack.operators import identification, identify
from quillstack.plans import q_records

SF = "/root/testdata/sf0.001"


def test_merged_fields_are_dealt_out(spark):
    assert q_records.fields(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_rank_sorts_all_rows_once(spark):
    rows = [(1, "a", 4, 0, 1, "p"), (1, "a", 5, 1, 0, "q"), (1, "b", 4, 2, 3, "r"), (1, "b", 4, None, 2, "s"), (2, "a", None, 1, 1, "t"), (2, "a", 6, 1, 2, "u"), (2, "c", 6, 2, 5, "v"), (2, "c", 6, 2, 4, "w")]
    ranked = identify.rank(spark.createDataFrame(rows, "doc int, id string, tier int, confidence int, seq int, context string"))
    assert ranked.columns == ["doc", "id", "tier", "confidence", "seq", "context", "place"]
    assert sorted(map(tuple, ranked.collect()), key=lambda r: (r[0], r[-1])) == [(1, "a", 4, 3, 1, "p", 1), (1, "b", 4, 2, 3, "r", 2), (2, "c", 6, 2, 4, "w", 1), (2, "a", None, 1, 1, "t", 2)]
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1


def test_normal_forms_in_parts(monkeypatch):
    texts = ["é x" * 50, None, "plain", "", "ﬁé" * 400] * 7
    monkeypatch.setattr(keys, "HELD", 300)
    monkeypatch.setattr(keys, "ROWS", 4)
    for form in ("NFC", "NFKD"):
        want = [None if t is None else unicodedata.normalize(form, t) for t in texts]
        assert keys._normalized(form, pa.array(texts)).to_pylist() == want
    assert keys._normalized("NFC", pa.array([], pa.string())).to_pylist() == []


def test_texts_are_dealt_out_before_they_are_searched(spark):
    texts = spark.range(300).coalesce(1).selectExpr("id AS doc", "concat('see 10.1000/x', id, ' and a-\n b') AS text")
    found = identification.text_evidence(texts, 7, F.lit(1))
    assert found.groupBy(F.spark_partition_id()).count().count() > 4
    assert {r.doc: r.n for r in found.groupBy("doc").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(range(300), 3)


def test_recorded_runs_are_made_once(spark):
    """Five stages read the runs; what they are made from is read by one job alone."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    pdfs = spark.createDataFrame([(i, f"{i}.pdf") for i in range(6)], "doc long, pdf string")
    rows = [(f"{i}.pdf", key, text, None) for i in range(6) for key, text in (("info", "Pages: 3"), ("text-1-1-layout", "none"), ("text-3-3", "|10.1000/x|"))]
    schema = "pdf string, op_key string, text string, error string"
    found = identification.identify_documents(pdfs, spark.createDataFrame(rows, schema).mapInArrow(count, schema))
    assert [r.id.value for r in found.evidence.collect()] == ["10.1000/x"] * 6
    assert made.value == len(rows)
