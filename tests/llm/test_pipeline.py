"""The pipeline's stages on the smallest tables: columns, decisions and whole results."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from quillstack.llm import common, decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        n = docs.count()
        assert 0 < n <= left, name
        left = n
        if name == "quality":
            kept = {r.doc_id for r in docs.collect()}
            clean = [d for d, q in quality.items() if q == 1]
            assert sum(d in kept for d in clean) >= 0.97 * len(clean)
    tests = decontaminate.TestSuffixes(items, 10)
    assert all(not s for s, _, _ in decontaminate.search(tests, [decontaminate.words((r.text or "").encode()) for r in docs.collect()]))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == left


@pytest.mark.parametrize("name", ["op2_sharding", "op4_decontamination", "op9_url_filter"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == names
    rows = lambda rs, cols: sorted(repr([r[cols.index(n)] for n in names]) for r in rs)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)
