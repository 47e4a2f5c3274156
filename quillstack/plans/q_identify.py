"""Identification over the star schema: an order is a PDF, its lineitems are its pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators import identification
from quillstack.plans.fixtures import table
from quillstack.sources.tables import dealt

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, n, text): an order's lineitems as pages. Every page cites its part and supplier; the last but one shows the
    order's own DOI in a line, as every page does for each third order; a list of references follows for each seventh."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", "l_suppkey")
    own = F.concat(F.lit("\n|10.5555/o"), F.col("doc").cast("string"), F.lit("|"))
    page = F.concat(F.lit("See |10."), (F.col("l_suppkey") + 1000).cast("string"), F.lit("/Part."), F.col("l_partkey").cast("string"), F.lit("|."), F.when(F.col("doc") % 3 == 0, own).otherwise(F.lit("")))
    pages = dealt(items, "doc").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", page.alias("text")))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\f")
    return pages.select("doc", F.size("p").alias("n"), F.concat(body, F.when(F.col("doc") % 7 == 0, F.lit("\nReferences\n|10.7777/cited|")).otherwise(F.lit(""))).alias("text"))


PAGED_SQL = """cited AS (SELECT l_orderkey AS doc, '10.' || (l_suppkey + 1000) || '/part.' || l_partkey AS doi, count(*) AS pages FROM lineitem GROUP BY ALL),
own AS (SELECT l_orderkey AS doc, '10.5555/o' || l_orderkey AS doi, count(*) AS pages FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL),
held AS (SELECT *, pages >= 3 AS repeated FROM (SELECT * FROM cited UNION ALL SELECT * FROM own))"""


@query("f_29_from_text", f"WITH {PAGED_SQL} SELECT doc, doi, max(CASE WHEN repeated THEN 2 ELSE 0 END) AS confidence FROM held GROUP BY doc, doi")
def from_text(spark, sf):
    texts = paged(spark, sf)
    found = identification.text_evidence(texts, 7, F.col("n"))
    return found.groupBy("doc", F.col("id.value").alias("doi")).agg(F.max("confidence").alias("confidence"))


def recorded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents, recorded runs): of six orders one is named by its dictionary, one by its first page, one by its last
    page and front matter together, one by a repeated line of the full scan, one by its file's name, one by nothing."""
    texts = paged(spark, sf_dir)
    doc, n, kind = F.col("doc"), F.col("n"), F.col("doc") % 6
    key = doc.cast("string")
    texts = texts.withColumn("pdf", F.when(kind == 4, F.concat(F.lit("in/10.4444_f00000000"), key, F.lit(".pdf"))).otherwise(F.concat(F.lit("in/o"), key, F.lit(".pdf"))))
    doi = lambda prefix: F.concat(F.lit(f"{prefix}"), key)
    run = lambda op, text: F.struct(op.alias("op_key"), text.alias("text"))
    front = F.concat(F.lit("text-1-"), F.least(n, F.lit(6)).cast("string"))
    last = F.concat(F.lit("text-"), n.cast("string"), F.lit("-"), n.cast("string"))
    full = F.concat(F.lit("text-1-"), F.least(n, F.lit(40)).cast("string"))
    runs = F.array(
        run(F.lit("info"), F.concat(F.lit("Title: T"), key, F.lit("\nPages: "), n.cast("string"))),
        run(F.lit("info-custom"), F.when(kind == 0, F.concat(F.lit("doi: "), doi("10.1111/c")))),
        run(F.lit("text-1-1-layout"), F.when(kind == 1, F.concat(F.lit("arXiv:1706."), F.lpad((doc % 100000).cast("string"), 5, "0"))).otherwise(F.lit("no mark"))),
        run(last, F.when((kind == 2) & (n > 1), F.concat(F.lit("|"), doi("10.2222/l"), F.lit("|")))),
        run(full, F.when(kind == 3, F.col("text")).when((kind == 2) & (n > 1), F.concat(F.lit("|"), doi("10.2222/l"), F.lit("|"))).when(kind == 1, "|10.9999/unread|")),
        # Orders have seven lineitems at most, so a front matter of six pages is another run than the full scan of seven.
        run(front, F.when((kind == 2) & (n > 6), F.concat(F.lit("|"), doi("10.2222/l"), F.lit("|")))),
    )
    rows = texts.select("pdf", F.explode(F.filter(runs, lambda r: r["text"].isNotNull())).alias("r")).select("pdf", "r.op_key", "r.text", F.lit(None).cast("string").alias("error"))
    return texts.select("doc", "pdf"), rows


IDENTIFY_SQL = f"""WITH {PAGED_SQL},
d AS (SELECT l_orderkey AS doc, count(*) AS n, l_orderkey % 6 AS kind FROM lineitem GROUP BY ALL),
found AS (
  SELECT doc, 'doi' AS id_kind, '10.1111/c' || doc AS value, 2 AS tier, 2 AS confidence FROM d WHERE kind = 0
  UNION ALL SELECT doc, 'arxiv', '1706.' || lpad(CAST(doc % 100000 AS VARCHAR), 5, '0'), 4, 2 FROM d WHERE kind = 1
  UNION ALL SELECT doc, 'doi', '10.2222/l' || doc, 5, 3 FROM d WHERE kind = 2 AND n > 1
  UNION ALL SELECT doc, 'doi', '10.4444/f00000000' || doc, 0, 2 FROM d WHERE kind = 4
  UNION ALL SELECT doc, 'doi', doi, CASE WHEN n BETWEEN 2 AND 6 THEN 6 ELSE 7 END, CASE WHEN repeated THEN 2 WHEN n BETWEEN 2 AND 6 THEN 1 ELSE 0 END FROM d JOIN held USING (doc) WHERE kind = 3),
agreed AS (SELECT f.doc, id_kind, value, tier, CASE WHEN kind = 3 AND n = 2 THEN 3 ELSE confidence END AS confidence FROM found f JOIN d USING (doc))"""


@query("w_07_identify", f"{IDENTIFY_SQL} SELECT doc, id_kind, value, tier, confidence, CAST(row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, tier, value) AS INT) AS place FROM agreed")
def identified(spark, sf):
    found = identification.identify_documents(*recorded(spark, sf)).evidence
    return found.select("doc", F.col("id.kind").alias("id_kind"), "id.value", "tier", "confidence", "place")
