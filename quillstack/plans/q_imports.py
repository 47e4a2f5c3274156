"""Queries of imports, recorded answers and pacing, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import imports
from quillstack.plans.fixtures import LIBRARY_SQL, library, table
from quillstack.sources import responses

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


@query(
    "n_12_take_files",
    f"""WITH {LIBRARY_SQL} SELECT citekey, coalesce((SELECT list(path ORDER BY n) FROM files f WHERE f.citekey = l.citekey AND n <> 1), []) AS files,
  coalesce((SELECT list(f.citekey || '/sub/' || path ORDER BY n) FROM files f WHERE f.citekey = l.citekey AND n = 1), []) AS missing FROM lib l""",
)
def take_files(spark, sf):
    docs = library(spark, sf).select("citekey", F.transform("files", lambda f: F.concat(F.lit("sub/"), f)).alias("files"))
    listing = docs.select("citekey", F.explode("files").alias("path")).where("path <> 'sub/f1.pdf'")
    return imports.take_files(docs, listing)


@query(
    "n_14_ingest",
    "SELECT p_partkey AS ord, 'b' || p_size AS key, 'b' || p_size || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS citekey FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part WHERE p_partkey % 7 <> 0)",
)
def ingest(spark, sf):
    items = table(spark, sf, "part").selectExpr("p_partkey AS ord", "concat('b', p_size) AS key", "CASE WHEN p_partkey % 7 = 0 THEN 'broken' END AS error")
    return imports.ingest(items, items.selectExpr("'none' AS citekey"), "numeric")[0].select("ord", "key", "citekey")


_DIR = "CASE WHEN p_partkey % 50 = 0 THEN concat('lib/', cast(p_size as varchar(20))) ELSE concat('lib/', cast(p_size as varchar(20)), '/x', cast(p_partkey as varchar(20))) END"


@query("s_10_outermost", f"WITH d AS (SELECT p_partkey, {_DIR} AS dir FROM part) SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d e WHERE starts_with(d.dir, e.dir || '/'))")
def outermost(spark, sf):
    return imports.outermost(table(spark, sf, "part").selectExpr("p_partkey", f"{_DIR} AS dir")).select("p_partkey", "dir")


@query(
    "s_26_answers",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'cacheMiss' WHEN p_partkey % 5 = 0 THEN 'ok' WHEN p_partkey % 5 IN (1, 4) THEN 'notFound' WHEN p_partkey % 5 = 2 THEN 'rateLimited' ELSE 'status 500' END AS outcome,
  CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 5 = 0 THEN p_name END AS body FROM part""",
)
def answers(spark, sf):
    asked = table(spark, sf, "part").selectExpr("p_partkey", "p_brand AS provider", "concat('https://x.org/', p_partkey) AS url", "'application/json' AS accept", "p_name")
    now = asked.where("p_partkey % 6 <> 0").selectExpr("provider", "url", "accept", "p_name AS body", "get(array(200, 404, 429, 500, 410), cast(p_partkey % 5 AS int)) AS status", "1 AS stored")
    before = asked.where("p_partkey % 6 <> 0").selectExpr("provider", "url", "accept", "'old' AS body", "200 AS status", "0 AS stored")
    return responses.answered(asked.drop("p_name"), now.unionAll(before)).select("p_partkey", "outcome", "body")


_PACED = "SELECT o_orderkey AS ord, o_orderpriority AS peer, CAST(o_orderkey * 7919 % 100003 AS BIGINT) AS ready, CASE WHEN o_orderpriority = '1-URGENT' THEN 300 ELSE 20 END AS gap FROM orders"


@query("t_04_paced", f"WITH c AS (SELECT *, row_number() OVER w AS i FROM ({_PACED}) WINDOW w AS (PARTITION BY peer ORDER BY ready, ord)) SELECT ord, i * gap + max(ready - i * gap) OVER (PARTITION BY peer ORDER BY i) AS start FROM c")
def paced(spark, sf):
    calls = table(spark, sf, "orders").selectExpr("o_orderkey AS ord", "o_orderpriority AS peer", "o_orderkey * 7919L % 100003L AS ready")
    return responses.paced(calls, F.when(F.col("peer") == "1-URGENT", 300).otherwise(20)).select("ord", "start")


@query("s_24_tool_answers", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 THEN p_name END AS text, CASE WHEN p_partkey % 3 = 0 THEN 'nothing recorded for text-1-2-layout' WHEN p_partkey % 4 = 0 THEN 'cut' END AS error FROM part")
def tool_answers(spark, sf):
    key = responses.op_key("text", 1, 2, layout=True)
    asked = table(spark, sf, "part").selectExpr("p_partkey", "concat(p_partkey, '.pdf') AS pdf", f"'{key}' AS op_key", "p_name")
    recorded = asked.where("p_partkey % 3 <> 0").selectExpr("pdf", "op_key", "p_name AS text", "CASE WHEN p_partkey % 4 = 0 THEN 'cut' END AS error")
    return responses.tool_answers(asked.drop("p_name"), recorded).select("p_partkey", "text", "error")
