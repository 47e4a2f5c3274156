"""The driver's star schema as a library of documents, a corpus and lists of candidates; SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per order: persons, tags, files and serials are arrays of its lineitems, never null."""
    orders, customer, nation, supplier, items = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "supplier", "lineitem"))
    lines = items.join(supplier, items.l_suppkey == supplier.s_suppkey, "left").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") - 1).alias("position"), F.col("s_name").alias("name")))).alias("suppliers"),
        F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_linestatus").alias("states"),
        F.array_sort(F.collect_list(F.when(F.col("l_quantity") > 45, F.col("l_linenumber")))).alias("attached"),
        F.collect_set(F.concat(F.lit("10."), (1000 + F.col("l_suppkey")).cast("string"), F.lit("/part."), F.col("l_partkey").cast("string"))).alias("dois"),
    )
    d = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").join(nation, F.col("c_nationkey") == nation.n_nationkey, "left").join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    key = F.col("o_orderkey")
    text = lambda c: F.coalesce(c, F.lit(""))
    authors = F.transform(F.coalesce("suppliers", F.array().cast("array<struct<position:int,name:string>>")), lambda s: F.struct(F.lit("author").alias("role"), s["position"].cast("int").alias("position"), s["name"].alias("name")))
    editors = F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit("editor").alias("role"), F.lit(0).alias("position"), F.col("c_name").alias("name")))).otherwise(F.array().cast("array<struct<role:string,position:int,name:string>>"))
    none = F.array().cast("array<string>")
    d = d.select(
        F.concat(F.lit("o"), key.cast("string")).alias("citekey"), F.concat(F.lit("lib/o"), key.cast("string")).alias("dir"),
        F.lower(F.substring("o_orderpriority", 3, 20)).alias("type"), F.concat("c_name", F.lit(" "), "c_mktsegment").alias("title"),
        F.when(key % 11 != 0, F.year("o_orderdate").cast("bigint")).alias("year"), F.when(key % 7 != 0, F.col("c_mktsegment")).alias("publisher"), F.col("n_name").alias("parent_title"),
        F.concat(authors, editors).alias("persons"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce("flags", none), F.coalesce("states", none)))).alias("tags"),
        F.transform(F.coalesce("attached", F.array().cast("array<int>")), lambda n: F.concat(F.lit("f"), n.cast("string"), F.lit(".pdf"))).alias("files"),
        F.concat(F.transform(F.array_sort(F.coalesce("dois", none)), lambda v: F.struct(F.lit("doi").alias("kind"), v.alias("value"))), F.array(F.struct(F.lit("isbn").alias("kind"), F.lpad(key.cast("string"), 10, "0").alias("value")))).alias("serials"),
    )
    words = F.concat_ws(" ", "citekey", text(F.col("title")), text(F.col("parent_title")), F.array_join(F.transform("persons", lambda p: p["name"]), " "), F.array_join("tags", " "))
    return d.withColumn("fts_norm", tx.full_text(words))


#: The same tables for DuckDB: one row per document, and its persons, tags, files and serials as rows.
LIBRARY_SQL = """
lib AS (SELECT 'o' || o_orderkey AS citekey, 'lib/o' || o_orderkey AS dir, lower(substr(o_orderpriority, 3)) AS type, c_name || ' ' || c_mktsegment AS title,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(year(o_orderdate) AS BIGINT) END AS year, CASE WHEN o_orderkey % 7 <> 0 THEN c_mktsegment END AS publisher, n_name AS parent_title, o_orderkey, o_orderstatus, c_name
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
persons AS (SELECT 'o' || l_orderkey AS citekey, 'author' AS role, l_linenumber - 1 AS position, s_name AS name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT citekey, 'editor', 0, c_name FROM lib WHERE o_orderstatus = 'F'),
tags AS (SELECT DISTINCT 'o' || l_orderkey AS citekey, l_returnflag AS tag FROM lineitem UNION SELECT DISTINCT 'o' || l_orderkey, l_linestatus FROM lineitem),
files AS (SELECT 'o' || l_orderkey AS citekey, l_linenumber AS n, 'f' || l_linenumber || '.pdf' AS path FROM lineitem WHERE l_quantity > 45),
serials AS (SELECT DISTINCT 'o' || l_orderkey AS citekey, 'doi' AS kind, '10.' || (1000 + l_suppkey) || '/part.' || l_partkey AS value FROM lineitem
  UNION ALL SELECT citekey, 'isbn', lpad(CAST(o_orderkey AS VARCHAR), 10, '0') FROM lib)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a library without persons, files or serials, for full-text terms."""
    d = table(spark, sf_dir, "documents")
    key = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    return d.select(
        key.alias("citekey"), F.concat(F.lit("lib/"), key).alias("dir"), F.col("lang").alias("type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("bigint").alias("year"),
        F.col("source").alias("publisher"), F.lit(None).cast("string").alias("parent_title"), F.array().cast("array<struct<role:string,position:int,name:string>>").alias("persons"),
        F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("files"), F.array().cast("array<struct<kind:string,value:string>>").alias("serials"),
        tx.full_text(F.concat_ws(" ", key, F.coalesce("text", F.lit("")))).alias("fts_norm"),
    )


CORPUS_SQL = r"""corpus AS (SELECT 'd' || doc_id AS citekey, lang AS type, source AS publisher, ' ' || trim(regexp_replace(lower(strip_accents('d' || doc_id || ' ' || coalesce(text, ''))), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS fts FROM documents)"""
