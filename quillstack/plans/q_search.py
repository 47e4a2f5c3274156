"""Queries of the search language, joins, aggregates and listings over the library, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.operators import fulltext, sync, versions
from quillstack.plans import predicates, querylang
from quillstack.plans.fixtures import CORPUS_SQL, LIBRARY_SQL, corpus, library
from quillstack.sources.tables import shared_path

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz"


def _has(column: str, text: str) -> str:
    return f"contains(translate({column}, '{UP}'), '{text.lower()}')"


def _exists(table: str, condition: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} x WHERE x.citekey = d.citekey AND {condition})"


def _author(text: str) -> str:
    return _exists("persons", f"x.role = 'author' AND {_has('x.name', text)}")


#: Name: (query, SQL condition over the library).
SEARCHES = {
    "q_10_all": ("", "true"),
    "q_11_and_or_not": ("(author:000000001 OR author:supplier#000000007) year:<1996 -type:urgent", f"({_author('000000001')} OR {_author('supplier#000000007')}) AND year <= 1995 AND NOT ({_has('type', 'urgent')})"),
    "q_11_not_null": ("NOT publisher:building", f"NOT ({_has('publisher', 'building')})"),
    "q_11_not_exists": ("NOT author:00000000", f"NOT {_author('00000000')}"),
    "q_13_key": ("key:o11", _has("citekey", "o11")),
    "q_13_key_exact": ('citekey:"o32"', "citekey = 'o32'"),
    "q_14_type": ("type:HIGH", _has("type", "high")),
    "q_15_title": ("title:customer#00000001", _has("title", "customer#00000001")),
    "q_15_title_literal": ("title:%", "contains(title, '%')"),
    "q_16_publisher": ("publisher:Auto", _has("publisher", "auto")),
    "q_17_parent": ('journal:_1 OR in:"NATION_2"', f"{_has('parent_title', '_1')} OR parent_title = 'NATION_2'"),
    "q_18_year": ("year:1994-1996", "year BETWEEN 1994 AND 1996"),
    "q_18_year_open": ("date:>=1997", "year >= 1997"),
    "q_18_year_empty": ("year:1995--1996", "year BETWEEN 1995 AND -1996"),
    "q_19_author": ("author:SUPPLIER#00000000", _author("supplier#00000000")),
    "q_20_editor": ("editor:customer#00000001", _exists("persons", f"x.role = 'editor' AND {_has('x.name', 'customer#00000001')}")),
    "q_21_person": ("by:000000009", _exists("persons", _has("x.name", "000000009"))),
    "q_22_tag": ("tag:R tag:f", f"{_exists('tags', _has('x.tag', 'r'))} AND {_exists('tags', _has('x.tag', 'f'))}"),
    "q_23_doi": ("doi:10.1001/part.1", _exists("serials", f"x.kind = 'doi' AND {_has('x.value', '10.1001/part.1')}")),
    "q_24_arxiv": ("arxiv:1706", _exists("serials", "x.kind = 'arxiv' AND contains(x.value, '1706')")),
    "q_25_isbn": ("isbn:00123", _exists("serials", "x.kind = 'isbn' AND contains(x.value, '00123')")),
    "q_26_id": ("serial:1001", _exists("serials", "contains(x.value, '1001')")),
    "q_27_file": ("file:yes year:1995", f"{_exists('files', 'true')} AND year = 1995"),
    "q_27_no_file": ("has:pdf", f"NOT {_exists('files', 'true')}"),
    "j_01_semi": ("editor:1 OR NOT author:2", f"""{_exists("persons", "x.role = 'editor' AND contains(x.name, '1')")} OR NOT {_author("2")}"""),
    "j_02_semi_kind": ("doi:10.1003 tag:o", f"""{_exists("serials", "x.kind = 'doi' AND contains(x.value, '10.1003')")} AND {_exists("tags", _has("x.tag", "o"))}"""),
    "j_03_anti": ("file:no tag:A", f"NOT {_exists('files', 'true')} AND {_exists('tags', _has('x.tag', 'a'))}"),
    "o_01_order": ("year:1998", "year = 1998"),
}
#: Name: (query, SQL condition over the corpus).
FULL_TEXT = {
    "q_28_prefix": ("théat", "contains(fts, ' theat')"),
    "q_29_phrase": ('"of the"', "contains(fts, ' of the ')"),
    "q_30_membership": ("idiot -clown publisher:src1", "contains(fts, ' idiot') AND NOT contains(fts, ' clown') AND contains(publisher, 'src1')"),
    "q_30_empty": ('-"!!!" type:fr', "contains(type, 'fr')"),
    "f_03_full_text": ("que-se", "contains(fts, ' que se')"),
    "j_04_in": ('"ciónue" OR d1', "contains(fts, ' cionue ') OR contains(fts, ' d1')"),
}


def _search(query: str, source):
    columns = ("citekey", "dir", "title", "year", "type") if source is library else ("citekey", "type", "publisher")
    return lambda spark, sf: predicates.search(source(spark, sf), query, columns)


def _indexed(query: str):
    """The query answered from postings that are built for it; no text is read after that."""
    return lambda spark, sf: fulltext.search(fulltext.build(corpus(spark, sf), shared_path(spark, "fulltext")), query, ("citekey", "type", "publisher"))


QUERIES = {name: _search(query, library) for name, (query, _) in SEARCHES.items()} | {name: _indexed(query) for name, (query, _) in FULL_TEXT.items()}
ORACLE_SQL = {name: f"WITH {LIBRARY_SQL} SELECT citekey, dir, title, year, type FROM lib d WHERE {sql} ORDER BY citekey" for name, (_, sql) in SEARCHES.items()} | {
    name: f"WITH {CORPUS_SQL} SELECT citekey, type, publisher FROM corpus WHERE {sql} ORDER BY citekey" for name, (_, sql) in FULL_TEXT.items()
}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {LIBRARY_SQL} {sql}" if " lib" in sql or "serials" in sql else sql
        return f

    return add


@query("q_32_hits", "SELECT citekey, dir, title, year, type FROM lib d WHERE year >= 1996 AND type = 'urgent' ORDER BY citekey")
def hits(spark, sf):
    return predicates.search(library(spark, sf), 'year:1996- type:"urgent"')


@query("q_33_by_serial", "SELECT citekey FROM serials WHERE kind = 'doi' AND value = '10.1001/part.1' ORDER BY citekey")
def by_serial(spark, sf):
    return sync.by_serial(library(spark, sf), "doi", "10.1001/part.1")


@query("s_06_get", "SELECT citekey, title FROM lib WHERE citekey = 'o7'")
def get(spark, sf):
    return library(spark, sf).where(F.col("citekey") == "o7").select("citekey", "title").limit(1)


@query("a_01_count", "SELECT count(*) AS n FROM lib")
def count(spark, sf):
    return library(spark, sf).agg(F.count("*").alias("n"))


@query("k_11_keys", "SELECT citekey FROM lib WHERE parent_title = 'NATION_3' ORDER BY citekey")
def keys(spark, sf):
    return predicates.search(library(spark, sf), 'parent:"NATION_3"', ("citekey",))


@query("k_12_table", "SELECT citekey || repeat(' ', greatest(0, 28 - length(citekey))) || '  ' || coalesce(CAST(year AS VARCHAR), '----') || '  ' || coalesce(title, '—') AS line FROM lib")
def listing(spark, sf):
    d = library(spark, sf)
    key = F.when(F.length("citekey") < 28, F.rpad("citekey", 28, " ")).otherwise(F.col("citekey"))
    return d.select(F.concat(key, F.lit("  "), F.coalesce(F.col("year").cast("string"), F.lit("----")), F.lit("  "), F.coalesce("title", F.lit("—"))).alias("line"))


@query("o_02_scan_order", "SELECT citekey FROM lib ORDER BY citekey")
def scan_order(spark, sf):
    return library(spark, sf).select("citekey").orderBy("citekey")


@query("j_05_first_owner", "SELECT kind, value, min(citekey) AS citekey FROM serials GROUP BY kind, value")
def first_owner(spark, sf):
    return sync.owners(library(spark, sf))


@query(
    "j_06_duplicates",
    "SELECT p_partkey, min(citekey) AS citekey FROM (SELECT p_partkey, '10.' || (1001 + p_partkey % 10) || '/part.' || p_partkey AS doi FROM part) JOIN serials ON kind = 'doi' AND value = doi GROUP BY p_partkey",
)
def duplicates(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    wanted = part.select("p_partkey", F.lit("doi").alias("kind"), F.concat(F.lit("10."), (1001 + F.col("p_partkey") % 10).cast("string"), F.lit("/part."), F.col("p_partkey").cast("string")).alias("value"))
    return wanted.join(sync.owners(library(spark, sf)), ["kind", "value"]).select("p_partkey", "citekey")


@query("j_08_key_list", "SELECT t.pos, citekey, title FROM (VALUES (0, 'o39'), (1, 'o3'), (2, 'o7'), (3, 'o1')) t(pos, k) JOIN lib ON citekey = k ORDER BY pos")
def key_list(spark, sf):
    return sync.by_keys(library(spark, sf), ["o39", "o3", "o7", "o1"]).select("pos", "citekey", "title")


@query("o_07_first_serial", "SELECT citekey, min(value) AS doi FROM serials WHERE kind = 'doi' GROUP BY citekey")
def first_serial(spark, sf):
    return library(spark, sf).select("citekey", F.filter("serials", lambda s: s["kind"] == "doi").alias("d")).where(F.size("d") > 0).select("citekey", F.col("d")[0]["value"].alias("doi"))


_SNAPSHOT = "SELECT 'o' || o_orderkey AS citekey, o_orderstatus || o_custkey AS content FROM orders"
_KNOWN = f"known AS (SELECT citekey, sha256(content) AS hash, length(content) AS size FROM ({_SNAPSHOT} WHERE o_orderkey % 13 <> 0))"
_NOW = "now AS (SELECT citekey, sha256(content) AS hash, length(content) AS size FROM (SELECT 'o' || o_orderkey AS citekey, o_orderstatus || (o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS content FROM orders WHERE o_orderkey % 17 <> 0))"
_STATUS = f"WITH {_KNOWN}, {_NOW} SELECT coalesce(n.citekey, k.citekey) AS citekey, CASE WHEN n.citekey IS NULL THEN 'removed' WHEN k.citekey IS NULL OR k.hash <> n.hash OR k.size <> n.size THEN 'indexed' ELSE 'unchanged' END AS status FROM now n FULL JOIN known k ON n.citekey = k.citekey"


def _snapshots(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    key, state = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("citekey"), F.col("o_orderstatus")
    known = o.where("o_orderkey % 13 <> 0").select(key, F.concat(state, F.col("o_custkey").cast("string")).alias("content"))
    now = o.where("o_orderkey % 17 <> 0").select(key, F.concat(state, (F.col("o_custkey") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0)).cast("string")).alias("content"))
    return sync.fingerprints(known), sync.fingerprints(now)


@query("t_01_sync", _STATUS)
def sync_status(spark, sf):
    known, now = _snapshots(spark, sf)
    return sync.classify(known, now)


@query("j_07_fingerprints", _STATUS.replace("AS status FROM", "AS status, n.hash FROM"))
def sync_hashes(spark, sf):
    known, now = _snapshots(spark, sf)
    return sync.classify(known, now, "hash")


@query("a_02_report", f"SELECT count(*) FILTER (WHERE status = 'indexed') AS indexed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'removed') AS removed FROM ({_STATUS})")
def sync_report(spark, sf):
    known, now = _snapshots(spark, sf)
    return sync.report(sync.classify(known, now)).select("indexed", "unchanged", "removed")


@query("u_02_difference", f"WITH {_KNOWN}, {_NOW} SELECT citekey FROM known WHERE citekey NOT IN (SELECT citekey FROM now)")
def stale(spark, sf):
    known, now = _snapshots(spark, sf)
    return known.select("citekey").join(now, "citekey", "left_anti")


@query("u_06_idempotent", "SELECT DISTINCT citekey, kind, value FROM serials")
def idempotent(spark, sf):
    return sync.serial_rows(library(spark, sf)).distinct()


_ORDERS = "SELECT o_orderkey, 'o' || o_orderkey AS citekey, o_orderstatus AS type, o_custkey AS holder FROM orders"


def _records(spark, sf, more=0):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select("o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("citekey"), F.col("o_orderstatus").alias("type"), (F.col("o_custkey") + more).alias("holder"))


def _filled(spark, sf):
    """An index of all orders but each 13th, then a batch that changes each fifth, adds each 13th and takes each 17th away."""
    index, docs = shared_path(spark, "versions"), _records(spark, sf)
    n = F.col("o_orderkey")
    versions.commit(index, docs.where(n % 13 != 0).drop("o_orderkey"), source="orders", batch=0)
    changed = _records(spark, sf, 1).where(((n % 5 == 0) | (n % 13 == 0)) & (n % 17 != 0))
    for _ in range(2):  # the second time it is known, and nothing is written
        versions.commit(index, changed.drop("o_orderkey"), docs.where(n % 17 == 0), "orders", 1)
    return index


_MERGED = f"SELECT citekey, type, holder + CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS holder FROM ({_ORDERS}) WHERE o_orderkey % 17 <> 0"


@query("k_01_merge_on_read", _MERGED)
def merge_on_read(spark, sf):
    return versions.current(spark, _filled(spark, sf)).drop("_bucket")


@query("k_03_reset", f"SELECT citekey, type, holder FROM ({_ORDERS}) WHERE o_orderkey % 3 = 0")
def reset(spark, sf):
    index = _filled(spark, sf)
    versions.reset(spark, index)
    versions.commit(index, _records(spark, sf).where(F.col("o_orderkey") % 3 == 0).drop("o_orderkey"), source="orders", batch=0)
    return versions.current(spark, index).drop("_bucket")
