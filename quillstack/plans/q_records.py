"""Queries of identifier extraction, record normalisation, ranking, merging and keys, each with its SQL.

The star schema holds no identifiers, so texts are made from keys by the same rule here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import identifiers as ids
from quillstack.functions import keys as k
from quillstack.functions import records as rec
from quillstack.functions import text as tx
from quillstack.functions.similarity import jaro_winkler
from quillstack.operators import identify, merge, ranking, sync
from quillstack.plans.fixtures import CORPUS_SQL, LIBRARY_SQL, library, table
from quillstack.sources.tables import dealt

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def scalar(name: str, source: str, keys: str, inputs: str, column, sql: str):
    """A query of one function: ``inputs`` (an expression both engines know) as ``x``, the function as ``y``."""

    def run(spark, sf):
        return table(spark, sf, source).selectExpr(*keys.split(", "), f"{inputs} AS x").select(*keys.split(", "), column(F.col("x")).alias("y"))

    query(name, f"SELECT {keys}, {sql} AS y FROM (SELECT *, {inputs} AS x FROM {source})")(run)


LINE = "l_orderkey, l_linenumber"
TEXT = "concat('see (doi:10.', cast(1000 + l_suppkey as varchar(20)), '/P', cast(l_partkey as varchar(20)), '). arXiv:', cast(1000 + l_suppkey % 9000 as varchar(20)), '.', lpad(cast(l_partkey as varchar(20)), 5, '0'), 'v2; again 10.5555/[A', cast(l_linenumber as varchar(20)), ']>.')"
NUMBER = "lpad(cast((o_orderkey * 7919) % 10000000000 as varchar(20)), 10, '0')"
_TRIM = "regexp_replace(lower({0}), '[.,;:\"''\\-]+$', '')"

scalar("f_05_find_dois", "lineitem", LINE, TEXT, ids.find_dois, "['10.' || (1000 + l_suppkey) || '/p' || l_partkey, '10.5555/[a' || l_linenumber || ']']")
scalar("f_06_trim_doi", "part", "p_partkey", "concat('10.1000/(A', cast(p_partkey as varchar(20)), ')', CASE WHEN p_partkey % 3 = 0 THEN ').,' WHEN p_partkey % 3 = 1 THEN '];-' ELSE '' END)", ids.trim_doi, "'10.1000/(a' || p_partkey || ')'")
scalar("f_07_normalize_doi", "part", "p_partkey", "concat(CASE WHEN p_partkey % 4 = 0 THEN 'https://dx.doi.org/' WHEN p_partkey % 4 = 1 THEN ' http://doi.org/' WHEN p_partkey % 4 = 2 THEN 'x' ELSE '' END, '10.1234/Ab', cast(p_partkey as varchar(20)), '.')", ids.normalize_doi, "CASE WHEN p_partkey % 4 <> 2 THEN '10.1234/ab' || p_partkey END")
scalar("f_08_find_arxiv", "lineitem", LINE, TEXT, ids.find_arxiv, "[(1000 + l_suppkey % 9000) || '.' || lpad(CAST(l_partkey AS VARCHAR), 5, '0') || 'v2']")
scalar("f_09_arxiv_in_url", "part", "p_partkey", "concat('https://', CASE WHEN p_partkey % 2 = 0 THEN 'www.' ELSE '' END, 'arXiv.org/', CASE WHEN p_partkey % 3 = 0 THEN 'abs/' WHEN p_partkey % 3 = 1 THEN 'pdf/' ELSE 'list/' END, '2301.', lpad(cast(p_partkey as varchar(20)), 5, '0'), CASE WHEN p_partkey % 3 = 1 THEN '.pdf' ELSE '' END)", ids.arxiv_in_url, "CASE WHEN p_partkey % 3 <> 2 THEN '2301.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') END")
scalar("f_10_normalize_arxiv", "part", "p_partkey", "concat(CASE WHEN p_partkey % 2 = 0 THEN 'arXiv:' ELSE '' END, 'hep-th/', lpad(cast(p_partkey as varchar(20)), 7, '0'), CASE WHEN p_partkey % 5 = 0 THEN '.pdf' WHEN p_partkey % 5 = 1 THEN 'x' ELSE '' END)", ids.normalize_arxiv, "CASE WHEN p_partkey % 5 <> 1 THEN 'hep-th/' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END")

_S10 = "list_sum(list_transform(range(0, 10), lambda i: CAST(substr(x, CAST(i + 1 AS INT), 1) AS INT) * (10 - i)))"
_S13 = "list_sum(list_transform(range(0, {1}), lambda i: CAST(substr({0}, CAST(i + 1 AS INT), 1) AS INT) * (1 + 2 * (i % 2))))"
_TO13 = f"'978' || substr(x, 1, 9) || ((10 - {_S13.format("('978' || substr(x, 1, 9))", 12)} % 10) % 10)"
scalar("f_13_isbn10", "orders", "o_orderkey", NUMBER, ids.isbn10_ok, f"{_S10} % 11 = 0")
scalar("f_14_isbn13", "orders", "o_orderkey", f"concat('978', {NUMBER})", ids.isbn13_ok, f"{_S13.format('x', 13)} % 10 = 0")
scalar("f_15_isbn10_to_13", "orders", "o_orderkey", NUMBER, ids.isbn10_to_13, _TO13)
scalar("f_12_normalize_isbn", "orders", "o_orderkey", NUMBER, ids.normalize_isbn, f"CASE WHEN {_S10} % 11 = 0 THEN {_TO13} END")
scalar("f_11_find_isbns", "orders", "o_orderkey", NUMBER, lambda x: ids.find_isbns(F.concat(F.lit("Printed. ISBN-10: "), x, F.lit("\nall rights"))), f"CASE WHEN {_S10} % 11 = 0 THEN [{_TO13}] ELSE [] END")


@query("f_16_parse_identifier", f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'doi:10.1000/k' || o_orderkey WHEN 1 THEN 'pmid:' || o_orderkey WHEN 2 THEN 'arxiv:2001.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')
  WHEN 3 THEN CASE WHEN {_S10} % 11 = 0 THEN 'isbn:' || {_TO13} END END AS id FROM (SELECT *, {NUMBER} AS x FROM orders)""")
def parse_identifier(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" DOI: https://doi.org/10.1000/K"), key)).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("PMID: "), key))
    text = text.when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("2001."), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"))).when(F.col("o_orderkey") % 5 == 3, F.expr(NUMBER.replace("varchar(20)", "string"))).otherwise("nothing here")
    return o.select("o_orderkey", ids.display(ids.parse_identifier(text)).alias("id"))


@query("f_17_scan", "SELECT l_orderkey, l_linenumber, ['doi:10.' || (1000 + l_suppkey) || '/p' || l_partkey, 'doi:10.5555/[a' || l_linenumber || ']', 'arxiv:' || (1000 + l_suppkey % 9000) || '.' || lpad(CAST(l_partkey AS VARCHAR), 5, '0') || 'v2'] AS found FROM lineitem")
def scan(spark, sf):
    items = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{TEXT.replace('varchar(20)', 'string')} AS x")
    return items.select("l_orderkey", "l_linenumber", F.transform(ids.scan(F.col("x")), ids.display).alias("found"))


scalar("f_01_contains", "customer", "c_custkey", "c_name", lambda x: tx.contains_fold(x, "R#00000001"), "contains(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'r#00000001')")
scalar("f_02_exact", "customer", "c_custkey", "c_mktsegment", lambda x: x == "BUILDING", "x = 'BUILDING'")
scalar("f_19_repair", "documents", "doc_id", "concat(coalesce(text, ''), ' ﬁne­ﬂow a–b ﬃx')", lambda x: F.sha2(tx.repair(x).cast("binary"), 256), "sha256(coalesce(text, '') || ' fineflow a-b ffix')")
scalar("f_20_join_lines", "part", "p_partkey", "concat(p_name, '- \n  ', CASE WHEN p_partkey % 2 = 0 THEN 'joined' ELSE 'Kept' END)", tx.join_broken_lines, "CASE WHEN p_partkey % 2 = 0 THEN p_name || 'joined' ELSE p_name || '- \n  Kept' END")
scalar("f_21_squeeze", "documents", "doc_id", "coalesce(text, '')", lambda x: F.sha2(tx.squeeze(x).cast("binary"), 256), r"sha256(regexp_replace(x, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', '', 'g'))")
scalar("f_23_before_references", "part", "p_partkey", "concat(p_name, '\n', CASE WHEN p_partkey % 3 = 0 THEN ' 7. References:' WHEN p_partkey % 3 = 1 THEN 'LITERATUR' ELSE 'references here' END, '\n[1] x')", tx.before_references, "CASE WHEN p_partkey % 3 < 2 THEN p_name || '\n' ELSE x END")
scalar("s_22_pages", "documents", "doc_id", "concat(coalesce(text, ''), chr(12), source, chr(12), lang)", lambda x: F.transform(identify.pages_of(x), lambda p: F.sha2(p.cast("binary"), 256)), "list_transform(string_split(x, chr(12)), lambda p: sha256(p))")
scalar("u_03_ordered_distinct", "part", "p_partkey", "concat('10.1000/bb', cast(p_partkey % 7 as varchar(20)), ' 10.1000/aa, 10.1000/BB', cast(p_partkey % 3 as varchar(20)), '.')", ids.find_dois, "CASE WHEN p_partkey % 7 = p_partkey % 3 THEN ['10.1000/bb' || p_partkey % 7, '10.1000/aa'] ELSE ['10.1000/bb' || p_partkey % 7, '10.1000/aa', '10.1000/bb' || p_partkey % 3] END")
scalar("f_22_views", "part", "p_partkey", "concat('a–', p_name, '-\nb')", tx.views, "['a-' || p_name || '-\nb', 'a-' || p_name || 'b', 'a-' || replace(p_name, ' ', '') || '-b']")
scalar("f_27_filename", "part", "p_partkey", "concat('10.100200300_p_', lpad(cast(p_partkey as varchar(20)), 9, '0'))", lambda x: ids.display(identify.from_filename(x)), "'doi:10.100200300/p_' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')")
scalar("f_26_text_confidence", "lineitem", LINE, "l_linenumber", lambda x: identify.text_confidence(x + 3, F.col("l_linenumber") % 2), "CASE WHEN x + 3 = 4 AND l_linenumber % 2 = 1 THEN 2 WHEN x + 3 IN (4, 5, 6) THEN 1 ELSE 0 END")

# Records.
scalar("f_30_as_text", "part", "p_partkey", "CASE p_partkey % 5 WHEN 0 THEN concat('\"  ', p_name, '   x \"') WHEN 1 THEN concat(cast(p_size as varchar(20)), '.0') WHEN 2 THEN '[\" \", \"second\"]' WHEN 3 THEN '\"   \"' ELSE concat(cast(p_size as varchar(20)), '.5') END", rec.as_text, "CASE p_partkey % 5 WHEN 0 THEN p_name || ' x' WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'second' WHEN 3 THEN NULL ELSE p_size || '.5' END")


@query("f_31_name", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Acme Inc.' WHEN 1 THEN 'van ' || p_brand || ', Ada' WHEN 2 THEN p_brand || ', Jr., Ada' WHEN 3 THEN p_brand END AS name FROM part")
def name(spark, sf):
    n = F.col("p_partkey") % 5
    null = F.lit(None).cast("string")
    return table(spark, sf, "part").select("p_partkey", rec.name(F.when(n == 0, " Acme, Inc. "), F.when(n < 4, F.col("p_brand")), F.when(n.isin(1, 2), "Ada").otherwise(null), F.when(n.isin(2, 3), "Jr."), F.when(n == 1, " van")).alias("name"))


_DATE = "CASE p_partkey % 6 WHEN 0 THEN concat(cast(1900 + p_size as varchar(20)), '-05-17T00:00') WHEN 1 THEN '2001-11 online' WHEN 2 THEN 'June 5, 1997' WHEN 3 THEN concat('c', cast(1900 + p_size as varchar(20)), '?') WHEN 4 THEN '2001-13-01' ELSE 'undated' END"
scalar("f_32_iso_date", "part", "p_partkey", _DATE, rec.iso_of_text, "CASE p_partkey % 6 WHEN 0 THEN (1900 + p_size) || '-05-17' WHEN 1 THEN '2001-11' WHEN 3 THEN CAST(1900 + p_size AS VARCHAR) WHEN 4 THEN '2001' END")
scalar("f_33_is_iso_date", "part", "p_partkey", "concat('2001-', lpad(cast(p_partkey % 15 as varchar(20)), 2, '0'), '-', lpad(cast(p_size as varchar(20)), 2, '0'))", rec.is_iso_date, "p_partkey % 15 BETWEEN 1 AND 12 AND p_size BETWEEN 1 AND 31")
_KIND = "CASE p_partkey % 6 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'book-chapter' WHEN 2 THEN 'book' WHEN 3 THEN 'posted-content' WHEN 4 THEN 'speech' END"
scalar("f_34_types", "part", "p_partkey", _KIND, lambda x: F.concat_ws("/", rec.entry_type(x), rec.parent_type(x)), "CASE p_partkey % 6 WHEN 0 THEN 'misc' WHEN 1 THEN 'misc' WHEN 2 THEN 'book' WHEN 3 THEN 'misc' WHEN 4 THEN 'article/proceedings' ELSE 'article/periodical' END")
scalar("f_36_catalogue_type", "part", "p_partkey", _KIND, rec.catalogue_type, "CASE p_partkey % 6 WHEN 0 THEN 'article-journal' WHEN 1 THEN 'chapter' WHEN 2 THEN 'book' WHEN 3 THEN 'posted-content' WHEN 4 THEN 'speech' ELSE 'article-journal' END")
scalar("f_38_page_range", "part", "p_partkey", "concat(cast(p_size as varchar(20)), CASE WHEN p_partkey % 2 = 0 THEN ' – ' ELSE '--' END, cast(p_size + 9 as varchar(20)))", rec.page_range, "p_size || '-' || (p_size + 9)")
scalar("f_39_split_name", "part", "p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN concat('Ada M. ', p_brand) ELSE p_brand END", lambda x: F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in rec.split_name(x))), "CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|Ada M.|' ELSE '||' || p_brand END")
scalar("f_50_published_rank", "part", "p_partkey", _KIND, rec.published_rank, "CASE WHEN x = 'posted-content' THEN 0 ELSE 1 END")
scalar("a_10_citation_bucket", "orders", "o_orderkey", "o_custkey - 3", rec.citation_bucket, "CASE WHEN x > 0 THEN CAST(floor(log10(x)) AS INT) + 1 ELSE 0 END")
scalar("f_51_encode", "nation", "n_nationkey", "concat(n_name, ' é&*~+/')", rec.encode, "replace(n_name, ' ', '%20') || '%20%C3%A9%26%2A~%2B%2F'")
scalar("f_57_host", "pages", "page_id", "url", rec.host_of, "regexp_extract(regexp_replace(url, '^https?://', ''), '^[^/?#]*')")
scalar("f_56_pdf_form", "part", "p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'https://arxiv.org/abs/2301.12345' WHEN 1 THEN concat('https://openreview.net/forum?id=A', cast(p_partkey as varchar(20))) WHEN 2 THEN concat('https://www.biorxiv.org/content/', cast(p_partkey as varchar(20)), '/') ELSE 'https://x.org/a' END", rec.pdf_form, "CASE p_partkey % 4 WHEN 0 THEN 'https://arxiv.org/pdf/2301.12345' WHEN 1 THEN 'https://openreview.net/pdf?id=A' || p_partkey WHEN 2 THEN 'https://www.biorxiv.org/content/' || p_partkey || '.full.pdf' END")
scalar("f_55_pdf_sources", "part", "p_partkey", "concat('https://openreview.net/forum?id=', cast(p_partkey as varchar(20)))", lambda x: rec.pdf_sources(F.when(F.col("p_partkey") % 2 == 0, "2301.12345"), F.lit(" "), x), "CASE WHEN p_partkey % 2 = 0 THEN ['https://arxiv.org/pdf/2301.12345'] ELSE [] END || ['https://openreview.net/pdf?id=' || p_partkey, x]")
scalar("f_47_plain_title", "documents", "doc_id", "coalesce(text, '')", lambda x: F.sha2(rec.plain_title(x).cast("binary"), 256), r"sha256(trim(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g')))")
scalar("f_48_jaro_winkler", "part", "p_partkey", "concat(p_name, ' ', lower(p_brand))", lambda x: F.round(jaro_winkler(F.lit("small red ring brand"), x), 6), "round(jaro_winkler_similarity('small red ring brand', x), 6)")

CANDIDATE_SQL = """cand AS (SELECT p_partkey, 's' || p_partkey % 5 AS source, CAST(p_partkey % 5 AS INT) AS provider_ord, p_partkey AS pos, CASE WHEN p_partkey % 13 <> 0 THEN 'doi:10.1000/r' || p_partkey % 1000 END AS id,
  CASE WHEN p_type = 'PROMO' THEN 'posted-content' ELSE 'book' END AS kind, p_name || ' ' || p_brand AS title, CASE WHEN p_partkey % 3 <> 0 THEN [p_brand] ELSE [] END AS families,
  CASE WHEN p_partkey % 4 <> 0 THEN CAST(1950 + p_size AS VARCHAR) END AS issued, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS container, CASE WHEN p_partkey % 7 = 0 THEN '1-2' END AS page,
  CASE WHEN p_partkey % 5 = 0 THEN '7' END AS volume, p_brand AS publisher, CAST(NULL AS VARCHAR) AS abstract, CAST(p_size AS BIGINT) AS cited_by FROM part),
uniq AS (SELECT * FROM cand WHERE id IS NULL UNION ALL SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY provider_ord, pos) AS n FROM cand WHERE id IS NOT NULL) WHERE n = 1),
norm AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS got, 'small ring brand 2' AS want FROM uniq),
base AS (SELECT *, CASE WHEN got = want THEN 1.0 WHEN starts_with(got, want) THEN greatest(jaro_winkler_similarity(want, got), 0.95) ELSE jaro_winkler_similarity(want, got) END AS jw FROM norm),
scored AS (SELECT *, round(least(greatest(jw + CASE WHEN len(list_filter(families, lambda f: contains(trim(regexp_replace(lower(f), '[^a-z0-9]+', ' ', 'g')), 'brand 2'))) > 0 THEN 0.05 ELSE -0.05 END
  + CASE WHEN issued IS NULL THEN 0.0 WHEN starts_with(issued, '1961') THEN 0.05 ELSE -0.05 END, 0.0), 1.0), 6) AS score, CASE WHEN kind = 'posted-content' THEN 0 ELSE 1 END AS published,
  CASE WHEN cited_by > 0 THEN CAST(floor(log10(cited_by)) AS INT) + 1 ELSE 0 END AS cited, CAST(len(families) > 0 AS INT) + CAST(issued IS NOT NULL AS INT) + CAST(container IS NOT NULL AS INT) + CAST(page IS NOT NULL AS INT) + CAST(volume IS NOT NULL AS INT) + 1 AS complete FROM base),
turns AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, (id IS NOT NULL) DESC, published DESC, cited DESC, complete DESC, title NULLS FIRST, provider_ord, pos) AS turn,
  row_number() OVER (ORDER BY score DESC, (id IS NOT NULL) DESC, published DESC, cited DESC, complete DESC, title NULLS FIRST, provider_ord, pos) AS rnk FROM scored),
placed AS (SELECT *, dense_rank() OVER (ORDER BY best) AS source_ord FROM (SELECT *, min(rnk) OVER (PARTITION BY source) AS best FROM turns))"""
WANTED = ranking.Wanted("Small ring, Brand#2", "Brand#2", 1961, 25)


def candidates(spark, sf):
    n = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("s"), (n % 5).cast("string")).alias("source"), (n % 5).cast("int").alias("provider_ord"), n.alias("pos"), F.when(n % 13 != 0, F.concat(F.lit("doi:10.1000/r"), (n % 1000).cast("string"))).alias("id"),
        F.when(F.col("p_type") == "PROMO", "posted-content").otherwise("book").alias("kind"), F.concat("p_name", F.lit(" "), "p_brand").alias("title"), F.when(n % 3 != 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("families"),
        F.when(n % 4 != 0, (1950 + F.col("p_size")).cast("string")).alias("issued"), F.when(n % 2 == 0, F.col("p_type")).alias("container"), F.when(n % 7 == 0, "1-2").alias("page"), F.when(n % 5 == 0, "7").alias("volume"),
        F.col("p_brand").alias("publisher"), F.lit(None).cast("string").alias("abstract"), F.col("p_size").cast("bigint").alias("cited_by"),
    )


@query("w_01_first_by_id", f"WITH {CANDIDATE_SQL} SELECT p_partkey, id, source FROM uniq")
def first_by_id(spark, sf):
    return ranking.first_by_identifier(candidates(spark, sf)).select("p_partkey", "id", "source")


@query("f_49_score", f"WITH {CANDIDATE_SQL} SELECT p_partkey, score FROM scored")
def score(spark, sf):
    return ranking.scored(WANTED, candidates(spark, sf)).select("p_partkey", "score")


@query("a_09_completeness", f"WITH {CANDIDATE_SQL} SELECT p_partkey, complete FROM scored")
def completeness(spark, sf):
    return ranking.scored(WANTED, candidates(spark, sf)).select("p_partkey", "complete")


@query("o_03_rank_order", f"WITH {CANDIDATE_SQL} SELECT p_partkey, source, turn FROM turns")
def rank_order(spark, sf):
    return ranking.interleave(ranking.scored(WANTED, candidates(spark, sf))).select("p_partkey", "source", F.col("turn").cast("bigint").alias("turn"))


@query("w_03_interleave", f"WITH {CANDIDATE_SQL} SELECT p_partkey, CAST(turn AS INT) AS turn, CAST(source_ord AS INT) AS source_ord FROM placed")
def interleave(spark, sf):
    placed = ranking.interleave(ranking.scored(WANTED, candidates(spark, sf)))
    return placed.select("p_partkey", F.col("turn").cast("int").alias("turn"), F.col("source_ord").cast("int").alias("source_ord"))


@query("w_03_places", f"WITH {CANDIDATE_SQL} SELECT p_partkey, row_number() OVER (ORDER BY turn, source_ord) AS place FROM placed")
def places(spark, sf):
    return ranking.interleave(ranking.scored(WANTED, candidates(spark, sf))).select("p_partkey", "place")


@query("o_04_limit", f"WITH {CANDIDATE_SQL} SELECT p_partkey, score FROM placed ORDER BY turn, source_ord LIMIT 25")
def limited(spark, sf):
    return ranking.rank(WANTED, candidates(spark, sf)).select("p_partkey", "score")


@query("w_04_select", f"WITH {CANDIDATE_SQL} SELECT p_partkey, id FROM placed WHERE id IS NOT NULL ORDER BY turn, source_ord LIMIT 1 OFFSET 6")
def selected(spark, sf):
    return ranking.select(ranking.interleave(ranking.scored(WANTED, candidates(spark, sf))), 7).select("p_partkey", "id")


@query("u_01_union", f"WITH {CANDIDATE_SQL} SELECT p_partkey, source FROM cand UNION ALL SELECT p_partkey, 'again' FROM cand WHERE provider_ord = 4")
def union(spark, sf):
    c = candidates(spark, sf)
    return ranking.union([c, c.where("provider_ord = 4").withColumn("source", F.lit("again"))]).select("p_partkey", "source")


@query("f_42_record_identifier", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'doi:10.1000/d' || p_partkey WHEN p_partkey % 3 = 1 THEN 'arxiv:2301.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') ELSE 'isbn:9780201896831' END AS id FROM part")
def record_identifier(spark, sf):
    n, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    url = F.when(n % 3 < 2, F.concat(F.lit("http://arxiv.org/abs/2301."), F.lpad(key, 5, "0"))).otherwise("https://x.org")
    return table(spark, sf, "part").select("p_partkey", ids.display(ids.identifier_of_record(F.when(n % 3 == 0, F.concat(F.lit("10.1000/D"), key)), url, F.lit("0-201-89683-4"))).alias("id"))


@query("f_43_document_identifier", f"WITH {LIBRARY_SQL} SELECT citekey, coalesce((SELECT 'doi:' || min(value) FROM serials s WHERE s.citekey = d.citekey AND kind = 'doi'), (SELECT 'isbn:' || min(value) FROM serials s WHERE s.citekey = d.citekey AND kind = 'isbn')) AS id FROM lib d")
def document_identifier(spark, sf):
    first = lambda kind: F.get(F.filter("serials", lambda s: s["kind"] == kind), F.lit(0))["value"]
    return library(spark, sf).select("citekey", F.coalesce(*(F.concat(F.lit(f"{x}:"), first(x)) for x in ("doi", "arxiv", "isbn"))).alias("id"))


@query("f_44_arxiv_of", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '2001.00001' WHEN 1 THEN '2002.00002' ELSE '2003.00003' END AS arxiv FROM part")
def arxiv_of(spark, sf):
    n = F.col("p_partkey") % 3
    note = F.get(ids.find_arxiv(F.lit("see arXiv: 2003.00003 there")), F.lit(0))
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.when(n == 0, "2001.00001"), ids.arxiv_in_url(F.when(n < 2, "https://arxiv.org/abs/2002.00002")), note).alias("arxiv"))


@query("f_52_subtitle", f"WITH {LIBRARY_SQL} SELECT citekey, array_to_string(list_filter([CASE WHEN n > 0 THEN array_to_string(a[1:3], ', ') || CASE WHEN n > 3 THEN ' et al.' ELSE '' END END, CAST(year AS VARCHAR), parent_title], lambda x: x IS NOT NULL), ' · ') AS subtitle FROM lib LEFT JOIN (SELECT citekey, list(name ORDER BY position, name) AS a, count(*) AS n FROM persons WHERE role = 'author' GROUP BY citekey) USING (citekey)")
def subtitle(spark, sf):
    authors = F.transform(F.filter("persons", lambda p: p["role"] == "author"), lambda p: p["name"])
    return library(spark, sf).select("citekey", rec.subtitle(authors, F.col("year"), F.col("parent_title")).alias("subtitle"))


@query("f_53_result_id", f"WITH {LIBRARY_SQL} SELECT citekey, coalesce((SELECT 'doi:' || min(value) FROM serials s WHERE s.citekey = d.citekey AND kind = 'doi'), citekey) AS id FROM lib d")
def result_id(spark, sf):
    first = lambda kind: F.get(F.filter("serials", lambda s: s["kind"] == kind), F.lit(0))["value"]
    return library(spark, sf).select("citekey", F.coalesce(*(F.concat(F.lit(f"{x}:"), first(x)) for x in ("doi", "arxiv")), "citekey").alias("id"))


@query("f_54_web_rows", f"WITH {CANDIDATE_SQL} SELECT p_partkey, id, title FROM cand WHERE id IS NOT NULL")
def web_rows(spark, sf):
    return candidates(spark, sf).where(F.col("id").isNotNull() & F.col("title").isNotNull()).select("p_partkey", "id", "title")


@query("j_05_present", f"WITH {LIBRARY_SQL}, own AS (SELECT 'doi:' || value AS id, min(citekey) AS owner FROM serials WHERE kind = 'doi' GROUP BY value) SELECT p_partkey, owner, owner IS NOT NULL AS in_library FROM (SELECT p_partkey, 'doi:10.' || (1001 + p_partkey % 10) || '/part.' || p_partkey AS id FROM part) LEFT JOIN own USING (id)")
def present(spark, sf):
    n = F.col("p_partkey")
    wanted = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("doi:10."), (1001 + n % 10).cast("string"), F.lit("/part."), n.cast("string")).alias("id"))
    return ranking.present(wanted, sync.owners(library(spark, sf))).select("p_partkey", "owner", "in_library")


# Merging.
FIELD_SQL = """fields AS (SELECT p_partkey AS record, f AS field, CAST(s AS INT) AS provider_ord, 'p' || s AS source, CASE WHEN (p_partkey + s * 3 + length(f)) % 4 <> 0 THEN f || s || '-' || p_brand END AS value
  FROM part, (VALUES (0), (1), (2)) t(s), (VALUES ('title'), ('publisher'), ('parent'), ('serial-number')) u(f))"""


def fields(spark, sf):
    # A part becomes twelve rows, so parts are dealt out first.
    f = dealt(table(spark, sf, "part").select("p_partkey", "p_brand")).select(F.col("p_partkey").alias("record"), "p_brand", F.explode(F.array(*map(F.lit, ("title", "publisher", "parent", "serial-number")))).alias("field"))
    f = f.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("provider_ord"))
    s = F.col("provider_ord").cast("string")
    there = (F.col("record") + F.col("provider_ord") * 3 + F.length("field")) % 4 != 0
    return f.select("record", "field", "provider_ord", F.concat(F.lit("p"), s).alias("source"), F.when(there, F.concat("field", s, F.lit("-"), "p_brand")).alias("value"))


@query("a_06_first_wins", f"WITH {FIELD_SQL} SELECT record, field, min_by(value, provider_ord) AS value, min_by(source, provider_ord) AS source FROM fields WHERE value IS NOT NULL GROUP BY ALL")
def first_wins(spark, sf):
    return merge.merge(fields(spark, sf))


@query("a_07_provenance", f"WITH {FIELD_SQL}, m AS (SELECT record, field, min_by(source, provider_ord) AS source FROM fields WHERE value IS NOT NULL GROUP BY ALL) SELECT record, string_agg(field || '=' || source, ',' ORDER BY field) AS provenance FROM m GROUP BY record")
def provenance(spark, sf):
    p = merge.provenance(merge.merge(fields(spark, sf)))
    return p.select("record", F.array_join(F.transform(F.map_entries("provenance"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("provenance"))


@query("a_08_consulted", f"WITH {FIELD_SQL} SELECT record, ['p0', 'p1', 'p2'] AS sources FROM fields GROUP BY record")
def consulted(spark, sf):
    return merge.consulted(fields(spark, sf))


_UPDATE = """loc AS (SELECT p_partkey AS doc, f AS field, CASE WHEN p_partkey % 3 = 0 THEN 'same' ELSE 'old' END AS value FROM part, (VALUES ('title'), ('note')) u(f)),
fresh AS (SELECT p_partkey AS doc, f AS field, 'same' AS value, 'crossref' AS source FROM part, (VALUES ('title'), ('note'), ('page-range'), ('x-meta')) u(f)), known AS (SELECT p_partkey AS doc, 'title' AS field FROM part WHERE p_partkey % 2 = 0)"""
_UPDATED = f"WITH {_UPDATE} SELECT coalesce(l.doc, f.doc) AS doc, coalesce(l.field, f.field) AS field, CASE WHEN l.doc IS NULL OR k.doc IS NOT NULL THEN coalesce(f.value, l.value) ELSE l.value END AS value, (l.doc IS NULL OR k.doc IS NOT NULL) AND f.value IS NOT NULL AND f.value IS DISTINCT FROM l.value AS changed FROM loc l FULL JOIN (SELECT * FROM fresh WHERE field <> 'x-meta') f ON l.doc = f.doc AND l.field = f.field LEFT JOIN known k ON k.doc = coalesce(l.doc, f.doc) AND k.field = coalesce(l.field, f.field)"


def updated(spark, sf):
    p = table(spark, sf, "part")
    each = lambda *names: F.explode(F.array(*map(F.lit, names))).alias("field")
    doc = F.col("p_partkey").alias("doc")
    local = p.select(doc, F.when(F.col("p_partkey") % 3 == 0, "same").otherwise("old").alias("value"), each("title", "note"))
    fresh = p.select(doc, F.lit("same").alias("value"), F.lit("crossref").alias("source"), each("title", "note", "page-range", "x-meta"))
    return merge.update(local, fresh, p.where("p_partkey % 2 = 0").select(doc, F.lit("title").alias("field")))


@query("n_07_update", _UPDATED)
def update(spark, sf):
    return updated(spark, sf).select("doc", "field", "value", "changed")


@query("n_08_provenance_update", f"SELECT doc, field, 'crossref' AS source FROM ({_UPDATED}) WHERE changed")
def provenance_update(spark, sf):
    return updated(spark, sf).where("changed").select("doc", "field", "source")


@query("n_05_with_identifiers", "SELECT p_partkey, 'mine' AS doi, 'b' || p_partkey AS isbn FROM part")
def with_identifiers(spark, sf):
    mine, more = F.create_map(F.lit("doi"), F.lit("mine")), F.create_map(F.lit("doi"), F.lit("other"), F.lit("isbn"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")))
    m = merge.with_identifiers(mine, more)
    return table(spark, sf, "part").select("p_partkey", m["doi"].alias("doi"), m["isbn"].alias("isbn"))


@query("n_06_overlay", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'flag' ELSE p_name END AS title, coalesce(CASE WHEN p_size > 25 THEN p_type END, 'article') AS type FROM part")
def overlay(spark, sf):
    return table(spark, sf, "part").select("p_partkey", merge.overlay(F.when(F.col("p_partkey") % 2 == 0, "flag"), F.col("p_name")).alias("title"), merge.overlay(F.lit(None).cast("string"), F.when(F.col("p_size") > 25, F.col("p_type")), F.lit("article")).alias("type"))


@query("n_15_allowed", "SELECT p_partkey, list_filter(['arxiv', 'openalex', 'url'], lambda x: x <> CASE WHEN p_partkey % 2 = 0 THEN 'openalex' ELSE '' END) AS allowed FROM part")
def allowed(spark, sf):
    configured = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("url"), F.lit("arxiv"))).otherwise(F.array(F.lit("url"), F.lit("openalex"), F.lit("arxiv")))
    return table(spark, sf, "part").select("p_partkey", F.filter(F.array(F.lit("arxiv"), F.lit("openalex"), F.lit("url")), lambda s: F.array_contains(configured, s)).alias("allowed"))


# Identification.
EVIDENCE_SQL = """ev AS (SELECT l_orderkey AS doc, 'doi:' || l_partkey % 3 AS id, CAST(l_linenumber AS INT) AS tier, CAST(l_suppkey % 3 AS INT) AS confidence, l_linenumber AS seq FROM lineitem),
agree AS (SELECT *, CASE WHEN (SELECT count(DISTINCT tier) FROM ev e WHERE e.doc = ev.doc AND e.id = ev.id) > 1 THEN 3 ELSE confidence END AS conf FROM ev)"""


def evidence(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("doi:"), (F.col("l_partkey") % 3).cast("string")).alias("id"), F.col("l_linenumber").cast("int").alias("tier"), (F.col("l_suppkey") % 3).cast("int").alias("confidence"), F.col("l_linenumber").alias("seq"))


@query("w_02_best_evidence", f"WITH {EVIDENCE_SQL} SELECT doc, id, tier, conf AS confidence, CAST(row_number() OVER (PARTITION BY doc ORDER BY conf DESC, tier, id) AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc, id ORDER BY conf DESC, tier, seq) AS n FROM agree) WHERE n = 1")
def best_evidence(spark, sf):
    return identify.rank(evidence(spark, sf)).select("doc", "id", "tier", "confidence", "place")


@query("a_03_distinct_tiers", f"WITH {EVIDENCE_SQL} SELECT doc, id, count(DISTINCT tier) > 1 AS agreed FROM ev GROUP BY ALL")
def distinct_tiers(spark, sf):
    return evidence(spark, sf).groupBy("doc", "id").agg((F.countDistinct("tier") > 1).alias("agreed"))


@query("a_04_repeated", "SELECT doc, doi, count(DISTINCT page) AS pages FROM (SELECT l_orderkey AS doc, l_linenumber AS page, '10.1000/p' || l_partkey % 2 AS doi FROM lineitem) GROUP BY ALL HAVING count(DISTINCT page) >= 3")
def repeated(spark, sf):
    text = F.concat(F.lit("10.1000/P"), (F.col("l_partkey") % 2).cast("string"), F.lit(". and 10.1000/P"), (F.col("l_partkey") % 2).cast("string"))
    return identify.repeated_dois(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), text.alias("text")))


# Keys.
_SLUG = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', '-', 'g'), '-')"
HEADLINE = "concat(CASE WHEN p_partkey % 3 = 0 THEN 'The ' WHEN p_partkey % 3 = 1 THEN 'On the ' ELSE '' END, p_name, ' Ünit-', cast(p_size as varchar(20)))"
_REST = "p_name || ' Ünit-' || p_size"
scalar("f_59_slug", "part", "p_partkey", HEADLINE, k.slug, _SLUG.format("x"))
scalar("f_60_words", "part", "p_partkey", HEADLINE, lambda x: k.words(x, 2), "array_to_string(string_split(x, ' ')[1:2], '')")
scalar("f_61_word", "part", "p_partkey", HEADLINE, lambda x: k.word(x, 4), "coalesce(string_split(x, ' ')[4], '')")
scalar("f_62_abbrev", "part", "p_partkey", HEADLINE, lambda x: k.abbrev(x, 7), "substr(x, 1, 7)")
scalar("f_63_nostop", "part", "p_partkey", HEADLINE, k.nostop, _REST)
scalar("f_64_alnum", "part", "p_partkey", HEADLINE, lambda x: F.concat(k.alnum(x), F.lit("|"), k.nospace(x)), r"regexp_replace(x, '[^\p{L}\p{N}]+', '', 'g') || '|' || replace(x, ' ', '')")
scalar("f_65_titlecase", "part", "p_partkey", HEADLINE, k.titlecase, "array_to_string(list_transform(string_split(x, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")
scalar("f_66_initial", "part", "p_partkey", "p_name", k.initial, "x[1]")
scalar("f_72_alpha_suffix", "part", "p_partkey", "p_partkey", lambda x: k.alpha_suffix(x), "CASE WHEN x < 26 THEN chr(CAST(97 + x AS INT)) WHEN x < 702 THEN chr(CAST(97 + x // 26 - 1 AS INT)) || chr(CAST(97 + x % 26 AS INT)) ELSE chr(CAST(97 + (x // 26 - 1) // 26 - 1 AS INT)) || chr(CAST(97 + (x // 26 - 1) % 26 AS INT)) || chr(CAST(97 + x % 26 AS INT)) END")
scalar("f_71_sanitize", "part", "p_partkey", "concat(p_name, '!:', cast(p_size as varchar(20)), '.:')", lambda x: k.sanitize(x, 14), "rtrim(substr(replace(p_name, ' ', '') || ':' || p_size || '.:', 1, 14), '.:')")


@query("f_67_render", f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'bjornson' || (1950 + p_size) || string_split(p_name, ' ')[1] WHEN 1 THEN 'dahl' || (1950 + p_size) ELSE substr({_SLUG.format('p_name')}, 1, 24) || (1950 + p_size) END AS citekey FROM part")
def render(spark, sf):
    n = F.col("p_partkey") % 3
    none = F.array().cast("array<string>")
    authors, editors = F.when(n == 0, F.array(F.lit("Bjørnson"))).otherwise(none), F.when(n == 1, F.array(F.lit("Dahl"))).otherwise(none)
    return table(spark, sf, "part").select("p_partkey", k.default_key(authors, editors, 1950 + F.col("p_size"), F.concat(F.lit("The "), "p_name")).alias("citekey"))
