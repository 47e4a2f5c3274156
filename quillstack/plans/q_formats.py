"""Queries of sources, evidence, documents and index upkeep, each with its SQL. Texts and answers are made from the rows
of the star schema, so what they say follows from those rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstack.functions import identifiers as ids
from quillstack.functions import keys as k
from quillstack.functions import labels
from quillstack.operators import collisions, documents, sync
from quillstack.plans.fixtures import LIBRARY_SQL, library, table
from quillstack.sources import catalogues, pdftext

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return add


def part(spark, sf, **columns: str):
    return table(spark, sf, "part").selectExpr("p_partkey", *(f"{v} AS {n}" for n, v in columns.items()))


# Texts of PDF tools.
_INFO = "concat('Title:  ', p_name, ': ', p_brand, '\n\nPages: 7\nPages: ', cast(p_size as varchar(20)), CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE '' END, '\nEmpty:\nno colon')"


@query("s_19_info", "SELECT p_partkey, p_name || ': ' || p_brand AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS pages, CAST(2 AS INT) AS n FROM part")
def info(spark, sf):
    i = part(spark, sf, i=_INFO).select("p_partkey", pdftext.info(F.col("i")).alias("i"))
    return i.select("p_partkey", F.col("i")["Title"].alias("title"), pdftext.page_count(F.col("i")).alias("pages"), F.size("i").alias("n"))


@query("f_24_page_count", "SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS pages FROM part")
def page_count(spark, sf):
    return part(spark, sf, i=_INFO).select("p_partkey", pdftext.page_count(pdftext.info(F.col("i"))).alias("pages"))


_URLS = "concat('Page  Type          URL\n   ', cast(p_size as varchar(20)), '  Annotation    https://doi.org/10.1000/p', cast(p_partkey as varchar(20)), '\n  17  Other  y\n   2  Annotation  https://x.org/', p_brand, '  ')"


@query("s_20_urls", "SELECT p_partkey, [p_size || ' https://doi.org/10.1000/p' || p_partkey, '2 https://x.org/' || p_brand] AS found FROM part")
def urls(spark, sf):
    return part(spark, sf, u=_URLS).select("p_partkey", F.transform(pdftext.urls(F.col("u")), lambda r: F.concat_ws(" ", r["page"].cast("string"), r["uri"])).alias("found"))


@query("s_21_xmp", "SELECT p_partkey, '10.1000/p' || p_partkey AS doi, p_name || ' & ' || p_brand AS title FROM part")
def xmp(spark, sf):
    p = part(spark, sf, x="concat('<x:xmpmeta><rdf:Description prism:doi=\"10.1000/p', cast(p_partkey as string), '\"><dc:title><rdf:Alt><rdf:li>', p_name, ' &amp; ', p_brand, '</rdf:li></rdf:Alt></dc:title><pdfx:cut')")
    return p.select("p_partkey", pdftext.xmp(F.col("x")).alias("m")).select("p_partkey", F.col("m")["doi"].alias("doi"), F.col("m")["title"].alias("title"))


_PAGE = """concat('<page width="600" height="800"><line yMin="20" yMax="28"><word>Journal</word></line><line yMin="100" yMax="', cast(110 + p_size as string), '"><word>', p_brand, '</word><word>&amp; co</word></line><line yMin="',
  CASE WHEN p_partkey % 3 = 0 THEN '400" yMax="' ELSE concat(cast(112 + p_size as string), '" yMax="') END, CASE WHEN p_partkey % 3 = 0 THEN cast(410 + p_size as string) WHEN p_partkey % 3 = 1 THEN cast(122 + 2 * p_size as string) ELSE cast(114 + p_size as string) END,
  '"><word>', p_name, '</word></line><line yMin="700" yMax="799"><word>Foot</word></line></page>')"""


def pages(spark, sf):
    return part(spark, sf, x=_PAGE).select("p_partkey", pdftext.layout("x").alias("page"))


@query("s_23_layout", "SELECT p_partkey, 800.0::DOUBLE AS height, ['Journal', p_brand || ' & co', p_name, 'Foot'] AS lines FROM part")
def layout(spark, sf):
    return pages(spark, sf).select("p_partkey", F.col("page.height").alias("height"), F.transform("page.lines", lambda x: x["text"]).alias("lines"))


@query("a_05_max_line_height", "SELECT p_partkey, CAST(greatest(99, 10 + p_size) AS DOUBLE) AS height FROM part")
def max_height(spark, sf):
    return pages(spark, sf).select("p_partkey", pdftext.max_line_height(F.col("page.lines")).alias("height"))


_TITLE = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 AND 10 + p_size >= 8 THEN p_brand || ' & co ' || p_name ELSE p_brand || ' & co' END AS title FROM part"


@query("f_25_geometry_title", _TITLE)
def geometry_title(spark, sf):
    return pages(spark, sf).select("p_partkey", pdftext.geometry_title(F.col("page")).alias("title"))


@query("w_05_runs", _TITLE)
def runs(spark, sf):
    return geometry_title(spark, sf)


# Catalogue answers.
def answers(spark, sf, body: str):
    return table(spark, sf, "part").selectExpr(f"{body} AS body")


_ITEM = "named_struct('type', CASE WHEN p_partkey % 2 = 0 THEN 'journal-article' ELSE 'book' END, 'title', array(concat(' ', p_name, '  x')), 'volume', p_size, 'DOI', concat('10.1000/P', p_partkey), 'author', array(named_struct('family', p_brand, 'given', 'A.', 'suffix', 'Jr.')), 'issued', named_struct('date-parts', array(array(1900 + p_size, 6))))"
_CSL = "SELECT '10.1000/P' || p_partkey AS doi, {0} AS kind, p_name || ' x' AS title, CAST(p_size AS VARCHAR) AS volume, (1900 + p_size) || '-06' AS issued, p_brand || '/A./Jr.' AS who FROM part"
_CSL_KIND = "CASE WHEN p_partkey % 2 = 0 THEN '{0}' ELSE 'book' END"


def csl_rows(records):
    a = F.get("authors", F.lit(0))
    return records.select("doi", "kind", "title", "volume", "issued", F.concat_ws("/", a["family"], a["given"], a["suffix"]).alias("who"))


@query("s_11_csl_json", _CSL.format(_CSL_KIND.format("journal-article")))
def csl_json(spark, sf):
    return csl_rows(catalogues.csl_json(answers(spark, sf, f"to_json(array({_ITEM}))")))


@query("s_12_work_list", _CSL.format(_CSL_KIND.format("article-journal")))
def work_list(spark, sf):
    return csl_rows(catalogues.crossref(answers(spark, sf, f"to_json(named_struct('message', named_struct('items', array({_ITEM}))))")))


@query("s_12_single_work", _CSL.format(_CSL_KIND.format("article-journal")))
def single_work(spark, sf):
    return csl_rows(catalogues.crossref(answers(spark, sf, f"to_json(named_struct('message', {_ITEM}))")))


@query("s_13_works", "SELECT '10.1000/p' || p_partkey AS doi, p_name AS title, p_size || '-' || (p_size + 9) AS page, p_mfgr AS container, CAST(p_size AS BIGINT) AS cited_by FROM (SELECT *, p_type AS p_mfgr FROM part)")
def works(spark, sf):
    body = "to_json(named_struct('results', array(named_struct('title', p_name, 'doi', concat('https://doi.org/10.1000/P', p_partkey), 'cited_by_count', p_size, 'biblio', named_struct('first_page', cast(p_size as string), 'last_page', cast(p_size + 9 as string)), 'primary_location', named_struct('source', named_struct('display_name', p_type))))))"
    return catalogues.openalex(answers(spark, sf, body)).select("doi", "title", "page", "container", "cited_by")


_FEED = "concat('<feed><entry><id>http://arxiv.org/abs/2001.', lpad(p_partkey, 5, '0'), 'v2</id><title>', p_name, '\n &amp; ', p_brand, '</title><published>', 1950 + p_size, '-06-12T00:00:00Z</published><author><name>Ada ', p_brand, '</name></author></entry><entry><title>Error</title></entry></feed>')"
_ATOM = "SELECT 'https://arxiv.org/abs/2001.' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || 'v2' AS url, p_name || ' & ' || p_brand AS title, (1950 + p_size) || '-06-12' AS issued FROM part"


@query("s_14_atom", _ATOM)
def atom(spark, sf):
    return catalogues.arxiv_atom(answers(spark, sf, _FEED)).select("url", "title", "issued")


@query("s_18_volumes", "SELECT p_name AS title, (1950 + p_size) || '-07-01' AS issued FROM part")
def volumes(spark, sf):
    return catalogues.google_books(answers(spark, sf, "to_json(named_struct('items', array(named_struct('volumeInfo', named_struct('title', p_name, 'publishedDate', concat(1950 + p_size, '-07-01'))))))")).select("title", "issued")


@query("s_08_bibtex", "SELECT key, title, year, error FROM (SELECT 'k' || p_partkey % 7 AS key, p_name || ' & ' || p_brand AS title, CAST(1950 + p_size AS VARCHAR) AS year, NULL AS error FROM part UNION ALL SELECT NULL, NULL, NULL, 'unread' FROM part WHERE p_partkey % 3 = 0)")
def bibtex(spark, sf):
    body = r"concat('@book{k', p_partkey % 7, ', title = {', p_name, ' \\& {', p_brand, '}}, year = ', 1950 + p_size, '}', CASE WHEN p_partkey % 3 = 0 THEN '\n@misc{broken, title = {x' ELSE '' END)"
    found = catalogues.from_texts(answers(spark, sf, body), "bibtex")
    return found.select("key", F.get_json_object("body", "$.title").alias("title"), F.get_json_object("body", "$.date").alias("year"), F.when(F.col("error").isNotNull(), "unread").alias("error"))


@query("s_09_yaml", "SELECT 'k' || p_partkey AS key, 'book' AS type, p_name AS title FROM part")
def yaml(spark, sf):
    found = catalogues.from_texts(answers(spark, sf, "concat('k', p_partkey, ':\n  type: book\n  title: \"', p_name, '\"\n')"), "yaml")
    return found.select("key", F.get_json_object("body", "$.type").alias("type"), F.get_json_object("body", "$.title").alias("title"))


# Evidence and documents.
@query("f_28_annotations", "SELECT l_orderkey AS doc, 'doi:10.' || (1000 + l_suppkey) || '/p' || l_partkey AS id, CAST(CASE WHEN l_linenumber = 1 THEN 3 ELSE 0 END AS INT) AS confidence FROM lineitem WHERE l_partkey % 2 = 0")
def annotations(spark, sf):
    uri = "CASE WHEN l_partkey % 2 = 0 THEN concat('https://doi.org/10.', 1000 + l_suppkey, '/P', l_partkey) ELSE 'https://x.org/10.1000/1' END"
    links = table(spark, sf, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS page", f"{uri} AS uri")
    return documents.from_annotations(links).select("doc", ids.display(F.col("id")).alias("id"), "confidence")


@query("f_18_snippet", "SELECT p_partkey, trim(substr(p_name, 1, 5)) AS s FROM part")
def snippet(spark, sf):
    needle = F.left("p_name", F.lit(5))
    return table(spark, sf, "part").select("p_partkey", documents.snippet(F.concat(F.lit("\n"), needle, F.lit("\r")), needle).alias("s"))


@query("n_10_identifier_only", "SELECT p_partkey, '{\"type\":\"misc\",\"serial-number\":{\"doi\":\"10.1000/p' || p_partkey || '\"}}' AS body FROM part")
def identifier_only(spark, sf):
    ident = ids.parse_identifier(F.concat(F.lit("doi:10.1000/P"), F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").select("p_partkey", documents.identifier_only(ident).alias("body"))


@query("o_06_nth_file", f"WITH {LIBRARY_SQL} SELECT citekey, (SELECT list(path ORDER BY n)[2] FROM files f WHERE f.citekey = l.citekey) AS path FROM lib l")
def nth_file(spark, sf):
    return documents.nth_file(library(spark, sf), 2)


@query("n_13_attachments", f"WITH {LIBRARY_SQL} SELECT citekey, path, n <> 1 AS present FROM files")
def attachments(spark, sf):
    docs = library(spark, sf)
    listing = docs.select("citekey", F.explode("files").alias("path")).where("path <> 'f1.pdf'")
    return documents.attachments(docs, listing)


@query("t_03_budget", "SELECT p_brand AS query, p_partkey AS provider_ord, coalesce(sum(CAST(p_size AS DOUBLE)) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 600 AS used FROM part")
def budget(spark, sf):
    asked = table(spark, sf, "part").selectExpr("p_brand AS query", "p_partkey AS provider_ord", "cast(p_size AS double) AS seconds")
    return documents.within_budget(asked, 600).select("query", "provider_ord", "used")


_MAPS = "SELECT p_partkey, p_brand AS a, CASE WHEN p_partkey % 2 = 0 THEN 'over' ELSE p_name END AS b, 'new' AS c FROM part"


@query("u_04_map_union", _MAPS)
def map_union(spark, sf):
    base, over = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_name")), F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("b"), F.lit("over"), F.lit("c"), F.lit("new"))).otherwise(F.create_map(F.lit("c"), F.lit("new")))
    m = documents.overlay_maps(base, over)
    return table(spark, sf, "part").select("p_partkey", *(m[x].alias(x) for x in "abc"))


@query("f_69_normalize", "SELECT doc_id, sha256(nfc_normalize(coalesce(text, ''))) AS y FROM documents")
def normalize(spark, sf):
    text = k.normalize(k.normalize(F.coalesce("text", F.lit("")), "nfd"), "nfc")
    return table(spark, sf, "documents").select("doc_id", F.sha2(text.cast("binary"), 256).alias("y"))


@query("f_70_label", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'trailing:.' WHEN 1 THEN 'invalid-char:' || length(split_part(p_name, ' ', 1)) || ': ' END AS problem FROM part WHERE contains(p_name, ' ')")
def label(spark, sf):
    n = F.col("p_partkey") % 3
    text = F.when(n == 0, F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit("."))).when(n == 1, F.col("p_name")).otherwise(F.concat(F.lit("k:"), F.col("p_partkey").cast("string")))
    return table(spark, sf, "part").where(F.contains("p_name", F.lit(" "))).select("p_partkey", labels.problem(text).alias("problem"))


# Keys and the index.
@query("w_06_disambiguate", "SELECT p_partkey AS ord, p_brand || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS key FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def disambiguate(spark, sf):
    p = table(spark, sf, "part")
    return collisions.disambiguate(p.select(F.col("p_brand").alias("base"), F.col("p_partkey").alias("ord")), p.select(F.lit("none").alias("citekey")), "numeric").select("ord", "key")


def index_of(spark, sf):
    return table(spark, sf, "orders").selectExpr("concat('o', o_orderkey) AS citekey", "o_orderstatus AS status")


@query("k_01_upsert", "SELECT 'o' || o_orderkey AS citekey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT 'n' || o_orderkey, 'new' FROM orders WHERE o_orderkey % 3 = 0")
def upsert(spark, sf):
    fresh = table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("explode(array(concat('o', o_orderkey), concat('n', o_orderkey))) AS citekey", "'new' AS status")
    return sync.upsert(index_of(spark, sf), fresh)


@query("k_02_delete", "SELECT 'o' || o_orderkey AS citekey, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0")
def delete(spark, sf):
    index = index_of(spark, sf)
    gone = table(spark, sf, "orders").where("o_orderkey % 5 = 0").selectExpr("concat('o', o_orderkey) AS citekey")
    return sync.upsert(index, index.limit(0), gone)


@query("t_02_fingerprint", "SELECT 'd' || doc_id AS citekey, sha256(coalesce(text, '')) AS hash, length(coalesce(text, '')) AS size FROM documents")
def fingerprint(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("citekey"), F.coalesce("text", F.lit("")).alias("content"))
    return sync.fingerprints(d)
