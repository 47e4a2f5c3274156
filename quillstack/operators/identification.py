"""Identification as one call: from documents and the recorded runs of their PDF tools to ranked evidence.

Reading goes by stages: file name and metadata, first page, last page, front matter, full scan. After each stage the
documents that have evidence of high confidence are settled, and the next stage asks only for runs of those that are not
(an anti-join against what is settled, before any text is met), so full scans touch few texts. A stage's evidence is a
table in the shared folder: the stages after it read that and never come back to its texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import identifiers as ids
from quillstack.functions import text as tx
from quillstack.operators import documents, identify
from quillstack.sources import pdftext
from quillstack.sources.responses import op_key
from quillstack.sources.tables import dealt, shared_path

#: Pages of the front matter and of a full scan at most, pages on which a DOI is repeated.
FRONT, SCANNED, REPEATED = 6, 40, 3

COLUMNS = ("doc", "id", "tier", "confidence", "seq", "context")


def _key(kind: str, first: Column, last: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), first.cast("string"), F.lit("-"), last.cast("string"))


@dataclass(frozen=True)
class Stage:
    """A tier's run: its key from the number of pages, and which documents have one."""

    tier: int
    key: Callable[[Column], Column]
    where: Callable[[Column], Column] = lambda n: F.lit(True)


TEXT_STAGES = (
    Stage(4, lambda n: F.lit(op_key("text", 1, 1, layout=True))),
    Stage(5, lambda n: _key("text", n, n), lambda n: n > 1),
    Stage(6, lambda n: _key("text", F.lit(1), F.least(n, F.lit(FRONT))), lambda n: n > 1),
    Stage(7, lambda n: _key("text", F.lit(1), F.greatest(F.least(n, F.lit(SCANNED)), F.lit(1)))),
)


def text_evidence(texts: DataFrame, tier: int, page_count: Column) -> DataFrame:
    """Evidence (``COLUMNS``) of a tier's texts (doc, text): DOIs that stand on three or more of the raw pages are high;
    then what the three views of the part before the references hold, in order. A DOI found there has the tier's
    confidence, marked arXiv ids and (from the front matter on) ISBNs are high. Null texts hold nothing."""
    low, high = identify.text_confidence(F.lit(tier), page_count), F.lit(identify.HIGH)
    t = dealt(texts.where("text IS NOT NULL").select("doc", "text", low.cast("int").alias("low")), "doc")

    def of(kind: str, found: Column, view: Column, confidence: Column) -> Column:
        return F.transform(found, lambda x: F.struct(ids.identifier(kind, x).alias("id"), confidence.alias("confidence"), documents.snippet(view, x).alias("context")))

    def in_view(view: Column) -> Column:
        isbns = [of("isbn", ids.find_isbns(view), view, high)] if tier >= 6 else []
        return F.concat(of("doi", ids.find_dois(view), view, F.col("low")), of("arxiv", ids.find_arxiv(view), view, high), *isbns)

    found = t.select("doc", F.posexplode(F.flatten(F.transform(tx.views(tx.before_references(F.col("text"))), in_view))).alias("seq", "f"))
    found = found.select("doc", "f.id", F.lit(tier).alias("tier"), "f.confidence", "seq", "f.context")
    pages = t.where(F.contains("text", F.lit("\f"))).select("doc", F.posexplode(identify.pages_of(F.col("text"))).alias("page", "text"))
    again = identify.repeated_dois(pages, REPEATED)
    again = again.select("doc", ids.identifier("doi", F.col("doi")).alias("id"), F.lit(tier).alias("tier"), high.alias("confidence"), F.lit(-1).alias("seq"), F.concat(F.lit("repeated across pages ("), "doi", F.lit(")")).alias("context"))
    return again.unionByName(found)


def described(pdfs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, pdf, pages, title, info, xmp) of (doc, pdf) and runs (pdf, op_key, text): what dictionaries and packets say.
    The custom dictionary's entries come over the plain one's; a document without a page count has one page."""
    one = lambda key: F.max(F.when(F.col("op_key") == key, F.col("text")))
    keys = ("info", "info-custom", "xmp")
    said = runs.where(F.col("op_key").isin(*keys)).groupBy("pdf").agg(*(one(k).alias("_" + k) for k in keys))
    empty = F.create_map().cast("map<string,string>")
    info = lambda c: F.coalesce(pdftext.info(F.col(c)), empty)
    d = dealt(pdfs.join(said, "pdf", "left"), "doc").select("doc", "pdf", info("_info").alias("plain"), info("_info-custom").alias("custom"), pdftext.xmp(F.col("_xmp")).alias("xmp"))
    pages = F.coalesce(pdftext.page_count(F.col("plain")), F.lit(1))
    d = d.select("doc", "pdf", pages.alias("pages"), documents.overlay_maps(F.col("plain"), F.col("custom")).alias("info"), "xmp")
    return d.withColumn("title", F.coalesce(F.nullif(F.col("info")["Title"], F.lit("")), F.col("xmp")["title"]))


def metadata_evidence(described: DataFrame, runs: DataFrame) -> DataFrame:
    """Evidence (``COLUMNS``) of the file names, links, dictionaries and packets of ``described``."""
    described = dealt(described, "doc")
    stem = F.regexp_replace(F.regexp_extract("pdf", "[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    # Exploded, not filtered: a filter on the identifier would state its long expression twice.
    named = described.select("doc", F.explode(F.array_compact(F.array(identify.from_filename(stem)))).alias("id"), F.lit(0).alias("tier"), F.lit(identify.HIGH).alias("confidence"), stem.alias("context"))
    pairs = lambda c: described.select("doc", F.explode(c).alias("key", "value"))
    asked = described.select("doc", "pdf", F.concat(F.lit("urls-"), F.col("pages").cast("string")).alias("op_key"))
    links = asked.join(runs.where(F.col("op_key").startswith("urls-")), ["pdf", "op_key"]).select("doc", F.explode(pdftext.urls(F.col("text"))).alias("u")).select("doc", "u.page", "u.uri")
    found = [named, documents.from_annotations(links), documents.from_info(pairs("info")), documents.from_xmp(pairs("xmp"))]
    return reduce(DataFrame.unionByName, found).withColumn("seq", F.lit(0)).select(*COLUMNS)


def settled(evidence: DataFrame) -> DataFrame:
    """The documents whose best evidence is at least high: of one find, or of two tiers that agree."""
    by_id = evidence.groupBy("doc", "id").agg(F.max("confidence").alias("best"), F.min("tier").alias("low"), F.max("tier").alias("top"))
    return by_id.where((F.col("best") >= identify.HIGH) | (F.col("low") < F.col("top"))).select("doc").distinct()


@dataclass(frozen=True)
class Identification:
    """``evidence``: the best for each identifier of each document, with its ``place`` (1: the document's identifier).
    ``asked``: (doc, pdf, stage, op_key) of every text run that was asked for. ``titles``: (doc, title)."""

    evidence: DataFrame
    asked: DataFrame
    titles: DataFrame


def identify_documents(pdfs: DataFrame, recorded: DataFrame) -> Identification:
    """Identify ``pdfs`` (doc, pdf; both distinct) by the ``recorded`` runs (pdf, op_key, text, error; one a key).

    A run that isn't recorded, or failed, finds nothing and stops nothing. Titles come from the dictionary, else the
    packet, else, for documents that no stage settled, from the geometry of the first page."""
    spark = pdfs.sparkSession

    def table(df: DataFrame) -> DataFrame:
        path = shared_path(spark, "identification")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # Each stage reads the runs: they are made once, whatever they are made from.
    runs = table(recorded.where("error IS NULL AND text IS NOT NULL").select("pdf", "op_key", "text"))
    docs = table(described(pdfs.select("doc", "pdf"), runs))
    evidence, asked = [table(metadata_evidence(docs, runs))], None
    for stage in TEXT_STAGES:
        n = F.col("pages")
        left = docs.join(settled(reduce(DataFrame.unionByName, evidence)), "doc", "left_anti")
        wanted = table(left.where(stage.where(n)).select("doc", "pdf", n, F.lit(stage.tier).alias("stage"), stage.key(n).alias("op_key")))
        asked = wanted if asked is None else asked.unionByName(wanted)
        texts = wanted.join(runs.where(F.col("op_key").startswith("text-")), ["pdf", "op_key"])
        evidence.append(table(text_evidence(texts.select("doc", "text", "pages"), stage.tier, F.col("pages"))))
    every = reduce(DataFrame.unionByName, evidence)
    bare = docs.join(settled(every), "doc", "left_anti").where("title IS NULL").select("doc", "pdf")
    drawn = bare.join(runs.where(F.col("op_key") == op_key("bbox", 1)), "pdf").select("doc", pdftext.layout(F.col("text")).alias("page"))
    drawn = drawn.select("doc", pdftext.geometry_title(F.col("page")).alias("title"))
    titles = docs.where("title IS NOT NULL").select("doc", "title").unionByName(drawn.where("title IS NOT NULL"))
    return Identification(identify.rank(every), asked.drop("pages"), titles)
