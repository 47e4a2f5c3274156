"""Identification of a document from candidate identifiers found in its tiers (file name to full text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions import identifiers as ids
from quillstack.functions import text as tx
from quillstack.sources.tables import dealt

#: Tiers and confidences, in order.
TIERS = ("filename", "link-annotations", "doc-info", "xmp", "first-page", "last-page", "front-matter", "full-scan", "ocr")
CONFIDENCES = ("low", "medium", "high", "certain")
HIGH, CERTAIN = 2, 3
STAGES = {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 2, 6: 3, 7: 4, 8: 5}


def pages_of(text: Column) -> Column:
    """Pages of a text that form feeds part."""
    return F.split(text, "\f")


def text_confidence(tier: Column, pages: Column) -> Column:
    return F.when((tier == 4) & (pages == 1), HIGH).when(tier.isin(4, 5, 6), 1).otherwise(0)


def from_filename(stem: Column) -> Column:
    """The identifier that a file's name is, or is with its first ``_`` read as ``/``. Names without what every
    identifier has (a DOI's start, the digits of an arXiv id or of an ISBN, a mark) aren't parsed."""
    likely = stem.rlike(r"(?i)10\.[0-9]{4}|[0-9]{4}\.[0-9]{4}|[/_][0-9]{7}|pmid:|[0-9X](?:[^0-9X]*[0-9X]){9}")
    read = F.transform(F.array(stem, F.regexp_replace(stem, "^([^_]*)_", "$1/")), ids.parse_identifier)
    return F.when(likely, F.get(F.array_compact(read), F.lit(0)))


def repeated_dois(pages: DataFrame, threshold: int = 3) -> DataFrame:
    """(doc, doi, pages): DOIs on at least so many pages of (doc, page, text), once a page at most."""
    found = pages.select("doc", "page", F.explode(ids.find_dois(F.col("text"))).alias("doi"))
    return found.distinct().groupBy("doc", "doi").agg(F.count("*").alias("pages")).where(F.col("pages") >= threshold)


def rank(candidates: DataFrame) -> DataFrame:
    """The best evidence for each identifier of (doc, id, tier, confidence, seq, context), with its ``place``.

    Two tiers that name the same identifier make it certain. Best: confidence, earlier tier, then identifier; of equal
    evidence the first found gives the context."""
    row = F.struct(*(c for c in candidates.columns if c not in ("doc", "id")))
    by_confidence = F.struct(F.col("confidence").isNull(), -F.col("confidence"), "tier", "seq")
    # Rows are few for each identifier: they are dealt out and sorted once, by what they are grouped by.
    found = dealt(candidates, "doc", "id").groupBy("doc", "id").agg((F.min("tier") < F.max("tier")).alias("_agreed"), F.min_by(row, by_confidence).alias("_best"), F.min_by(row, F.struct("tier", "seq")).alias("_first"))
    best = F.when(F.col("_agreed"), F.col("_first").withField("confidence", F.lit(CERTAIN))).otherwise(F.col("_best"))
    kept = found.select("doc", "id", best.alias("_r")).select("doc", "id", "_r.*").select(*candidates.columns)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("doc").orderBy(F.desc("confidence"), "tier", "id")))


def conclusive_stage(candidates: DataFrame) -> DataFrame:
    """Candidates up to the first stage after which the best is at least high: metadata is one stage, each text tier
    another. Agreement counts as far as it was read."""
    stage = F.lit(None).cast("int")
    for tier, s in STAGES.items():
        stage = F.when(F.col("tier") == tier, s).otherwise(stage)
    c = candidates.withColumn("stage", stage)
    # An identifier is conclusive from the stage of its first high evidence, or of its second tier.
    by_tier = c.groupBy("doc", "id", "tier").agg(F.min("stage").alias("s"), F.max("confidence").alias("conf"))
    tiers = by_tier.groupBy("doc", "id").agg(F.min(F.when(F.col("conf") >= HIGH, F.col("s"))).alias("high"), F.get(F.array_sort(F.collect_list("s")), F.lit(1)).alias("second"))
    stop = tiers.groupBy("doc").agg(F.min(F.least("high", "second")).alias("stop"))
    return c.join(stop, "doc", "left").where(F.col("stop").isNull() | (F.col("stage") <= F.col("stop"))).drop("stop")


def from_text(pages: DataFrame, tier: int, page_count: Column) -> DataFrame:
    """(doc, id, tier, confidence) from a text tier's (doc, text): identifiers in the three views of what stands before
    the references; arXiv marks are high; ISBNs count from the front matter on."""
    views = pages.select("doc", F.explode(tx.views(tx.before_references(F.col("text")))).alias("view"), page_count.alias("n"))
    low = text_confidence(F.lit(tier), F.col("n"))
    found = F.concat(
        F.transform(ids.find_dois(F.col("view")), lambda x: F.struct(ids.identifier("doi", x).alias("id"), low.alias("confidence"))),
        F.transform(ids.find_arxiv(F.col("view")), lambda x: F.struct(ids.identifier("arxiv", x).alias("id"), F.lit(HIGH).alias("confidence"))),
        *([F.transform(ids.find_isbns(F.col("view")), lambda x: F.struct(ids.identifier("isbn", x).alias("id"), F.lit(HIGH).alias("confidence")))] if tier >= 6 else []),
    )
    return views.select("doc", F.explode(found).alias("f")).select("doc", "f.id", F.lit(tier).alias("tier"), "f.confidence")
