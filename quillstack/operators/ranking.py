"""Ranking of candidate records for a title that someone looks for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions import records as rec
from quillstack.functions.similarity import jaro_winkler
from quillstack.operators.numbering import numbered
from quillstack.sources.tables import delete


@dataclass(frozen=True)
class Wanted:
    text: str
    author: str | None = None
    year: int | None = None
    limit: int = 10


def union(answers: list[DataFrame]) -> DataFrame:
    """All candidates of all providers, repeated ones included."""
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out


def first_by_identifier(candidates: DataFrame) -> DataFrame:
    """One candidate for each identifier, the first in the order of providers; those without one all stay."""
    w = W.partitionBy("id").orderBy("provider_ord", "pos")
    with_id = candidates.where(F.col("id").isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return with_id.unionByName(candidates.where(F.col("id").isNull()))


def score(wanted: Wanted, title: Column, families: Column, issued: Column) -> Column:
    """Likeness of the title in 0 to 1; author and year move it by a twentieth."""
    text, got = rec.plain_title(F.lit(wanted.text)), rec.plain_title(title)
    s = F.when(got == text, 1.0).when(got.startswith(text), F.greatest(jaro_winkler(text, got), F.lit(0.95))).otherwise(jaro_winkler(text, got))
    if wanted.author is not None:
        hit = F.exists(families, lambda f: F.contains(rec.plain_title(f), rec.plain_title(F.lit(wanted.author))))
        s = s + F.when(hit, 0.05).otherwise(-0.05)
    if wanted.year is not None:
        s = s + F.when(issued.isNull(), 0.0).when(issued.startswith(str(wanted.year)), 0.05).otherwise(-0.05)
    return F.when(title.isNull() | (text == ""), 0.0).otherwise(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))


#: The order of ranked candidates: likeness, whether it can be added, published, cited, complete, title.
def order() -> list[Column]:
    return [F.desc("score"), F.col("id").isNotNull().desc(), F.desc("published"), F.desc("cited"), F.desc("complete"), F.asc_nulls_first("title"), F.asc("provider_ord"), F.asc("pos")]


def scored(wanted: Wanted, candidates: DataFrame) -> DataFrame:
    """Candidates (source, provider_ord, pos, id, kind, title, families, issued, container, page, volume, publisher,
    abstract, cited_by) with what they are ordered by. Repeats by identifier are gone."""
    c = first_by_identifier(candidates)
    return c.select(
        "*", F.round(score(wanted, F.col("title"), F.col("families"), F.col("issued")), 6).alias("score"), rec.published_rank(F.col("kind")).alias("published"),
        rec.citation_bucket(F.col("cited_by")).alias("cited"), rec.completeness(F.col("families"), *map(F.col, ("issued", "container", "page", "volume", "publisher", "abstract"))).alias("complete"),
    )


def interleave(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """Sources take turns, the one with the best candidate first; ``place`` numbers the result from 1.

    A limit is applied to each source before the sources meet, which changes nothing in the result: no more than so many
    of a source can be in it. Without one, nothing is held in one task: turns, sources and places are numbered by range
    (``numbering``), so a source may be any share of the candidates; the table that the result reads stays in
    ``spark.checkpoint.dir``."""
    met = lambda rows, best: rows.alias("l").join(best.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.source_ord")
    if limit is not None:
        top = max(limit, 1)
        by_source = ranked.withColumn("turn", F.row_number().over(W.partitionBy("source").orderBy(*order())).cast("bigint")).where(F.col("turn") <= top)
        best = by_source.where("turn = 1").withColumn("source_ord", F.row_number().over(W.orderBy(*order())).cast("bigint")).select("source", "source_ord")  # one row a source
        first = met(by_source, best).orderBy("turn", "source_ord").limit(top)
        return first.withColumn("place", F.row_number().over(W.orderBy("turn", "source_ord")).cast("bigint")).orderBy("place")
    by_source, turns = numbered(ranked, ["source"], order(), "turn")
    best, sources = numbered(by_source.where("turn = 1"), [], order(), "source_ord")
    out, _ = numbered(met(by_source, best.select("source", "source_ord")), [], [F.col("turn").asc(), F.col("source_ord").asc()], "place")
    for path in (turns, sources):
        delete(ranked.sparkSession, path)
    return out.orderBy("place")


def rank(wanted: Wanted, candidates: DataFrame) -> DataFrame:
    return interleave(scored(wanted, candidates), wanted.limit)


def select(ranked: DataFrame, n: int) -> DataFrame:
    """The n-th candidate (from 1) of those that have an identifier."""
    if n < 1:
        raise ValueError("candidates are counted from 1")
    able = ranked.where(F.col("id").isNotNull()).orderBy("turn", "source_ord").limit(n)
    return able.orderBy(F.desc("turn"), F.desc("source_ord")).limit(1)


def present(candidates: DataFrame, owners: DataFrame) -> DataFrame:
    """Candidates with the key of the document that has their identifier (null if none), and ``in_library``."""
    o = owners.select(F.concat("kind", F.lit(":"), "value").alias("id"), F.col("citekey").alias("owner"))
    return candidates.join(o, "id", "left").withColumn("in_library", F.col("owner").isNotNull())
