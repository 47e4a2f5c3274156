"""Records of several providers into one, field by field, with provenance; guarded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(fields: DataFrame) -> DataFrame:
    """(record, field, value, source) from (record, field, provider_ord, source, value): the earliest provider that has a
    field gives all of it."""
    first = F.min_by(F.struct("value", "source"), F.col("provider_ord")).alias("w")
    return fields.where(F.col("value").isNotNull()).groupBy("record", "field").agg(first).select("record", "field", "w.value", "w.source")


def provenance(merged: DataFrame) -> DataFrame:
    """(record, provenance): map of fields to the sources that gave them, in the order of the fields."""
    named = merged.where(F.coalesce("source", F.lit("")) != "")
    return named.groupBy("record").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "source")))).alias("provenance"))


def consulted(fields: DataFrame) -> DataFrame:
    """(record, sources): distinct sources in the order in which they were asked."""
    ordered = F.transform(F.array_sort(F.collect_set(F.struct("provider_ord", "source"))), lambda x: x["source"])
    return fields.where(F.coalesce("source", F.lit("")) != "").groupBy("record").agg(F.array_distinct(ordered).alias("sources"))


def update(local: DataFrame, fresh: DataFrame, known: DataFrame, overwrite_local: bool = False, meta: str = "x-meta") -> DataFrame:
    """(doc, field, value, changed, source): local fields (doc, field, value) after an update by fresh ones (doc, field,
    value, source). A field that ``known`` (doc, field) doesn't trace to a provider was written by hand and stays,
    unless ``overwrite_local``; a new field is added; an equal value isn't a change; the ``meta`` field stays."""
    a = local.select("doc", "field", F.col("value").alias("_old"), F.lit(True).alias("_has"))
    b = fresh.where(F.col("field") != meta).select("doc", "field", F.col("value").alias("_new"), "source", F.lit(True).alias("_offers"))
    k = known.select("doc", "field", F.lit(True).alias("_known")).distinct()
    j = a.join(b, ["doc", "field"], "full_outer").join(k, ["doc", "field"], "left")
    free = F.col("_has").isNull() | F.coalesce("_known", F.lit(overwrite_local))
    changed = F.coalesce("_offers", F.lit(False)) & (F.lit(True) if overwrite_local else free) & ~F.col("_old").eqNullSafe(F.col("_new"))
    return j.select("doc", "field", F.when(changed, F.col("_new")).otherwise(F.col("_old")).alias("value"), changed.alias("changed"), F.when(changed, F.col("source")).alias("source"))


def changed_fields(updated: DataFrame) -> DataFrame:
    return updated.where("changed").groupBy("doc").agg(F.array_sort(F.collect_list("field")).alias("fields"))


def overlay(flag: Column, fetched: Column, default: Column | None = None) -> Column:
    """What was asked for explicitly, else what was fetched, else the default."""
    return F.coalesce(flag, fetched, *([default] if default is not None else []))


def with_identifiers(serials: Column, more: Column) -> Column:
    """A map of serials with those of ``more`` whose kinds it lacks."""
    return F.map_zip_with(serials, more, lambda _, mine, other: F.coalesce(mine, other))
