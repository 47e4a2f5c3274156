"""Index upkeep: serial lookups, key lists, and change detection by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def serial_rows(documents: DataFrame) -> DataFrame:
    """(citekey, kind, value) of every serial."""
    return documents.select("citekey", F.explode("serials").alias("s")).select("citekey", "s.kind", "s.value")


def by_serial(documents: DataFrame, kind: str, value: str) -> DataFrame:
    """Keys of the documents with that serial, exactly as stored."""
    return documents.where(F.exists("serials", lambda s: (s["kind"] == kind) & (s["value"] == value))).select("citekey").orderBy("citekey")


def owners(documents: DataFrame) -> DataFrame:
    """The first key that carries each serial."""
    return serial_rows(documents).groupBy("kind", "value").agg(F.min("citekey").alias("citekey"))


def by_keys(documents: DataFrame, keys: list[str]) -> DataFrame:
    """The documents of the keys, in the order of the keys (column ``pos``). The list is the caller's, so it is small."""
    spark = documents.sparkSession
    wanted = spark.createDataFrame(list(enumerate(keys)), "pos int, citekey string")
    return documents.join(F.broadcast(wanted), "citekey").orderBy("pos")


def fingerprints(files: DataFrame, content: str = "content") -> DataFrame:
    """(citekey, hash, size) of the files' content."""
    return files.select("citekey", F.sha2(F.col(content).cast("binary"), 256).alias("hash"), F.length(content).alias("size"))


def classify(known: DataFrame, now: DataFrame, *more: str) -> DataFrame:
    """(citekey, status): indexed (new or changed), unchanged or removed. ``more``: columns of ``now`` to carry."""
    k = known.select("citekey", F.struct("hash", "size").alias("_k"))
    n = now.select("citekey", F.struct("hash", "size").alias("_n"), *more)
    status = F.when(F.col("_n").isNull(), "removed").when(F.col("_k").isNull() | (F.col("_k") != F.col("_n")), "indexed").otherwise("unchanged")
    return n.join(k, "citekey", "full_outer").select("citekey", status.alias("status"), *more)


def report(statuses: DataFrame) -> DataFrame:
    """One row: how many were indexed, unchanged, removed, failed."""
    return statuses.agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("indexed", "unchanged", "removed", "failed")))


def upsert(index: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index with the fresh rows in place of those of the same keys, and without the keys of ``gone``."""
    kept = index.join(fresh.select("citekey"), "citekey", "left_anti")
    if gone is not None:
        kept = kept.join(gone.select("citekey"), "citekey", "left_anti")
    return kept.unionByName(fresh)
