"""Taking documents of another library in: a walk over its folders, keys that collide with nothing, attachments that exist."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions.labels import problem
from quillstack.operators.collisions import disambiguate
from quillstack.sources import library
from quillstack.sources.catalogues import flat_body


def outermost(listing: DataFrame) -> DataFrame:
    """The rows of ``listing`` (dir, ...) that stand in no folder below another row's folder: a walk that stops at a
    document. A folder meets its own parents, as many as its path is deep, so nothing is compared in pairs."""
    dirs = listing.select("dir").distinct()
    parents = "transform(sequence(1, greatest(size(parts) - 1, 1)), n -> array_join(slice(parts, 1, n), '/'))"
    above = dirs.withColumn("parts", F.split("dir", "/")).where(F.size("parts") > 1).select("dir", F.explode(F.expr(parents)).alias("parent"))
    nested = above.join(dirs.select(F.col("dir").alias("parent")), "parent", "left_semi").select("dir").distinct()
    return listing.join(nested, "dir", "left_anti")


def flat_library(spark: SparkSession, root: str) -> DataFrame:
    """(dir, key, body, error) of the flat (papis) files below ``root``: ``info.yaml`` goes before ``info.yml``, and no
    folder below a document is looked into. The key is the file's own ``ref`` if that is a text, else the folder's name,
    else ``imported``. A file that can't be read is a row with an error and no body."""

    def run(batches):
        for batch in batches:
            keys, bodies, errors = [], [], []
            for name, content in zip(batch.column("citekey").to_pylist(), batch.column("content").to_pylist()):
                key, body, error = name or "imported", None, None
                try:
                    flat = library.load_yaml(content.decode())
                    if not isinstance(flat, dict):
                        raise ValueError("not a mapping")
                    key = flat["ref"] if isinstance(flat.get("ref"), str) else key
                    body = json.dumps(flat_body(flat, library.META_KEY), ensure_ascii=False, default=str)
                except Exception as e:  # any reason that a file can't be read goes to the error channel
                    error = str(e).splitlines()[0][:300] if str(e) else type(e).__name__
                keys.append(key)
                bodies.append(body)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("dir"), *(pa.array(x, pa.string()) for x in (keys, bodies, errors))], names=["dir", "key", "body", "error"])

    found = outermost(library.preferred(library.files(spark, root), "info.yaml"))
    return found.select("dir", "citekey", "content").mapInArrow(run, "dir string, key string, body string, error string")


def ingest(items: DataFrame, index: DataFrame, policy: str = "alpha", base: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(items with their ``citekey``, refused ones as (key, reason)) of items (ord, key, error, ...) against the keys of
    ``index``; ``base``: the key wanted in place of ``key``.

    An item with an error or a key that is no folder's name is refused and claims nothing; the others are served by
    ``ord``, so that they collide neither with the index nor with each other. Some refused ones don't stop the rest; if
    nothing at all is left to import of what was there, ValueError."""
    wanted = items.withColumn("base", F.col("key") if base is None else base)
    reason = F.coalesce("error", F.when(F.col("base").isNull(), "no key"), problem(F.col("base")))
    judged = wanted.withColumn("reason", reason)
    good, refused = judged.where("reason IS NULL"), judged.where("reason IS NOT NULL").select("key", "reason")
    if refused.limit(1).count() and not good.limit(1).count():
        raise ValueError("no documents were imported")
    claimed = disambiguate(good, index, policy).select("ord", F.col("key").alias("citekey"))
    return good.drop("base", "reason", "error").join(claimed, "ord"), refused


def take_files(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """Documents (citekey, files, ...; keys unique) with ``files`` cut to the base names of those that the listing
    (citekey, path) has, in their order, and ``missing``: ``citekey/path`` of the others. A path without a last name
    (empty, ``..``) is neither. A record without files has two empty lists."""
    said = documents.select("citekey", F.posexplode("files").alias("pos", "path"))
    name = F.regexp_extract(F.regexp_replace("path", r"(/\.?)+$", ""), "[^/]*$", 0)
    there = listing.select("citekey", "path", F.lit(True).alias("there")).distinct()
    met = said.withColumn("name", name).where("name NOT IN ('', '.', '..')").join(there, ["citekey", "path"], "left")
    of = lambda condition, value: F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("pos", value.alias("x"))))), lambda r: r["x"])
    lists = met.groupBy("citekey").agg(of(F.col("there"), F.col("name")).alias("kept"), of(F.col("there").isNull(), F.concat_ws("/", "citekey", "path")).alias("missing"))
    none = F.array().cast("array<string>")
    rest = [F.coalesce("kept", none).alias("files") if c == "files" else F.col(c) for c in documents.columns]
    return documents.join(lists, "citekey", "left").select(*rest, F.coalesce("missing", none).alias("missing"))
