"""A library kept in step as a stream: new and changed info files update the index, run by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.operators import versions
from quillstack.sources import library


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the info files that come or change below ``root``, as the batch listing has them."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "info.y*ml").load(root)
    d = F.regexp_replace("path", "/[^/]*$", "")
    return raw.select("path", d.alias("dir"), F.regexp_extract(d, "[^/]*$", 0).alias("citekey"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content", "length")


def follow(spark: SparkSession, root: str, index: str, checkpoint: str):
    """Commit everything new since the last call to the versioned index, then stop. A batch writes its own documents and
    tombstones of those that no longer parse; one that Spark runs again is known by the stream's own id and number.

    A file stream never reports deletions; ``remove_missing`` compares the index with a full listing."""

    def step(batch: DataFrame, number: int) -> None:
        fresh = library.parsed(library.preferred(batch))
        stream = batch.sparkSession.read.json(f"{checkpoint}/metadata").first().id
        versions.commit(index, fresh.where("error IS NULL").drop("error"), fresh.where("error IS NOT NULL"), stream, number)

    return changed_files(spark, root).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, index: str) -> DataFrame | None:
    """The index as the last step left it; None before the first."""
    now = versions.current(spark, index)
    return None if now is None else now.drop("_bucket")


def remove_missing(index: DataFrame, listing: DataFrame) -> DataFrame:
    return index.join(listing.select("citekey"), "citekey", "left_semi")
