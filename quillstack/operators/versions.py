"""A versioned index of documents: segments that are merged when read, under a manifest that is swapped in one rename.

A commit writes only its own rows, fresh documents and tombstones, as one segment: a new folder, parted by a hash of the
key. Then it writes the next manifest, which lists all segments in order. Nothing that a manifest names is ever written
again, so a job that fails, runs twice or reads while another writes loses nothing; a batch that a manifest records isn't
committed again. Readers take of each key the row of its newest segment: only the keys of the segments after the first are
grouped and met with the rows, texts aren't shuffled. ``compact`` merges the segments into one; ``vacuum`` deletes what
the current manifest doesn't name. Another form of documents has another stamp, and an index of another stamp is empty:
it is built anew.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.sources.tables import delete, file_system

#: Grows whenever the meaning of stored columns changes.
FORMAT = 1
#: Parts of a segment by the key's hash, and segments after which a commit that may do so compacts.
BUCKETS, MOST_SEGMENTS = 16, 12


class Conflict(RuntimeError):
    """Another writer has swapped the manifest meanwhile."""


@dataclass(frozen=True)
class Manifest:
    """One version of an index. ``batches``: the last batch that each source has committed."""

    version: int = 0
    stamp: str = ""
    schema: str = ""
    segments: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)


def stamp_of(schema) -> str:
    """What readers and writers must agree on: the format and the documents' columns."""
    return f"{FORMAT}:{','.join(sorted(f'{f.name} {f.dataType.simpleString()}' for f in schema.fields))}"


def manifest(spark: SparkSession, index: str) -> Manifest:
    """The newest manifest; an empty one of version 0 where there is none."""
    fs, folder = file_system(spark, f"{index}/manifests")
    if not fs.exists(folder):
        return Manifest()
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
    if not names:
        return Manifest()
    stream = fs.open(file_system(spark, f"{index}/manifests/{names[-1]}")[1])
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(**said | {"segments": tuple(said["segments"])})


def swap(spark: SparkSession, index: str, old: Manifest, new: Manifest) -> Manifest:
    """Make ``new`` the manifest after ``old``: a whole file under another name, then one rename that must be the first."""
    new = replace(new, version=old.version + 1)
    fs, folder = file_system(spark, f"{index}/manifests")
    fs.mkdirs(folder)
    _, loose = file_system(spark, f"{index}/manifests/.{uuid.uuid4().hex}")
    _, final = file_system(spark, f"{index}/manifests/{new.version:012d}.json")
    out = fs.create(loose, False)
    try:
        out.write(bytearray(json.dumps(asdict(new)).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(loose, final):
        fs.delete(loose, False)
        raise Conflict(f"version {new.version} of {index} is there already")
    return new


def _bucket(key):
    return F.pmod(F.hash(key), F.lit(BUCKETS))


def _write(rows: DataFrame, index: str, spread: bool) -> str:
    """A new segment of (documents' columns, _gone). ``spread``: it may be large, so a bucket is many tasks' and files."""
    name = uuid.uuid4().hex
    rows = rows.withColumn("_bucket", _bucket(F.col("citekey")))
    rows = rows.repartitionByRange("_bucket", "citekey") if spread else rows.repartition(BUCKETS, "_bucket")
    rows.write.partitionBy("_bucket").parquet(f"{index}/segments/{name}")
    return name


def _segments(spark: SparkSession, index: str, m: Manifest) -> list[DataFrame]:
    """(documents' columns, _gone, _bucket, _seq) of each segment."""
    schema = spark.createDataFrame([], m.schema).schema.add("_gone", T.BooleanType()).add("_bucket", T.IntegerType())
    return [spark.read.schema(schema).parquet(f"{index}/segments/{s}").withColumn("_seq", F.lit(i)) for i, s in enumerate(m.segments)]


def current(spark: SparkSession, index: str, stamp: str | None = None, at: Manifest | None = None) -> DataFrame | None:
    """The documents of the index (with ``_bucket``, their key's part); None before the first commit, after a reset, or if
    the index is of another ``stamp``. ``at``: as of that manifest, whose segments aren't vacuumed yet."""
    m = at or manifest(spark, index)
    if not m.segments or (stamp is not None and m.stamp != stamp):
        return None
    segments = _segments(spark, index, m)
    if len(segments) == 1:
        return segments[0].where("NOT _gone").drop("_gone", "_seq")
    newer = reduce(DataFrame.unionAll, [s.select("citekey", "_seq") for s in segments[1:]]).groupBy("citekey").agg(F.max("_seq").alias("_last"))
    rows = reduce(DataFrame.unionAll, segments).join(newer, "citekey", "left")
    return rows.where((F.col("_last").isNull() | (F.col("_seq") == F.col("_last"))) & ~F.col("_gone")).drop("_gone", "_seq", "_last").select(*segments[0].drop("_gone", "_seq").columns)


def get(spark: SparkSession, index: str, key: str) -> DataFrame:
    """The document of a key; only its part of each segment is read."""
    found = current(spark, index)
    if found is None:
        raise LookupError(f"nothing is indexed below {index}")
    return found.where((F.col("_bucket") == _bucket(F.lit(key))) & (F.col("citekey") == key)).drop("_bucket")


def commit(index: str, fresh: DataFrame, gone: DataFrame | None = None, source: str | None = None, batch: int | None = None, most: int = MOST_SEGMENTS) -> Manifest:
    """Put the rows of ``fresh`` (citekey distinct and not null) in place of those of their keys and take the keys of
    ``gone`` away; keys in both stay. Batches of a ``source`` that are recorded already do nothing. Other commits in
    between are kept: the manifest is read again and the segment appended to it. Beyond ``most`` segments the index is
    compacted."""
    spark, stamp = fresh.sparkSession, stamp_of(fresh.schema)
    rows = fresh.withColumn("_gone", F.lit(False))
    if gone is not None:
        keys = gone.select("citekey").distinct().join(fresh.select("citekey"), "citekey", "left_anti")
        rows = rows.unionByName(keys.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    old = manifest(spark, index)
    if source is not None and batch is not None and batch <= old.batches.get(source, -1) and old.stamp == stamp:
        return old
    segment = _write(rows, index, spread=False)
    while True:
        old = manifest(spark, index)
        if source is not None and batch is not None and batch <= old.batches.get(source, -1) and old.stamp == stamp:
            return old
        kept = old if old.stamp == stamp else Manifest(version=old.version)
        batches = kept.batches | ({source: batch} if source is not None and batch is not None else {})
        new = Manifest(stamp=stamp, schema=kept.schema or _ddl(fresh), segments=(*kept.segments, segment), batches=batches)
        try:
            out = swap(spark, index, old, new)
            break
        except Conflict:
            continue
    return compact(spark, index) if len(out.segments) > most else out


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def reset(spark: SparkSession, index: str) -> Manifest:
    """Empty the index. Its batches are forgotten too, so sources are read anew; files go with ``vacuum``."""
    while True:
        old = manifest(spark, index)
        try:
            return swap(spark, index, old, Manifest())
        except Conflict:
            continue


def compact(spark: SparkSession, index: str) -> Manifest:
    """Merge the segments into one; tombstones go. Segments that come meanwhile stay behind it."""
    old = manifest(spark, index)
    if len(old.segments) < 2:
        return old
    merged = _write(current(spark, index, at=old).drop("_bucket").withColumn("_gone", F.lit(False)), index, spread=True)
    while True:
        now = manifest(spark, index)
        if now.segments[: len(old.segments)] != old.segments:  # a reset or another compaction came between
            return now
        try:
            return swap(spark, index, now, replace(now, segments=(merged, *now.segments[len(old.segments) :])))
        except Conflict:
            continue


def vacuum(spark: SparkSession, index: str) -> list[str]:
    """Delete segments and manifests that the current manifest is past; the names of the segments. For when nobody reads
    an older version and no commit is under way."""
    m = manifest(spark, index)
    fs, folder = file_system(spark, f"{index}/segments")
    gone = sorted({s.getPath().getName() for s in fs.listStatus(folder)} - set(m.segments)) if fs.exists(folder) else []
    for name in gone:
        delete(spark, f"{index}/segments/{name}")
    for v in range(max(1, m.version - 1000), m.version):
        delete(spark, f"{index}/manifests/{v:012d}.json")
    return gone
