"""What the operators share: shared-folder tables, Arrow batches of texts, small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on at once; bounds a Python worker's memory, as Spark's own limit of bytes in
#: an Arrow batch does for what comes from the JVM.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where that is unset, one of our own if all runs on this
    machine; otherwise an error, since other machines couldn't read it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="quillstack-")
        shared_dir.own = path
    return path.rstrip("/")


#: Tables that this driver has written and not deleted, in order, and the frames that read them.
_WRITTEN: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut, and a lost executor costs
    nothing that was already computed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstack-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    _WRITTEN.remove(path)
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more; other frames are left alone."""
    for df in frames:
        if (path := _PATHS.pop(df, None)) in _WRITTEN:
            _delete(df.sparkSession, path)


def written() -> int:
    """Number of tables that are written and not deleted."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the tables written after the first ``since``, but for that of ``keep``, once no result needs them."""
    spared = _PATHS.get(keep) if keep is not None else None
    for path in [p for p in _WRITTEN[since:] if p != spared]:
        _delete(spark, path)


def lowest(df: DataFrame, key: Column, n: int) -> DataFrame:
    """``n`` rows at most, those whose ``key`` (distinct) hashes lowest. Only some more than ``n`` rows that lie below a
    bound of the hash are sorted, however many there are; by chance it may be a few less than ``n``."""
    total = df.count()
    low = F.pmod(F.xxhash64(key, F.lit("lowest")), F.lit(1 << 40))
    if total > n:
        df = df.where(low < int(min(1.0, (n + 6 * n**0.5 + 100) / total) * (1 << 40)))
    return df.orderBy(low, key).limit(n)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted column names, with as many ``_`` in front as keep them apart from ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def extended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of ``df`` with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, each of some ``limit`` bytes of text (or a single row)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.nan_to_num(pa.compute.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The ``parts`` with their texts as bytes."""
    for batch in parts(batches, text, limit):
        yield batch, as_bytes(batch.column(batch.schema.get_field_index(text)))


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of the texts, A-Z in lower case, cut at ASCII white space: (the place of each word among the distinct
    ones, the distinct words, words of each text). Null texts have none."""
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
    sizes = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    index, distinct = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in distinct:  # what white space at the edges leaves
        full = index != distinct.index(b"")
        sizes = np.add.reduceat(full, np.cumsum(sizes) - sizes, dtype=np.int64)
        index = index[full]
    return index, distinct, sizes


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``start .. start + count - 1`` for each pair."""
    counts = np.asarray(counts, np.int64)
    if not len(counts) or not counts.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts)


class Memo(dict):
    """Words to what is known of them. ``full`` after ``count`` words or ``size`` bytes of words."""

    def __init__(self, count: int = 600_000, size: int = 64 << 20):
        super().__init__()
        self.limit, self.room = count, size
        self.bytes = 0

    def learn(self, words: list, values: list) -> None:
        self.update(zip(words, values))
        self.bytes += sum(map(len, words))

    @property
    def full(self) -> bool:
        return len(self) > self.limit or self.bytes > self.room

    def clear(self) -> None:
        super().clear()
        self.bytes = 0
