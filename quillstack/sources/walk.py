"""A library's directories as a data source of their own: ``spark.read.format("library")`` and its sink.

Spark's file listing leaves out names that start with ``_``, holds every file of the tree on the driver and can't stop at
one directory. Here the driver lists only until there are enough directories to deal out; tasks walk what is below. The
root must be a path that all machines see, or a URL of a store that Arrow reads (``s3://``, ``hdfs://``, ``gs://``).
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from quillstack.functions.labels import problem
from quillstack.sources import library
from quillstack.sources.tables import dealt, shared_path

#: Names of info files, the preferred one first.
NAMES = ("info.yml", "info.yaml")
FOUND = pa.schema([("path", pa.string()), ("dir", pa.string()), ("citekey", pa.string()), ("name", pa.string())])
#: Bytes of files that a task holds before it hands them on.
BATCH = 4 << 20


def _store(root: str):
    """(Arrow file system or None for this machine's, path) of a root."""
    if "://" not in root and not root.startswith("file:"):
        return None, root.rstrip("/") or "/"
    if root.startswith("file:"):
        return None, "/" + root[5:].strip("/")
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(root)
    return found, path.rstrip("/")


def _entries(store, path: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a directory) of the directories and info files of a directory. Hidden directories are left out,
    and on this machine links to directories, so that no walk runs in a circle; a link to a file is a file."""
    if store is None:
        with os.scandir(path) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if not e.name.startswith("."):
                        yield e.name, True
                elif e.name in NAMES and e.is_file():
                    yield e.name, False
    else:
        from pyarrow import fs

        for i in store.get_file_info(fs.FileSelector(path)):
            if i.type == fs.FileType.Directory:
                if not i.base_name.startswith("."):
                    yield i.base_name, True
            elif i.base_name in NAMES and i.type == fs.FileType.File:
                yield i.base_name, False


def listed(store, path: str) -> tuple[list[str], set[str]]:
    """(names of directories, info files) of a directory."""
    names, info = [], set()
    for name, directory in _entries(store, path):
        names.append(name) if directory else info.add(name)
    return sorted(names), info


def _is_directory(store, path: str) -> bool:
    if store is None:
        return os.path.isdir(path)
    from pyarrow import fs

    return store.get_file_info(path).type == fs.FileType.Directory


def _shown(path: str) -> str:
    return path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


@dataclass
class Walk(InputPartition):
    """One task's work: directories taken alone, with all below them, or with a share (number, of) of their children."""

    alone: list[str] = field(default_factory=list)
    deep: list[str] = field(default_factory=list)
    shared: list[tuple[str, int, int]] = field(default_factory=list)


class LibraryReader(DataSourceReader):
    def __init__(self, root: str, first: str, parts: int):
        self.root, self.parts = root, max(parts, 1)
        self.names = (first, *(n for n in NAMES if n != first))
        self.dirs: set[str] | None = None
        self.keys: set[str] | None = None
        self.below: list[str] = []

    def partitions(self) -> list[Walk]:
        store, root = _store(self.root)
        out = [Walk() for _ in range(self.parts)]
        if self.dirs is not None:
            for i, d in enumerate(sorted(d for d in self.dirs if self._inside(root, d))):
                out[i % self.parts].alone.append(d)
            return [w for w in out if w.alone] or [Walk()]
        level, alone, shared = [root], [], []
        while level and len(level) < self.parts:
            deeper = []
            for d in level:
                children = listed(store, d)[0]
                alone.append(d)
                if len(children) >= self.parts:
                    shared.append(d)
                else:
                    deeper += [f"{d.rstrip('/')}/{n}" for n in children]
            level = [d for d in deeper if self._leads(d)]
        for at, (kind, found) in enumerate((("alone", alone), ("deep", level))):
            for i, d in enumerate(found):
                getattr(out[(i + at) % self.parts], kind).append(d)
        for d in shared:
            for i, w in enumerate(out):
                w.shared.append((d, i, self.parts))
        return [w for w in out if w.alone or w.deep or w.shared] or [Walk()]

    @staticmethod
    def _inside(root: str, d: str) -> bool:
        """Whether a walk from the root would come to ``d``."""
        below = d[len(root.rstrip("/")) :]
        return d.startswith(root) and (below == "" or below.startswith("/")) and posixpath.normpath(d) == d and not any(p.startswith(".") for p in below.split("/")[1:])

    def _there(self, store, d: str) -> bool:
        """Whether a directory asked for is there, with no link on the way from the root."""
        root = _store(self.root)[1].rstrip("/")
        return _is_directory(store, d) and (store is not None or os.path.realpath(d) == os.path.realpath(root) + d[len(root) :])

    def _leads(self, d: str) -> bool:
        """Whether a directory or one below it may have every prefix asked for."""
        return all(d.startswith(p) or p.startswith(f"{d}/") or p == d for p in self.below)

    def _kept(self, d: str) -> bool:
        return all(d.startswith(p) for p in self.below) and (self.keys is None or posixpath.basename(d) in self.keys)

    def _visit(self, store, walk: Walk) -> Iterator[tuple[str, set[str]]]:
        for d in walk.alone:
            if self.dirs is None or self._there(store, d):
                yield d, listed(store, d)[1]
        stack = list(reversed(walk.deep))
        for d, number, of in walk.shared:
            share = (n for n, directory in _entries(store, d) if directory and zlib.crc32(n.encode("utf-8", "surrogateescape")) % of == number)
            stack += [f"{d.rstrip('/')}/{n}" for n in sorted(share)]
        while stack:
            d = stack.pop()
            if self._leads(d):
                children, info = listed(store, d)
                yield d, info
                stack += [f"{d}/{n}" for n in reversed(children)]

    def read(self, partition: Walk) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.root)
        rows: list[tuple] = []
        for d, info in self._visit(store, partition):
            name = next((n for n in self.names if n in info), None)
            if name and self._kept(d):
                shown, key = _shown(d), posixpath.basename(d)
                rows.append((f"{shown}/{name}", shown, key if _shown(key) == key and key else None, name))
            if len(rows) == 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, r)) for r in rows], FOUND)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, r)) for r in rows], FOUND)


class PrunedLibraryReader(LibraryReader):
    """The reader where the session lets Python sources take filters: directories and keys asked for, or the beginning of
    a directory, decide what is walked."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("dir",), ("citekey",)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                held = "dirs" if f.attribute == ("dir",) else "keys"
                setattr(self, held, asked if getattr(self, held) is None else getattr(self, held) & asked)
            elif isinstance(f, StringStartsWith) and f.attribute == ("dir",):
                self.below.append(f.value)
            else:
                yield f


class LibraryWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Each file is written beside its place and renamed, so a reader finds the old or the new one, whole; a task that
        runs again writes the same."""
        store, root = _store(self.root)
        task = uuid.uuid4().hex
        for batch in iterator:
            for d, text in zip(batch.column("dir").to_pylist(), batch.column("text").to_pylist()):
                target = f"{root}/{d}/{NAMES[0]}"
                loose = f"{target}.{task}.tmp"
                if store is None:
                    try:
                        os.mkdir(f"{root}/{d}")
                    except OSError:  # it is there, or what it stands in isn't
                        os.makedirs(f"{root}/{d}", exist_ok=True)
                    with open(loose, "wb") as f:
                        f.write(text.encode())
                    os.replace(loose, target)
                else:
                    store.create_dir(f"{root}/{d}", recursive=True)
                    with store.open_output_stream(loose) as f:
                        f.write(text.encode())
                    store.move(loose, target)
        return WriterCommitMessage()


class LibrarySource(DataSource):
    """Options of the reader: ``path``, ``first`` (the info file preferred), ``parts`` (tasks, 64), ``pushdown``. The sink
    takes (dir below the root, text)."""

    @classmethod
    def name(cls) -> str:
        return "library"

    def schema(self) -> str:
        return "path string, dir string, citekey string, name string"

    def reader(self, schema) -> LibraryReader:
        kind = PrunedLibraryReader if self.options.get("pushdown") == "true" else LibraryReader
        return kind(self.options["path"], self.options.get("first", NAMES[0]), int(self.options.get("parts", 64)))

    def writer(self, schema, overwrite: bool) -> LibraryWriter:
        return LibraryWriter(self.options["path"])


def paths(spark: SparkSession, root: str, first: str = NAMES[0], parts: int = 64) -> DataFrame:
    """(path, dir, citekey, name): the document directories of a library, the root among them, at any depth; no file is
    opened. Of two info files the one called ``first`` counts. ``_x`` directories are walked, hidden ones aren't. A name
    that isn't UTF-8 has no citekey. Raises for a root that isn't there.

    With ``spark.sql.python.filterPushdown.enabled`` conditions on ``dir`` and ``citekey`` are the source's. The driver
    lists directories until there are ``parts`` of them; a directory with more children than that is dealt out by a hash
    of their names, so only its names pass the driver, once."""
    store, path = _store(root)
    if not _is_directory(store, path):
        raise ValueError(f"no library at {root}")
    spark.dataSource.register(LibrarySource)
    pushdown = (spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") or "false").lower()
    return spark.read.format("library").options(first=first, parts=parts, pushdown=pushdown).load(root)


def opened(listing: DataFrame, root: str) -> DataFrame:
    """The listing with each file's ``content``, null where it can't be read. Files are dealt out evenly first, however
    uneven the tree is; a batch holds some megabytes or one file."""

    def run(batches):
        store, _ = _store(root)
        for batch in batches:
            at, held, size = 0, [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    if store is None:
                        with open(path, "rb") as f:
                            held.append(f.read())
                    else:
                        with store.open_input_stream(path) as f:
                            held.append(f.read())
                except OSError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size > BATCH or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(held)).columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                    at, held, size = i + 1, [], 0

    listing = listing.select("path", "dir", "citekey", "name")
    return dealt(listing, "path").mapInArrow(run, "path string, dir string, citekey string, name string, content binary")


def scanned(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """Documents and errors of a library, or of those directories of ``listing`` (from ``paths``), as one table that parses
    each file once: ``error`` is null for documents. A file that can't be read, isn't an entry or stands in a directory
    without a usable name is an error and stops no other; of two directories of one name the later path gives the
    document."""
    read = library.parsed(opened(paths(spark, root) if listing is None else listing, root))
    all_ = read.withColumn("error", F.when(F.col("citekey").isNull(), "no usable directory name").otherwise(F.col("error")))
    last = W.partitionBy("citekey", F.col("error").isNull()).orderBy(F.desc("dir"))
    all_ = all_.withColumn("_n", F.row_number().over(last)).where("_n = 1 OR error IS NOT NULL").drop("_n")
    year = F.regexp_extract("date", r"^-?[0-9]{4}", 0).try_cast("bigint")
    return all_.withColumn("year", year).withColumn("fts_norm", library.full_text_of(all_))


def documents(spark: SparkSession, root: str, listing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a library: the two parts of ``scanned``. Where both are used, each parses all files."""
    all_ = scanned(spark, root, listing)
    return all_.where("error IS NULL").drop("error"), all_.where("error IS NOT NULL").select("citekey", "dir", "error")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """The document of one directory, its ``error`` if its file is no entry. No other directory is listed. Raises
    ValueError for a directory without an info file."""
    store, inner = _store(path)
    name = next((n for n in NAMES if _is_directory(store, inner) and n in listed(store, inner)[1]), None)
    if name is None:
        raise ValueError(f"{path} contains no {NAMES[0]}")
    row = [(f"{inner}/{name}", inner, posixpath.basename(inner), name)]
    return library.parsed(opened(spark.createDataFrame(row, "path string, dir string, citekey string, name string"), path))


def save(documents: DataFrame, root: str, create: bool = False) -> DataFrame:
    """Write documents (dir below the root, text of their info file) into a library; (dir, reason) of those refused.

    Nothing is written that doesn't read back as an entry, that would leave the root or whose directory's name is no key;
    with ``create`` none whose directory is there already. Of rows of one ``dir`` all are refused, since none goes first.
    Nulls are refused. What was decided stays as a table in ``spark.checkpoint.dir`` for the result."""
    form = "dir string, text string, reason string"
    store, base = _store(root)
    base = base if store is None else None

    def judge(batches):
        for batch in batches:
            reasons = []
            for d, text in zip(batch.column("dir").to_pylist(), batch.column("text").to_pylist()):
                reason = None
                try:
                    library.shred(library.load_yaml(text or ""))
                except Exception as e:  # whatever keeps a text from being an entry is the reason
                    reason = str(e).splitlines()[0] if str(e) else type(e).__name__
                parts = (d or "").split("/")
                if any(p in ("", ".", "..") for p in parts):
                    reason = "outside the library"
                elif any(p.startswith(".") for p in parts):
                    reason = "hidden"
                elif reason is None and create and base is not None and os.path.exists(f"{base}/{d}"):
                    reason = "already exists"
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([batch.column("dir"), batch.column("text"), pa.array(reasons, pa.string())], names=["dir", "text", "reason"])

    spark = documents.sparkSession
    spark.dataSource.register(LibrarySource)
    twice = F.count("*").over(W.partitionBy("dir")) > 1
    one = dealt(documents.select("dir", "text"), "dir").withColumn("_twice", twice)
    judged = one.where("NOT _twice").drop("_twice").mapInArrow(judge, form)
    named = F.concat(F.lit("no key: "), problem(F.regexp_extract("dir", "[^/]*$", 0)))
    judged = judged.withColumn("reason", F.coalesce("reason", named))
    path = shared_path(spark, "saved")  # what is written and what is refused is decided once
    judged.unionByName(one.where("_twice").select("dir", "text", F.lit("several texts").alias("reason"))).write.parquet(path)
    decided = spark.read.parquet(path)
    dealt(decided.where("reason IS NULL").select("dir", "text"), "dir").write.format("library").mode("append").save(root)
    return decided.where("reason IS NOT NULL").select("dir", "reason")
