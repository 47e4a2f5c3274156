"""BibTeX files of any size: Spark's text reader cuts them at every ``@``, and records are put together by their braces.

A piece runs from an ``@`` to the next one. With the depth of open braces before each piece, and the least depth that is
reached from there to the end of the file, a piece that opens a record and lies at that depth or above isn't part of what
came before: no brace that is open there is ever closed. Both are prefix sums: within a split by a window over narrow
rows, between splits over one row a split. Only pieces that belong together meet; all others are parsed where they are.

The entries are those of parsing the file as one text, as long as braces are balanced within quoted values and an entry in
parentheses has no ``@word{`` in its values. A record is one task's; a brace that is left open at the top of a file and
one too many at its end make one record of all between, as for any parser.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.sources.catalogues import TOLD, bibtex_body, parse_bibtex
from quillstack.sources.tables import delete, shared_path

#: What a record starts with, after its ``@``.
HEAD = r"^\s*\w+\s*[{(]"
#: A word that may be a string's name: what follows ``=`` or ``#`` without braces or quotes.
NAME = r'[=#]\s*([^\s,#}"){=]+)'
PLACE = ["file", "block", "row"]
_DEFINED = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("name", "value")]))
_ENTRIES = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("key", "body", "error")]))
_UNREAD = re.compile(r"\\.|[^{}\\]+|\\", re.S)


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("depth", "low")]))
def braces(texts: pd.Series) -> pd.DataFrame:
    """By how much a text changes the depth of braces, and the least it comes to (0 at most); escaped ones don't count."""
    marks = [" " + _UNREAD.sub("", t or "") for t in texts]
    code = np.frombuffer("".join(marks).encode(), np.uint8)
    depth = np.cumsum((code == ord("{")).astype(np.int64) - (code == ord("}")))
    sizes = np.array([len(m) for m in marks], np.int64)
    starts = np.cumsum(sizes) - sizes
    before = depth[starts]  # the blank of each changes nothing
    return pd.DataFrame({"depth": depth[starts + sizes - 1] - before, "low": np.minimum.reduceat(depth, starts) - before} if len(marks) else {"depth": [], "low": []})


def pieces(spark: SparkSession, path) -> DataFrame:
    """(file, block, row, text, depth, low): the texts between any two ``@``, in order of block and row within a file."""
    lines = spark.read.option("lineSep", "@").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"))
    return rows.withColumn("b", braces("text")).select(*PLACE, "text", "b.depth", "b.low")


def starts(rows: DataFrame) -> DataFrame:
    """(file, block, row, at, alone) of pieces (file, block, row, depth, low, head): ``at`` is the (block, row) where a
    piece's record starts, ``alone`` says that the record has no other piece.

    The depth never falls below 0: a brace too many closes nothing."""
    here = W.partitionBy("file", "block").orderBy("row")
    so_far, files = here.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("file").orderBy("block")
    # What follows is taken backwards: a frame that grows from its start is summed once, one that shrinks anew by row.
    from_here = W.partitionBy("file", "block").orderBy(F.desc("row")).rowsBetween(W.unboundedPreceding, 0)
    earlier, later = files.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("file").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    spot = F.struct("block", "row")

    rows = rows.withColumn("sum", F.sum("depth").over(so_far)).withColumn("dip", F.col("sum") - F.col("depth") + F.col("low")).withColumn("least", F.min("dip").over(so_far))
    split = rows.groupBy("file", "block").agg(F.max_by("sum", "row").alias("sum"), F.min("dip").alias("dip"))
    split = split.withColumn("base", F.coalesce(F.sum("sum").over(earlier), F.lit(0))).withColumn("deepest", F.coalesce(F.min(F.col("base") + F.col("dip")).over(earlier), F.lit(0)))
    rows = rows.join(split.select("file", "block", "base", "deepest"), ["file", "block"])
    floor = F.least(F.lit(0), F.col("deepest"), F.col("base") + F.col("least"))
    rows = rows.select(*PLACE, "head", (F.col("base") + F.col("sum") - floor).alias("open"), F.greatest(F.lit(0), F.col("base") + F.col("dip") - floor).alias("reached"))

    ends = rows.groupBy("file", "block").agg(F.max_by("open", "row").alias("open"), F.min("reached").alias("reached"))
    ends = ends.select("file", "block", F.lag("open").over(files).alias("came"), F.min("reached").over(later).alias("to_come"))
    rows = rows.join(ends, ["file", "block"])
    before = F.coalesce(F.lag("open").over(here), F.col("came"))
    rows = rows.withColumn("before", before).withColumn("reached", F.least(F.min("reached").over(from_here), "to_come"))
    rows = rows.select(*PLACE, (F.col("before").isNull() | (F.col("head") & (F.col("before") <= F.col("reached")))).alias("free"))

    last = rows.groupBy("file", "block").agg(F.max(F.when(F.col("free"), spot)).alias("at"), F.min_by("free", "row").alias("free"))
    last = last.select("file", "block", F.max("at").over(earlier).alias("held"), F.coalesce(F.lead("free").over(files), F.lit(True)).alias("next"))
    rows = rows.join(last, ["file", "block"])
    at = F.coalesce(F.max(F.when(F.col("free"), spot)).over(so_far), F.col("held"))
    return rows.select(*PLACE, at.alias("at"), (F.col("free") & F.coalesce(F.lead("free").over(here), F.col("next"))).alias("alone"))


def records(table: DataFrame) -> DataFrame:
    """(file, block, row, text): texts that are parsed on their own, made of the pieces of a table."""
    narrow = table.select(*PLACE, "depth", "low", F.col("text").rlike(HEAD).alias("head"))
    first = table.where("block = 0").groupBy("file").agg(F.min("row").alias("first"))
    marked = table.select(*PLACE, "text").join(starts(narrow), PLACE).join(first, "file", "left")
    marked = marked.withColumn("text", F.when((F.col("block") == 0) & (F.col("row") == F.col("first")), F.col("text")).otherwise(F.concat(F.lit("@"), "text")))
    joint = marked.where("NOT alone").groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("block", "row", "text"))).alias("all"))
    joint = joint.select("file", "at.block", "at.row", F.array_join("all.text", "").alias("text"))
    return marked.where("alone").select(*PLACE, "text").unionByName(joint)


def with_names(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """Records with ``names``: what the strings that a record names stood for before it, as JSON; null for none.

    A use meets the definitions of its name in its file that differ from the one before them."""
    if known is None:
        return rows.withColumn("names", F.lit(None).cast("string"))
    of_name = W.partitionBy("file", "name").orderBy("block", "row", "n")
    changes = known.withColumn("old", F.lag("value").over(of_name)).where("old IS NULL OR old != value")
    changes = changes.select("file", "name", "value", F.struct("block", "row", "n").alias("since"), F.struct("block", "row").alias("of"))
    uses = rows.select(*PLACE, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(NAME), 1), F.lower))).alias("name"))
    met = uses.join(changes, ["file", "name"]).where(F.col("of") < F.struct("block", "row"))
    valid = met.groupBy(*PLACE, "name").agg(F.max_by("value", "since").alias("value"))
    names = valid.groupBy(*PLACE).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "value")))).alias("names"))
    return rows.join(names, PLACE, "left")


@F.pandas_udf(_DEFINED)
def _defined(texts: pd.Series, names: pd.Series) -> pd.Series:
    out = []
    for text, known in zip(texts, names):
        old = json.loads(known) if known else {}
        new = dict(old)
        parse_bibtex(text, new)
        out.append([{"name": k, "value": v} for k, v in new.items() if old.get(k, k) != v or re.search(rf"(?i)@\s*string\s*[{{(]\s*{re.escape(k)}\s*=", text)])
    return pd.Series(out)


@F.pandas_udf(_ENTRIES)
def _parsed(texts: pd.Series, names: pd.Series) -> pd.Series:
    out = []
    for text, known in zip(texts, names):
        entries, errors = parse_bibtex(text, json.loads(known) if known else {})
        found = [{"key": e["key"], "body": json.dumps(bibtex_body(e), ensure_ascii=False), "error": None} for e in entries]
        out.append(found + [{"key": None, "body": None, "error": e} for e in errors])
    return pd.Series(out)


def written(df: DataFrame, name: str, paths: list[str]) -> DataFrame:
    paths.append(shared_path(df.sparkSession, name))
    df.write.parquet(paths[-1])
    return df.sparkSession.read.parquet(paths[-1])


def definitions(rows: DataFrame, paths: list[str]) -> DataFrame | None:
    """(file, block, row, n, name, value) of all strings; None if there are none. Strings that name others are read again
    until nothing changes: a round more for each level of naming."""
    naming = written(rows.where(F.col("text").rlike(r"(?i)@\s*string\s*[{(]")), "strings", paths)
    known = None
    while True:
        made = with_names(naming, known).select(*PLACE, F.posexplode(_defined("text", "names")).alias("n", "d")).select(*PLACE, "n", "d.name", "d.value")
        made = written(made, "definitions", paths)
        if known is None and made.isEmpty():
            return None
        if known is not None and made.select(*PLACE, "name", "value").exceptAll(known.select(*PLACE, "name", "value")).isEmpty():
            return made
        known = made


def read(spark: SparkSession, path) -> tuple[DataFrame, str]:
    """((file, block, row, n, key, body, error), path of the table that it reads): the entries of BibTeX files, bodies as
    JSON, ordered within a file by block, row and n, repeated keys included.

    A file is cut like any text of Spark's (``spark.sql.files.maxPartitionBytes``). Strings hold from where they are
    defined to the end of their file. What can't be read is a row with an error alone: of each file the first ``TOLD``
    one by one, the others as one row with their number, whose place is null. Empty files give no rows; bytes that aren't
    UTF-8 are read as replacements. The path is to be deleted once the result was read."""
    paths: list[str] = []
    rows = written(records(written(pieces(spark, path), "pieces", paths)), "records", paths)
    made = with_names(rows, definitions(rows, paths)).select(*PLACE, F.posexplode(_parsed("text", "names")).alias("n", "e")).select(*PLACE, "n", "e.*")
    kept: list[str] = []
    made = written(made, "entries", kept)
    for p in paths:
        delete(spark, p)
    errors = made.where("error IS NOT NULL")
    told = errors.withColumn("rank", F.row_number().over(W.partitionBy("file").orderBy("block", "row", "n"))).where(F.col("rank") <= TOLD).drop("rank")
    more = errors.groupBy("file").count().where(F.col("count") > TOLD)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in made.drop("file", "error").dtypes]
    more = more.select("file", *nothing, F.concat(F.lit("and "), (F.col("count") - TOLD).cast("string"), F.lit(" more")).alias("error"))
    return made.where("error IS NULL").unionByName(told).unionByName(more), kept[0]
