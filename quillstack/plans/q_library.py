"""Libraries on disk: ``part`` written as directories with info files by the sink, then walked and read by the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.plans.fixtures import table
from quillstack.sources import bibfile, walk
from quillstack.sources.tables import dealt, shared_path

QUERIES, ORACLE_SQL = {}, {}

#: Where a part's directory stands: beside others, on a shelf that starts with ``_`` as every third does, or hidden.
_DIR = "CASE p_partkey % 3 WHEN 0 THEN concat('_', lower(p_brand)) WHEN 1 THEN 'all/of/them' ELSE concat('size', cast(p_size as varchar(20))) END"
_KEY = "concat('p', cast(p_partkey as varchar(20)))"
_PLACE = f"replace(concat({_DIR}, '/', {_KEY}), '#', '')"
_BAD = "p_partkey % 7 = 0"


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dir, text): every part as an info file, of every seventh one with a type that isn't known."""
    text = f"""concat('type: ', CASE WHEN {_BAD} THEN 'gadget' ELSE 'book' END, '\ntitle: "', p_name, '"\ndate: ', 1950 + p_size, '\nx-meta: {{tags: [', p_type, ']}}\n')"""
    return table(spark, sf_dir, "part").selectExpr(f"{_PLACE} AS dir", f"{text} AS text")


def library(spark: SparkSession, sf_dir: str) -> str:
    """The root of a library of all parts, with hidden directories beside them that are no documents."""
    root = shared_path(spark, "library")
    spark.dataSource.register(walk.LibrarySource)
    files = entries(spark, sf_dir)
    hidden = files.where("dir LIKE 'size%'").selectExpr("concat('.bib/', dir) AS dir", "text")
    dealt(files.unionByName(hidden), "dir").write.format("library").mode("append").save(root)
    return root


def below(column: str = "dir"):
    return F.regexp_replace(column, "^.*/library-[0-9a-f]{32}/", "")


@query("s_01_walk", f"SELECT {_KEY} AS citekey, {_PLACE} AS dir, 'info.yml' AS name FROM part")
def walked(spark, sf):
    return walk.paths(spark, library(spark, sf)).select("citekey", below().alias("dir"), "name")


@query("s_04_full_scan", f"SELECT {_KEY} AS citekey, CASE WHEN {_BAD} THEN NULL ELSE p_name END AS title, CASE WHEN {_BAD} THEN NULL ELSE CAST(1950 + p_size AS BIGINT) END AS year, {_BAD} AS failed FROM part")
def full_scan(spark, sf):
    return walk.scanned(spark, library(spark, sf)).select("citekey", "title", "year", F.col("error").isNotNull().alias("failed"))


@query("s_07_shelf", f"SELECT {_KEY} AS citekey, p_name AS title FROM part WHERE p_partkey % 3 = 0 AND p_brand = 'Brand#2' AND NOT {_BAD}")
def shelf(spark, sf):
    """The documents below one directory; its name starts with ``_``."""
    root = library(spark, sf)
    listing = walk.paths(spark, root).where(F.contains("dir", F.lit("/_brand2/")))
    return walk.documents(spark, root, listing)[0].select("citekey", "title")


@query("s_07_directory", f"SELECT {_KEY} AS citekey, p_name AS title FROM part WHERE p_partkey = 3")
def directory(spark, sf):
    root = library(spark, sf)
    place = entries(spark, sf).where("endswith(dir, '/p3')").first().dir
    return walk.directory(spark, f"{root}/{place}").select("citekey", "title")


@query("k_06_save", f"SELECT {_PLACE} AS dir, 'refused' AS outcome FROM part WHERE {_BAD} UNION ALL SELECT concat('../', {_KEY}), 'refused' FROM part UNION ALL SELECT {_PLACE}, 'written' FROM part WHERE NOT {_BAD}")
def save(spark, sf):
    """Every part is saved, and asked to be saved outside the library once more."""
    root = shared_path(spark, "library")
    asked = entries(spark, sf)
    outside = table(spark, sf, "part").selectExpr(f"concat('../', {_KEY}) AS dir", "'type: book' AS text")
    refused = walk.save(asked.unionByName(outside), root).select("dir", F.lit("refused").alias("outcome"))
    return refused.unionByName(walk.paths(spark, root).select(below().alias("dir"), F.lit("written").alias("outcome")))


def bib_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of BibTeX files of all parts: a string and an entry that names it, in its note a record that is none; every
    seventh is followed by one that is never closed."""
    record = rf"""concat('@string{{b', p_partkey, ' = {{', p_brand, '}} # " {{@}} "}}\n@book{{', {_KEY}, ',\n title = {{', p_name, '}},\n note = {{see\n@misc{{no, title={{x}}}}\n}},\n year = ', 1950 + p_size, ',\n publisher = B', p_partkey, ' # {{', p_type, '}}}}', CASE WHEN {_BAD} THEN '\n@misc{{open, title = {{x' ELSE '' END)"""
    path = shared_path(spark, "bib")
    table(spark, sf_dir, "part").selectExpr(f"{record} AS value").write.text(path)
    return path


@query("s_08_split", f"SELECT {_KEY} AS key, 'book' AS type, p_name AS title, CAST(1950 + p_size AS VARCHAR) AS year, p_brand || ' @ ' || p_type AS publisher FROM part")
def bib_split(spark, sf):
    found = bibfile.read(spark, bib_files(spark, sf))[0].where("error IS NULL")
    return found.select("key", *(F.get_json_object("body", f"$.{a}").alias(b) for a, b in (("type", "type"), ("title", "title"), ("date", "year"), ("publisher", "publisher"))))


@query("s_08_errors", f"SELECT count(*) AS errors FROM part WHERE {_BAD}")
def bib_errors(spark, sf):
    """Errors that are told one by one, and the number of the others."""
    errors = bibfile.read(spark, bib_files(spark, sf))[0].where("error IS NOT NULL")
    return errors.agg(F.coalesce(F.sum(F.when(F.col("block").isNull(), F.split("error", " ")[1].cast("bigint")).otherwise(1)), F.lit(0)).cast("bigint").alias("errors"))
