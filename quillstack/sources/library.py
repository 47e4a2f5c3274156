"""Libraries on disk as DataFrames: a directory with an info file is a document; bad files go to an error channel.

Files are listed and read by Spark (``binaryFile``), so a library may be in any store that Spark reads. YAML is parsed
in Arrow batches, one file at a time; everything after that is columns.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.functions import text as tx

#: Names of fields an entry may have besides its type.
ENTRY_FIELDS = (
    "abstract affiliated archive archive-location author call-number chapter date edition editor genre issue language location note organization page-range page-total parent "
    "publisher runtime serial-number time-range title url volume volume-total"
).split()
#: Entry types.
ENTRY_TYPES = "article chapter entry anthos report thesis web scene artwork patent case newspaper legislation manuscript post misc performance periodical proceedings book blog reference conference anthology repository thread video audio exhibition original".split()
#: The reserved key under which a library's own data stands in an entry; any top-level ``x-`` key with a mapping is read.
META_KEY = "x-meta"
SERIALS = ("doi", "arxiv", "isbn", "issn", "pmid")
#: Fixed value: tabs, byte order marks, comments at a block's head, bare tags, question marks in flow style: libyaml takes some of what
#: the plain parser refuses.
APART = re.compile(r"[\t\ufeff]|[|>][-+0-9]*#|(?:^|[\s\[{,])!(?:[\s,\]}]|\Z)|[\[{][\s\S]*\?")

BODY = (
    "type string, title string, parent_title string, date string, publisher string, abstract string, persons array<struct<role:string,position:int,name:string>>, "
    "serials array<struct<kind:string,value:string>>, tags array<string>, files array<string>, added string, provenance map<string,string>, body string"
)


def files(spark: SparkSession, root: str, names: str = "info.y*ml") -> DataFrame:
    """(path, dir, citekey, name, content) of info files below ``root``; hidden directories are skipped. Spark's own
    listing also leaves out files and directories that start with ``_``; ``walk`` has them."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    path = F.regexp_replace("path", "/+$", "")
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    below = F.regexp_replace(path, r"^[a-z]+:/*" + re.escape(base.lstrip("/")), "")
    d = F.regexp_replace(path, "/[^/]*$", "")
    out = raw.select(path.alias("path"), d.alias("dir"), F.url_decode(F.regexp_replace(F.regexp_extract(d, "[^/]*$", 0), r"\+", "%2B")).alias("citekey"), F.regexp_extract(path, "[^/]*$", 0).alias("name"), "content", "length")
    return out.where(~F.contains(below, F.lit("/.")))


def preferred(listing: DataFrame, first: str = "info.yml") -> DataFrame:
    """One info file a directory: the one of the preferred name if there are two."""
    w = W.partitionBy("dir").orderBy((F.col("name") != first).cast("int"), "name")
    return listing.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


@lru_cache(maxsize=2)
def yaml_loader(fast: bool = False):
    """A loader that keeps dates, yes/no and base-60 numbers as text; ``fast`` where libyaml is there: its parser."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader) if fast else yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool", "tag:yaml.org,2002:int", "tag:yaml.org,2002:float")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("^(?:true|false|True|False|TRUE|FALSE)$"), list("tfTF"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile("^[-+]?[0-9]+$"), list("-+0123456789"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?[0-9]+\.[0-9]*(?:[eE][-+]?[0-9]+)?$"), list("-+0123456789"))
    return Loader


def load_yaml(text: str):
    """What a YAML text says. A text that the fast parser refuses is judged by the plain one, whose reasons are told; so is
    one with what the two may take differently."""
    import yaml

    if not APART.search(text):
        try:
            return yaml.load(text, yaml_loader(fast=True))
        except Exception:  # the plain parser says why, or takes it
            pass
    return yaml.load(text, yaml_loader())


def _text(v) -> str | None:
    return None if v is None or isinstance(v, (dict, list)) else str(v)


def _value(v) -> str | None:
    """Formatted strings may stand as ``{value: ...}`` or a publisher as ``{name: ...}``."""
    return _text(v.get("value", v.get("name"))) if isinstance(v, dict) else _text(v)


def _people(v) -> list[str]:
    out = []
    for p in v if isinstance(v, list) else [v] if v else []:
        if isinstance(p, dict):
            name = " ".join(x for x in (_text(p.get("prefix")), _text(p.get("name"))) if x)
            out.append(", ".join(x for x in (name, _text(p.get("given-name"))) if x))
        elif _text(p):
            parts = [x.strip() for x in str(p).split(",")]
            out.append(f"{parts[0]}, {parts[-1]}" if len(parts) > 1 else parts[0])
    return out


def shred(body: dict) -> dict:
    """The columns of one entry. Raises ValueError for what isn't an entry."""
    if not isinstance(body, dict):
        raise ValueError("an entry must be a mapping")
    metas = [k for k, v in body.items() if str(k).startswith("x-") and isinstance(v, dict)]
    meta = body[META_KEY] if META_KEY in metas else body[metas[0]] if metas else {}
    entry = {k: v for k, v in body.items() if not str(k).startswith("x-")}
    kind = str(entry.get("type", "")).lower()
    if kind not in ENTRY_TYPES:
        raise ValueError(f"unknown entry type {entry.get('type')!r}")
    if unknown := [k for k in entry if k != "type" and k not in ENTRY_FIELDS]:
        raise ValueError(f"unknown field {unknown[0]!r}")
    parents = entry.get("parent") or []
    parents = [p for p in (parents if isinstance(parents, list) else [parents]) if isinstance(p, dict)]
    serials: list[tuple[str, str]] = []

    def add(source, kinds):
        s = source.get("serial-number")
        for k in kinds:
            v = _text(s.get(k)) if isinstance(s, dict) else None
            if v and v.strip() and (k, v.strip().lower()) not in serials:
                serials.append((k, v.strip().lower()))

    add(entry, SERIALS)
    for p in parents:
        add(p, ("isbn", "issn"))
    listed = lambda v: [str(x) for x in v] if isinstance(v, list) else [str(v)] if isinstance(v, (str, int)) else []
    return {
        "type": kind, "title": _value(entry.get("title")), "parent_title": _value(parents[0].get("title")) if parents else None, "date": _text(entry.get("date")),
        "publisher": _value(entry.get("publisher")) or (_value(parents[0].get("publisher")) if parents else None), "abstract": _value(entry.get("abstract")),
        "persons": [{"role": r, "position": i, "name": n} for r in ("author", "editor") for i, n in enumerate(_people(entry.get(r)))],
        "serials": [{"kind": k, "value": v} for k, v in serials], "tags": listed(meta.get("tags")), "files": listed(meta.get("files")), "added": _text(meta.get("added")),
        "provenance": [(str(k), str(v)) for k, v in (meta.get("provenance") or {}).items()] if isinstance(meta.get("provenance"), dict) else [], "body": json.dumps(body, ensure_ascii=False, default=str),
    }


def parsed(listing: DataFrame) -> DataFrame:
    """The listing's files as documents, with ``error`` where a file is no entry; no file stops the others."""
    fields = [f.strip() for f in re.split(r", (?=[a-z_]+ )", BODY)]
    kinds = {"string": pa.string(), "persons": pa.list_(pa.struct([("role", pa.string()), ("position", pa.int32()), ("name", pa.string())])), "serials": pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])), "tags": pa.list_(pa.string()), "files": pa.list_(pa.string()), "provenance": pa.map_(pa.string(), pa.string())}
    names = [f.split()[0] for f in fields]

    def run(batches):
        for batch in batches:
            rows, errors = [], []
            for content in batch.column("content").to_pylist():
                try:
                    if content is None:
                        raise ValueError("the file can't be read")
                    rows.append(shred(load_yaml(content.decode())))
                    errors.append(None)
                except Exception as e:  # any reason that a file can't be read goes to the error channel
                    rows.append(dict.fromkeys(names))
                    errors.append(str(e).splitlines()[0][:300] if str(e) else type(e).__name__)
            columns = [pa.array([r[n] for r in rows], kinds.get(n, kinds["string"])) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("citekey"), batch.column("dir"), batch.column("hash"), batch.column("size"), *columns, pa.array(errors, pa.string())], names=["citekey", "dir", "hash", "size", *names, "error"])

    source = listing.select("citekey", "dir", "content", F.sha2("content", 256).alias("hash"), F.length("content").cast("bigint").alias("size"))
    return source.mapInArrow(run, f"citekey string, dir string, hash string, size bigint, {BODY}, error string")


def full_text_of(d: DataFrame) -> Column:
    """Key, title, container, people, tags and abstract in one text."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return tx.full_text(F.concat_ws(" ", "citekey", text(F.col("title")), text(F.col("parent_title")), F.array_join(F.transform("persons", lambda p: p["name"]), " "), F.array_join("tags", " "), text(F.col("abstract"))))


def documents(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a library. Of two directories of one name the later path gives the document."""
    all_ = parsed(preferred(files(spark, root)))
    good = all_.where("error IS NULL").drop("error")
    last = W.partitionBy("citekey").orderBy(F.desc("dir"))
    good = good.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    year = F.regexp_extract("date", r"^-?[0-9]{4}", 0).try_cast("bigint")
    good = good.withColumn("year", year).withColumn("fts_norm", full_text_of(good))
    return good, all_.where("error IS NOT NULL").select("citekey", "dir", "error")


def paths(spark: SparkSession, root: str) -> DataFrame:
    """(citekey, dir, path): no file is opened."""
    return preferred(files(spark, root).select("path", "dir", "citekey", "name")).select("citekey", "dir", "path").orderBy("citekey")
