"""Exports: pruned bodies, YAML, BibTeX and BibLaTeX, JSON results, template lines."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions import keys as k
from quillstack.sources.library import ENTRY_FIELDS


def check_fields(fields: list[str]) -> None:
    for f in fields:
        if f == "type":
            raise ValueError("`type` cannot be excluded")
        if f not in ENTRY_FIELDS:
            raise ValueError(f"`{f}` is not an entry field; one of {', '.join(ENTRY_FIELDS)}")


def prune(value, fields: set[str]):
    """A body without those fields, in its parents too."""
    if isinstance(value, dict):
        return {a: prune(b, fields) for a, b in value.items() if a not in fields}
    return [prune(x, fields) for x in value] if isinstance(value, list) else value


def to_yaml(key: str, body: dict, fields: set[str] = frozenset(("abstract",))) -> str:
    import yaml

    entry = {a: b for a, b in body.items() if not a.startswith("x-")}
    return yaml.safe_dump({key: prune(entry, set(fields))}, allow_unicode=True, sort_keys=False)


#: Entry types to export types.
_BY_PARENT = {("article", "proceedings"): "inproceedings", ("article", "anthology"): "incollection", ("chapter", "anthology"): "incollection"}
_BY_TYPE = {"article": "article", "blog": "article", "newspaper": "article", "periodical": "article", "book": "book", "anthology": "book", "chapter": "inbook", "entry": "inbook", "proceedings": "proceedings", "thesis": "thesis", "report": "report", "manuscript": "unpublished", "web": "online", "misc": "online", "patent": "patent"}


def to_bibtex(key: str, body: dict, latex: bool = False) -> str:
    """One entry; BibLaTeX has a ``date``, BibTeX ``year`` and ``month``. A container's volume replaces the entry's."""
    parents = body.get("parent") or []
    parent = (parents if isinstance(parents, list) else [parents])[0] if parents else {}
    kind = _BY_PARENT.get((body["type"], parent.get("type"))) or _BY_TYPE.get(body["type"], "misc")
    text = lambda v: v.get("value", v.get("name")) if isinstance(v, dict) else v
    serial = body.get("serial-number") or {}
    date = str(body.get("date") or "")
    out: dict[str, object] = {"title": text(body.get("title"))}
    for role in ("author", "editor"):
        people = body.get(role) or []
        out[role] = " and ".join(people if isinstance(people, list) else [people]) or None
    if date and latex:
        out["date"] = date
    elif date:
        out["year"] = date[:4]
        out["month"] = int(date[5:7]) if len(date) >= 7 else None
    out |= {n: serial.get(n) for n in ("doi", "isbn", "issn")} | {"url": body.get("url"), "pages": body.get("page-range"), "volume": body.get("volume"), "publisher": text(body.get("publisher"))}
    publisher = body.get("publisher")
    out["address"] = text(body.get("location")) or (publisher.get("location") if isinstance(publisher, dict) else None)
    out["note"] = text(body.get("note"))
    if parent:
        out["journal" if kind == "article" else "booktitle"] = text(parent.get("title"))
        out["volume"] = parent.get("volume", out["volume"])
        out["number"] = parent.get("issue")
    lines = [f"  {a} = {{{b}}}" for a, b in out.items() if b not in (None, "")]
    return f"@{kind}{{{key},\n" + ",\n".join(lines) + "\n}\n"


def rendered(documents: DataFrame, form: str, exclude: tuple[str, ...] = ("abstract",)) -> DataFrame:
    """(citekey, text) of each document (citekey, body as JSON) in the order of keys: yaml, bibtex or biblatex."""
    check_fields(list(exclude))

    @F.pandas_udf(T.StringType())
    def one(keys: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for key, b in zip(keys, bodies):
            body = prune(json.loads(b), set(exclude))
            out.append(to_yaml(key, body) if form == "yaml" else to_bibtex(key, body, form == "biblatex"))
        return pd.Series(out, dtype=object)

    return documents.select("citekey", one("citekey", "body").alias("text")).orderBy("citekey")


RESULT = ("id", "source", "citekey", "cite", "title", "subtitle", "year", "authors", "container", "tags", "files", "in_library")


def result_json(results: DataFrame) -> DataFrame:
    """One JSON text a row; nulls and empty lists are left out."""
    columns = [F.when(F.size(c) > 0, F.col(c)).alias(c) if c in ("authors", "tags", "files") else F.col(c) for c in RESULT]
    return results.select(F.to_json(F.struct(*columns)).alias("json"))


def unescape_template(t: str) -> str:
    r"""``\t``, ``\0`` and ``\\`` mean what they say; any other backslash stays."""
    return re.sub(r"\\([t0\\])", lambda m: {"t": "\t", "0": "\0", "\\": "\\"}[m[1]], t)


FILTERS = {"lower": lambda c: F.lower(c), "upper": lambda c: F.upper(c), "trim": lambda c: F.trim(c), "replace": lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))} | {
    n: getattr(k, n) for n in ("ascii", "slug", "words", "word", "abbrev", "truncate", "nostop", "alnum", "nospace", "titlecase")
}


def template(text: str, context: dict[str, Column]) -> Column:
    """A template of ``{{ path | filter(args) | ... }}`` parts as an expression; null where a path is null, so that the
    next template of a chain is tried. Unknown paths and filters raise ValueError."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{\{(.*?)\}\}", text)):
        if i % 2 == 0:
            parts += [F.lit(piece)] if piece else []
            continue
        path, *filters = (p.strip() for p in re.split(r"\|(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", piece))
        if path not in context:
            raise ValueError(f"nothing is named `{path}`")
        c = context[path].cast("string")
        for f in filters:
            m = re.fullmatch(r"(\w+)(?:\((.*)\))?", f)
            if not m or m[1] not in FILTERS:
                raise ValueError(f"no filter `{f}`")
            args = [int(x) if x.isdigit() else x.strip("'\"") for x in re.findall(r"\d+|'[^']*'|\"[^\"]*\"", m[2] or "")]
            c = FILTERS[m[1]](c, *args)
        parts.append(c)
    return F.concat(*parts) if parts else F.lit("")


def template_lines(results: DataFrame, text: str, context: dict[str, Column]) -> DataFrame:
    return results.select(F.regexp_replace(template(unescape_template(text), context), "[\r\n]", " ").alias("line"))


def is_pdf(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 1024).cast("string"), F.lit("%PDF-"))
