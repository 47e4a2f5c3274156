"""Query trees to Columns over the wide document table.

Scalar fields keep SQL's three-valued logic (NOT of a null is null, so the row drops out); fields with many values are
two-valued, since their arrays are never null. Nothing is spliced into SQL text: values are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.plans import querylang as q

SCALAR = {"key": "citekey", "type": "type", "title": "title", "publisher": "publisher", "parent": "parent_title"}
ROLES = {"author": ("author",), "editor": ("editor",), "person": ("author", "editor")}
SERIALS = {"doi": ("doi",), "arxiv": ("arxiv",), "isbn": ("isbn",), "id": ("doi", "arxiv", "isbn", "issn", "pmid")}


def matches(c: Column, value) -> Column:
    """A text column against a text value; false where the value is of another kind."""
    if isinstance(value, q.Contains):
        return tx.contains_fold(c, value.text)
    return c == value.text if isinstance(value, q.Exact) else F.lit(False)


def of_field(name: str, value) -> Column:
    if name in SCALAR:
        return matches(F.col(SCALAR[name]), value)
    if name == "year":
        if not isinstance(value, q.Range):
            return F.lit(False)
        year = F.col("year")
        sides = ([year >= value.low] if value.low is not None else []) + ([year <= value.high] if value.high is not None else [])
        return year.isNotNull() if not sides else sides[0] if len(sides) == 1 else sides[0] & sides[1]
    if name == "file":
        return (F.size("files") > 0) if value.value else (F.size("files") == 0)
    if name == "tag":
        return F.exists("tags", lambda t: matches(t, value))
    if name in ROLES:
        return F.exists("persons", lambda p: p["role"].isin(*ROLES[name]) & matches(p["name"], value))
    if name == "id":
        return F.exists("serials", lambda s: matches(s["value"], value))
    return F.exists("serials", lambda s: s["kind"].isin(*SERIALS[name]) & matches(s["value"], value))


def column(tree, known: dict | None = None) -> Column:
    """The tree as a Column; terms that are ``known`` are the Columns given for them."""
    match tree:
        case q.All():
            return F.lit(True)
        case q.And(a, b):
            return column(a, known) & column(b, known)
        case q.Or(a, b):
            return column(a, known) | column(b, known)
        case q.Not(a):
            return ~column(a, known)
        case q.Prefix() | q.Phrase() if known and tree in known:
            return known[tree]
        case q.Prefix(t):
            return tx.full_text_match(F.col("fts_norm"), t, True)
        case q.Phrase(t):
            return tx.full_text_match(F.col("fts_norm"), t, False)
        case q.Field(name, value):
            return of_field(name, value)
    raise TypeError(tree)


HIT = ("citekey", "dir", "title", "year", "type")


def search(documents: DataFrame, query: str, columns=HIT) -> DataFrame:
    """Hits of a query in the order of their keys."""
    return documents.where(column(q.parse(query))).select(*columns).orderBy("citekey")
