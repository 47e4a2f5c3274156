"""The search-box language: text to a small tree of terms.

Terms are ``field:value``, bare words (prefixes) and quoted phrases; ``AND OR NOT``, adjacency, ``-term`` and
parentheses combine them. NOT binds tightest, OR loosest. Everything here runs on the driver, over one short string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Names of the search fields, by field.
FIELDS = {
    "key": ("key", "citekey", "ref"), "type": ("type",), "title": ("title",), "author": ("author",), "editor": ("editor",), "person": ("person", "by"), "year": ("year", "date"),
    "tag": ("tag", "tags"), "publisher": ("publisher",), "parent": ("parent", "journal", "booktitle", "in"), "doi": ("doi",), "arxiv": ("arxiv",), "isbn": ("isbn",), "id": ("id", "serial"), "file": ("file", "has"),
}
NAMES = {alias: field for field, aliases in FIELDS.items() for alias in aliases}
#: What counts as yes.
YES = ("yes", "y", "true", "1", "any")


class QueryError(ValueError):
    """The text isn't a query."""


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Contains:
    text: str


@dataclass(frozen=True)
class Exact:
    text: str


@dataclass(frozen=True)
class Range:
    low: int | None
    high: int | None


@dataclass(frozen=True)
class Flag:
    value: bool


@dataclass(frozen=True)
class Field:
    name: str
    value: Contains | Exact | Range | Flag


@dataclass(frozen=True)
class Prefix:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


#: One token: what stands alone, a quoted text (with the field name before it, if any), or a run up to a space, a
#: parenthesis, or a colon that a quote follows.
_LEX = re.compile(r"""\s*(?:(?P<paren>[()])|(?P<minus>-)(?=\S)|(?P<quote>["'])|(?P<word>[^\s()]+?(?:(?=[\s()])|$|(?<=:)(?=["']))))""", re.S)


def tokenize(text: str) -> list[tuple[str, ...]]:
    """Tokens as tuples: ("(",), (")",), ("AND",), ("OR",), ("NOT",), ("word", w), ("quoted", w), ("pair", field, value,
    quoted)."""
    out: list[tuple] = []
    at = 0

    def quoted(start: int) -> tuple[str, int]:
        end = text.find(text[start], start + 1)
        if end < 0:
            raise QueryError(f"unterminated {text[start]} in query")
        return text[start + 1 : end], end + 1

    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        m = _LEX.match(text, at)
        if m["paren"] or m["minus"]:
            out.append((m["paren"] or "NOT",))
            at = m.end()
        elif m["quote"]:
            word, at = quoted(m.start("quote"))
            out.append(("quoted", word))
        else:
            word, at = m["word"], m.end()
            name, colon, value = word.partition(":")
            if word in ("AND", "OR", "NOT"):
                out.append((word,))
            elif word.endswith(":") and text[at : at + 1] in ("'", '"') and at < len(text):
                value, at = quoted(at)
                out.append(("pair", word[:-1], value, True))
            elif colon and value and name in NAMES:
                out.append(("pair", name, value, False))
            else:
                out.append(("word", word))
    return out


def parse_range(text: str) -> Range:
    """Years: ``N``, ``A-B``, ``A-``, ``-B``, ``>N``, ``>=N``, ``<N``, ``<=N``."""

    def number(s: str) -> int:
        if not re.fullmatch(r"[+-]?[0-9]+", s.strip()):
            raise QueryError(f"`{text}` is not a year or year range")
        return int(s)

    for mark, low, high in ((">=", 0, None), ("<=", None, 0), (">", 1, None), ("<", None, -1), ("-", None, 0)):
        if text.startswith(mark):
            n = number(text[len(mark) :])
            return Range(None if low is None else n + low, None if high is None else n + high)
    if text.endswith("-"):
        return Range(number(text[:-1]), None)
    a, dash, b = text.partition("-")
    return Range(number(a), number(b)) if dash else Range(number(a), number(a))


def parse_value(field: str, text: str, quoted: bool) -> Contains | Exact | Range | Flag:
    if field == "file":
        return Flag(text.lower() in YES)
    if field == "year":
        return parse_range(text)
    return Exact(text) if quoted else Contains(text)


def parse(text: str) -> object:
    """The tree of a query; a blank one asks for everything. Raises QueryError."""
    tokens = tokenize(text)
    if not tokens:
        return All()
    at = 0

    def kind(k: int) -> str | None:
        return tokens[k][0] if k < len(tokens) else None

    def either():
        nonlocal at
        left = both()
        while kind(at) == "OR":
            at += 1
            left = Or(left, both())
        return left

    def both():
        nonlocal at
        left = single()
        while True:
            explicit = kind(at) == "AND"
            at += explicit
            if kind(at) in (")", "OR", None):
                if not explicit:
                    return left
                if kind(at) is None:
                    raise QueryError("query ends after AND")
            left = And(left, single())

    def single():
        nonlocal at
        if at >= len(tokens):
            raise QueryError("query ended unexpectedly")
        token = tokens[at]
        at += 1
        match token[0]:
            case "NOT":
                return Not(single())
            case "(":
                inner = either()
                if kind(at) != ")":
                    raise QueryError("unclosed ( in query")
                at += 1
                return inner
            case "word":
                return Prefix(token[1])
            case "quoted":
                return Phrase(token[1])
            case "pair":
                if token[1] not in NAMES:
                    raise QueryError(f"unknown search field `{token[1]}`")
                field = NAMES[token[1]]
                return Field(field, parse_value(field, token[2], token[3]))
            case ")":
                raise QueryError("unmatched ) in query")
        raise QueryError(f"`{token[0]}` needs something on both sides")

    tree = either()
    if at < len(tokens):
        raise QueryError(f"unexpected `{tokens[at][-1]}` in query")
    return tree
