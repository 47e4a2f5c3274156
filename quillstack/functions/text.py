"""Text expressions: folding, full-text form, repair of extracted text. All stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Ligatures and what they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Characters that show as nothing, as a space, as a hyphen.
INVISIBLE = "­​‌‍﻿"
SPACES = "     "
DASHES = "‐‑‒–—"
#: Headings of a list of references.
HEADINGS = ("references", "reference", "bibliography", "works cited", "literature cited", "literatur", "literaturverzeichnis")
#: White space as Unicode has it, for Java patterns.
WS = r"(?U)\s"


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def contains_fold(c: Column, text: str) -> Column:
    """Whether ``c`` holds ``text``, A-Z and a-z alike; null for a null. Nothing in ``text`` is a wildcard."""
    return F.contains(ascii_lower(c), F.lit("".join(x.lower() if x in UPPER else x for x in text)))


@lru_cache(maxsize=1)
def accents() -> tuple[str, str]:
    """(accented characters, their base characters), by rule: all whose decomposition is one character and marks."""
    found = []
    for i in range(0xC0, 0x2000):
        d = unicodedata.normalize("NFD", chr(i))
        if len(d) > 1 and all(unicodedata.combining(x) for x in d[1:]):
            found.append((chr(i), d[0]))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *accents()), r"\p{M}+", "")


def full_text(c: Column) -> Column:
    """Words in lower case without accents, one blank before, between and after: what full-text terms are looked up in."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def full_text_of(text: str) -> str:
    """The same of a query's text, on the driver, without the outer blanks."""
    plain = "".join(x for x in unicodedata.normalize("NFD", text) if not unicodedata.combining(x)).lower()
    return " ".join(re.findall(r"[^\W_]+", plain))


def full_text_match(c: Column, text: str, prefix: bool) -> Column:
    """Whether the full-text column ``c`` holds the words in a row; as a prefix, the last may go on. No words: false."""
    words = full_text_of(text)
    return F.contains(c, F.lit(f" {words}" if prefix else f" {words} ")) if words else F.lit(False)


def repair(c: Column) -> Column:
    """Ligatures to letters, invisible characters dropped, odd spaces and dashes to plain ones."""
    c = F.translate(c, SPACES + DASHES + INVISIBLE, " " * len(SPACES) + "-" * len(DASHES))
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def join_broken_lines(c: Column) -> Column:
    """A hyphen at a line's end goes where the next line goes on in lower case."""
    return F.regexp_replace(c, r"-[ \r]*\n *(?=\p{IsLowercase})", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, WS + "+", "")


def views(c: Column) -> Column:
    """The three forms of a text that identifiers are looked for in. The plain one is made once for all three."""
    return F.get(F.transform(F.array(repair(c)), lambda plain: F.array(plain, join_broken_lines(plain), squeeze(plain))), F.lit(0))


def before_references(c: Column) -> Column:
    """What stands before the first line that is a heading of references."""
    heading = r"(?im)^[^\S\n]*[0-9. ]*(?:" + "|".join(HEADINGS) + r"):*[^\S\n]*$[\s\S]*"
    return F.regexp_replace(c, heading, "")


def words_of(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, WS + "+"), lambda x: x != "")
