"""Expressions for citation keys: the string filters, the default templates, collision suffixes."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions.text import WS, accents, words_of

#: Words that a title may start with and a key leaves out.
STOPWORDS = "a an the on of in at for to and or but with from by into over under as via about toward towards is are be this that these those its it".split()
#: Letters without a decomposition and what they are written as.
LETTERS = {"Æ": "AE", "æ": "ae", "Ø": "O", "ø": "o", "Œ": "OE", "œ": "oe", "ß": "ss", "Ł": "L", "ł": "l", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "Th", "þ": "th", "ı": "i"}


@lru_cache(maxsize=1)
def _singles() -> tuple[str, str]:
    a, b = accents()
    pairs = [(x, y) for x, y in zip(a, b) if y.isascii()]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


def ascii(c: Column) -> Column:  # noqa: A001
    """Latin letters without accents; other characters outside ASCII stay out."""
    c = F.translate(c, *_singles())
    for x, y in LETTERS.items():
        c = F.replace(c, F.lit(x), F.lit(y))
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(ascii(c)), "[^a-z0-9]+", "-"), r"^-|-\z", "")


def words(c: Column, n: int) -> Column:
    """The first ``n`` words, with nothing between."""
    return F.array_join(F.slice(words_of(c), 1, n), "") if n > 0 else F.when(c.isNotNull(), "")


def word(c: Column, n: int) -> Column:
    return F.coalesce(F.get(words_of(c), F.lit(max(n, 1) - 1)), F.when(c.isNotNull(), ""))


def abbrev(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


truncate = abbrev


def alnum(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{IsAlphabetic}\p{N}]+", "")


def nospace(c: Column) -> Column:
    return F.regexp_replace(c, WS + "+", "")


def titlecase(c: Column) -> Column:
    parts = F.transform(words_of(c), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.array_join(parts, " ")


def initial(c: Column) -> Column:
    return F.left(c, F.lit(1))


def nostop(c: Column) -> Column:
    """Without the stop words at its start; a title of nothing else stays."""
    w = words_of(c)
    bare = F.transform(w, lambda x: F.lower(alnum(x)))
    at = F.array_position(F.transform(bare, lambda x: (x != "") & ~x.isin(*STOPWORDS)), True)
    return F.when(at > 0, F.array_join(F.slice(w, at.cast("int"), F.greatest(F.size(w), F.lit(1))), " ")).otherwise(c)


def alpha_suffix(n: Column) -> Column:
    """0 is a, 25 z, 26 aa: digits from a up, of as many places as a long number takes."""
    letter = lambda x: F.char(97 + F.pmod(x, F.lit(26)))
    state = F.aggregate(F.sequence(F.lit(0), F.lit(13)), F.struct(n.cast("bigint").alias("rest"), F.lit("").alias("out")), lambda a, _: F.when(a["rest"] < 0, a).otherwise(F.struct((F.floor(a["rest"].cast("decimal(20, 0)") / 26) - 1).cast("bigint").alias("rest"), F.concat(letter(a["rest"]), a["out"]).alias("out"))))
    return state["out"]


def sanitize(c: Column, n: int = 64) -> Column:
    """Letters, digits, marks, connectors and ``- : .``; the first ``n``, without points or colons at the end."""
    return F.regexp_replace(F.left(F.regexp_replace(c, r"[^\p{L}\p{M}\p{N}\p{Pc}\-:.]+", ""), F.lit(n)), r"[.:]+\z", "")


#: Texts, and bytes of texts, that are held as Python strings at once.
ROWS, HELD = 1024, 1 << 20


def _normalized(form: str, texts: pa.Array) -> pa.Array:
    """The normal form of each text, a few at a time: beside the batch and its result a worker holds ``HELD`` bytes or one
    text."""
    done, at, n = [], 0, len(texts)
    while at < n:
        sizes = pa.compute.fill_null(pa.compute.binary_length(texts.slice(at, ROWS)), 0).to_numpy(zero_copy_only=False)
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes, dtype=np.int64), HELD, side="right")))
        done.append(pa.array([None if x is None else x if x.isascii() else unicodedata.normalize(form, x) for x in texts.slice(at, stop - at).to_pylist()], pa.string()))
        at = stop
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


def normalize(c: Column, form: str = "nfkd") -> Column:
    """A Unicode normal form (nfc, nfkc, nfd, nfkd) or none of them. No built-in function does this."""
    if form == "none":
        return c
    form = form.upper()

    @F.arrow_udf(T.StringType())
    def normalized(c: pa.Array) -> pa.Array:
        return _normalized(form, c)

    return normalized(c)


def default_key(authors: Column, editors: Column, year: Column, title: Column, n: int = 64) -> Column:
    """The first of the default templates whose parts are all there and whose key isn't empty: first author's family, year
    and title word; first editor's family and year; slug of the title and year."""
    family = lambda p: F.lower(ascii(F.get(p, F.lit(0))))
    y = year.cast("string")
    templates = (F.concat(family(authors), y, F.lower(ascii(words(nostop(title), 1)))), F.concat(family(editors), y), F.concat(truncate(slug(nostop(title)), 24), y))
    return F.coalesce(*(F.nullif(sanitize(t, n), F.lit("")) for t in templates))
