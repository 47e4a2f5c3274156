"""Expressions over bibliographic records: texts of loose values, names, dates, types, ranges, URLs, result lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.functions.identifiers import arxiv_in_url, strip
from quillstack.functions.text import DASHES, WS

#: Record type to (entry type, type of its container).
TYPES = {
    ("article", "periodical"): ("article-journal", "article", "review", "review-book", "article-magazine"),
    ("article", "newspaper"): ("article-newspaper",),
    ("article", "proceedings"): ("paper-conference", "speech"),
    ("chapter", "anthology"): ("chapter", "entry", "entry-dictionary", "entry-encyclopedia"),
    ("book", None): ("book", "monograph"),
    ("thesis", None): ("thesis",),
    ("report", None): ("report", "standard"),
    ("web", None): ("webpage", "post-weblog", "post"),
    ("patent", None): ("patent",),
    ("manuscript", None): ("manuscript", "preprint"),
    ("repository", None): ("dataset", "software"),
    ("legislation", None): ("legislation", "bill"),
    ("case", None): ("legal_case",),
    ("video", None): ("broadcast", "motion_picture"),
    ("audio", None): ("song", "musical_score"),
}
#: A catalogue's own type names.
CATALOGUE_TYPES = {"journal-article": "article-journal", "proceedings-article": "paper-conference", "book-chapter": "chapter"}


def collapse(c: Column) -> Column:
    """Words with one blank between; null if there are none."""
    out = F.trim(F.regexp_replace(c, WS + "+", " "))
    return F.when(out != "", out)


def as_text(c: Column) -> Column:
    """The text of a value given as JSON: a string, a number (whole ones without a point) or a list (its first text)."""

    def one(j: Column) -> Column:
        number = j.try_cast("double")
        text = collapse(F.get_json_object(F.concat(F.lit('{"v":'), j, F.lit("}")), "$.v"))
        return F.when(j.startswith('"'), text).when(number.isNotNull(), F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string")))

    c = F.trim(c)
    items = F.from_json(c, "array<string>")
    # Items of a list come unquoted; a list is searched for its first text that isn't blank.
    first = F.get(F.filter(F.transform(items, collapse), lambda x: x.isNotNull()), F.lit(0))
    return F.when(c.startswith("["), F.when(first.startswith("["), F.get(F.filter(F.transform(F.from_json(first, "array<string>"), collapse), lambda x: x.isNotNull()), F.lit(0))).otherwise(first)).otherwise(one(c))


def name(literal: Column, family: Column, given: Column, suffix: Column, particle: Column) -> Column:
    """A person's name, family first. A literal (corporate) name loses its commas so that nothing splits it."""
    text = lambda c: F.coalesce(strip(c), F.lit(""))
    lit_, fam, giv, suf, par = map(text, (literal, family, given, suffix, particle))
    last = F.when(par == "", fam).otherwise(F.concat(par, F.lit(" "), fam))
    whole = F.when(suf == "", F.concat(last, F.lit(", "), giv)).otherwise(F.concat(last, F.lit(", "), suf, F.lit(", "), giv))
    return F.when(lit_ != "", F.replace(lit_, F.lit(","), F.lit(""))).when((fam == "") & (giv == ""), None).when(giv == "", last).otherwise(whole)


def is_iso_date(c: Column) -> Column:
    return c.rlike(r"^[0-9]{4}(-(0[1-9]|1[0-2])(-(0[1-9]|[12][0-9]|3[01]))?)?\z")


def iso_of_parts(parts: Column) -> Column:
    """ISO date of year, month and day texts, as precise as they are; null if none is a number."""
    n = F.filter(F.transform(parts, lambda p: F.when(p.rlike(r"^[+-]?[0-9]+\z"), p.try_cast("bigint"))), lambda x: x.isNotNull())
    at = lambda i, w: F.lpad(F.get(n, F.lit(i)).cast("string"), w, "0")
    padded = lambda i, w: F.when(F.length(F.get(n, F.lit(i)).cast("string")) >= w, F.get(n, F.lit(i)).cast("string")).otherwise(at(i, w))
    year, month, day = padded(0, 4), padded(1, 2), padded(2, 2)
    return F.when(F.size(n) == 0, None).when(F.size(n) == 1, year).when(F.size(n) == 2, F.concat_ws("-", year, month)).otherwise(F.concat_ws("-", year, month, day))


def iso_of_text(c: Column) -> Column:
    """ISO date that a text starts with, to the day or month, else its first run of digits if that is a year."""
    run = F.regexp_extract(c, "[0-9]+", 0)
    day, month = F.left(c, F.lit(10)), F.left(c, F.lit(7))
    return F.when(is_iso_date(day), day).when(is_iso_date(month), month).when(F.length(run) == 4, run)


def iso_date(parts: Column, literal: Column, raw: Column) -> Column:
    return F.when(F.size(parts) > 0, iso_of_parts(parts)).otherwise(iso_of_text(F.coalesce(literal, raw)))


def _lookup(c: Column, table: dict, default) -> Column:
    out = None
    for value, keys in table.items():
        condition = c.isin(*keys)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default)


def entry_type(kind: Column) -> Column:
    """Entry type of a record type; no type means a journal article, an unknown one misc."""
    return _lookup(F.coalesce(kind, F.lit("article-journal")), {t: [k for (a, _), ks in TYPES.items() if a == t for k in ks] for t in dict.fromkeys(a for a, _ in TYPES)}, "misc")


def parent_type(kind: Column) -> Column:
    return _lookup(F.coalesce(kind, F.lit("article-journal")), {t: [k for (_, b), ks in TYPES.items() if b == t for k in ks] for t in dict.fromkeys(b for _, b in TYPES if b)}, None)


def catalogue_type(kind: Column) -> Column:
    return F.coalesce(_lookup(kind, {v: [k] for k, v in CATALOGUE_TYPES.items()}, kind), F.lit("article-journal"))


def page_range(c: Column) -> Column:
    return F.regexp_replace(F.replace(F.translate(c, DASHES, "-----"), F.lit("--"), F.lit("-")), WS + "+", "")


def split_name(c: Column) -> tuple[Column, Column, Column]:
    """(family, given, literal): the last blank parts given names from the family name; none makes it literal."""
    c = strip(c)
    both = c.rlike(r"^.* [^ ]*\z")
    return F.when(both, F.regexp_extract(c, r"(?s)^(.*) ([^ ]*)\z", 2)), F.when(both, F.regexp_extract(c, r"(?s)^(.*) ([^ ]*)\z", 1)), F.when(~both, c)


def encode(c: Column) -> Column:
    """Percent-encoding that keeps only unreserved characters."""
    c = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def host_of(url: Column) -> Column:
    """What stands before the first ``/ ? #``, after the scheme."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(url, "^(?:https://)+", ""), "^(?:http://)+", ""), "^[^/?#]*", 0)


def after_host(url: Column, host: str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "^(?:https://)+", ""), "^(?:http://)+", ""), r"^(?:www\.)+", "")
    return F.when(bare.startswith(host), F.substring(bare, F.lit(len(host) + 1), F.length(bare)))


def pdf_form(url: Column) -> Column:
    """Where the PDF of a known site's page stands, else null."""
    url = strip(url)
    review = after_host(url, "openreview.net")
    out = F.when(arxiv_in_url(url).isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv_in_url(url)))
    out = out.when(review.startswith("/forum?id="), F.concat(F.lit("https://openreview.net/pdf?id="), F.regexp_replace(review, r"^/forum\?id=", "")))
    for host in ("biorxiv.org", "medrxiv.org"):
        rest = after_host(url, host)
        out = out.when(rest.startswith("/content/") & ~rest.endswith(".pdf"), F.concat(F.lit(f"https://www.{host}"), F.regexp_replace(rest, r"/+\z", ""), F.lit(".full.pdf")))
    return out


def pdf_sources(arxiv: Column, open_url: Column, url: Column) -> Column:
    """URLs to try for a PDF, in order, without repeats."""
    full = lambda c: F.when(strip(c) != "", c)
    all_ = F.array(F.concat(F.lit("https://arxiv.org/pdf/"), full(arxiv)), full(open_url), pdf_form(url), full(url))
    return F.array_distinct(F.filter(all_, lambda x: x.isNotNull()))


def subtitle(authors: Column, year: Column, container: Column) -> Column:
    """``A, B, C et al. · 1905 · Container`` without its empty parts."""
    names = F.concat(F.array_join(F.slice(authors, 1, 3), ", "), F.when(F.size(authors) > 3, " et al.").otherwise(""))
    parts = F.array(F.when(F.size(authors) > 0, names), year.cast("string"), F.when(strip(container) != "", container))
    return F.translate(F.array_join(F.filter(parts, lambda x: x.isNotNull()), " · "), "\n\r", "  ")


def citation_bucket(n: Column) -> Column:
    """0 for none, else one more than the power of ten."""
    return F.when(n > 0, F.floor(F.log10(n.cast("double"))).cast("int") + 1).otherwise(0)


def published_rank(kind: Column) -> Column:
    return F.when(kind == "posted-content", 0).otherwise(1)


def completeness(authors: Column, *fields: Column) -> Column:
    """How many of the authors and the fields are there."""
    out = F.coalesce((F.size(authors) > 0).cast("int"), F.lit(0))
    for f in fields:
        out = out + f.isNotNull().cast("int")
    return out


def plain_title(c: Column) -> Column:
    """Words of letters and digits in lower case with one blank between."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{IsAlphabetic}\p{N}]+", " "))
