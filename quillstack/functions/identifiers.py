"""Identifier expressions: DOI, arXiv id, ISBN and PMID. An identifier is a struct (ord, kind, value) that sorts as
DOI < arXiv < ISBN < PMID, then by value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.functions.text import ascii_lower

#: The patterns of identifiers.
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9<>\[\]]+"
ARXIV_NEW, ARXIV_OLD = r"\d{4}\.\d{4,5}(?:v\d+)?", r"[a-z][a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?"
ARXIV_MARKED = rf"(?i)arxiv[:\s]?\s*((?:{ARXIV_NEW})|(?:{ARXIV_OLD}))"
ARXIV_BARE = rf"^(?:{ARXIV_NEW}|{ARXIV_OLD})\z"
ARXIV_URL = r"(?i)^(?:https?://)?(?:www\.|export\.)?arxiv\.org/(?:abs|pdf|format)/(.+?)(?:\.pdf)?/?\z"
ISBN = "(?i)\\b(?:isbn[-—: ]*(?:1[03][-: ]*)?)?((?:97[89][- ]?)?[\\dX][\\dX\n -]{8,20}[\\dX])\\b"
KINDS = {"doi": 1, "arxiv": 2, "isbn": 3, "pmid": 4}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def non_empty(c: Column) -> Column:
    return F.when(c != "", c)


def trim_doi(c: Column) -> Column:
    """Lower case, without punctuation at the end or closing brackets that were never opened."""

    def ends(x: Column, closing: str) -> Column:
        return F.right(x, F.lit(1)) == closing

    def count(x: Column, mark: str) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(mark), F.lit("")))

    def drop(x: Column) -> Column:
        plain = F.right(x, F.lit(1)).isin(".", ",", ";", ":", '"', "'", "-")
        for a, b in (("(", ")"), ("[", "]"), ("<", ">")):
            plain = plain | (ends(x, b) & (count(x, a) < count(x, b)))
        return plain

    step = lambda x, _: F.when((x != "") & drop(x), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    # Only a run of such marks at the end can go, so there are no more steps than it has characters.
    tail = F.length(F.regexp_extract(c, r"[.,;:\"'\-)\]>]*\z", 0))
    return F.when(tail == 0, ascii_lower(c)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(tail, F.lit(1))), ascii_lower(c), step))


def find_dois(c: Column) -> Column:
    """Distinct DOIs in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({DOI})")), trim_doi)
    return F.array_distinct(F.filter(found, lambda x: F.octet_length(x) > 8))


def normalize_doi(c: Column) -> Column:
    """The DOI that a text or resolver URL starts with, else null."""
    c = strip(c)
    for prefix in ("https://", "http://", r"dx\.", r"doi\.org/", r"www\.doi\.org/"):
        c = F.regexp_replace(c, f"^(?:{prefix})+", "")
    doi = trim_doi(F.regexp_extract(c, f"^{DOI}", 0))
    return F.when(F.octet_length(doi) > 8, doi)


def find_arxiv(c: Column) -> Column:
    """Distinct arXiv ids that follow the word arXiv."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(ARXIV_MARKED)))


def arxiv_in_url(c: Column) -> Column:
    found = F.regexp_extract(strip(c), ARXIV_URL, 1)
    return F.when(found.rlike(ARXIV_BARE), found)


def normalize_arxiv(c: Column) -> Column:
    """The id of an arXiv URL or of a bare id with or without its mark, else null."""
    bare = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(c), r"^(?:arXiv:)+", ""), r"^(?:arxiv:)+", ""), r"(?:\.pdf)+\z", ""))
    return F.coalesce(arxiv_in_url(c), F.when(bare.rlike(ARXIV_BARE), bare))


def _weighted(digits: Column, n: int, weight) -> Column:
    """Sum of the first ``n`` digits by weight; X counts 10."""
    total = F.lit(0)
    for i in range(n):
        d = F.substring(digits, i + 1, 1)
        total = total + F.when(d.isin("X", "x"), 10).otherwise(d.try_cast("int")) * weight(i)
    return total


def isbn10_ok(digits: Column) -> Column:
    return F.coalesce(digits.rlike(r"^[0-9]{9}[0-9Xx]\z") & (_weighted(digits, 10, lambda i: 10 - i) % 11 == 0), F.lit(False))


def isbn13_ok(digits: Column) -> Column:
    return F.coalesce(digits.rlike(r"^[0-9]{13}\z") & (_weighted(digits, 13, lambda i: 1 + 2 * (i % 2)) % 10 == 0), F.lit(False))


def isbn10_to_13(digits: Column) -> Column:
    body = F.concat(F.lit("978"), F.substring(digits, 1, 9))
    return F.concat(body, ((10 - _weighted(body, 12, lambda i: 1 + 2 * (i % 2)) % 10) % 10).cast("string"))


def normalize_isbn(c: Column) -> Column:
    """ISBN-13 of a text whose digits make a valid ISBN, else null."""
    digits = F.regexp_replace(c, "[^0-9Xx]", "")
    return F.when(isbn10_ok(digits), isbn10_to_13(digits)).when(isbn13_ok(digits), digits)


def find_isbns(c: Column) -> Column:
    """Distinct valid ISBNs in order, as ISBN-13."""
    found = F.transform(F.regexp_extract_all(c, F.lit(ISBN)), normalize_isbn)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def identifier(kind: str, value: Column) -> Column:
    """The struct of an identifier, null where the value is."""
    return F.when(value.isNotNull(), F.struct(F.lit(KINDS[kind]).alias("ord"), F.lit(kind).alias("kind"), value.alias("value")))


def parse_identifier(c: Column) -> Column:
    """A marked value (``doi: arxiv: isbn: pmid:``) or a bare one, tried as DOI, arXiv id, ISBN."""
    c = strip(c)
    mark, rest = ascii_lower(F.regexp_extract(c, r"^([^:]*):", 1)), strip(F.regexp_replace(c, r"^[^:]*:", ""))
    has = F.contains(c, F.lit(":"))
    bare = F.coalesce(identifier("doi", normalize_doi(c)), identifier("arxiv", normalize_arxiv(c)), identifier("isbn", normalize_isbn(c)))
    out = F.when(has & (mark == "doi"), identifier("doi", normalize_doi(rest))).when(has & (mark == "arxiv"), identifier("arxiv", normalize_arxiv(rest)))
    out = out.when(has & (mark == "isbn"), identifier("isbn", normalize_isbn(rest))).when(has & (mark == "pmid"), identifier("pmid", F.when(rest.rlike(r"^[0-9]*\z"), rest)))
    return out.otherwise(bare)


def scan(c: Column) -> Column:
    """All identifiers in a text: DOIs, then arXiv ids, then ISBNs."""

    def all_of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda x: identifier(kind, x))

    return F.concat(all_of("doi", find_dois(c)), all_of("arxiv", find_arxiv(c)), all_of("isbn", find_isbns(c)))


def display(c: Column) -> Column:
    return F.concat(c["kind"], F.lit(":"), c["value"])


def identifier_of_record(doi: Column, url: Column, isbn: Column) -> Column:
    """A record's identifier: its DOI, else the arXiv id of its URL, else its ISBN."""
    return F.coalesce(identifier("doi", normalize_doi(doi)), identifier("arxiv", normalize_arxiv(url)), identifier("isbn", normalize_isbn(isbn)))
