"""Answers of catalogues (JSON and Atom texts) as records of one type, and reference-manager files.

A record: source, kind, title, container, authors (array of family, given, literal, suffix, particle), issued, volume, issue, page,
publisher, publisher_place, doi, isbn, issn, url, language, note, abstract, cited_by, oa_url.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import identifiers as ids
from quillstack.functions import records as rec
from quillstack.sources.tables import dealt

AUTHOR = "struct<family:string,given:string,literal:string,suffix:string,particle:string>"
RECORD = {
    "source": "string", "kind": "string", "title": "string", "container": "string", "authors": f"array<{AUTHOR}>", "issued": "string", "volume": "string", "issue": "string", "page": "string", "publisher": "string",
    "publisher_place": "string", "doi": "string", "isbn": "string", "issn": "string", "url": "string", "language": "string", "note": "string", "abstract": "string", "cited_by": "bigint", "oa_url": "string",
}


def record(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in RECORD.items()))


def person(c: Column, longest: int | None = None) -> Column:
    """A display name; with ``longest``, more given names than that make it literal."""
    family, given, literal = rec.split_name(c)
    if longest:
        plain = F.size(F.split(given, " ")) <= longest
        family, given, literal = F.when(plain, family), F.when(plain, given), F.when(literal.isNotNull() | ~plain, ids.strip(c))
    none = F.lit(None).cast("string")
    return F.struct(family.alias("family"), given.alias("given"), literal.alias("literal"), none.alias("suffix"), none.alias("particle"))


def titled(title: Column, subtitle: Column) -> Column:
    return F.when(title.isNotNull() & subtitle.isNotNull(), F.concat(title, F.lit(": "), subtitle)).otherwise(title)


def first_isbn(c: Column) -> Column:
    return F.get(F.filter(F.transform(c, ids.normalize_isbn), lambda x: x.isNotNull()), F.lit(0))


_NAME = "struct<family:string,given:string,literal:string,suffix:string,`non-dropping-particle`:string>"
_LOOSE = "type title container-title page volume issue publisher publisher-place ISBN ISSN".split()
CSL = "struct<" + ",".join([*(f"`{f}`:string" for f in _LOOSE), *(f"`{f}`:string" for f in "DOI URL abstract note language".split()), f"author:array<{_NAME}>", "issued:struct<`date-parts`:array<array<string>>,literal:string,raw:string>", "`is-referenced-by-count`:bigint"]) + ">"


def _csl(df: DataFrame, item: Column, source: Column, fix_type: bool) -> DataFrame:
    def text(field: str) -> Column:
        c = item[field]
        array = F.from_json(c, "array<string>")
        first = F.get(F.filter(F.transform(array, rec.collapse), lambda x: x.isNotNull()), F.lit(0))
        number = c.try_cast("double")
        return F.when(c.startswith("["), first).when(number.isNotNull() & (number == F.floor(number)) & c.rlike(r"^-?[0-9]+\.0*$"), number.cast("bigint").cast("string")).otherwise(rec.collapse(c))

    authors = F.transform(item["author"], lambda a: F.struct(a["family"].alias("family"), a["given"].alias("given"), a["literal"].alias("literal"), a["suffix"].alias("suffix"), a["non-dropping-particle"].alias("particle")))
    return record(
        df, source=source, kind=rec.catalogue_type(item["type"]) if fix_type else item["type"], title=text("title"), container=text("container-title"), authors=authors,
        issued=rec.iso_date(F.get(item["issued"]["date-parts"], F.lit(0)), item["issued"]["literal"], item["issued"]["raw"]), volume=text("volume"), issue=text("issue"), page=text("page"), publisher=text("publisher"),
        publisher_place=text("publisher-place"), doi=item["DOI"], isbn=text("ISBN"), issn=text("ISSN"), url=item["URL"], language=item["language"], note=item["note"], abstract=item["abstract"], cited_by=item["is-referenced-by-count"],
    )


def csl_json(df: DataFrame, body: str = "body") -> DataFrame:
    """CSL-JSON arrays, one text a row."""
    items = df.select(F.explode(F.from_json(body, f"array<{CSL}>")).alias("i"))
    return _csl(items, F.col("i"), F.lit(""), False)


def crossref(df: DataFrame, body: str = "body") -> DataFrame:
    """A work list (``message.items``) or a single work (``message``)."""
    many = F.from_json(body, f"struct<message:struct<items:array<{CSL}>>>")["message"]["items"]
    one = F.from_json(body, f"struct<message:{CSL}>")["message"]
    items = df.select(F.explode(F.coalesce(many, F.when(one["title"].isNotNull() | one["DOI"].isNotNull(), F.array(one)))).alias("i"))
    return _csl(items, F.col("i"), F.lit("crossref"), True)


_WORK = (
    "struct<type:string,title:string,doi:string,language:string,publication_date:string,publication_year:bigint,cited_by_count:bigint,authorships:array<struct<author:struct<display_name:string>>>,"
    "primary_location:struct<source:struct<display_name:string,issn_l:string,host_organization_name:string>>,biblio:struct<volume:string,issue:string,first_page:string,last_page:string>,best_oa_location:struct<pdf_url:string>,open_access:struct<oa_url:string>>"
)


def openalex(df: DataFrame, body: str = "body") -> DataFrame:
    """Work lists (``results``) and single works."""
    both = F.from_json(body, f"struct<results:array<{_WORK}>>")["results"]
    one = F.from_json(body, _WORK)
    w = df.select(F.explode(F.coalesce(both, F.array(one))).alias("w")).select("w.*")
    kind = F.when(F.col("type").isNull() | (F.col("type") == "article"), "article-journal").when(F.col("type") == "book-chapter", "chapter").when(F.col("type") == "dissertation", "thesis").when(F.col("type") == "preprint", "manuscript").otherwise(F.col("type"))
    place, b = F.col("primary_location.source"), F.col("biblio")
    names = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    return record(
        w, source=F.lit("openalex"), kind=kind, title=rec.collapse(F.col("title")), container=place["display_name"], authors=F.transform(names, lambda n: person(n, 3)),
        issued=rec.iso_of_text(F.coalesce("publication_date", F.col("publication_year").cast("string"))), volume=b["volume"], issue=b["issue"],
        page=F.when(b["last_page"].isNotNull(), F.concat(b["first_page"], F.lit("-"), b["last_page"])).otherwise(b["first_page"]), publisher=place["host_organization_name"],
        doi=F.lower(F.regexp_replace("doi", "^(?:https://doi.org/)+", "")), issn=place["issn_l"], language=F.col("language"), cited_by=F.col("cited_by_count"), oa_url=F.coalesce("best_oa_location.pdf_url", "open_access.oa_url"),
    )


def arxiv_atom(df: DataFrame, body: str = "body") -> DataFrame:
    """Entries of Atom feeds; an entry titled Error is none. Feed-level fields are ignored."""
    entries = F.regexp_extract_all(F.col(body), F.lit(r"(?s)(<entry\b.*?</entry>)"), F.lit(1))
    e = df.select(F.explode(entries).alias("e"))

    def field(tag: str) -> Column:
        raw = F.regexp_extract("e", rf"(?s)<(?:[\w-]+:)?{tag}\b[^>]*>(.*?)</(?:[\w-]+:)?{tag}>", 1)
        return rec.collapse(unescaped(raw))

    blocks = F.regexp_extract_all(F.col("e"), F.lit(r"(?s)<author\b[^>]*>(.*?)</author>"), F.lit(1))
    names = F.filter(F.transform(blocks, lambda x: rec.collapse(unescaped(F.regexp_extract(x, r"(?s)<name\b[^>]*>(.*?)</name>", 1)))), lambda x: x.isNotNull())
    id_ = F.element_at(F.split(field("id"), "/"), -1)
    out = record(
        e, source=F.lit("arxiv"), kind=F.lit("manuscript"), title=field("title"), authors=F.transform(names, lambda n: person(n)), issued=rec.iso_of_text(field("published")), abstract=field("summary"), doi=F.lower(field("doi")),
        note=field("journal_ref"), url=F.concat(F.lit("https://arxiv.org/abs/"), id_),
    )
    return out.where(F.col("title").isNotNull() & (F.lower("title") != "error"))


def unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def openlibrary_books(df: DataFrame, isbn: Column, body: str = "body") -> DataFrame:
    """A map of books: its first value; an empty map is no record."""
    book = "struct<title:string,subtitle:string,publish_date:string,authors:array<struct<name:string>>,publishers:array<struct<name:string>>,publish_places:array<struct<name:string>>>"
    b = df.select("*", F.get(F.map_values(F.from_json(body, f"map<string,{book}>")), F.lit(0)).alias("b")).where("b IS NOT NULL")
    names = F.filter(F.transform("b.authors", lambda a: a["name"]), lambda n: n.isNotNull())
    return record(b, source=F.lit("openlibrary"), kind=F.lit("book"), title=titled(F.col("b.title"), F.col("b.subtitle")), authors=F.transform(names, lambda n: person(n)), publisher=F.get("b.publishers", F.lit(0))["name"], publisher_place=F.get("b.publish_places", F.lit(0))["name"], issued=rec.iso_of_text(F.col("b.publish_date")), isbn=isbn)


def openlibrary_search(df: DataFrame, body: str = "body") -> DataFrame:
    doc = "struct<title:string,author_name:array<string>,first_publish_year:bigint,publisher:array<string>,isbn:array<string>>"
    d = df.select(F.explode(F.from_json(body, f"struct<docs:array<{doc}>>")["docs"]).alias("d")).select("d.*")
    return record(d, source=F.lit("openlibrary"), kind=F.lit("book"), title=F.col("title"), authors=F.transform("author_name", lambda n: person(n)), publisher=F.get("publisher", F.lit(0)), issued=F.col("first_publish_year").cast("string"), isbn=first_isbn(F.col("isbn")))


def google_books(df: DataFrame, body: str = "body") -> DataFrame:
    v = "struct<title:string,subtitle:string,authors:array<string>,publisher:string,publishedDate:string,description:string,language:string,industryIdentifiers:array<struct<identifier:string>>>"
    d = df.select(F.explode(F.from_json(body, f"struct<items:array<struct<volumeInfo:{v}>>>")["items"]).alias("i")).select("i.volumeInfo.*")
    codes = F.transform("industryIdentifiers", lambda x: x["identifier"])
    return record(d, source=F.lit("google-books"), kind=F.lit("book"), title=titled(F.col("title"), F.col("subtitle")), authors=F.transform("authors", lambda n: person(n)), publisher=F.col("publisher"), issued=rec.iso_of_text(F.col("publishedDate")), abstract=F.col("description"), language=F.col("language"), isbn=first_isbn(codes))


# Reference-manager files.

#: TeX accents by command and what they combine with.
TEX_ACCENTS = {"`": "̀", "'": "́", "^": "̂", "~": "̃", '"': "̈", "c": "̧", "v": "̌", "=": "̄", ".": "̇", "r": "̊"}
#: Month names.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _plain(tex: str) -> str:
    import unicodedata

    tex = re.sub(r"\\(ss|ae|AE|o|O|l|L|aa|AA)\b\s*(?:\{\})?", lambda m: {"ss": "ß", "ae": "æ", "AE": "Æ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å"}[m[1]], tex)
    tex = re.sub(r"""\\([`'^~"=.]|[cvr](?=[\s{]))\s*\{?\\?([A-Za-z])\}?""", lambda m: unicodedata.normalize("NFC", m[2] + TEX_ACCENTS[m[1]]), tex)
    tex = re.sub(r"\\([&%$#_{}])", r"\1", tex).replace("~", " ").replace("---", "—").replace("--", "–")
    return " ".join(re.sub(r"\\[A-Za-z]+\s*|[{}]", "", tex).split())


def parse_bibtex(text: str, names: dict[str, str] | None = None) -> tuple[list[dict], list[str]]:
    """(entries, errors): each entry has ``key``, ``type`` and its fields in plain text. Strings and ``#`` are resolved;
    ``names`` are strings that are known before, the text's own are added to them."""
    entries, errors = [], []
    names = {} if names is None else names
    for m in MONTHS:
        names.setdefault(m, m)
    at = 0
    while (at := text.find("@", at)) >= 0:
        head = re.compile(r"@\s*(\w+)\s*([{(])").match(text, at)
        at += 1
        if not head:
            continue
        kind, pos = head[1].lower(), head.end()

        def value(pos: int) -> tuple[str, int]:
            out = []
            while True:
                while text[pos : pos + 1].isspace():
                    pos += 1
                c = text[pos : pos + 1]
                if c in ("{", '"'):
                    depth, start = 0, pos + 1
                    pos += 1
                    while pos < len(text):
                        x = text[pos]
                        if x == "\\":
                            pos += 1
                        elif depth == 0 and x == ("}" if c == "{" else '"'):
                            break
                        elif x == "{":
                            depth += 1
                        elif x == "}":
                            depth -= 1
                        pos += 1
                    if pos >= len(text):
                        raise ValueError("unterminated value")
                    out.append(text[start:pos])
                    pos += 1
                elif m := re.compile(r"[^\s,#}\")]+").match(text, pos):
                    out.append(names.get(m[0].lower(), m[0]))
                    pos = m.end()
                else:
                    raise ValueError("a value is missing")
                m = re.compile(r"\s*#").match(text, pos)
                if not m:
                    return "".join(out), pos
                pos = m.end()

        try:
            if kind in ("comment", "preamble"):
                continue
            if kind == "string":
                m = re.compile(r"\s*([\w-]+)\s*=").match(text, pos)
                names[m[1].lower()], at = value(m.end())
                continue
            m = re.compile(r"\s*([^\s,]+)\s*,?").match(text, pos)
            entry, pos = {"key": m[1], "type": kind}, m.end()
            while m := re.compile(r"[\s,]*([\w-]+)\s*=").match(text, pos):
                raw, pos = value(m.end())
                entry.setdefault(m[1].lower(), raw if m[1].lower() in ("author", "editor", "url", "doi", "file") else _plain(raw))
            if not re.compile(r"[\s,]*[})]").match(text, pos):
                raise ValueError("the entry isn't closed")
            for role in ("author", "editor"):
                if role in entry:
                    entry[role] = [_plain(p) for p in re.split(r"\s+and\s+(?![^{]*\})", entry[role].strip())]
            entries.append(entry)
            at = pos
        except (ValueError, TypeError) as e:
            errors.append(f"{head[0]}{text[head.end() : head.end() + 20]!r}: {e}")
    return entries, errors


#: Export types to (entry type, container type).
BIBTEX_TYPES = {"article": ("article", "periodical"), "inproceedings": ("article", "proceedings"), "conference": ("article", "proceedings"), "incollection": ("chapter", "anthology"), "inbook": ("chapter", "book"), "book": ("book", None), "proceedings": ("proceedings", None), "phdthesis": ("thesis", None), "mastersthesis": ("thesis", None), "thesis": ("thesis", None), "techreport": ("report", None), "report": ("report", None), "unpublished": ("manuscript", None), "online": ("web", None), "electronic": ("web", None), "patent": ("patent", None)}


def bibtex_body(entry: dict) -> dict:
    """An entry body of a parsed BibTeX entry."""
    kind, holder = BIBTEX_TYPES.get(entry["type"], ("misc", None))
    out: dict = {"type": kind}
    for a, b in (("title", "title"), ("abstract", "abstract"), ("note", "note"), ("url", "url"), ("address", "location"), ("location", "location"), ("edition", "edition")):
        if entry.get(a):
            out.setdefault(b, entry[a])
    for role in ("author", "editor"):
        if entry.get(role):
            out[role] = [n if "," in n or " " not in n else f"{n.rsplit(' ', 1)[1]}, {n.rsplit(' ', 1)[0]}" for n in entry[role]]
    date = entry.get("date") or entry.get("year")
    month = (entry.get("month") or "").lower()[:3]
    if date:
        n = MONTHS.index(month) + 1 if month in MONTHS else int(month) if month.isdigit() and 1 <= int(month) <= 12 else 0
        out["date"] = f"{date}-{n:02}" if n and len(date) == 4 else date
    if entry.get("pages"):
        out["page-range"] = re.sub(r"[‐-—]|--", "-", entry["pages"]).replace(" ", "")
    serial = {k: entry[k] for k in ("doi", "isbn", "issn", "pmid") if entry.get(k) and not (k == "issn" and holder)}
    if (entry.get("eprinttype") or entry.get("archiveprefix") or "").lower() == "arxiv" and entry.get("eprint"):
        serial["arxiv"] = entry["eprint"]
    if serial:
        out["serial-number"] = serial
    title = entry.get("journal") or entry.get("journaltitle") or entry.get("booktitle")
    if holder and title:
        out["parent"] = {"type": holder, "title": title} | {b: entry[a] for a, b in (("volume", "volume"), ("number", "issue")) if entry.get(a)} | ({"serial-number": {"issn": entry["issn"]}} if entry.get("issn") else {})
    elif entry.get("volume"):
        out["volume"] = entry["volume"]
    if entry.get("publisher"):
        out["publisher"] = entry["publisher"]
    return out


#: The flat format's types.
FLAT_TYPES = {"article": "article", "misc": "article", "book": "book", "inbook": "chapter", "incollection": "chapter", "inproceedings": "article", "conference": "article", "proceedings": "proceedings", "phdthesis": "thesis", "mastersthesis": "thesis", "thesis": "thesis", "techreport": "report", "report": "report", "unpublished": "manuscript", "online": "web", "electronic": "web", "www": "web", "patent": "patent"}
#: Where the flat format's texts go in an entry; the first that is there fills a place.
FLAT_PLACES = {
    "title": "title", "abstract": "abstract", "note": "note", "url": "url", "publisher": "publisher", "address": "location", "pages": "page-range", "doi": "serial-number/doi", "isbn": "serial-number/isbn",
    "issn": "serial-number/issn", "journal": "parent/title", "booktitle": "parent/title", "volume": "parent/volume", "number": "parent/issue",
}
#: The container type that each container title stands for; fields that are read in other ways; what is
#: kept of the library's own data.
FLAT_HOLDERS = {"journal": "periodical", "booktitle": "anthology"}
FLAT_OTHERS = ("type", "author", "author_list", "editor", "editor_list", "year", "month", "ref", "school", "institution")
FLAT_OWN = ("files", "tags", "notes")


def flat_people(listed, text) -> list[str]:
    """Names, family first: those of a list of people that have a family name, else those of a text with ``and``."""
    people = [p for p in listed or [] if isinstance(p, dict) and isinstance(p.get("family"), str)]
    if people:
        return [", ".join(x for x in (p["family"], p.get("given")) if isinstance(x, str)) for p in people]
    return [x.strip() for x in text.split(" and ")] if isinstance(text, str) else []


def flat_date(year, month) -> str | None:
    if isinstance(year, bool) or not isinstance(year, (int, str)):
        return None
    return f"{year}-{month:02}" if isinstance(month, int) and month in range(1, 13) else f"{year}"


def flat_body(flat: dict, meta_key: str = "x-meta") -> dict:
    """An entry body of a flat (papis) file, with what has no place in it kept under the meta key. Values that aren't
    texts are left out, but for the year and month; so are a container's numbers without its title."""
    texts = {k: v for k, v in flat.items() if isinstance(v, str)}
    nested: dict = {}
    for field, place in FLAT_PLACES.items():
        if field in texts:
            holder, _, leaf = place.rpartition("/")
            nested.setdefault(holder, {}).setdefault(leaf, texts[field])
    out = {"type": FLAT_TYPES.get(texts.get("type") or "article", "misc")} | nested.pop("", {})
    container = nested.pop("parent", {})
    if "title" in container:
        nested["parent"] = {"type": next(kind for field, kind in FLAT_HOLDERS.items() if field in texts)} | container
    people = {role: flat_people(flat.get(f"{role}_list"), flat.get(role)) for role in ("author", "editor")}
    other = {"date": flat_date(flat.get("year"), flat.get("month")), **people}
    own = {k: texts[k].split() if k in texts and k != "notes" else flat[k] for k in FLAT_OWN if k in flat}
    known = {*FLAT_PLACES, *FLAT_OTHERS, *FLAT_OWN}
    if rest := {k: v for k, v in flat.items() if k not in known}:
        own["papis"] = rest
    return out | {k: v for k, v in other.items() if v} | nested | ({meta_key: own} if own else {})


#: Errors of one text that are told one by one.
TOLD = 5


def from_texts(df: DataFrame, form: str, body: str = "body") -> DataFrame:
    """(key, body, error): entries of BibTeX or YAML library texts, one text a row, in their order, repeated keys
    included; bodies as JSON. What can't be read is a row with an error alone: the first ``TOLD`` of a text one by one,
    the others as their number."""
    import json

    @F.pandas_udf("array<struct<key:string,body:string,error:string>>")
    def parse(texts: pd.Series) -> pd.Series:
        import yaml

        from quillstack.sources.library import load_yaml

        out = []
        for t in texts:
            found, errors = [], []
            if form == "bibtex":
                entries, errors = parse_bibtex(t or "")
                found = [(e["key"], bibtex_body(e)) for e in entries]
            else:
                try:
                    loaded = load_yaml(t or "")
                    loaded = {} if loaded is None else loaded
                    if isinstance(loaded, dict):
                        found = [(str(k), v) for k, v in loaded.items() if isinstance(v, dict)]
                        errors = [f"{k}: not an entry" for k, v in loaded.items() if not isinstance(v, dict)]
                    else:
                        errors = ["not a map of entries"]
                except yaml.YAMLError as e:
                    errors = [str(e)]
            told = errors[:TOLD] + ([f"and {len(errors) - TOLD} more"] if len(errors) > TOLD else [])
            out.append([{"key": k, "body": json.dumps(v, ensure_ascii=False, default=str), "error": None} for k, v in found] + [{"key": None, "body": None, "error": e} for e in told])
        return pd.Series(out)

    return dealt(df.select(body)).select(F.explode(parse(body)).alias("e")).select("e.*")
