"""Choosing, resolving and completing documents: targets, evidence from metadata, record bodies, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import identifiers as ids
from quillstack.functions import records as rec
from quillstack.functions.text import ascii_lower
from quillstack.operators import sync
from quillstack.operators.identify import CERTAIN, HIGH
from quillstack.plans import predicates


def select(documents: DataFrame, args: list[str]) -> DataFrame:
    """The documents of the keys, in their order, if all arguments are keys; else the hits of the arguments as one query."""
    found = documents.where(F.col("citekey").isin(args)).select("citekey").distinct().count() if args else 0
    if args and found == len(set(args)):
        return sync.by_keys(documents, args).drop("pos")
    return predicates.search(documents, " ".join(args), documents.columns)


def export_selection(documents: DataFrame, query: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """What an export takes: a query's hits (none is an error), the keys (a missing one is an error), or everything."""
    if query is not None:
        out = predicates.search(documents, query, documents.columns)
        if not out.limit(1).count():
            raise ValueError("no document matches")
        return out
    if keys:
        out = sync.by_keys(documents, keys)
        missing = set(keys) - {r.citekey for r in out.select("citekey").collect()}
        if missing:
            raise ValueError(f"no such document: {', '.join(sorted(missing))}")
        return out.drop("pos")
    return documents.orderBy("citekey")


def _evidence(df: DataFrame, found: Column, tier: int, context: Column) -> DataFrame:
    return df.select("doc", F.explode(found).alias("f"), context.alias("context")).select("doc", "f.id", F.lit(tier).alias("tier"), "f.confidence", "context")


def from_annotations(links: DataFrame) -> DataFrame:
    """Evidence of (doc, page, uri): resolver links, certain on the first page, low beyond it."""
    uri = ascii_lower(F.col("uri"))
    rows = links.where(F.contains(uri, F.lit("doi.org/")) | F.contains(uri, F.lit("arxiv.org/"))).select("doc", "page", "uri", F.explode(F.array_compact(F.transform(F.array("uri"), ids.parse_identifier))).alias("id"))
    return rows.select("doc", "id", F.lit(1).alias("tier"), F.when(F.col("page") == 1, CERTAIN).otherwise(0).alias("confidence"), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": "), "uri").alias("context"))


def from_info(info: DataFrame) -> DataFrame:
    """Evidence of (doc, key, value) of an info dictionary: high under a key that names an identifier, else medium."""
    named = ascii_lower(F.col("key")).rlike("doi|arxiv|isbn")
    c = F.when(named, HIGH).otherwise(1)
    return _evidence(info, F.transform(ids.scan(F.col("value")), lambda x: F.struct(x.alias("id"), c.alias("confidence"))), 2, F.concat("key", F.lit(": "), "value"))


def from_xmp(packet: DataFrame) -> DataFrame:
    """Evidence of (doc, key, value) of a metadata packet: certain under an identifier's own name, else medium."""
    c = F.when(F.col("key").isin("doi", "arxiv", "isbn", "identifier"), CERTAIN).otherwise(1)
    return _evidence(packet, F.transform(ids.scan(F.col("value")), lambda x: F.struct(x.alias("id"), c.alias("confidence"))), 3, F.concat("key", F.lit(": "), "value"))


def snippet(text: Column, needle: Column) -> Column:
    """The needle with some thirty characters around it, on one line."""
    at = F.locate(needle, text) if isinstance(needle, str) else F.instr(text, needle)
    start = F.greatest(at - 31, F.lit(1))
    cut = F.substring(text, start, at - start + F.length(needle) + 30)
    return F.when(at == 0, needle).otherwise(ids.strip(F.translate(cut, "\n\r", "  ")))


def body_fields(records: DataFrame, key: str) -> DataFrame:
    """(record, field, provider_ord, source, value) of records (``key``, provider_ord and the columns of a record): what
    each says about an entry's fields, values as JSON. A container that only has a type is kept where the type matters."""
    r = records
    kind, holder = rec.entry_type(F.col("kind")), rec.parent_type(F.col("kind"))
    text = lambda c: rec.collapse(F.col(c))
    json = lambda c: F.when(c.isNotNull(), F.to_json(F.array(c)))
    names = F.filter(F.transform("authors", lambda a: rec.name(a["literal"], a["family"], a["given"], a["suffix"], a["particle"])), lambda x: x.isNotNull())
    publisher = F.when(text("publisher_place").isNotNull() & text("publisher").isNotNull(), F.to_json(F.struct(text("publisher").alias("name"), text("publisher_place").alias("location")))).otherwise(json(text("publisher")))
    serial = F.to_json(F.struct(F.lower(F.when(ids.strip(F.col("doi")) != "", ids.strip(F.col("doi")))).alias("doi"), text("isbn").alias("isbn")))
    inside = F.struct(holder.alias("type"), text("container").alias("title"), text("volume").alias("volume"), text("issue").alias("issue"), text("issn").alias("issn"), text("publisher").alias("publisher"))
    bare = F.coalesce("container", "volume", "issue", "issn", "publisher").isNull() & ~holder.isin("proceedings", "anthology")
    fields = {
        "type": json(kind), "title": json(text("title")), "author": F.when(F.size(names) > 0, F.to_json(names)), "date": json(F.col("issued")), "page-range": json(rec.page_range(text("page"))),
        "abstract": json(text("abstract")), "note": json(text("note")), "url": json(text("url")), "language": json(text("language")), "publisher": F.when(holder.isNull(), publisher),
        "serial-number": F.when(serial != "{}", serial), "volume": F.when(holder.isNull(), json(text("volume"))), "parent": F.when(holder.isNotNull() & ~bare, F.to_json(inside)),
    }
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in fields.items()))
    return r.select(F.col(key).alias("record"), "provider_ord", "source", F.explode(pairs).alias("p")).select("record", "p.field", "provider_ord", "source", "p.value").where("value IS NOT NULL")


def upgraded(records: DataFrame, published: DataFrame) -> DataFrame:
    """Records (record, provider_ord, source, doi, ...) with those of the DOI that an arXiv record names put before them.

    ``published`` has the same columns with ``record`` a DOI."""
    named = records.where((F.col("source") == "arxiv") & ids.normalize_doi(F.col("doi")).isNotNull()).groupBy("record").agg(ids.normalize_doi(F.min_by("doi", "provider_ord")).alias("named"))
    better = published.withColumnRenamed("record", "named").join(named, "named").drop("named")
    better = better.withColumn("provider_ord", F.col("provider_ord") - 1_000_000)
    return records.unionByName(better.select(*records.columns))


def identifier_only(ident: Column) -> Column:
    """The body of an entry of which only the identifier is known, as JSON."""
    return F.concat(F.lit('{"type":"misc","serial-number":'), F.to_json(F.create_map(ident["kind"], ident["value"])), F.lit("}"))


def with_meta(documents: DataFrame, added: str) -> DataFrame:
    """Documents with ``files`` cut to their base names and ``added`` where they have none."""
    base = F.transform("files", lambda f: F.regexp_extract(f, "[^/]*$", 0))
    return documents.withColumns({"files": base, "added": F.coalesce("added", F.lit(added))})


def attachments(documents: DataFrame, listing: DataFrame) -> DataFrame:
    """(citekey, path, present) of recorded attachments against a listing (citekey, path) of what is there."""
    said = documents.select("citekey", F.explode("files").alias("path"))
    return said.join(listing.select("citekey", "path", F.lit(True).alias("_p")).distinct(), ["citekey", "path"], "left").select("citekey", "path", F.coalesce("_p", F.lit(False)).alias("present"))


def nth_file(documents: DataFrame, n: int) -> DataFrame:
    """(citekey, path): the n-th attachment, from 1; null where there is none."""
    if n < 1:
        raise ValueError("attachments are counted from 1")
    return documents.select("citekey", F.get("files", F.lit(n - 1)).alias("path"))


def within_budget(answers: DataFrame, budget: float) -> DataFrame:
    """Answers (query, provider_ord, seconds) with ``used``: whether their provider was still asked in time."""
    before = "coalesce(sum(seconds) OVER (PARTITION BY query ORDER BY provider_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D)"
    return answers.selectExpr("*", f"{before} < {float(budget)!r}D AS used")


def overlay_maps(base: Column, over: Column) -> Column:
    """A map with the entries of both; of equal keys ``over`` wins."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def page_size(n: int, most: int = 50) -> int:
    return max(1, min(n, most))
