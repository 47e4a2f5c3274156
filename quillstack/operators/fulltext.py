"""A full-text index: positional postings in order of their terms, and a sorted dictionary.

A slice is some megabytes of texts of one task; ``keys`` (slice, citekeys) says which. ``postings`` has a row for each term
of each slice: (term, slice, docs, counts, gaps), the documents that hold the term by their place in the slice, how often
each does, and their positions as gaps, one document's after the other's. So neither words nor single postings nor keys
are shuffled; the rows are range-partitioned and sorted by (term, slice). A term so lies in few files, whose row groups say which terms they hold, and a frequent term
is spread over as many files as it needs. ``terms`` is the dictionary: (term, documents, occurrences), sorted too.
``documents`` holds the other columns, without texts.

A search reads the postings of its own words (equality and prefixes are pushed to the files) and meets the documents in
semi- and anti-joins on their keys; no text is read. A phrase is the intersection of its words' positions, each shifted
by its place in the phrase. It starts from its rarest word, as the dictionary says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import text as tx
from quillstack.plans import predicates
from quillstack.plans import querylang as q
from quillstack.sources.tables import delete

#: Bytes of texts that one numpy step works on.
SLICE_BYTES = 8 << 20
#: Positions that are summed before they join the others.
BLOCK = 256
#: A rarer word's documents narrow the other words' postings where they are at most this part of all.
NARROWS = 0.1


@dataclass(frozen=True)
class Index:
    """An index as it was built: its tables."""

    documents: DataFrame
    postings: DataFrame
    keys: DataFrame
    terms: DataFrame


NAMES = ["term", "slice", "docs", "counts", "gaps", "citekeys"]
_ROWS = "term string, slice long, docs array<int>, counts array<int>, gaps array<int>, citekeys array<string>"


def _posted(batch: pa.RecordBatch, number: int) -> Iterator[pa.RecordBatch]:
    """Postings of a slice (citekey, fts_norm), and a row without a term that holds its keys."""
    words = pc.split_pattern(pc.utf8_trim(pc.fill_null(batch.column(1), ""), " "), " ")
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(words)), np.diff(offsets))
    at = np.arange(len(code)) - np.repeat(offsets[:-1] - offsets[0], np.diff(offsets))
    full = code != (coded.dictionary.index("").as_py() if len(coded.dictionary) else -1)
    code, doc, at = code[full], doc[full], at[full]
    # Sorted by term, document and position: rows begin where the term changes, lists where the document does.
    key = code * (len(words) + 1) + doc
    order = np.argsort(key, kind="stable")
    key, code, at = key[order], code[order], at[order].astype(np.int32)
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    gaps = np.diff(at, prepend=np.int32(0))
    gaps[first] = at[first]
    row = np.flatnonzero(np.r_[True, code[first][1:] != code[first][:-1]]) if len(first) else np.zeros(0, np.int64)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))
    outer = np.r_[row, len(first)]
    terms = coded.dictionary.take(pa.array(code[first][row])).cast(pa.string())
    counts = np.diff(np.r_[first, len(at)])
    n, strings = len(row), pa.list_(pa.string())
    yield pa.RecordBatch.from_arrays([terms, pa.array(np.full(n, number)), lists(outer, doc[order][first]), lists(outer, counts), lists(np.r_[first[row], len(at)], gaps), pa.nulls(n, strings)], NAMES)
    none = pa.nulls(1, pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number]), none, none, none, pa.array([batch.column(0).to_pylist()], strings)], NAMES)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield from _posted(batch.slice(start, stop - start), number)
            number += 1
            start = stop


def build(documents: DataFrame, path: str, parts: int | None = None) -> Index:
    """Write the index of ``documents`` (citekey, fts_norm, more) below ``path``. Keys are distinct, as in a library; a row
    without a key is never found by a word. ``parts``: term ranges; as many as shuffles have partitions if not given."""
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents.drop("fts_norm").write.parquet(f"{path}/documents")
    # Range partitioning looks at its input twice, so the postings are made once and kept until they are sorted.
    documents.where("citekey IS NOT NULL").select("citekey", "fts_norm").mapInArrow(_sliced, _ROWS).write.option("compression", "zstd").parquet(f"{path}/unsorted")
    loose = spark.read.schema(_ROWS).parquet(f"{path}/unsorted")
    loose.where("term IS NULL").select("slice", "citekeys").write.parquet(f"{path}/keys")
    loose = loose.where("term IS NOT NULL").drop("citekeys")
    loose.repartitionByRange(parts, "term", "slice").sortWithinPartitions("term", "slice").write.option("compression", "zstd").parquet(f"{path}/postings")
    delete(spark, f"{path}/unsorted")
    # Sorted as they are now, a term's rows are counted before they are shuffled.
    counted = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum(F.size("docs")).alias("documents"), F.sum(F.size("gaps")).alias("occurrences"))
    counted.sort("term").write.parquet(f"{path}/terms")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("documents", "postings", "keys", "terms")))


def vocabulary(index: Index, prefix: str) -> DataFrame:
    """The dictionary's terms that start with ``prefix``, in order; pushed to the sorted files."""
    return index.terms.where(F.col("term").startswith(prefix)).orderBy("term")


def entries(rows: DataFrame) -> DataFrame:
    """(term, slice, doc, gaps): rows of ``postings`` as one for each document."""
    each = F.transform(F.arrays_zip("docs", "counts", positions(F.col("counts")).alias("ends")), lambda e: F.struct(e["docs"].alias("doc"), F.slice(F.col("gaps"), e["ends"] - e["counts"] + 1, e["counts"]).alias("gaps")))
    return rows.select("term", "slice", F.explode(each).alias("e")).select("term", "slice", "e.doc", "e.gaps")


def keys_of(index: Index, found: DataFrame) -> DataFrame:
    """The keys (citekey) of documents (slice, doc)."""
    return found.join(index.keys.select("slice", F.posexplode("citekeys").alias("doc", "citekey")), ["slice", "doc"]).select("citekey")


def positions(gaps: Column) -> Column:
    """Positions from gaps: running sums, a block at a time, since an array is copied whenever it grows."""
    none = F.array().cast("array<int>")
    add = lambda acc, g: F.struct((acc["at"] + g).alias("at"), F.concat(acc["all"], F.array(acc["at"] + g)).alias("all"))

    def block(acc, i):
        inner = F.aggregate(F.slice(gaps, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), none.alias("all")), add)
        return F.struct(inner["at"].alias("at"), F.concat(acc["all"], inner["all"]).alias("all"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(gaps) - 1) / BLOCK).cast("int"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("all")), block)["all"]


def _rarity(index: Index, words: list[str], prefix: bool) -> list[int]:
    """Postings of each word, the last counted with all its continuations if ``prefix``: one number each."""
    exact = words[:-1] if prefix else words
    sums = [F.sum(F.when(F.col("term") == w, F.col("documents"))) for w in exact] + ([F.sum(F.when(F.col("term").startswith(words[-1]), F.col("documents")))] if prefix else [])
    wanted = F.col("term").isin(exact) | (F.col("term").startswith(words[-1]) if prefix else F.lit(False))
    return [n or 0 for n in index.terms.where(wanted).agg(*sums).first()]


def _back(places: int):
    return lambda p: p - places


def hits(index: Index, leaf: q.Prefix | q.Phrase) -> DataFrame:
    """The distinct keys of the documents that hold a phrase; the last word of a prefix may go on. No words: none."""
    words, prefix = tx.full_text_of(leaf.text).split(), isinstance(leaf, q.Prefix)
    term = F.col("term")
    none = index.documents.where(F.lit(False)).select("citekey")
    if not words:
        return none
    if len(words) == 1:
        found = index.postings.where(term.startswith(words[0]) if prefix else term == words[0]).select("slice", F.explode("docs").alias("doc"))
        return keys_of(index, found.distinct() if prefix else found)
    counts = _rarity(index, words, prefix)
    if 0 in counts:
        return none
    rarest = min(range(len(words)), key=lambda i: (counts[i], i))
    is_word = [term.startswith(w) if prefix and i == len(words) - 1 else term == w for i, w in enumerate(words)]
    few = entries(index.postings.where(is_word[rarest]))
    rows = entries(index.postings.where(reduce(Column.__or__, is_word) & ~is_word[rarest]))
    if counts[rarest] <= NARROWS * sum(counts):
        rows = rows.join(few.select("slice", "doc"), ["slice", "doc"], "left_semi")
    rows = few.unionByName(rows).withColumn("at", positions(F.col("gaps")))
    # Where each word would have the phrase begin.
    begins = [F.flatten(F.collect_list(F.when(is_word[i], F.transform("at", _back(i))))).alias(f"w{i}") for i in range(len(words))]
    together = rows.groupBy("slice", "doc").agg(*begins)
    return keys_of(index, together.where(F.size(reduce(F.array_intersect, [F.col(f"w{i}") for i in range(len(words))])) > 0))


def _leaves(tree) -> set:
    if isinstance(tree, (q.Prefix, q.Phrase)):
        return {tree}
    if isinstance(tree, (q.And, q.Or)):
        return _leaves(tree.left) | _leaves(tree.right)
    return _leaves(tree.inner) if isinstance(tree, q.Not) else set()


def _conjuncts(tree) -> list:
    return _conjuncts(tree.left) + _conjuncts(tree.right) if isinstance(tree, q.And) else [tree]


def search(index: Index, query: str, columns=predicates.HIT) -> DataFrame:
    """Hits of a query in the order of their keys, as ``predicates.search`` gives them over texts. Field terms come first;
    a full-text term of its own is a semi-join, one under NOT an anti-join; where OR mixes terms, each key comes once with
    a flag for each term that it holds, and the condition reads the flags."""
    out = index.documents
    joined = []
    for part in _conjuncts(q.parse(query)):
        if not _leaves(part):
            out = out.where(predicates.column(part))
        else:
            joined.append(part)
    for part in joined:
        if isinstance(part, (q.Prefix, q.Phrase)):
            out = out.join(hits(index, part), "citekey", "left_semi")
        elif isinstance(part, q.Not) and isinstance(part.inner, (q.Prefix, q.Phrase)):
            out = out.join(hits(index, part.inner), "citekey", "left_anti")
        else:
            leaves = sorted(_leaves(part), key=repr)
            found = reduce(DataFrame.unionAll, [hits(index, x).withColumn("_leaf", F.lit(i)) for i, x in enumerate(leaves)])
            flags = found.groupBy("citekey").agg(*(F.max(F.col("_leaf") == i).alias(f"_t{i}") for i in range(len(leaves))))
            known = {x: F.coalesce(F.col(f"_t{i}"), F.lit(False)) for i, x in enumerate(leaves)}
            out = out.join(flags, "citekey", "left").where(predicates.column(part, known)).drop(*(f"_t{i}" for i in range(len(leaves))))
    return out.select(*columns).orderBy("citekey")
