"""Benchmark decontamination by training suffix arrays.

Each slice of the training texts (a shard) becomes one array of word ids and its suffix array; every suffix of every
benchmark item is searched in it by bisection, all suffixes at once. That gives the longest verbatim match of each
suffix and the places of every window (``window`` consecutive item words; a shorter item is one window).

Word ids are those of the benchmark's vocabulary, 0 for any other word. No match spans a 0, so the suffix array holds
only runs of known words that are long enough for the shortest window: the result is the same as over the whole shard.

The benchmark's size is checked before it is broadcast. Beyond ``block_bytes`` it is dealt into blocks, each of which
passes over all the documents, written once with row numbers; the passes' spans then meet by row, so the result is the
same for any number of blocks.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import discard, materialize, ranges, slices

WINDOW = 10
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 8 << 20

#: Bytes to words: A-Z to lower case, other ASCII but digits and a-z to a space, bytes of non-ASCII characters kept.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of ``ids`` by prefix doubling, exact for the first ``depth`` ids of each suffix."""
    rank, k = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        fresh = np.empty(len(ids), np.int64)
        fresh[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        if k >= depth or fresh[order[-1]] == len(ids) - 1:
            return order
        after = np.zeros(len(ids), np.int64)
        after[:-k] = fresh[k:] + 1
        rank = fresh * (len(ids) + 1) + after
        order = np.argsort(rank, kind="stable")
        k *= 2


class TestSuffixes:
    """The items of one block as suffixes to search for."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        split = [(i, w) for i, w in ((i, words(t)) for i, t in items) if w]
        self.names = [i for i, _ in split]
        self.vocabulary: dict[bytes, int] = {}
        ids = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64) for _, w in split]
        lengths = np.array([len(x) for x in ids], np.int64)
        self.depth = int(lengths.max(initial=0))
        #: Every suffix: its item, its place in it, its words' place in ``flat`` and its length.
        self.flat = np.concatenate([*ids, np.zeros(0, np.int64)])
        self.item = np.repeat(np.arange(len(ids)), lengths)
        self.place = ranges(np.zeros(len(ids)), lengths)
        self.start = np.arange(len(self.flat))
        self.length = np.repeat(lengths, lengths) - self.place
        whole = np.repeat(lengths, lengths)
        #: Words of the window that starts with the suffix; 0 where none does.
        self.width = np.where(self.length >= window, window, np.where((whole < window) & (self.place == 0), whole, 0))
        self.shortest = int(self.width[self.width > 0].min(initial=window))

    def compare(self, text: np.ndarray, at: np.ndarray, q: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For text suffixes ``at`` and test suffixes ``q`` cut to ``width``: words in common, and -1, 0 or 1 as the text
        suffix is below, has as its prefix, or is above the test suffix. ``text`` ends in a 0."""
        common, sign, live = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.arange(len(q))
        for k in range(int(width.max(initial=0))):
            live = live[width[live] > k]
            if not len(live):
                break
            a, b = text[np.minimum(at[live] + k, len(text) - 1)], self.flat[self.start[q[live]] + k]
            sign[live] = np.sign(a - b)
            live = live[a == b]
            common[live] += 1
        return common, sign

    def bisect(self, text: np.ndarray, order: np.ndarray, q: np.ndarray, width: np.ndarray, above: bool) -> np.ndarray:
        """First place in the suffix array whose suffix isn't below the test suffix (``above``: is above it)."""
        low, high = np.zeros(len(q), np.int64), np.full(len(q), len(order))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            sign = self.compare(text, order[mid], q[open_], width[open_])[1]
            right = sign <= 0 if above else sign < 0
            low[open_[right]], high[open_[~right]] = mid[right] + 1, mid[~right]
        return low


def search(tests: TestSuffixes, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[str], tuple]]:
    """For each document: spans [start, end) of words hit, the items with windows in it, and its longest match as (words,
    item, place in the item, place in the document)."""
    get = tests.vocabulary.get
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    first = np.cumsum(sizes) - sizes
    ids = np.array([x for d in docs for x in [*map(get, d, repeat(0)), 0]], np.int64)
    none: list = [([], [], (0, None, None, None)) for _ in docs]
    known = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
    begin, end = known[::2], known[1::2]
    keep = end - begin >= tests.shortest
    if not len(tests.flat) or not keep.any():
        return none
    begin, end = begin[keep], end[keep]
    place = ranges(begin, end - begin + 1)  # with the 0 after each run
    text = ids[place]
    order = suffix_array(text, tests.depth)
    order = order[text[order] > 0]
    # Every test suffix: the longest match is with a neighbour of its place in the order.
    q = np.arange(len(tests.flat))
    at = tests.bisect(text, order, q, tests.length, above=False)
    best = np.maximum(*(tests.compare(text, order[np.clip(at + d, 0, len(order) - 1)], q, tests.length)[0] for d in (0, -1)))
    q = np.flatnonzero((tests.width > 0) & (best >= tests.width))
    low = tests.bisect(text, order, q, tests.width[q], above=False)
    count = tests.bisect(text, order, q, tests.width[q], above=True) - low
    where = place[order[ranges(low, count)]]
    hit = np.repeat(q, count)
    doc = np.searchsorted(first, where, side="right") - 1
    if not len(hit):
        return none
    out = none
    # Matches that go on along one diagonal of (item, document) are one longer match.
    width, item, diagonal = tests.width[hit], tests.item[hit], where - tests.place[hit]
    by = np.lexsort((where, diagonal, item, doc))
    d, i, g, w = doc[by], item[by], diagonal[by], where[by]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (g[1:] != g[:-1]) | (w[1:] != w[:-1] + 1)))
    head = np.flatnonzero(new)
    words_ = np.diff(np.concatenate((head, [len(by)]))) - 1 + width[by[head]]
    starts = w[head] - first[d[head]]
    order_ = np.lexsort((starts, starts - (g[head] - first[d[head]]), i[head], -words_, d[head]))
    edges = np.flatnonzero(np.concatenate(([True], np.diff(d[head][order_]) > 0, [True])))
    for a, b in zip(edges[:-1], edges[1:]):
        rows = order_[a:b]
        k = int(d[head][rows[0]])
        spans: list[tuple[int, int]] = []
        for s, n in sorted(set(zip(starts[rows].tolist(), words_[rows].tolist()))):
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], s + n))
            else:
                spans.append((s, s + n))
        top = rows[0]
        out[k] = (spans, sorted({tests.names[x] for x in i[head][rows].tolist()} - {None}), (int(words_[top]), tests.names[i[head][top]], int(w[head][top] - g[head][top]), int(starts[top])))
    return out


SPANS = "array<struct<start:bigint,stop:bigint>>"
LONGEST = "struct<n_words:bigint,item_id:string,item_at:bigint,doc_at:bigint>"


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts, each of some ``block_bytes`` of text."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = int(total // block_bytes) + 1
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p) for p in range(parts)]


def scan(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: ``key``, n_words, n_hit, items (array of item ids as text, sorted), spans (word ranges
    hit, in order, apart), longest (the longest verbatim match and where it is).

    A null text has no words; a document or item without words matches nothing; an empty benchmark hits nothing. Rows
    are judged one by one, whatever their keys: repeated rows and null keys each get their row. An item without an id
    hits words like any other but isn't named. Equal items are all reported; of equally long matches the first item, then
    place, is named. Very long texts are searched whole, as a shard of their own. Other columns aren't read.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    blocks = blocks_of(benchmark, item, item_text, block_bytes)
    if len(blocks) > 1:  # each block passes over the same rows
        rows = materialize(rows)
    schema = f"row bigint, key {kind}, n_words bigint, n_hit bigint, items array<string>, spans {SPANS}, longest {LONGEST}"

    def one(block: DataFrame) -> DataFrame:
        items = spark.sparkContext.broadcast([(r.item, (r.text or "").encode()) for r in block.collect()])

        def over(batches):
            tests = TestSuffixes(items.value, window)
            for batch, texts in slices(batches, limit=SHARD_BYTES):
                split = [words(t) for t in texts]
                found = search(tests, split)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("key"),
                        pa.array([len(w) for w in split], pa.int64()),
                        pa.array([sum(b - a for a, b in s) for s, _, _ in found], pa.int64()),
                        pa.array([x for _, x, _ in found], pa.list_(pa.string())),
                        pa.array([[{"start": a, "stop": b} for a, b in s] for s, _, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        pa.array([dict(zip(("n_words", "item_id", "item_at", "doc_at"), x)) for _, _, x in found], pa.struct([("n_words", pa.int64()), ("item_id", pa.string()), ("item_at", pa.int64()), ("doc_at", pa.int64())])),
                    ],
                    names=["row", "key", "n_words", "n_hit", "items", "spans", "longest"],
                )

        return rows.mapInArrow(over, schema)

    parts = [one(b) for b in blocks]
    if len(parts) > 1:
        passes = [materialize(part) for part in parts]
        both = passes[0]
        for part in passes[1:]:
            both = both.unionByName(part)
        merged = (
            "aggregate(array_sort(flatten(collect_list(spans))), cast(array() as {s}), (a, x) -> CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).stop "
            "THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).stop, x.stop) AS stop))) ELSE concat(a, array(x)) END)"
        ).format(s=SPANS)
        out = both.groupBy("row").agg(F.first("key").alias("key"), F.max("n_words").alias("n_words"), F.expr("array_sort(array_distinct(flatten(collect_list(items))))").alias("items"), F.expr(merged).alias("spans"), F.max_by("longest", "longest.n_words").alias("longest"))
        discard(rows)
        out = out.select("key", "n_words", F.expr("aggregate(spans, 0L, (a, x) -> a + x.stop - x.start)").alias("n_hit"), "items", "spans", "longest")
    else:
        out = parts[0].drop("row")
    return out.withColumnRenamed("key", key)


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any window of the benchmark, columns as they were, without a shuffle: each block of the
    benchmark passes over what the blocks before it have left. Rows are judged one by one, so null or repeated keys
    don't matter; null and empty texts stay; items without an id count like any other; an empty table gives an empty one.
    Columns of any name are kept."""
    spark = documents.sparkSession
    for block in blocks_of(benchmark, item, item_text, block_bytes):
        items = spark.sparkContext.broadcast([(r.item, (r.text or "").encode()) for r in block.collect()])

        def keep(batches, items=items):
            tests = TestSuffixes(items.value, window)
            for batch, texts in slices(batches, text, SHARD_BYTES):
                yield batch.filter(pa.array([not s for s, _, _ in search(tests, [words(t) for t in texts])], pa.bool_()))

        documents = documents.mapInArrow(keep, documents.schema)
    return documents


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
