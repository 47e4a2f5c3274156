"""SimHash near-dedup by segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two; the embedding is the segments' bit counts. The Manhattan distance of
two embeddings is never above the Hamming distance of the fingerprints. The embedding is cut into six parts: of two
within Manhattan distance three, at most three parts differ, so they meet in one of the 20 grid cells that fix three of
the parts (the range join). In a cell, pairs within the Manhattan bound are verified by their exact Hamming distance.

Only what joins a cell's fingerprints leaves it (a spanning forest of its links), never all pairs. A cell above
``CELL`` fingerprints is dealt into blocks, and each pair of blocks is a cell of its own: nothing is capped. Components
come from alternating large-star and small-star steps over tables in the shared folder.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import discard, materialize, slices

SHINGLE, SEED, BITS = 3, 42, 3
CELL = 2048
PARTS = (6, 6, 5, 5, 5, 5)
LOW = 0x5555555555555555


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks() -> list[int]:
    """The 20 choices of three of the embedding's six parts."""
    parts, at = [], 0
    for n in PARTS:
        parts.append(((1 << 2 * n) - 1) << at)
        at += 2 * n
    return [signed(a | b | c) for a, b, c in combinations(parts, 3)]


def shingle_hashes(text: bytes, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends[: len(words) - n + 1] - [len(w) + 1 for w in words[: len(words) - n + 1]]).tolist()
    return np.array(list(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())], repeat(seed))), np.uint64)


def fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED) -> int:
    """Bit j is 1 if it is set in over half the shingles' hashes; 0 for a text without words."""
    h = shingle_hashes(text, n, seed)
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of every row's whole text, as a signed long. Null texts have no words."""
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))], names=["key", "fp"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fp bigint")


def embedding(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments, two bits each."""
    one, low = np.uint64(1), np.uint64(LOW)
    a, b = fp & low, (fp >> one) & low
    return (a ^ b) | ((a & b) << one)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed embeddings: counts 0, 1, 2 differ by 2 where their xor is 2, by 1 where it is odd."""
    d, low = x ^ y, np.uint64(LOW)
    odd, high = d & low, (d >> np.uint64(1)) & low
    return np.bitwise_count(odd) + 2 * np.bitwise_count(high & ~odd)


def forest(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of each cell (equal values of ``cell`` stand together, fingerprints sorted in it)
    as all links within ``bits`` would."""
    n = len(cell)
    root = np.arange(n)
    ahead = np.searchsorted(cell, cell, side="right") - np.arange(n) - 1  # fingerprints of the cell behind this one
    vector = embedding(fp)
    left, right, live, step = [], [], np.flatnonzero(ahead > 0), 1

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    while len(live):
        i, j = live, live + step
        near = manhattan(vector[i], vector[j]) <= bits
        i, j = i[near], j[near]
        near = (np.bitwise_count(fp[i] ^ fp[j]) <= bits) & (root[i] != root[j])
        for a, b in zip(i[near].tolist(), j[near].tolist()):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
        if near.any():
            while (deep := root[root]).tobytes() != root.tobytes():
                root[:] = deep
        step += 1
        live = live[ahead[live] >= step]
    return fp[np.array(left, np.int64)], fp[np.array(right, np.int64)]


def links(fps: DataFrame, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that join all that lie within ``bits`` of each other."""
    if bits > 3:
        raise ValueError("three of six parts are fixed, so no more than three bits may differ")
    spark = fps.sparkSession
    low = F.lit(LOW)
    a, b = F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 1).bitwiseAND(low)
    vector = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    cells = F.array(*(F.xxhash64(F.lit(i), F.col("v").bitwiseAND(F.lit(m))) for i, m in enumerate(masks())))
    rows = fps.select("fp", vector.alias("v")).select("fp", F.explode(cells).alias("cell"))
    large = materialize(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell))
    if large.limit(1).count():
        parts = F.ceil(F.col("n") / cell).cast("int")
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        with_size = rows.join(large, "cell", "left").withColumn("parts", parts).withColumn("mine", mine)
        own = F.when(F.col("n").isNull(), F.array("cell")).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64("cell", F.least(o, F.col("mine")), F.greatest(o, F.col("mine"))))
        )
        rows = with_size.select("fp", F.explode(own).alias("cell"))

    def run(batches):
        rest_cell, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(c, f):
            x, y = forest(c, f, bits)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

        for batch in batches:
            c = np.concatenate((rest_cell, batch.column("cell").to_numpy()))
            f = np.concatenate((rest_fp, batch.column("fp").to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(c, c[-1])) if len(c) else 0
            if whole:
                yield out(c[:whole], f[:whole])
            rest_cell, rest_fp = c[whole:], f[whole:]
        if len(rest_cell):
            yield out(rest_cell, rest_fp)

    found = rows.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "a bigint, b bigint")
    found = materialize(found.distinct())
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the links with the smallest node that it reaches. Large-star and small-star steps
    until nothing changes; each step is a table in the shared folder."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = materialize(large)
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        edges = materialize(small)
        discard(large)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): ``component`` is the smallest key that links of fingerprints reach, itself included.

    Texts without words (null, empty, white space) have fingerprint 0 and are linked like any other; rows that repeat a
    key count as one document; a row with a null key gets its component, null if that has no other key; very long texts
    are read whole; an empty table gives an empty one. Other columns aren't read."""
    rows = materialize(fingerprints(documents, key, text))
    distinct = materialize(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    joined = links(distinct.select("fp"))
    nodes = components(joined)
    named = materialize(nodes.join(distinct, nodes["node"] == distinct["fp"]).select("node", "root", "least"))
    discard(joined)
    lowest = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = named.join(lowest, "root").select(F.col("node").alias("fp"), "component")
    alone = distinct.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("component"))
    known = materialize(linked.unionAll(alone))
    discard(distinct, named)
    out = rows.join(known, "fp", "left").select("key", "fp", F.coalesce("component", "key").alias("component"))
    return out.withColumnRenamed("key", key)
