"""Approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and sub-space codebooks are fitted to a bounded sample of vectors (``SAMPLE``, those whose keys hash
lowest); every vector is indexed: its cell and the codes of its residual. A query probes the cells nearest to it. In a
cell, asymmetric distance tables of the query's own residual give a shortlist, which is reranked by exact distance.

How many cells a query probes is measured, not fixed: as many as hold ``TARGET`` of the true neighbours of some sample
vectors among the sample. The sample is thinner than the table, so neighbours in it are further off and the number errs
upwards. Vectors in clusters need few cells, so that a query meets a share of the table that falls as cells grow in
number; vectors without any structure need most cells at any size, and the work is then queries times vectors.

Copies of a vector are one entry of the index with their ``k + 1`` smallest keys, which is all that ties to smaller
keys can ask for. A cell is dealt into blocks of about the square root of the number of vectors, and its queries into
blocks too, so no task holds a large cell; nothing is capped. What is broadcast is centroids and codebooks of bounded
size. Vectors of different lengths have no distance: each length is a space of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import lowest, materialize, ranges

SAMPLE, CELLS, TARGET, SHORTLIST = 16_384, 4096, 0.95, 128
#: Sample vectors that ask when the number of probes is measured.
ASKED = 256
SUBSPACES, WORDS = 16, 256


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows, in one matrix product."""
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids; an empty one is put on the row that is worst served."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = distances(x, c)
        mine = d.argmin(1)
        n = np.bincount(mine, minlength=k)
        total = np.stack([np.bincount(mine, x[:, j], k) for j in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        far = np.argsort(-d[np.arange(len(x)), mine])
        empty = np.flatnonzero(n == 0)
        c[empty] = x[far[: len(empty)]]
    return c


class Index:
    """Centroids and codebooks."""

    def __init__(self, sample: np.ndarray, vectors: int, subspaces: int = SUBSPACES, words: int = WORDS):
        self.dim = sample.shape[1]
        self.subspaces = min(subspaces, self.dim)
        self.width = -(-self.dim // self.subspaces)
        cells = max(1, min(int(round(vectors**0.5)), CELLS, len(sample) // 8 or 1))
        self.centroids = kmeans(sample, cells, 12, 1)
        residual = self.pad(sample - self.centroids[distances(sample, self.centroids).argmin(1)])
        few = residual[: 8192]
        self.books = np.stack([kmeans(few[:, s], min(words, len(few)), 8, 2 + s) for s in range(self.subspaces)])

    def pad(self, x: np.ndarray) -> np.ndarray:
        """Rows as [row, subspace, component]."""
        return np.pad(x, ((0, 0), (0, self.width * self.subspaces - self.dim))).reshape(len(x), self.subspaces, self.width)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes) of each row."""
        cell = distances(x, self.centroids).argmin(1)
        residual = self.pad(x - self.centroids[cell])
        return cell, np.stack([distances(residual[:, s], self.books[s]).argmin(1) for s in range(self.subspaces)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Asymmetric distance tables [query, subspace, word] of the queries' residuals in a cell."""
        residual = self.pad(q - self.centroids[cell])
        return np.stack([distances(residual[:, s], self.books[s]) for s in range(self.subspaces)], 1)

    def share(self, sample: np.ndarray, k: int, target: float) -> float:
        """The share of cells, nearest first, that hold ``target`` of the ``k`` nearest sample vectors of some of them."""
        asked = sample[:ASKED]
        d = distances(asked, sample)
        d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1.0
        near = np.argpartition(d, k - 1, 1)[:, :k]
        rank = np.argsort(np.argsort(distances(asked, self.centroids), 1), 1)
        cell = distances(sample, self.centroids).argmin(1)
        return float(np.quantile(np.take_along_axis(rank, cell[near], 1), target) + 1) / len(self.centroids)

    def probes(self, q: np.ndarray, sizes: np.ndarray, share: float, least: int) -> list[np.ndarray]:
        """The cells that each query probes: the nearest ones that hold ``share`` of all cells, and more until they hold
        ``least`` vectors."""
        order = np.argsort(distances(q, self.centroids), 1, kind="stable")
        held = np.cumsum(sizes[order], 1)
        n = np.maximum(int(np.ceil(share * len(sizes))), (held < least).sum(1) + 1)
        return [row[:m][sizes[row[:m]] > 0] for row, m in zip(order, n)]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vector: str) -> Column:
    """The vector is there, not zero, and all its components are finite."""
    return F.expr(f"coalesce(size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(double(x)) < double('Infinity')) AND exists({vector}, x -> x != 0), false)")


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, target: float = TARGET, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, key, score): for each row where ``is_query`` holds, its ``k`` nearest other rows found by Euclidean
    distance in double precision, nearest first, ties to smaller keys; fewer where there are fewer.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null keys; vectors are
    compared with those of their length. Rows that repeat a key and its vector count once. Other columns aren't read.
    No vectors, no rows."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    lengths = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).agg(F.max("q").alias("q")).where("q").orderBy("n").collect()]
    found = spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    spaces = [search_space(rows.where(F.size("v") == n), key, k, target, shortlist) for n in lengths]
    for space in spaces[1:]:
        spaces[0] = spaces[0].unionAll(space)
    return spaces[0] if spaces else found


def search_space(rows: DataFrame, key: str, k: int, target: float, shortlist: int) -> DataFrame:
    """``search`` among rows (id, v, q) with vectors of one length."""
    spark = rows.sparkSession
    order = "row_number() OVER (PARTITION BY v ORDER BY id)"
    kept = rows.select("id", "v").distinct().withColumn("r", F.expr(order)).where(F.col("r") <= k + 1)
    entries = materialize(kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = materialize(rows.where("q").select(F.col("id").alias("query_id"), "v").distinct())
    distinct = materialize(asked.groupBy("v").agg(F.min("query_id").alias("qid")))

    total = entries.count()
    sample = matrix(lowest(entries, F.col("ids")[0], SAMPLE).select("v").toArrow().column("v").combine_chunks())
    index = Index(sample, total)
    share = index.share(sample, k, target)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cell, codes = shared.value.assign(matrix(batch.column("v")))
                flat = pa.array(codes.ravel().tobytes()[i : i + codes.shape[1]] for i in range(0, codes.size, codes.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), pa.array(cell), flat.cast(pa.binary())], names=["v", "ids", "cell", "code"])

    indexed = materialize(entries.mapInArrow(assign, "v array<double>, ids array<bigint>, cell bigint, code binary"))
    cells = len(index.centroids)
    sizes = np.zeros(cells, np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        sizes[r["cell"]] = r["n"]

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                found = shared.value.probes(matrix(batch.column("v")), sizes, share, 16 * (k + 1))
                take = np.repeat(np.arange(batch.num_rows), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(take)), batch.column("v").take(pa.array(take)), pa.array(np.concatenate(found))], names=["qid", "v", "cell"])

    probed = materialize(distinct.mapInArrow(probe, "qid bigint, v array<double>, cell bigint"))
    asks = np.ones(cells, np.int64)
    for r in probed.groupBy("cell").agg(F.count("*").alias("n")).collect():
        asks[r["cell"]] = r["n"]
    block = int(np.ceil(max(total, 1) ** 0.5))
    literal = lambda x: F.from_json(F.lit(str(x.tolist())), "array<int>")  # noqa: E731  bounded by CELLS
    blocks, parts = F.get(literal(np.maximum(1, -(-sizes // block))), F.col("cell")), F.get(literal(-(-asks // (4 * block))), F.col("cell"))
    mine = indexed.select("cell", F.pmod(F.xxhash64(F.col("ids")[0]), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("bigint").alias("qid"), "v", "ids", "code")
    theirs = probed.select("cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("qid"), parts).cast("int").alias("part"), "qid", "v", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("binary").alias("code"))

    def scan(table: pa.Table) -> pa.Table:
        is_q = table.column("qid").is_valid().combine_chunks()
        ours, queries = table.filter(pa.compute.invert(is_q)), table.filter(is_q)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if ours.num_rows and queries.num_rows:
            x, q = (matrix(t.column("v").combine_chunks()) for t in (ours, queries))
            codes = np.frombuffer(b"".join(ours.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
            ids = ours.column("ids").combine_chunks()
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            qid, cell = queries.column("qid").to_numpy(), table.column("cell")[0].as_py()
            # By smallest key, so that stable sorts settle ties.
            rows = np.argsort(flat[offsets[:-1]], kind="stable")
            x, codes, first, count = x[rows], codes[rows], offsets[:-1][rows], np.diff(offsets)[rows]
            for i in range(0, len(q), 64):
                part = q[i : i + 64]
                tables = shared.value.tables(part, cell)
                near = np.zeros((len(part), len(x)))
                for s in range(codes.shape[1]):
                    near += tables[:, s][:, codes[:, s]]
                short = np.sort(np.argsort(near, 1, kind="stable")[:, :shortlist], 1)
                exact = np.sqrt(((x[short] - part[:, None]) ** 2).sum(2))
                best = np.argsort(exact, 1, kind="stable")[:, : k + 1]
                score, entry = np.take_along_axis(exact, best, 1).ravel(), np.take_along_axis(short, best, 1).ravel()
                n = count[entry]
                out.append((np.repeat(np.repeat(qid[i : i + 64], best.shape[1]), n), flat[ranges(first[entry], n)], np.repeat(score, n)))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, t) for c, t in ((0, np.int64), (1, np.int64), (2, np.float64))]
        return pa.table(dict(zip(("qid", "id", "score"), map(pa.array, columns))))

    import pyarrow.compute  # noqa: F401  for scan

    found = mine.unionByName(theirs).groupBy("cell", "block", "part").applyInArrow(scan, "qid bigint, id bigint, score double")
    top = materialize(found.withColumn("r", F.expr("row_number() OVER (PARTITION BY qid ORDER BY score, id)")).where(F.col("r") <= k + 1))
    members = asked.join(distinct, "v").select("query_id", "qid")
    pairs = members.join(top, "qid").where("id != query_id")
    ranked = pairs.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score, id)")).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
