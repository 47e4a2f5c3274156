"""Language-model scores of whole texts, by causal self-attention over all their subword pieces.

A text is its lower-cased words, each spelled in the tokenizer's pieces, and one end. The network (``attention``) reads
every piece in overlapping windows and gives the chance of every next piece, each scored once; a text's score is the sum
of the logs, and nothing else goes into it. All pieces that training words are spelled with are inputs and targets of
their own, however rare. Those that no training word has are one input, and as targets share one chance evenly.

The softmax over all pieces is taken in two levels, both by the network (``Tree``): the ``LEAVES`` most frequent pieces
and ``BINS`` bins of the others; then, for a piece of a bin, all pieces of that bin. The product is the piece's chance;
those of all pieces sum to one. Counts only say where the weights start: at the log odds after the piece before on the
first level, at log shares on the second.

Weights are fitted to ``WARM`` training texts and then to every window of every training text, ends included, in shards
by a hash (``languagemodel.refine``), so neither partitions nor their order matter. Word counts serve the base score
alone: the ``HEAD`` words are broadcast, the others of a text meet their counts in a shuffle.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm import attention as net
from quillstack.llm import languagemodel as lm
from quillstack.llm.common import Memo, materialize, parts, ranges, words_of

LEAVES, BINS = 48, 16
#: Windows that are scored at once.
BATCH = 256
#: Indices that 16 bits hold.
NARROW = np.iinfo(np.int16).max
#: Pieces before the text, at its end, and those of no training word; then the others, most frequent first.
START, END, UNSEEN, FIRST = 0, 1, 2, 3


class Tree:
    """Classes of targets: the most frequent ones alone, the others in bins of equal sums of square roots of counts.

    Targets have slots, in which a class is one run (``at`` to ``at + size``). ``share``: log share of each slot in its
    class; ``prior``: log odds of the class after each piece, from ``follow`` counts."""

    def __init__(self, count: np.ndarray):
        n = len(count)
        order = 1 + np.argsort(-count[1:], kind="stable")
        plus = count[order] + 0.1
        leaves = min(LEAVES, n - 1)
        self.of, self.slot = np.zeros(n, np.int16), np.zeros(n, np.int64)
        self.slot[order] = np.arange(n - 1)
        kind = np.arange(n - 1)
        if n - 1 > leaves:
            mass = np.cumsum(np.sqrt(plus[leaves:]))
            kind[leaves:] = leaves + np.unique(np.minimum(mass * BINS / mass[-1], BINS - 1).astype(np.int64), return_inverse=True)[1]
        self.of[order] = kind
        self.leaves, self.size = leaves, np.bincount(kind)
        self.count, self.at = len(self.size), np.cumsum(self.size) - self.size
        total = np.bincount(kind, plus)
        self.share = np.log(plus / total[kind]).astype(np.float32)
        self.chance = total / total.sum()
        self.prior = np.zeros((n, self.count), np.float32)

    def follow(self, counts: np.ndarray) -> None:
        self.prior = np.log((counts + 4 * self.chance) / (counts.sum(1, keepdims=True) + 4)).astype(np.float32)

    def binned(self, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice, np.ndarray]]]:
        """(which targets are in bins, bin by bin; for each bin with some: their run, its slots, their slots within it)."""
        of = self.of[targets]
        rows = np.flatnonzero(of >= self.leaves)
        rows = rows[np.argsort(of[rows], kind="stable")]
        slots, counts = self.slot[targets[rows]], np.bincount(of[rows], minlength=self.count)
        stop, bins = np.cumsum(counts), []
        for c in np.flatnonzero(counts):
            run, first = slice(stop[c] - counts[c], stop[c]), self.at[c]
            bins.append((run, slice(first, first + self.size[c]), slots[run] - first))
        return rows, bins


def start(pieces: int, classes: int) -> dict[str, np.ndarray]:
    return {**net.start(pieces, classes), "member": np.zeros((net.HIDDEN, pieces - 1), np.float32)}


def chances(w: dict[str, np.ndarray], tree: Tree, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Log chances of the targets at the scored positions."""
    logits, kept = net.odds(w, inputs, tree.prior)
    r = kept[-1]
    out = logits[np.arange(len(targets)), tree.of[targets]]
    np.exp(logits, out=logits)
    out -= np.log(logits @ np.ones(logits.shape[1], logits.dtype))
    rows, bins = tree.binned(targets)
    x, lower = r.take(rows, 0), np.empty(len(rows), r.dtype)
    for run, slots, mine in bins:
        z = x[run] @ w["member"][:, slots]
        z += tree.share[slots]
        aim = z[np.arange(len(mine)), mine]
        np.exp(z, out=z)
        lower[run] = aim - np.log(z @ np.ones(z.shape[1], z.dtype))
    out[rows] += lower
    return out


def gradients(w: dict[str, np.ndarray], tree: Tree, inputs: np.ndarray, targets: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the ``live`` scored positions and its gradients. Targets that aren't live must be ``START``."""
    d, kept = net.odds(w, inputs, tree.prior)
    r, m = kept[-1], max(int(live.sum()), 1)

    def descend(d: np.ndarray, aims: np.ndarray, share: np.ndarray) -> float:
        """The loss at one softmax; its log odds become their gradients."""
        at = np.arange(len(aims))
        aim = d[at, aims]
        np.exp(d, out=d)
        whole = d @ np.ones(d.shape[1], d.dtype)
        d *= (share / whole)[:, None]
        d[at, aims] -= share
        return float((np.log(whole) - aim) @ share)

    share = (live / m).astype(d.dtype)
    loss = descend(d, tree.of[targets], share)
    g = {"out": r.T @ d, "member": np.zeros_like(w["member"])}
    dr = d @ w["out"].T
    rows, bins = tree.binned(targets)
    x, part = r.take(rows, 0), share[rows]
    dx = np.empty_like(x)
    for run, slots, mine in bins:
        member = w["member"][:, slots]
        z = x[run] @ member
        z += tree.share[slots].astype(z.dtype)
        loss += descend(z, mine, part[run])
        g["member"][:, slots] = x[run].T @ z
        np.matmul(z, member.T, out=dx[run])
    dr[rows] += dx
    return loss, {**g, **net.body_gradients(w, inputs, kept, dr)}


class Model:
    """All that scoring needs: the index of each of the tokenizer's ids, the tree, the network's weights and the head:
    the end first, then words, with their counts and pieces (a run of ``flat`` each)."""

    def __init__(self, path: str, ids: dict[int, int], head: dict[bytes, int], ends: int, total: int, distinct: int):
        self.path, self.total, self.distinct = path, total, distinct
        size, seen = lm.speller(path).get_piece_size(), sorted(ids, key=lambda p: (-ids[p], p))
        #: What holds an index: 16 bits, 32 for a tokenizer whose training words have more pieces than that.
        self.kind = np.int16 if FIRST + len(seen) <= NARROW else np.int32
        self.index = np.full(size, UNSEEN, self.kind)
        self.index[seen] = np.arange(FIRST, FIRST + len(seen))
        #: Log number of the pieces that share the chance of ``UNSEEN``.
        self.unseen = float(np.log(max(size - len(seen), 1)))
        self.tree = Tree(np.array([0, ends, 0, *(ids[p] for p in seen)], np.float64))
        self.n = FIRST + len(seen)
        self.words = [lm.END, *(w for w in head if w != lm.END)]
        sizes, flat = self.pieces(self.words[1:])
        self.known = (np.append(1, sizes), np.append(self.kind(END), flat), np.array([ends, *(head[w] for w in self.words[1:])], np.int64))
        self.weights: dict[str, np.ndarray] = start(self.n, self.tree.count)
        #: Pieces that the network has learned from, after the warm texts.
        self.learned = 0

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of each word, all their indices)."""
        sizes, flat = spelled(self.path, words)
        return sizes, self.index[flat]

    def base(self, c):
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


class Reader:
    """Texts as rows of pieces, and the counts of the head's words."""

    def __init__(self, model: Model):
        self.model, self.number = model, Memo()
        self.clear()

    def clear(self) -> None:
        self.number.clear()
        self.number.learn(self.model.words, range(len(self.model.words)))
        self.word = list(self.model.words)
        self.size, self.flat, self.counts = self.model.known
        self.at = np.cumsum(self.size) - self.size

    def learn(self, words: list[bytes]) -> None:
        """Words outside the head: their counts aren't known here."""
        size, flat = self.model.pieces(words)
        n = len(self.number)
        self.number.learn(words, range(n, n + len(words)))
        self.word += words
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(size) - size))
        self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, flat))
        self.counts = np.concatenate((self.counts, np.full(len(words), -1, np.int64)))

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts with their ends, tokens of each text)."""
        if self.number.full:
            self.clear()
        index, distinct, sizes = words_of(texts)
        known = self.number
        new = [w for w in distinct if w and w not in known]
        if new:
            self.learn(new)
        numbers = np.fromiter((known[w] for w in distinct), np.int64, len(distinct))
        # The end of each text is word 0.
        words = np.zeros(len(index) + len(sizes), np.int64)
        words[ranges(np.cumsum(sizes + 1) - sizes - 1, sizes)] = numbers[index]
        return words, sizes + 1

    def pieces(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of the words, how many each has)."""
        n = self.size[words]
        return self.flat[ranges(self.at[words], n)], n


def spelled(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each word, all their ids). A word that is spelled with nothing has id 0, the unknown piece."""
    lists = [x or (0,) for x in lm.spell(path, words)]
    sizes = np.array([len(x) for x in lists], np.int64)
    return sizes, np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))


def count_ids(counts: DataFrame, path: str) -> dict[int, int]:
    """How often each of the tokenizer's ids stands in the counted words; those in none are left out."""

    def run(batches):
        found = np.zeros(lm.speller(path).get_piece_size(), np.int64)
        for batch in filter(len, batches):
            sizes, flat = spelled(path, batch.column("word").to_pylist())
            np.add.at(found, flat, np.repeat(batch.column("c").to_numpy(), sizes))
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["id", "c"])

    got = counts.where(F.length("word") > 0).mapInArrow(run, "id bigint, c bigint").groupBy("id").agg(F.sum("c").alias("c")).toArrow()
    return dict(zip(got.column("id").to_pylist(), got.column("c").to_pylist()))


def coded(rows: DataFrame, model: Model) -> DataFrame:
    """A table of two kinds of rows. A row for each text: row, key, h (null for rows that teach nothing), fresh (no row
    before it in the task has its h), seq (its pieces, ``Model.kind`` each), n_tokens, and what the head's words add to n_known
    and base. A row for each other word of a text: row, word, tf."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["key"].dataType.simpleString()
    names = ["row", "key", "h", "fresh", "seq", "word", "tf", "n_tokens", "n_known", "base"]
    kinds = [pa.int64(), None, pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]

    def batch_of(n: int, types: list, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def run(batches):
        reader, seen = Reader(shared.value), set()
        for batch in parts(batches):
            types = [t or batch.schema.field("key").type for t in kinds]
            words, sizes = reader.rows(batch.column("text"))
            begin, n = np.cumsum(sizes) - sizes, len(sizes)
            fresh = []
            for x in batch.column("h").to_pylist():
                fresh.append(x is not None and x not in seen)
                seen.add(x)
            c = reader.counts[words]
            known = c >= 0
            base = np.where(known, reader.model.base(np.maximum(c, 0)), 0.0)
            flat, many = reader.pieces(words)
            seq, ends = flat.tobytes(), np.concatenate(([0], np.cumsum(np.add.reduceat(many, begin)))) * flat.itemsize
            yield batch_of(
                n, types, row=batch.column("row"), key=batch.column("key"), h=batch.column("h"), fresh=pa.array(fresh), seq=pa.array([seq[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()), n_tokens=pa.array(sizes),
                n_known=pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)), base=pa.array(np.add.reduceat(base, begin)),
            )
            both, many = np.unique(np.repeat(np.arange(n), sizes)[~known] << 32 | words[~known], return_counts=True)
            text, tail = both >> 32, both & 0xFFFFFFFF
            yield batch_of(len(tail), types, row=batch.column("row").take(pa.array(text)), word=pa.array([reader.word[k] for k in tail.tolist()], pa.binary()), tf=pa.array(many))

    schema = f"row bigint, key {kind}, h bigint, fresh boolean, seq binary, word binary, tf bigint, n_tokens bigint, n_known bigint, base double"
    return materialize(rows.mapInArrow(run, schema))


def train(model: Model, texts: list[np.ndarray], optimiser: net.Adam, steps: int | None = None, seed: int = 0) -> int:
    """Adam over the texts' windows, in place: ``steps`` of them with a falling rate, or one pass. Number of pieces."""
    if not texts:
        return 0
    rate = optimiser.rate
    tokens, lengths = np.concatenate(texts), np.array([len(t) for t in texts], np.int64)
    row, begin, place = lm.inputs_of(tokens, lengths)
    targets, live = np.full(len(begin) * net.STRIDE, START, tokens.dtype), np.zeros(len(begin) * net.STRIDE, bool)
    targets[place], live[place] = tokens, True
    targets, live = targets.reshape(-1, net.STRIDE), live.reshape(-1, net.STRIDE)
    order = np.random.default_rng(seed).permutation(len(begin))
    used, size = 0, lm.SIZE if steps is None else lm.WARM_SIZE
    for step in range(steps if steps is not None else -(-len(order) // size)):
        at = order[np.arange(step * size, step * size + size) % len(order)] if steps is not None else order[step * size : step * size + size]
        if steps is not None:
            optimiser.rate = rate * (1 - 0.9 * step / steps)
        _, g = gradients(model.weights, model.tree, row.take(begin[at][:, None] + np.arange(net.LENGTH)), targets[at].ravel(), live[at].ravel())
        optimiser.step(g)
        used += int(live[at].sum())
    return used


def text_scores(model: Model, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text: the sum of the log chances of its pieces."""
    row, begin, place = lm.inputs_of(tokens, lengths)
    targets = np.full(len(begin) * net.STRIDE, START, tokens.dtype)
    targets[place] = tokens
    chance = np.zeros(len(targets))
    for i in range(0, len(begin), BATCH):
        b = begin[i : i + BATCH]
        at = slice(i * net.STRIDE, (i + len(b)) * net.STRIDE)
        chance[at] = chances(model.weights, model.tree, row[b[:, None] + np.arange(net.LENGTH)], targets[at])
    found = chance[place]
    found[tokens == UNSEEN] -= model.unseen
    return np.add.reduceat(found, np.cumsum(lengths) - lengths)


def fit(documents: DataFrame, path: str, allowed: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Model, DataFrame]:
    """(the documents' ``coded`` table, the model, word counts), learned from the rows where ``allowed`` holds."""
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(allowed, F.lit(False)).alias("teaches"))
    counts, head, total, distinct, ends = lm.counted(rows.where("teaches"))
    model = Model(path, count_ids(counts, path), head, ends, total, distinct)
    h = F.when(F.col("teaches"), F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "text"))
    table = coded(rows.select(F.monotonically_increasing_id().alias("row"), "key", h.alias("h"), "text"), model)
    model.tree.follow(lm.following(table, model.tree.of, model.tree.count, model.kind))
    train(model, lm.warm_texts(table, ends, model.kind), net.Adam(model.weights, 0.015), lm.WARM_STEPS)
    lm.refine(model, table, train, model.kind)
    return table, model, counts


def score(documents: DataFrame, path: str, allowed: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score), one row per document row; learned from the rows where
    ``allowed`` (a condition on the documents' columns) holds.

    A null or empty text is the end alone. Without any training text nothing is known: the end and all pieces are as
    likely as the starting odds make them. Rows with null keys and repeated rows each get their row; an empty table gives
    an empty one; very long texts are read whole. The scores don't depend on the order of the rows or their partitions,
    but for the last digits of sums. Other columns aren't read."""
    return scored(*fit(documents, path, allowed, key, text), key)


def scored(table: DataFrame, model: Model, counts: DataFrame, key: str) -> DataFrame:
    """The result of ``score`` for the texts of a ``coded`` table."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    kind = table.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = lm.sequences(batch.column("seq"), shared.value.kind)
            sizes = np.array([len(t) for t in texts], np.int64)
            found = np.zeros(len(texts))
            at = 0
            while at < len(texts):  # some ``CHUNK`` pieces at a time
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), lm.CHUNK, side="right")) + at)
                found[at:stop] = text_scores(shared.value, np.concatenate(texts[at:stop]), sizes[at:stop])
                at = stop
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "key", "n_tokens", "n_known", "base")), pa.array(found / np.log(10))], names=["row", "key", "n_tokens", "n_known", "base", "score"])

    texts = table.where("word IS NULL").select("row", "key", "n_tokens", "n_known", "base", "seq").mapInArrow(run, f"row bigint, key {kind}, n_tokens bigint, n_known bigint, base double, score double")
    unit = F.lit(float(model.total + 0.1 * (model.distinct + 1)))
    rest = table.where("word IS NOT NULL").select("row", "word", "tf").join(counts, "word", "left")
    terms = rest.select("row", (F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / unit)).alias("base"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"))
    both = texts.unionByName(terms, allowMissingColumns=True).groupBy("row").agg(F.first("key", ignorenulls=True).alias("key"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return both.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")
