"""Language-model scores of whole texts.

A text is its lower-cased words and one end; a word is spelled in subword pieces. A causal self-attention network
(``attention``) reads the first pieces of the words in overlapping windows, each token scored once, and gives the class
of the next word's first piece. Counts of all training words give the piece in its class, and the rest of the word: as
a whole, in proportion to the words of that first piece, or spelled on piece by piece, for words that weren't seen. The
chances of all words, the end included, sum to one.

Classes are groups of first pieces that share texts (k-means on the warm texts), cut by frequency.

What is learned from: word counts of all training texts; piece pairs of all counted words; which class follows which
first piece, over all training texts; network weights that are first fitted to ``WARM`` training texts and then to every
window of all training texts, ends included.

The second fit doesn't depend on how the table is partitioned: texts go to shards by a hash of key and text, each shard
learns its texts in the order of that hash in chunks of fixed size, and the shards' weights are averaged. Rows that
repeat a key and its text teach the network once (their words count each time); each task sends only the first of them.
Shards number one for ``SHARD`` tokens, ``SHARDS`` at most, beyond which they grow; they are streamed, never held whole.

The base score and the whole-word way need the count of every word. The ``HEAD`` words (a fixed bound) are broadcast;
the other words of a text meet their counts in a shuffle, where no word can be hot, since hot words are in the head.
Both ways give the same terms, so the head's size changes no score.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm import attention as net
from quillstack.llm.common import Memo, discard, materialize, parts, ranges, slices, words_of

HEAD, PIECES, CLASSES, GROUPS = 1 << 18, 1500, 64, 6
#: Texts of the first fit (of ``WARM_TOKENS`` tokens at most), its steps, and windows in a step of each fit.
WARM, WARM_TOKENS, WARM_STEPS, WARM_SIZE, SIZE = 1000, 1 << 16, 1500, 48, 256
RATE = 0.001
#: Tokens of a shard, shards at most, and tokens that are shuffled and learned together.
SHARD, SHARDS, CHUNK = 1 << 22, 4096, 1 << 17
#: Weights that are added up as one row, and tasks that add.
BLOCK, ADDERS = 4096, 8
END = b""
BLANK = "▁"


@lru_cache(maxsize=2)
def speller(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def spell(path: str, words: list[bytes]) -> list[list[int]]:
    return speller(path).encode([w.decode(errors="replace").replace(BLANK, "_") for w in words], num_threads=1)


def groups_of(n: int, texts: list[np.ndarray], groups: int = GROUPS) -> np.ndarray:
    """Group of each of ``n`` pieces by the texts that they stand in: k-means of unit vectors. Pieces in none: group 0."""
    table = np.zeros((n, len(texts) + 1), np.float32)
    for k, t in enumerate(texts):
        table[:, k] = np.sqrt(np.bincount(t, minlength=n))
    used = np.flatnonzero(table.sum(1))
    out = np.zeros(n, np.int64)
    if len(used) < groups:
        return out
    u, d, _ = np.linalg.svd(table[used] / np.linalg.norm(table[used], axis=1, keepdims=True), full_matrices=False)
    x = (u * d)[:, :24]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    heavy = np.argsort(-table[used].sum(1), kind="stable")
    centres = [x[heavy[0]]]
    for _ in range(groups - 1):  # each next centre: the frequent piece least like the ones before
        near = np.max(x[heavy[: len(heavy) // 3 + groups]] @ np.array(centres).T, axis=1)
        centres.append(x[heavy[int(np.argmin(near))]])
    c = np.array(centres)
    for _ in range(25):
        mine = (x @ c.T).argmax(1)
        for g in range(groups):
            if (mine == g).any():
                c[g] = x[mine == g].mean(0)
                c[g] /= np.linalg.norm(c[g]) + 1e-9
    out[used] = mine
    return out


class Spelling:
    """Words by their first pieces, and the chance of a word given its first piece.

    A first piece is an index: 0 stands before the text, 1 is the end, 2 a rare piece, then the ``PIECES`` most frequent
    ones. ``held`` and ``once``: words, and words seen once, by first piece. ``singles`` and ``pairs``: pieces, and
    pieces that follow each other, in all counted words."""

    def __init__(self, size: int, held: dict[int, int], once: dict[int, int], singles: dict[int, int], pairs: dict[tuple[int, int], int], kept: int = PIECES):
        full = lambda counts: np.bincount(np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), np.float64, len(counts)), size)
        self.held, self.single = full(held), full(singles)
        top = sorted(held, key=lambda p: (-held[p], p))[:kept]
        self.index = np.full(size, 2, np.int16)
        self.index[top] = np.arange(3, 3 + len(top))
        self.n = 3 + len(top)
        #: The share of a rare first piece among them, by count with 0.1 added.
        self.rare = self.among(self.held, self.index == 2)
        on = np.clip((full(once) + 0.5) / (self.held + 1), 0.01, 1)
        #: For each first piece: log chance that the word is spelled on; log chance of one count of a whole word.
        self.spelled = np.log(on)
        with np.errstate(divide="ignore"):
            self.whole = np.log1p(-on) - np.log(np.maximum(self.held, 1))
        # Pieces after a piece: that the word ends, else those that go on, discounted towards their counts.
        often = sorted(singles, key=lambda p: (-singles[p], p))[:kept]
        self.inner = np.zeros(size, np.int64)
        self.inner[often] = np.arange(1, len(often) + 1)
        m = len(often) + 1
        self.odd = self.among(self.single, self.inner == 0)
        after = np.zeros((m, m))
        for (a, b), c in pairs.items():
            after[self.inner[a], self.inner[b]] += c
        all_, onward = np.bincount(self.inner, self.single, m), after.sum(1)
        go = np.bincount(self.inner, self.single - np.minimum(self.held, self.single), m) + 0.1
        go /= go.sum()
        stop = np.maximum(all_ - onward, 0) + 0.5
        lifted = np.minimum(after, 0.5).sum(1) + 0.5
        onward += 0.5
        table = (np.maximum(after - 0.5, 0) + lifted[:, None] * go) / (onward + stop)[:, None]
        self.after, self.stop = np.log(table).astype(np.float32), np.log(stop / (onward + stop))

    @staticmethod
    def among(counts: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Log share of each of the pieces ``which`` among them, by count with 0.1 added; 0 for the others."""
        plus = (counts + 0.1) * which
        return np.where(which, np.log(np.where(which, plus, 1) / max(plus.sum(), 1e-9)), 0.0)

    def words(self, path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the first piece, log chance given it that the word is spelled so, of one count as a whole). A word
        that is spelled with nothing has a rare first piece."""
        lists = spell(path, words)
        sizes = np.array([max(len(x), 1) for x in lists], np.int64)
        flat = np.fromiter(chain.from_iterable(x or (0,) for x in lists), np.int64, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        terms = np.zeros(len(flat))
        terms[1:] = self.after[self.inner[flat[:-1]], self.inner[flat[1:]]] + self.odd[flat[1:]]
        terms[begin] = 0
        first = flat[begin]
        rest = np.add.reduceat(terms, begin) + self.stop[self.inner[flat[begin + sizes - 1]]] if len(begin) else terms
        rare = self.rare[first]
        return self.index[first], rare + self.spelled[first] + rest, rare + self.whole[first]


class Classes:
    """Classes of first pieces: bins of equal sums of square roots of counts in each group; frequent ones hold few pieces.

    ``prior``: log odds of the class after each first piece, from ``follow`` counts; ``within``: log chance of a first
    piece in its class."""

    def __init__(self, begin: np.ndarray, texts: list[np.ndarray], classes: int = CLASSES):
        n = len(begin)
        self.count, self.of = classes, np.zeros(n, np.int64)
        group = groups_of(n, texts)
        weight = np.sqrt(begin + 1)
        members = np.arange(1, n)
        shares = np.array([weight[members[group[members] == g]].sum() for g in range(GROUPS)])
        parts = np.maximum(1, np.floor(shares / shares.sum() * (classes - GROUPS))).astype(int)
        at = np.cumsum(parts) - parts
        for g in range(GROUPS):
            inside = members[group[members] == g]
            inside = inside[np.argsort(-weight[inside], kind="stable")]
            self.of[inside] = at[g] + np.minimum(np.cumsum(weight[inside]) * parts[g] / (shares[g] + 1), parts[g] - 1).astype(np.int64)
        plus = begin + 0.1
        plus[0] = 0
        self.total = np.bincount(self.of, plus, classes)
        self.within = np.log(np.maximum(plus, 1e-30) / np.maximum(self.total[self.of], 1e-30))

    def follow(self, counts: np.ndarray) -> None:
        chance = self.total / self.total.sum()
        self.prior = np.log((counts + 4 * chance) / (counts.sum(1, keepdims=True) + 4) + 1e-9).astype(np.float32)


class Model:
    """All that scoring needs: the spelling, the classes, the network's weights and the head: the end first, then words,
    each with its first piece, count, ways (``Spelling.words``) and the log chance that they make together."""

    def __init__(self, path: str, spelling: Spelling, head: dict[bytes, int], ends: int, total: int, distinct: int):
        self.path, self.spelling, self.total, self.distinct = path, spelling, total, distinct
        self.words = [END, *(w for w in head if w != END)]
        counts = np.array([ends, *(head[w] for w in self.words[1:])], np.int64)
        start, on, one = spelling.words(path, self.words[1:])
        mixed = np.logaddexp(on, one + np.log(counts[1:]))
        self.known = (np.append(np.int16(1), start), counts, np.append(0.0, on), np.append(-np.inf, one), np.append(0.0, mixed))
        self.classes: Classes | None = None
        self.weights: dict[str, np.ndarray] = {}
        #: Tokens that the network has learned from, after the warm texts.
        self.learned = 0

    def base(self, c):
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


class Reader:
    """Texts as rows of first pieces, with what is known of each word beforehand."""

    def __init__(self, model: Model):
        self.model, self.number = model, Memo()
        self.clear()

    def clear(self) -> None:
        self.number.clear()
        self.number.learn(self.model.words, range(len(self.model.words)))
        self.word = list(self.model.words)
        self.start, self.counts, self.on, self.one, self.mixed = self.model.known

    def learn(self, words: list[bytes]) -> None:
        """Words outside the head: their counts, and with them what they add, aren't known here."""
        start, on, one = self.model.spelling.words(self.model.path, words)
        counts, mixed = np.full(len(words), -1, np.int64), np.zeros(len(words))
        n = len(self.number)
        self.number.learn(words, range(n, n + len(words)))
        self.word += words
        for name, new in (("start", start), ("counts", counts), ("on", on), ("one", one), ("mixed", mixed)):
            setattr(self, name, np.concatenate((getattr(self, name), new)))

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


def inputs_of(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the padded row of inputs, window starts, places in the windows' scored positions of each token)."""
    padded, begin, _ = net.windows(lengths)
    first = np.cumsum(padded) - padded
    row = np.zeros(int(padded.sum()), np.int32)
    lead = net.LENGTH - net.STRIDE
    # The input of a position is the token before it.
    row[ranges(first + lead + 1, lengths - 1)] = tokens[ranges(np.cumsum(lengths) - lengths, lengths - 1)]
    count = -(-lengths // net.STRIDE)
    return row, begin, ranges((np.cumsum(count) - count) * net.STRIDE, lengths)


def first_scores(model: Model, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text: the sum of the log chances of its tokens' first pieces."""
    k = model.classes
    row, begin, place = inputs_of(tokens, lengths)
    targets = np.zeros(len(begin) * net.STRIDE, np.int64)
    targets[place] = k.of[tokens]
    chance = np.zeros(len(targets))
    for i in range(0, len(begin), net.BATCH):
        b = begin[i : i + net.BATCH]
        at = slice(i * net.STRIDE, (i + len(b)) * net.STRIDE)
        chance[at] = net.chances(model.weights, row[b[:, None] + np.arange(net.LENGTH)], k.prior, targets[at])
    return np.add.reduceat(chance[place] + k.within[tokens], np.cumsum(lengths) - lengths)


def train(model: Model, texts: list[np.ndarray], optimiser: net.Adam, steps: int | None = None, seed: int = 0) -> int:
    """Adam over the texts' windows, in place: ``steps`` of them with a falling rate, or one pass. Number of tokens."""
    if not texts:
        return 0
    k, rate = model.classes, optimiser.rate
    tokens, lengths = np.concatenate(texts), np.array([len(t) for t in texts], np.int64)
    row, begin, place = inputs_of(tokens, lengths)
    targets, live = np.zeros(len(begin) * net.STRIDE, np.int64), np.zeros(len(begin) * net.STRIDE, bool)
    targets[place], live[place] = k.of[tokens], True
    targets, live = targets.reshape(-1, net.STRIDE), live.reshape(-1, net.STRIDE)
    order = np.random.default_rng(seed).permutation(len(begin))
    used, size = 0, SIZE if steps is None else WARM_SIZE
    for step in range(steps if steps is not None else -(-len(order) // size)):
        at = order[np.arange(step * size, step * size + size) % len(order)] if steps is not None else order[step * size : step * size + size]
        if steps is not None:
            optimiser.rate = rate * (1 - 0.9 * step / steps)
        _, g = net.gradients(model.weights, row[begin[at][:, None] + np.arange(net.LENGTH)], targets[at].ravel(), live[at].ravel(), k.prior)
        optimiser.step(g)
        used += int(live[at].sum())
    return used


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) of the texts, the end as an empty word; counted in each task before the shuffle."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            part = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return part

        for _, texts in slices(batches):
            for t in texts:
                counts.update(t.lower().split())
            counts[END] += len(texts)
            if len(counts) > 250_000:
                yield out()
        yield out()

    return rows.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def count_pieces(counts: DataFrame, path: str) -> DataFrame:
    """(a, b, c) over all counted words: pairs of pieces that follow each other in words; a = -1: single pieces, a = -2:
    first ones, a = -3: first ones of words that were counted once."""

    def run(batches):
        found: Counter = Counter()

        def out():
            keys = np.array(list(found), np.int64)
            part = pa.RecordBatch.from_arrays([pa.array((keys >> 20) - 3), pa.array(keys & 0xFFFFF), pa.array(list(found.values()), pa.int64())], names=["a", "b", "c"])
            found.clear()
            return part

        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy()
            lists = [x or (0,) for x in spell(path, words)]
            sizes = np.array([len(x) for x in lists], np.int64)
            flat = np.fromiter(chain.from_iterable(lists), np.int64)
            weight = np.repeat(c, sizes)
            first = np.zeros(len(flat), bool)
            first[np.cumsum(sizes) - sizes] = True
            rare = first & (weight == 1)
            keys = np.concatenate((2 << 20 | flat, 1 << 20 | flat[first], flat[rare], np.concatenate(([0], flat[:-1] + 3))[~first] << 20 | flat[~first]))
            unique, back = np.unique(keys, return_inverse=True)
            for k, v in zip(unique.tolist(), np.bincount(back, np.concatenate((weight, weight[first], weight[rare], weight[~first]))).astype(np.int64).tolist()):
                found[k] += v
            if len(found) > 300_000:
                yield out()
        yield out()

    return counts.where(F.length("word") > 0).mapInArrow(run, "a bigint, b bigint, c bigint").groupBy("a", "b").agg(F.sum("c").alias("c"))


def counted(rows: DataFrame) -> tuple[DataFrame, dict[bytes, int], int, int, int]:
    """(the table (word, c) of the rows' word counts, the head, tokens, distinct tokens, ends)."""
    counts = materialize(count_words(rows))
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    # The head: all words from the lowest count on of which there are no more than HEAD.
    held, least = 0, None
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        held += r["n"]
        if held > HEAD:
            break
        least = r["c"]
    top = counts.where(F.col("c") >= F.lit(least)).toArrow() if least is not None else counts.limit(0).toArrow()
    head = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist()))
    return counts, head, int(total), int(distinct), int(ends)


def learn_words(rows: DataFrame, path: str) -> tuple[Model, DataFrame]:
    """The model without its network, and the table (word, c) of the rows' word counts."""
    counts, head, total, distinct, ends = counted(rows)
    pairs = materialize(count_pieces(counts, path))
    kinds = {a: {r["b"]: r["c"] for r in pairs.where(F.col("a") == a).collect()} for a in (-1, -2, -3)}
    kept = sorted(kinds[-1], key=lambda p: (-kinds[-1][p], p))[:PIECES]
    known = F.array(*map(F.lit, kept)) if kept else F.array().cast("array<int>")
    inner = pairs.where((F.col("a") >= 0) & F.array_contains(known, F.col("a").cast("int")) & F.array_contains(known, F.col("b").cast("int")))
    both = {(r["a"], r["b"]): r["c"] for r in inner.collect()}
    discard(pairs)
    spelling = Spelling(speller(path).get_piece_size(), kinds[-2], kinds[-3], kinds[-1], both)
    return Model(path, spelling, head, ends, total, distinct), counts


def coded(rows: DataFrame, model: Model) -> DataFrame:
    """A table of two kinds of rows. A row for each text: row, key, h (null for rows that teach nothing), fresh (no row
    before it in the task has its h), seq (its tokens' first pieces, 16 bits each), n_tokens, and what the head's words
    add to n_known, base and score. A row for each other word of a text: row, word, tf, spelled, whole."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["key"].dataType.simpleString()
    names = ["row", "key", "h", "fresh", "seq", "word", "tf", "n_tokens", "n_known", "base", "score", "spelled", "whole"]
    kinds = [pa.int64(), None, pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]

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
            seq = reader.start[words].tobytes()
            ends = np.concatenate(([0], np.cumsum(sizes))) * 2
            yield batch_of(
                n, types, row=batch.column("row"), key=batch.column("key"), h=batch.column("h"), fresh=pa.array(fresh), seq=pa.array([seq[a:b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()), n_tokens=pa.array(sizes),
                n_known=pa.array(np.add.reduceat((c > 0).astype(np.int64), begin)), base=pa.array(np.add.reduceat(base, begin)), score=pa.array(np.add.reduceat(reader.mixed[words], begin)),
            )
            text, tail = np.repeat(np.arange(n), sizes)[~known], words[~known]
            both, many = np.unique(text << 32 | tail, return_counts=True)
            text, tail = both >> 32, both & 0xFFFFFFFF
            yield batch_of(
                len(tail), types, row=batch.column("row").take(pa.array(text)), word=pa.array([reader.word[k] for k in tail.tolist()], pa.binary()), tf=pa.array(many), spelled=pa.array(reader.on[tail]), whole=pa.array(reader.one[tail]),
            )

    schema = f"row bigint, key {kind}, h bigint, fresh boolean, seq binary, word binary, tf bigint, n_tokens bigint, n_known bigint, base double, score double, spelled double, whole double"
    return materialize(rows.mapInArrow(run, schema))


def sequences(column: pa.Array, kind=np.int16) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def warm_texts(table: DataFrame, texts: int, kind=np.int16) -> list[np.ndarray]:
    """The ``WARM`` training texts, of so many, whose hash is lowest, read behind a bound of the hash that about twice as
    many pass."""
    chosen = table.where(F.col("fresh") & (F.length("seq") <= np.dtype(kind).itemsize * WARM_TOKENS)).withColumn("low", F.pmod("h", F.lit(1 << 40)))
    bound = int(min(1.0, 2 * (WARM + 50) / max(texts, 1)) * (1 << 40))
    warm = chosen.where(F.col("low") < bound).dropDuplicates(["h"]).orderBy("low", "h").limit(WARM).select("seq").toArrow()
    return sequences(warm.column("seq").combine_chunks(), kind)


def following(table: DataFrame, of: np.ndarray, n: int, kind=np.int16) -> np.ndarray:
    """How often each of the ``n`` classes comes after each token, in all training texts; ``of``: the tokens' classes."""
    kinds, of = len(of), table.sparkSession.sparkContext.broadcast(of)

    def count(batches):
        found = np.zeros(kinds * n, np.int64)
        for batch in filter(len, batches):
            texts = sequences(batch.column("seq"), kind)
            sizes = np.array([len(t) for t in texts], np.int64)
            tokens = np.concatenate(texts).astype(np.int64)
            before = np.concatenate(([0], tokens[:-1]))
            before[np.cumsum(sizes) - sizes] = 0
            found += np.bincount(before * n + of.value[tokens], minlength=kinds * n)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], names=["i", "c"])

    follow = np.zeros(kinds * n)
    got = table.where("h IS NOT NULL").select("seq").mapInArrow(count, "i bigint, c bigint").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    follow[got.column("i").to_numpy()] = got.column("c").to_numpy()
    return follow.reshape(kinds, n)


def learn_classes(model: Model, table: DataFrame, texts: int) -> list[np.ndarray]:
    """Classes and prior, in place; returns the warm texts."""
    begin = np.bincount(model.spelling.index, model.spelling.held, model.spelling.n)
    begin[1] = texts
    warm = warm_texts(table, texts)
    model.classes = Classes(begin, warm)
    model.classes.follow(following(table, model.classes.of, model.classes.count))
    return warm


def blocks_of(sums: dict) -> pa.RecordBatch:
    """Runs of weights (their start, their sums, tokens) as rows."""
    columns = [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v, _ in sums.values()], pa.binary()), pa.array([n for _, n in sums.values()], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=["i", "v", "n"])


def refine(model: Model, table: DataFrame, teach=None, kind=np.int16) -> None:
    """The second fit, in place: every window of every text of the table that teaches, shard by shard, by ``teach``
    (``train``)."""
    teach = teach or train
    tokens = table.where("h IS NOT NULL").agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0] // np.dtype(kind).itemsize
    shards = int(min(max(1, -(-tokens // SHARD)), SHARDS))
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from copy import copy

        total, count, mine, shard, before = None, 0.0, None, None, None
        held: list[np.ndarray] = []
        size = chunk = used = 0

        def learn():
            nonlocal held, size, chunk, used
            used += teach(mine, held, optimiser, seed=chunk)
            held, size, chunk = [], 0, chunk + 1

        def close():
            nonlocal total, count
            if mine is not None:
                learn()
                values = net.flatten(mine.weights).astype(np.float64) * used
                total, count = values if total is None else total + values, count + used

        for batch in batches:
            for s, h, t in zip(batch.column("shard").to_pylist(), batch.column("h").to_pylist(), sequences(batch.column("seq"), kind)):
                if s != shard:
                    close()
                    mine = copy(shared.value)
                    mine.weights = {k: x.copy() for k, x in mine.weights.items()}
                    optimiser = net.Adam(mine.weights, RATE)
                    shard, before, chunk, used = s, None, 0, 0
                if h != before:
                    held.append(t)
                    size, before = size + len(t), h
                if size >= CHUNK:
                    learn()
        close()
        if total is not None:
            yield blocks_of({i: (total[i : i + BLOCK], count) for i in range(0, len(total), BLOCK)})

    def add(batches):
        sums: dict = {}
        for batch in batches:
            for i, v, n in zip(*(batch.column(c).to_pylist() for c in ("i", "v", "n"))):
                old = sums.get(i, (0.0, 0.0))
                sums[i] = old[0] + np.frombuffer(v), old[1] + n
        yield blocks_of(sums)

    dealt = table.where("fresh").select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), "h", "seq")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h")
    sums = "i bigint, v binary, n double"
    summed = dealt.mapInArrow(run, sums).repartition(ADDERS, "i").mapInArrow(add, sums).orderBy("i").toArrow()
    if summed.num_rows:
        model.learned = int(summed.column("n")[0].as_py())
        model.weights = net.unflatten(np.concatenate([np.frombuffer(v) for v in summed.column("v").to_pylist()]) / model.learned, model.weights)


def fit(documents: DataFrame, path: str, allowed: Column, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Model, DataFrame]:
    """(the documents' ``coded`` table, the model, word counts), learned from the rows where ``allowed`` holds."""
    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(allowed, F.lit(False)).alias("teaches"))
    model, counts = learn_words(rows.where("teaches"), path)
    h = F.when(F.col("teaches"), F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), "text"))
    table = coded(rows.select(F.monotonically_increasing_id().alias("row"), "key", h.alias("h"), "text"), model)
    warm = learn_classes(model, table, int(model.known[1][0]))
    model.weights = net.start(model.spelling.n, model.classes.count)
    train(model, warm, net.Adam(model.weights, 0.015), WARM_STEPS)
    refine(model, table)
    return table, model, counts


def score(documents: DataFrame, path: str, allowed: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score), one row per document row; learned from the rows where
    ``allowed`` (a condition on the documents' columns) holds.

    A null or empty text is the end alone. Without any training text nothing is known, and the spelling falls back to
    its smoothing. Rows with null keys and repeated rows each get their row; an empty table gives an empty one; very long
    texts are read whole. The scores don't depend on the order of the rows or their partitions, but for the last digits
    of sums. Other columns aren't read."""
    return scored(*fit(documents, path, allowed, key, text), key)


def scored(table: DataFrame, model: Model, counts: DataFrame, key: str) -> DataFrame:
    """The result of ``score`` for the texts of a ``coded`` table."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    kind = table.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = sequences(batch.column("seq"))
            sizes = np.array([len(t) for t in texts], np.int64)
            found = np.zeros(len(texts))
            at = 0
            while at < len(texts):  # some ``CHUNK`` tokens at a time
                stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, side="right")) + at)
                found[at:stop] = first_scores(shared.value, np.concatenate(texts[at:stop]), sizes[at:stop])
                at = stop
            mixed = batch.column("score").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "key", "n_tokens", "n_known", "base")), pa.array((found + mixed) / np.log(10))], names=["row", "key", "n_tokens", "n_known", "base", "score"])

    texts = table.where("word IS NULL").select("row", "key", "n_tokens", "n_known", "base", "score", "seq").mapInArrow(run, f"row bigint, key {kind}, n_tokens bigint, n_known bigint, base double, score double")
    unit = F.lit(float(model.total + 0.1 * (model.distinct + 1)))
    rest = table.where("word IS NOT NULL").select("row", "word", "tf", "spelled", "whole").join(counts, "word", "left")
    one = F.col("whole") + F.log("c")
    mixed = F.when(F.coalesce("c", F.lit(0)) > 0, F.greatest("spelled", one) + F.log1p(F.exp(-F.abs(F.col("spelled") - one)))).otherwise(F.col("spelled"))
    terms = rest.select("row", (F.col("tf") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / unit)).alias("base"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * mixed / float(np.log(10))).alias("score"))
    both = texts.unionByName(terms, allowMissingColumns=True).groupBy("row").agg(F.first("key", ignorenulls=True).alias("key"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return both.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")
