"""SentencePiece encoding and decoding in batched numpy.

A word (its leading blanks and what follows up to the next blank) is segmented as the model's own library does. The
scores of a merge model are the ranks of its merges: the neighbours whose union is the piece of highest score are
merged, the first of equals, until none is left. Words of equal length advance together, a merge of each in a step.

Other models: the pieces with the highest sum of scores, by Viterbi. Hashes of all substrings up to the longest piece
probe the sorted hashes of the pieces, and a vectorised maximum over the piece that ends at each character stores the
back pointer. Characters without a piece become byte pieces. Decoding joins the pieces and gives the text back.

No piece of the model spans a blank that follows another character, so words can be segmented on their own; that is
checked when the model is loaded. The longest piece wins ties.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillstack.llm.common import Memo, extended, parts, ranges

BLANK = "▁"
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Stands for a blank mark that is in the text: half a surrogate pair, which UTF-8 can't hold.
OWN_BLANK = "\udc00"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Score of one byte piece: below that of any piece, so bytes serve only characters that no piece has.
BYTE_SCORE = -1e9
#: Characters of words in one numpy step, and words remembered by a task.
STEP, KNOWN = 1 << 18, 600_000
#: Longer words are merged one by one from a heap, whose time grows with the length rather than its square.
LONG = 64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Pieces:
    """The pieces of a model file. ``encode`` and ``decode`` are exact inverses on any text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = np.full(256, -1, np.int64)
        chosen: dict[str, tuple[int, float]] = {}
        for i, p in enumerate(names):
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if BLANK in p.lstrip(BLANK):
                    raise ValueError("a piece spans a blank after another character")
                chosen[p] = (i, float(model.get_score(i)))
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte pieces")
        #: What each id decodes to; bytes above 127 as half surrogates, which Python's surrogateescape turns into bytes.
        self.text = [p.replace(BLANK, " ") for p in names]
        for i in range(len(names)):
            if model.is_control(i):
                self.text[i] = ""
        for b, i in enumerate(self.bytes.tolist()):
            self.text[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.spelled = pa.array([t.encode("utf-8", "surrogateescape") for t in self.text], pa.binary())
        self.longest = max(map(len, chosen))
        keys = np.array([self.hash_of(p) for p in chosen], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        #: For most substrings one look here shows that they are no piece.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.ids = np.array([i for i, _ in chosen.values()], np.int64)[order]
        self.scores = np.array([s for _, s in chosen.values()])[order]
        #: Every piece's characters, to verify a probe.
        self.chars = np.zeros((len(keys), self.longest), np.uint32)
        for row, p in zip(self.chars, np.array(list(chosen), object)[order]):
            row[: len(p)] = [ord(c) for c in p]

        self.place = {p: i for i, p in enumerate(np.array(list(chosen), object)[order].tolist())}
        spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto()).trainer_spec
        self.merges = spec.model_type == spec.BPE
        if self.merges:
            self.learn_pairs()

    def learn_pairs(self) -> None:
        """The two parts of each piece that are pieces too, as sorted keys, with the place of the union."""
        place, n = self.place, len(self.place)
        if any(c not in place for c in {c for p in place for c in p}):
            raise ValueError("a piece holds a character that is no piece")
        pairs = {place[p[:i]] * n + place[p[i:]]: at for p, at in place.items() for i in range(1, len(p)) if p[:i] in place and p[i:] in place}
        self.union = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_union = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        single = sorted((ord(p), at) for p, at in place.items() if len(p) == 1)
        self.codes, self.code_place = np.array([c for c, _ in single], np.int64), np.array([at for _, at in single], np.int64)

    def hash_of(self, piece: str) -> int:
        h = np.uint64(len(piece))
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * BASE + np.uint64(ord(c) + 1)
            return int(mixed(np.array([h], np.uint64))[0])

    def words(self, text: str) -> list[str]:
        """Each blank becomes the blank mark, one more is put in front, as the model's own library does. A blank mark in
        the text itself becomes a character that no text and no piece holds, and falls back to the mark's bytes."""
        return _WORD.findall(BLANK + text.replace(BLANK, OWN_BLANK).replace(" ", BLANK))

    def segment(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each of the words, which are best given without repeats."""
        out: list = [()] * len(words)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for size, rows in by.items():
            for at in range(0, len(rows), max(1, STEP // size)):
                part = rows[at : at + max(1, STEP // size)]
                for i, ids in zip(part, self.advance([words[i] for i in part], size)):
                    out[i] = ids
        return out

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of each word) by the model's merges."""
        sizes, made, odd = np.zeros(len(words), np.int64), [], {}
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            size = int(lengths[order[a]])
            for at in range(a, b, max(1, STEP // size)):
                part = order[at : min(b, at + max(1, STEP // size))]
                chosen = [words[i] for i in part.tolist()]
                if size > LONG:
                    odd.update(zip(part.tolist(), map(self.ids_of, self.merge_long(chosen, size))))
                    continue
                for rows, places in self.merge(chosen, size):
                    bare = (places < 0).any(1)
                    odd.update(zip(part[rows[bare]].tolist(), map(self.ids_of, places[bare].tolist())))
                    made.append((part[rows[~bare]], self.ids[places[~bare]]))
                    sizes[made[-1][0]] = places.shape[1]
        for i, ids in odd.items():
            sizes[i] = len(ids)
        begin = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        for rows, ids in made:
            flat[begin[rows][:, None] + np.arange(ids.shape[1])] = ids
        for i, ids in odd.items():
            flat[begin[i] : begin[i] + len(ids)] = ids
        return flat, sizes

    def ids_of(self, places: list[int]) -> tuple[int, ...]:
        """Ids of places in the table; a character c without a piece is the place -1 - c."""
        if min(places) >= 0:
            return tuple(self.ids[places].tolist())
        out: list[int] = []
        for p in places:
            c = "" if p >= 0 else chr(-1 - p)
            out.extend([int(self.ids[p])] if p >= 0 else self.bytes[list((BLANK if c == OWN_BLANK else c).encode())].tolist())
        return tuple(out)

    def characters(self, words: list[str], size: int) -> np.ndarray:
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.code_place[at], -1 - codes).reshape(-1, size)

    def unions(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the union of each pair, its score), score -inf where there is none."""
        key = left * len(self.place) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        some = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return self.pair_union[at], np.where(some, self.scores[self.pair_union[at]], -np.inf)

    def merge(self, words: list[str], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places of words of one length, as (words, their places) of each number of places: in each step the best pair of
        every word that has one."""
        out = []
        live, row = np.arange(len(words)), self.characters(words, size)
        union, score = self.unions(row[:, :-1], row[:, 1:])
        while len(live):
            n, m = row.shape
            best = score.argmax(1) if m > 1 else np.zeros(n, np.int64)
            more = score[np.arange(n), best] > -np.inf if m > 1 else np.zeros(n, bool)
            if not more.all():
                out.append((live[~more], row[~more]))
            live, row, union, score, best = live[more], row[more], union[more], score[more], best[more]
            if not len(live):
                break
            each = np.arange(len(live))
            row[each, best] = union[each, best]
            row = row[np.arange(m) != best[:, None] + 1].reshape(len(live), m - 1)
            keep = np.arange(m - 1) != best[:, None]
            union, score = union[keep].reshape(len(live), m - 2), score[keep].reshape(len(live), m - 2)
            for rows, at in ((each[best > 0], best[best > 0] - 1), (each[best < m - 2], best[best < m - 2])):
                union[rows, at], score[rows, at] = self.unions(row[rows, at], row[rows, at + 1])
        return out

    def merge_long(self, words: list[str], size: int) -> list[list[int]]:
        out, n = [], len(self.place)
        for word in self.characters(words, size).tolist():
            after, before = list(range(1, size + 1)), list(range(-1, size - 1))
            scores, union, heap = self.scores, self.union, []

            def push(a: int, b: int) -> None:
                if a >= 0 and b < size and word[a] >= 0 and word[b] >= 0 and (p := union.get(word[a] * n + word[b])) is not None:
                    heap.append((-scores[p], a, b, word[a], word[b], p)) if not ready else heappush(heap, (-scores[p], a, b, word[a], word[b], p))

            ready = False
            for i in range(size - 1):
                push(i, i + 1)
            heapify(heap)
            ready, gone = True, [False] * size
            while heap:
                _, a, b, x, y, p = heappop(heap)
                if gone[a] or gone[b] or word[a] != x or word[b] != y or after[a] != b:
                    continue
                word[a], gone[b], after[a] = p, True, after[b]
                if after[b] < size:
                    before[after[b]] = a
                push(before[a], a)
                push(a, after[a])
            out.append([p for p, g in zip(word, gone) if not g])
        return out

    def advance(self, words: list[str], size: int) -> list[tuple[int, ...]]:
        """Viterbi over words of one length."""
        n = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int32)
        longest = min(self.longest, size)
        #: found[l][i]: the piece of l + 1 characters that starts at i of each word, or -1.
        found = []
        h = np.zeros((n, size), np.uint64)
        with np.errstate(over="ignore"):
            power = np.uint64(1)
            for l in range(1, longest + 1):
                power = power * BASE
                h = h[:, : size - l + 1] * BASE + (codes[:, l - 1 :].astype(np.uint64) + np.uint64(1))
                key = mixed(h + np.uint64(l) * power)
                key = key.ravel()
                hit = np.flatnonzero(self.maybe[key >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
                equal = self.keys[at] == key[hit]
                hit, at = hit[equal], at[equal]
                row, col = hit // (size - l + 1), hit % (size - l + 1)
                same = (codes[row[:, None], col[:, None] + np.arange(l)] == self.chars[at][:, :l]).all(1)
                ids = np.full((size - l + 1, n), -1, np.int32)
                ids[col[same], row[same]] = at[same]
                found.append(ids)
        for end in range(1, size + 1):
            best[end], back[end] = best[end - 1] + BYTE_SCORE, end - 1
            for l in range(1, min(longest, end) + 1):
                p = found[l - 1][end - l]
                some = np.flatnonzero(p >= 0)
                s = best[end - l, some] + self.scores[p[some]]
                better = s >= best[end, some]
                some = some[better]
                best[end, some], back[end, some], piece[end, some] = s[better], end - l, p[some]
        #: Back pointers of all words are followed at once; each step yields one piece of each unfinished word.
        at, steps = np.full(n, size), []
        live = np.arange(n)
        while len(live):
            steps.append((live, piece[at[live], live], back[at[live], live]))
            at[live] = steps[-1][2]
            live = live[at[live] > 0]
        out: list[list[int]] = [[] for _ in words]
        for rows, ps, starts in reversed(steps):
            for r, p, s in zip(rows.tolist(), ps.tolist(), starts.tolist()):
                if p >= 0:
                    out[r].append(int(self.ids[p]))
                else:
                    c = words[r][s]
                    out[r].extend(self.bytes[list((BLANK if c == OWN_BLANK else c).encode())].tolist())
        return [tuple(x) for x in out]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids. Byte pieces that aren't UTF-8 become replacement characters; ids of control pieces add
        nothing."""
        text = "".join(map(self.text.__getitem__, ids))
        if not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:]


    def joined(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of runs of ids, the first from ``ends[0]`` to ``ends[1]``; ids of valid texts, as ``encode`` gives."""
        found = self.spelled.take(pa.array(ids))
        offsets = np.frombuffer(found.buffers()[1], np.int32, len(ids) + 1)[ends] if len(ids) else np.zeros(len(ends), np.int32)
        whole = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), found.buffers()[2]])
        return pa.compute.utf8_slice_codeunits(whole.cast(pa.string()), 1)


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Encodes texts; words that were seen before are remembered, as a row of ids with each word's place in it."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, Memo(KNOWN)
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.ids, self.place, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Words as UTF-8 without their first blank mark: further blanks, then a word, or blanks alone."""
        marked = [BLANK + w.decode().replace(BLANK, OWN_BLANK).replace(" ", BLANK) for w in words]
        if self.pieces.merges:
            ids, sizes = self.pieces.merged(marked)
        else:
            lists = self.pieces.segment(marked)
            sizes = np.array([len(x) for x in lists], np.int64)
            ids = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        n = len(self.known)
        self.known.learn(words, range(n, n + len(words)))
        self.place = np.concatenate((self.place, len(self.ids) + np.cumsum(sizes) - sizes))
        self.ids = np.concatenate((self.ids, ids))
        self.size = np.concatenate((self.size, sizes))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of each text). A blank in front of a word is its own; of several, the others
        are part of the word too, and blanks at the end of a text are a word."""
        if self.known.full:
            self.clear()
        filled = pa.compute.fill_null(texts, "")
        empty = pa.compute.equal(filled, "").to_numpy(zero_copy_only=False)
        lists = pa.compute.split_pattern(filled, " ")
        cut = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.binary()).to_pylist()
        text = np.repeat(np.arange(len(cut)), cut)
        keep = ~empty[text]
        blank = distinct.index(b"") if b"" in distinct else -1
        gaps = np.flatnonzero((index == blank) & keep)
        if len(gaps):
            # A run of gaps goes to the word behind it, in the same text, or is a word at the text's end.
            last = np.cumsum(cut) - 1
            head = gaps[np.concatenate(([True], (np.diff(gaps) > 1) | (np.diff(text[gaps]) > 0)))]
            run = np.diff(np.concatenate((np.searchsorted(gaps, head), [len(gaps)])))
            behind = head + run
            inside = behind <= last[text[head]]
            place = {w: i for i, w in enumerate(distinct)}
            keep[gaps] = False
            for at, n, go in zip(np.where(inside, behind, head).tolist(), run.tolist(), inside.tolist()):
                word = b" " * n + distinct[index[at]] if go else b" " * (n - 1)
                if word not in place:
                    place[word] = len(distinct)
                    distinct.append(word)
                index[at], keep[at] = place[word], True
        used = np.unique(index[keep])
        words = [distinct[i] for i in used.tolist()]
        if new := [w for w in words if w not in self.known]:
            self.learn(new)
        number = np.zeros(len(distinct), np.int64)
        number[used] = [self.known[w] for w in words]
        found = number[index[keep]]
        size = self.size[found]
        counts = np.bincount(text[keep], size, len(cut)).astype(np.int64)
        return self.ids[ranges(self.place[found], size)], counts


def encode(documents: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``documents`` with ``ids`` (array of int) appended, and with ``decoded`` the text that the ids give back.

    Null and empty texts have no ids and decode to ''; repeated rows are encoded alike; very long texts are read whole;
    an empty table gives an empty one. Former columns of the new names are replaced. One pass over whole texts, no
    shuffle. ``path`` is a model file that every executor can open."""
    documents = documents.drop(ids, *([decoded] if decoded else []))
    schema = extended(documents, ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = T.StructType([*schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        pieces = load(path)
        encoder = Encoder(pieces)
        for batch in parts(batches, text):
            flat, counts = encoder.flat(batch.column(batch.schema.get_field_index(text)))
            ends = np.concatenate(([0], np.cumsum(counts)))
            batch = batch.append_column(ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
            if decoded:
                batch = batch.append_column(decoded, pieces.joined(flat, ends))
            yield batch

    return documents.mapInArrow(run, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``frame`` with the text of its ``ids``; null ids give null. A former column ``text`` is replaced; repeated rows
    decode alike; an empty table gives an empty one."""
    frame = frame.drop(text)

    def run(batches):
        pieces = load(path)
        for batch in batches:
            yield batch.append_column(text, pa.array([None if x is None else pieces.decode(x) for x in batch.column(ids).to_pylist()], pa.string()))

    return frame.mapInArrow(run, extended(frame, text, T.StringType()))
