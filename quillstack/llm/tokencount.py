"""Token counts by a tokenizer compiled to finite-state transducers.

Two deterministic transducers annotate their transitions with what they emit.

The splitter reads character classes (with a look at what follows, which makes the pattern deterministic) and emits 1
where a part of the text (a pre-token) starts. A text is cut into chunks; every chunk's map from start state to end
state and emitted count is found for all states at once, the maps compose by a parallel prefix scan, and each chunk is
then read again from the state that the scan gives it. So the longest text takes as many steps as the shortest.

The merger reads the bytes of a pre-token and emits, with each byte, by how much the number of tokens changes. After a
prefix its state holds, for each start of a token that may still end later, where that token is in the vocabulary's
trie, the last token before it and the count there. Of the tokens that end at a byte exactly one is such that it and
the last token before it are what byte-pair merging makes of both together; that one is the prefix's last token. States
are compiled when they are first met and kept in a bounded table; distinct pre-tokens advance together.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillstack.llm.common import Memo, extended, slices

CHUNK = 128
#: States of the merger and pre-tokens' counts that a worker keeps at most.
STATES, KNOWN = 600_000, 400_000

#: White space as the pattern's \\s has it.
SPACES = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

#: Symbols of the splitter. BLANK and OTHER_SPACE are white space before a character that isn't; SPACE is any other.
LETTER, NUMBER, REST, BLANK, OTHER_SPACE, SPACE, SHORT, LONG, RESET = range(9)
#: Its states: in letters, in numbers, in other characters, after a blank that joins what follows, in white space, one
#: or two characters before the end of a contraction, and where whatever follows starts a part.
IN_LETTERS, IN_NUMBERS, IN_REST, AFTER_BLANK, IN_SPACE, ONE_LEFT, TWO_LEFT, FREE = range(8)


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted) by state * 9 + symbol, for the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    step, emit = np.full((8, 9), FREE, np.uint8), np.ones((8, 9), np.uint8)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, REST: IN_REST, SHORT: IN_REST, LONG: IN_REST}
    for state in range(8):
        for symbol, run in runs.items():
            step[state, symbol] = run
            if state in (run, AFTER_BLANK):
                emit[state, symbol] = 0
            elif symbol == SHORT:
                step[state, symbol] = ONE_LEFT
            elif symbol == LONG:
                step[state, symbol] = TWO_LEFT
        step[state, BLANK] = AFTER_BLANK
        step[state, OTHER_SPACE] = FREE
        step[state, SPACE] = IN_SPACE
        emit[state, SPACE] = state != IN_SPACE
    for state, after in ((TWO_LEFT, ONE_LEFT), (ONE_LEFT, FREE)):
        step[state, :RESET], emit[state, :RESET] = after, 0
    emit[:, RESET] = 0
    return step.ravel(), emit.ravel()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point: LETTER, NUMBER, REST or SPACE."""
    out = np.full(0x110000, REST, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = NUMBER
    out[SPACES] = SPACE
    return out


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbol of each character; ``ends``: places of the separators after each segment, whose symbol is RESET."""
    sym = classes()[codes]
    sym[ends] = RESET
    after = np.append(sym[1:], RESET)
    filled = (sym == SPACE) & (after != SPACE) & (after != RESET)
    sym[filled] = np.where(codes[filled] == 32, BLANK, OTHER_SPACE)
    quote = np.flatnonzero((codes == 39) & (sym == REST))
    if len(quote):
        padded = np.concatenate((np.where(sym == RESET, 0, codes), [0, 0]))
        a, b = padded[quote + 1], padded[quote + 2]
        short = np.isin(a, [115, 116, 109, 100])
        long = ((b == 101) & ((a == 114) | (a == 118))) | ((a == 108) & (b == 108))
        sym[quote[short]] = SHORT
        sym[quote[long]] = LONG
    return sym


def starts(sym: np.ndarray) -> np.ndarray:
    """Places where the splitter emits, by chunk maps and a prefix scan over them."""
    step, emit = splitter()
    rows = -(-len(sym) // CHUNK)
    cut = np.full(rows * CHUNK, RESET, np.uint8)
    cut[: len(sym)] = sym
    columns = np.ascontiguousarray(cut.reshape(rows, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    counts = np.zeros((rows, 8), np.int64)
    for k in range(CHUNK):
        at = maps * np.uint8(9) + columns[k][:, None]
        counts += emit[at]
        maps = step[at]
    reach = 1
    while reach < rows:  # after each turn a row's map and count span twice as many chunks before it
        before = maps[:-reach].astype(np.intp)
        joined = np.take_along_axis(maps[reach:], before, 1)
        counts[reach:] = counts[:-reach] + np.take_along_axis(counts[reach:], before, 1)
        maps = np.concatenate((maps[:reach], joined))
        reach *= 2
    state = np.concatenate(([FREE], maps[:-1, FREE])).astype(np.uint8)
    flags = np.empty((CHUNK, rows), np.uint8)
    for k in range(CHUNK):
        at = state * np.uint8(9) + columns[k]
        flags[k] = emit[at]
        state = step[at]
    found = np.flatnonzero(flags.T.ravel()[: len(sym)])
    assert not rows or len(found) == counts[-1, FREE]
    return found


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """The byte-pair merging transducer of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, letters = whole["model"], byte_letters()
        pre = whole["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or whole["normalizer"] or not all(len(s["content"]) for s in whole["added_tokens"]):
            raise ValueError("not a byte-level BPE vocabulary of the kind that is known here")
        #: Special strings, the longest first, so that the leftmost and there the longest one is taken.
        special = sorted((s["content"].encode() for s in whole["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        ids = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if all(c in letters for c in w)}
        self.bytes_of = {i: b for b, i in ids.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in w) for w in (pair if isinstance(pair, list) else pair.split(" ")))
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        #: The trie: (node << 8 | byte) to node; token of each node or -1; whether a node has children.
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [False]
        for word, i in ids.items():
            node = 0
            for b in word:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.inner[node] = True
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = i
        self.fits: dict[int, bool] = {}
        self.known = Memo(KNOWN)
        self.reset()

    def merge(self, parts: list[int]) -> list[int]:
        """What byte-pair merging makes of bytes: the lowest rank first, the leftmost of equals."""
        parts = list(parts)
        while len(parts) > 1:
            (_, new), at = min((self.merges.get(p, (1 << 60, -1)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if new < 0:
                break
            parts[at : at + 2] = [new]
        return parts

    def pair(self, a: int, b: int) -> bool:
        """Whether merging the bytes of token ``a`` (-1: none) and of token ``b`` gives just these."""
        key = (a + 1) << 32 | b
        if key not in self.fits:
            if len(self.fits) > 500_000:
                self.fits.clear()
            both = (self.bytes_of[a] if a >= 0 else b"") + self.bytes_of[b]
            self.fits[key] = self.merge([self.single[x] for x in both]) == ([a, b] if a >= 0 else [b])
        return self.fits[key]

    def reset(self) -> None:
        """Forget all compiled states but the first: nothing read, one start in the trie's root without a token before."""
        self.size = 1 << 22
        self.keys = np.full(self.size, -1, np.int64)
        self.next, self.delta = np.zeros(self.size, np.int32), np.zeros(self.size, np.int16)
        first = array("i", (0, -1, 0)).tobytes()
        self.states, self.number, self.edges = [first], {first: 0}, 0

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the count). A state is a row of (trie node, last token before, count there less the
        count now)."""
        flat = array("i", self.states[state])
        going, token, count = [], -1, 0
        for k in range(0, len(flat), 3):
            node = self.child.get(flat[k] << 8 | byte)
            if node is None:
                continue
            t, last = self.token[node], flat[k + 1]
            if token < 0 <= t and self.pair(-1, t) and (last < 0 or self.pair(last, t)):
                token, count = t, flat[k + 2] + 1
            if self.inner[node]:
                going.append((node, last, flat[k + 2]))
        assert token >= 0, "no token ends here"
        out = array("i")
        for node, last, c in going:
            out.extend((node, last, c - count))
        out.extend((0, token, 0))
        key = out.tobytes()
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        return number, count

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the table, or the free one where it belongs."""
        mask = np.int64(self.size - 1)
        at = ((keys * np.int64(-7046029254386353131)) >> np.int64(32)) & mask
        live = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(live):
            at[live] = (at[live] + 1) & mask
            live = live[(self.keys[at[live]] != keys[live]) & (self.keys[at[live]] >= 0)]
        return at

    def grow(self) -> None:
        """Twice the table, for one call that needs more states than it holds; the next call starts afresh."""
        used = np.flatnonzero(self.keys >= 0)
        keys, after, delta = self.keys[used], self.next[used], self.delta[used]
        self.size *= 2
        self.keys = np.full(self.size, -1, np.int64)
        self.next, self.delta = np.zeros(self.size, np.int32), np.zeros(self.size, np.int16)
        self.put(keys, np.stack((after, delta), 1))

    def put(self, keys: np.ndarray, got: np.ndarray) -> None:
        """Distinct keys into the table, with (next state, change) each."""
        while len(keys):
            at, one = np.unique(self.slot(keys), return_index=True)
            self.keys[at], self.next[at], self.delta[at] = keys[one], got[one, 0], got[one, 1]
            keys, got = np.delete(keys, one), np.delete(got, one, 0)

    def add(self, keys: np.ndarray) -> None:
        """Compile the transitions of distinct keys and put them into the table."""
        got = np.array([self.compile(k >> 8, k & 255) for k in keys.tolist()])
        self.edges += len(keys)
        self.put(keys, got)

    def counts(self, words: list[bytes]) -> list[int]:
        """Number of tokens of each of the pre-tokens."""
        if len(self.states) > STATES or self.edges > self.size // 2:
            self.reset()
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        text = np.frombuffer(b"".join(words), np.uint8)
        first = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -k, side="left"))  # those longer than k
            keys = state[:n] << 8 | text[first[:n] + k]
            at = self.slot(keys)
            missing = np.flatnonzero(self.keys[at] < 0)
            if len(missing):
                while self.edges + len(missing) > self.size * 3 // 4:
                    self.grow()
                    at = self.slot(keys)
                self.add(np.unique(keys[missing]))
                at[missing] = self.slot(keys[missing])
            state[:n] = self.next[at]
            total[:n] += self.delta[at]
        out = np.empty(len(words), np.int64)
        out[order] = total
        return out.tolist()

    def of(self, texts: list[bytes]) -> np.ndarray:
        """Number of tokens of each text. A special string counts as one token and parts what is around it."""
        segments, owner = [], []
        out = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = self.special.split(t) if self.special else [t]
            out[i] = len(parts) - 1
            segments += parts
            owner += [i] * len(parts)
        joined = b"\n".join(segments) + b"\n"
        codes = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32)
        width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        offset = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))
        last = np.cumsum([len(s) + 1 for s in segments]) - 1  # separators, in bytes
        ends = np.searchsorted(offset, last)
        begin = starts(symbols(codes, ends))
        # A part ends where the next one starts, or at its segment's separator.
        stop = np.minimum(np.append(begin[1:], len(codes)), ends[np.searchsorted(ends, begin)]) if len(begin) else begin
        words = [joined[a:b] for a, b in zip(offset[begin].tolist(), offset[stop].tolist())]
        if self.known.full:
            self.known.clear()
        new = list({w for w in words if w not in self.known})
        self.known.learn(new, self.counts(new))
        got = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        return out + np.bincount(np.array(owner)[np.searchsorted(ends, begin)] if len(begin) else [], got, len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Merger:
    return Merger(path)


def count(documents: DataFrame, path: str, text: str = "text", n_tokens: str = "n_tokens") -> DataFrame:
    """``documents`` with the number of tokens (long) of each whole text, without begin, end or padding tokens.

    Null and empty texts have none; repeated rows count alike; very long texts are read whole; a former column of the
    name is replaced; an empty table gives an empty one. One pass, no shuffle. ``path`` is a vocabulary file that every
    executor can open."""
    documents = documents.drop(n_tokens)

    def run(batches):
        merger = load(path)
        for batch, texts in slices(batches, text):
            yield batch.append_column(n_tokens, pa.array(merger.of(texts)))

    return documents.mapInArrow(run, extended(documents, n_tokens, T.LongType()))
