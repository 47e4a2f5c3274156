"""Jaro-Winkler similarity. Spark has no such function, so it is an Arrow UDF: distinct pairs of a batch as padded rows of
code points, all pairs of a kind advanced together, one character a step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points held at once by one block of pairs; a longer pair is a block of its own.
CELLS = 1 << 20


def _padded(texts: list[str], sizes: np.ndarray, filler: int) -> np.ndarray:
    """A row of code points a text; places behind its end hold ``filler``, which is no code point."""
    out = np.full((len(texts), int(sizes.max(initial=0))), filler, np.int32)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = codes
    return out


def _block(a: list[str], b: list[str], la: np.ndarray, lb: np.ndarray, reach: int) -> np.ndarray:
    """Jaro-Winkler of pairs of texts that aren't empty and have one ``reach``.

    Each character of ``a`` in turn takes the first equal one of ``b`` within reach that no earlier one took."""
    left, right = _padded(a, la, -1), _padded(b, lb, -2)
    free, mine = right.copy(), np.zeros(left.shape, bool)
    for i in range(left.shape[1]):
        low = max(0, i - reach)
        window = free[:, low : i + reach + 1]
        if not window.shape[1]:
            break
        equal = window == left[:, i : i + 1]
        hit = np.flatnonzero(equal.any(axis=1))
        free[hit, low + equal[hit].argmax(axis=1)] = -3
        mine[hit, i] = True
    m = mine.sum(axis=1)
    moved = np.bincount(np.repeat(np.arange(len(m)), m), left[mine] != right[free == -3], len(m)) // 2
    share = np.maximum(m, 1)
    score = np.where(m > 0, (m / la + m / lb + (m - moved) / share) / 3, 0.0)
    width = min(4, left.shape[1], right.shape[1])
    prefix = np.cumprod(left[:, :width] == right[:, :width], axis=1).sum(axis=1)
    return np.where(score > 0.7, np.minimum(score + 0.1 * prefix * (1 - score), 1.0), score)


def winkler_of(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro of each pair, raised by 0.1 for each of up to four equal first characters where it is above 0.7. Equal texts
    (two empty ones too) give 1, an empty one beside another 0."""
    out = np.fromiter((x == y for x, y in zip(a, b)), float, len(a))
    la, lb = (np.fromiter(map(len, s), np.int64, len(s)) for s in (a, b))
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    todo = np.flatnonzero((out == 0) & (la > 0) & (lb > 0))
    todo = todo[np.argsort(reach[todo], kind="stable")]
    for same in np.split(todo, np.flatnonzero(np.diff(reach[todo])) + 1):
        if len(same):
            rows = max(1, CELLS // int(la[same].max() + lb[same].max()))
            for at in range(0, len(same), rows):
                p = same[at : at + rows]
                out[p] = _block([a[i] for i in p], [b[i] for i in p], la[p], lb[p], int(reach[p[0]]))
    return out


def winkler(a: str, b: str) -> float:
    return float(winkler_of([a], [b])[0])


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Null if one of the texts is."""
    pairs = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()})
    distinct = pairs.dropna().drop_duplicates()
    distinct["score"] = winkler_of(distinct.a.tolist(), distinct.b.tolist())
    return pairs.merge(distinct, "left", ["a", "b"]).score.astype("float64")
