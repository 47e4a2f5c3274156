"""Labels: what may stand after an @ in a text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def problem_of(label: str | None) -> str | None:
    """empty, invalid-char:PLACE:CHARACTER, trailing:CHARACTER, or None for a valid label."""
    if not label:
        return "empty"
    for i, c in enumerate(label):
        if c not in "_-:." and not ("a" + c).isidentifier():
            return f"invalid-char:{len(label[:i].encode())}:{c}"
    return f"trailing:{label[-1]}" if label[-1] in ".:" else None


@F.pandas_udf(T.StringType())
def _problem(c: pd.Series) -> pd.Series:
    return pd.Series([problem_of(x) for x in c], dtype=object)


def problem(c: Column) -> Column:
    return _problem(c)


def folder(rendered: str) -> list[str]:
    """The parts of a rendered folder template. Raises ValueError for parts that leave the library and for none."""
    parts = [p for p in rendered.split("/") if p]
    if not parts or any(p in (".", "..") for p in parts):
        raise ValueError(f"not a folder inside the library: {rendered!r}")
    return parts
