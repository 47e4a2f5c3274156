"""Recorded answers in place of the network and of tools: requests meet them by key, and what wasn't recorded is a miss."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.sources.config import fnv1a

REQUEST = ("provider", "url", "accept")


@F.pandas_udf(T.StringType())
def _cache_name(provider: pd.Series, url: pd.Series, accept: pd.Series) -> pd.Series:
    return pd.Series([None if None in r else f"{r[0]}-{fnv1a('|'.join(r).encode()):016x}.txt" for r in zip(provider, url, accept)], dtype=object)


def cache_name(provider: Column, url: Column, accept: Column) -> Column:
    """The file name under which a cache keeps an answer. What is accepted is part of the key: one address serves several
    formats. Null if a part is."""
    return _cache_name(provider, url, accept)


def outcome(status: Column) -> Column:
    """What a status says: ok, notFound, rateLimited or ``status N``; null, as nothing is recorded: cacheMiss."""
    return F.when(status.isNull(), "cacheMiss").when(status.between(200, 299), "ok").when(status.isin(404, 410), "notFound").when(status == 429, "rateLimited").otherwise(F.concat(F.lit("status "), status.cast("string")))


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests (provider, url, accept, ...) with ``outcome`` and ``body``, the body only of those that went well.

    ``responses``: (provider, url, accept, body, status, stored); of several answers to a request the one stored last
    counts, of those the one with the lower status, so every request keeps its one row. Parts that are null are a miss."""
    last = responses.groupBy(*REQUEST).agg(F.max_by(F.struct("status", "body"), F.struct("stored", -F.col("status"))).alias("_a"))
    met = requests.join(last, list(REQUEST), "left")
    return met.select(*requests.columns, outcome(F.col("_a.status")).alias("outcome"), F.when(F.col("_a.status").between(200, 299), F.col("_a.body")).alias("body"))


def paced(calls: DataFrame, gap: Column) -> DataFrame:
    """Calls (peer, ready, ord, ...) with ``start``: the first of a peer at once, each other not before ``gap`` (a
    column, one value a peer, in the unit of ``ready``) after the start of the one before. Calls of one peer follow each
    other by ready, then ord.

    start(i) = max(ready(i), start(i - 1) + gap) is i * gap + the running maximum of ready(j) - j * gap: a window, no
    loop. A peer is one sequence by nature."""
    one = "PARTITION BY peer ORDER BY ready, ord"
    placed = calls.withColumn("_gap", gap).withColumn("_i", F.expr(f"row_number() OVER ({one})"))
    slack = placed.withColumn("_s", F.expr("ready - _i * _gap"))
    start = F.expr(f"_i * _gap + max(_s) OVER ({one} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return slack.withColumn("start", start).select(*calls.columns, "start")


def op_key(kind: str, first: int | None = None, last: int | None = None, layout: bool = False) -> str:
    """The key of a tool's run: info, info-custom, xmp, urls-LAST, text-FIRST-LAST with -layout or not, bbox-PAGE,
    ocr-FIRST-LAST."""
    if kind in ("info", "info-custom", "xmp"):
        return kind
    if kind == "urls":
        return f"urls-{last}"
    if kind == "bbox":
        return f"bbox-{first}"
    if kind in ("text", "ocr"):
        return f"{kind}-{first}-{last}" + ("-layout" if layout and kind == "text" else "")
    raise ValueError(f"no tool does `{kind}`")


def tool_answers(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """Requests (pdf, op_key, ...) with ``text`` and ``error`` of the recorded runs (pdf, op_key, text, error; one a
    key). A run that isn't recorded is a missing tier: an error of its row, not a stop."""
    runs = recorded.select("pdf", "op_key", F.struct("text", "error").alias("_r"))
    met = requests.join(runs, ["pdf", "op_key"], "left")
    error = F.when(F.col("_r").isNull(), F.concat(F.lit("nothing recorded for "), "op_key")).otherwise(F.col("_r.error"))
    return met.select(*requests.columns, F.when(F.col("_r.error").isNull(), F.col("_r.text")).alias("text"), error.alias("error"))
