"""Secrets in texts: patterns, and character Markov models of random strings and of ordinary identifiers.

Base spans come from three patterns. Beside them every run of 16 or more key characters (with a letter in it, clear of
base spans) is scored by the log-likelihood ratio of two bigram models of characters and is a span above a threshold.

The models learn from labelled samples. Ordinary: runs of key characters in some thousand documents that no base span
touches. Random: the values that the base patterns found there, and for each ordinary run a string of the same length
cut from the SHA-512 of the run in one of the forms that keys are written in (hexadecimal, base64, either in one case).

All is built-in functions. Matches are placed by the texts between them (``split`` and ``regexp_extract_all`` find the
same matches), so a text is a few passes of whole-stage code; the ratio of the models is a constant array in the plan,
whose size is that of the alphabet squared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import free_names

#: The base patterns, the length below which a match is dropped, and what has that length (a group).
#: A run of 32 or 16 characters is found as such: shorter runs of these two kinds would be dropped whole.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
ASSIGN_LEAST = 8
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
RUN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
LEAST, SAMPLED_LEAST = 16, 6
#: Documents that the models learn from, in the mean, and the weight of an unseen pair of characters.
SAMPLE, SMOOTHING = 2048, 0.5
#: Log-likelihood ratio (natural) from which a run is a secret: one run in a million is taken to be one.
THRESHOLD = math.log(1e6)
#: Characters of a run that are looked at together, which bounds the arrays of very long runs.
PIECE = 1024
#: Matches whose spans are gathered in one array before they join the others.
BLOCK = 256

_SPAN = "struct<start:int,rank:int,end:int>"


def _placed(text: Column, pattern: str, rank: int, wanted=None, group: int = 0) -> Column:
    """Spans (start, rank, end) in code points of the pattern's matches, of those whose ``group`` is ``wanted``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    if group:
        found = F.arrays_zip(found.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
        parts = F.zip_with(between, found, lambda gap, x: F.struct(gap.alias("gap"), F.length(x["m"]).alias("long"), wanted(x["v"]).alias("good")))
    else:
        parts = F.zip_with(between, found, lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("long"), (wanted(m) if wanted else m.isNotNull()).alias("good")))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc, p):
        begin = acc["at"] + p["gap"]
        end = begin + F.coalesce(p["long"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["long"].isNotNull() & p["good"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def block(acc, b):
        """Arrays are grown block by block, since each growth copies what there is."""
        inner = F.aggregate(b, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], inner["out"]).alias("out"))

    def blocks(parts):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda i: F.slice(parts, i * BLOCK + 1, F.lit(BLOCK)))

    whole = F.get(F.transform(F.array(parts), blocks), F.lit(0))
    return F.when(text.rlike(pattern), F.aggregate(whole, F.struct(F.lit(0).alias("at"), none.alias("out")), block)["out"]).otherwise(none)


def base_spans(text: Column) -> Column:
    """Base spans of a text that isn't null, by start, then by kind."""
    return F.array_sort(F.concat(
        _placed(text, ASSIGN, 0, lambda v: F.length(v) >= ASSIGN_LEAST, group=2),
        _placed(text, PATTERNS["access"], 1),
        _placed(text, PATTERNS["hex"], 2),
    ))


def samples(texts: DataFrame, documents: int = SAMPLE) -> DataFrame:
    """(token, random): labelled strings from about so many of the rows of ``texts`` (text), by a hash of the text and of
    its row's other columns; from all where there are fewer."""
    total = texts.count()
    share = min(1.0, documents / total) if total else 1.0
    chosen = texts.where(F.pmod(F.xxhash64(*texts.columns), F.lit(1 << 30)) < int(share * (1 << 30)))
    text = F.coalesce("text", F.lit(""))
    rest = text
    for pattern in PATTERNS.values():
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = F.filter(F.regexp_extract_all(rest, F.lit(RUN % SAMPLED_LEAST), F.lit(0)), lambda x: x.rlike("[A-Za-z]"))
    key = F.sha2("token", 512)
    coded = F.regexp_replace(F.base64(F.unhex(key)), "\\s", "")
    form = F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(5))
    drawn = F.when(form == 0, key).when(form == 1, F.upper(key)).when(form == 2, F.lower(coded)).when(form == 3, F.upper(coded)).otherwise(coded)
    plain = chosen.select(F.explode(ordinary).alias("token"))
    both = F.array(F.struct(F.col("token"), F.lit(False).alias("random")), F.struct(F.substring(drawn, F.lit(1), F.length("token")).alias("token"), F.lit(True).alias("random")))
    values = F.concat(F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= LEAST), *(F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)) for k in ("access", "hex")))
    found = chosen.select(F.explode(values).alias("token"), F.lit(True).alias("random"))
    return plain.select(F.explode(both).alias("s")).select("s.token", "s.random").unionAll(found)


def _pieces(token: Column) -> Column:
    """A token's characters in pieces; each but the last goes one character into the next, so no pair is lost."""
    return F.transform(F.regexp_extract_all(token, F.lit(f"(?s)(?=(.{{1,{PIECE + 1}}})).{{1,{PIECE}}}"), F.lit(1)), lambda p: F.transform(F.filter(F.split(p, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1))


def fit(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of every pair of characters of the alphabet, random over ordinary, from (token, random).
    Null tokens and characters outside the alphabet count for nothing; of an empty table all ratios are 0."""
    k = len(ALPHABET)
    pairs = labelled.where("token IS NOT NULL").select("random", F.explode(_pieces(F.col("token"))).alias("p"))
    pairs = pairs.select("random", F.explode(F.zip_with(F.expr("slice(p, 1, greatest(size(p) - 1, 0))"), F.expr("slice(p, 2, greatest(size(p) - 1, 0))"), lambda a, b: F.when((a >= 0) & (b >= 0), a * k + b))).alias("pair"))
    counted = {(r.random, r.pair): r.n for r in pairs.where("pair IS NOT NULL").groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}
    ratios = [0.0] * (k * k)
    for a in range(k):
        totals = [sum(counted.get((kind, a * k + b), 0) for b in range(k)) for kind in (True, False)]
        for b in range(k):
            chance = [(counted.get((kind, a * k + b), 0) + SMOOTHING) / (totals[i] + SMOOTHING * k) for i, kind in enumerate((True, False))]
            ratios[a * k + b] = round(math.log(chance[0] / chance[1]), 4)
    return ratios


def ratio(token: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a token; pairs with characters outside the alphabet count 0."""
    table, k = F.expr(f"from_json('[{','.join(map(repr, model))}]', 'array<double>')"), len(ALPHABET)

    def piece(total, p):
        pair = lambda i: F.get(p, i - 1) * k + F.get(p, i)
        inside = lambda i: (F.get(p, i - 1) >= 0) & (F.get(p, i) >= 0)
        steps = F.when(F.size(p) > 1, F.sequence(F.lit(1), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, total, lambda acc, i: acc + F.when(inside(i), F.coalesce(F.get(table, pair(i)), F.lit(0.0))).otherwise(F.lit(0.0)))

    return F.aggregate(_pieces(token), F.lit(0.0), piece)


def scan(df: DataFrame, model: list[float], text: str = "text", spans: str = "spans", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with the array ``spans`` of structs (start, rank, end): code points, end exclusive, ``rank`` the place of the
    kind in ``KINDS``; by start, then by rank. Spans of the last kind are runs above the threshold that meet no base span.

    Null and empty texts have none. Repeated rows are judged alike; a column with the name of the new one is replaced,
    others stay. Rows are mapped one by one, so no key matters; of a very long text the arrays grow with its matches.
    """
    held = F.coalesce(F.col(text), F.lit(""))
    base, more = free_names([*df.columns, spans], "base", "more")
    found = df.withColumns({base: base_spans(held), more: _placed(held, RUN % LEAST, 3, lambda m: m.rlike("[A-Za-z]") & (ratio(m, model) > F.lit(float(threshold))))})
    clear = F.filter(more, lambda x: ~F.exists(base, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    return found.withColumn(spans, F.when(F.size(more) > 0, F.array_sort(F.concat(F.col(base), clear))).otherwise(F.col(base))).drop(base, more)


def of_kind(spans: Column, kind: str) -> Column:
    """The spans of a kind."""
    rank = KINDS.index(kind)
    return F.filter(spans, lambda s: s["rank"] == rank)


def written(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
