"""URL filters: host and path rules, and a path-template tree for the urls that no rule fits.

Template tree, host by host and from the top: digits in a path's segments become ``*``. Below one template, where more
than ``FANOUT`` different segments stand, the segment is variable and becomes ``*``; where fewer stand, branches whose
share of blocked labels doesn't differ from their siblings' at ``Z`` (two proportions, corrected for continuity) are
merged into one ``*``. A segment whose share
does differ keeps its name, and so does one without labels where few stand. The next level is judged below the
generalised templates, so the children of a ``*`` are pooled.

A template is rejected if its share of blocked labels, smoothed, is above one half. It is smoothed towards what other
hosts show for its paths: the share of paths with the same first segment on all hosts, then of the same shape (the path
with digits starred) on all hosts, then on the hosts of its last label, last two and last three labels, each smoothed
towards the one before. So a host without a single label is judged by its likes. Labels are the verdicts of the rules,
or a label column of the caller's.

The tree is ``DEPTH`` levels deep: what follows in a path is one last segment.

Only built-in functions; distinct (host, path) pairs are counted before anything is joined, so a host that holds a
large part of the pages is as many rows as it has paths, and no window spans a host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import discard, materialize

#: (verdict, host, start of the path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DEPTH, FANOUT, Z, WEIGHT = 8, 16, 1.96, 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: from the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case. Path: then up to ``? #`` or the end. A
    url that is null or has no ``://`` has both empty."""
    rest = f"substring({url}, instr({url}, '://') + 3)"
    host = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    path = f"regexp_extract(substring({rest}, length({host}) + 1), '^[^?#]*', 0)"
    there = f"coalesce(instr({url}, '://') > 0, false)"
    return F.expr(f"CASE WHEN {there} THEN translate({host}, '{UPPER}', '{LOWER}') ELSE '' END"), F.expr(f"CASE WHEN {there} THEN {path} ELSE '' END")


def longest_rule(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns ``host`` and ``path``, else null."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def segments(path: str) -> str:
    """SQL of a path's segments, digits starred, those from the DEPTH-th on as one."""
    found = f"filter(split(regexp_replace({path}, '[0-9]+', '*'), '/'), x -> x != '')"
    return f"transform({found}, (x, i) -> CASE WHEN i < {DEPTH - 1} THEN x WHEN i = {DEPTH - 1} THEN array_join(slice({found}, {DEPTH}, size({found})), '/') END)"


def grow(shapes: DataFrame, depth: int, fanout: int, z: float) -> DataFrame:
    """The shapes (host, segments, n, bad, pages) with their templates, level by level."""
    state = shapes.withColumn("template", F.expr("cast(array() AS array<string>)"))
    spread = "((bb / bn) * (1 - bb / bn) * (1D / n + 1D / (bn - n)))"
    alike = f"CASE WHEN bn = n OR bb = 0 OR bb = bn THEN true ELSE abs(bad / n - (bb - bad) / (bn - n)) - 0.5D * (1D / n + 1D / (bn - n)) < {z}D * sqrt({spread}) END"
    for d in range(1, depth + 1):
        state = state.withColumn("seg", F.expr(f"get(segments, {d - 1})"))
        kids = materialize(state.where("seg IS NOT NULL").groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
        sums = kids.groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("n").alias("bn"), F.sum("bad").alias("bb"))
        named = kids.join(sums, ["host", "template"])
        named = named.selectExpr("host", "template", "seg", f"CASE WHEN n > 0 AND NOT {alike} THEN seg WHEN k > {fanout} OR (n > 0 AND k > 1) THEN '*' ELSE seg END AS name")
        after = state.join(named, ["host", "template", "seg"], "left").withColumn("template", F.expr("CASE WHEN name IS NULL THEN template ELSE concat(template, array(name)) END"))
        after = materialize(after.select(*shapes.columns, "template"))
        discard(state, kids)
        state = after
    return state


def priors(shapes: DataFrame, share: float, weight: float) -> DataFrame:
    """(host, segments, prior): what all hosts show for a shape, from the most general to the nearest."""
    form = "array_join(segments, '/')"
    last = lambda n: f"struct({n + 1} AS level, array_join(slice(l, -{n}, {n}), '.') AS suffix, {form} AS form)"
    keys = f"array(struct(0 AS level, '' AS suffix, concat(coalesce(get(segments, 0), ''), '/...') AS form), struct(1 AS level, '' AS suffix, {form} AS form), {last(1)}, {last(2)}, {last(3)})"
    rows = shapes.withColumn("l", F.expr("split(host, '[.]')")).selectExpr("host", "segments", "n", "bad", f"explode(filter({keys}, k -> k.level < 2 OR size(l) >= k.level)) AS k").selectExpr("host", "segments", "n", "bad", "k.*")
    seen = rows.where("n > 0").groupBy("level", "suffix", "form").agg(F.sum("n").alias("sn"), F.sum("bad").alias("sb"))
    met = rows.join(seen, ["level", "suffix", "form"], "left")
    found = met.groupBy("host", "segments").agg(F.array_sort(F.collect_list(F.when(F.col("sn") > 0, F.struct("level", "sn", "sb")))).alias("steps"))
    return found.selectExpr("host", "segments", f"aggregate(steps, {share!r}D, (p, s) -> (s.sb + {weight}D * p) / (s.sn + {weight}D)) AS prior")


def rejected(paths: DataFrame, fanout: int = FANOUT, z: float = Z, weight: float = WEIGHT) -> DataFrame:
    """(host, path) of rejected templates, from distinct (host, path, n, bad, pages): labels, blocked ones among them, and
    rows."""
    paths = materialize(paths.withColumn("segments", F.expr(segments("path"))).withColumn("segments", F.expr("filter(segments, x -> x IS NOT NULL)")))
    shapes = materialize(paths.groupBy("host", "segments").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("pages").alias("pages")))
    n, bad, depth = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.max(F.size("segments")), F.lit(0))).first()
    placed = grow(shapes, depth, fanout, z).join(priors(shapes, (bad + 1) / (n + 2), weight), ["host", "segments"])
    placed = materialize(placed)
    sums = placed.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), (F.sum(F.col("prior") * F.col("pages")) / F.sum("pages")).alias("prior"))
    gone = sums.where(f"(bad + {weight}D * prior) / (n + {weight}D) > 0.5D + 1e-9D").select("host", "template")
    return paths.join(placed.join(gone, ["host", "template"], "left_semi").select("host", "segments"), ["host", "segments"], "left_semi").select("host", "path")


def judge(pages: DataFrame, url: str = "url", key: str = "page_id", rules=RULES, blocked: Column | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) of every row. ``blocked``: a condition that labels a row (true: to block, null: no
    label), in place of the rules' verdicts.

    Null urls and urls without ``://`` have an empty host and path and are judged like any other; equal urls get equal
    verdicts; null keys and repeated rows keep their rows; very long urls are read whole; an empty table gives an empty
    one. Other columns aren't read unless ``blocked`` reads them."""
    host, path = host_and_path(url)
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), (F.lit(None).cast("boolean") if blocked is None else blocked).alias("_blocked"))
    rule, verdict = longest_rule(rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    label = F.col("ruled") == "block" if blocked is None else F.col("_blocked")
    paths = materialize(rows.groupBy("host", "path").agg(F.count(label).alias("n"), F.count(F.when(label, 1)).alias("bad"), F.count("*").alias("pages")))
    gone = rejected(paths).withColumn("gone", F.lit(True))
    out = rows.join(gone, ["host", "path"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("gone"), "block").otherwise("allow"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"))
