"""The registered queries ``opN_<name>`` with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import conversations, decontaminate, manifest, nearest, pieces, quality, secrets, sharding, simhash, subwords, tokencount, toxicity, urlfilter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is, on every machine alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(key: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign(docs, F.col("doc_id"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = subwords.score(docs, tokenizer_path("piece_bpe_32k.model"), remainder("doc_id", 10) != 0)
    return scored.withColumn("held_out", remainder("doc_id", 10) == 0)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, allowed=remainder("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"), decoded="decoded")
    text = F.coalesce("text", F.lit(""))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == text).alias("lossless"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.count(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return quality.resample(docs, quality.fit(docs, labels), ["doc_id"])


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.digests(conversations.repair(damaged, lost=F.col("lost"))).withColumnRenamed("conv", "conv_id")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.fit(secrets.samples(docs)))
    base = F.filter("spans", lambda s: s["rank"] < 3)
    counts = [F.size(secrets.of_kind(F.col("spans"), kind)).cast("long").alias(f"n_{kind}") for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, manifest.digest(manifest.encoded(*fields, text=lowered)))
    built = manifest.build(docs, "source", "doc_id", manifest.digest(manifest.encoded(*fields)), tampered.alias("tampered"))
    folded = manifest.folded(F.coalesce("tampered", "leaf"), F.col("way"))
    return built.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.proof(F.col("way")), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {
    "op1_nearest": op1_nearest,
    "op2_sharding": op2_sharding,
    "op3_language_model": op3_language_model,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
    "op11_conversations": op11_conversations,
    "op12_secrets": op12_secrets,
    "op13_manifest": op13_manifest,
}

_SHARD_ROWS = ", ".join(f"({i}, '{s}', {sharding.preferences(s, sharding.SIZE)[0]}, {sharding.preferences(s, sharding.SIZE)[1]})" for i, s in enumerate(sharding.SHARDS))

OP2_SQL = f"""
WITH RECURSIVE shards(i, shard, off, step) AS (VALUES {_SHARD_ROWS}),
prefs AS (SELECT i, list((off + j * step) % {sharding.SIZE} ORDER BY j) AS slots FROM shards, range({sharding.SIZE}) r(j) GROUP BY i),
turns(turn, claimed, slot) AS (
  SELECT 0, CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT turn + 1, list_append(claimed, pick), pick
  FROM (SELECT t.turn, t.claimed, list_filter(p.slots, lambda s: NOT list_contains(t.claimed, s))[1] AS pick
        FROM turns t JOIN prefs p ON p.i = t.turn % {len(sharding.SHARDS)} WHERE t.turn < {sharding.SIZE})
),
filled AS (SELECT slot, (turn - 1) % {len(sharding.SHARDS)} AS i FROM turns WHERE slot IS NOT NULL),
placed AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {sharding.SIZE} AS slot FROM documents)
SELECT doc_id, slot, shard FROM placed JOIN filled USING (slot) JOIN shards USING (i)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT item_id, {decontaminate.WINDOW} AS n, array_to_string(w[p:p + {decontaminate.WINDOW - 1}], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - {decontaminate.WINDOW - 2})) AS p FROM b WHERE len(w) >= {decontaminate.WINDOW})
  UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND {decontaminate.WINDOW - 1}
),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
hits AS (SELECT doc_id, item_id, p, n FROM dw JOIN win USING (n, s)),
hit_words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def _rule_cases(what: int) -> str:
    """CASE over the rules, longest first; 0: the rule, 1: its verdict."""
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{(h + p, v)[what]}'" for v, h, p in rules) + " END"


def _levels(depth: int) -> str:
    """The tree's levels as common table expressions."""
    alike = f"CASE WHEN bn = n OR bb = 0 OR bb = bn THEN true ELSE abs(bad / n - (bb - bad) / (bn - n)) - 0.5 * (1 / n + 1 / (bn - n)) < {urlfilter.Z} * sqrt((bb / bn) * (1 - bb / bn) * (1 / n + 1 / (bn - n))) END"
    return "".join(f"""
k{d} AS (SELECT host, template, segments[{d}] AS seg, sum(n) AS n, sum(bad) AS bad FROM t{d - 1} WHERE len(segments) >= {d} GROUP BY ALL),
m{d} AS (SELECT host, template, seg, CASE WHEN n > 0 AND NOT {alike} THEN seg WHEN k > {urlfilter.FANOUT} OR (n > 0 AND k > 1) THEN '*' ELSE seg END AS name
  FROM (SELECT *, count(*) OVER w AS k, sum(n) OVER w AS bn, sum(bad) OVER w AS bb FROM k{d} WINDOW w AS (PARTITION BY host, template))),
t{d} AS (SELECT t.host, t.segments, t.n, t.bad, t.pages, CASE WHEN name IS NULL THEN t.template ELSE list_append(t.template, name) END AS template
  FROM t{d - 1} t LEFT JOIN m{d} m ON t.host = m.host AND t.template = m.template AND t.segments[{d}] = m.seg),""" for d in range(1, depth + 1))


_FORM = "array_to_string(segments, '/')"
_SUFFIX = "array_to_string(l[-{n}:], '.')"

OP9_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
hp AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM u),
r AS (SELECT *, {_rule_cases(0)} AS rule, {_rule_cases(1)} AS ruled FROM hp),
paths0 AS (SELECT host, path, count(ruled) AS n, count(*) FILTER (WHERE ruled = 'block') AS bad, count(*) AS pages,
  list_filter(string_split(regexp_replace(path, '[0-9]+', '*', 'g'), '/'), lambda x: x != '') AS s FROM r GROUP BY host, path),
paths AS (SELECT host, path, n, bad, pages, CASE WHEN len(s) < {urlfilter.DEPTH} THEN s ELSE list_append(s[1:{urlfilter.DEPTH - 1}], array_to_string(s[{urlfilter.DEPTH}:], '/')) END AS segments FROM paths0),
t0 AS (SELECT host, segments, sum(n) AS n, sum(bad) AS bad, sum(pages) AS pages, CAST([] AS VARCHAR[]) AS template FROM paths GROUP BY host, segments),{_levels(urlfilter.DEPTH)}
keyed AS (SELECT host, segments, n, bad, level, CASE level WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN {_SUFFIX.format(n=1)} WHEN 3 THEN {_SUFFIX.format(n=2)} ELSE {_SUFFIX.format(n=3)} END AS suffix,
  CASE level WHEN 0 THEN coalesce(segments[1], '') || '/...' ELSE {_FORM} END AS form FROM (SELECT *, string_split(host, '.') AS l FROM t0), range(5) g(level) WHERE level < 2 OR len(l) >= level),
seen AS (SELECT level, suffix, form, sum(n) AS sn, sum(bad) AS sb FROM keyed WHERE n > 0 GROUP BY ALL),
steps AS (SELECT host, segments, max(CASE level WHEN 0 THEN sn END) AS n0, max(CASE level WHEN 0 THEN sb END) AS b0, max(CASE level WHEN 1 THEN sn END) AS n1, max(CASE level WHEN 1 THEN sb END) AS b1,
  max(CASE level WHEN 2 THEN sn END) AS n2, max(CASE level WHEN 2 THEN sb END) AS b2, max(CASE level WHEN 3 THEN sn END) AS n3, max(CASE level WHEN 3 THEN sb END) AS b3, max(CASE level WHEN 4 THEN sn END) AS n4, max(CASE level WHEN 4 THEN sb END) AS b4
  FROM keyed LEFT JOIN seen USING (level, suffix, form) GROUP BY host, segments),
p0 AS (SELECT *, (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) FROM t0) AS p FROM steps),
{"".join(f"p{i + 1} AS (SELECT * REPLACE ((coalesce(b{i}, 0) + {urlfilter.WEIGHT} * p) / (coalesce(n{i}, 0) + {urlfilter.WEIGHT}) AS p) FROM p{i})," for i in range(5))}
placed AS (SELECT t.*, p AS prior FROM t{urlfilter.DEPTH} t JOIN p5 USING (host, segments)),
gone AS (SELECT host, template FROM placed GROUP BY host, template HAVING (sum(bad) + {urlfilter.WEIGHT} * (sum(prior * pages) / sum(pages))) / (sum(n) + {urlfilter.WEIGHT}) > 0.5 + 1e-9)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN g.template IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN paths USING (host, path) JOIN placed USING (host, segments) LEFT JOIN gone g USING (host, template)
"""

#: crc32 of an ASCII text, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS UBIGINT)), lambda crc, c: list_reduce(list_transform(range(9), lambda i: xor(crc, c)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"

_WHITE = r"\x20\x09-\x0D"


def _cheapest(*options: str) -> str:
    """Least of texts that are a cost of ten digits and an audit; nulls don't count."""
    return f"least({', '.join(options)})"


def _more(cost: int, letter: str, then: str) -> str:
    return f"(lpad(CAST(CAST(substr({then}, 1, 10) AS INT) + {cost} AS VARCHAR), 10, '0') || '{letter}' || substr({then}, 11))"


def _edit_sql(state: str) -> str:
    """The cheapest of delete, keep and rerole at a turn from a state, by what is cheapest after it (e, s, u, a)."""
    to = "ua" if state in "esa" else "a"
    options = [_more(2, "D", f"p.{state}")]
    for role in ("su" if state == "e" else "u" if state in "sa" else "a"):
        options.append(f"CASE WHEN must OR initial <> '{role}' THEN NULL WHEN cut THEN {_more(5, 'K', 'p.' + role)} ELSE {_more(0, 'K', 'p.' + role)} END")
    options.append(f"CASE WHEN must OR initial = '{to[0]}' THEN NULL WHEN cut THEN {_more(6, 'R', 'p.' + to[0])} ELSE {_more(1, 'R', 'p.' + to[0])} END")
    return _cheapest(*options)


#: Two rounds of insertions: from start, system and assistant to user, from user to assistant.
_INSERTED = ", ".join(f"{_cheapest(s, _more(5, 'I', 'a' if s == 'u' else 'u'))} AS {s}" for s in "esua")

OP11_SQL = f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
faulty AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, f
  FROM (SELECT *, {_CRC} % 20 AS f FROM named)),
present AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
  FROM (SELECT *, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM faulty WHERE f <> 0)),
judged AS (SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^{_WHITE}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][{_WHITE}]*\\z') THEN 'truncated' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM present),
t AS (SELECT conv_id, i, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS must, coalesce(fault = 'truncated', false) AS cut FROM judged),
counts AS (SELECT conv_id, count(*) AS rows_left, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
best(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, rows_left + 1, '0000000000', '0000000010II', '0000000005I', '0000000000' FROM counts
  UNION ALL
  SELECT conv_id, i, {_INSERTED} FROM (SELECT conv_id, i, {_INSERTED} FROM (
    SELECT t.conv_id, t.i, {", ".join(f"{_edit_sql(s)} AS {s}" for s in "esua")} FROM best p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i - 1))),
won AS (SELECT conv_id, CAST(substr(e, 1, 10) AS BIGINT) AS cost, substr(e, 11) AS audit FROM best WHERE i = 1),
letters AS (SELECT conv_id, audit, unnest(string_split(audit, '')) AS edit, unnest(range(1, length(audit) + 1)) AS place FROM won WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS i, count(*) FILTER (WHERE edit <> 'D') OVER w AS out FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
lines AS (SELECT l.conv_id, l.place, l.edit, l.out, CASE WHEN l.edit = 'I' THEN '' ELSE j.text END AS text, j.role AS role, max(CASE WHEN l.edit = 'K' AND l.out = 1 AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS lead
  FROM placed l LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM l.conv_id AND j.i = l.i),
repaired AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (out - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS s FROM lines WHERE edit <> 'D' GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(s, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN won w ON w.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _field(name: str, text: str | None = None) -> str:
    value = f"CAST({text or name} AS VARCHAR)"
    return f"coalesce(CAST(octet_length(encode({value})) AS VARCHAR) || ':' || {value}, '-')"


def _tree(name: str, leaves: str, depth: int) -> str:
    """Common table expressions of the trees over ``leaves`` (g, i, h): levels, and each leaf's siblings by level."""
    ctes = [f"{name}0 AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {leaves})"]
    for d in range(1, depth + 1):
        ctes.append(f"{name}{d} AS (SELECT g, i // 16 AS i, CASE WHEN max(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, CAST(ceil(max(n) / 16.0) AS BIGINT) AS n, list(h ORDER BY i) AS c, max(n) = 1 AS over FROM {name}{d - 1} GROUP BY g, i // 16)")
    return ", ".join(ctes)


_SOURCES, _CROWN = 5, 3


def _ways(name: str, depth: int, prefix: str) -> str:
    """Columns: the siblings on the left and the right on each level; empty above the top."""
    return ", ".join(f"CASE WHEN {name}{d}.over THEN '' ELSE array_to_string({name}{d}.c[1:(i{prefix} // {16 ** (d - 1)}) % 16], '') END AS {prefix}l{d}, CASE WHEN {name}{d}.over THEN '' ELSE array_to_string({name}{d}.c[(i{prefix} // {16 ** (d - 1)}) % 16 + 2:], '') END AS {prefix}r{d}, {name}{d}.over AS {prefix}o{d}" for d in range(1, depth + 1))


def _joins(name: str, depth: int, key: str, i: str) -> str:
    return " ".join(f"JOIN {name}{d} ON {name}{d}.g = {key} AND {name}{d}.i = {i} // {16 ** d}" for d in range(1, depth + 1))


def _fold(start: str) -> str:
    for p, depth in (("s", _SOURCES), ("c", _CROWN)):
        for d in range(1, depth + 1):
            start = f"list_transform([{start}], lambda x: CASE WHEN {p}o{d} THEN x ELSE sha256({p}l{d} || x || {p}r{d}) END)[1]"
    return start


OP13_SQL = f"""
WITH rows0 AS (SELECT doc_id, coalesce('+' || source, '') AS g, sha256({" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS h,
  sha256({" || ".join(_field(c, "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else None) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS low, CAST(doc_id AS VARCHAR) AS k FROM documents),
leaves AS (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN low ELSE h END AS used, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM rows0),
{_tree("t", "leaves", _SOURCES)},
subroots AS (SELECT '' AS g, g AS grp, h, row_number() OVER (ORDER BY g) - 1 AS i FROM t{_SOURCES}),
{_tree("u", "subroots", _CROWN)},
crowned AS (SELECT i AS ic, grp, h AS subroot FROM subroots),
crown AS (SELECT grp, subroot, {_ways("u", _CROWN, "c")} FROM crowned {_joins("u", _CROWN, "''", "ic")}),
own AS (SELECT doc_id, g AS sg, h AS leaf, used, i AS "is" FROM leaves),
ways AS (SELECT doc_id, sg, leaf, used, {_ways("t", _SOURCES, "s").replace("(is //", '("is" //')} FROM own {_joins("t", _SOURCES, "sg", '"is"')}),
folded AS (SELECT doc_id, leaf, subroot, (SELECT h FROM u{_CROWN}) AS root, sha256({" || ".join(f"{p}l{d} || {p}r{d}" for p, n in (("s", _SOURCES), ("c", _CROWN)) for d in range(1, n + 1))}) AS proof_sha256, {_fold("used")} AS folded_root FROM ways JOIN crown ON grp = sg)
SELECT *, folded_root = root AS verified FROM folded
"""

ORACLE_SQL = {"op2_sharding": OP2_SQL, "op4_decontamination": OP4_SQL, "op9_url_filter": OP9_SQL, "op11_conversations": OP11_SQL, "op13_manifest": OP13_SQL}
