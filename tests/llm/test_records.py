"""Conversation repair, secret scans and the manifest against plain programs, on small odd tables."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillstack.llm import conversations, manifest, queries, secrets

SF = "/root/testdata/sf0.001"


# Conversations.


def cheapest(initials, gone, cut):
    """(cost, audit) by uniform cost search over single edits; of equal costs the least audit."""
    step = {("e", "s"): "S", ("e", "u"): "u", ("S", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "e")], set()
    ends = []
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if ends and cost > ends[0][0]:
            break
        if i == len(initials) and state in "ea":
            ends.append((cost, audit))
        if (cost, audit, i, state) in seen or audit.count("I") > len(initials) + 2:
            continue
        seen.add((cost, audit, i, state))
        for role in "ua":
            if (state, role) in step:
                heapq.heappush(heap, (cost + 5, audit + "I", i, step[state, role]))
        if i == len(initials):
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
        if not gone[i]:
            for edit, role, price in [("K", initials[i], 0), ("R", "u", 1), ("R", "a", 1)]:
                if (state, role) in step:
                    heapq.heappush(heap, (cost + price + 5 * cut[i], audit + edit, i + 1, step[state, role]))
    return min(ends)


def test_plan_against_search():
    rnd = random.Random(11)
    for _ in range(400):
        n = rnd.randrange(0, 7)
        initials = [rnd.choice(["s", "u", "a", "u", "a", "t", ""]) for _ in range(n)]
        fault = [rnd.choice(["", "", "", "gone", "cut"]) for _ in range(n)]
        gone, cut = [f == "gone" for f in fault], [f == "cut" for f in fault]
        cost, plan, tail = conversations.repair_plan(initials, gone, cut)
        audit = "".join("I" * len(p[0]) + p[1] for p in plan) + "I" * len(tail)
        assert (cost, audit) == cheapest(initials, gone, cut), (initials, fault)
        roles = []
        for initial, (before, edit, new) in zip(initials, plan):
            roles += [r[0] for r in before] + ([] if edit == "D" else [new[0] if new else initial])
        assert re.fullmatch("(s?(ua)+)?", "".join(roles + [r[0] for r in tail]))


def test_repair_of_odd_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Well"), (1, None, "system", "Be."), (None, 0, "assistant", "Alone!"), (None, 0, None, None), (2, 5, "tool", "x?"), (3, 0, "user", "A.\t\n"), (3, 0, "user", "A.\t\n"), (3, 4, "assistant", "B. "), (4, 0, "user", ""), (5, 7, "user", "lost")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"edit": F.lit("mine"), "place": F.lit(1)})
    out = conversations.digests(conversations.repair(t, lost=F.col("conv_id") == 5))
    got = {r.conv: r for r in out.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == out.count() == 6
    assert (got[1].audit, got[1].cost, got[1].truncated, got[1].illegal) == ("RRD", 4, 1, 0)
    assert (got[None].audit, got[None].blank, got[None].illegal, got[None].cost) == ("DD", 1, 1, 4)
    assert (got[2].audit, got[2].gaps) == ("D", 0)
    assert (got[3].audit, got[3].duplicate, got[3].gaps, got[3].repaired_sha256) == ("KDK", 1, 3, sha("user:A.\t\n\nassistant:B. "))
    assert (got[4].audit, got[4].blank) == ("D", 1)
    assert (got[5].audit, got[5].cost, got[5].gaps, got[5].repaired_sha256) == ("", 0, 0, sha(""))
    assert conversations.digests(conversations.repair(t.limit(0))).count() == 0


def test_long_conversation(spark):
    n = 3000
    t = spark.range(n).selectExpr("7L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, '.', repeat('x', 2000), '!') AS text")
    rows = conversations.repair(t)
    assert rows.where("edit = 'K'").count() == n
    (r,) = conversations.digests(rows).collect()
    want = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:t{i}.{'x' * 2000}!" for i in range(n))
    assert (r.cost, r.audit, r.repaired_sha256) == (0, "K" * n, hashlib.sha256(want.encode()).hexdigest())


# Secrets.


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def random_text(rnd):
    bits = ["password", "PassWd", "token", "api_key", "apikey", "secret", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIA" + "Z9" * 7, "é日", "\n", "=abc", "0123456789abcdef" * 2, "deadbeef", "secretary", ": hunter2hunter2", "=x" * 9, "KEY", "-._"]
    return "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 40)))


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(secrets.samples(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")))


def test_base_spans(spark, model):
    rnd = random.Random(3)
    texts = [None, "", "x", "token=" + "a" * 40 + "," + "f" * 31] + [random_text(rnd) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("old"))
    for r in secrets.scan(df, model).collect():
        got = [tuple(s) for s in r.spans]
        assert got == sorted(got)
        assert [s for s in got if s[1] < 3] == plain_spans(r.text or ""), r.text
    assert secrets.scan(df.limit(0), model).count() == 0


def test_model_tells_random_from_ordinary(spark, model):
    rnd = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rnd.choice(alphabet) for _ in range(32)) for _ in range(200)]
    ordinary = ["thingstionthenthereof", "undschlichkeiteinverber", "connection/reading/there", "lethsttionthinganderst", "auxelleentionmentpar"]
    text = " ".join(keys + ordinary)
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    one, two = secrets.scan(df, model).collect()
    assert one.spans == two.spans
    found = {text[s.start : s.end] for s in one.spans if s.rank == 3}
    assert len(found & set(keys)) >= 190 and not found & set(ordinary)
    assert secrets.fit(spark.createDataFrame([], "token string, random boolean")) == [0.0] * len(secrets.ALPHABET) ** 2


def test_ratio_of_long_runs(spark, model):
    rnd = random.Random(4)
    token = "".join(rnd.choice(secrets.ALPHABET) for _ in range(5000))
    k = len(secrets.ALPHABET)
    want = sum(model[secrets.ALPHABET.index(a) * k + secrets.ALPHABET.index(b)] for a, b in zip(token, token[1:]))
    got = spark.createDataFrame([(token,), ("",), ("a",)], "t string").select(secrets.ratio(F.col("t"), model).alias("r")).collect()
    assert got[0].r == pytest.approx(want) and got[1].r == got[2].r == 0


def test_many_matches(spark, model):
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(2000))
    (r,) = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [tuple(s) for s in r.spans] == [(33 * i, 2, 33 * i + 32) for i in range(2000)]


def test_op12(spark, tmp_path):
    rnd = random.Random(6)
    texts = [None, "", "token = '" + "ab12" * 10 + "' and AKIA" + "Q7" * 8 + " secret: 12345678 secret: 1"] + [random_text(rnd) for _ in range(120)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows, seen = {r.doc_id: r for r in queries.op12_secrets(spark, str(tmp_path)).collect()}, [0, 0, 0]
    for d in docs.collect():
        r, want = rows[d.doc_id], plain_spans(d.text or "")
        counts = [sum(s[1] == k for s in want) for k in range(3)]
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        seen = [a + b for a, b in zip(seen, counts)]
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("markov")] == [x for x in said.split(",") if x]
    assert all(seen) and len(set(seen)) == 3


# Manifest.


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_tree(leaves):
    """(top, proof and fold of each leaf) of a list of digests."""
    ways = [[] for _ in leaves]
    spots = {i: [i] for i in range(len(leaves))}
    while len(leaves) > 1:
        ups, places = [], {}
        for at in range(0, len(leaves), 16):
            run = leaves[at : at + 16]
            for j in range(len(run)):
                for leaf in spots[at + j]:
                    ways[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
                    places.setdefault(at // 16, []).append(leaf)
            ups.append(sha("".join(run)))
        leaves, spots = ups, places
    return leaves[0], ways


def plain_manifest(rows):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(text, (r.doc_id, r.source, r.lang, r.n_chars, t))))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault((r.source is not None, (r.source or "").encode()), []).append(r)
    order = sorted(groups)
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[g] = plain_tree([leaf(r, r.text) for r in groups[g]])
    root, crown = plain_tree([trees[g][0] for g in order])
    out = []
    for g, up in zip(order, crown):
        for r, way in zip(groups[g], trees[g][1]):
            whole = way + up
            used = leaf(r, r.text)
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
                used = leaf(r, lower(r.text))
            for a, b in whole:
                used = sha(a + used + b)
            out.append((r.doc_id, leaf(r, r.text), trees[g][0], root, sha("".join(a + b for a, b in whole)), used, used == root))
    return out


def manifest_rows(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_manifest(spark, str(tmp_path))
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx int, way string, grp string"


@pytest.mark.parametrize("sizes", [{"a": 700, "b": 1, None: 17, "": 16, "é": 33}, {"only": 1}, {f"s{i}": 1 + i % 3 for i in range(40)}, {"x": 4113}])
def test_manifest(spark, tmp_path, sizes):
    rnd = random.Random(2)
    rows, ids = [], rnd.sample(range(100_000), sum(n for n in sizes.values()))
    for source, n in sizes.items():
        rows += [(ids.pop(), source, rnd.choice(["en", None]), rnd.choice([3, None]), rnd.choice([None, "", "Größe ABC", "low"]), 1, "w", "g") for _ in range(n)]
    rnd.shuffle(rows)
    if "b" in sizes:
        rows += [(None, "a", None, None, None, 1, "w", "g")] * 2 + [rows[0], (rows[0][0], "a", "en", 1, "other", 1, "w", "g")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    key = lambda t: (t[0] is None, t[0] or 0, t[1:])
    assert sorted(manifest_rows(spark, tmp_path, df), key=key) == sorted(plain_manifest(df.collect()), key=key)


def test_manifest_of_nothing(spark, tmp_path):
    assert manifest_rows(spark, tmp_path, spark.createDataFrame([], SCHEMA)) == []


def test_combine_in_any_order():
    """Partial parents complete once their size-derived arity is met, whatever the order of events; the rest stays open."""
    import pyarrow as pa

    schema = pa.schema([("kind", pa.string()), ("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("children", pa.list_(pa.string()))])
    events = [{"grp": "g", "level": 0, "idx": i, "digest": sha(str(i)), "n": 40} for i in range(40)]
    random.Random(1).shuffle(events)
    run = lambda rows: [r for b in manifest._combine(iter([pa.RecordBatch.from_pylist(rows)]), schema) for r in b.to_pylist()]
    whole = run(events)
    assert [r["kind"] for r in whole].count("node") == 4 and [r["digest"] for r in whole if r["kind"] == "top"] == [plain_tree([sha(str(i)) for i in range(40)])[0]]
    late = run([e for e in events if e["idx"] != 39])
    assert sorted(r["idx"] for r in late if r["kind"] == "open" and r["level"] == 0) == list(range(32, 39))
    assert sorted(r["idx"] for r in late if r["kind"] == "open" and r["level"] == 1) == [0, 1]
