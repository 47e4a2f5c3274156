"""The template tree: planted templates on hosts that no rule covers, pooled children, odd urls."""

import duckdb
from pyspark.sql import functions as F

from quillstack.llm import queries, urlfilter


def verdicts(spark, rows, **more):
    d = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    return {x.page_id: x.verdict for x in urlfilter.judge(d, blocked=F.col("bad"), **more).collect()}


def test_planted_templates_on_hosts_without_labels(spark):
    """Hosts a to e show that /win/... is to block and /news/... isn't; host f has no label at all."""
    rows, n = [], 0
    for host in "abcde":
        for i in range(8):
            rows += [(n, f"http://{host}.com/win/{i}/now", True), (n + 1, f"http://{host}.com/news/{i}.html", False)]
            n += 2
    planted = [(1000 + i, f"http://www.f.net/win/{900 + i}/now", None) for i in range(6)]
    clean = [(2000 + i, f"http://www.f.net/news/{i}.html", None) for i in range(6)]
    other = [(3000, "http://www.f.net/about", None), (3001, "http://g.net/win/else", None), (3002, "http://f.net", None)]
    got = verdicts(spark, rows + planted + clean + other, rules=())
    assert {got[k] for k, _, _ in planted} == {"block"} and {got[k] for k, _, _ in clean} == {"allow"}
    assert got[3001] == "block" and got[3002] == "allow"  # by the first segment alone; nothing known


def test_children_of_a_wildcard_are_pooled(spark):
    """Below 30 users, /edit is always to block and /view never: each user has one page of each, labelled or not."""
    users = [f"u{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)]
    rows = [(i, f"http://h.net/{u}/edit", True if i < 15 else None) for i, u in enumerate(users)] + [(100 + i, f"http://h.net/{u}/view", False if i < 15 else None) for i, u in enumerate(users)]
    got = verdicts(spark, rows, rules=())
    assert {got[i] for i in range(30)} == {"block"} and {got[100 + i] for i in range(30)} == {"allow"}


def test_alike_branches_are_merged(spark):
    """/a and /b are alike and clean; one bad label below /b doesn't reject it. /c differs and goes."""
    rows = [(100 * k + i, f"http://h.net/{b}/x{chr(97 + i)}", b == "c" or (b == "b" and i == 0)) for k, b in enumerate("abc") for i in range(12)]
    got = verdicts(spark, rows, rules=())
    assert {got[100 + i] for i in range(12)} == {"allow"} and {got[200 + i] for i in range(12)} == {"block"}


def test_odd_urls_equal_the_sql(spark):
    urls = ["http://a.example.com/de/" + "x/" * 30 + "end", "http://a.example.com/de/" + "x/" * 30 + "end", "http://b.net/" + "y" * 50_000, "http://b.net/de/" + "x/" * 30 + "end", None, "", "://", "http://", "http:///", "http://.net/es/1", "HTTP://B.NET/es//2//", "http://q.example.org/es/4", "http://c.net/es/7?u=http://z", "http://é.net/ü/1"]
    urls += [f"http://w{i}.example.com/fr/{i}" for i in range(20)] + [f"http://x.net/s{chr(97 + i)}/de/{i}" for i in range(20)]
    d = spark.createDataFrame([*enumerate(urls), (None, urls[0]), (1, urls[1])], "page_id long, url string")
    got = urlfilter.judge(d).collect()
    con = duckdb.connect()
    pages = d.toArrow()  # noqa: F841  read by DuckDB
    want = con.sql(queries.OP9_SQL).fetchall()
    assert len(got) == len(urls) + 2 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
