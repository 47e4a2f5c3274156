"""The library source: what it walks, what a filter spares, what the sink refuses."""

import os

import pytest
from pyspark.sql import functions as F

from quillstack.sources import library, walk

BOOK = "type: book\ntitle: {}\n"


def put(root, key, text=None, name="info.yml"):
    os.makedirs(root / key, exist_ok=True)
    (root / key / name).write_text(BOOK.format(key) if text is None else text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "lib"
    for key in ("a", "deep/b", "_shelf/c", "_shelf/_d", "_shelf/c/inner", "plus+1%41"):
        put(root, key)
    for key in (".git/x", ".bib/y", "deep/.hidden/z"):
        put(root, key)
    put(root, "alt", BOOK.format("alt"), "info.yaml")
    put(root, "a", "type: misc", "info.yaml")
    put(root, "bad", "type: nothing")
    os.makedirs(root / "loose/more")
    (root / "loose/info.txt").write_text("no")
    os.symlink(root, root / "circle")
    os.makedirs(root / "linked")
    os.symlink(root / "a/info.yml", root / "linked/info.yml")
    return root


KEYS = ["_d", "a", "alt", "b", "bad", "c", "inner", "linked", "plus+1%41"]


@pytest.mark.parametrize("parts", [1, 2, 3, 64])
def test_paths(spark, tree, parts):
    """However the tree is dealt out, each directory comes once."""
    got = walk.paths(spark, str(tree), parts=parts).collect()
    assert sorted(r.citekey for r in got) == KEYS
    assert all(r.path == f"{r.dir}/{r.name}" and os.path.isfile(r.path) for r in got)
    assert {r.citekey: r.name for r in got if r.citekey in ("a", "alt")} == {"a": "info.yml", "alt": "info.yaml"}
    other = walk.paths(spark, str(tree), first="info.yaml", parts=parts).where("citekey = 'a'").collect()
    assert [r.name for r in other] == ["info.yaml"]


def test_wide_directory(spark, tmp_path):
    """More children than tasks: dealt out by name, none twice."""
    for i in range(90):
        put(tmp_path, f"k{i}")
    put(tmp_path, ".", BOOK.format("root"))
    got = [r.citekey for r in walk.paths(spark, str(tmp_path), parts=7).collect()]
    assert sorted(got) == sorted([f"k{i}" for i in range(90)] + [tmp_path.name])
    assert sum(bool(w.shared) for w in walk.LibraryReader(str(tmp_path), "info.yml", 7).partitions()) == 7


def test_documents(spark, tree):
    docs, errors = walk.documents(spark, str(tree))
    assert sorted(r.citekey for r in docs.collect()) == [k for k in KEYS if k != "bad"]
    assert [(r.citekey, "nothing" in r.error) for r in errors.collect()] == [("bad", True)]
    one, _ = walk.documents(spark, str(tree), walk.paths(spark, str(tree)).where("citekey IN ('a', 'c')"))
    assert sorted(r.title for r in one.collect()) == ["_shelf/c", "a"]


def test_names_and_files_that_cant_be_read(spark, tmp_path):
    put(tmp_path, "good")
    os.makedirs(os.fsencode(str(tmp_path)) + b"/n\xff")
    with open(os.fsencode(str(tmp_path)) + b"/n\xff/info.yml", "w") as f:
        f.write(BOOK)
    listing = walk.paths(spark, str(tmp_path))
    assert sorted((r.citekey or "") for r in listing.collect()) == ["", "good"]
    docs, errors = walk.documents(spark, str(tmp_path), listing)
    (tmp_path / "good/info.yml").unlink()  # gone between listing and reading
    assert docs.count() == 0 and sorted(r.error for r in errors.collect()) in (["no usable directory name"], ["no usable directory name", "the file can't be read"])


def test_empty_and_missing(spark, tmp_path):
    assert walk.paths(spark, str(tmp_path)).count() == 0
    assert [d.count() for d in walk.documents(spark, str(tmp_path))] == [0, 0]
    with pytest.raises(ValueError):
        walk.paths(spark, str(tmp_path / "none"))


def test_directory(spark, tree):
    assert walk.directory(spark, str(tree / "_shelf/c")).first().title == "_shelf/c"
    assert walk.directory(spark, str(tree / "bad")).first().error
    for none in ("loose", "nowhere"):
        with pytest.raises(ValueError):
            walk.directory(spark, str(tree / none))


def test_filters(spark, tree, monkeypatch):
    """With pushdown a directory asked for is the only one listed, and a prefix spares what is beside it."""
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith

    seen = []
    real = walk.listed
    monkeypatch.setattr(walk, "listed", lambda store, path: (seen.append(os.path.relpath(path, tree)), real(store, path))[1])

    def run(*filters, parts=1):
        seen.clear()
        r = walk.PrunedLibraryReader(str(tree), "info.yml", parts)
        left = list(r.pushFilters(list(filters)))
        return sorted(k for w in r.partitions() for b in r.read(w) for k in b.column("citekey").to_pylist()), left

    d = f"{tree}/_shelf"
    assert run(EqualTo(("dir",), f"{d}/c")) == (["c"], []) and seen == ["_shelf/c"]
    assert run(In(("dir",), (f"{d}/c", f"{tree}/.git/x", f"{tree}/nowhere", f"{tree}/deep/../a", f"{tree}/circle/a", "/etc"))) == (["c"], [])
    for parts in (1, 3, 64):
        assert run(StringStartsWith(("dir",), f"{d}/"), parts=parts)[0] == ["_d", "c", "inner"]
        assert not {s.split("/")[0] for s in seen} - {".", "_shelf"} or parts == 1
    null = IsNotNull(("dir",))
    assert run(null, EqualTo(("citekey",), "b"), In(("citekey",), ("a", "b"))) == (["b"], [null])
    assert run(EqualTo(("citekey",), "a"), EqualTo(("citekey",), "b"))[0] == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        p = walk.paths(spark, str(tree))
        assert [r.citekey for r in p.where(F.col("dir") == f"{d}/c").collect()] == ["c"]
        assert sorted(r.citekey for r in p.where(F.col("dir").startswith(f"{d}/") & (F.col("name") != "x")).collect()) == ["_d", "c", "inner"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_save(spark, tree):
    rows = [("new/n1", "type: book\ntitle: N"), ("a", "type: book\ntitle: over"), ("../out", "type: book"), ("/abs", "type: book"), (".x/h", "type: book"), ("bad2", "type: nothing"), ("bad3", "a: ["), ("sp ace", "type: book"), ("t", "type: book"), ("t", "type: misc"), (None, "type: book"), ("nul", None)]
    df = spark.createDataFrame(rows, "dir string, text string")
    refused = sorted((r.dir or "") for r in walk.save(df, str(tree)).collect())
    assert refused == sorted(["../out", "/abs", ".x/h", "bad2", "bad3", "sp ace", "t", "t", "", "nul"])
    assert (tree / "a/info.yml").read_text() == "type: book\ntitle: over" and not (tree.parent / "out").exists() and not (tree / "t").exists()
    assert not [f for _, _, fs in os.walk(tree) for f in fs if f.endswith(".tmp")]
    again = {r.dir: r.reason for r in walk.save(df.where("dir IN ('a', 'new/n2', 'new/n1')"), str(tree), create=True).collect()}
    assert again == {"a": "already exists", "new/n1": "already exists"}
    assert {r.citekey: r.title for r in walk.documents(spark, str(tree))[0].collect()}["n1"] == "N"


def test_yaml_parsers_agree():
    """Whatever text the fast parser takes, the plain one takes alike; what is refused is refused for the plain one's reason."""
    import random

    import yaml

    plain = library.yaml_loader()
    assert library.yaml_loader() is plain
    seeds = ["k:\n  type: book\n  title: \"a: b\"\n", "title: {value: 'x', n: 1_0, f: 1.5}\ndate: 2001-02\ny: yes\nk: true\nz: 010\n", "a: |\n  x\n   y\nb: >-\n  q\n\n  z\n- &x 'y'\n- *x\n"]
    draw = random.Random(5)

    def said(read, text):
        try:
            return repr(read(text))
        except Exception as e:
            return str(e)

    for _ in range(2000):
        text = list(draw.choice(seeds))
        for _ in range(draw.randint(1, 4)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = draw.choice(" \n\t:-{}[],'\"#&*!|>%@?~a1.\\é\x00\ufeff")
        text = "".join(text)
        assert said(library.load_yaml, text) == said(lambda t: yaml.load(t, plain), text), text


def test_parsing_is_dealt_out(spark, tmp_path):
    """Texts of few bytes are parsed in many tasks, and each file once for documents and errors together."""
    from quillstack.sources import catalogues
    from quillstack.sources.tables import dealt

    texts = spark.range(400).coalesce(1).selectExpr("concat('k', id, ':\n  title: t\n') AS body")
    assert dealt(texts).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    found = catalogues.from_texts(texts, "yaml")
    assert found.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert {r.key for r in found.collect()} == {f"k{i}" for i in range(400)}
    for i in range(40):
        (tmp_path / f"k{i}").mkdir()
        (tmp_path / f"k{i}" / "info.yml").write_text("type: book\ntitle: t\n" if i % 4 else "type: gadget\n")
    all_ = walk.scanned(spark, str(tmp_path))
    assert walk.opened(walk.paths(spark, str(tmp_path)), str(tmp_path)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert {(r.citekey, r.error is None) for r in all_.collect()} == {(f"k{i}", i % 4 > 0) for i in range(40)}
