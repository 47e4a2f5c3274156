"""BibTeX files cut into many splits, against the parse of each file as one text."""

import json
import random

import pytest

from quillstack.sources import bibfile
from quillstack.sources.catalogues import bibtex_body, parse_bibtex
from quillstack.sources.tables import delete


@pytest.fixture
def cut(spark):
    """Splits of some bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(n: int):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield to
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, folder):
    df, path = bibfile.read(spark, str(folder))
    rows = df.collect()
    delete(spark, path)
    return rows


def plain(text):
    entries, errors = parse_bibtex(text)
    return [(e["key"], json.dumps(bibtex_body(e), ensure_ascii=False)) for e in entries], len(errors)


def same(rows, text):
    expected, wrong = plain(text)
    got = sorted((r for r in rows if r.key), key=lambda r: (r.block, r.row, r.n))
    assert [(r.key, r.body) for r in got] == expected
    told = [r.error for r in rows if r.error]
    assert sum(int(e.split()[1]) if r.block is None else 1 for r in rows if (e := r.error)) == wrong
    assert len(told) == min(wrong, 5) + (wrong > 5)


PARTS = [
    "@misc{k%d, title = {plain %d}}\n", '@misc{k%d, title = "mail a@b.c and @misc{no, x} %d", year = 2001}\n', "@article{k%d,\n  note = {see\n@book{in%d, title={x}}\n},\n journal = pub}\n", "free text, a stray } %d %d\n",
    "@misc{k%d, title = {never closed %d\n", "@misc{k%d, title = {closed} %d\n", "@comment{about %d %d}\n", "  @string{pub = {House %d} # { & %d}}\n", "@string(sub = pub # { of %d %d})\n", "@book{k%d, title={T \\{ %d}, publisher = sub # \" Ltd\"}\n",
    "@misc(k%d, title={round %d})\n", "}} %d %d\n", "@@ %d @ %d\n", "@misc{k%d, title={ünï 東京 %d}}@misc{l, title={next}}\n",
]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_whole_files(spark, cut, tmp_path, seed):
    rng = random.Random(seed)
    choice = PARTS if seed % 2 else [p for p in PARTS if "never" not in p and "stray" not in p and "}} " not in p]
    texts = {f"f{i}.bib": "".join(rng.choice(choice) % (rng.randrange(99), rng.randrange(99)) for _ in range(50)) for i in range(2)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    cut(rng.choice((250, 700)))
    rows = read(spark, tmp_path)
    for name, text in texts.items():
        same([r for r in rows if r.file.endswith(name)], text)


def test_strings_name_strings_across_splits(spark, cut, tmp_path):
    text = '@string{a = "A"}\n@string{b = a # "B"}\n@string{c = b # "C"}\n@misc{x, title = c}\n@string{a = "Z"}\n@misc{y, title = a # c}\n@misc{z, title = {c}}'
    (tmp_path / "s.bib").write_text(text)
    cut(20)
    rows = read(spark, tmp_path)
    assert {r.key: json.loads(r.body)["title"] for r in rows} == {"x": "ABC", "y": "ZABC", "z": "c"}


def test_many_splits_and_one_open_brace(spark, cut, tmp_path):
    """A brace that is never closed costs its own record alone, and the rest stays apart."""
    text = "@misc{bad, title = {x\n" + "".join(f"@misc{{k{i}, title = {{t{i}}}}}\n" for i in range(200))
    (tmp_path / "s.bib").write_text(text)
    cut(600)
    table = bibfile.pieces(spark, str(tmp_path))
    assert table.select("block").distinct().count() > 8
    found = bibfile.records(table)
    assert found.count() == 202 and max(len(r.text) for r in found.collect()) < 40
    same(read(spark, tmp_path), text)


def test_nothing(spark, tmp_path):
    (tmp_path / "e.bib").write_text("")
    assert read(spark, tmp_path) == []
    (tmp_path / "t.bib").write_text("no records here")
    assert read(spark, tmp_path) == []
