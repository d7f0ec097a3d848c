from __future__ import annotations

import bz2
import random

import pytest
from pyspark.sql import functions as F

from sediment.operators.layout import reading_order
from sediment.sources.dumps import escaped, field, read_records, segments, segments_of


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "700")
    yield
    for name in names:
        spark.conf.unset(name)


def test_records_across_splits_are_read_once(spark, tmp_path, small_splits):
    r = random.Random(1)
    texts = ["".join(r.choice("ab<>& é\n") for _ in range(r.choice([0, 3, 50, 3000]))) for _ in range(60)]
    plain = "<dump>\n"
    for i, t in enumerate(texts):
        plain += f"<page a='b'>\n<id>{i}</id><text>{t.replace('&', '&amp;').replace('<', '&lt;').replace('>', '&gt;')}</text>\n</page>\n between "
    plain += "</dump>"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(plain)
    (tmp_path / "in" / "b.xml.bz2").write_bytes(bz2.compress(plain.encode()))
    found = read_records(spark, f"file://{tmp_path}/in")
    assert found.rdd.getNumPartitions() > 20
    rows = found.select("file", field(F.col("record"), "id").cast("int").alias("id"), field(F.col("record"), "text").alias("text"), field(F.col("record"), "none").alias("none")).collect()
    for name in ("a.xml", "b.xml.bz2"):
        assert sorted((r["id"], r["text"]) for r in rows if r["file"].endswith(name)) == list(enumerate(texts))
    assert all(r["none"] is None for r in rows)


def test_escaping_is_taken_back(spark):
    rows = spark.createDataFrame([(t,) for t in ("", "a<b>&amp;\"'&lt;", "\n x ")], "t string")
    back = rows.select("t", field(F.concat(F.lit("<x>"), escaped(F.col("t")), F.lit("</x>")), "x").alias("u"))
    assert back.where("t <> u").count() == 0 and back.where("u is not null").count() == 3


def made(r: random.Random, deep: int, layer: str = "text") -> tuple[str, list[tuple[str, str]]]:
    """Markup and the (layer, text) that it says."""
    markup, said = "", []
    for _ in range(r.randint(1, 4)):
        word = r.choice(["ab", "c d", "é", "x = y", "1"])
        kind = r.randrange(6 if deep else 2)
        if kind < 2:
            markup, said = markup + word, [*said, (layer, word)]
        elif kind == 2:
            name = r.choice(["note", "small", "gloss"])
            inner, inside = made(r, deep - 1, f"{layer}/{name}")
            markup, said = markup + "{{" + name + "|" + inner + "}}", said + inside
        elif kind == 3:
            name = r.choice(["ref", "commentary"])
            inner, inside = made(r, deep - 1, f"{layer}/{name}")
            markup, said = markup + f'<{name} n="1">' + inner + f"</{name}>", said + inside
        elif kind == 4:
            markup, said = markup + f"[[target|{word}]]", [*said, (layer, word)]
        else:
            markup += "<!-- {{ [[ -->"
    return markup, said


def test_nested_layers():
    r = random.Random(2)
    for _ in range(500):
        markup, said = made(r, 4)
        wanted: list[tuple[str, str]] = []
        for layer, text in said:
            if wanted and wanted[-1][0] == layer:
                wanted[-1] = (layer, wanted[-1][1] + text)
            else:
                wanted.append((layer, text))
        assert [(layer, text) for _, layer, text in segments_of(markup)] == wanted, markup


@pytest.mark.parametrize(
    "markup, found",
    [
        (None, []),
        ("", []),
        (" \n", []),
        ("== H ==\nx\n=== K ===\ny\n== L ==\nv", [("H", "text", "\nx\n"), ("H / K", "text", "\ny\n"), ("L", "text", "\nv")]),
        ("{{Infobox}}a", [("", "text", "a")]),
        ("{{note|open", [("", "text/note", "open")]),
        ("a }} ]] </ref> | b <b>", [("", "text", "a }} ]] </ref> | b <b>")]),
        ("<note>n</wrong></note>t<small/>", [("", "text/note", "n</wrong>"), ("", "text", "t")]),
        ("<!-- never ends {{note|", []),
    ],
)
def test_edges_of_markup(spark, markup, found):
    rows = segments(spark.createDataFrame([(1, markup), (1, markup)], "page int, markup string")).collect()
    assert sorted((r["seq"], r["path"], r["layer"], r["text"]) for r in rows) == sorted((i, *f) for i, f in enumerate(found) for _ in range(2))


def test_long_and_deep_markup():
    assert segments_of("{{note|" * 3000 + "x" + "}}" * 3000) == [("", "text" + "/note" * 3000, "x")]
    assert segments_of("word " * 200_000)[0][2] == "word " * 200_000


def page(r: random.Random, columns: int, heading: bool, footer: bool):
    """Boxes in reading order."""
    out, y = [], 0.0
    width = columns * 200 + (columns - 1) * 40
    if heading:
        out += [(x, y, x + 44, y + 14) for x in range(0, width - 40, 50)]
        y += 24
    below = y
    for c in range(columns):
        y2 = y
        for _ in range(r.randint(2, 9)):
            out += [(c * 240 + x, y2 + r.uniform(-1, 1), c * 240 + x + 35, y2 + 10 + r.uniform(-1, 1)) for x in range(0, 40 * r.randint(1, 5), 40)]
            y2 += 14
        below = max(below, y2)
    if footer:
        out += [(x, below + 20, x + 44, below + 32) for x in range(0, width - 40, 50)]
    return out


def test_pages_come_back_in_order(spark):
    r = random.Random(3)
    rows, wanted = [], {}
    for p in range(60):
        boxes = page(r, r.choice([1, 2, 3]), r.random() < 0.5, r.random() < 0.5)
        ids = r.sample(range(10_000), len(boxes))
        wanted[p] = ids
        rows += [(p, i, *map(float, b)) for i, b in zip(ids, boxes)]
    r.shuffle(rows)
    schema = "page int, box int, x0 double, y0 double, x1 double, y1 double"
    table = spark.createDataFrame([*rows, (99, 1, None, 0.0, 1.0, 1.0), (99, 2, 5.0, 0.0, 1.0, 1.0)], schema)
    found: dict = {}
    for b in reading_order(table).orderBy("page", "place").collect():
        found.setdefault(b["page"], []).append(b["box"])
    assert found == wanted
    turned = table.select("page", "box", (-F.col("y1")).alias("x0"), F.col("x0").alias("y0"), (-F.col("y0")).alias("x1"), F.col("x1").alias("y1"))
    found = {}
    for b in reading_order(turned, vertical=True).orderBy("page", "place").collect():
        found.setdefault(b["page"], []).append(b["box"])
    assert found == wanted
    assert reading_order(spark.createDataFrame([], schema)).collect() == []


def test_other_columns_go_along_with_boxes(spark):
    from sediment.operators.layout import reading_order

    rows = [("p", 2, 40.0, 0.0, 60.0, 10.0, "b"), ("p", 1, 0.0, 0.0, 20.0, 10.0, "a"), ("q", 7, 0.0, 0.0, 5.0, 5.0, None)]
    found = reading_order(spark.createDataFrame(rows, "page string, box long, x0 double, y0 double, x1 double, y1 double, word string"))
    assert {(r["page"], r["place"], r["word"]) for r in found.collect()} == {("p", 0, "a"), ("p", 1, "b"), ("q", 0, None)}
