import numpy as np
import pytest

from scriptorium.operators import layout

SCHEMA = "page bigint, line_id bigint, text string, x0 double, x1 double, y0 double, y1 double, slope double"


def line(i, text, x, y, w=None, h=20, slope=None, page=1):
    return (page, i, text, float(x), float(x + (10 * len(text) if w is None else w)), float(y), float(y + h), slope)


def frame(spark, rows):
    return spark.createDataFrame([line(i, *r) for i, r in enumerate(rows)], SCHEMA)


def blocks(spark, rows):
    return sorted(layout.layout(frame(spark, rows)).collect(), key=lambda r: r.pos)


def test_heading_form_table_list_paragraph(spark):
    rows = [("Big title", 0, 0, None, 40), ("Date: 4 May", 0, 70), ("From: Harbour", 0, 100)]
    rows += [(f"c{r}{c}", 200 * c, 160 + 30 * r) for r in range(3) for c in range(3)]
    rows += [("- first", 0, 300), ("- second", 0, 330), ("[x] checked", 0, 380), ("running text here", 0, 440), ("goes on below", 0, 465)]
    got = blocks(spark, rows)
    assert [b.type for b in got] == ["heading", "key_value", "table", "list", "checkbox", "paragraph"]
    assert got[2].text.splitlines()[1] == "c10\tc11\tc12" and got[3].text == "first\nsecond" and got[3].ordered is False
    assert got[0].level == 1 and got[4].checked and got[4].text == "checked" and got[1].text == "Date: 4 May\nFrom: Harbour"


def test_labels_with_values_in_a_column_stand_apart_from_data(spark):
    rows = [("Monthly report", 100, 40, 500, 80), ("Name:", 100, 200, 120, 40), ("Ayesha", 400, 200, 160, 40), ("Date:", 100, 260, 120, 40), ("07/08/2026", 400, 260, 220, 40)]
    for k, r in enumerate([("Item", "Qty", "Price"), ("Pencils", "12", "0.75"), ("Ink", "3", "4.20")]):
        rows += [(t, x, 400 + 60 * k, 90, 40) for t, x in zip(r, (100, 500, 800))]
    rows += [("- pens", 100, 700, 140, 40), ("- tape", 100, 760, 140, 40), ("Budget approved: $12,450.75 total.", 100, 900, 700, 40), ("Call Sarah about it.", 100, 950, 420, 40)]
    got = blocks(spark, rows)
    assert [b.type for b in got] == ["heading", "key_value", "table", "list", "paragraph"]
    assert got[1].text == "Name: Ayesha\nDate: 07/08/2026" and got[2].text == "Item\tQty\tPrice\nPencils\t12\t0.75\nInk\t3\t4.20"
    assert got[4].text == "Budget approved: $12,450.75 total.\nCall Sarah about it."


def test_fields_two_on_a_line_leaders_and_a_lone_colon(spark):
    rows = [
        ("Pick list : 93.001774278.8", 100, 100, 520, 30), ("Supervisor :", 100, 140, 240, 30), ("LFS", 360, 140, 60, 30), ("Work pack. :", 100, 180, 240, 30), ("748322", 360, 180, 130, 30),
        ("Ship. Meth.:", 100, 260, 240, 30), ("Order", 700, 260, 100, 30), (".:", 830, 262, 30, 30), ("Tour . . . : Product. no:", 100, 300, 700, 30), ("at 12:30 sharp", 100, 400, 300, 30),
    ]
    got = sorted(layout.form_fields(frame(spark, rows)).collect(), key=lambda r: r.row)
    assert [(r.key, r.value) for r in got] == [("Pick list", "93.001774278.8"), ("Supervisor", "LFS"), ("Work pack.", "748322"), ("Ship. Meth.", ""), ("Order", ""), ("Tour", ""), ("Product. no", "")]
    assert blocks(spark, rows)[0].type == "key_value"


def test_lines_above_each_other_are_rows_of_their_own(spark):
    got = layout.visual_rows(frame(spark, [("left one", 0, 0), ("right", 200, 3), ("left two", 5, 8), ("below", 0, 60)])).collect()
    assert {r.line_id: r.row for r in got} == {0: 0, 1: 0, 2: 1, 3: 2}


def test_curled_page_is_flattened(spark):
    slope = lambda x: 0.1 * (1 - x / 1400)
    at = lambda y, x: y + 0.1 * (x - 100) - 0.1 * (x * x - 100 * 100) / 2800
    rows = []
    for r in range(8):
        for t, x, w in ((f"CODE-{r}1", 100, 200), (f"{r}0{r}", 600, 90), (f"{r}.000 PCS", 1100, 200)):
            rows.append((t, x, at(100 + r * 45, x + w / 2) - 15, w, 30, slope(x + w / 2)))
    flat = layout.flattened(frame(spark, rows))
    got = layout.visual_rows(flat).groupBy("row").count().collect()
    assert sorted((r.row, r["count"]) for r in got) == [(i, 3) for i in range(8)]
    as_dict = [dict(zip(("page", "line_id", "text", "x0", "x1", "y0", "y1", "slope"), line(i, *r))) for i, r in enumerate(rows)]
    v = layout.fit_curl(as_dict)
    assert np.ptp(v.reshape(8, 3), axis=1).max() < 2 and layout.fit_curl(as_dict[:5]) is None
    moved = layout.fit_curl([o | {"x0": o["x0"] + 900, "x1": o["x1"] + 900} for o in as_dict])
    assert np.allclose(v, moved, atol=1e-6)  # a left margin moves nothing


def test_reading_order():
    boxes = [{"x0": 50, "y0": 4}, {"x0": 0, "y0": 9}, {"x0": 0, "y0": 40}]
    assert [b["x0"] for b in layout.reading_order(boxes)] == [0, 50, 0]


@pytest.mark.parametrize("n", [0, 50])
def test_pages_are_kept_apart(spark, n):
    rows = [line(i, "word", 0, 30 * i, page=p) for p in range(n) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert layout.visual_rows(df).count() == 3 * n and layout.layout(df).count() == n and layout.flattened(df).count() == 3 * n
