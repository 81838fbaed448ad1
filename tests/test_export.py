import json

import pytest

from scriptorium.operators import export

SCAN = "scan_id bigint, title string, language string, handwritten boolean"
BLOCK = "block_id bigint, scan_id bigint, page_number int, block_pos int, type string, text string, level int, items array<string>, ordered boolean, checked boolean, uncertain boolean, confidence double"
CELL = "cell_id bigint, block_id bigint, row_pos int, col_pos int, text string, uncertain boolean, struck boolean"
PAIR = "kv_id bigint, scan_id bigint, page_number int, pair_pos int, key string, value string, uncertain boolean"


@pytest.fixture(scope="module")
def tables(spark):
    b = lambda i, s, p, pos, kind, text=None, level=None, items=None: (i, s, p, pos, kind, text, level, items, None, None, None, None)
    blocks = [b(1, 1, 1, 0, "heading", "Head", 1), b(2, 1, 1, 1, "table"), b(3, 1, 2, 0, "list", None, None, ["a", None]), b(4, 2, 1, 0, "paragraph", 'one, "two"\nthree'), b(5, 3, 1, 0, "table"), b(6, 3, 1, 1, "table")]
    cells = [(1, 2, 0, 0, "A|B", None, None), (2, 2, 0, 1, "n", None, None), (3, 2, 1, 0, "x\ny", True, True), (4, 5, 0, 0, "p", None, None), (5, 6, 0, 0, "q", None, None)]
    return (
        spark.createDataFrame([(1, "My: title", "en", True), (2, None, None, None), (3, "T", None, None)], SCAN), spark.createDataFrame(blocks, BLOCK),
        spark.createDataFrame(cells, CELL), spark.createDataFrame([(1, 1, 2, 0, "k", "v", None)], PAIR),
    )


def test_markdown(tables):
    got = {r.scan_id: (r.file, r.text) for r in export.export("md", *tables).collect()}
    assert got[1] == ("My title.md", "# My: title\n\n<!-- page 1 -->\n## Head\n\n| A\\|B | n |\n|---|---|\n| ~~x<br>y~~ ⚠ |  |\n\n<!-- page 2 -->\n• a\n• \n\n- **k:** v\n")
    assert got[2] == ("scan.md", 'one, "two"\nthree\n')


def test_csv_none_one_and_several_tables(tables):
    got = {(r.scan_id, r.entry): (r.file, r.text) for r in export.export("csv", *tables).collect()}
    assert got[2, None] == ("scan.csv", '\ufeff"one, ""two"""\r\nthree\r\n')
    assert got[1, None] == ("My title.csv", '\ufeffA|B,n\r\n"x\ny",\r\n')
    assert got[3, "page1_table1.csv"] == ("T.zip", "\ufeffp\r\n") and got[3, "page1_table2.csv"][1] == "\ufeffq\r\n"


def test_json_holds_the_whole_tree(tables):
    got = {r.scan_id: json.loads(r.text) for r in export.export("json", *tables).collect()}
    pages = got[1]["pages"]
    assert got[1]["title"] == "My: title" and [p["page_number"] for p in pages] == [1, 2]
    assert [[c["text"] for c in r] for r in pages[0]["blocks"][1]["rows"]] == [["A|B", "n"], ["x\ny", ""]] and pages[0]["blocks"][1]["rows"][1][0]["struck"]
    assert pages[1]["blocks"][1]["type"] == "key_value" and pages[1]["blocks"][1]["pairs"][0]["value"] == "v"


def test_text_and_unknown_formats(tables):
    assert {r.scan_id: r.file for r in export.export("txt", *tables).collect()} == {1: "My title.txt", 2: "scan.txt", 3: "T.txt"}
    with pytest.raises(ValueError, match="unknown format"):
        export.export("xls", *tables)
