import datetime as dt

from pyspark.sql import functions as F

from scriptorium.operators import geometry as G
from scriptorium.operators import history as H
from scriptorium.operators import model as M
from scriptorium.operators import quality as Q


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_medians_differ(spark):
    d = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4, None)], "k int, v bigint")
    assert rows(G.upper_median(d, ["k"], "v"), "median") == [(3,)] and d.agg(F.median("v")).first()[0] == 2.5
    w = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 9, 5)], "k int, v bigint, w bigint")
    assert rows(G.weighted_median(w, ["k"], "v", "w"), "median") == [(9,)]


def test_column_starts_keep_their_anchor(spark):
    d = spark.createDataFrame([(1, x) for x in (0, 5, 10, 15, 40)], "page bigint, x0 bigint")
    assert rows(G.column_starts(d, ["page"], 10), "start") == [(0,), (15,), (40,)]


def test_sequence_repair(spark):
    d = spark.createDataFrame([(1, 1, 2), (1, 2, 7), (1, 3, 4), (1, 4, None)], "page int, id int, v int")
    assert [r[1] for r in rows(G.repair_sequence(d, ["page"], "id", "v"), "id", "expected")] == [2, 3, 4, 5]


def test_collapse_and_numeric_fix(spark):
    d = spark.createDataFrame([(1, i, c) for i, c in enumerate("-hh-el-llo")], "page int, t int, best string")
    assert rows(G.collapse_repeats(d, ["page"], "-"), "text") == [("hello",)]
    glyphs = [(k, i, c, {"s": "5", "S": "5"}.get(c), 0.5 if c in "sS" else 0.0) for k, t in enumerate(["202s", "A4 12", "1990s"]) for i, c in enumerate(t)]
    glyphs = [(k, i, c, a, 0.001 if k == 2 else p) for k, i, c, a, p in glyphs]
    got = rows(Q.fix_numeric_tokens(spark.createDataFrame(glyphs, "k int, pos int, c string, alt string, alt_p double"), ["k"]), "k", "text", "flagged")
    assert got == [(0, "2025", True), (1, "A4 12", False), (2, "1990s", False)]


def test_harmonize(spark):
    cells = [("KYB5540", 0.9), ("KYBS540", 0.6), ("KY85540", 0.88), ("ABCDEFG", 0.2)]
    got = {r.text: r for r in Q.harmonize(spark.createDataFrame([(1, *c) for c in cells], "page int, text string, conf double"), ["page"]).collect()}
    assert got["KYBS540"].reading == "KYB5540" and got["KYB5540"].reading == "KYB5540" and got["KYB5540"].flagged and "ABCDEFG" not in got


def test_history(spark):
    t = dt.datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, t, "a"), (2, t, "b")], "id int, created timestamp, title string")
    b = spark.createDataFrame([(1, t + dt.timedelta(1), "c")], "id int, created timestamp, title string")
    u = H.upsert(a, b, "id", ["created"])
    assert rows(u, "id", "title") == [(1, "c"), (2, "b")] and rows(H.retain(u, "created", 1, "id"), "id") == [(1,)]
    assert H.search(u, "", "title").count() == 2 and rows(H.search(u, " C", "title"), "id") == [(1,)] and rows(H.delete(u, b, "id"), "id") == [(2,)]


def test_tables(spark):
    c = spark.createDataFrame([(1, 9, 0, 0, "Item", True, False, False, 1.0), (2, 9, 0, 1, "Qty", True, False, False, None), (3, 9, 1, 0, "a,b", False, False, True, 0.505), (4, 9, 2, 1, None, False, True, False, 0.9)], "cell_id int, block_id int, row_pos int, col_pos int, text string, is_header boolean, uncertain boolean, struck boolean, conf double")
    assert M.normalize(c).count() == 6 and rows(M.header_rows(c), "row_pos", "kept", "header") == [(0, True, True), (1, True, False), (2, False, False)]
    assert ("\"a,b\"",) in rows(M.table_lines(c, "csv"), "line") and ("| ~~a,b~~ |",) in rows(M.table_lines(c, "markdown"), "line")
    assert rows(M.block_confidence(c), "confidence", "uncertain") == [(0.51, True)]
    assert M.normalize(c.limit(0)).count() == 0 and M.table_lines(c.limit(0), "csv").count() == 0


def test_grid_half_open(spark):
    p = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 20, 5), (1, 3, 9, 5)], "page bigint, id bigint, x bigint, y bigint")
    cols = spark.createDataFrame([(1, 1, 10, 20)], "page bigint, c bigint, x0 bigint, x1 bigint")
    rws = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "page bigint, r bigint, y0 bigint, y1 bigint")
    taken = G.grid_cells(p, cols, rws)
    assert rows(taken, "id") == [(1,)] and rows(G.empty_cells(cols, rws, taken), "r") == [(1,)]


def test_cuts_and_bands(spark):
    f = spark.createDataFrame([(1, 0), (1, 100)], "page int, x bigint")
    loose = spark.createDataFrame([(1, x) for x in (3, 20, 24, 28, 99)] + [(2, 5)], "page int, x bigint")
    assert rows(G.cuts(f, loose, 5), "page", "x") == [(1, 0), (1, 20), (1, 28), (1, 100), (2, 5)]
    b = spark.createDataFrame([(1, i, i % 2) for i in range(8)] + [(2, i, i) for i in range(8)], "page int, i int, v int")
    assert rows(G.bands(b, ["page"], "i", "v"), "page", "banded") == [(1, True), (2, False)]
