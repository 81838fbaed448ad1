"""Page layout as windows over the lines of a page: visual rows, labelled fields, blocks. All keep to built-in functions but the
fit of a curled page, which needs least squares.

A page holds what one sheet of paper can hold, so a window over a page is bounded; pages are spread by their key. Lines have
(page, line_id, text, x0, x1, y0, y1) and, where a page may be curled, slope. The operators are set-based: rows are islands of
centres in order of height, and a paragraph's drift is measured from row to row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import geometry

#: Marks between the pieces of a row: near ones, and ones ten heights apart; a time's colon; the begin and end of a label.
NEAR, FAR, TIME, LABEL, VALUE = "\x1f", "\x1c", "\x1b", "\x1e", "\x1d"
#: A label is one to four words that begin with a letter, with a colon (perhaps after dots) or with dot leaders
#: at the end of its piece.
LABEL_WORD = r"[A-Za-z][A-Za-z0-9.#/()'&-]*"
LABELLED = rf"(?:^|[ {NEAR}{FAR}])({LABEL_WORD}(?: {LABEL_WORD}){{0,3}})(?: *(?:[.][. ]*)?:|( *[.]{{2,}} *)([{NEAR}{FAR}]|$))"


def fit_curl(page: list[dict]) -> np.ndarray | None:
    """Flat centre heights of a curled page's lines, or None (LAY6, AGG14, AGG15): slopes of at least eight long lines are
    fitted by 1, x, y and xy; the fit counts if the slopes' RMS is at least 0.02 and the residual's at most 40 per cent of it.
    The lines are moved along the fitted slope field to the height they have at the page's left edge."""
    long = [o for o in page if o.get("slope") is not None]
    if len(long) < 8:
        return None
    mid = lambda items, a, b: np.array([(o[a] + o[b]) / 2 for o in items], float)
    x, y, s = mid(long, "x0", "x1"), mid(long, "y0", "y1"), np.array([o["slope"] for o in long], float)
    a = np.stack([np.ones_like(x), x, y, x * y], 1)
    scale = np.maximum(np.abs(a).max(0), 1)
    c = np.linalg.lstsq(a / scale, s, rcond=None)[0] / scale
    raw, rest = np.sqrt((s**2).mean()), np.sqrt(((s - a @ c) ** 2).mean())
    if raw < 0.02 or rest > 0.4 * raw:
        return None
    px, py, left = mid(page, "x0", "x1"), mid(page, "y0", "y1"), min(o["x0"] for o in page)
    return py - (c[0] + c[2] * py) * (px - left) - (c[1] + c[3] * py) * (px**2 - left**2) / 2


def flattened(lines: DataFrame, key: str = "page") -> DataFrame:
    """`lines` (with slope) with v, the centre's height on the flat page: fitted page by page where a page is curled (LAY6)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out(page: list[dict]) -> Iterator[pa.RecordBatch]:
            if page:
                flat = fit_curl(page)
                v = flat.tolist() if flat is not None else [(o["y0"] + o["y1"]) / 2 for o in page]
                yield pa.RecordBatch.from_pydict({key: [o[key] for o in page], "line_id": [o["line_id"] for o in page], "v": v})

        for b in batches:
            for o in b.to_pylist():
                if held and o[key] != held[0][key]:
                    yield from out(held)
                    held = []
                held.append(o)
        yield from out(held)

    narrow = lines.select(key, "line_id", "x0", "x1", "y0", "y1", "slope").repartition(key).sortWithinPartitions(key, "line_id")
    return lines.join(narrow.mapInArrow(run, f"{key} bigint, line_id bigint, v double"), [key, "line_id"])


def placed(lines: DataFrame, key: str = "page") -> DataFrame:
    """Each line with h, body (the page's upper median height), v and row, its visual row from the top (WIN8, LAY8).

    Lines in order of v are in one band until v jumps by more than 0.3 body heights and half of the lower line; lines of a band
    that overlap sidewise by more than half of the line stand above each other and go to rows of their own."""
    base = lines.withColumn("h", F.col("y1") - F.col("y0"))
    base = base if "v" in base.columns else base.withColumn("v", (F.col("y0") + F.col("y1")) / 2)
    body = geometry.upper_median(base, [key], "h").select(key, F.when(F.col("median") == 0, 20).otherwise(F.col("median")).alias("body"))
    order = ["v", "x0", "line_id"]
    w = W.partitionBy(key).orderBy(*order)
    far = F.col("v") - F.lag("v").over(w) > F.greatest(0.3 * F.col("body"), 0.5 * F.least(F.col("h"), F.lag("h").over(w)))
    bands = geometry.islands(base.join(body, key), [key], order, far, "_band")
    side = W.partitionBy(key, "_band").orderBy("x0", "line_id")
    reach = F.max("x1").over(side.rowsBetween(W.unboundedPreceding, -1))
    heaps = geometry.islands(bands, [key, "_band"], ["x0", "line_id"], reach - F.col("x0") <= 0.5 * (F.col("x1") - F.col("x0")), "_heap")
    deep = heaps.withColumn("_deep", F.row_number().over(W.partitionBy(key, "_band", "_heap").orderBy(*order)))
    row = F.dense_rank().over(W.partitionBy(key).orderBy("_band", "_deep")) - 1
    return deep.withColumn("row", row.cast("bigint")).drop("_band", "_heap", "_deep")


def rows(lines: DataFrame, key: str = "page") -> DataFrame:
    """page, row, y0, y1, h, body, pieces (text, x0, x1 from left to right), text, marked (the pieces with NEAR or FAR between)."""
    ln = placed(lines, key).withColumn("_h", F.median("h").over(W.partitionBy(key, "row")))
    w = W.partitionBy(key, "row").orderBy("x0", "line_id")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    piece = geometry.islands(ln, [key, "row"], ["x0", "line_id"], F.col("x0") - reach >= 0.5 * F.col("_h"), "_piece")
    words = F.array_sort(F.collect_list(F.struct("x0", "line_id", "text")))
    piece = piece.groupBy(key, "row", "_piece").agg(
        F.array_join(F.transform(words, lambda p: p["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.first("_h").alias("h"), F.first("body").alias("body"),
    )
    got = piece.groupBy(key, "row").agg(
        F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.first("h").alias("h"), F.first("body").alias("body"),
        F.array_sort(F.collect_list(F.struct("_piece", "text", "x0", "x1"))).alias("pieces"),
    )
    glue = lambda p, i: F.when(i == 0, p["text"]).otherwise(F.concat(F.when(p["x0"] - F.get("pieces", i - 1)["x1"] < 10 * F.col("h"), NEAR).otherwise(FAR), p["text"]))
    return got.withColumns({"text": F.array_join(F.transform("pieces", lambda p: p["text"]), " "), "marked": F.array_join(F.transform("pieces", glue), "")})


def with_fields(rows: DataFrame) -> DataFrame:
    """`rows` with fields (key, value) and begins, whether the row begins with a label (STR6). A label without a value takes the
    next piece if that is near."""
    m = F.regexp_replace("marked", rf"[{NEAR}{FAR}][. ]*:", " :")  # a colon read on its own
    m = F.regexp_replace(F.regexp_replace(m, r":(\d)", rf"{TIME}$1"), LABELLED, rf"{LABEL}$1{VALUE}$3")
    parts = F.split(m, LABEL)
    back = lambda c: F.trim(F.replace(c, F.lit(TIME), F.lit(":")))

    def field(p):  # noqa: ANN001, ANN202
        label, rest = F.substring_index(p, VALUE, 1), F.substring_index(p, VALUE, -1)
        piece = F.split(rest, f"[{NEAR}{FAR}]")
        own = back(piece[0])
        value = F.when((own == "") & F.ltrim(rest).startswith(NEAR), back(F.get(piece, F.lit(1)))).otherwise(own)
        return F.struct(back(F.regexp_replace(label, r"[ ]*[.]{2,}$", "")).alias("key"), value.alias("value"))

    fields = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), field)
    return rows.withColumns({"fields": fields, "begins": (F.size(parts) > 1) & (F.trim(parts[0]) == "")})


def visual_rows(lines: DataFrame, key: str = "page") -> DataFrame:
    """page, row, line_id."""
    return placed(lines, key).select(key, "row", "line_id")


def form_fields(lines: DataFrame, key: str = "page") -> DataFrame:
    """page, row, key, value: the labelled fields of each row."""
    return with_fields(rows(lines, key)).select(key, "row", F.inline("fields"))


def layout(lines: DataFrame, key: str = "page") -> DataFrame:
    """page, pos, type, text, rows, level, checked, ordered: the blocks of each page (LAY1).

    Forms are runs of rows that begin with a label, with at least two such rows and two fields, one stray row between two of
    them allowed (WIN13). Of the other rows, runs of at least two with several pieces are tables (WIN10), unless they are a
    label with its value (WIN24), which go with the lines of key and value; checkboxes stand alone, bullets make lists
    (WIN11), at least two lines of key and value a form (WIN12); rows over 1.35 body heights and under 80 characters are
    headings (FLT19), of level 1 over 1.8; the rest are paragraphs, cut at gaps over 1.2 body heights and where a row begins
    over 4 body heights aside (WIN14)."""
    w = W.partitionBy(key).orderBy("row")
    gap = F.col("y0") - F.lag("y1").over(w)
    r = with_fields(rows(lines, key)).withColumns({"_gap": gap, "_n": F.size("pieces"), "_field": F.col("begins") & (F.size("fields") > 0)})
    stray = (F.col("_n") == 1) & F.lag("_field").over(w) & F.lead("_field").over(w)
    r = r.withColumn("_form", F.col("_field") | F.coalesce(stray, F.lit(False)))
    r = geometry.islands(r, [key], ["row"], (F.col("_form") != F.lag("_form").over(w)) | (F.col("_gap") >= 3 * F.col("body")), "_run")
    run = W.partitionBy(key, "_run")
    fields = F.sum(F.when(F.col("_field"), F.size("fields")).otherwise(0)).over(run)
    r = r.withColumn("_form", F.col("_form") & (F.sum(F.col("_field").cast("int")).over(run) >= 2) & (fields >= 2))

    kind = T.line_class(F.col("text"))
    labelled = (F.col("_n") == 2) & F.col("pieces")[0]["text"].rlike("[:=] *$")
    tall = (F.col("h") > 1.35 * F.col("body")) & (F.length("text") < 80)
    plain = F.when(kind.isin("checkbox", "bullet"), kind).when(tall, "heading").otherwise("paragraph")
    first = (
        F.when(F.col("_form"), "form").when(labelled, "pair").when(F.col("_n") >= 2, "table")
        .when((kind == "key_value") & (F.col("_n") == 1), "pair").otherwise(plain)
    )
    r = r.withColumns({"_labelled": labelled, "_plain": plain, "_kind": first})
    change = (F.col("_kind") != F.lag("_kind").over(w)) | (F.col("_gap") >= 3 * F.col("body"))
    r = geometry.islands(r, [key], ["row"], change, "_run")
    lone = F.col("_kind").isin("table", "pair") & (F.count("*").over(run) < 2)
    r = r.withColumn("_kind", F.when(lone, F.col("_plain")).otherwise(F.col("_kind")))
    left = F.col("pieces")[0]["x0"]
    r = r.withColumn("_left", left)
    cut = (F.col("_kind") != F.lag("_kind").over(w)) | F.col("_kind").isin("checkbox", "heading") | (F.col("_gap") >= F.when(F.col("_kind") == "paragraph", 1.2).otherwise(3.0) * F.col("body"))
    cut = cut | (F.col("_kind") == "paragraph") & (F.abs(F.col("_left") - F.lag("_left").over(w)) > 4 * F.col("body"))
    r = geometry.islands(r, [key], ["row"], cut, "_block")
    pair = F.when(F.col("_labelled"), F.concat(F.regexp_replace(F.col("pieces")[0]["text"], " *[:=] *$", ""), F.lit(": "), F.col("pieces")[1]["text"])).otherwise(F.regexp_replace("text", T.KEY_VALUE, "$1: $2"))
    shown = (
        F.when((F.col("_kind") == "form") & F.col("_field"), F.array_join(F.transform("fields", lambda f: F.concat(f["key"], F.lit(": "), f["value"])), "\n"))
        .when(F.col("_kind") == "table", F.array_join(F.transform("pieces", lambda p: p["text"]), "\t")).when(F.col("_kind") == "pair", pair)
        .when(F.col("_kind") == "checkbox", F.regexp_replace("text", T.CHECKBOX, "")).when(F.col("_kind") == "bullet", F.regexp_replace("text", T.BULLET, "")).otherwise(F.col("text"))
    )
    r = r.withColumns({"_shown": shown, "_ticked": F.regexp_extract("text", T.CHECKBOX, 1).rlike("[xX✓✔☑☒■]"), "_numbered": F.col("text").rlike(T.ORDERED)})
    out = r.groupBy(key, "_block", "_kind").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_shown"))), lambda x: x["_shown"]), "\n").alias("text"), F.count("*").alias("rows"),
        F.first(F.when(F.col("_kind") == "heading", F.when(F.col("h") > 1.8 * F.col("body"), 1).otherwise(2))).alias("level"),
        F.first(F.when(F.col("_kind") == "checkbox", F.col("_ticked"))).alias("checked"), F.bool_and(F.when(F.col("_kind") == "bullet", F.col("_numbered"))).alias("ordered"),
    )
    named = F.when(F.col("_kind").isin("form", "pair"), "key_value").when(F.col("_kind") == "bullet", "list").otherwise(F.col("_kind"))
    return out.select(key, (F.col("_block") - 1).alias("pos"), named.alias("type"), "text", "rows", "level", "checked", "ordered")


def reading_order(boxes: list[dict], near: float = 10) -> list[dict]:
    """Boxes of one page by top; a box no lower than `near` below the ones placed last goes before those further right (WIN16)."""
    placed_: list[dict] = []
    for box in sorted(boxes, key=lambda b: (b["y0"], b["x0"])):
        ahead = len(placed_)
        while ahead and box["y0"] - placed_[ahead - 1]["y0"] < near and box["x0"] < placed_[ahead - 1]["x0"]:
            ahead -= 1
        placed_.insert(ahead, box)
    return placed_
