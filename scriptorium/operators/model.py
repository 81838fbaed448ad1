"""The document model as long tables: table shape, texts of blocks, and the text formats. All keep to built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def table_ordinals(block: DataFrame, cell: DataFrame) -> DataFrame:
    """scan_id, page_number, block_id, n: non-empty tables numbered within their page (PRJ2, WIN22)."""
    tables = block.where("type = 'table'").join(cell.select("block_id").distinct(), "block_id", "left_semi")
    n = F.row_number().over(W.partitionBy("scan_id", "page_number").orderBy("block_pos", "block_id"))
    return tables.select("scan_id", "page_number", "block_id", n.cast("bigint").alias("n"))


def normalize(cell: DataFrame) -> DataFrame:
    """block_id, row_pos, col_pos, text: every table padded to a rectangle with empty cells (PRJ1). The cells of a table are
    counted, not gathered; the missing places are generated and filled by a join."""
    shape = cell.groupBy("block_id").agg(F.max("col_pos").alias("w"))
    rows = cell.select("block_id", "row_pos").distinct().join(shape, "block_id")
    place = rows.select("block_id", "row_pos", F.explode(F.sequence(F.lit(0), "w")).alias("col_pos"))
    have = cell.select("block_id", "row_pos", "col_pos", "text")
    return place.join(have, ["block_id", "row_pos", "col_pos"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def header_rows(cell: DataFrame) -> DataFrame:
    """block_id, row_pos, kept, header: a row is kept if a cell has text; it is a header if no cell has a figure and some
    cell has a word of two letters (FLT10, FLT11)."""
    t = F.coalesce("text", F.lit(""))
    return cell.groupBy("block_id", "row_pos").agg(
        F.bool_or(T.strip(t) != "").alias("kept"), (F.bool_and(~t.rlike(r"\d")) & F.bool_or(t.rlike("[A-Za-z]{2}"))).alias("header")
    )


def numeric_columns(cell: DataFrame) -> DataFrame:
    """block_id, col_pos, n, hits, numeric: at least two filled cells, 60 per cent of them like numbers (FLT12)."""
    t = T.strip(F.col("text"))
    filled = cell.where(~F.col("is_header") & F.col("text").isNotNull() & (t != ""))
    g = filled.groupBy("block_id", "col_pos").agg(F.count("*").alias("n"), F.sum(t.rlike(r"^[\d.,+/ -]+$").cast("bigint")).alias("hits"))
    return g.withColumn("numeric", (F.col("n") >= 2) & (F.col("hits") * 10 >= F.col("n") * 6))


def column_widths(cell: DataFrame) -> DataFrame:
    """block_id, col_pos, width: longest line + 2, within 8 and 60 (SNK9, AGG23)."""
    longest = F.max(F.array_max(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.length)))
    return cell.groupBy("block_id", "col_pos").agg(F.greatest(F.lit(8), F.least(F.lit(60), longest + 2)).cast("bigint").alias("width"))


def strike_rows(cell: DataFrame) -> DataFrame:
    """cell_id, struck: a struck first cell strikes every cell with text in its row (AGG25)."""
    first = F.max(F.when(F.col("col_pos") == 0, F.coalesce("struck", F.lit(False)))).over(W.partitionBy("block_id", "row_pos"))
    return cell.select("cell_id", F.when(F.coalesce("text", F.lit("")) != "", F.coalesce("struck", F.lit(False)) | F.coalesce(first, F.lit(False))).otherwise(F.coalesce("struck", F.lit(False))).alias("struck"))


def table_lines(cell: DataFrame, fmt: str) -> DataFrame:
    """block_id, row_pos, line: a table's rows as csv, markdown or plain (tab) lines, cells in order (SNK2, SNK3, PRJ3)."""
    t = F.coalesce("text", F.lit(""))
    struck = F.coalesce("struck", F.lit(False)) & (t != "")
    if fmt == "csv":
        shown, glue, wrap = T.csv_field(t), ",", lambda c: c
    elif fmt == "markdown":
        m = T.markdown_cell(t)
        shown = F.concat(F.when(struck, F.concat(F.lit("~~"), m, F.lit("~~"))).otherwise(m), F.when(F.coalesce("uncertain", F.lit(False)), " ⚠").otherwise(""))
        glue, wrap = " | ", lambda c: F.concat(F.lit("| "), c, F.lit(" |"))
    else:
        shown, glue, wrap = F.when(struck, F.concat(F.lit("~~"), t, F.lit("~~"))).otherwise(t), "\t", lambda c: c
    cells = F.array_sort(F.collect_list(F.struct("col_pos", "cell_id", shown.alias("s"))))
    return cell.groupBy("block_id", "row_pos").agg(wrap(F.array_join(F.transform(cells, lambda x: x["s"]), glue)).alias("line"))


def block_text(block: DataFrame, cell: DataFrame) -> DataFrame:
    """scan_id, page_number, block_pos, block_id, text: the text of each block by its type (PRJ3)."""
    rows = table_lines(cell, "plain").groupBy("block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_pos", "line"))), lambda x: x["line"]), "\n").alias("_rows"))
    t = F.coalesce("text", F.lit(""))
    listed = F.array_join(F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda x, i: F.concat(F.when(F.coalesce("ordered", F.lit(False)), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("• "), F.coalesce(x, F.lit("")))), "\n")
    shown = (
        F.when(F.col("type") == "list", listed).when(F.col("type") == "table", F.coalesce("_rows", F.lit("")))
        .when(F.col("type") == "checkbox", F.concat(F.when(F.coalesce("checked", F.lit(False)), "[x] ").otherwise("[ ] "), t))
        .when(F.col("type").isin("signature", "figure"), T.strip(F.concat(F.lit("("), F.col("type"), F.lit(") "), t))).otherwise(t)
    )
    return block.join(rows, "block_id", "left").select("scan_id", "page_number", "block_pos", "block_id", shown.alias("text"))


def plain_text(texts: DataFrame) -> DataFrame:
    """scan_id, text: a document's block texts in order, a blank line between, trimmed (SNK4). The sink of one document is
    one row, so its blocks are joined there."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", "block_pos", "block_id", "text")))
    return texts.groupBy("scan_id").agg(T.strip(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")).alias("text"))


def heading_markdown(block: DataFrame, titled: bool = True) -> DataFrame:
    """block_id, line: headings with level marks, one deeper where the document has a title, six at most (SNK3)."""
    n = F.least(F.lit(6), F.coalesce("level", F.lit(1)) + int(titled))
    return block.where("type = 'heading'").select("block_id", F.concat(F.repeat(F.lit("#"), n), F.lit(" "), F.coalesce("text", F.lit(""))).alias("line"))


def content_rows(block: DataFrame, pairs: DataFrame) -> DataFrame:
    """page_number, type, field, value, uncertain: everything but tables, flattened (PRJ5)."""
    u = F.coalesce("uncertain", F.lit(False)).alias("uncertain")
    items = block.where("type = 'list'").select("page_number", "type", F.posexplode("items").alias("_p", "value"), u).select("page_number", "type", (F.col("_p") + 1).cast("string").alias("field"), "value", "uncertain")
    other = block.where("type not in ('list', 'table', 'key_value')").select("page_number", "type", F.lit("").alias("field"), F.col("text").alias("value"), u)
    kv = pairs.select("page_number", F.lit("key_value").alias("type"), F.col("key").alias("field"), "value", u)
    return items.unionByName(other).unionByName(kv)


def doubt_counts(block: DataFrame, cell: DataFrame, pairs: DataFrame) -> DataFrame:
    """scan_id, doubtful, tables, pages: doubtful cells, pairs and other blocks of a document (AGG10, AGG11)."""
    flag = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("bigint"))
    cells = cell.groupBy("block_id").agg(flag("uncertain").alias("c"))
    by = block.join(cells, "block_id", "left").groupBy("scan_id").agg(
        F.sum(F.when(F.col("type") == "table", F.coalesce("c", F.lit(0))).when(F.col("type") == "key_value", 0).otherwise(F.coalesce("uncertain", F.lit(False)).cast("bigint"))).alias("b"),
        F.sum((F.col("type") == "table").cast("bigint")).alias("tables"), F.count_distinct("page_number").alias("pages"),
    )
    kv = pairs.groupBy("scan_id").agg(flag("uncertain").alias("k"))
    return by.join(kv, "scan_id", "left").select("scan_id", (F.col("b") + F.coalesce("k", F.lit(0))).cast("bigint").alias("doubtful"), "tables", "pages")


def block_confidence(cell: DataFrame) -> DataFrame:
    """block_id, confidence, uncertain: least confidence, rounded half up to two places (missing counts as 1), any doubt (AGG8)."""
    return cell.groupBy("block_id").agg((F.floor(F.min(F.coalesce("conf", F.lit(1.0))) * 100 + 0.5) / 100).alias("confidence"), F.bool_or(F.coalesce("uncertain", F.lit(False))).alias("uncertain"))


def titles(block: DataFrame) -> DataFrame:
    """scan_id, title: the first line of the first heading, 80 characters (PRJ17)."""
    first = F.min_by("text", F.struct("page_number", "block_pos", "block_id"))
    heads = block.where("type = 'heading' and text is not null and page_number is not null and block_pos is not null")
    return heads.groupBy("scan_id").agg(F.substring(F.substring_index(first, "\n", 1), 1, 80).alias("title"))


def sheet_names(sheets: DataFrame, book: list[str], order: list[str]) -> DataFrame:
    """book, order, sheet: the sheets of each workbook in order, named by title (SNK8): forbidden marks as hyphens, 31 characters,
    `Sheet` where nothing is left, and the first free number where the name is taken already, also by another's numbered name.
    A fold over the sheets of one workbook, which are as many as a workbook holds."""
    base = F.substring(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\[\]:*?/\\]", "-"), 1, 31)
    base = F.when(base == "", "Sheet").otherwise(base)

    def name(i, b):  # noqa: ANN001, ANN202
        tail = F.concat(F.lit(" ("), i.cast("string"), F.lit(")"))
        return F.when(i == 1, b).otherwise(F.concat(F.substring(b, F.lit(1), 31 - F.length(tail)), tail))

    free = lambda used, b: F.filter(F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda i: name(i, b)), lambda x: ~F.array_contains(used, x))[0]
    listed = sheets.groupBy(*book).agg(F.array_sort(F.collect_list(F.struct(*order, base.alias("_base")))).alias("_all"))
    named = F.aggregate("_all", F.array().cast("array<string>"), lambda used, s: F.array_append(used, free(used, s["_base"])))
    flat = listed.withColumn("_names", named).select(*book, F.inline(F.arrays_zip("_all", "_names")))
    return flat.select(*book, *[F.col("_all")[c].alias(c) for c in order], F.col("_names").alias("sheet"))
