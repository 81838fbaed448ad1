"""Documents as files: Markdown, CSV, plain text and JSON, a row for each file. A file holds one document, so its parts are
joined there; nothing larger is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import model

_BOM = "﻿"


def padded(cell: DataFrame) -> DataFrame:
    """The cells of rectangular tables: missing ones are empty and bear no marks (PRJ1)."""
    marks = cell.select("block_id", "row_pos", "col_pos", "cell_id", "struck", "uncertain")
    return model.normalize(cell).join(marks, ["block_id", "row_pos", "col_pos"], "left").withColumn("cell_id", F.coalesce("cell_id", F.lit(-1)))


def _joined(rows: DataFrame, keys: list[str], order: list[str], text: str, glue: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), glue).alias("text"))


def _stem(scan: DataFrame) -> DataFrame:
    return scan.select("scan_id", T.file_name(F.col("title")).alias("stem"), F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).alias("title"))


def markdown(scan: DataFrame, block: DataFrame, cell: DataFrame, pairs: DataFrame) -> DataFrame:
    """scan_id, file, text: each document with its title, a mark before each page where there are several, headings by level,
    tables with a line under their first row, pairs as a list after their page's blocks, other blocks as text (SNK3)."""
    page = F.coalesce("page_number", F.lit(1)).alias("page")
    lines = model.table_lines(padded(cell), "markdown")
    wide = cell.groupBy("block_id").agg((F.max("col_pos") + 1).alias("_w"), F.min("row_pos").alias("_first"))
    ruled = F.when(F.col("row_pos") == F.col("_first"), F.concat("line", F.lit("\n|"), F.repeat(F.lit("---|"), F.col("_w")))).otherwise(F.col("line"))
    tables = _joined(lines.join(wide, "block_id").withColumn("line", ruled), ["block_id"], ["row_pos"], "line", "\n").withColumnRenamed("text", "_table")
    plain = model.block_text(block, cell).select("block_id", "text")
    level = F.least(F.lit(6), F.coalesce("level", F.lit(1)) + F.when(F.col("title").isNotNull(), 1).otherwise(0))
    known = block.select("scan_id", page, F.coalesce("block_pos", F.lit(-1)).alias("pos"), "block_id", "type", "level", F.coalesce("text", F.lit("")).alias("_own"))
    known = known.join(plain, "block_id").join(tables, "block_id", "left").join(_stem(scan), "scan_id", "left")
    shown = F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("_own"))).otherwise(F.coalesce("_table", "text"))
    parts = known.select("scan_id", "page", F.lit(1).alias("part"), "pos", "block_id", F.concat(shown, F.lit("\n")).alias("text"))
    pair = F.concat(F.lit("- **"), F.coalesce("key", F.lit("")), F.lit(":** "), F.coalesce("value", F.lit("")))
    listed = _joined(pairs.where("scan_id is not null").select("scan_id", page, F.coalesce("pair_pos", F.lit(-1)).alias("pos"), "kv_id", pair.alias("_p")), ["scan_id", "page"], ["pos", "kv_id"], "_p", "\n")
    parts = parts.unionByName(listed.select("scan_id", "page", F.lit(2).alias("part"), F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("block_id"), F.concat("text", F.lit("\n")).alias("text")))
    pages = parts.select("scan_id", "page").distinct()
    several = pages.groupBy("scan_id").agg(F.count("*").alias("_n")).where("_n > 1").select("scan_id")
    marks = pages.join(several, "scan_id").select("scan_id", "page", F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("block_id"), F.concat(F.lit("<!-- page "), F.col("page").cast("string"), F.lit(" -->")).alias("text"))
    body = _joined(parts.unionByName(marks), ["scan_id"], ["page", "part", "pos", "block_id"], "text", "\n")
    out = body.join(_stem(scan), "scan_id", "left")
    whole = F.concat(F.coalesce(F.concat(F.lit("# "), F.col("title"), F.lit("\n\n")), F.lit("")), F.col("text"))
    return out.select("scan_id", F.concat(F.coalesce("stem", F.lit("scan")), F.lit(".md")).alias("file"), F.concat(T.strip(whole), F.lit("\n")).alias("text"))


def csv(scan: DataFrame, block: DataFrame, cell: DataFrame) -> DataFrame:
    """scan_id, file, entry, text: a document's only table as one file; each of several as an entry of a zip, by page and number;
    without tables the lines of its plain text. With a byte order mark and CRLF (SNK2)."""
    rows = _joined(model.table_lines(padded(cell), "csv"), ["block_id"], ["row_pos"], "line", "\r\n")
    numbered = model.table_ordinals(block, cell).join(rows, "block_id").withColumn("page", F.coalesce("page_number", F.lit(1)))
    count = numbered.groupBy("scan_id").agg(F.count("*").alias("_n"))
    entry = F.when(F.col("_n") > 1, F.concat(F.lit("page"), F.col("page").cast("string"), F.lit("_table"), F.col("n").cast("string"), F.lit(".csv")))
    tables = numbered.join(count, "scan_id").select("scan_id", entry.alias("entry"), "text")
    plain = model.plain_text(model.block_text(block, cell)).join(count, "scan_id", "left_anti")
    lines = F.array_join(F.transform(F.split("text", "\n"), T.csv_field), "\r\n")
    both = tables.unionByName(plain.select("scan_id", F.lit(None).cast("string").alias("entry"), lines.alias("text")))
    kind = F.when(F.col("entry").isNull(), ".csv").otherwise(".zip")
    named = both.join(_stem(scan).select("scan_id", "stem"), "scan_id", "left")
    return named.select("scan_id", F.concat(F.coalesce("stem", F.lit("scan")), kind).alias("file"), "entry", F.concat(F.lit(_BOM), "text", F.lit("\r\n")).alias("text"))


def text(scan: DataFrame, block: DataFrame, cell: DataFrame) -> DataFrame:
    """scan_id, file, text (SNK4)."""
    out = model.plain_text(model.block_text(block, cell)).join(_stem(scan), "scan_id", "left")
    return out.select("scan_id", F.concat(F.coalesce("stem", F.lit("scan")), F.lit(".txt")).alias("file"), "text")


def json(scan: DataFrame, block: DataFrame, cell: DataFrame, pairs: DataFrame) -> DataFrame:
    """scan_id, file, text, signature: the whole tree of each document: title, language, pages, blocks, rows of cells, and the
    pairs of a page as a block of their own; nulls are left out (SNK5, PRJ20)."""
    one = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("uncertain", F.lit(False)).alias("uncertain"), F.coalesce("struck", F.lit(False)).alias("struck"))
    rows = padded(cell).groupBy("block_id", "row_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_pos", "cell_id", one.alias("c")))), lambda x: x["c"]).alias("r"))
    rows = rows.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_pos", "r"))), lambda x: x["r"]).alias("rows"))
    page = F.coalesce("page_number", F.lit(1)).alias("page_number")
    names = ["type", "text", "level", "items", "ordered", "checked", "uncertain", "confidence"]
    kv = pairs.where("scan_id is not null").groupBy("scan_id", page).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("pair_pos", F.lit(-1)).alias("p"), "kv_id", F.struct("key", "value", "uncertain").alias("v")))), lambda x: x["v"]).alias("pairs")
    )
    kind = dict(block.select(*names).dtypes)
    blocks = block.select("scan_id", page, F.coalesce("block_pos", F.lit(-1)).alias("pos"), "block_id", *names).join(rows, "block_id", "left").withColumn("pairs", F.lit(None).cast(dict(kv.dtypes)["pairs"]))
    own = kv.select("scan_id", "page_number", F.lit(2**31 - 1).alias("pos"), F.lit(0).cast("bigint").alias("block_id"), *[(F.lit("key_value") if n == "type" else F.lit(None).cast(kind[n])).alias(n) for n in names], F.lit(None).cast(dict(rows.dtypes)["rows"]).alias("rows"), "pairs")
    every = blocks.unionByName(own)
    pages = every.groupBy("scan_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block_id", F.struct(*names, "rows", "pairs").alias("b")))), lambda x: x["b"]).alias("blocks"))
    docs = pages.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "blocks"))).alias("pages"))
    out = docs.join(scan.select("scan_id", "title", "language", "handwritten"), "scan_id", "left").join(_stem(scan).select("scan_id", "stem"), "scan_id", "left")
    out = out.select("scan_id", F.concat(F.coalesce("stem", F.lit("scan")), F.lit(".json")).alias("file"), F.to_json(F.struct("title", "language", "handwritten", "pages")).alias("text"))
    return out.withColumn("signature", F.sha2("text", 256))


def export(fmt: str, scan: DataFrame, block: DataFrame, cell: DataFrame, pairs: DataFrame) -> DataFrame:
    """The files of a format: md, csv, txt or json; another one is an error (SNK1)."""
    if fmt in ("md", "json"):
        return {"md": markdown, "json": json}[fmt](scan, block, cell, pairs)
    if fmt in ("csv", "txt"):
        return {"csv": csv, "txt": text}[fmt](scan, block, cell)
    raise ValueError(f"unknown format: {fmt}")
