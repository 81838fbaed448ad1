"""Registered queries of the core and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import eav, export, flatten, geometry, history, layout, model, quality
from scriptorium.plans import views as V
from scriptorium.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every non-null page, block, cell and pair of the documents, by position."""
    return flatten.flatten(table(spark, d, "extraction"), fields=False)


@query()
def p1_flat(spark: SparkSession, d: str) -> DataFrame:
    """The same with the fields of each element."""
    return flatten.flatten(table(spark, d, "extraction"))


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The value of each form's attributes, read back from the wide table."""
    attrs = table(spark, d, "form_attr")
    wide = eav.pivot(table(spark, d, "key_value"), attrs, table(spark, d, "scan"), typed=False)
    return eav.found(wide, [r.attr for r in attrs.select("attr").collect()])


@query()
def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    """One typed row per form; cast failures as JSON text."""
    wide = eav.pivot(table(spark, d, "key_value"), table(spark, d, "form_attr"), table(spark, d, "scan"))
    return wide.withColumn("failed", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("failed")))))


def _skeleton_sql(c: str) -> str:
    blank = eav.MARKS + eav.BLANKS
    return f"translate(replace(trim(regexp_replace(translate(lower({c}), '{blank}', '{' ' * len(blank)}'), ' {{2,}}', ' ', 'g')), 'rn', 'm'), '{eav.FROM}', '{eav.TO}')"


@query(f"""WITH w AS (SELECT label_en AS w FROM form_attr UNION ALL SELECT label_de FROM form_attr UNION ALL SELECT replace(attr, '_', ' ') FROM form_attr
UNION ALL SELECT unnest([{", ".join("'" + w.replace("'", "''") + "'" for ws in eav.WORDINGS.values() for w in ws)}]))
SELECT k AS key, count(*) AS n FROM (SELECT {_skeleton_sql("key")} AS k FROM key_value WHERE key IS NOT NULL) WHERE k NOT IN (SELECT {_skeleton_sql("w")} FROM w WHERE w IS NOT NULL) GROUP BY 1""")
def p3_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Keys that mean no attribute, and on how many rows."""
    return eav.unknown_keys(table(spark, d, "key_value"), table(spark, d, "form_attr"))


NUM = T.NUMBER
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(rf"""
WITH c AS (SELECT cell_id, {_STRIP.format("text")} AS s FROM cell WHERE text IS NOT NULL),
p AS (SELECT cell_id, s, regexp_extract(s, '{NUM}', 1) AS cur, regexp_extract(s, '{NUM}', 2) AS neg, regexp_extract(s, '{NUM}', 3) AS whole,
  regexp_extract(s, '{NUM}', 4) AS dec, regexp_extract(s, '{NUM}', 5) AS pct FROM c WHERE regexp_matches(s, '{NUM}')),
q AS (SELECT *, replace(whole, ',', '') AS plain, CASE WHEN whole LIKE '%,%' THEN '#,##0' ELSE '0' END || CASE WHEN dec <> '' THEN '.' || repeat('0', length(dec)) ELSE '' END AS body FROM p)
SELECT cell_id, CAST(neg || plain || CASE WHEN dec <> '' THEN '.' || dec ELSE '' END AS DOUBLE) / CASE WHEN pct = '%' THEN 100 ELSE 1 END AS value,
  CASE WHEN pct = '%' THEN body || '%' WHEN cur <> '' THEN '"' || cur || '"' || body ELSE body END AS format
FROM q WHERE NOT (length(whole) > 1 AND whole LIKE '0%') AND length(plain) <= 15""")
def typed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """STR1, STR2 over all cells."""
    value, form = T.typed_number(F.col("text"))
    return table(spark, d, "cell").select("cell_id", value.alias("value"), form.alias("format")).where("value is not null")


@query(r"""
SELECT block_id, col_pos, count(*) AS n, CAST(sum(CASE WHEN regexp_matches(s, '^[\d.,+/ -]+$') THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  count(*) >= 2 AND sum(CASE WHEN regexp_matches(s, '^[\d.,+/ -]+$') THEN 1 ELSE 0 END) * 10 >= count(*) * 6 AS "numeric"
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM cell WHERE NOT is_header AND text IS NOT NULL) WHERE s <> '' GROUP BY ALL""")
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    """FLT12."""
    return model.numeric_columns(table(spark, d, "cell"))


@query(r"""
SELECT block_id, row_pos, bool_or(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> '') AS kept,
  bool_and(NOT regexp_matches(coalesce(text, ''), '\d')) AND bool_or(regexp_matches(coalesce(text, ''), '[A-Za-z]{2}')) AS header FROM cell GROUP BY ALL""")
def header_rows(spark: SparkSession, d: str) -> DataFrame:
    """FLT10, FLT11."""
    return model.header_rows(table(spark, d, "cell"))


@query("""SELECT scan_id, page_number, block_id, row_number() OVER (PARTITION BY scan_id, page_number ORDER BY block_pos NULLS FIRST, block_id) AS n
FROM block WHERE type = 'table' AND block_id IN (SELECT block_id FROM cell)""")
def table_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """PRJ2, WIN22."""
    return model.table_ordinals(table(spark, d, "block"), table(spark, d, "cell"))


@query("""WITH s AS (SELECT block_id, max(col_pos) AS w FROM cell GROUP BY 1), r AS (SELECT DISTINCT block_id, row_pos FROM cell),
p AS (SELECT r.block_id, r.row_pos, CAST(unnest(range(w + 1)) AS INTEGER) AS col_pos FROM r JOIN s USING (block_id))
SELECT p.block_id, p.row_pos, p.col_pos, coalesce(c.text, '') AS text FROM p LEFT JOIN cell c ON c.block_id = p.block_id AND c.row_pos = p.row_pos AND c.col_pos = p.col_pos""")
def normalize_tables(spark: SparkSession, d: str) -> DataFrame:
    """PRJ1."""
    return model.normalize(table(spark, d, "cell"))


_ROWS = """t AS (SELECT block_id, row_pos, string_agg(CASE WHEN coalesce(struck, false) AND coalesce(text, '') <> '' THEN '~~' || text || '~~' ELSE coalesce(text, '') END, chr(9) ORDER BY col_pos, cell_id) AS line FROM cell GROUP BY 1, 2),
tt AS (SELECT block_id, string_agg(line, chr(10) ORDER BY row_pos) AS r FROM t GROUP BY 1),
li AS (SELECT block_id, string_agg(CASE WHEN coalesce(ordered, false) THEN i || '. ' ELSE '• ' END || coalesce(x, ''), chr(10) ORDER BY i) AS r FROM (SELECT block_id, ordered, unnest(items) AS x, unnest(range(1, len(items) + 1)) AS i FROM block) GROUP BY 1),
bt AS (SELECT b.scan_id, b.page_number, b.block_pos, b.block_id, CASE WHEN type = 'list' THEN coalesce(li.r, '') WHEN type = 'table' THEN coalesce(tt.r, '')
 WHEN type = 'checkbox' THEN CASE WHEN coalesce(checked, false) THEN '[x] ' ELSE '[ ] ' END || coalesce(text, '')
 WHEN type IN ('signature', 'figure') THEN regexp_replace('(' || type || ') ' || coalesce(text, ''), '^\\s+|\\s+$', '', 'g') ELSE coalesce(text, '') END AS text
 FROM block b LEFT JOIN li USING (block_id) LEFT JOIN tt USING (block_id))"""


@query(f"WITH {_ROWS} SELECT * FROM bt")
def block_text(spark: SparkSession, d: str) -> DataFrame:
    """PRJ3, JS variant: struck cells as ~~text~~ (D9)."""
    return model.block_text(table(spark, d, "block"), table(spark, d, "cell"))


@query(f"WITH {_ROWS} SELECT scan_id, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY page_number NULLS FIRST, block_pos NULLS FIRST, block_id), '^\\s+|\\s+$', '', 'g') AS text FROM bt GROUP BY 1")
def plain_text_export(spark: SparkSession, d: str) -> DataFrame:
    """SNK4."""
    return model.plain_text(model.block_text(table(spark, d, "block"), table(spark, d, "cell")))


@query("""SELECT page_number, type, CAST(unnest(range(1, len(items) + 1)) AS VARCHAR) AS field, unnest(items) AS value, coalesce(uncertain, false) AS uncertain FROM block WHERE type = 'list'
UNION ALL SELECT page_number, type, '', text, coalesce(uncertain, false) FROM block WHERE type NOT IN ('list', 'table', 'key_value')
UNION ALL SELECT page_number, 'key_value', key, value, coalesce(uncertain, false) FROM key_value""")
def content_rows(spark: SparkSession, d: str) -> DataFrame:
    """PRJ5."""
    return model.content_rows(table(spark, d, "block"), table(spark, d, "key_value"))


@query("""SELECT block_id, row_pos, '| ' || string_agg(CASE WHEN coalesce(struck, false) AND coalesce(text, '') <> '' THEN '~~' || m || '~~' ELSE m END || CASE WHEN coalesce(uncertain, false) THEN ' ⚠' ELSE '' END, ' | ' ORDER BY col_pos, cell_id) || ' |' AS line
FROM (SELECT *, replace(replace(coalesce(text, ''), '|', '\\|'), chr(10), '<br>') AS m FROM cell) GROUP BY 1, 2""")
def markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    """SNK3, rows of tables."""
    return model.table_lines(table(spark, d, "cell"), "markdown")


@query("SELECT block_id, repeat('#', CAST(least(6, coalesce(level, 1) + 1) AS INTEGER)) || ' ' || coalesce(text, '') AS line FROM block WHERE type = 'heading'")
def markdown_headings(spark: SparkSession, d: str) -> DataFrame:
    """SNK3, headings of titled documents."""
    return model.heading_markdown(table(spark, d, "block"))


@query("""SELECT block_id, row_pos, string_agg(CASE WHEN regexp_matches(t, '[",\\r\\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END, ',' ORDER BY col_pos, cell_id) AS line
FROM (SELECT *, coalesce(text, '') AS t FROM cell) GROUP BY 1, 2""")
def csv_export_lines(spark: SparkSession, d: str) -> DataFrame:
    """SNK2, STR11."""
    return model.table_lines(table(spark, d, "cell"), "csv")


@query("SELECT block_id, col_pos, CAST(greatest(8, least(60, max(n) + 2)) AS BIGINT) AS width FROM (SELECT block_id, col_pos, length(unnest(string_split(coalesce(text, ''), chr(10)))) AS n FROM cell) GROUP BY 1, 2")
def column_widths(spark: SparkSession, d: str) -> DataFrame:
    """SNK9, AGG23."""
    return model.column_widths(table(spark, d, "cell"))


@query(r"""SELECT scan_id, CASE WHEN f = '' THEN 'scan' ELSE f END AS name FROM (SELECT scan_id, substring(regexp_replace(regexp_replace(coalesce(title, ''), '[^\w\- ]+', '', 'g'), '^\s+|\s+$', '', 'g'), 1, 80) AS f FROM scan)""")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    """SNK19, ASCII variant (D12)."""
    return table(spark, d, "scan").select("scan_id", T.file_name(F.col("title")).alias("name"))


@query(r"""WITH RECURSIVE b AS (SELECT coalesce(device_id, '') AS book, scan_id, row_number() OVER (PARTITION BY coalesce(device_id, ''), CAST(created AS DATE) ORDER BY scan_id) AS k, coalesce(strftime(created, '%Y-%m-%d'), '') AS day,
  CASE WHEN coalesce(title, '') = '' THEN 'Sheet' ELSE substring(regexp_replace(title, '[\[\]:*?/\\]', '-', 'g'), 1, 31) END AS b FROM scan),
f AS (SELECT book, day, scan_id, k, b AS sheet, [b] AS used FROM b WHERE k = 1 UNION ALL
  SELECT book, day, scan_id, k, n AS sheet, list_append(used, n) AS used FROM (SELECT b.book, b.day, b.scan_id, b.k, f.used,
    list_filter(list_concat([b.b], list_transform(range(2, len(f.used) + 2), lambda i: left(b.b, CAST(31 - length(' (' || i || ')') AS INTEGER)) || ' (' || i || ')')), lambda x: NOT list_contains(f.used, x))[1] AS n
    FROM f JOIN b ON b.book = f.book AND b.day = f.day AND b.k = f.k + 1))
SELECT book, day, scan_id, sheet FROM f""")
def sheet_names_unique(spark: SparkSession, d: str) -> DataFrame:
    """SNK8: a device's scans of one day are the sheets of a workbook."""
    s = table(spark, d, "scan").select(F.coalesce("device_id", F.lit("")).alias("book"), F.coalesce(F.date_format("created", "yyyy-MM-dd"), F.lit("")).alias("day"), "scan_id", "title")
    return model.sheet_names(s, ["book", "day"], ["scan_id"])


@query("SELECT c.cell_id, CASE WHEN coalesce(c.text, '') <> '' THEN coalesce(c.struck, false) OR coalesce(f.s, false) ELSE coalesce(c.struck, false) END AS struck FROM cell c LEFT JOIN (SELECT block_id, row_pos, bool_or(coalesce(struck, false)) AS s FROM cell WHERE col_pos = 0 GROUP BY 1, 2) f USING (block_id, row_pos)")
def struck_rows(spark: SparkSession, d: str) -> DataFrame:
    """AGG25."""
    return model.strike_rows(table(spark, d, "cell"))


@query("SELECT block_id, floor(min(coalesce(conf, 1.0)) * 100 + 0.5) / 100 AS confidence, bool_or(coalesce(uncertain, false)) AS uncertain FROM cell GROUP BY 1")
def table_confidence(spark: SparkSession, d: str) -> DataFrame:
    """AGG8."""
    return model.block_confidence(table(spark, d, "cell"))


@query("SELECT scan_id, left(string_split(arg_min(text, (page_number, block_pos, block_id)), chr(10))[1], 80) AS title FROM block WHERE type = 'heading' AND text IS NOT NULL AND page_number IS NOT NULL AND block_pos IS NOT NULL GROUP BY 1")
def scan_titles(spark: SparkSession, d: str) -> DataFrame:
    """PRJ17, D13 JS variant."""
    return model.titles(table(spark, d, "block"))


@query("""WITH c AS (SELECT block_id, sum(CAST(coalesce(uncertain, false) AS INT)) AS c FROM cell GROUP BY 1), k AS (SELECT scan_id, sum(CAST(coalesce(uncertain, false) AS INT)) AS k FROM key_value GROUP BY 1),
b AS (SELECT scan_id, sum(CASE WHEN type = 'table' THEN coalesce(c, 0) WHEN type = 'key_value' THEN 0 ELSE CAST(coalesce(uncertain, false) AS INT) END) AS b, CAST(sum(CASE WHEN type = 'table' THEN 1 ELSE 0 END) AS BIGINT) AS tables, count(DISTINCT page_number) AS pages FROM block LEFT JOIN c USING (block_id) GROUP BY 1)
SELECT scan_id, CAST(b + coalesce(k, 0) AS BIGINT) AS doubtful, tables, pages FROM b LEFT JOIN k USING (scan_id)""")
def doubt_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG10, AGG11."""
    return model.doubt_counts(table(spark, d, "block"), table(spark, d, "cell"), table(spark, d, "key_value"))


_CLASS = rf"CASE WHEN regexp_matches(ltext, '{T.CHECKBOX}') THEN 'checkbox' WHEN regexp_matches(ltext, '{T.BULLET}') THEN 'bullet' WHEN regexp_matches(ltext, '{T.KEY_VALUE}') AND regexp_replace(regexp_extract(ltext, '{T.KEY_VALUE}', 1), '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_matches(regexp_extract(ltext, '{T.KEY_VALUE}', 1), '\d$') THEN 'key_value' ELSE 'text' END"
#: Lines of text, list items with a bullet and pairs as `key: value`: each class of line occurs.
_MIXED = rf"mixed AS (SELECT block_id AS page, line, ltext FROM lines UNION ALL SELECT -kv_id, CAST(0 AS BIGINT), key || ': ' || coalesce(value, '') FROM key_value WHERE key IS NOT NULL UNION ALL SELECT block_id + 1000000000000, CAST(unnest(range(len(items))) AS BIGINT), '- ' || unnest(items) FROM block WHERE items IS NOT NULL)"


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "block").where("items is not null").select((F.col("block_id") + 1000000000000).alias("page"), F.posexplode("items").alias("_i", "_t")).select("page", F.col("_i").cast("bigint").alias("line"), F.concat(F.lit("- "), "_t").alias("ltext"))
    pairs = table(spark, d, "key_value").where("key is not null").select((-F.col("kv_id")).alias("page"), F.lit(0).cast("bigint").alias("line"), F.concat("key", F.lit(": "), F.coalesce("value", F.lit(""))).alias("ltext"))
    return V.lines(spark, d).select(F.col("block_id").alias("page"), "line", "ltext").unionByName(pairs).unionByName(items)


@query(f"WITH {V.LINES}, {_MIXED} SELECT page, line, {_CLASS} AS class FROM mixed WHERE ltext IS NOT NULL")
def line_classes(spark: SparkSession, d: str) -> DataFrame:
    """FLT16, FLT18."""
    return _mixed(spark, d).where("ltext is not null").select("page", "line", T.line_class(F.col("ltext")).alias("class"))


@query(f"""WITH {V.LINES}, {_MIXED}, k AS (SELECT page, line, {_CLASS} AS class FROM mixed WHERE ltext IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN p = class THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY line) AS island FROM (SELECT *, lag(class) OVER (PARTITION BY page ORDER BY line) AS p FROM k))
SELECT page, min(line) AS first_line, count(*) AS n, class FROM i WHERE class <> 'text' GROUP BY page, island, class HAVING class = 'bullet' OR count(*) >= 2""")
def list_and_form_blocks(spark: SparkSession, d: str) -> DataFrame:
    """WIN11, WIN12: runs of bullets; runs of at least two pairs."""
    from pyspark.sql import Window as W

    k = _mixed(spark, d).where("ltext is not null").select("page", "line", T.line_class(F.col("ltext")).alias("class"))
    i = geometry.islands(k, ["page"], ["line"], F.lag("class").over(W.partitionBy("page").orderBy("line")) != F.col("class"))
    return i.where("class <> 'text'").groupBy("page", "island", "class").agg(F.min("line").alias("first_line"), F.count("*").alias("n")).where("class = 'bullet' or n >= 2").select("page", "first_line", "n", "class")


@query(f"WITH {V.WORDS} SELECT block_id, line, string_agg(wtext, ' ' ORDER BY x0, word) AS text, min(x0) AS x0, max(x0 + w) AS x1, round(avg(conf), 6) AS conf, bool_or(conf < 70) AS uncertain FROM words GROUP BY 1, 2")
def words_to_lines(spark: SparkSession, d: str) -> DataFrame:
    """AGG1, FLT2, PRJ8."""
    return geometry.lines_of_words(V.words(spark, d), ["block_id", "line"]).withColumn("conf", F.round("conf", 6))


@query(f"""WITH {V.WORDS}, s AS (SELECT *, sum(CASE WHEN x0 - p > 25 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY block_id, line ORDER BY word) AS segment FROM (SELECT *, lag(x0 + w) OVER (PARTITION BY block_id, line ORDER BY word) AS p FROM words))
SELECT block_id, line, CAST(segment AS BIGINT) AS segment, min(x0) AS x0, max(x0 + w) AS x1, count(*) AS n FROM s GROUP BY 1, 2, 3""")
def line_segments(spark: SparkSession, d: str) -> DataFrame:
    """WIN1."""
    return geometry.segments(V.words(spark, d), ["block_id", "line"])


@query(f"""WITH {V.WORDS}, s AS (SELECT *, sum(CASE WHEN x0 - p >= 5 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY block_id, line ORDER BY x0, word) AS segment FROM (SELECT *, max(x0 + w) OVER (PARTITION BY block_id, line ORDER BY x0, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM words))
SELECT block_id, line, CAST(segment AS BIGINT) AS segment, min(x0) AS x0, max(x0 + w) AS x1, count(*) AS n FROM s GROUP BY 1, 2, 3""")
def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    """WIN2."""
    return geometry.merged_segments(V.words(spark, d), ["block_id", "line"])


@query(f"""WITH RECURSIVE {V.WORDS}, s AS (SELECT block_id, line, min(x0) AS x0 FROM words GROUP BY block_id, line, word // 3), a(block_id, col, start) AS (
SELECT block_id, CAST(0 AS BIGINT), min(x0) FROM s GROUP BY block_id UNION ALL SELECT a.block_id, a.col + 1, (SELECT min(x0) FROM s WHERE s.block_id = a.block_id AND s.x0 > a.start + 60) AS n FROM a WHERE EXISTS (SELECT 1 FROM s WHERE s.block_id = a.block_id AND s.x0 > a.start + 60))
SELECT block_id, col, start FROM a""")
def column_starts(spark: SparkSession, d: str) -> DataFrame:
    """WIN4: the SQL takes the next start beyond the anchor, again and again."""
    s = V.words(spark, d).withColumn("_g", F.floor(F.col("word") / 3)).groupBy("block_id", "line", "_g").agg(F.min("x0").alias("x0"))
    return geometry.column_starts(s, ["block_id"], 60)


@query(f"""WITH {V.MARKS}, s AS (SELECT page, x, sum(CASE WHEN x - p <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY x) AS island FROM (SELECT page, x, lag(x) OVER (PARTITION BY page ORDER BY x) AS p FROM (SELECT DISTINCT page, x FROM marks)))
SELECT page, CAST(island AS BIGINT) AS island, count(*) AS n, round(avg(x), 6) AS position FROM s GROUP BY 1, 2""")
def rule_positions(spark: SparkSession, d: str) -> DataFrame:
    """WIN3."""
    return geometry.rule_positions(V.marks(spark, d), ["page"], "x").withColumn("position", F.round("position", 6))


@query(f"""WITH {V.MARKS}, s AS (SELECT page, y, sum(CASE WHEN y - p < 3 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y) AS cluster FROM (SELECT page, y, lag(y) OVER (PARTITION BY page ORDER BY y) AS p FROM (SELECT DISTINCT page, y FROM marks))),
g AS (SELECT page, CAST(cluster AS BIGINT) AS cluster, avg(y) AS centre, count(*) AS n FROM s GROUP BY 1, 2)
SELECT page, cluster, round(centre, 6) AS centre, n, round((centre + lead(centre) OVER (PARTITION BY page ORDER BY cluster)) / 2, 6) AS boundary FROM g""")
def row_clusters(spark: SparkSession, d: str) -> DataFrame:
    """WIN6, WIN18."""
    g = geometry.row_clusters(V.marks(spark, d), ["page"], "y", 3)
    return g.select("page", "cluster", F.round("centre", 6).alias("centre"), "n", F.round("boundary", 6).alias("boundary"))


_IN_GRID = "taken AS (SELECT m.page, m.id, r.r, c.c FROM marks m JOIN gcols c ON c.page = m.page AND m.x >= c.x0 AND m.x < c.x1 JOIN grows r ON r.page = m.page AND m.y >= r.y0 AND m.y < r.y1)"


@query(f"WITH {V.MARKS}, {_IN_GRID} SELECT page, id, r, c FROM taken")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    """JOI1, LAY3."""
    return geometry.grid_cells(V.marks(spark, d), *V.grid(spark, d))


@query(f"WITH {V.MARKS}, {_IN_GRID} SELECT r.page, r.r, c.c FROM grows r JOIN gcols c USING (page) WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.page = r.page AND t.r = r.r AND t.c = c.c)")
def empty_cells(spark: SparkSession, d: str) -> DataFrame:
    """JOI4, JOI5."""
    cols, rows = V.grid(spark, d)
    return geometry.empty_cells(cols, rows, geometry.grid_cells(V.marks(spark, d), cols, rows))


@query(f"WITH {V.MARKS} SELECT m.page, m.id, count(r.x) AS col FROM marks m LEFT JOIN rules r ON r.page = m.page AND r.x < m.x GROUP BY 1, 2")
def column_of(spark: SparkSession, d: str) -> DataFrame:
    """JOI2, JOI13."""
    return geometry.column_of(V.marks(spark, d), V.rules(spark, d))


@query(f"WITH {V.MARKS} SELECT r.page, r.rule, r.x, CAST(count(*) FILTER (m.x < r.x) AS BIGINT) AS left_n, CAST(count(*) FILTER (m.x >= r.x) AS BIGINT) AS right_n FROM rules r JOIN marks m USING (page) GROUP BY 1, 2, 3 HAVING count(*) FILTER (m.x < r.x) >= 2 AND count(*) FILTER (m.x >= r.x) >= 2")
def main_rules(spark: SparkSession, d: str) -> DataFrame:
    """JOI3."""
    return geometry.main_rules(V.marks(spark, d), V.rules(spark, d))


@query(f"""WITH {V.MARKS}{V.BOXES} SELECT * FROM boxes n WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM boxes o WHERE o.id % 2 = 0 AND o.page = n.page
AND greatest(0, least(n.x1, o.x1) - greatest(n.x0, o.x0)) * greatest(0, least(n.y1, o.y1) - greatest(n.y0, o.y0)) > least((n.x1 - n.x0) * (n.y1 - n.y0), (o.x1 - o.x0) * (o.y1 - o.y0)) * 0.3)""")
def overlap_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """JOI6, JOI10: two kinds of boxes, odd and even ids."""
    b = V.boxes(spark, d)
    return geometry.overlap_antijoin(b.where("id % 2 = 1"), b.where("id % 2 = 0"))


@query(f"WITH {V.MARKS} SELECT page, id, mark FROM (SELECT m.page, m.id, r.x AS mark, row_number() OVER (PARTITION BY m.page, m.id ORDER BY abs(r.x - m.x), r.x) AS k FROM marks m JOIN rules r ON r.page = m.page) WHERE k = 1")
def nearest_column(spark: SparkSession, d: str) -> DataFrame:
    """JOI11, JOI12; of two as near the smaller."""
    return geometry.nearest(V.marks(spark, d), V.rules(spark, d))


@query(f"WITH {V.MARKS} SELECT page, min(x) AS median FROM (SELECT page, x, sum(sum(y)) OVER (PARTITION BY page ORDER BY x) AS run, sum(sum(y)) OVER (PARTITION BY page) AS total FROM marks GROUP BY page, x) WHERE run * 2 >= total GROUP BY 1")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    """AGG4."""
    return geometry.weighted_median(V.marks(spark, d), ["page"], "x", "y")


@query(f"WITH {V.MARKS} SELECT page, l[len(l) // 2 + 1] AS median FROM (SELECT page, list(x ORDER BY x) AS l FROM marks GROUP BY 1)")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    """AGG2 (D4)."""
    return geometry.upper_median(V.marks(spark, d), ["page"], "x")


@query(f"WITH {V.MARKS}, m AS (SELECT page, l[len(l) // 2 + 1] AS median FROM (SELECT page, list(x ORDER BY x) AS l FROM marks GROUP BY 1)) SELECT page, l[len(l) // 2 + 1] AS spread FROM (SELECT page, list(abs(x - median) ORDER BY abs(x - median)) AS l FROM marks JOIN m USING (page) GROUP BY 1)")
def angle_spread(spark: SparkSession, d: str) -> DataFrame:
    """AGG5."""
    return geometry.spread(V.marks(spark, d), ["page"], "x")


@query(f"WITH {V.MARKS} SELECT page, l[CAST(least(len(l), floor(0.9 * len(l)) + 1) AS INTEGER)] AS quantile FROM (SELECT page, list(x ORDER BY x) AS l FROM marks GROUP BY 1)")
def row_quantile(spark: SparkSession, d: str) -> DataFrame:
    """AGG7."""
    return geometry.quantile_at(V.marks(spark, d), ["page"], "x", 0.9)


@query(f"WITH {V.MARKS} SELECT page, median(x) AS median FROM marks GROUP BY 1")
def interpolated_median(spark: SparkSession, d: str) -> DataFrame:
    """AGG3 (D4, Python variant)."""
    return V.marks(spark, d).groupBy("page").agg(F.median("x").alias("median"))


@query(f"WITH {V.MARKS}, f AS (SELECT page, regr_slope(x, y) AS a, regr_intercept(x, y) AS b FROM marks GROUP BY 1) SELECT page, round(a, 6) AS a, round(b, 6) AS b, round(avg(abs(x - a * y - b)), 6) AS residual FROM marks JOIN f USING (page) GROUP BY page, a, b")
def rule_fit(spark: SparkSession, d: str) -> DataFrame:
    """AGG13, AGG15."""
    return geometry.rule_fit(V.marks(spark, d), ["page"]).select("page", *[F.round(c, 6).alias(c) for c in ("a", "b", "residual")])


_COVER = "cover AS (SELECT page, bin, count(DISTINCT y) AS rows FROM (SELECT page, y0 // 40 AS y, unnest(range(x0 // 16, x1 // 16 + 1)) AS bin FROM boxes) GROUP BY 1, 2)"


@query(f"WITH {V.MARKS}{V.BOXES}, {_COVER} SELECT page, bin, rows FROM cover")
def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG12."""
    return geometry.coverage(V.boxes(spark, d).withColumn("_y", F.floor(F.col("y0") / 40)), ["page"], "_y", 16)


@query(f"""WITH {V.MARKS}{V.BOXES}, {_COVER}, t AS (SELECT *, sum(CASE WHEN bin - p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY bin) AS run FROM (SELECT *, lag(bin) OVER (PARTITION BY page ORDER BY bin) AS p FROM cover WHERE rows <= 3)),
l AS (SELECT page, run, bin FROM (SELECT *, min(rows) OVER (PARTITION BY page, run) AS m FROM t) WHERE rows = m),
s AS (SELECT *, sum(CASE WHEN bin - p = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY page, run ORDER BY bin) AS part FROM (SELECT *, lag(bin) OVER (PARTITION BY page, run ORDER BY bin) AS p FROM l))
SELECT page, CAST(run AS BIGINT) AS run, CAST(part AS BIGINT) AS part, (min(bin) + max(bin) + 1) / 2 AS gap FROM s GROUP BY 1, 2, 3""")
def column_gaps(spark: SparkSession, d: str) -> DataFrame:
    """WIN9, LAY5."""
    return geometry.column_gaps(coverage_histogram(spark, d), ["page"], 3)


@query(f"WITH {V.MARKS} SELECT page, id, max(x) OVER (PARTITION BY page ORDER BY id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS reference FROM marks")
def local_reference(spark: SparkSession, d: str) -> DataFrame:
    """WIN17."""
    return geometry.local_reference(V.marks(spark, d), ["page"], "id", "x").select("page", "id", "reference")


#: Numbers that count up in each page, one in eight misread.
_SEQ = "seq AS (SELECT page, id, CAST(k + page % 7 + CASE WHEN id % 8 = 0 THEN id % 5 ELSE 0 END AS BIGINT) AS v FROM (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY id) AS k FROM marks))"


@query(f"""WITH {V.MARKS}, {_SEQ}, i AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY id) - 1 AS i FROM seq), o AS (SELECT page, v - i AS o, count(*) AS n, min(i) AS f FROM i GROUP BY 1, 2),
w AS (SELECT page, o FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, f) AS k FROM o) WHERE k = 1) SELECT page, id, v, CAST(o + i AS BIGINT) AS expected FROM i JOIN w USING (page)""")
def sequence_repair(spark: SparkSession, d: str) -> DataFrame:
    """AGG9, WIN15."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("page").orderBy("id"))
    s = V.marks(spark, d).withColumn("_k", k).selectExpr("page", "id", "cast(_k + page % 7 + case when id % 8 = 0 then id % 5 else 0 end as bigint) as v")
    return geometry.repair_sequence(s, ["page"], "id", "v")


_PAIRS = "(VALUES " + ", ".join(f"('{p}')" for x in T.CONFUSABLE for p in (x, x[::-1])) + ") AS k(p)"


@query(f"""WITH c AS (SELECT nation AS page, text, max(conf) AS conf FROM (SELECT c_nationkey AS nation, replace(c_name, '#', '') AS text, (c_custkey * 37 % 100) / 100.0 AS conf FROM customer) WHERE regexp_matches(text, '^[A-Za-z0-9().-]{{6,}}$') GROUP BY 1, 2),
p AS (SELECT a.page, a.text, a.conf AS ca, b.text AS bt, b.conf AS cb FROM c a JOIN c b ON a.page = b.page AND a.text <> b.text AND length(a.text) = length(b.text)
 WHERE (regexp_matches(a.text, '\\d') OR regexp_matches(b.text, '\\d')) AND hamming(a.text, b.text) <= 2 AND hamming(a.text, b.text) * 4 <= length(a.text)
 AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(1, 60)) AS i) WHERE i <= length(a.text) AND a.text[i] <> b.text[i] AND a.text[i] || b.text[i] NOT IN (SELECT p FROM {_PAIRS}))),
g AS (SELECT page, text, max(ca) AS ca, max(cb) AS cb, arg_max(bt, (cb, bt)) AS bt, bool_or(abs(ca - cb) <= 0.05) AS near FROM p GROUP BY 1, 2)
SELECT page, text, CASE WHEN cb > ca + 0.05 THEN bt ELSE text END AS reading, cb > ca + 0.05 OR near AS flagged FROM g""")
def harmonize_codes(spark: SparkSession, d: str) -> DataFrame:
    """JOI8, STR5 in the set-based definition; codes from customers, a nation as document."""
    c = table(spark, d, "customer").selectExpr("c_nationkey as page", "replace(c_name, '#', '') as text", "(c_custkey * 37 % 100) / 100.0D as conf")
    return quality.harmonize(c, ["page"])


@query()
def best_line_match(spark: SparkSession, d: str) -> DataFrame:
    """JOI14, STR4: first lines against the other lines of their scan, whole and of every script; distances in characters (DuckDB's
    are in bytes, hence no SQL; held against plain loops in the tests)."""
    ln = V.lines(spark, d)
    truth = ln.where("line = 0").selectExpr("scan_id", "block_id as truth_id", "ltext as truth")
    return quality.best_line_match(truth, ln.where("line > 0").selectExpr("scan_id", "ltext as line"), ["scan_id"])


_TOK = rf"SELECT scan_id, unnest(regexp_extract_all(text, '{T.NUMBER_TOKEN}')) AS token FROM block WHERE text IS NOT NULL AND page_number"


@query(rf"""WITH t AS (SELECT scan_id, token, count(*) AS t FROM ({_TOK} = 1) GROUP BY 1, 2), r AS (SELECT scan_id, token, count(*) AS r FROM ({_TOK} = 2) GROUP BY 1, 2)
SELECT scan_id, CAST(sum(t) AS BIGINT) AS wanted, CAST(sum(least(t, coalesce(r, 0))) AS BIGINT) AS hits FROM t LEFT JOIN r USING (scan_id, token) GROUP BY 1""")
def number_recall(spark: SparkSession, d: str) -> DataFrame:
    """STR10, SET2: numbers of the first page found on the second."""
    b = table(spark, d, "block").where("text is not null")
    return quality.number_recall(b.where("page_number = 1"), b.where("page_number = 2"), ["scan_id"])


@query("SELECT device_id, created, scan_id, title FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY created DESC, scan_id DESC) AS k FROM scan WHERE created IS NOT NULL) WHERE k = 1")
def latest_scans(spark: SparkSession, d: str) -> DataFrame:
    """SNK16, JOI17: the newest scan of each device."""
    s = table(spark, d, "scan").where("created is not null").select("device_id", "created", "scan_id", "title")
    return history.latest(s, "device_id", ["created", "scan_id"]).select("device_id", "created", "scan_id", "title")


@query("SELECT scan_id, created FROM scan WHERE created IS NOT NULL ORDER BY created DESC, scan_id DESC LIMIT 40")
def newest_scans(spark: SparkSession, d: str) -> DataFrame:
    """SRT2, SRC10: the newest 40 are the feature."""
    return history.retain(table(spark, d, "scan").where("created is not null").select("scan_id", "created"), "created", 40, "scan_id")


@query("SELECT scan_id, title FROM scan WHERE contains(lower(title), 'report') OR contains(lower(language), 'report')")
def scan_search(spark: SparkSession, d: str) -> DataFrame:
    """FLT14."""
    return history.search(table(spark, d, "scan"), " Report ", "title", "language").select("scan_id", "title")


@query("SELECT scan_id, title FROM scan WHERE scan_id NOT IN (SELECT scan_id FROM scan WHERE handwritten)")
def delete_scans(spark: SparkSession, d: str) -> DataFrame:
    """SNK17."""
    s = table(spark, d, "scan")
    return history.delete(s, s.where("handwritten"), "scan_id").select("scan_id", "title")


_STEPS = "steps AS (SELECT user_id AS page, event_id AS t, CASE WHEN event_id % 3 = 0 THEN '-' ELSE left(event_type, 1) END AS best FROM events)"


@query(f"WITH {_STEPS} SELECT page, string_agg(best, '' ORDER BY t) AS text FROM (SELECT *, lag(best) OVER (PARTITION BY page ORDER BY t) AS p FROM steps) WHERE best <> '-' AND (p IS NULL OR p <> best) GROUP BY 1")
def ctc_collapse(spark: SparkSession, d: str) -> DataFrame:
    """WIN20."""
    steps = table(spark, d, "events").selectExpr("user_id as page", "event_id as t", "case when event_id % 3 = 0 then '-' else left(event_type, 1) end as best")
    return geometry.collapse_repeats(steps, ["page"], "-")


#: Cell texts as glyphs; runner-ups are the digits that the letters look like.
_ALT = {"s": "5", "S": "5", "o": "0", "O": "0", "l": "1", "I": "1", "Z": "2", "z": "2", "B": "8", "g": "9", "q": "9", "b": "6", "G": "6", "T": "7", "|": "1"}


@query(r"""WITH g AS (SELECT cell_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS pos FROM cell WHERE text <> ''),
t AS (SELECT *, sum(CASE WHEN c = ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id ORDER BY pos) AS tok, translate(c, 'sSoOlIZzBgqbGT|', '550011228996671') AS alt FROM g),
u AS (SELECT *, c <> ' ' AND NOT regexp_matches(c, '[\d.,/:\-$€£¥₹#%+]') AS odd FROM t),
v AS (SELECT *, count(*) FILTER (regexp_matches(c, '\d')) OVER w AS digits, count(*) FILTER (odd) OVER w AS odds, count(*) FILTER (odd AND NOT regexp_matches(c, '[sSoOlIZzBgqbGT|]')) OVER w AS bad FROM u WINDOW w AS (PARTITION BY cell_id, tok)),
x AS (SELECT *, odd AND digits >= 2 AND odds <= greatest(1.0, digits / 3) AND bad = 0 AS fix FROM v)
SELECT cell_id, string_agg(CASE WHEN fix THEN alt ELSE c END, '' ORDER BY pos) AS text, bool_or(fix) AS flagged FROM x GROUP BY 1""")
def numeric_token_fix(spark: SparkSession, d: str) -> DataFrame:
    """STR3."""
    glyphs = table(spark, d, "cell").where("text <> ''").select("cell_id", F.posexplode(F.split("text", "")).alias("pos", "c"))
    glyphs = glyphs.where("c <> ''").withColumn("alt", F.translate("c", "".join(_ALT), "".join(_ALT.values()))).withColumn("alt_p", F.lit(0.5))
    return quality.fix_numeric_tokens(glyphs, ["cell_id"])


@query("""SELECT user_id AS page, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(greatest(0, floor(c * w / 3.0 - w / 3.0 * 0.125)) AS BIGINT) AS x0, CAST(greatest(0, floor(r * h / 3.0 - h / 3.0 * 0.125)) AS BIGINT) AS y0,
CAST(least(w, floor((c + 1) * w / 3.0 + w / 3.0 * 0.125)) AS BIGINT) AS x1, CAST(least(h, floor((r + 1) * h / 3.0 + h / 3.0 * 0.125)) AS BIGINT) AS y1
FROM (SELECT DISTINCT user_id, CAST(1200 + user_id % 5 * 240 AS BIGINT) AS w, CAST(960 + user_id % 3 * 480 AS BIGINT) AS h FROM events), (SELECT unnest(range(3)) AS r), (SELECT unnest(range(3)) AS c)""")
def page_tiles(spark: SparkSession, d: str) -> DataFrame:
    """PRJ10."""
    p = table(spark, d, "events").selectExpr("user_id as page", "1200 + user_id % 5 * 240 as width", "960 + user_id % 3 * 480 as height").distinct()
    return geometry.tiles(p, 3, 0.125)


@query("""WITH n AS (SELECT DISTINCT col_pos + 1 + 40 * row_pos AS n FROM cell) SELECT n, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER)) WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
ELSE chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 703) % 26 AS INTEGER)) END AS letters FROM n""")
def column_letters(spark: SparkSession, d: str) -> DataFrame:
    """PRJ21."""
    return table(spark, d, "cell").selectExpr("col_pos + 1 + 40 * row_pos as n").distinct().select("n", T.column_letters(F.col("n")).alias("letters"))


def _page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Segments as positioned lines of a page each."""
    w = V.words(spark, d).join(V.lines(spark, d).select("block_id", "line").distinct(), ["block_id", "line"])
    seg = geometry.segments(w, ["block_id", "line"])
    text = geometry.islands(w, ["block_id", "line"], ["word"], F.expr("x0 - lag(x0 + w) over (partition by block_id, line order by word) > 25"), "segment").groupBy("block_id", "line", "segment").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "wtext"))), lambda x: x["wtext"]), " ").alias("text")
    )
    s = seg.join(text, ["block_id", "line", "segment"])
    return s.selectExpr("block_id as page", "line * 1000 + segment as line_id", "text", "cast(x0 as double) as x0", "cast(x1 as double) as x1", "cast(line * 12 + 3 * (segment % 3) as double) as y0", "cast(line * 12 + 3 * (segment % 3) + 10 + line % 4 as double) as y1")


@query("""WITH p AS (SELECT block_id, length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) AS latin, length(regexp_replace(text, '[^Ѐ-ӿ぀-ヿ一-鿿]', '', 'g')) AS other FROM block WHERE text IS NOT NULL)
SELECT block_id, latin, other, latin >= 20 AND other > 0 AND other <= 0.05 * (latin + other) AS stray FROM p""")
def stray_script(spark: SparkSession, d: str) -> DataFrame:
    """FLT6, STR12: texts in Latin script with a few glyphs of another."""
    b = table(spark, d, "block").where("text is not null")
    n = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]", "")).cast("bigint")
    b = b.select("block_id", n("A-Za-zÀ-ɏ").alias("latin"), n("Ѐ-ӿ぀-ヿ一-鿿").alias("other"))
    return b.withColumn("stray", (F.col("latin") >= 20) & (F.col("other") > 0) & (F.col("other") <= 0.05 * (F.col("latin") + F.col("other"))))


@query("SELECT scan_id, page_number, arg_min(text, (block_pos, block_id)) FILTER (text IS NOT NULL) AS first_text, bool_or(coalesce(uncertain, false)) AS doubt, count(*) AS blocks FROM block WHERE block_pos IS NOT NULL GROUP BY 1, 2")
def page_meta(spark: SparkSession, d: str) -> DataFrame:
    """First non-null text of a page, any doubt."""
    b = table(spark, d, "block").where("block_pos is not null")
    first = F.min_by("text", F.when(F.col("text").isNotNull(), F.struct("block_pos", "block_id")))
    return b.groupBy("scan_id", "page_number").agg(first.alias("first_text"), F.bool_or(F.coalesce("uncertain", F.lit(False))).alias("doubt"), F.count("*").alias("blocks"))


@query("SELECT form_id, round(sum(CASE WHEN regexp_matches(value, '^[0-9]+$') THEN 1.0 ELSE 0.0 END) / count(*), 6) AS share, count(*) AS n, count(DISTINCT key) AS keys FROM key_value GROUP BY 1")
def form_stats(spark: SparkSession, d: str) -> DataFrame:
    """Shares of hits by group."""
    g = table(spark, d, "key_value").groupBy("form_id")
    return g.agg(F.round(F.sum(F.coalesce(F.col("value").rlike("^[0-9]+$").cast("double"), F.lit(0.0))) / F.count("*"), 6).alias("share"), F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("SELECT device_id, round(sum(seconds), 6) AS seconds, count(*) AS n, max(page_count) AS pages FROM scan GROUP BY 1")
def scan_seconds(spark: SparkSession, d: str) -> DataFrame:
    """AGG24."""
    return table(spark, d, "scan").groupBy("device_id").agg(F.round(F.sum("seconds"), 6).alias("seconds"), F.count("*").alias("n"), F.max("page_count").alias("pages"))


@query(f"""WITH {V.MARKS}{V.BOXES} SELECT page, id, round(sqrt(CAST((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS DOUBLE)), 6) AS diagonal, round(degrees(atan2(CAST(y1 - y0 AS DOUBLE), CAST(x1 - x0 AS DOUBLE))), 6) AS angle, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM boxes""")
def box_geometry(spark: SparkSession, d: str) -> DataFrame:
    """PRJ6, PRJ7, PRJ11: centre, diagonal and angle of boxes."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return V.boxes(spark, d).select("page", "id", F.round(F.hypot(w, h), 6).alias("diagonal"), F.round(F.degrees(F.atan2(h.cast("double"), w.cast("double"))), 6).alias("angle"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


@query(f"WITH {V.MARKS}{V.BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_max(id, ((x1 - x0) * (y1 - y0), -id)) AS largest FROM boxes GROUP BY 1")
def union_boxes(spark: SparkSession, d: str) -> DataFrame:
    """PRJ9, AGG18, AGG19: the union of a page's boxes and its largest box, the first of equals."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return V.boxes(spark, d).groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max_by("id", F.struct(area, -F.col("id"))).alias("largest"))


@query(f"WITH {V.MARKS}{V.BOXES} SELECT page, id, k FROM (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY (x1 - x0) * (y1 - y0) DESC, id) AS k FROM boxes) WHERE k <= 5")
def top_boxes(spark: SparkSession, d: str) -> DataFrame:
    """SRT4: the five largest are the feature."""
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("page").orderBy(F.desc((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), "id"))
    return V.boxes(spark, d).select("page", "id", k.cast("bigint").alias("k")).where("k <= 5")


@query(f"WITH {V.MARKS}, {_IN_GRID} SELECT g.page, count(DISTINCT g.r) AS n, count(DISTINCT t.r) AS filled, count(DISTINCT t.r) * 10 >= count(DISTINCT g.r) * 7 AS kept FROM grows g LEFT JOIN taken t ON t.page = g.page AND t.r = g.r GROUP BY 1")
def kept_grids(spark: SparkSession, d: str) -> DataFrame:
    """FLT5: a grid is kept if text stands in 70 per cent of its rows."""
    cols, rows = V.grid(spark, d)
    taken = geometry.grid_cells(V.marks(spark, d), cols, rows).select("page", "r").distinct().withColumn("_t", F.lit(True))
    g = rows.select("page", "r").join(taken, ["page", "r"], "left").groupBy("page").agg(F.count("*").alias("n"), F.count("_t").alias("filled"))
    return g.withColumn("kept", F.col("filled") * 10 >= F.col("n") * 7)


@query(f"WITH {V.MARKS}, t AS (SELECT page, x - lag(x) OVER w AS a, lag(x) OVER w - lag(x, 2) OVER w AS b FROM marks WINDOW w AS (PARTITION BY page ORDER BY id)) SELECT page, count(*) AS triples, CAST(count(*) FILTER (a * b < 0) AS BIGINT) AS flips, count(*) >= 4 AND count(*) FILTER (a * b < 0) * 4 >= count(*) * 3 AS banded FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def row_bands(spark: SparkSession, d: str) -> DataFrame:
    """AGG21."""
    return geometry.bands(V.marks(spark, d), ["page"], "id", "x")


@query(f"WITH RECURSIVE {V.MARKS}, v AS (SELECT DISTINCT page, x + 10 AS x FROM marks), a(page, first) AS (SELECT page, min(x) FROM v GROUP BY 1 UNION ALL SELECT a.page, (SELECT min(x) FROM v WHERE v.page = a.page AND v.x > a.first * 1.5) FROM a WHERE EXISTS (SELECT 1 FROM v WHERE v.page = a.page AND v.x > a.first * 1.5)) SELECT page, first FROM a")
def size_groups(spark: SparkSession, d: str) -> DataFrame:
    """WIN5."""
    return geometry.size_groups(V.marks(spark, d).withColumn("x", F.col("x") + 10), ["page"], "x", 1.5)


@query(f"WITH {V.LINES} SELECT block_id, line, ltext AS candidate FROM lines UNION ALL SELECT block_id, line, ltext || ' ' || n FROM (SELECT *, lead(ltext) OVER (PARTITION BY block_id ORDER BY line) AS n FROM lines) WHERE n IS NOT NULL")
def candidate_lines(spark: SparkSession, d: str) -> DataFrame:
    """WIN19, SET1: lines, and each line with the next."""
    from pyspark.sql import Window as W

    ln = V.lines(spark, d)
    pair = ln.withColumn("_n", F.lead("ltext").over(W.partitionBy("block_id").orderBy("line"))).where("_n is not null")
    return ln.select("block_id", "line", F.col("ltext").alias("candidate")).unionByName(pair.select("block_id", "line", F.concat_ws(" ", "ltext", "_n").alias("candidate")))


@query("""SELECT scan_id, n < 5 OR m < 0.75 AS hard, n, m FROM (SELECT scan_id, count(*) AS n, l[len(l) // 2 + 1] AS m FROM (SELECT scan_id, list(confidence ORDER BY confidence) AS l, count(*) AS k FROM block WHERE confidence IS NOT NULL GROUP BY 1) JOIN (SELECT scan_id FROM block WHERE confidence IS NOT NULL) USING (scan_id) GROUP BY scan_id, l)""")
def hard_scans(spark: SparkSession, d: str) -> DataFrame:
    """FLT15: few blocks or a low upper median of confidence."""
    b = table(spark, d, "block").where("confidence is not null").select("scan_id", "confidence")
    g = b.groupBy("scan_id").agg(F.count("*").alias("n")).join(geometry.upper_median(b, ["scan_id"], "confidence"), "scan_id")
    return g.select("scan_id", ((F.col("n") < 5) | (F.col("median") < 0.75)).alias("hard"), "n", F.col("median").alias("m"))


@query(rf"""WITH o AS (SELECT block_id, CASE WHEN coalesce(page_number, 1) = 1 THEN '' ELSE 'P' || page_number || ' ' END || 'Table ' || row_number() OVER (PARTITION BY scan_id, page_number ORDER BY block_pos NULLS FIRST, block_id) AS sheet FROM block WHERE type = 'table' AND block_id IN (SELECT block_id FROM cell)),
n AS (SELECT cell_id, regexp_matches(s, '{NUM}') AND NOT (length(regexp_extract(s, '{NUM}', 3)) > 1 AND regexp_extract(s, '{NUM}', 3) LIKE '0%') AND length(replace(regexp_extract(s, '{NUM}', 3), ',', '')) <= 15 AS num FROM (SELECT cell_id, {_STRIP.format("coalesce(text, '')")} AS s FROM cell))
SELECT c.block_id, sheet, c.row_pos + 1 AS r, c.col_pos + 1 AS c, CASE WHEN num AND NOT coalesce(is_header, false) THEN 'number' WHEN coalesce(text, '') LIKE '=%' THEN 'quoted' ELSE 'text' END AS kind, coalesce(c.uncertain, false) AS note FROM cell c JOIN o USING (block_id) JOIN n USING (cell_id)""")
def sheet_plan(spark: SparkSession, d: str) -> DataFrame:
    """SNK6, SNK7: where each cell goes in a workbook and how it is written; never as a live formula."""
    c = table(spark, d, "cell")
    o = model.table_ordinals(table(spark, d, "block"), c)
    page = F.when(F.coalesce("page_number", F.lit(1)) == 1, "").otherwise(F.concat(F.lit("P"), F.col("page_number"), F.lit(" ")))
    o = o.select("block_id", F.concat(page, F.lit("Table "), F.col("n").cast("string")).alias("sheet"))
    value, _ = T.typed_number(F.coalesce("text", F.lit("")))
    kind = F.when(value.isNotNull() & ~F.coalesce("is_header", F.lit(False)), "number").when(F.col("text").startswith("="), "quoted").otherwise("text")
    return c.join(o, "block_id").select("block_id", "sheet", (F.col("row_pos") + 1).alias("r"), (F.col("col_pos") + 1).alias("c"), kind.alias("kind"), F.coalesce("uncertain", F.lit(False)).alias("note"))


@query(f"""WITH {V.MARKS}{V.BOXES}, m AS (SELECT page, id, x0, x1, x0 % 100 AS l, 100 - (x1 - x0 // 100 * 100) AS r FROM boxes)
SELECT page, id, x0, x1, CASE WHEN r < 0 THEN 'left' WHEN r < 0.35 * l AND l > 8 THEN 'right' WHEN abs(l - r) < 20 AND l > 15 THEN 'center' ELSE 'left' END AS align FROM m""")
def cell_alignment(spark: SparkSession, d: str) -> DataFrame:
    """PRJ23: how a text stands in its column (here 100 wide), by the margins: what runs past the column starts where it starts."""
    m = V.boxes(spark, d).selectExpr("page", "id", "x0", "x1", "cast(x0 div 100 * 100 as bigint) as c0", "cast(x0 div 100 * 100 + 100 as bigint) as c1")
    return m.select("page", "id", "x0", "x1", geometry.alignment("x0", "x1", "c0", "c1").alias("align"))


@query(f"WITH {V.MARKS}{V.BOXES} SELECT page, count(*) AS n, CAST(sum(CASE WHEN y1 - y0 > 1.5 * (x1 - x0) THEN 1 ELSE 0 END) AS BIGINT) AS tall, count(*) >= 3 AND sum(CASE WHEN y1 - y0 > 1.5 * (x1 - x0) THEN 1 ELSE 0 END) > 0.6 * count(*) AS sideways FROM (SELECT page, y0 AS x0, y1 AS x1, x0 AS y0, x1 AS y1 FROM boxes) GROUP BY 1")
def sideways_pages(spark: SparkSession, d: str) -> DataFrame:
    """FLT22: pages on which most boxes are taller than wide; the boxes are turned first, so that some pages are."""
    return geometry.sideways(V.boxes(spark, d).selectExpr("page", "y0 as x0", "y1 as x1", "x0 as y0", "x1 as y1"), ["page"])


@query(f"WITH {V.MARKS}{V.BOXES} SELECT page, id FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x1 - x0 DESC, id) AS k FROM boxes) WHERE k <= 24 AND x1 - x0 > 2 * (y1 - y0)")
def orientation_sample(spark: SparkSession, d: str) -> DataFrame:
    """SRT5: of a page's 24 longest lines those that tell which way is up."""
    return geometry.orientation_sample(V.boxes(spark, d), ["page"]).select("page", "id")


@query(f"WITH {V.MARKS} SELECT page, id, x FROM marks WHERE x / 1000.0 > 0.35")
def sure_lines(spark: SparkSession, d: str) -> DataFrame:
    """FLT1: readings that are not blank and surer than 0.35; x is the score in thousandths, the id the text."""
    return geometry.sure(V.marks(spark, d).withColumns({"text": F.col("id").cast("string"), "score": F.col("x") / 1000}), 0.35).select("page", "id", "x")


@query(f"WITH {V.MARKS} SELECT page, id FROM marks WHERE least(x, y) / 1000.0 < 0.93")
def reread_lines(spark: SparkSession, d: str) -> DataFrame:
    """FLT4: lines with a glyph below 0.93."""
    return V.marks(spark, d).where(F.least("x", "y") / 1000 < 0.93).select("page", "id")


@query(f"WITH {V.WORDS} SELECT block_id, line, word FROM words WHERE trim(wtext) <> '' AND conf - 5 >= 0")
def scanned_words(spark: SparkSession, d: str) -> DataFrame:
    """SRC9: words that are not blank and whose confidence is not negative."""
    return geometry.sure(V.words(spark, d).withColumns({"text": F.col("wtext"), "score": F.col("conf") - 5}), 0, strict=False).select("block_id", "line", "word")


@query(f"WITH {V.MARKS}{V.BOXES} SELECT page, id FROM boxes WHERE x0 % 250 <= 4 AND x0 >= 250 OR x1 % 250 >= 246 AND x1 < 750 OR y0 % 250 <= 4 AND y0 >= 250 OR y1 % 250 >= 246 AND y1 < 750")
def tile_edge_boxes(spark: SparkSession, d: str) -> DataFrame:
    """FLT8: boxes that touch an inner border of their tile (250 wide, 1000 in all), seen whole in the next tile."""
    return geometry.on_tile_edge(V.boxes(spark, d), 250, 1000, 4).select("page", "id")


@query(f"WITH {V.MARKS}{V.BOXES}, m AS (SELECT * FROM boxes WHERE x1 - x0 < 24), e AS (SELECT * FROM boxes WHERE x1 - x0 >= 24) SELECT page, id FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.page = m.page AND abs((e.y0 + e.y1) / 2.0 - (m.y0 + m.y1) / 2.0) < 1)")
def lone_markers(spark: SparkSession, d: str) -> DataFrame:
    """FLT9: markers (narrow boxes) with no entry (a wide one) at their height."""
    b = V.boxes(spark, d)
    return geometry.alone(b.where("x1 - x0 < 24"), b.where("x1 - x0 >= 24"), 2).select("page", "id")


@query(f"WITH {V.MARKS} SELECT page, rule, x, row_number() OVER (PARTITION BY page ORDER BY x * 0.01 * 400 + x, rule) AS k FROM (WITH {V.MARKS} SELECT * FROM rules)")
def rules_at_mid_height(spark: SparkSession, d: str) -> DataFrame:
    """SRT7: rules from left to right where they cross the page's middle (height 800, slope growing with x)."""
    from pyspark.sql import Window as W

    at = F.col("x") * 0.01 * 400 + F.col("x")
    return V.rules(spark, d).select("page", "rule", "x", F.row_number().over(W.partitionBy("page").orderBy(at, "rule")).alias("k"))


@query("SELECT block_id, page_number, scan_id FROM block WHERE block_id NOT IN (SELECT block_id FROM cell WHERE block_id IS NOT NULL)")
def unused_items(spark: SparkSession, d: str) -> DataFrame:
    """SET3: the items no table uses."""
    return table(spark, d, "block").join(table(spark, d, "cell").select("block_id"), "block_id", "left_anti").select("block_id", "page_number", "scan_id")


@query(f"WITH {V.MARKS} SELECT page, id, x, CASE WHEN 0.299 * (x % 256) + 0.587 * (y % 256) + 0.114 * (id % 256) < 120 THEN 'FFFFFF' ELSE '000000' END AS ink FROM marks")
def readable_ink(spark: SparkSession, d: str) -> DataFrame:
    """PRJ30: white on fills of a luminance under 120, else black."""
    m = V.marks(spark, d)
    fill = F.concat(*[F.lpad(F.hex(F.col(c) % 256), 2, "0") for c in ("x", "y", "id")])
    return m.select("page", "id", "x", T.readable_ink(fill).alias("ink"))


@query(f"WITH {V.LINES} SELECT block_id, line, ltext, 100.0 * line / n AS y0, 100.0 * (line + 1) / n AS y1 FROM (SELECT *, count(*) OVER (PARTITION BY block_id) AS n FROM lines)")
def stacked_lines(spark: SparkSession, d: str) -> DataFrame:
    """PRJ24: a text's lines as boxes of one height in a box 100 high."""
    b = table(spark, d, "block").where("text is not null").select("block_id", "text", F.lit(0.0).alias("y0"), F.lit(100.0).alias("y1"))
    return geometry.stacked(b).select("block_id", "line", "ltext", "y0", "y1")


@query("""SELECT device_id, strftime(created, '%Y-%m-%d') AS day, arg_min(title, (created, scan_id)) FILTER (title IS NOT NULL) AS title, arg_min(language, (created, scan_id)) FILTER (language IS NOT NULL) AS language,
bool_or(coalesce(handwritten, false)) AS handwritten FROM scan GROUP BY 1, 2""")
def merged_meta(spark: SparkSession, d: str) -> DataFrame:
    """PRJ18: first title and language that are there, any handwriting; the parts are a device's scans of a day."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("created", "scan_id"))).alias(c)
    return table(spark, d, "scan").groupBy("device_id", F.date_format("created", "yyyy-MM-dd").alias("day")).agg(first("title"), first("language"), F.bool_or(F.coalesce("handwritten", F.lit(False))).alias("handwritten"))


@query("SELECT scan_id, coalesce(title, strftime(created, '%Y-%m-%d %H%M')) AS name FROM scan WHERE created IS NOT NULL")
def default_names(spark: SparkSession, d: str) -> DataFrame:
    """PRJ19: a scan without a title is named by its time."""
    return table(spark, d, "scan").where("created is not null").select("scan_id", F.coalesce("title", F.date_format("created", "yyyy-MM-dd HHmm")).alias("name"))


_FILES = _ROWS + r""", st AS (SELECT scan_id, CASE WHEN f = '' THEN 'scan' ELSE f END AS stem, nullif(title, '') AS title FROM (SELECT scan_id, title, substring(regexp_replace(regexp_replace(coalesce(title, ''), '[^\w\- ]+', '', 'g'), '^\s+|\s+$', '', 'g'), 1, 80) AS f FROM scan)),
sh AS (SELECT block_id, max(col_pos) AS w FROM cell GROUP BY 1), ro AS (SELECT DISTINCT block_id, row_pos FROM cell),
pl AS (SELECT ro.block_id, ro.row_pos, unnest(range(w + 1)) AS col_pos FROM ro JOIN sh USING (block_id)),
pa AS (SELECT pl.block_id, pl.row_pos, pl.col_pos, coalesce(c.cell_id, -1) AS cell_id, coalesce(c.text, '') AS text, coalesce(struck, false) AS struck, coalesce(uncertain, false) AS uncertain FROM pl LEFT JOIN cell c ON c.block_id = pl.block_id AND c.row_pos = pl.row_pos AND c.col_pos = pl.col_pos)"""


@query(f"""WITH {_FILES}, ml AS (SELECT block_id, row_pos, max(col_pos) + 1 AS w, '| ' || string_agg(CASE WHEN struck AND text <> '' THEN '~~' || m || '~~' ELSE m END || CASE WHEN uncertain THEN ' ⚠' ELSE '' END, ' | ' ORDER BY col_pos, cell_id) || ' |' AS line
  FROM (SELECT *, replace(replace(text, '|', '\\|'), chr(10), '<br>') AS m FROM pa) GROUP BY 1, 2),
mt AS (SELECT block_id, string_agg(CASE WHEN k = 1 THEN line || chr(10) || '|' || repeat('---|', CAST(w AS INTEGER)) ELSE line END, chr(10) ORDER BY row_pos) AS r FROM (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY row_pos) AS k FROM ml) GROUP BY 1),
parts AS (SELECT b.scan_id, coalesce(b.page_number, 1) AS page, 1 AS part, coalesce(b.block_pos, -1) AS pos, b.block_id,
  CASE WHEN type = 'heading' THEN repeat('#', CAST(least(6, coalesce(level, 1) + CASE WHEN st.title IS NULL THEN 0 ELSE 1 END) AS INTEGER)) || ' ' || coalesce(b.text, '') ELSE coalesce(mt.r, bt.text) END || chr(10) AS text
  FROM block b JOIN bt USING (block_id) LEFT JOIN mt USING (block_id) LEFT JOIN st ON st.scan_id = b.scan_id WHERE b.scan_id IS NOT NULL
 UNION ALL SELECT scan_id, coalesce(page_number, 1), 2, 0, 0, string_agg('- **' || coalesce(key, '') || ':** ' || coalesce(value, ''), chr(10) ORDER BY coalesce(pair_pos, -1), kv_id) || chr(10) FROM key_value WHERE scan_id IS NOT NULL GROUP BY 1, 2),
pg AS (SELECT DISTINCT scan_id, page FROM parts), mk AS (SELECT scan_id, page, 0 AS part, 0 AS pos, 0 AS block_id, '<!-- page ' || page || ' -->' AS text FROM pg WHERE scan_id IN (SELECT scan_id FROM pg GROUP BY 1 HAVING count(*) > 1)),
body AS (SELECT scan_id, string_agg(text, chr(10) ORDER BY page, part, pos, block_id) AS text FROM (SELECT * FROM parts UNION ALL SELECT * FROM mk) GROUP BY 1)
SELECT scan_id, coalesce(stem, 'scan') || '.md' AS file, regexp_replace(coalesce('# ' || title || chr(10) || chr(10), '') || text, '^\\s+|\\s+$', '', 'g') || chr(10) AS text FROM body LEFT JOIN st USING (scan_id)""")
def markdown_files(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK3."""
    return export.export("md", table(spark, d, "scan"), table(spark, d, "block").where("scan_id is not null"), table(spark, d, "cell"), table(spark, d, "key_value"))


@query(f"""WITH {_FILES}, cl AS (SELECT block_id, row_pos, string_agg(CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END, ',' ORDER BY col_pos, cell_id) AS line FROM pa GROUP BY 1, 2),
ct AS (SELECT block_id, string_agg(line, chr(13) || chr(10) ORDER BY row_pos) AS text FROM cl GROUP BY 1),
nu AS (SELECT scan_id, coalesce(page_number, 1) AS page, block_id, row_number() OVER (PARTITION BY scan_id, page_number ORDER BY block_pos NULLS FIRST, block_id) AS n, count(*) OVER (PARTITION BY scan_id) AS k FROM block WHERE type = 'table' AND scan_id IS NOT NULL AND block_id IN (SELECT block_id FROM cell)),
pt AS (SELECT scan_id, regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY page_number NULLS FIRST, block_pos NULLS FIRST, block_id), '^\\s+|\\s+$', '', 'g') AS text FROM bt WHERE scan_id IS NOT NULL AND scan_id NOT IN (SELECT scan_id FROM nu) GROUP BY 1),
al AS (SELECT scan_id, CASE WHEN k > 1 THEN 'page' || page || '_table' || n || '.csv' END AS entry, text FROM nu JOIN ct USING (block_id)
 UNION ALL SELECT scan_id, NULL, array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '[",\\r\\n]') THEN '"' || replace(x, '"', '""') || '"' ELSE x END), chr(13) || chr(10)) FROM pt)
SELECT scan_id, coalesce(stem, 'scan') || CASE WHEN entry IS NULL THEN '.csv' ELSE '.zip' END AS file, entry, chr(65279) || text || chr(13) || chr(10) AS text FROM al LEFT JOIN st USING (scan_id)""")
def csv_files(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK2."""
    return export.export("csv", table(spark, d, "scan"), table(spark, d, "block").where("scan_id is not null"), table(spark, d, "cell"), table(spark, d, "key_value"))


@query()
def json_export(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK5, PRJ20: each document as JSON with a signature of its content."""
    return export.export("json", table(spark, d, "scan"), table(spark, d, "block").where("scan_id is not null"), table(spark, d, "cell"), table(spark, d, "key_value"))


_PLACED = f"""{V.WORDS}, g AS (SELECT *, lag(x0 + w) OVER (PARTITION BY block_id, line ORDER BY word) AS p FROM words),
s AS (SELECT *, sum(CASE WHEN x0 - p > 25 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY block_id, line ORDER BY word) AS segment FROM g),
ln AS (SELECT block_id AS page, CAST(line * 1000 + segment AS BIGINT) AS line_id, string_agg(wtext, ' ' ORDER BY word) AS text, min(x0) AS x0, max(x0 + w) AS x1, line * 12 + 3 * (segment % 3) AS y0, line * 12 + 3 * (segment % 3) + 10 + line % 4 AS y1 FROM s GROUP BY block_id, line, segment),
lv AS (SELECT *, y1 - y0 AS h, (y0 + y1) / 2.0 AS v FROM ln), bd AS (SELECT page, l[len(l) // 2 + 1] AS body FROM (SELECT page, list(h ORDER BY h) AS l FROM lv GROUP BY page)),
b1 AS (SELECT lv.*, body, v - lag(v) OVER o AS dv, lag(h) OVER o AS ph FROM lv JOIN bd USING (page) WINDOW o AS (PARTITION BY page ORDER BY v, x0, line_id)),
b2 AS (SELECT *, sum(CASE WHEN dv IS NULL OR dv > greatest(0.3 * body, 0.5 * least(h, ph)) THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY v, x0, line_id) AS band FROM b1),
b3 AS (SELECT *, max(x1) OVER (PARTITION BY page, band ORDER BY x0, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b2),
b4 AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach - x0 <= 0.5 * (x1 - x0) THEN 1 ELSE 0 END) OVER (PARTITION BY page, band ORDER BY x0, line_id) AS heap FROM b3),
b5 AS (SELECT *, row_number() OVER (PARTITION BY page, band, heap ORDER BY v, x0, line_id) AS deep FROM b4),
placed AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY page ORDER BY band, deep) - 1 AS BIGINT) AS row FROM b5)"""


@query(f"WITH {_PLACED} SELECT page, row, line_id FROM placed")
def visual_rows(spark: SparkSession, d: str) -> DataFrame:
    """WIN8, LAY8."""
    return layout.visual_rows(_page_lines(spark, d))


@query()
def layout_blocks(spark: SparkSession, d: str) -> DataFrame:
    """LAY1, WIN10 to WIN14, WIN24, FLT19, STR7."""
    return layout.layout(_page_lines(spark, d))


@query(f"""WITH {_PLACED}, r1 AS (SELECT *, median(h) OVER (PARTITION BY page, row) AS rh, max(x1) OVER (PARTITION BY page, row ORDER BY x0, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rr FROM placed),
r2 AS (SELECT *, sum(CASE WHEN rr IS NULL OR x0 - rr >= 0.5 * rh THEN 1 ELSE 0 END) OVER (PARTITION BY page, row ORDER BY x0, line_id) AS piece FROM r1),
r3 AS (SELECT page, row, piece, string_agg(text, ' ' ORDER BY x0, line_id) AS text, min(x0) AS x0, max(x1) AS x1, min(rh) AS rh FROM r2 GROUP BY 1, 2, 3),
r4 AS (SELECT *, lag(x1) OVER (PARTITION BY page, row ORDER BY piece) AS px FROM r3),
r5 AS (SELECT page, row, string_agg(CASE WHEN px IS NULL THEN '' WHEN x0 - px < 10 * rh THEN chr(31) ELSE chr(28) END || text, '' ORDER BY piece) AS m FROM r4 GROUP BY 1, 2),
r6 AS (SELECT page, row, string_split(regexp_replace(regexp_replace(regexp_replace(m, '[\\x1f\\x1c][. ]*:', ' :', 'g'), ':(\\d)', chr(27) || '\\1', 'g'), '{layout.LABELLED.replace("'", "''")}', chr(30) || '\\1' || chr(29) || '\\3', 'g'), chr(30)) AS parts FROM r5),
r7 AS (SELECT page, row, unnest(parts[2:]) AS p FROM r6), r8 AS (SELECT page, row, string_split(p, chr(29))[1] AS label, string_split(p, chr(29))[2] AS rest FROM r7),
r9 AS (SELECT *, string_split_regex(rest, '[\\x1f\\x1c]') AS q FROM r8)
SELECT page, row, trim(replace(regexp_replace(label, ' *[.]{{2,}}$', ''), chr(27), ':')) AS key, trim(replace(CASE WHEN trim(q[1]) = '' AND ltrim(rest) LIKE chr(31) || '%' THEN q[2] ELSE q[1] END, chr(27), ':')) AS value FROM r9""")
def form_fields(spark: SparkSession, d: str) -> DataFrame:
    """STR6."""
    return layout.form_fields(_page_lines(spark, d))


@query()
def flat_pages(spark: SparkSession, d: str) -> DataFrame:
    """LAY6, AGG14, AGG15: the heights of lines on pages whose lines sag by their slope."""
    p = _page_lines(spark, d).withColumn("slope", 0.0001 * (F.col("x0") + F.col("x1")) / 2)
    bent = F.col("slope") * (F.col("x0") + F.col("x1")) / 4
    return layout.flattened(p.withColumns({"y0": F.col("y0") + bent, "y1": F.col("y1") + bent})).select("page", "line_id", F.round("v", 6).alias("v"))
