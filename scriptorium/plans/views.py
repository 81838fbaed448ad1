"""Integer views over the test tables on which the positional operators run, in Spark and as SQL of the same meaning.

Words stand in lines of paragraphs: 8 units a character, 10 high, 12 a line, with a gap of 60 or 4 before a word. Marks come
from the events: a page is 400 events on end, so pages grow in number with the table; x and y are taken from value and id. A
page's rules stand at the left ends of the 50 wide bands its marks are in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.sources import table

LINES = (
    "lines AS (SELECT block_id, scan_id, page_number, block_pos, unnest(l) AS ltext, CAST(unnest(range(len(l))) AS BIGINT) AS line FROM "
    "(SELECT *, string_split(text, chr(10)) AS l FROM block WHERE text IS NOT NULL))"
)
WORDS = LINES + (
    ", w0 AS (SELECT block_id, line, unnest(l) AS wtext, CAST(unnest(range(len(l))) AS BIGINT) AS word FROM (SELECT *, string_split(ltext, ' ') AS l FROM lines))"
    ", w1 AS (SELECT *, CAST(8 * length(wtext) AS BIGINT) AS w, CASE WHEN (block_id * 7 + line * 5 + word * 3) % 9 = 0 THEN 60 ELSE 4 END AS gap,"
    " CAST((block_id * 31 + line * 7 + word * 13) % 101 AS BIGINT) AS conf FROM w0 WHERE wtext <> '')"
    ", words AS (SELECT block_id, line, word, wtext, w, conf, CAST(sum(gap + w) OVER (PARTITION BY block_id, line ORDER BY word) - w AS BIGINT) AS x0 FROM w1)"
)
MARKS = (
    "marks AS (SELECT event_id AS id, event_id // 400 AS page, CAST(floor(abs(value) * 10) AS BIGINT) % 1000 AS x, event_id * 37 % 800 AS y FROM events WHERE value IS NOT NULL)"
    ", rules AS (SELECT page, min(id) AS rule, x // 50 * 50 AS x FROM marks GROUP BY 1, 3)"
    ", cols AS (SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY x) AS BIGINT) AS c, x AS x0, lead(x) OVER (PARTITION BY page ORDER BY x) AS x1 FROM (SELECT DISTINCT page, x FROM rules))"
    ", gcols AS (SELECT * FROM cols WHERE x1 IS NOT NULL)"
    ", grows AS (SELECT page, CAST(r AS BIGINT) AS r, CAST(r * 50 AS BIGINT) AS y0, CAST(r * 50 + 50 AS BIGINT) AS y1 FROM (SELECT DISTINCT page FROM marks), (SELECT unnest(range(16)) AS r))"
)


def lines(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "block").where("text is not null")
    return b.select("block_id", "scan_id", "page_number", "block_pos", F.posexplode(F.split("text", "\n")).alias("_l", "ltext")).withColumn("line", F.col("_l").cast("bigint")).drop("_l")


def words(spark: SparkSession, d: str) -> DataFrame:
    w = lines(spark, d).select("block_id", "line", F.posexplode(F.split("ltext", " ")).alias("_w", "wtext")).withColumn("word", F.col("_w").cast("bigint")).drop("_w").where("wtext <> ''")
    w = w.selectExpr("*", "cast(8 * length(wtext) as bigint) as w", "case when (block_id * 7 + line * 5 + word * 3) % 9 = 0 then 60 else 4 end as gap", "(block_id * 31 + line * 7 + word * 13) % 101 as conf")
    return w.withColumn("x0", (F.sum(F.col("gap") + F.col("w")).over(W.partitionBy("block_id", "line").orderBy("word")) - F.col("w")).cast("bigint")).drop("gap")


def marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value is not null").selectExpr("event_id as id", "event_id div 400 as page", "cast(floor(abs(value) * 10) as bigint) % 1000 as x", "event_id * 37 % 800 as y")


def rules(spark: SparkSession, d: str) -> DataFrame:
    return marks(spark, d).groupBy("page", F.expr("x div 50 * 50").alias("x")).agg(F.min("id").alias("rule"))


def grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = W.partitionBy("page").orderBy("x")
    cols = rules(spark, d).select("page", "x").distinct().select("page", F.row_number().over(w).cast("bigint").alias("c"), F.col("x").alias("x0"), F.lead("x").over(w).alias("x1")).where("x1 is not null")
    rows = marks(spark, d).select("page").distinct().select("page", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("r"))
    return cols, rows.selectExpr("page", "r", "r * 50 as y0", "r * 50 + 50 as y1")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes around marks: page, id, x0, y0, x1, y1."""
    return marks(spark, d).selectExpr("page", "id", "x as x0", "y as y0", "x + 20 + id % 30 as x1", "y + 12 + id % 7 as y1")


BOXES = ", boxes AS (SELECT page, id, x AS x0, y AS y0, x + 20 + id % 30 AS x1, y + 12 + id % 7 AS y1 FROM marks)"
