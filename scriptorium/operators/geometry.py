"""Operators on positions: words, lines, segments, columns, rules, grids, marks. Groups are pages or lines (`keys`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lines_of_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """text, x0, x1, conf, uncertain by line: words joined from left to right; any word under 70 is a doubt (AGG1, FLT2)."""
    parts = F.array_sort(F.collect_list(F.struct("x0", "word", "wtext")))
    return words.groupBy(*keys).agg(
        F.array_join(F.transform(parts, lambda p: p["wtext"]), " ").alias("text"), F.min("x0").alias("x0"), F.max(F.col("x0") + F.col("w")).alias("x1"),
        F.avg("conf").alias("conf"), F.bool_or(F.col("conf") < 70).alias("uncertain"),
    )


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """Running number of the island each row is in; `new` tells of a row whether it begins one (null: it does)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce(new.cast("int"), F.lit(1))).withColumn(name, F.sum("_new").over(w).cast("bigint")).drop("_new")


def segments(words: DataFrame, keys: list[str], height: int = 10) -> DataFrame:
    """Words split where the gap to the last word is over max(2.2 heights, 25) (WIN1)."""
    w = W.partitionBy(*keys).orderBy("word")
    gap = F.col("x0") - F.lag(F.col("x0") + F.col("w")).over(w)
    return islands(words, keys, ["word"], gap > max(2.2 * height, 25), "segment").groupBy(*keys, "segment").agg(F.min("x0").alias("x0"), F.max(F.col("x0") + F.col("w")).alias("x1"), F.count("*").alias("n"))


def merged_segments(words: DataFrame, keys: list[str], height: int = 10) -> DataFrame:
    """Pieces joined while they begin less than half a height after the running right end (WIN2)."""
    w = W.partitionBy(*keys).orderBy("x0", "word")
    reach = F.max(F.col("x0") + F.col("w")).over(w.rowsBetween(W.unboundedPreceding, -1))
    return islands(words, keys, ["x0", "word"], F.col("x0") - reach >= height // 2, "segment").groupBy(*keys, "segment").agg(F.min("x0").alias("x0"), F.max(F.col("x0") + F.col("w")).alias("x1"), F.count("*").alias("n"))


def column_starts(pieces: DataFrame, keys: list[str], tol: int) -> DataFrame:
    """starts: a new column where a start is over tol from the last column's first start (WIN4); a fold, as the anchor does
    not move. The starts of one page are few."""
    fold = F.aggregate(
        F.sort_array(F.collect_set("x0")), F.array().cast("array<bigint>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) > tol), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return pieces.groupBy(*keys).agg(fold.alias("starts")).select(*keys, F.posexplode("starts").alias("_c", "start")).select(*keys, F.col("_c").cast("bigint").alias("col"), "start")


def rule_positions(points: DataFrame, keys: list[str], at: str, reach: int = 4) -> DataFrame:
    """Chains of positions at most `reach` apart, as their mean (WIN3)."""
    w = W.partitionBy(*keys).orderBy(at)
    d = points.select(*keys, at).distinct()
    return islands(d, keys, [at], F.col(at) - F.lag(at).over(w) > reach).groupBy(*keys, "island").agg(F.count("*").alias("n"), F.avg(at).alias("position"))


def row_clusters(points: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Rows of centres whose gap to the last is below `gap`, with their mean and the boundary to the next row (WIN6)."""
    w = W.partitionBy(*keys).orderBy(at)
    d = points.select(*keys, at).distinct()
    g = islands(d, keys, [at], F.col(at) - F.lag(at).over(w) >= gap, "cluster").groupBy(*keys, "cluster").agg(F.avg(at).alias("centre"), F.count("*").alias("n"))
    nxt = F.lead("centre").over(W.partitionBy(*keys).orderBy("cluster"))
    return g.withColumn("boundary", (F.col("centre") + nxt) / 2)


def grid_cells(points: DataFrame, cols: DataFrame, rows: DataFrame) -> DataFrame:
    """Points in the cells of their page's grid, half open on both sides (JOI1). cols (page, c, x0, x1) and rows (page, r, y0,
    y1) share the page with the points, so both joins hash on it and the range is a residual filter."""
    p = points.join(cols, (points.page == cols.page) & (points.x >= cols.x0) & (points.x < cols.x1)).drop(cols.page)
    return p.join(rows, (p.page == rows.page) & (p.y >= rows.y0) & (p.y < rows.y1)).select(p.page, "id", "r", "c")


def empty_cells(cols: DataFrame, rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Cells of the grid that hold no point (JOI4): rows and columns of a page joined by page, less the taken ones."""
    return rows.join(cols, "page").select("page", "r", "c").join(taken.select("page", "r", "c").distinct(), ["page", "r", "c"], "left_anti")


def column_of(points: DataFrame, rules: DataFrame) -> DataFrame:
    """id, col: the number of the page's rules left of the point (JOI2). The rules of a page are few and become an array."""
    arr = rules.groupBy("page").agg(F.collect_list("x").alias("_rules"))
    n = F.size(F.filter(F.coalesce("_rules", F.array().cast("array<bigint>")), lambda r: r < F.col("x")))
    return points.join(arr, "page", "left").select("page", "id", n.cast("bigint").alias("col"))


def main_rules(points: DataFrame, rules: DataFrame, least: int = 2) -> DataFrame:
    """Rules with at least two points on each side (JOI3)."""
    j = points.select("page", F.col("x").alias("_px")).join(rules, "page")
    g = j.groupBy("page", "rule", "x").agg(F.sum((F.col("_px") < F.col("x")).cast("bigint")).alias("left_n"), F.sum((F.col("_px") >= F.col("x")).cast("bigint")).alias("right_n"))
    return g.where((F.col("left_n") >= least) & (F.col("right_n") >= least))


def overlap_antijoin(new: DataFrame, old: DataFrame, most: float = 0.3) -> DataFrame:
    """Boxes of `new` that overlap no box of their page in `old` by more than `most` of the smaller area (JOI6)."""
    n, o = new.alias("n"), old.alias("o")
    w = F.greatest(F.lit(0), F.least("n.x1", "o.x1") - F.greatest("n.x0", "o.x0"))
    h = F.greatest(F.lit(0), F.least("n.y1", "o.y1") - F.greatest("n.y0", "o.y0"))
    area = lambda t: (F.col(f"{t}.x1") - F.col(f"{t}.x0")) * (F.col(f"{t}.y1") - F.col(f"{t}.y0"))
    return n.join(o, (F.col("n.page") == F.col("o.page")) & (w * h > F.least(area("n"), area("o")) * most), "left_anti").select("n.*")


def nearest(points: DataFrame, marks: DataFrame) -> DataFrame:
    """id, mark: the page's nearest mark, the smaller position where two are as near (JOI11, JOI12)."""
    arr = marks.groupBy("page").agg(F.array_sort(F.collect_set("x")).alias("_marks"))
    best = F.array_min(F.transform("_marks", lambda m: F.struct(F.abs(m - F.col("x")).alias("d"), m.alias("m"))))
    return points.join(arr, "page").select("page", "id", best["m"].alias("mark"))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half (AGG4). Equal values are summed before the window."""
    d = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    run = F.sum("_w").over(W.partitionBy(*keys).orderBy(value))
    total = F.sum("_w").over(W.partitionBy(*keys))
    return d.withColumn("_run", run).withColumn("_total", total).where(F.col("_run") * 2 >= F.col("_total")).groupBy(*keys).agg(F.min(value).alias("median"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper middle element (AGG2). By counts of equal values and a running sum, so no group is gathered as an array."""
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = F.sum("_n").over(W.partitionBy(*keys).orderBy(value))
    total = F.sum("_n").over(W.partitionBy(*keys))
    return d.withColumn("_run", run).withColumn("_total", total).where(F.col("_run") > F.floor(F.col("_total") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median absolute deviation by the upper median (AGG5)."""
    mid = upper_median(df, keys, value)
    dev = df.join(mid, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    return upper_median(dev.select(*keys, "_dev"), keys, "_dev").withColumnRenamed("median", "spread")


def quantile_at(df: DataFrame, keys: list[str], value: str, f: float) -> DataFrame:
    """The element at floor(f n), clamped (AGG7)."""
    n = F.count("*").over(W.partitionBy(*keys))
    k = F.row_number().over(W.partitionBy(*keys).orderBy(value))
    return df.where(F.col(value).isNotNull()).withColumn("_n", n).withColumn("_k", k).where(F.col("_k") == F.least(F.col("_n"), F.floor(F.col("_n") * f) + 1)).select(*keys, F.col(value).alias("quantile"))


def rule_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """x = a y + b by least squares with the mean absolute residual (AGG13)."""
    fit = points.groupBy(*keys).agg(F.regr_slope("x", "y").alias("a"), F.regr_intercept("x", "y").alias("b"))
    return points.join(fit, keys).groupBy(*keys).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.avg(F.abs(F.col("x") - F.col("a") * F.col("y") - F.col("b"))).alias("residual"))


def coverage(boxes: DataFrame, keys: list[str], row: str, width: int) -> DataFrame:
    """Rows that cover each bin of the page's width (AGG12)."""
    b = boxes.select(*keys, row, F.explode(F.sequence(F.floor(F.col("x0") / width), F.floor(F.col("x1") / width))).alias("bin"))
    return b.groupBy(*keys, "bin").agg(F.count_distinct(row).alias("rows"))


def column_gaps(cover: DataFrame, keys: list[str], allowed: int) -> DataFrame:
    """Midpoints of the thinnest stretches of runs of bins that at most `allowed` rows cover (WIN9)."""
    w = W.partitionBy(*keys).orderBy("bin")
    thin = cover.where(F.col("rows") <= allowed)
    runs = islands(thin, keys, ["bin"], F.col("bin") - F.lag("bin").over(w) > 1, "run")
    low = runs.withColumn("_low", F.min("rows").over(W.partitionBy(*keys, "run"))).where(F.col("rows") == F.col("_low"))
    v = W.partitionBy(*keys, "run").orderBy("bin")
    sub = islands(low, [*keys, "run"], ["bin"], F.col("bin") - F.lag("bin").over(v) > 1, "part")
    return sub.groupBy(*keys, "run", "part").agg(((F.min("bin") + F.max("bin") + 1) / 2).alias("gap"))


def local_reference(df: DataFrame, keys: list[str], order: str, value: str, reach: int = 2) -> DataFrame:
    """The greatest value within `reach` rows on either side (WIN17)."""
    return df.withColumn("reference", F.max(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)))


def repair_sequence(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Expected number of each row: the commonest offset value - index, the first seen among equals (AGG9, WIN15)."""
    idx = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    d = df.withColumn("_i", idx)
    votes = d.where(F.col(value).isNotNull()).groupBy(*keys, (F.col(value) - F.col("_i")).alias("_o")).agg(F.count("*").alias("n"), F.min("_i").alias("f"))
    win = votes.groupBy(*keys).agg(F.max_by("_o", F.struct("n", -F.col("f"))).alias("_offset"))
    return d.join(win, keys, "left").withColumn("expected", (F.col("_offset") + F.col("_i")).cast("bigint")).drop("_i", "_offset")


def collapse_repeats(steps: DataFrame, keys: list[str], blank: str) -> DataFrame:
    """A sequence of best classes without blanks and repeats of the one before (WIN20)."""
    w = W.partitionBy(*keys).orderBy("t")
    kept = steps.withColumn("_prev", F.lag("best").over(w)).where((F.col("best") != blank) & (F.col("_prev").isNull() | (F.col("_prev") != F.col("best"))))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "best"))), lambda x: x["best"]), "").alias("text"))


def tiles(pages: DataFrame, grid: int, overlap: float) -> DataFrame:
    """Overlapping rectangles of grid x grid tiles (PRJ10)."""
    cell = F.sequence(F.lit(0), F.lit(grid - 1))
    t = pages.withColumn("r", F.explode(cell)).withColumn("c", F.explode(cell))
    edge = lambda size, i, far: F.least(F.col(size), F.floor((F.col(i) + 1) * F.col(size) / grid + F.col(size) / grid * overlap)) if far else F.greatest(F.lit(0), F.floor(F.col(i) * F.col(size) / grid - F.col(size) / grid * overlap))
    return t.select("page", "r", "c", edge("width", "c", False).cast("bigint").alias("x0"), edge("height", "r", False).cast("bigint").alias("y0"), edge("width", "c", True).cast("bigint").alias("x1"), edge("height", "r", True).cast("bigint").alias("y1"))


def size_groups(values: DataFrame, keys: list[str], value: str, factor: float) -> DataFrame:
    """group (its first value) of each value: a value joins while it is at most `factor` times the first of the group (WIN5)."""
    fold = F.aggregate(
        F.sort_array(F.collect_set(value)), F.array().cast("array<bigint>"),
        lambda acc, x: F.when((F.size(acc) == 0) | (x > F.try_element_at(acc, F.lit(-1)) * factor), F.concat(acc, F.array(x))).otherwise(acc),
    )
    return values.groupBy(*keys).agg(fold.alias("_g")).select(*keys, F.explode("_g").alias("first"))


def cuts(fixed: DataFrame, loose: DataFrame, tol: int) -> DataFrame:
    """page, x: the fixed cuts, and each loose one that is more than tol from all cuts taken before it (WIN7, SET4)."""
    f = fixed.groupBy("page").agg(F.sort_array(F.collect_set("x")).alias("_f"))
    g = loose.groupBy("page").agg(F.sort_array(F.collect_set("x")).alias("_l")).join(f, "page", "left")
    taken = F.aggregate(F.col("_l"), F.coalesce("_f", F.array().cast("array<bigint>")), lambda acc, x: F.when(F.exists(acc, lambda c: F.abs(c - x) <= tol), acc).otherwise(F.concat(acc, F.array(x))))
    return g.select("page", F.explode(taken).alias("x"))


def bands(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """triples, flips and whether the rows alternate: at least four triples, three quarters of which change sign (AGG21)."""
    w = W.partitionBy(*keys).orderBy(order)
    d1, d2 = F.col(value) - F.lag(value).over(w), F.lag(value).over(w) - F.lag(value, 2).over(w)
    t = rows.withColumn("_a", d1).withColumn("_b", d2).where("_a is not null and _b is not null")
    g = t.groupBy(*keys).agg(F.count("*").alias("triples"), F.sum((F.col("_a") * F.col("_b") < 0).cast("bigint")).alias("flips"))
    return g.withColumn("banded", (F.col("triples") >= 4) & (F.col("flips") * 4 >= F.col("triples") * 3))


def alignment(x0: str, x1: str, left: str, right: str) -> Column:
    """left, center or right: how a text stands in its column, by its margins (PRJ23)."""
    before, after, wide = F.col(x0) - F.col(left), F.col(right) - F.col(x1), F.col(right) - F.col(left)
    inside = (before >= 0) & (after >= 0)
    return (
        F.when(inside & (after < 0.35 * before) & (before > 0.08 * wide), "right")
        .when(inside & (F.abs(before - after) < 0.2 * wide) & (before > 0.15 * wide), "center").otherwise("left")
    )


def sideways(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """n, tall, sideways: whether over 60 per cent of at least three boxes are taller than 1.5 times their width (FLT22)."""
    tall = F.sum((F.col("y1") - F.col("y0") > 1.5 * (F.col("x1") - F.col("x0"))).cast("bigint"))
    g = boxes.groupBy(*keys).agg(F.count("*").alias("n"), tall.alias("tall"))
    return g.withColumn("sideways", (F.col("n") >= 3) & (F.col("tall") > 0.6 * F.col("n")))


def orientation_sample(boxes: DataFrame, keys: list[str], k: int = 24) -> DataFrame:
    """Of the k widest boxes those more than twice as wide as high (SRT5)."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.col("x1") - F.col("x0")), "id"))
    return boxes.withColumn("_k", rank).where("_k <= %d and x1 - x0 > 2 * (y1 - y0)" % k).drop("_k")


def sure(readings: DataFrame, least: float, strict: bool = True) -> DataFrame:
    """Readings (text, score) that are not blank and above `least`, or at least that (FLT1, SRC9)."""
    return readings.where((F.trim("text") != "") & ((F.col("score") > least) if strict else (F.col("score") >= least)))


def on_tile_edge(boxes: DataFrame, tile: int, size: int, near: int) -> DataFrame:
    """Boxes that come within `near` of a border between tiles; the outer borders of the page do not count (FLT8)."""
    low = lambda c: (F.col(c) % tile <= near) & (F.col(c) >= tile)
    high = lambda c: (F.col(c) % tile >= tile - near) & (F.col(c) < size - tile)
    return boxes.where(low("x0") | high("x1") | low("y0") | high("y1"))


def alone(markers: DataFrame, entries: DataFrame, height: int) -> DataFrame:
    """Markers with no entry whose centre is within half a `height` of theirs (FLT9). Centres are binned by the height, so the
    anti-join is on equal page and bin, a marker looking in its bin and the two next to it."""
    centre = (F.col("y0") + F.col("y1")) / 2
    m = markers.withColumn("_c", centre)
    e = entries.select(F.col("page").alias("_page"), centre.alias("_e")).withColumn("_bin", F.floor(F.col("_e") / height))
    e = e.select("_page", "_e", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)).alias("_bin")).distinct()
    on = (F.col("page") == F.col("_page")) & (F.floor(F.col("_c") / height) == F.col("_bin")) & (F.abs(F.col("_c") - F.col("_e")) < height / 2)
    return m.join(e, on, "left_anti").drop("_c")


def stacked(texts: DataFrame) -> DataFrame:
    """The lines of a text as boxes of one height in its box (PRJ24)."""
    t = texts.withColumn("_l", F.split("text", "\n")).withColumn("_h", (F.col("y1") - F.col("y0")) / F.size("_l"))
    t = t.select("*", F.posexplode("_l").alias("_i", "ltext")).withColumn("line", F.col("_i").cast("bigint"))
    return t.withColumns({"y1": F.col("y0") + (F.col("_i") + 1) * F.col("_h"), "y0": F.col("y0") + F.col("_i") * F.col("_h")}).drop("_l", "_h", "_i", "text")
