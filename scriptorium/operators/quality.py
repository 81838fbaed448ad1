"""Accuracy of readings: best line match, numbers found, codes made alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import CONFUSABLE, NUMBER_TOKEN


#: Lengths that share a bin when lines are matched.
BIN = 8


def best_line_match(truth: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Least edit distance of each truth line to a candidate of the same document (JOI14, STR4), whole lines of any script.

    Equal lines count once. The candidate next in length gives a bound; only candidates whose length is within it can be nearer,
    and these are found by bins of length, so a long document's lines are not all compared with each other. Truth lines of a
    document without candidates give no row; null lines are left out.
    """
    cand = lines.where("line is not null").select(*keys, "line").distinct().withColumn("_len", F.length("line"))
    want = truth.where("truth is not null").select(*keys, "truth").distinct().withColumn("_len", F.length("truth"))
    every = want.select(*keys, "_len", F.col("truth"), F.lit(None).cast("string").alias("line")).unionByName(cand.select(*keys, "_len", F.lit(None).cast("string").alias("truth"), "line"))
    w = W.partitionBy(*keys).orderBy("_len", F.col("truth").isNotNull(), "line", "truth")
    before = F.last("line", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("line", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    near = every.withColumns({"_a": before, "_b": after}).where("truth is not null")
    bound = F.least(F.levenshtein("truth", "_a"), F.levenshtein("truth", "_b"))
    near = near.select(*keys, "truth", "_len", bound.alias("_most")).where("_most is not null")
    reach = F.sequence(F.floor((F.col("_len") - F.col("_most")) / BIN), F.floor((F.col("_len") + F.col("_most")) / BIN))
    probe = near.where("_most > 0").withColumn("_bin", F.explode(reach))
    binned = cand.select(*keys, "line", F.col("_len").alias("_n"), F.floor(F.col("_len") / BIN).alias("_bin"))
    pairs = probe.join(binned, [*keys, "_bin"]).where(F.abs(F.col("_len") - F.col("_n")) < F.col("_most"))
    exact = F.min(F.when(F.levenshtein("truth", "line") < F.col("_most"), F.levenshtein("truth", "line")))
    nearer = pairs.groupBy(*keys, "truth").agg(exact.alias("_d"))
    best = near.join(nearer, [*keys, "truth"], "left").select(*keys, "truth", F.coalesce("_d", "_most").cast("int").alias("distance"))
    return truth.join(best, [*keys, "truth"]).groupBy(*keys, "truth_id").agg(F.min("distance").alias("distance"))


def number_recall(truth: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """wanted, hits: number tokens of the truth, and how many of them the reading has too, as multisets (STR10, SET2)."""
    count = lambda d, n: d.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(NUMBER_TOKEN), F.lit(0))).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias(n))
    j = count(truth, "t").join(count(read, "r"), [*keys, "token"], "left")
    return j.groupBy(*keys).agg(F.sum("t").alias("wanted"), F.sum(F.least("t", F.coalesce("r", F.lit(0)))).alias("hits"))


def harmonize(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Codes of a document made alike (JOI8), as sets: of each code, the partner of the same length with at most two
    confusable differences and the highest confidence (ties: by text); it replaces the code if it is better by over 0.05, and
    both are flagged if one is within 0.05. Partners share a folded key, in which every confusable glyph is its class, so
    candidates come from an equi-join; each pair is verified glyph by glyph, as classes are not transitive.
    """
    glyphs = sorted({c for p in CONFUSABLE for c in p})
    root = {c: c for c in glyphs}
    for a, b in CONFUSABLE:
        ra, rb = root[a], root[b]
        for c in glyphs:
            if root[c] in (ra, rb):
                root[c] = min(ra, rb)
    code = cells.where(F.col("text").rlike(r"^[A-Za-z0-9().-]{6,}$")).groupBy(*keys, "text").agg(F.max(F.coalesce("conf", F.lit(1.0))).alias("conf"))
    code = code.withColumn("_k", F.translate("text", "".join(glyphs), "".join(root[c] for c in glyphs)))
    a, b = code.alias("a"), code.alias("b")
    pairs = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a._k") == F.col("b._k"), F.col("a.text") != F.col("b.text"), F.length("a.text") == F.length("b.text")])
    pairs = pairs.where(F.col("a.text").rlike(r"\d") | F.col("b.text").rlike(r"\d"))
    both = [p for x in CONFUSABLE for p in (x, x[::-1])]
    diffs = F.filter(F.zip_with(F.split("a.text", ""), F.split("b.text", ""), lambda x, y: F.concat(x, y)), lambda p: F.substring(p, 1, 1) != F.substring(p, 2, 1))
    pairs = pairs.withColumn("_d", diffs).where((F.size("_d") <= 2) & (F.size("_d") * 4 <= F.length("a.text")) & F.forall("_d", lambda p: p.isin(both)))
    best = F.max(F.struct(F.col("b.conf").alias("conf"), F.col("b.text").alias("text")))
    near = F.bool_or(F.abs(F.col("a.conf") - F.col("b.conf")) <= 0.05)
    g = pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.text").alias("text")).agg(F.max("a.conf").alias("_c"), best.alias("_b"), near.alias("_near"))
    better = F.col("_b.conf") > F.col("_c") + 0.05
    return g.select(*keys, "text", F.when(better, F.col("_b.text")).otherwise(F.col("text")).alias("reading"), (better | F.col("_near")).alias("flagged"))


def fix_numeric_tokens(chars: DataFrame, keys: list[str]) -> DataFrame:
    """text of each line, look-alike letters in number-like tokens replaced by their digit runner-up (STR3). Rows: one glyph
    (pos, c, alt, alt_p); a token of at least two digits is mended if its other glyphs are at most a third of the digits (one
    at least), look like digits and have a digit as runner-up."""
    w = W.partitionBy(*keys).orderBy("pos")
    t = chars.withColumn("_tok", F.sum((F.col("c") == " ").cast("int")).over(w)).withColumn("_sp", F.col("c") == " ")
    odd = ~F.col("c").rlike(r"[\d.,/:\-$€£¥₹#%+]") & ~F.col("_sp")
    fixable = F.col("c").rlike("[sSoOlIZzBgqbGT|]") & F.coalesce(F.col("alt"), F.lit("")).rlike(r"^\d$") & (F.coalesce("alt_p", F.lit(0.0)) >= 0.01)
    part = W.partitionBy(*keys, "_tok")
    digits, odds = F.sum(F.col("c").rlike(r"\d").cast("int")).over(part), F.sum(odd.cast("int")).over(part)
    bad = F.sum((odd & ~fixable).cast("int")).over(part)
    t = t.withColumn("_fix", odd & (digits >= 2) & (odds <= F.greatest(F.lit(1.0), digits / 3)) & (bad == 0))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("_fix"), F.col("alt")).otherwise(F.col("c")).alias("g"), "_fix")))
    return t.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["g"]), "").alias("text"), F.bool_or("_fix").alias("flagged"))
