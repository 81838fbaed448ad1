"""Sources mixed to target shares of tokens by systematic sampling.

A source's documents are laid end to end, each as long as its expected number of copies; one random offset is added, and a
document is given once for each whole number its stretch crosses. So a document has at most ceil(expected) copies and the
source misses its number of copies by less than one. The prefix sums are made in two steps: within blocks of at most
2^BLOCK_BITS rows, and over the blocks' sums, of which there are as many as rows in a 2^BLOCK_BITS-th; so a source that holds
most of the rows is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.tokens import VOCABULARY, with_counts

BLOCK_BITS = 16


def source_name(source):  # noqa: ANN001, ANN201
    """One spelling of a source: lower case, outer blanks cut, - and blanks as _."""
    return F.translate(F.lower(F.trim(source)), "- ", "__")


def expected_copies(targets: list[dict], tokens: dict[str, int], total: int) -> list[dict]:
    """Adds to each target (mix_name, source, target_share, max_repeat, budget_ratio) the wanted tokens and the expected
    copies of each of its documents. A source that would need more than max_repeat copies, or has no documents, gives what it
    can; what it lacks is spread over the mix's other sources by their shares, until nothing is left or all are full."""
    out = []
    for mix in sorted({t["mix_name"] for t in targets}):
        rows = [dict(t) for t in targets if t["mix_name"] == mix and (t["target_share"] or 0) > 0]
        share = sum(r["target_share"] for r in rows)
        for r in rows:
            r["goal"] = r["target_share"] / share
            r["wanted"] = r["goal"] * (r["budget_ratio"] or 0) * total
            r["most"] = max(0, r["max_repeat"] or 0) * tokens.get(r["source"], 0)
            r["given"] = 0.0
        budget = sum(r["wanted"] for r in rows)
        free = list(rows)
        while free and budget > 1e-6:
            part = sum(r["goal"] for r in free)
            full = [r for r in free if r["given"] + budget * r["goal"] / part >= r["most"]]
            if not full:
                for r in free:
                    r["given"] += budget * r["goal"] / part
                break
            for r in full:
                budget -= r["most"] - r["given"]
                r["given"] = float(r["most"])
            free = [r for r in free if r["given"] < r["most"]]
        for r in rows:
            r["copies"] = r["given"] / tokens[r["source"]] if tokens.get(r["source"]) else 0.0
        out += rows
    return out


def _prepared(docs: DataFrame, targets: DataFrame, vocabulary: str) -> tuple[DataFrame, list[dict]]:
    from scriptorium.session import checkpoint

    counted = checkpoint(with_counts(docs, vocabulary).withColumn("source", source_name(F.col("source"))))
    sums = {r.source: r.n for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(targets.select(source_name(F.col("source")).alias("source")).distinct()), "source").collect()}
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    rows = [r.asDict() | {"source": s} for r in targets.withColumn("_s", source_name(F.col("source"))).collect() if (s := r["_s"]) is not None]
    return counted, expected_copies(rows, sums, total)


def _drawn(counted: DataFrame, plan: list[dict], seed: int) -> DataFrame:
    spark = counted.sparkSession
    rows = [(r["mix_name"], r["source"], float(r["copies"])) for r in plan if r["copies"] > 0]
    part = spark.createDataFrame(rows, "mix_name string, source string, copies double")
    part = part.withColumn("offset", F.pmod(F.xxhash64("mix_name", "source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30))
    numbered = counted.withColumn("_row", F.monotonically_increasing_id())
    numbered = numbered.where("n_tokens > 0").withColumn("_block", F.shiftrightunsigned("_row", BLOCK_BITS))
    before = numbered.groupBy("source", "_block").agg(F.count("*").alias("n"))
    before = before.withColumn("_before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("source", "_block").orderBy("n_tokens", "_row"))  # by length: every draw is spread over the lengths
    placed = numbered.withColumn("_rank", rank).join(before.select("source", "_block", "_before"), ["source", "_block"])
    placed = placed.join(F.broadcast(part), "source")
    end = F.col("offset") + F.col("copies") * (F.col("_before") + F.col("_rank"))
    start = F.col("offset") + F.col("copies") * (F.col("_before") + F.col("_rank") - 1)
    return placed.withColumn("n_copies", (F.floor(end) - F.floor(start)).cast("int")).where("n_copies > 0").select("mix_name", "source", "doc_id", "n_tokens", "n_copies")


def mix(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """mix_name, source, doc_id, n_tokens, copy: the chosen records, one row for each copy (1, 2, ...).

    `targets` (mix_name, source, target_share, max_repeat, budget_ratio) is a parameter table and fetched to the driver.
    Shares count relative to their sum within a mix; the total wanted is budget_ratio times the tokens of all documents. Spelt
    variants of a source are one. Null sources, sources absent from a mix, null and empty texts are not drawn; absent sources
    give nothing. Repeated rows are records of their own. The same table, split alike, and seed give the same records.
    """
    counted, plan = _prepared(docs, targets, vocabulary)
    return _drawn(counted, plan, seed).withColumn("copy", F.explode(F.sequence(F.lit(1), "n_copies"))).drop("n_copies")


def shares(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """mix_name, source, target_share (relative), wanted_tokens, reached_tokens, reached_share, full (whether max_repeat
    stopped it): one row for every target."""
    counted, plan = _prepared(docs, targets, vocabulary)
    reached = _drawn(counted, plan, seed).groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("reached"))
    rows = [(r["mix_name"], r["source"], float(r["goal"]), float(r["wanted"]), bool(r["given"] >= r["most"])) for r in plan]
    goal = counted.sparkSession.createDataFrame(rows, "mix_name string, source string, target_share double, wanted_tokens double, full boolean")
    out = goal.join(reached, ["mix_name", "source"], "left").withColumn("reached_tokens", F.coalesce("reached", F.lit(0)).cast("bigint"))
    total = F.sum("reached_tokens").over(W.partitionBy("mix_name"))
    return out.select("mix_name", "source", "target_share", "wanted_tokens", "reached_tokens", F.when(total > 0, F.col("reached_tokens") / total).otherwise(0.0).alias("reached_share"), "full")
