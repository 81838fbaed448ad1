"""Documents as a stream of JSON files: flattened as they arrive, repeated uploads dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.operators.flatten import flatten


def uploads(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Uploads from JSON files (upload_id, received_at, payload); an id that comes again within `late` is dropped."""
    raw = spark.readStream.schema("upload_id BIGINT, received_at TIMESTAMP, payload STRING").json(folder)
    return raw.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["upload_id"])


def flat_stream(stream: DataFrame, fields: bool = True) -> DataFrame:
    """The flat rows of a stream of uploads; stateless, so it can follow any source."""
    from pyspark.sql import functions as F

    from scriptorium.schema import PAGE

    return flatten(stream.withColumn("pages", F.lit(None).cast(f"array<{PAGE}>")), fields=fields)
