"""A stream of NDJSON files into an index: each micro-batch becomes a segment."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftwell.sources.index import Index
from siftwell.sources.ingest import parse_json


def follow(spark: SparkSession, folder: str, index: Index, checkpoint: str, once: bool = True):
    """Index every line that is a document with an id of its own; lines without one get their batch and place.

    The commit names the batches it has, by the checkpoint, so a batch that is replayed isn't indexed again."""

    def add(batch, n: int) -> None:
        good = parse_json(batch.where(F.trim("value") != ""), "value").where("error is null")
        named = good.select(F.when(F.col("_id") != "", F.col("_id")).otherwise(F.concat(F.lit(f"{n}-"), F.monotonically_increasing_id().cast("string"))).alias("_id"), "fields")
        if not named.isEmpty():
            index.index_all(named, (checkpoint, n))

    writer = spark.readStream.text(folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
