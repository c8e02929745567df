"""Micro-batches: documents that arrive later pair with all facts so far; pairs already stored keep their first verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_pairs(fresh: DataFrame, stored: DataFrame, pairs_of: Callable[[DataFrame], DataFrame], known: DataFrame | None) -> DataFrame:
    """Candidate pairs of which at least one fact is new, without the pairs that ``known`` (a, b) holds."""
    ids = fresh.select(F.col("id").alias("fact"))
    pairs = pairs_of(stored.unionByName(fresh))
    touched = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fact")).join(ids, "fact", "left_semi").select("a", "b").distinct()
    return touched if known is None else touched.join(known.select("a", "b"), ["a", "b"], "left_anti")


def run(spark: SparkSession, source: str, schema, target: str, checkpoint: str, stage: Callable[[DataFrame, int], DataFrame]) -> StreamingQuery:
    """Reads parquet as it arrives and appends what ``stage`` makes of each batch; a batch that is repeated overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        stage(batch, number).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
