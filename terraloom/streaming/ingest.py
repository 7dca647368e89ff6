"""Streams of features into a table of the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terraloom.operators.graph import upsert


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """Write each batch as a new version, ``path``/v<batch>, of the table; what is there stays readable.

    A batch that runs again writes the same version again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        whole = batch if number == 0 else spark.read.parquet(f"{path}/v{number - 1:012d}").unionByName(batch)
        latest = upsert(whole.withColumn("_order", whole[order]), key, "_order").drop("_order")
        latest.write.mode("overwrite").parquet(f"{path}/v{number:012d}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
