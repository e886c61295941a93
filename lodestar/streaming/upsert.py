"""Upserts as a stream: the row with the greatest order of each key, kept as state and written when it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order. State grows with the keys: a table without deletions has no watermark."""
    rest = [c for c in stream.columns if c not in (*keys, *order)]
    return stream.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("row")).select(*keys, "row.*")


def upsert_available(stream: DataFrame, keys: list[str], order: list[str], folder: str) -> DataFrame:
    """Run the stream over all that is there, and read the table that it has kept.

    Every batch writes the keys that it changed under its own number, so a
    batch that runs again overwrites itself; the table is the last row of each
    key over all batches.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = latest(stream, keys, order).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/rows").drop("batch")
    return latest(rows, keys, order)
