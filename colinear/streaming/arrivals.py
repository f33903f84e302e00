"""Newly arriving query sequences, seeded against a fixed target set batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colinear.operators.seeds import seed_blocks


def seed_arrivals(arrivals: DataFrame, target: DataFrame, out: str, checkpoint: str, k: int = 15, most: int = 1, **trigger) -> StreamingQuery:
    """Writes the seed blocks of each micro-batch of ``arrivals`` (seq_id, seq) to ``out``, one folder per batch.

    A batch that is run again after a failure overwrites its own folder, so each
    block is there once. Frequencies are those of the batch and of the target.
    """

    def each(batch: DataFrame, number: int) -> None:
        found = seed_blocks(batch, target, k, most=most)
        found.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
