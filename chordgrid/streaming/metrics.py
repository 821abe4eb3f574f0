"""Running means of image metrics over a stream of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

METRICS = ("count_avg", "n_ccpts", "maxes", "devs")


def running_means(batches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Streams (batch, count_avg, n_ccpts, maxes, devs) to one Parquet row of sums for each micro-batch under ``path``.

    A micro-batch that is run again after a failure writes its own folder over, so nothing counts twice.
    """

    def add(rows: DataFrame, number: int) -> None:
        sums = rows.agg(F.count("*").alias("batches"), *[F.sum(m).alias(m) for m in METRICS])
        sums.write.mode("overwrite").parquet(f"{path}/part={number}")

    return batches.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(df: DataFrame) -> DataFrame:
    """The sums so far, divided by the batches so far."""
    n = F.sum("batches")
    return df.agg(n.alias("batches"), *[(F.sum(m) / n).alias(m) for m in METRICS])
