"""Sightings arriving as a stream, with their disruptions kept up to date.

A later sighting can change what earlier ones mean, but only under its own
`start`. So each micro-batch stores its sightings and folds anew just the starts
that it touches; late polls need no watermark. Nothing is rewritten: a fold is
stored under its batch, and of each start the fold of the latest batch counts.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from permway.operators import fold, ingest
from permway.sources.shared import scratch

#: Folders of stored sightings by a hash of their start, so that a batch reads few of those that it doesn't touch.
BUCKETS = 256


def _bucket() -> Column:
    return F.pmod(F.xxhash64(F.isnull("start"), "start"), F.lit(BUCKETS)).cast("int").alias("bucket")


def update(sightings_path: str, out_path: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: store the batch's sightings, then refold the starts that it touches.

    Both tables are partitioned by batch, so a batch that is delivered again
    replaces itself.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        rows = ingest.ours(batch).withColumn("batch", F.lit(batch_id)).select("*", _bucket())
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(sightings_path)
        everything = spark.read.parquet(sightings_path)
        touched = everything.where((F.col("batch") == batch_id)).select("bucket", F.col("start").alias("__start")).distinct()
        if touched.isEmpty():
            return
        buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        seen = everything.where(F.col("bucket").isin(buckets)).join(touched.select("__start"), F.col("start").eqNullSafe(F.col("__start")), "left_semi")
        with scratch(spark):
            folded = fold.disruptions(seen.drop("batch", "bucket")).withColumn("batch", F.lit(batch_id))
            folded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out_path)

    return run


def current(spark: SparkSession, out_path: str) -> DataFrame:
    """The disruptions as of the latest batch: of each start the fold that was made last."""
    folds = spark.read.parquet(out_path)
    last = folds.groupBy(F.col("start").alias("__start")).agg(F.max("batch").alias("__last"))
    return folds.join(last, F.col("start").eqNullSafe(F.col("__start")) & (F.col("batch") == F.col("__last"))).drop("__start", "__last", "batch")


def start(stream: DataFrame, sightings_path: str, out_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run the fold over a stream of sightings (`seq, head, text, start, origin, destination, seen_at, legs`)."""
    writer = stream.writeStream.foreachBatch(update(sightings_path, out_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
