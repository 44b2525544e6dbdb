"""Parquet tables of one data directory."""

from pyspark.sql import DataFrame, SparkSession

#: A scan is spread over the cores where each gets at least so many stored bytes.
SPREAD_BYTES = 64 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the directory `sf_dir`, read lazily.

    A file of one row group is one task, however many cores there are. A table
    of fewer files than cores, all of them small, is therefore dealt out over
    the cores; any larger table has tasks enough and is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(len(df.inputFiles()), stored // (128 * 1024 * 1024))
    wanted = min(cores, stored // SPREAD_BYTES)
    return df.repartition(wanted) if tasks < wanted else df
