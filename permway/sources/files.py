"""Small files by the session's file systems, local or shared."""

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any file has a path of this pattern."""
    fs, at = _system(spark, pattern)
    return bool(fs.globStatus(at))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file, replacing it."""
    fs, at = _system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
