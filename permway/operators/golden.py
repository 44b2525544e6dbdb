"""Pinned readings: built, compared and merged as joins on the wording."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permway.functions.causes import with_reading
from permway.sources.files import matches, write_text

CAUSE = ("category", "family", "phrase", "matched", "marker", "role", "earlier")
SCHEMA = (
    "head string, text string, causes array<struct<category: string, family: string, phrase: string, matched: string, marker: string, role: string, earlier: boolean>>, unread array<string>"
)


def build(notices: DataFrame) -> DataFrame:
    """The reading of each different wording."""
    read = with_reading(notices.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("head", "text")]).distinct())
    return read.select("head", "text", F.transform("causes", lambda c: F.struct(*[c[f].alias(f) for f in CAUSE])).alias("causes"), "unread")


def differences(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Wordings in both whose causes or unread clauses moved; growth is no difference."""
    a, b = stored.alias("a"), current.alias("b")
    both = a.join(b, ["head", "text"])
    moved = lambda f: ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    rows = both.select(
        "head", "text", moved("causes").alias("causes_moved"), moved("unread").alias("unread_moved"),
        F.col("a.causes").alias("causes_before"), F.col("b.causes").alias("causes_after"), F.col("a.unread").alias("unread_before"), F.col("b.unread").alias("unread_after"),
    )
    return rows.where("causes_moved OR unread_moved")


def gained(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Current readings of wordings that are not stored."""
    return current.join(stored.select("head", "text"), ["head", "text"], "left_anti")


def merge(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Both together, the current reading where both have one; nothing is dropped."""
    return current.unionByName(gained(current, stored))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A golden document; a missing file is an empty one."""
    if not matches(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(f"readings array<struct<{SCHEMA.replace('head string', 'head: string').replace('text string', 'text: string').replace('causes array', 'causes: array').replace('unread array', 'unread: array')}>>").json(
        path, multiLine=True
    ).select(F.explode("readings").alias("r")).select("r.*")


def dump(document: DataFrame, path: str) -> None:
    """Write a golden document, sorted by wording. It is a reviewed file and small by its nature."""
    rows = [r.asDict(recursive=True) for r in document.orderBy("head", "text").toLocalIterator()]
    write_text(document.sparkSession, path, json.dumps({"readings": rows}, indent=1, sort_keys=True, ensure_ascii=False) + "\n")
