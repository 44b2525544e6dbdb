"""Figures of a month: tiles, rankings, routes, pages and histograms."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permway.functions import lexicon as L
from permway.operators.calendar import ZONE, local_day
from permway.sources.shared import staged


def with_month(found: DataFrame, zone: str = ZONE) -> DataFrame:
    return found.withColumn("ym", F.date_format(local_day(F.col("first_seen"), zone), "yyyy-MM"))


def tiles(found: DataFrame, zone: str = ZONE) -> DataFrame:
    """Per month: disruptions, with an origin named, with a consequence, with no cause named. They overlap."""
    has = lambda family: F.exists("causes", lambda c: c["family"] == family)
    silent = F.forall("causes", lambda c: c["family"] == "unstated")
    return with_month(found, zone).groupBy("ym").agg(
        F.count("*").alias("listed"), F.count_if(has("origin")).alias("named"), F.count_if(has("consequence")).alias("blamed"), F.count_if(silent).alias("silent")
    )


def routes_named(found: DataFrame, zone: str = ZONE) -> DataFrame:
    """Per month: the number of different routes, exactly."""
    named = F.when(F.col("route") != L.UNNAMED, F.col("route"))
    return with_month(found, zone).groupBy("ym").agg(F.countDistinct(named).alias("routes"))


def origin_ranking(found: DataFrame, zone: str = ZONE) -> DataFrame:
    """Per month: origin categories by their number of disruptions, then by the first that names them; with the bar's width."""
    rows = with_month(found, zone).select("ym", "first_seen", "route", "first_seq", F.posexplode("causes").alias("pos", "cause")).where("cause.family = 'origin'")
    counts = rows.groupBy("ym", "cause.category", "cause.label").agg(F.count("*").alias("n"), F.min(F.struct("first_seen", "route", "first_seq", "pos")).alias("first"))
    month = Window.partitionBy("ym")  # at most one row per category
    width = F.greatest(F.lit(2), F.bround(100 * F.col("n") / F.max("n").over(month)).cast("int"))
    place = F.row_number().over(month.orderBy(F.desc("n"), "first"))
    return counts.select("ym", "category", "label", "n", width.alias("width"), place.alias("place"))


def paged(found: DataFrame, size: int = 10, zone: str = ZONE) -> DataFrame:
    """Per month, newest first: the place and page of each disruption, the number of pages, and that of disruptions.

    A month may be long, so places come from counts per day and a window over a
    day, not from a window over the month. The columns needed are stored once.
    """
    rows = with_month(found, zone).select("ym", local_day(F.col("first_seen"), zone).alias("day"), "start", "route", "first_seen", "first_seq")
    rows = staged(rows, "paged")
    per_day = rows.groupBy("ym", "day").agg(F.count("*").alias("n"))
    month = Window.partitionBy("ym")  # one row per day
    later = F.coalesce(F.sum("n").over(month.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_day = per_day.select("ym", "day", later.alias("later"), F.sum("n").over(month).alias("listed"))
    within = Window.partitionBy("day").orderBy(F.desc("first_seen"), "route", "first_seq")
    place = F.row_number().over(within) + F.col("later")
    joined = rows.join(per_day, ["ym", "day"])
    return joined.withColumn("place", place).select("ym", "place", F.ceil(F.col("place") / size).alias("page"), F.ceil(F.col("listed") / size).alias("pages"), "listed", "start", "route", "first_seen", "first_seq")


def in_order(found: DataFrame, zone: str = ZONE) -> DataFrame:
    """`place, start, route, first_seen, first_seq`: disruptions numbered by first time, then route, then order of arrival.

    As in `paged`, places come from counts per day and windows over a day.
    """
    rows = staged(found.select("start", "route", "first_seen", "first_seq", local_day(F.col("first_seen"), zone).alias("day")), "in_order")
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    per_day = rows.groupBy("day").agg(F.count("*").alias("n")).select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("day").orderBy("first_seen", "route", "first_seq")
    return rows.join(per_day, "day").select((F.col("earlier") + F.row_number().over(within)).alias("place"), "start", "route", "first_seen", "first_seq")


def capacity_by_month(found: DataFrame, zone: str = ZONE) -> DataFrame:
    return with_month(found.where("is_capacity"), zone).groupBy("ym").agg(F.count("*").alias("n"))


def _each_cause(read: DataFrame) -> DataFrame:
    """One row per cause. An inner explode would have the optimizer test the array beforehand, that is read each notice again."""
    return read.select(F.explode_outer("causes").alias("c")).where("c IS NOT NULL")


def category_histogram(read: DataFrame) -> DataFrame:
    """Over readings: the number of causes by category."""
    return _each_cause(read).groupBy("c.category", "c.label").agg(F.count("*").alias("n"))


def family_histogram(read: DataFrame) -> DataFrame:
    """Over readings: the number of causes by family; a notice may count twice."""
    return _each_cause(read).groupBy("c.family").agg(F.count("*").alias("n"))


def unread_histogram(read: DataFrame) -> DataFrame:
    """Over readings: clauses that no category knows, with their number."""
    return read.select(F.explode_outer("unread").alias("clause")).where("clause IS NOT NULL").groupBy("clause").agg(F.count("*").alias("n"))


def silent(read: DataFrame) -> DataFrame:
    """Readings that state nothing, not even a non-answer."""
    return read.where((F.size("causes") == 0) & (F.size("unread") == 0))
