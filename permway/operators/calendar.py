"""Months and days, telling a quiet day from one that was not observed."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Europe/Dublin"


def local_day(at: Column, zone: str = ZONE) -> Column:
    """The calendar date of an instant in the zone; the session's zone must be UTC."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def _run(horizon: DataFrame, start: str, zone: str) -> DataFrame:
    """The first days `m` of the months from the first poll to the horizon."""
    month = lambda at: F.trunc(local_day(at, zone), "month")
    return horizon.select(F.explode(F.sequence(month(F.lit(start).cast("timestamp")), month(F.col("horizon")), F.expr("INTERVAL 1 MONTH"))).alias("m"))


def months(found: DataFrame, horizon: DataFrame, start: str, zone: str = ZONE) -> DataFrame:
    """`ym` from the month of the first poll to that of the horizon, and every month that has a disruption."""
    seen = found.select(F.trunc(local_day(F.col("first_seen"), zone), "month").alias("m"))
    return _run(horizon, start, zone).union(seen).where("m IS NOT NULL").select(F.date_format("m", "yyyy-MM").alias("ym")).distinct()


def day_counts(found: DataFrame, horizon: DataFrame, start: str, now: str | None = None, zone: str = ZONE) -> DataFrame:
    """`ym, day, total, future` for every day of every month; `total` is null where nothing was observed, 0 where nothing was listed."""
    month_days = lambda m: F.explode(F.sequence(m, F.last_day(m)))
    none = F.lit(0).cast("bigint")
    run = _run(horizon, start, zone).select(month_days(F.col("m")).alias("day"), none.alias("n"))
    totals = found.where("first_seen IS NOT NULL").groupBy(local_day(F.col("first_seen"), zone).alias("on")).agg(F.count("*").alias("n"))
    # Each day that has disruptions brings all days of its month along, so `found` is needed once.
    seen = totals.select("on", "n", month_days(F.trunc("on", "month")).alias("day")).select("day", F.when(F.col("day") == F.col("on"), F.col("n")).otherwise(none).alias("n"))
    days = run.unionAll(seen).groupBy("day").agg(F.sum("n").alias("n")).withColumn("ym", F.date_format("day", "yyyy-MM"))
    ends = horizon.select(local_day(F.col("horizon"), zone).alias("until"))
    rows = days.crossJoin(F.broadcast(ends))  # one row
    observed = (F.col("day") <= F.col("until")) & (F.col("day") >= local_day(F.lit(start).cast("timestamp"), zone))
    today = local_day(F.lit(now).cast("timestamp"), zone)
    future = ~observed & F.coalesce(F.col("day") > today, F.lit(False))
    return rows.select("ym", "day", F.when(observed, F.col("n")).alias("total"), future.alias("future"))


def day_families(found: DataFrame, zone: str = ZONE) -> DataFrame:
    """`day, family, n`: a disruption counts once per family that it names, under null if it names none."""
    names = F.array_distinct(F.transform("causes", lambda c: c["family"]))
    rows = found.select(local_day(F.col("first_seen"), zone).alias("day"), F.explode_outer(names).alias("family"))
    return rows.groupBy("day", "family").agg(F.count("*").alias("n"))


def band(total: Column, future: Column) -> Column:
    """The code of a day's cell."""
    return F.when(future, "9").when(total.isNull(), "8").when(total < 1, "0").when(total < 4, "1").when(total < 10, "2").otherwise("3")


def caption(total: Column, future: Column) -> Column:
    counted = F.concat(total.cast("string"), F.when(total == 1, " disruption").otherwise(" disruptions"))
    return F.when(future, "still to come").when(total.isNull(), "the collector missed this day").when(total == 0, "nothing listed").otherwise(counted)
