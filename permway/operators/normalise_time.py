"""Problem 1: mixed timestamp formats and zones, to one unambiguous UTC instant."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permway.functions.instants import instant

LOCAL_ZONE = "Europe/Dublin"


def with_instant(df: DataFrame, column: str, zone: str, utc: str = "utc_us", clock: str = "clock") -> DataFrame:
    """`df` with the UTC microseconds of the text `column` and its clock flag.

    Rows stay as they are, in number and in all other columns; a column of `df`
    that is named like a result is replaced. Null, empty, overlong and
    unreadable texts give null and 0.
    """
    parsed = df.withColumn("__instant", instant(F.col(column), zone))
    return parsed.withColumns({utc: F.col("__instant.utc_us"), clock: F.col("__instant.clock")}).drop("__instant")


def unusual_instants(df: DataFrame, table_name: str, id_col: str, column: str, zone: str, usual: str, doubtful: bool) -> DataFrame:
    """Rows whose text names an instant but not in the form `usual` (a regular expression).

    With `doubtful`, also rows in that form whose reading the zone's clock shows
    twice or never. Texts in the usual form need the parser only in that case,
    so without it they are filtered out in front of it.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(column).alias("at")).where("at IS NOT NULL AND at <> ''")
    rows = rows.withColumn("plain", F.col("at").rlike(usual))
    if not doubtful:
        rows = rows.where("NOT plain")
    read = with_instant(rows, "at", zone)
    return read.where("utc_us IS NOT NULL AND (NOT plain OR clock > 0)").select(F.lit(table_name).alias("table_name"), "row_id", "utc_us")


START_FORM = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z"
FETCHED_FORM = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"


def found(sightings: DataFrame, poll_runs: DataFrame) -> DataFrame:
    """p1_found: all unusual or doubtful instants of both tables."""
    a = unusual_instants(sightings, "sightings", "sighting_id", "start", LOCAL_ZONE, START_FORM, doubtful=True)
    b = unusual_instants(poll_runs, "poll_runs", "run_id", "fetched_at_utc", "UTC", FETCHED_FORM, doubtful=False)
    return a.unionAll(b)
