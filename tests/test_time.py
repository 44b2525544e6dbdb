import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from permway.functions.instants import parse_shape, python_mask
from permway.functions.zones import unpacked, zone_table, zones
from permway.operators import normalise_time


def read(text, zone="Europe/Dublin"):
    utc, clock, ok = parse_shape([text], python_mask(text), zone, zones())
    return (dt.datetime.fromtimestamp(0, dt.UTC) + dt.timedelta(microseconds=int(utc[0]))).strftime("%Y-%m-%dT%H:%M:%S.%f") if ok[0] else None


@pytest.mark.parametrize(
    ("text", "utc"),
    [
        ("2026-07-01T10:00:00", "2026-07-01T09:00:00.000000"),
        ("2025-10-26T01:30:00", "2025-10-26T00:30:00.000000"),  # shown twice: the earlier instant
        ("2026-03-29T01:30:00", "2026-03-29T01:30:00.000000"),  # never shown: the offset before
        ("2026-07-01 10:00:00 IST", "2026-07-01T09:00:00.000000"),
        ("2026-01-01 10:00:00 IST", "2026-01-01T09:00:00.000000"),
        ("2026-07-01 10:00:00UTC", "2026-07-01T10:00:00.000000"),
        ("2026-07-01 10:00 Europe/Dublin", "2026-07-01T09:00:00.000000"),
        ("2026-07-01T10:00:00.1234567+02:00[Europe/Dublin]", "2026-07-01T08:00:00.123456"),
        ("01/02/2026 03:04", "2026-02-01T03:04:00.000000"),
        ("1.2.2026 03.04", "2026-02-01T03:04:00.000000"),
        ("1 April 2026, 12:14 am", "2026-03-31T23:14:00.000000"),
        ("Wed, 1 Apr 2026 16:09:00 GMT", "2026-04-01T16:09:00.000000"),
        ("Thu, 1 Apr 2026 16:09:00 GMT", None),
        ("20260701T100000Z", "2026-07-01T10:00:00.000000"),
        ("20260701100000", "2026-07-01T09:00:00.000000"),
        ("1760924520", "2025-10-20T01:42:00.000000"),
        ("1760924520123", "2025-10-20T01:42:00.123000"),
        ("2026-3-2T4:5:6Z", "2026-03-02T04:05:06.000000"),
        ("2026-02-30T10:00:00", None),
        ("2026-01-01T24:00:00", None),
        ("2026-01-01T10:00:00+25:00", None),
        ("13:10 pm", None),
        ("tbc", None),
        (" " * 70 + "2026-03-01T10:00:00", "2026-03-01T10:00:00.000000"),
        ("2026-03-01T10:00:00." + "7" * 70 + "+01:00", "2026-03-01T09:00:00.777777"),
        ("2026-03-01T10:00:00." + "7" * 300_000, "2026-03-01T10:00:00.777777"),
        ("2026-07-01 10:00 Eire", "2026-07-01T09:00:00.000000"),
        ("2026-07-01 10:00 europe/dublin", "2026-07-01T09:00:00.000000"),
        ("2026-07-01 10:00 Etc/GMT+5", "2026-07-01T15:00:00.000000"),
        ("2026-07-01 10:00 Nowhere", None),
        ("2150-07-01T10:00:00", "2150-07-01T09:00:00.000000"),
        ("2150-01-01T10:00:00", "2150-01-01T10:00:00.000000"),
        ("9150-07-01T10:00:00", "9150-07-01T09:00:00.000000"),
        ("", None),
        ("9" * 5000, None),
    ],
)
def test_forms(text, utc):
    assert read(text) == utc


@settings(max_examples=200, deadline=None)
@given(st.datetimes(dt.datetime(1850, 1, 1), dt.datetime(9990, 1, 1)), st.sampled_from(["Europe/Dublin", "America/St_Johns", "Asia/Kolkata", "Africa/Casablanca"]))
def test_against_zoneinfo(local, zone):
    local = local.replace(microsecond=0)
    expected = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(dt.UTC)
    import numpy as np

    utc, _ = zone_table(zone).to_utc(np.array([int((local - dt.datetime(1970, 1, 1)).total_seconds())]))
    assert dt.datetime.fromtimestamp(int(utc[0]), dt.UTC) == expected


def test_found(spark):
    seen = spark.createDataFrame(
        [(1, "2026-07-01T10:00:00", 5), (2, "2025-10-26T01:30:00", 5), (3, None, 5), (4, "1760924520", 5), (4, "1760924520", 5), (5, "", 5), (None, "1760924520", 5)],
        "sighting_id bigint, start string, utc_us int",
    )
    runs = spark.createDataFrame([(1, "2026-07-01T10:00:00Z"), (2, "2026-07-01T10:00:00"), (3, "x")], "run_id bigint, fetched_at_utc string")
    rows = {(r.table_name, r.row_id) for r in normalise_time.found(seen, runs).collect()}
    assert rows == {("sightings", 2), ("sightings", 4), ("sightings", None), ("poll_runs", 2)}
    assert normalise_time.found(seen.limit(0), runs.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([("2026-07-01T10:00:00Z", 1, 2)], "at string, utc_us int, clock int")
    row = normalise_time.with_instant(df, "at", "UTC").first()
    assert (row.utc_us, row.clock) == (1782900000000000, 0)


def test_zones_are_sent_along():
    copy = unpacked(zones().packed())
    assert copy.version == zones().version and len(zones().packed()) < 1_000_000
    assert (copy.table("Asia/Tokyo").offsets == zones().table("Asia/Tokyo").offsets).all()


def test_each_text_is_parsed_once(spark):
    seen = spark.createDataFrame([(1, "2026-07-01T10:00:00")], "sighting_id bigint, start string")
    runs = spark.createDataFrame([(1, "2026-07-01T10:00:00Z")], "run_id bigint, fetched_at_utc string")
    assert normalise_time.found(seen, runs)._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
