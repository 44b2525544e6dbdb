import pytest
from pyspark.sql import functions as F

from permway.functions.causes import with_reading
from permway.functions.textops import claimed_minutes, plain, readable, sentences

NOTICES = [
    ("+20mins delayed", "Running late due to a signalling issue at Stop 3.", [("signalling", "proximate")], []),
    ("+20mins delayed", "Held due to congestion caused by a technical issue ahead.", [("congestion", "proximate"), ("technical", "root")], []),
    ("Expect +5/90 minutes", "Late because of an earlier service delay and a speed restriction.", [("knock_on", "proximate"), ("infrastructure", "proximate")], []),
    ("Line closed", "Closed following an incident where a vehicle struck a bridge.", [("vehicle_strike", "proximate")], []),
    ("Line closed", "Stopped following an incident on the line.", [("incident", "proximate")], []),
    ("+5mins delayed", "Delayed owing to an operational issue.", [("unspecified", "proximate")], []),
    ("+5mins delayed", "Delayed due to a fallen kite on the track.", [], ["a fallen kite on the track"]),
    ("Platform change", "Leaves from platform 2 today.", [], []),
    ("Signalling issue", "Staff are working on it.", [("signalling", "proximate")], []),
    ("+5 delayed", "Delayed due to a passenger issue and will skip stops to ease congestion.", [("passenger", "proximate")], []),
    ("Update at 09:15 - Trains moving", "Resumed after works. Due to planned works, this service runs late. We apologise for any inconvenience caused.", [("planned", "proximate")], []),
    ("Delays", "Ash &amp;amp; Elm<br>Due to a level crossing issue.", [("level_crossing", "proximate")], []),
    ("Delays", "Late arising from the late arrival of a train following a medical emergency.", [("knock_on", "proximate"), ("passenger", "root")], []),
    (None, None, [], []),
]


def test_readings(spark):
    rows = [(i, h, t) for i, (h, t, _, _) in enumerate(NOTICES)]
    df = with_reading(spark.createDataFrame(rows, "i int, head string, text string"))
    got = {r.i: ([(c.category, c.role) for c in r.causes], list(r.unread)) for r in df.collect()}
    for i, (_, _, causes, unread) in enumerate(NOTICES):
        assert got[i] == (causes, unread), NOTICES[i]


def test_very_long_notice(spark):
    text = "Late due to a signalling issue, the 10:00 waits - " * 5_000
    row = with_reading(spark.createDataFrame([("h", text, 1)], "head string, text string, causes int")).first()
    assert [c.category for c in row.causes] == ["signalling"] and not row.unread


def test_earlier_and_marker(spark):
    df = with_reading(spark.createDataFrame([("", "Late BECAUSE OF an earlier service delay.")], "head string, text string"))
    (c,) = df.first().causes
    assert (c.marker, c.earlier, c.family, c.matched, c.phrase) == ("because of", True, "consequence", "earlier service delay", "an earlier service delay")


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("A &amp;amp; B<br/>C</p>", "A & B. C."),
        ("x .. . y", "x. y"),
        ("&#38;lt;b&gt;bold", "bold"),
        (None, ""),
        (". " * 100_000 + "x", ". x"),
    ],
)
def test_plain(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(plain(F.col("t"))).first()[0] == clean


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Update at 17:24 - Trains moving", "Trains moving"),
        ("Iarnród Éireann apologises for any inconvenience caused.. ", ""),
        ("Held at A. We apologise or the inconvenience caused. -CL", "Held at A. We"),
        ("IARNRÓD ÉIREANN APOLOGISE FOR THE INCONVENIENCE CAUSED", ""),
        ("06:00hrs. Late - AP", "Late"),
    ],
)
def test_readable(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(readable(F.col("t"))).first()[0] == clean


@pytest.mark.parametrize(
    ("raw", "parts"),
    [
        ("The 17.43 is late. It waits - here; now? yes!", ["The 17.43 is late", "It waits", "here", "now", "yes"]),
        ("at 14.50. The next", ["at 14.50. The next"]),
        ("well-known", ["well-known"]),
        ("", []),
    ],
)
def test_sentences(spark, raw, parts):
    assert spark.createDataFrame([(raw,)], "t string").select(sentences(F.col("t"))).first()[0] == parts


@pytest.mark.parametrize(
    ("head", "text", "minutes"),
    [("+15/20 minutes", "", 15), ("+25 delayed", "late 40 mins", 40), ("x", None, None), ("1234mins", "", 234), ("15-20 mins", "", 20), ("5 minuteswise", "", None)],
)
def test_minutes(spark, head, text, minutes):
    df = spark.createDataFrame([(head, text)], "h string, t string")
    assert df.select(claimed_minutes(F.col("h"), F.col("t"))).first()[0] == minutes
