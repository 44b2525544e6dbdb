import datetime as dt
import json

from pyspark.sql import functions as F

from permway.operators import calendar, fold, golden, ingest, metrics
from permway.plans import report
from permway.streaming import incremental

SEEN = "seq bigint, head string, text string, start string, origin string, destination string, seen_at timestamp, legs int"
T0 = dt.datetime(2026, 9, 10, 9, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


ROWS = [
    (1, "A", "+5mins", "s1", "X", "Y", at(0), 1), (2, "A", "+15mins", "s1", None, None, at(30), 1), (3, "A", "+5mins", "s1", "", "", at(60 * 30), 0),
    (4, "B", "due to a signalling issue", "s2", "P", "Q", at(0), 1), (5, "B", "due to congestion", "s2", "R", "S", at(10), 4),
    (6, "C", "x", "s3", "X", "Y", at(0), 1), (7, "D", "x", "s3", "X", "Z", at(5), 1), (8, "D", "x", "s3", None, None, at(9), 1), (9, "E", "x", "s3", None, None, at(9), 1),
    (10, "reduced capacity", "", "s4", "X", "X", at(0), 1), (11, "lost", "", None, None, None, at(0), None), (12, "no time", "", "s1", "X", "Y", None, 1),
]


def test_resolve_and_fold(spark):
    seen = spark.createDataFrame(ROWS, SEEN).withColumns({"last": F.lit(1), "network": F.lit(1), "prev": F.lit(1)})
    want = {
        1: ("own", "X", "Y"), 2: ("single", "X", "Y"), 3: ("single", "X", "Y"), 4: ("network", "Several services", None), 5: ("network", "Several services", None),
        6: ("own", "X", "Y"), 7: ("own", "X", "Z"), 8: ("wording", "X", "Z"), 9: ("none", None, None), 10: ("own", "X", "X"), 11: ("none", None, None),
    }
    for hot in (0, 2, fold.HOT_ROWS):  # each start by itself, some, or none takes the long way
        assert {r.seq: (r.branch, r.route_from, r.route_to) for r in fold.resolve(seen, hot).collect()} == want
    ways = [sorted(map(str, fold.disruptions(seen, hot).collect())) for hot in (0, 2, fold.HOT_ROWS)]
    assert ways[0] == ways[1] == ways[2]
    assert sorted(r.seq for r in fold.updates(seen, 0).collect()) == sorted(r.seq for r in fold.updates(seen).collect())
    folded = {(r.start, r.route): r for r in fold.disruptions(seen).collect()}
    assert len(folded) == 7
    s1 = folded["s1", "X to Y"]
    assert (s1.n_updates, s1.minutes, s1.sightings, s1.text, s1.first_seen, s1.last_seen) == (3, 15, 3, "+5mins", at(0), at(1800))
    assert [c.category for c in folded["s2", "Several services"].causes] == ["signalling", "congestion"]
    assert folded["s4", "X"].is_capacity and not s1.is_capacity
    assert fold.disruptions(seen.limit(0)).count() == 0


def test_calendar(spark):
    found = fold.disruptions(spark.createDataFrame(ROWS, SEEN))
    horizon = spark.createDataFrame([(dt.datetime(2026, 9, 11, 23, 30), 5)], "horizon timestamp, runs bigint")
    days = {str(r.day): r for r in calendar.day_counts(found, horizon, "2026-09-09 00:00:00", "2026-09-20 12:00:00").collect()}
    assert len(days) == 30 and (days["2026-09-10"].total, days["2026-09-11"].total, days["2026-09-12"].total) == (7, 0, 0)
    assert days["2026-09-08"].total is None and not days["2026-09-15"].future and days["2026-09-25"].future
    assert metrics.tiles(found).first().listed == 7


def test_log_to_site(spark, tmp_path):
    body = [{"head": " Signalling issue ", "text": "+5mins late", "start": "s", "locationCodes": ["A"], "eventStops": [{"sStop": "X", "eStop": "Y"}]}, 5, {"head": None}]
    log = [
        {"http_status": 200, "network_error": None, "fetched_at_utc": "2026-09-10T09:00:00Z", "body": json.dumps(body)},
        {"http_status": "200", "network_error": None, "fetched_at_utc": "2026-09-10T10:00:00Z", "body": "[]"},
        {"http_status": 200, "network_error": "timeout", "fetched_at_utc": "2026-09-10T11:00:00Z", "body": "[]"},
        {"http_status": 200, "network_error": False, "fetched_at_utc": "2026-9-10T9:30:00Z", "body": "[]"},
        {"http_status": 200, "network_error": None, "fetched_at_utc": "2026-13-01T00:00:00Z", "body": json.dumps(body)},
        {"http_status": 200, "network_error": None, "fetched_at_utc": "2026-09-10T12:00:00Z", "body": "[] x"},
    ]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "messages-1.jsonl").write_text("\n".join([*map(json.dumps, log), "", "[1]", "{broken"]) + "\n")
    runs = ingest.read_log(spark, str(tmp_path))
    h = ingest.horizon(runs).first()
    assert (h.horizon, h.runs) == (dt.datetime(2026, 9, 10, 9, 30), 2)
    rows = ingest.sightings(runs, ["seq"]).collect()
    assert [(r.head, r.origin, r.legs) for r in rows] == [("Signalling issue", "X", 1), ("", None, 0)]
    seen = ingest.items(ingest.good_runs(runs), ["seq"])
    assert {r.head: r.sightings for r in ingest.distinct_notices(seen, "seq").collect()} == {"Signalling issue": 2, "": 2}
    found = fold.disruptions(ingest.sightings(runs, ["seq"]).withColumn("seq", F.col("item_pos").cast("bigint")))
    corpus = report.Corpus(found, ingest.horizon(runs), "2026-08-08 21:30:55", dt.datetime(2026, 9, 12, tzinfo=dt.UTC))
    size, text = report.write_site(corpus, str(tmp_path / "site"))
    page = (tmp_path / "site" / "index.html").read_text()
    assert size < report.BUDGET_BYTES and (tmp_path / "site" / "m" / "2026-08.html").exists() and (tmp_path / "site" / "robots.txt").exists()
    assert "September 2026 so far:</b> 2 disruptions listed across 1 route" in page and "X to Y" in page and "<!--" not in page and "stale" in page
    assert "%" not in page.split("<main>")[1].split("<script>")[0].replace('style="width:100%"', "")


def test_what_counts_as_a_poll(spark):
    bodies = ['[{"head":"x"}],"c":[1]', '[1]}{"z":[1]', "[1]] , [[2]", "[1],[2]", "[] x", "{}", "[1,]", "[NaN]", "", None, "[[1]", "['a']", ' [ {"a": [1]}, 5 , null] ', "[]"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string")
    assert [r.x for r in df.select("i", ingest.json_array(F.col("b")).alias("x")).orderBy("i").collect()] == [None] * 12 + [['{"a":[1]}', "5", None], []]
    errors = [None, False, 0, 0.0, "", [], {}, "false", "0", "[]", "{}", "timeout", 1, True]
    lines = [json.dumps({"http_status": 200, "network_error": e, "fetched_at_utc": "T", "body": "[]"}) for e in errors]
    lines += [json.dumps({"http_status": s, "network_error": None, "body": b}) for s, b in (("200", "[]"), (True, "[]"), (200.5, "[]"), (200, []), (None, None))] + ["[1]", "", lines[0] + " x", lines[0][:-1], None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    runs = ingest.decode_lines(df)
    assert runs.count() == len(errors) + 5
    assert sorted(r.i for r in ingest.good_runs(runs).collect()) == list(range(7))
    assert ingest.decode_lines(df.limit(0)).count() == 0


def test_golden(spark, tmp_path):
    notices = spark.createDataFrame([("h", "Due to a signalling issue."), ("h", "Due to a kite."), (None, "x")], "head string, text string")
    stored = golden.build(notices.limit(1))
    current = golden.build(notices).withColumn("causes", F.transform("causes", lambda c: c.withField("role", F.lit("root"))))
    assert [r.causes_moved for r in golden.differences(stored, current).collect()] == [True]
    assert golden.gained(stored, current).count() == 2
    golden.dump(golden.merge(stored, current), str(tmp_path / "g.json"))
    assert golden.differences(golden.load(spark, str(tmp_path / "g.json")), current).count() == 0
    assert golden.load(spark, str(tmp_path / "none.json")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    full = spark.createDataFrame(ROWS, SEEN)
    for k in range(3):
        full.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SEEN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.start(stream, str(tmp_path / "seen"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    key = lambda df: sorted((r.start or "", r.route, r.n_updates, r.minutes or -1) for r in df.collect())
    assert key(incremental.current(spark, str(tmp_path / "out"))) == key(fold.disruptions(full))
    late = spark.createDataFrame([(99, "Z", "late", "s4", "X", "X", at(-5), 1)], SEEN)
    incremental.update(str(tmp_path / "seen"), str(tmp_path / "out"))(late, 7)
    assert {r.start for r in spark.read.parquet(str(tmp_path / "out")).where("batch = 7").collect()} == {"s4"}
    assert key(incremental.current(spark, str(tmp_path / "out"))) == key(fold.disruptions(full.unionAll(late)))
