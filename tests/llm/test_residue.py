from permway.llm import residue

BAD = [
    ("Line closed at %s", "Held at A for 5 minutes."), ("+{{ delay | upper }}mins delayed", "x"), ("h", "Held at A for ${minutes} minutes"), ("h", "from &lt;train_no&gt; to B"), ("h", "from <<STATION>> to B"),
    ("h", "owing to @@CAUSE@@."), ("h", "owing to %%CAUSE%%."), ("h", "owing to %(cause)s."), ("h", "owing to ____."), ("h", "owing to __CAUSE__."), ("h", "owing to {0}."), ("h", "[INSERT ETA] late"), ("h", "[cause goes here]"),
    ("+XXXmins delayed", "x"), ("h", "Service from null to null is delayed."), ("h", "The NaN service from A is late."), ("h", "Cause: [object Object]"), ("h", "Late by None minutes at A."), ("h", "+nullmins delayed"),
    ("h", "asdf asdf asdf Ref: 00-0012855"), ("h", "Lorem ipsum dolor sit amet"), ("h", "test test test 123 Log 00-0006547."), ("h", "Your notice text here (log 00-0005655)"), ("Heading", "Heading text / sub heading text"),
    ("h", "[copy to follow]"), ("h", "404 Not Found. The requested address was not found on this server. Ray 00-0000001"), ("h", "&lt;p&gt;Internal Server Error&lt;/p&gt; #00-0000001"), ("h", "java.lang.IllegalStateException: feed not open"),
    ("h", "<title>Error 503</title><h1>Oops! Something went wrong</h1>"), ("h", "Please enable JavaScript to view this page."), ("h", "<noscript>Scripting must be active to show notices</noscript>"), ("502 Bad Gateway", ""),
    ("h", "Log 00-0000001."), ("h", "asdf " * 50_000), ("h", "From: A; To: ; Due: 10:00."), ("", ""), (None, None), (" ", "Log 00-0000001"),
]
REAL = [
    ("Line closed", "TBC: platform for the 10:03 to A, more news at B. Log 00-0000001."), ("h", "The test train from A is delayed."), ("h", "Access to platform 7 is denied to cyclists during works."),
    ("h", "Fares: $5 or 100% refund for the 13:10."), ("h", "The lift service at A is temporarily unavailable; the 06:34 is not affected."), ("h", "Our app may say that a page is not found for A; trains run as planned."),
    ("h", "Server room works at A: gateway 502 of the car park stays shut."), ("h", "Capacity cut by 50% on the 18:26 [coaches 1 to 7] from A."), ("h", "Revised plan {1 of 9} applies between A and B."),
    ("h", "The journey planner needs JavaScript and is down for some phones. Buy on board."), ("h", "Session tickets expired at 12:58 remain valid to A."), ("h", "The 404 service from A to B runs late."),
    ("h", "Bus stop <b>outside A</b> replaces the train.<br>Next update at 10:00.</p>"), ("h", "Ticket machines at A show error 404 due to flooding."), ("h", "None of the trains to A stop at B."), ("", "Delays at A."), (None, "Delays at A."), ("Delays", ""), ("Delays", None),
    ("Forbidden area works near Connolly", "x"), ("Access denied to platform 2", "x"), ("Request blocked line at Bray", "x"), ("Connection closed at Mallow", "x"), ("10:30 10:45", "x"), ("+10/20", "x"),
    ("<h1>Delays</h1>", "Held at A."), ("h", " ".join(f"w{i} a: b;" for i in range(50_000))), ("h", "." * 100_000 + " held at A"),
]


def frame(spark):
    rows = [(i, h, t, "x") for i, (h, t) in enumerate([*BAD, *REAL])]
    return spark.createDataFrame([*rows, rows[0]], "notice_id bigint, head string, text string, kind string")


def test_marks_residue_only(spark):
    got = {r.notice_id for r in residue.found(frame(spark)).collect()}
    both = [*BAD, *REAL]
    wrong = {i for i in got if i >= len(BAD)} | (set(range(len(BAD))) - got)
    assert not wrong, [both[i] for i in wrong]
    assert residue.found(frame(spark)).count() == len(BAD)
    assert residue.found(frame(spark).limit(0)).count() == 0


def test_messages_are_counted_over_their_numbers(spark):
    df = spark.createDataFrame([(i, "Delays", f"502 Bad Gateway Ray 00-000000{i}") for i in range(5)], "notice_id bigint, head string, text string")
    rows = {r.message: (r.n, r.kind) for r in residue.messages(df).collect()}
    assert rows == {"delays": (5, None), "9 bad gateway": (5, "error_page")}


def test_open_phrases_count_where_they_recur_over_sources(spark):
    rows = [(i, "Connection closed at port 7", "x", [f"S{i}"]) for i in range(3)] + [(9 + i, "Access denied to all", "x", ["S1"]) for i in range(5)] + [(20, "Request rejected as of 9:30", "x", None)]
    df = spark.createDataFrame(rows, "notice_id bigint, head string, text string, codes array<string>")
    assert {r.notice_id for r in residue.found(df).collect()} == {0, 1, 2}


def test_cut_messages_count_where_the_whole_recurs(spark):
    whole = "An unexpected error occurred while handling your request"
    rows = [(i, "Delays", whole, [f"S{i}"]) for i in range(4)] + [(10, whole[:27], "x", None), (11, "<p>" + whole[:22], "x", None), (12, whole[:9], "x", None), (13, "Your session has exp", "x", None)]
    df = spark.createDataFrame(rows, "notice_id bigint, head string, text string, codes array<string>")
    assert {r.notice_id for r in residue.found(df).collect()} == {0, 1, 2, 3, 10, 11}


def test_patterns_run_only_on_distinct_messages(spark):
    plan = residue.groups(residue.fields(spark.createDataFrame([(1, "a", "b")], "notice_id bigint, head string, text string"), "notice_id", ("head", "text")))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in text and "RLIKE" not in text[text.index("Aggregate") :]
