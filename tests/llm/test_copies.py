from permway.llm import copies

FIELDS = "From: Ardsill; To: Tarnfell; Due: 13:55; Log: 00-0000001."
ROWS = [
    (5, "Line closed", "Held at A. Next update at 10:26."), (2, " LINE\nclosed!", "held at a - next  update AT 10.26"), (9, "Line closed", "Held at A; next update at 10:27"),
    (3, "x", FIELDS), (4, "X", "to : tarnfell / log : 00/0000001 / due : 13.55 / from : ardsill"), (6, "x", "DUE - 13:55\nFROM - ARDSILL\nTO - TARNFELL\nLOG - 00-0000001"),
    (7, "x", "From: Tarnfell; To: Ardsill; Due: 13:55; Log: 00-0000001."), (8, None, None), (1, "", " . "), (10, "TBC: a", "TBC: platform, more news"), (11, "TBC: a", "TBC: platform – more news"),
    (12, "h", "w " * 100_000), (13, "h", "W\t" * 100_000), (None, "Line closed", "Held at A. Next update at 10:26."),
]


def frame(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "notice_id bigint, head string, text string, key string, salt int")


def test_copies(spark):
    rows = {tuple(r) for r in copies.found(frame(spark)).collect()}
    assert rows == {(2, 5), (3, 4), (3, 6), (1, 8), (10, 11), (12, 13)}
    assert copies.found(frame(spark).limit(0)).count() == 0


def test_characters_are_one(spark):
    rows = [(1, "caf\u00e9", "x"), (2, "cafe\u0301", "x"), (3, "c\uff41f\u00e9", "x"), (4, "CAFE\u0301", "x"), (5, "cafe", "x"), (6, "stra\u00dfe", "x"), (7, "STRASSE", "x"), (8, "x\u0302y", "x"), (9, "x y", "x")]
    df = spark.createDataFrame(rows, "notice_id bigint, head string, text string")
    assert {tuple(r) for r in copies.found(df).collect()} == {(1, 2), (1, 3), (1, 4), (6, 7)}


def test_counts(spark):
    counts = {r.keep_id: r.n for r in copies.collapse(frame(spark)).collect()}
    assert counts == {2: 3, 9: 1, 3: 3, 7: 1, 1: 2, 10: 2, 12: 2}
    assert copies.collisions(frame(spark)).count() == 0
