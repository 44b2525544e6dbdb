import json

from permway.operators import chain, nested, snapshots

RUNS = "run_id bigint, feed string, http_status int, network_error string, fetched_at_utc string, body string"


def poll(run, minute, items, feed="f", status=200, error=None):
    return run, feed, status, error, f"2026-01-01T00:{minute:02d}:00Z", items if isinstance(items, str) or items is None else json.dumps(items)


def item(ref, **fields):
    return {"itemRef": ref, **fields}


def test_changes(spark):
    rows = [
        poll(1, 0, [item("a", head="x"), item("b", head="x", v=[1, 2])]),
        poll(3, 20, '[ {"v":[1.0,2],"itemRef":"b","head":"\\u0078"}, {"itemRef":"c"}, 7, {"itemRef":"c"}, {"head":"no ref"} ]'),
        poll(2, 10, [item("a", head="y"), item("b", v=[2, 1], head="x")]),  # late
        poll(4, 30, [item("b", head="x", v=[1, 2], w=None)]),
        poll(5, 31, "[1,]"),
        poll(6, 32, [], status=500),
        poll(7, 33, [], error="timeout"),
        poll(8, 34, None),
        (9, "f", 200, None, "never", "[]"),
        poll(10, 0, [item("z")], feed=None),
        poll(11, 1, [], feed=None),
        poll(12, 30, [item("b", head="x", v=[1, 2], w=None)]),  # delivered again
    ]
    df = spark.createDataFrame(rows, RUNS)
    got = {(r.run_id, r.item_ref, r.delta, tuple(r.fields or ())) for r in snapshots.changes(df).collect()}
    assert got == {
        (2, "a", "changed", ("head",)), (2, "b", "changed", ("v",)),
        (3, "a", "removed", ()), (3, "b", "changed", ("v",)), (3, "c", "added", ()),
        (4, "c", "removed", ()), (4, "b", "changed", ("w",)),
        (11, "z", "removed", ()),
    }
    assert snapshots.found(df.limit(0)).count() == 0


def test_neighbours_across_spans(spark):
    rows = [(i, "k" if i % 3 else "l", (i * 7919) % 1000) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, key string, at bigint")
    got = {r.id: (r.prev_id, r.next_id) for r in chain.with_neighbours(df, "key", "at", "id", span=100).collect()}
    for key in "kl":
        line = [i for i, k, _ in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))]
        for a, i, b in zip([None, *line], line, [*line[1:], None], strict=False):
            assert got[i] == (a, b)


def test_nested(spark):
    body = [
        item("n1", head="h", locationCodes=["A", None, 5, "B"], eventStops=[{"sStop": "S", "via": {"stop": "V", "platform": {"no": "4"}, "calls": [{"due": "04:52"}, 1]}}, "x", {"sStop": None, "via": [None, {}]}]),
        "odd",
        item("n2", locationCodes="C", eventStops={"sStop": "T", "eStop": "U"}),
        item("n3", locationCodes=None),
    ]
    rows = [poll(1, 0, body, status=503), poll(2, 0, "{}"), poll(3, 0, None), poll(4, 0, "[]"), poll(None, 0, body)]
    df = spark.createDataFrame(rows, RUNS)
    got = {tuple(r) for r in nested.found(df).collect()}
    assert got == {
        (1, 0, "code", 0, -1, "A"), (1, 0, "code", 3, -1, "B"), (1, 0, "leg", 0, -1, "S"), (1, 0, "leg", 2, -1, ""), (1, 0, "via", 0, 0, "V"), (1, 0, "via", 2, 1, ""),
        (1, 2, "code", 0, -1, "C"), (1, 2, "leg", 0, -1, "T"),
    }
    tables = {k: t.collect() for k, t in nested.flatten(df).items()}
    keys = {r.pk for t in tables.values() for r in t}
    assert all(r.parent_pk in keys for k, t in tables.items() if k != "item" for r in t)
    assert tables["via"][0].platform_no in ("4", None) and tables["call"][0].due == "04:52"
    assert nested.found(df.limit(0)).count() == 0


def test_nothing_vanishes_from_nested_records(spark):
    via = [{"stop": "v", "platform": 7, "calls": {"due": "1", "y": None}}, {"stop": "w", "platform": {"no": 2, "side": "L"}}, {"platform": {"no": 3, "z": 1}}]
    body = json.dumps([{"itemRef": "r", "new": {"b": 1, "a": [2]}, "eventStops": [5, {"sStop": "S", "via": via}]}, {"itemRef": "q"}])
    tables = nested.flatten(spark.createDataFrame([(1, body)], "run_id bigint, body string"))
    assert {r.item_ref: r.rest for r in tables["item"].collect()} == {"r": '{"new":{"a":[2],"b":1}}', "q": None}
    assert {(r.pk, r.parent_pk, r.platform_no, r.rest) for r in tables["via"].collect()} == {
        ("1/0/l1/v0", "1/0/l1", None, '{"platform":7}'), ("1/0/l1/v1", "1/0/l1", "2", None), ("1/0/l1/v2", "1/0/l1", "3", '{"platform":{"no":3,"z":1}}'),
    }
    assert [(r.pk, r.due, r.rest) for r in tables["call"].collect()] == [("1/0/l1/v0/a0", "1", '{"y":null}')]
    assert set(nested.flatten(spark.createDataFrame([(1, body)], "run_id bigint, body string"), ("leg",))) == {"leg"}
