import random

from permway.llm import mixing
from permway.llm.mixing import Target, largest_total, route

DOCS = "doc_id bigint, text string, source string, n_tokens int, bucket int"


def docs(spark):
    rows = [(i, f"word{i} and more of the same kind", "big") for i in range(400)] + [(1000 + i, "a few words here", "small") for i in range(40)]
    rows += [(2000, "x", None), (2001, "x", "untargeted"), (2002, None, "big"), (2003, "", "small"), (2004, "long " * 30_000, "big")]
    return spark.createDataFrame([(*r, 1, 1) for r in rows], DOCS)


def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("none", 0.2, 4)], "source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark):
    m = mixing.mix(docs(spark).where("doc_id <> 2004"), targets(spark))
    rows = {r.source: r for r in m.shares.collect()}
    assert set(rows) == {"big", "small", "none"}
    assert abs(rows["big"].share - 0.625) < 0.02 and abs(rows["small"].share - 0.375) < 0.02 and rows["none"].tokens_used == 0
    chosen = m.selection.collect()
    assert all(r.uses <= {"big": 1, "small": 3}[r.source] for r in chosen) and len({r.doc_id for r in chosen}) == len(chosen)
    assert max(r.uses for r in chosen) == 3
    again = mixing.mix(docs(spark).where("doc_id <> 2004"), targets(spark)).selection.collect()
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, again))


def test_long_and_empty(spark):
    assert mixing.mix(docs(spark), targets(spark)).shares.count() == 3
    empty = mixing.mix(docs(spark).limit(0), targets(spark))
    assert empty.selection.count() == 0 and empty.total == 0 and {r.share for r in empty.shares.collect()} == {0.0}
    assert mixing.mix(docs(spark), targets(spark).limit(0)).selection.count() == 0


def test_flow_prefers_unused_tokens():
    patterns = [(("a", "b"), 100), (("b",), 50)]
    goal = [Target("a", 0.5, 2), Target("b", 0.5, 2)]
    flow = route(patterns, goal, 150)
    assert sum(flow.values()) == 150 and all(k == 1 for _, _, k in flow)
    assert flow[("a", "b"), "a", 1] == 75 and flow[("b",), "b", 1] == 50
    assert largest_total(patterns, goal) in (300, 301)  # quotas are whole tokens
    assert largest_total([(("a",), 10)], [Target("a", 0.5, 3), Target("b", 0.5, 1)]) in (60, 61)


def _brute_total(patterns, goal):
    """The total by the shares of all sets of sources."""
    sets = [{x.source for i, x in enumerate(goal) if n >> i & 1} for n in range(1, 1 << len(goal))]
    gives = lambda some: sum(size * max((x.max_repeats for x in goal if x.source in p and x.source in some), default=0) for p, size in patterns)
    return min(gives(some) / sum(x.share for x in goal if x.source in some) for some in sets)


def test_flow_against_all_sets_of_sources():
    rnd = random.Random(5)
    for _ in range(200):
        names = "abcd"[: rnd.randint(1, 4)]
        patterns = list({tuple(sorted(rnd.sample(names, rnd.randint(1, len(names))))): rnd.randint(1, 10**6) for _ in range(6)}.items())
        weights = [rnd.random() + 0.1 for _ in names]
        goal = [Target(n, w / sum(weights), rnd.randint(1, 4)) for n, w in zip(names, weights, strict=True) if any(n in p for p, _ in patterns)]
        goal = [Target(x.source, x.share / sum(y.share for y in goal), x.max_repeats) for x in goal]
        total = largest_total(patterns, goal)
        assert abs(total - _brute_total(patterns, goal)) < 60
        flow = route(patterns, goal, total)
        assert sum(flow.values()) == sum(round(x.share * total) for x in goal)
        size = dict(patterns)
        for p in size:
            layers = [sum(n for (q, _, k), n in flow.items() if q == p and k == layer) for layer in range(1, 5)]
            assert max(layers) <= size[p]
        assert all(k <= next(x.max_repeats for x in goal if x.source == s) for _, s, k in flow)


def test_many_patterns():
    rnd = random.Random(6)
    names = [f"s{i}" for i in range(12)]
    patterns = list({tuple(sorted(rnd.sample(names, rnd.randint(1, 6)))): rnd.randint(1, 10**7) for _ in range(1500)}.items())
    goal = [Target(n, 1 / 12, rnd.randint(1, 4)) for n in names]
    total = largest_total(patterns, goal)
    assert sum(route(patterns, goal, total).values()) == sum(round(x.share * total) for x in goal)


def test_overlapping_sources(spark):
    rows = [(i, "some words of one kind", ["a", "b"] if i % 2 else ["b"]) for i in range(200)] + [(900, "x", []), (901, "x", None)]
    both = spark.createDataFrame(rows, "doc_id bigint, text string, source array<string>")
    goal = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(both, goal)
    shares = {r.source: r.share for r in m.shares.collect()}
    assert abs(shares["a"] - 0.5) < 0.02 and abs(shares["b"] - 0.5) < 0.02
    assert {r.source for r in m.selection.where("doc_id % 2 = 0").collect()} == {"b"}
