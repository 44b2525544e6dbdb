import random

from permway.llm.leakage import Automaton, automata, found, leaks, scrub, word_form, word_spans

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen"), (2, "Three four five six seven eight nine ten eleven twelve thirteen FOURTEEN, end."), (3, "too short")]
DOCS = [
    (1, "x ONE-two three; four five six seven eight nine ten eleven twelve y"),
    (2, "one two three four five six seven eight nine ten eleven zwölf"),
    (3, "оne twо thre​e four five six ｓｅｖｅｎ eight nine ten eleven twelve thirteen fourteen"),
    (4, None), (5, ""), (6, "too short"), (7, "word " * 100_000), (8, ITEMS[0][1]), (8, ITEMS[0][1]),
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, 0, "c") for i, t in DOCS], "doc_id bigint, text string, item_id int, words string")
    return docs, spark.createDataFrame([(i, t) for i, t in ITEMS] + [(4, None), (5, "")], "item_id bigint, text string")


def test_leaks(spark):
    docs, items = frames(spark)
    rows = sorted(tuple(r) for r in leaks(docs, items).collect())
    assert rows == [(1, 1, 12), (3, 1, 13), (3, 2, 12), (8, 1, 13), (8, 1, 13)]
    assert found(docs.limit(0), items).count() == 0 and found(docs, items.limit(0)).count() == 0


def test_scrub(spark):
    docs, items = frames(spark)
    rows = {r.doc_id: r for r in scrub(docs, items, max_coverage=0.9).collect()}
    assert rows[1].text == "x  y" and rows[1].removed_words == 12
    assert rows[8].text == "" and rows[8].coverage == 1.0
    assert rows[2].text == DOCS[1][1] and 4 not in rows


def test_blocks_find_what_one_automaton_finds(spark):
    docs, items = frames(spark)
    assert len(list(automata(items, block_chars=10))) == 3 and len(list(automata(items))) == 1 and not list(automata(items.limit(0)))
    assert sorted(map(tuple, leaks(docs, items, block_chars=10).collect())) == sorted(map(tuple, leaks(docs, items).collect()))
    for share in (0.5, 0.9):
        one, many = (sorted(map(tuple, scrub(docs, items, max_coverage=share, block_chars=n).collect())) for n in (10, 10**6))
        assert one == many


def test_against_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        words = [chr(97 + rnd.randrange(3)) for _ in range(400)]
        items = [(i, " ".join(words[(a := rnd.randrange(380)) : a + rnd.randrange(3, 30)])) for i in range(6)]
        auto = Automaton(items, 4)
        doc = " ".join(chr(97 + rnd.randrange(3)) for _ in range(80))
        ids = [auto.ids.get(word_form(doc[a:b]), -1) for a, b in word_spans(doc)]
        best, spans = auto.scan(ids)
        want = {}
        for i, text in items:
            n = max((k for k in range(1, 30) for at in range(len(doc.split()) - k + 1) if f" {' '.join(doc.split()[at : at + k])} " in f" {text} "), default=0)
            if n >= 4:
                want[i] = n
        assert best == want
        covered = {at for a, b in spans for at in range(a, b)}
        grams = {tuple(t.split()[k : k + 4]) for _, t in items for k in range(len(t.split()) - 3)}
        assert covered == {at + j for at in range(77) if tuple(doc.split()[at : at + 4]) in grams for j in range(4)}
