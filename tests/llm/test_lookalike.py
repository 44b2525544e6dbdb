import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from permway.llm.lookalike import LOOKALIKES, classes, look_form, normalise, readable_form, same_look, table, transduce

CASES = [
    ("Ｔｈｅ ｃａｒ", "The car"), ("a​b­c﻿", "abc"), ("a b c d　e", "a b c d e"), ("conﬁrm ﬂood", "confirm flood"),
    ("é", "é"), ("е́", "é"), ("on‐call‑x", "on-call-x"), ("Тhе ѕіgn", "The sign"), ("ı́", "í"), ("ż̨", unicodedata.normalize("NFC", "ż̨")),
    ("e​́", "é"), ("𝗔Ꭺꓮ", "AAA"), ("ⲞⅬⅼᴠ", "OLlv"), ("е̂́", "ế"), ("ёά", "ëá"), ("a‌️b", "ab"),
]
KNOWN_APART = {"\u03ba", "\u04cf", "\u051a"}  # kappa, small palochka and capital qa are as Latin ones in most fonts
SAME = ["", "plain", "É é", "a\nb\tc", "two  spaces", "№ ½ ² …", "’“”–", "I l 1 0 O", "paypa1", "👨\u200d👩\u200d👧", "❤\ufe0f", "1\ufe0f\u20e3", "می\u200cخواهم", "क्\u200dष", "葛\U000e0100", "🏴\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f"]


def test_forms():
    for text, form in CASES:
        assert transduce(text) == form, ascii(text)
    for text in SAME:
        assert transduce(text) == text
    assert transduce("A") != transduce("a") and transduce("é") != transduce("e")


def test_other_scripts_keep_their_letters():
    real = "Повідомлення 00. Поїзд о 16:42 через рух і а. Tarnmere"
    assert readable_form(real) == real
    assert readable_form(real.replace("о", "o").replace("ї", "ї")) == real
    assert readable_form("Тhе саr") == "The car"


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=30))
def test_once_is_enough(text):
    form = transduce(text)
    assert transduce(form) == form
    assert transduce(readable_form(text)) == form


@settings(max_examples=200, deadline=None)
@given(st.text("abceopxyABCEHé -\n", max_size=30), st.randoms())
def test_disguises_come_back(text, rnd):
    disguised = "".join(rnd.choice([c, *LOOKALIKES.get(c, ""), unicodedata.normalize("NFD", c), c + "​"]) for c in text)
    assert transduce(disguised) == transduce(text) == text


def test_table_is_checked():
    t = table()
    assert not any(len(k) == 1 and k.isascii() for k in t) and all(c not in t for v in t.values() for c in v)
    assert max(map(len, t)) == 3 and sum(map(len, LOOKALIKES.values())) < 200


def test_lookalikes_are_confusable_by_unicode(spark):
    """Spark's own class path holds the list of UTS 39; it takes I and l as one, and some letters only as small forms."""
    skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
    apart = {c for letter, alike in LOOKALIKES.items() for c in alike if skeleton(c) != skeleton(letter)}
    assert apart == KNOWN_APART


def test_pairs(spark):
    texts = ["car", "cаr", "car", "Car", None, None, "", "​", "саr", "x" * 500_000, "x" * 499_999 + "х"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, h1 int, salt int")
    want = {(0, 1), (1, 2), (0, 8), (1, 8), (2, 8), (6, 7), (9, 10)}
    for hot in (1, 1000):
        rows = [tuple(r) for r in same_look(docs, hot=hot, salts=3).collect()]
        assert len(rows) == len(want) and set(rows) == want
    by_class = {r.doc_id: (r.class_id, r.links) for r in classes(docs).collect()}
    assert by_class == {0: (0, 2), 1: (0, 3), 2: (0, 2), 8: (0, 3), 6: (6, 1), 7: (6, 1), 9: (9, 1), 10: (9, 1)}
    assert classes(docs.limit(0)).count() == 0
    assert same_look(docs.limit(0)).count() == 0
    assert normalise(docs.withColumnRenamed("h1", "text_form"), "text").where("doc_id = 4").first().text_form is None
    assert docs.where("text IS NULL").select(look_form(docs["text"]).alias("f")).first().f is None
