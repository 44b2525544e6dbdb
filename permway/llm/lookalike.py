"""Problem 9: text that looks the same, brought to one form of characters.

A transducer reads a text once, from grapheme cluster to grapheme cluster, and
replaces the longest match of its compiled table: invisible characters go,
spaces of any width become U+0020, wide forms, ligatures and letters in a
mathematical style their plain letters, hyphens U+002D, and look-alike letters
of other alphabets, alone or with their accents, the Latin letter they look
like. Case, missing accents and line breaks stay, and so do joiners, selectors
and tags where they change the look: in emoji and flags, in scripts whose
letters join, after Han characters. ASCII characters never become one another
(l, I and 1; 0 and O), or words that differ would be one.
"""

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permway.operators.spread import join_sums
from permway.sources.shared import staged

# Letters of other alphabets by the Latin letter they look like, a choice from Unicode's list of confusable characters (UTS 39).
LOOKALIKES = {
    "a": "аαɑ", "c": "сϲᴄⲥ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іιꭵ", "j": "јϳ", "k": "κ", "l": "ӏ",
    "n": "ո", "o": "оοօᴏⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕꜱꮪ", "u": "υս", "v": "νѵᴠꮩ", "w": "ԝѡᴡꮃ", "x": "х", "y": "уγү", "z": "ᴢꮓ",
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ", "I": "ІΙӀꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ",
    "L": "Ꮮꓡ", "M": "МΜϺᎷꓟⲘ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "ᎡᏒꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ",
    "X": "ХΧꓫⲬ", "Y": "УΥҮᎩꓬⲨ", "Z": "ΖᏃꓜ",
}
# Ways to write a hyphen (soft hyphens are invisible).
HYPHENS = "‐‑˗⁃﹣－"
# Characters without a look of their own beside those of category Cf.
BLANK = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Characters of category Cf that are seen.
SEEN = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
# Letters without their dot, which an accent takes from them.
DOTLESS = {"ı": "i", "ȷ": "j"}
# Scripts in which a joiner or non-joiner changes the shape of letters.
JOINING = (
    "Arabic Syriac Nko Mandaic Mongolian Phags_Pa Manichaean Psalter_Pahlavi Adlam Hanifi_Rohingya Sogdian Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu "
    "Kannada Malayalam Sinhala Tibetan Myanmar Khmer Balinese Javanese Brahmi Chakma Grantha"
).split()
ZWNJ, ZWJ = "\u200c", "\u200d"


def _invisible(c: str) -> bool:
    return c not in SEEN and (unicodedata.category(c) == "Cf" or c in BLANK or "\ufe00" <= c <= "\ufe0f" or "\U000e0000" <= c <= "\U000e0fff")


def _single(c: str) -> str | None:
    """What one character becomes by the rules of width, style, ligature, space and hyphen."""
    if _invisible(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    kind, plain = unicodedata.decomposition(c), unicodedata.normalize("NFKC", c)
    if kind.startswith(("<wide>", "<narrow>")) or "\ufb00" <= c <= "\ufb17" or c in "Ĳĳ" or "Ǆ" <= c <= "ǌ" or "Ǳ" <= c <= "ǳ" or "\u2160" <= c <= "\u217f":
        return plain
    return plain if kind.startswith("<font>") and plain.isascii() and plain.isalnum() else None


@lru_cache(maxsize=1)
def table() -> dict[str, str]:
    """The mapping, made from the rules and checked for conflicts; keys of several characters are letters with their accents.

    Each key has one output, no output holds a key (one pass is enough), and
    no two ASCII characters come together.
    """
    out: dict[str, str] = {}

    def put(key: str, value: str) -> None:
        if out.setdefault(key, value) != value:
            raise ValueError(f"conflict at {ascii(key)}: {out[key]!r} and {value!r}")

    planes = [*range(0x80, 0x3200), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x11000, 0x11100), *range(0x1BCA0, 0x1BCB0), *range(0x1D170, 0x1D180), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE1000)]
    signs = [chr(code) for code in planes if not 0xD800 <= code < 0xE000]
    for c in signs:
        if (value := _single(c)) not in (None, c):
            put(c, value)
    latin = {c: letter for letter, alike in LOOKALIKES.items() for c in alike}
    for c, letter in latin.items():
        put(c, letter)
    for c in signs:
        parts = unicodedata.normalize("NFD", c)
        base, marks = parts[0], parts[1:]
        if not marks or unicodedata.normalize("NFC", c) != c:
            continue
        if base in latin:  # a look-alike that is one character with its accents
            put(c, unicodedata.normalize("NFC", latin[base] + marks))
        for other in LOOKALIKES.get(base, ""):  # a look-alike with the accents of a Latin letter
            put(unicodedata.normalize("NFC", other + marks), c)
    for bare, dotted in DOTLESS.items():
        for mark in map(chr, range(0x300, 0x370)):
            if unicodedata.combining(mark) == 230:
                put(bare + mark, unicodedata.normalize("NFC", dotted + mark))
    for key, value in out.items():
        if (len(key) == 1 and key.isascii()) or any(c in out for c in value):
            raise ValueError(f"not settled in one pass: {ascii(key)}")
    return out


_INVISIBLE_CLASS = "".join(f"\\U{ord(c):08x}" for c, v in table().items() if v == "" and ord(c) < 0xE0000) + "\\U000e0000-\\U000e0fff"
_FOLLOW = rf"[\p{{M}}{_INVISIBLE_CLASS}]"
#: A grapheme cluster that may change, with the invisible characters behind it: one that isn't ASCII, or ASCII with something behind it.
_CLUSTER = regex.compile(rf"[\x00-\x7f]{_FOLLOW}+|(?=[^\x00-\x7f])\X{_FOLLOW}*")
_EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Regional_Indicator}\u20e3]")
_JOINS = regex.compile("[" + "".join(rf"\p{{{s}}}" for s in JOINING) + "]")
_HAN = regex.compile(r"\p{Han}")
_LOOSE = regex.compile(rf"{ZWJ}+$")
_LONGEST = max(map(len, table()))


def _kept(cluster: str) -> str:
    """The invisible characters that change the look of this cluster."""
    if not cluster[0].isascii() or "\u20e3" in cluster:
        if _EMOJI.search(cluster):
            return ZWJ + "\ufe0e\ufe0f" + "".join(c for c in cluster if "\U000e0020" <= c <= "\U000e007f")
        if _JOINS.match(cluster):
            return ZWNJ + ZWJ + "\u180b\u180c\u180d\u180f"
        if _HAN.match(cluster):
            return "".join(c for c in cluster if "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef")
    return ""


def _one_cluster(cluster: str) -> str:
    """One cluster in its one form: what isn't seen taken out, then the longest matches from left to right."""
    t, kept = table(), _kept(cluster)
    seen = "".join(c for c in cluster if c in kept or t.get(c) != "")
    text = unicodedata.normalize("NFC", _LOOSE.sub("", seen) if _EMOJI.search(seen) else seen)
    out, at = [], 0
    while at < len(text):
        for size in range(min(_LONGEST, len(text) - at), 0, -1):
            if (value := t.get(text[at : at + size])) is not None and text[at] not in kept:
                break
        else:
            size, value = 1, text[at]
        out.append(value)
        at += size
    return unicodedata.normalize("NFC", "".join(out))


class Transducer:
    """Applies the table; remembers each cluster it has met, up to a bound."""

    def __init__(self, bound: int = 65_536):
        self.known: dict[str, str] = {}
        self.bound = bound

    def _replace(self, m: regex.Match) -> str:
        key = m[0]
        if (value := self.known.get(key)) is None:
            value = _one_cluster(key)
            if len(self.known) < self.bound:
                self.known[key] = value
        return value

    def __call__(self, text: str) -> str:
        return text if text.isascii() else _CLUSTER.sub(self._replace, text)


transduce = Transducer()


def _natives() -> dict[str, dict[str, str]]:
    """By script: each Latin letter's look-alike in it, the first one listed."""
    out: dict[str, dict[str, str]] = {"CYRILLIC": {}, "GREEK": {}, "ARMENIAN": {}}
    for letter, alike in LOOKALIKES.items():
        for c in alike:
            script = unicodedata.name(c).split()[0]
            if script in out:
                out[script].setdefault(letter, c)
    return out


_NATIVE = _natives()
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_FOREIGN = {script: regex.compile(rf"\p{{{script.title()}}}") for script in _NATIVE}


def readable_form(text: str) -> str:
    """The one form, with words of other scripts wholly in their script.

    After the transducer a word of another script mixes its own letters with
    Latin ones. If it has a letter that only that script has, its look-alikes
    are written in that script; a word without any such letter follows if such
    words are most of the text's words. The choice depends on the transduced
    text alone, so texts that look the same still come out equal.
    """
    form = transduce(text)
    if form.isascii() or not any(p.search(form) for p in _FOREIGN.values()):
        return form
    words = [m[0] for m in _LETTERS.finditer(unicodedata.normalize("NFD", form))]
    owner = lambda w: next((s for s, p in _FOREIGN.items() if p.search(w)), None)
    owners = [owner(w) for w in words]
    main = max(_NATIVE, key=owners.count)
    latin = sum(o is None and any(c.isalpha() and c not in _NATIVE[main] for c in w) for w, o in zip(words, owners, strict=True))
    common = main if owners.count(main) > latin else None

    def write(m: regex.Match) -> str:
        word = m[0]
        script = owner(word)
        if script is None and common and all(c in _NATIVE[common] or unicodedata.combining(c) for c in word):
            script = common
        return "".join(_NATIVE[script].get(c, c) for c in word) if script else word

    return unicodedata.normalize("NFC", _LETTERS.sub(write, unicodedata.normalize("NFD", form)))


@F.pandas_udf(T.StringType())
def _readable(text: pd.Series) -> pd.Series:
    return text.map(readable_form, na_action="ignore")


@F.pandas_udf(T.StringType())
def _transduced(text: pd.Series) -> pd.Series:
    return text.map(transduce, na_action="ignore")


def _beyond_ascii(text: Column) -> Column:
    """The text if it has characters beyond ASCII, so that only such texts leave the JVM."""
    return F.when(F.octet_length(text) > F.length(text), text)


def look_form(text: Column) -> Column:
    """The transduced text, in which texts that look the same are equal; null stays null."""
    return F.coalesce(_transduced(_beyond_ascii(text)), text)


def normalise(df: DataFrame, column: str, to: str = "text_form") -> DataFrame:
    """`df` with the one form of `column`, words of other scripts in their script, as `to`; a column of that name is replaced."""
    return df.withColumn(to, F.coalesce(_readable(_beyond_ascii(F.col(column))), F.col(column)))


LOOK, OWN = ["h1", "h2"], ["r1", "r2"]


def hashed(documents: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """`id`, 128 bits of the one form of its text (`h1, h2`) and of the text itself (`r1, r2`); stored, so that each text is transduced once. Null texts are left out."""
    two = lambda c, names: [F.xxhash64(F.lit(i), c).alias(n) for i, n in enumerate(names)]
    forms = documents.where(F.col(column).isNotNull()).select(F.col(id_col).alias("id"), F.col(column).alias("own"), look_form(F.col(column)).alias("form"))
    return staged(forms.select("id", *two(F.col("form"), LOOK), *two(F.col("own"), OWN)), "looks")


def _mixed(docs: DataFrame) -> DataFrame:
    """`h1, h2, n, class_id`: the looks that at least two different texts have."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in OWN for f in (F.min, F.max)]
    groups = docs.groupBy(*LOOK).agg(*ends, F.count("*").alias("n"), F.min("id").alias("class_id"))
    return groups.where("min_r1 <> max_r1 OR min_r2 <> max_r2").select(*LOOK, "n", "class_id")


def classes(documents: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """`doc_id, class_id, links`: each document whose text looks like a different one.

    `class_id` is the smallest id of its look, `links` the number of documents
    that look the same and differ in characters. This says all that the pairs
    of `same_look` say, in one row per document, however large a class is.
    """
    docs = hashed(documents, id_col, column)
    members = join_sums(docs, staged(_mixed(docs), "mixed"), LOOK, "n", "id")
    texts = staged(members.groupBy(*LOOK, *OWN).agg(F.count("*").alias("same")), "texts")
    return join_sums(members, texts, [*LOOK, *OWN], "same", "id").select(F.col("id").alias("doc_id"), "class_id", (F.col("n") - F.col("same")).alias("links"))


def same_look(documents: DataFrame, id_col: str = "doc_id", column: str = "text", hot: int = 2_000, salts: int = 64) -> DataFrame:
    """p9_found: pairs of documents whose texts look the same and differ in characters.

    Documents are grouped by the hash of their one form with map-side counts;
    only groups with at least two different texts go on. A group of over `hot`
    documents is dealt out over `salts` tasks. Exact copies of a text pair with
    each differing document, not with each other. Null texts have no pair,
    empty texts pair with texts of invisible characters only.
    """
    docs = hashed(documents, id_col, column)
    members = join_sums(docs, staged(_mixed(docs), "mixed"), LOOK, "n", "id")
    members = members.withColumn("salts", F.when(F.col("n") > hot, salts).otherwise(1))
    side = lambda x, salt: members.select(*LOOK, salt.alias("salt"), F.col("id").alias(f"doc_{x}"), F.col("r1").alias(f"{x}1"), F.col("r2").alias(f"{x}2"))
    left = side("a", F.pmod("id", "salts"))
    right = side("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts").cast("bigint") - 1)))
    pairs = left.join(right, [*LOOK, "salt"]).where("doc_a < doc_b AND (a1 <> b1 OR a2 <> b2)")
    return pairs.select("doc_a", "doc_b")
