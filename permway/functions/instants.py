"""Texts that name instants, in any of the usual makes, to UTC microseconds.

Each text becomes a shape mask (digits `9`, letters `a`, all else as it is). A
mask fixes the place of every part, so it is mapped to a parser once per
process, and a parser takes all texts of its mask at once as columns of
character codes. Local readings go through the zone's table of changes.
"""

from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from permway.functions.zones import ABBREVIATIONS, US, Zones, unpacked, zones

RESULT = "utc_us bigint, clock tinyint"

# English month and day names, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
DAY_NAMES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")

_DATE = r"""(?:
    (?P<Y>9{4})(?P<s1>[-/.])(?P<m>9{1,2})(?P=s1)(?P<d>9{1,2})
  | (?P<d>9{1,2})(?P<s2>[-/.])(?P<m>9{1,2})(?P=s2)(?P<Y>9{4})
  | (?:(?P<w>a{3,9}),?\ )?(?P<d>9{1,2})(?:aa)?\ (?P<mon>a{3,9})\.?,?\ (?P<Y>9{4})
  | (?:(?P<w>a{3,9}),?\ )?(?P<mon>a{3,9})\.?\ (?P<d>9{1,2})(?:aa)?,?\ (?P<Y>9{4})
)"""
_TIME = r"(?P<H>9{1,2})(?P<s3>[:.])(?P<M>9{2}|9(?=[:.]9))(?:(?P=s3)(?P<S>9{1,2})(?:[.,](?P<f>9+))?)?"
_CLOCK = r"(?:\ ?(?P<p>aa)(?!a))?"
_ZONE = r"(?:\ ?(?P<o>[-+−]9{1,2}(?::?9{2})?)|\ ?(?P<z>a+(?:[/_+-][a9]+)*))?(?:\ ?\[(?P<b>[^\]\[]+)\])?"
_SHAPES = [
    rf"{_DATE}(?:(?P<t>a)|,?\ (?:aa\ )?){_TIME}{_CLOCK}{_ZONE}",
    rf"(?P<Y>9{{4}})(?P<m>99)(?P<d>99)(?P<t>a)(?P<H>99)(?P<M>99)(?:(?P<S>99)(?:[.,](?P<f>9+))?)?{_ZONE}",
    r"(?P<Y>9{4})(?P<m>99)(?P<d>99)(?P<H>99)(?P<M>99)(?P<S>99)",
    r"(?P<unix>9{10})",
    r"(?P<unix>9{13})",
]
_GRAMMAR = [regex.compile(rf"\s*{s}\s*", regex.X) for s in _SHAPES]


def mask(text: Column) -> Column:
    """The shape mask of a text, as long as the text in characters."""
    letters = F.regexp_replace(text, r"\p{L}", "a")
    return F.translate(letters, "0123456789", "9999999999")


def python_mask(text: str) -> str:
    """`mask` of one Python string."""
    return "".join("a" if c.isalpha() else "9" if c in "0123456789" else c for c in text)


#: Masks up to this length are remembered; longer ones are as well read, but each time anew.
REMEMBERED = 120


def parser(shape: str):
    """The spans of the parts of every text with this mask, or None if no make fits."""
    return _parser(shape) if len(shape) <= REMEMBERED else _parser.__wrapped__(shape)


@lru_cache(maxsize=4096)
def _parser(shape: str):
    for g in _GRAMMAR:
        if m := g.fullmatch(shape):
            return {k: (m.start(k), m.end(k)) for k in m.groupdict() if m.start(k) >= 0}
    return None


def _number(codes: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(codes), np.int64)
    for k in range(*span):
        out = out * 10 + (codes[:, k].astype(np.int64) - 48)
    return out


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970-01-01, and whether the date exists."""
    fine = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)
    months = (np.where(fine, y, 2000) - 1970) * 12 + np.where(fine, m, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    days = first + d - 1
    return days, fine & (days < after)


def _words(texts: list[str], span: tuple[int, int]) -> list[str]:
    return [t[span[0] : span[1]] for t in texts]


def _offsets(words: list[str]) -> np.ndarray:
    """Seconds of written offsets such as +01:00, -0330, +09; -1 where there is none such."""

    def one(w: str) -> int:
        digits = w[1:].replace(":", "")
        h, m = (int(digits[:-2]), int(digits[-2:])) if len(digits) > 2 else (int(digits), 0)
        return -1 if h > 18 or m > 59 else (h * 3600 + m * 60) * (1 if w[0] == "+" else -1)

    known = {w: one(w) for w in set(words)}
    return np.array([known[w] for w in words], np.int64)


def parse_shape(texts: list[str], shape: str, default: str, rules: Zones) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTC microseconds, clock flag and validity of texts that all have the mask `shape`."""
    n = len(texts)
    none = (np.zeros(n, np.int64), np.zeros(n, np.int8), np.zeros(n, bool))
    if (at := parser(shape)) is None:
        return none
    if "f" in at:  # digits after the sixth are cut off
        a, b = at["f"]
        texts = [t[: min(b, a + 6)] + t[b:] for t in texts]
        shape, gone = shape[: min(b, a + 6)] + shape[b:], b - min(b, a + 6)
        at = {k: (x, y) if y <= a else (a, b - gone) if k == "f" else (x - gone, y - gone) for k, (x, y) in at.items()}
    codes = np.array(texts, dtype=f"U{len(shape)}").view(np.uint32).reshape(n, len(shape))
    if "unix" in at:
        return _number(codes, at["unix"]) * (US if at["unix"][1] - at["unix"][0] == 10 else 1000), none[1], ~none[2]
    part = lambda k: _number(codes, at[k]) if k in at else np.zeros(n, np.int64)
    ok = np.ones(n, bool)
    if "mon" in at:
        names = [w.lower() for w in _words(texts, at["mon"])]
        known = {w: MONTHS.index(w[:3]) + 1 for w in set(names) if w in MONTHS or w in MONTH_NAMES or w == "sept"}
        month = np.array([known.get(w, 0) for w in names], np.int64)
    else:
        month = part("m")
    days, real = _days(part("Y"), month, part("d"))
    ok &= real
    if "w" in at:
        names = [w.lower() for w in _words(texts, at["w"])]
        known = {w: DAYS.index(w[:3]) for w in set(names) if w in DAYS or w in DAY_NAMES}
        ok &= np.array([known.get(w, 9) for w in names]) == (days + 3) % 7
    if "t" in at:
        ok &= np.isin(codes[:, at["t"][0]], [ord("T"), ord("t")])
    hour, minute, second = part("H"), part("M"), part("S")
    zones = [w.strip() for w in _words(texts, at["z"])] if "z" in at else None
    if "p" in at:
        halves = [w.lower() for w in _words(texts, at["p"])]
        am, pm = (np.array([h == x for h in halves]) for x in ("am", "pm"))
        ok &= (am | pm) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + 12 * pm
    ok &= (hour < 24) & (minute < 60) & (second < 60)
    micros = np.zeros(n, np.int64)
    if "f" in at:
        a, b = at["f"]
        micros = _number(codes, (a, min(b, a + 6))) * 10 ** (6 - min(6, b - a))
    local = days * 86400 + hour * 3600 + minute * 60 + second
    clock = np.zeros(n, np.int8)
    if "o" in at:
        off = _offsets(_words(texts, at["o"]))
        ok &= off != -1
        utc = local - off
    else:
        if zones is None and "b" in at:
            zones = _words(texts, at["b"])
        utc = np.zeros(n, np.int64)
        names = np.array(zones if zones is not None else [""] * n, dtype=object)
        for name in set(names):
            rows = names == name
            if name == "":
                table = rules.table(default)
            elif name.upper() in ABBREVIATIONS:
                utc[rows] = local[rows] - ABBREVIATIONS[name.upper()] * 60
                continue
            else:
                table = rules.table(name)
            if table is None:
                ok[rows] = False
            else:
                utc[rows], clock[rows] = table.to_utc(local[rows])
    return utc * US + micros, clock, ok


def parse_texts(texts: pd.Series, masks: pd.Series, default: str, rules: Zones) -> pd.DataFrame:
    """`utc_us` (null if unreadable) and `clock` of a batch; equal texts are parsed once."""
    code, values = pd.factorize(texts, use_na_sentinel=True)
    utc, clock, ok = np.zeros(len(values) + 1, np.int64), np.zeros(len(values) + 1, np.int8), np.zeros(len(values) + 1, bool)
    if len(values):
        where = np.full(len(values), -1)
        rows = np.flatnonzero(code >= 0)
        where[code[rows]] = rows
        shapes = masks.to_numpy()[where]
        kind, kinds = pd.factorize(shapes)
        for k, shape in enumerate(kinds):
            at = np.flatnonzero(kind == k)
            utc[at], clock[at], ok[at] = parse_shape([values[i] for i in at], shape, default, rules)
    utc_us = pd.array(utc[code], dtype="Int64")
    utc_us[~ok[code]] = pd.NA
    return pd.DataFrame({"utc_us": utc_us, "clock": np.where(ok[code], clock[code], 0).astype(np.int8)})


def instant(text: Column, zone: str) -> Column:
    """Struct `utc_us bigint, clock tinyint` of a text; texts without a zone are read in `zone`.

    `utc_us` is null for null, empty and unreadable texts and for dates and
    times that do not exist. `clock` is 1 where the zone's clock shows the
    reading twice, 2 where it never does. The rules of all zones are those of
    the driver, with their version, and sent along. The function counts as not
    deterministic, so that no filter on its result makes it run twice.
    """
    if zones().table(zone) is None:
        raise ValueError(f"no such zone: {zone}")
    packed = zones().packed()

    @F.pandas_udf(RESULT)
    def parse(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        return parse_texts(texts, masks, zone, unpacked(packed))

    return parse.asNondeterministic()(text, mask(text))
