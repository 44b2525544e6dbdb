"""Problem 4: records that are the same but for formatting, collapsed with their counts.

Characters are brought to one form (compatibility forms, accents and case), then
each text becomes its words (runs of letters and digits); texts of labelled
fields become their fields in sorted order. The result is hashed to 128 bits
with 64 more as a check, and the groups are counted with map-side combining.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permway.operators.spread import join_sums
from permway.sources.shared import staged

_WORD = r"[\p{L}\p{N}\p{M}]+"
#: A label at the start of a text or after a separator, with its colon or spaced dash.
_LABEL = r"(?U)(^|[;,/|\n])([^\p{L}\p{N};,/|\n]*)(\p{L}+(?: \p{L}+)?)(\s*:|\s+[-–—]\s)"
_FIRST_LABEL = r"(?U)^[^\p{L}\p{N}]*\p{L}+(?: \p{L}+)?(?:\s*:|\s+[-–—]\s)"
_CUT = "\u0001"
KEY = ["h1", "h2", "check"]


def _folded(text: str) -> str:
    """One form of all characters. Space and case may make new sequences, so they are composed again."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


@F.pandas_udf(T.StringType())
def _fold_characters(text: pd.Series) -> pd.Series:
    return text.map(_folded, na_action="ignore")


def folded(text: Column) -> Column:
    """A text in one form of its characters and without case. Plain ASCII, whose bytes are as many as its characters, stays in the JVM."""
    beyond = F.octet_length(text) > F.length(text)
    return F.coalesce(_fold_characters(F.when(beyond, text)), F.lower(text), F.lit(""))


def _words(text: Column) -> Column:
    return F.concat_ws(" ", F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1)))


def canonical(lower: Column) -> Column:
    """The form of a folded text in which copies are equal.

    A text is one of labelled fields if it starts with a label (one or two
    words with a colon, or a dash between spaces) and another label follows a
    separator; its fields are sorted. Any other text is its words in order.
    """
    fields = F.split(F.regexp_replace(lower, _LABEL, rf"$1{_CUT}$3$4"), _CUT)
    fields = F.array_sort(F.filter(F.transform(fields, _words), lambda x: x != ""))
    labelled = lower.rlike(_FIRST_LABEL) & (F.regexp_count(lower, F.lit(_LABEL)) >= 2)
    return F.when(labelled, F.concat_ws("; ", fields)).otherwise(_words(lower))


def keyed(notices: DataFrame, id_col: str = "notice_id", columns: tuple[str, ...] = ("head", "text")) -> DataFrame:
    """`id` and the group key `h1, h2` (128 bits) with `check` (64 bits) of each row."""
    lower = notices.select(F.col(id_col).alias("id"), *[folded(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = lower.select("id", F.concat_ws("\u0002", *[canonical(F.col(f"c{i}")) for i in range(len(columns))]).alias("key"))
    half = lambda at: F.conv(F.substring("digest", at, 16), 16, -10).cast("bigint")
    rows = rows.select("id", "key", F.md5(F.col("key").cast("binary")).alias("digest"))
    return rows.select("id", half(1).alias("h1"), half(17).alias("h2"), F.xxhash64("key").alias("check"))


def groups(rows: DataFrame) -> DataFrame:
    """`h1, h2, check, keep_id, n`: of keyed rows one row per wording with its smallest id and number of rows.

    Texts whose 128 bits agree by chance differ in `check`, which is part of
    the key, so they stay apart; `collisions` counts such cases. Null, empty
    and wordless texts are one text. Rows with a null id count, but are never kept.
    """
    return rows.groupBy(*KEY).agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))


def collisions(notices: DataFrame, id_col: str = "notice_id", columns: tuple[str, ...] = ("head", "text")) -> DataFrame:
    """`h1, h2, wordings`: 128-bit values that several wordings share; empty unless the hash collides."""
    return groups(keyed(notices, id_col, columns)).groupBy("h1", "h2").agg(F.count("*").alias("wordings")).where("wordings > 1")


def collapse(notices: DataFrame, id_col: str = "notice_id", columns: tuple[str, ...] = ("head", "text")) -> DataFrame:
    """`keep_id, n`: each wording once with its number of copies."""
    return groups(keyed(notices, id_col, columns)).select("keep_id", "n")


def found(notices: DataFrame) -> DataFrame:
    """p4_found: each further copy with the row that is kept.

    The keys are stored once and only groups of several rows are joined back.
    One wording may hold a third of all rows; such groups are broadcast, the
    rest meet by a shuffle (`join_sums`).
    """
    rows = staged(keyed(notices), "copies")
    many = groups(rows).where("n > 1")
    return join_sums(rows, many, KEY, "n", "id").where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
