"""The causes that a notice states, read with the closed lexicon.

The reading is one SQL expression over the sentences of a row. It is put
together as text, since it has some thousand nodes and each would be a call to
the JVM otherwise. Lambda variables are named per function, so none is hidden.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permway.functions import lexicon as L
from permway.functions.textops import readable, split_sentences


def _lit(text: str) -> str:
    """A raw SQL string."""
    quote = '"' if "'" in text else "'"
    if quote in text:
        raise ValueError(f"both kinds of quotes in {text!r}")
    return f"r{quote}{text}{quote}"


def _re(pattern: str) -> str:
    return _lit(L.java(pattern))


def _in(categories: tuple[str, ...]) -> str:
    return ", ".join(map(_lit, categories))


def suppress(causes: str) -> str:
    """Without categories that a more specific one of the same array beats."""
    for n, (winner, losers) in enumerate(L.BEATS.items()):
        won = f"array_contains(transform(sx{n}, sn{n} -> sn{n}.category), {_lit(winner)})"
        causes = f"transform(array({causes}), sx{n} -> filter(sx{n}, sc{n} -> NOT ({won} AND sc{n}.category IN ({_in(losers)}))))[0]"
    return causes


def keep_first(causes: str) -> str:
    """The first cause of each category."""
    kept = "filter(kx, (kc, ki) -> array_position(transform(kx, kn -> kn.category), kc.category) = ki + 1)"
    return f"transform(array({causes}), kx -> {kept})[0]"


def causes_in(clause: str, marker: str, role: str) -> str:
    """Every category that the clause names, in the order of their places, then of their names."""
    hits = ", ".join(
        f"named_struct('category', {_lit(c)}, 'family', {_lit(f)}, 'label', {_lit(label)}, 'matched', regexp_extract({clause}, {_re(p)}, 0))" for c, f, label, p in L.CATEGORIES
    )
    # A match is the first place of its own text, so a plain search finds where it is.
    whole = (
        f"named_struct('at', locate(h.matched, {clause}), 'category', h.category, 'family', h.family, 'label', h.label, 'phrase', {clause}, 'matched', h.matched, "
        f"'marker', {marker}, 'role', {role}, 'earlier', {clause} RLIKE {_re(L.EARLIER)})"
    )
    return suppress(f"array_sort(transform(filter(array({hits}), m -> m.matched <> ''), h -> {whole}))")


def _segments(sentence: str) -> str:
    marks = f"regexp_extract_all({sentence}, {_re(L.MARKER)}, 1)"
    parts = f"split({sentence}, {_re(L.MARKER)}, -1)"
    cut = f"btrim(split(gp, {_re(L.TAIL)}, 2)[0], ' ,.-')"
    zipped = f"transform(array({marks}), gs -> zip_with(gs, slice({parts}, 2, size(gs)), (gm, gp) -> named_struct('marker', lower(gm), 'clause', {cut})))[0]"
    # Most sentences have no marker; a search without word boundaries tells so at less cost.
    maybe = f"{sentence} RLIKE {_lit(L.java(L.MARKER.replace(chr(92) + 'b', '')))}"
    return f"CASE WHEN {maybe} THEN filter({zipped}, gz -> gz.clause <> '') ELSE CAST(array() AS array<struct<marker: string, clause: string>>) END"


def segments(sentence: str) -> Column:
    """(marker, clause) of each cause clause of the column: from its marker to the next, cut where it says something else."""
    return F.expr(_segments(sentence))


def reading(sents: str) -> Column:
    """Struct `causes`, `unread` of the column of a notice's sentences, the head's before the text's."""
    clause = f"named_struct('causes', {causes_in('g.clause', 'g.marker', 'if(gi = 0, ' + _lit('proximate') + ', ' + _lit('root') + ')')}, 'clause', g.clause)"
    marked = f"flatten(transform({sents}, s -> transform({_segments('s')}, (g, gi) -> {clause})))"
    unmarked = f"filter(flatten(transform({sents}, u -> {causes_in('u', _lit(''), _lit('proximate'))})), uc -> uc.category IN ({_in(L.UNMARKED)}))"
    causes = f"CASE WHEN size(cl) > 0 THEN flatten(transform(cl, cx -> cx.causes)) ELSE {unmarked} END"
    unread = "array_distinct(transform(filter(cl, cy -> size(cy.causes) = 0), cz -> cz.clause))"
    return F.expr(f"transform(array({marked}), cl -> named_struct('causes', {suppress(keep_first(causes))}, 'unread', {unread}))[0]")


def with_reading(df: DataFrame, head: str = "head", text: str = "text") -> DataFrame:
    """`df` with `causes` (array of structs) and `unread` (array of texts) of each row.

    No shuffle: a row is read on its own. Call it on distinct wordings, as
    notices repeat theirs. Null fields count as empty; columns named `causes`
    or `unread` are replaced.
    """
    clean = df.withColumns({"__head": readable(F.col(head)), "__text": readable(F.col(text))})
    sents = clean.withColumn("__sents", F.concat(split_sentences(F.col("__head")), split_sentences(F.col("__text"))))
    read = sents.withColumn("__read", reading("__sents"))
    return read.withColumns({"causes": F.col("__read.causes"), "unread": F.col("__read.unread")}).drop("__head", "__text", "__sents", "__read")
