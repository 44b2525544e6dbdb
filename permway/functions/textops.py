"""Cleaning of notice texts as column functions."""

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from permway.functions import lexicon as L


@F.pandas_udf(T.StringType())
def _unescaped_twice(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(html.unescape(t)), na_action="ignore")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def plain(text: Column) -> Column:
    """One line of text: entities decoded twice, markup out, white space and full stops collapsed. Null gives ''.

    Only texts with an ampersand are handed to Python.
    """
    t = F.coalesce(text, F.lit(""))
    t = F.coalesce(_unescaped_twice(F.when(F.contains(t, F.lit("&")), t)), t)
    t = F.regexp_replace(t, L.java(L.BLOCK), ". ")
    t = F.regexp_replace(t, L.TAG, " ")
    t = squeeze(t)
    return F.regexp_replace(t, r"(?U)\s*\.[\s.]*\.", ".")


def readable(text: Column) -> Column:
    """`plain` without apologies, initials of the author and the time stamp of an update."""
    t = F.regexp_replace(plain(text), L.java(L.APOLOGY), " ")
    t = F.regexp_replace(t, r"(?U)" + L.INITIALS, "")
    t = F.regexp_replace(t, L.java(L.UPDATE_STAMP), "")
    return F.btrim(squeeze(t), F.lit(" .,-"))


def sentences(text: Column) -> Column:
    """`readable`, split where a thought ends; an array without empty parts."""
    return split_sentences(readable(text))


def split_sentences(clean: Column) -> Column:
    parts = F.split(clean, r"(?U)" + L.SENTENCE, -1)
    parts = F.filter(parts, lambda p: F.btrim(p, F.lit(" ,.")) != "")
    return F.transform(parts, lambda p: F.btrim(p, F.lit(" ,")))


def claimed_minutes(head: Column, text: Column) -> Column:
    """The first figure of minutes of the head, else of the text; the lower end of a range."""

    def figure(t: Column) -> Column:
        return F.regexp_extract(F.coalesce(t, F.lit("")), L.java(L.MINUTES), 1).try_cast("int")

    return F.coalesce(figure(head), figure(text))
