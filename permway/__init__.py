"""A PySpark engine for railway disruption notices, and operators that prepare large text corpora.

The functions below are the public reading of notices: `with_reading` adds
`causes` and `unread` to notices, `stated` keeps those that say anything,
`of_family` the causes of one family, `disruptions` folds sightings.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permway.functions.causes import with_reading
from permway.functions.lexicon import CATEGORIES, FAMILY, LABEL
from permway.functions.textops import claimed_minutes, plain, readable, sentences
from permway.operators.fold import disruptions, resolve, updates
from permway.operators.ingest import distinct_notices, read_log, sightings
from permway.sources.shared import release


def stated(read: DataFrame) -> DataFrame:
    """The readings that name a cause, a non-answer included."""
    return read.where(F.size("causes") > 0)


def of_family(causes: Column, family: str) -> Column:
    """The causes of an array that belong to a family."""
    return F.filter(causes, lambda c: c["family"] == family)


__all__ = [
    "CATEGORIES", "FAMILY", "LABEL", "claimed_minutes", "disruptions", "distinct_notices", "of_family", "plain", "read_log", "readable", "release", "resolve", "sentences", "sightings", "stated",
    "updates", "with_reading",
]
