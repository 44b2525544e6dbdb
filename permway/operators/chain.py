"""The neighbours of rows in long per-key sequences, without one task per key."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def with_neighbours(df: DataFrame, key: str, at: str, row_id: str, span: int = DAY_US) -> DataFrame:
    """Add `prev_id` and `next_id`: the ids before and after in the order (`at`, `row_id`) of `key`.

    A key may hold any share of the rows, so its sequence is cut into spans of
    `at`. Windows run inside (key, span); only the first and last id of each
    span, one row per key and span, are lined up by key. Rows with a null `at`
    must be filtered before. Ties in `at` follow `row_id`, which is unique.
    """
    cut = df.withColumn("__span", F.floor(F.col(at) / span))
    inside = Window.partitionBy(key, "__span").orderBy(at, row_id)
    rows = cut.withColumns({"prev_id": F.lag(row_id).over(inside), "next_id": F.lead(row_id).over(inside)})
    order = F.struct(at, row_id)
    ends = cut.groupBy(key, "__span").agg(F.min(order)[row_id].alias("__first"), F.max(order)[row_id].alias("__last"))
    along = Window.partitionBy(key).orderBy("__span")
    ends = ends.select(F.col(key).alias("__key"), F.col("__span").alias("__at"), F.lag("__last").over(along).alias("__before"), F.lead("__first").over(along).alias("__after"))
    joined = rows.join(ends, (F.col(key).eqNullSafe(F.col("__key"))) & (F.col("__span") == F.col("__at")), "left")
    return joined.withColumns({"prev_id": F.coalesce("prev_id", "__before"), "next_id": F.coalesce("next_id", "__after")}).drop("__key", "__at", "__before", "__after", "__span")


def with_previous(df: DataFrame, keys: list[str], at: str, row_id: str, payload: list[str], span: int = DAY_US) -> DataFrame:
    """Add `prev`, a struct of `payload` of the row before in the order (`at`, `row_id`) of `keys`.

    As `with_neighbours`, and `at` may be a timestamp: a key's sequence is cut
    into spans, and only the last payload of each span is lined up by key. The
    first row of a key has a null `prev`.
    """
    micros = F.unix_micros(at) if dict(df.dtypes)[at].startswith("timestamp") else F.col(at)
    named = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"__k{i}") for i, k in enumerate(keys)]
    cut = df.select("*", *named, F.floor(micros / span).alias("__span"), F.struct(*payload).alias("__row"))
    own = [f"__k{i}" for i in range(len(keys))]
    inside = Window.partitionBy(*own, "__span").orderBy(at, row_id)
    rows = cut.withColumn("prev", F.lag("__row").over(inside)).drop("__row")
    ends = cut.groupBy(*own, "__span").agg(F.max_by("__row", F.struct(at, row_id)).alias("__last"))
    ends = ends.withColumn("__before", F.lag("__last").over(Window.partitionBy(*own).orderBy("__span"))).where("__before IS NOT NULL").drop("__last")
    joined = rows.join(ends, [*own, "__span"], "left")
    return joined.withColumn("prev", F.coalesce("prev", "__before")).drop("__before", "__span", *own)
