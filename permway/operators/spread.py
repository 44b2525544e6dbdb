"""Joins with one row per key, where a key may hold any share of the rows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 1000


def join_sums(rows: DataFrame, sums: DataFrame, keys: list[str], size: str, row_id: str, parts: int = PARTS) -> DataFrame:
    """Inner join of `rows` with `sums`, which has one row per key and the key's number of rows as `size`.

    Keys with more than 1/`parts` of all counted rows are hot. There are fewer
    than `parts` of them by arithmetic, so they are broadcast; all other keys
    meet by a shuffle. Rows that have met a hot key pass through that shuffle
    with a hash of `row_id` in the key, so they spread evenly. Null keys meet
    each other. `rows` is computed once, `sums` three times unless it is stored
    or its shuffle is reused; columns of `rows` that are named like a value of
    `sums` must be renamed before.
    """
    values = [c for c in sums.columns if c not in keys]
    named = [F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)]
    total = sums.agg(F.sum(size).alias("__total"))
    ranked = sums.select(*named, F.struct(*values).alias("__v")).crossJoin(F.broadcast(total))  # one row
    is_hot = F.col(f"__v.{size}") * parts > F.col("__total")
    slots = [f"__s{i}" for i in range(len(keys))]
    hot = ranked.where(is_hot).select(*slots, F.col("__v").alias("__hot"))
    cold = ranked.where(~is_hot).select(*slots, F.lit(0).cast("bigint").alias("__place"), "__v")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(s)) for k, s in zip(keys, slots, strict=True)])
    marked = rows.join(F.broadcast(hot), same, "left").drop(*slots)
    spread = F.when(F.col("__hot").isNotNull(), F.greatest(F.lit(1).cast("bigint"), F.abs(F.xxhash64(row_id)))).otherwise(F.lit(0).cast("bigint"))
    met = marked.withColumn("__spread", spread).join(cold, same & (F.col("__spread") == F.col("__place")), "left")
    met = met.withColumn("__v", F.coalesce("__hot", "__v")).where("__v IS NOT NULL")
    return met.select(*rows.columns, *[F.col(f"__v.{v}").alias(v) for v in values])
