"""Sightings folded into disruptions: a stable identity under fields that drift.

All that decides the identity of a sighting is known within its `start`, so one
shuffle by `start` is enough to resolve and to find changes of wording; rows go
through it with the 128-bit id of their wording instead of its text. A start of
very many sightings would be one long task, so its rows take another way, by
sums that are combined where they lie and by windows over parts of a sequence,
with the same result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permway.functions import lexicon as L
from permway.functions.causes import with_reading
from permway.functions.textops import claimed_minutes
from permway.operators.chain import with_previous
from permway.operators.spread import join_sums
from permway.sources.shared import staged

KEY = ["start", "route_from", "route_to"]
WORDING = ["w1", "w2"]
#: A start of more sightings is hot. They are some 100 bytes each in a window, which can spill.
HOT_ROWS = 2_000_000

_ROUTED = "origin IS NOT NULL OR destination IS NOT NULL"


def _at() -> Column:
    return F.struct("seen_at", "seq")


def _route() -> Column:
    return F.when(F.expr(_ROUTED), F.struct("origin", "destination"))


def start_facts(seen: DataFrame) -> DataFrame:
    """Per start: its number of sightings `n`, `network` (ever more than one leg), `single` (carries just one route) and that route as `one`."""
    combos = seen.groupBy("start", "origin", "destination").agg(F.max(F.coalesce("legs", F.lit(0))).alias("legs"), F.count("*").alias("n"))
    facts = combos.groupBy("start").agg(F.sum("n").alias("n"), (F.max("legs") > 1).alias("network"), (F.count_if(F.expr(_ROUTED)) == 1).alias("single"), F.max(_route()).alias("one"))
    return facts.select("start", "n", "network", "single", "one")


def wording_routes(seen: DataFrame) -> DataFrame:
    """Per start and wording: the number of sightings `n`, and the route of the latest routed one as `last`."""
    return seen.groupBy("start", *WORDING).agg(F.count("*").alias("n"), F.max_by(_route(), F.when(F.expr(_ROUTED), _at())).alias("last"))


def prepared(sightings: DataFrame) -> DataFrame:
    """The columns that the fold needs, with the id of each wording; stored once, as several steps read it.

    Rows with a null `seen_at` are left out, empty origins and destinations
    count as null. Needs `seq`, unique and in order of arrival.
    """
    ends = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("origin", "destination")]
    ids = [F.xxhash64(F.lit(i), F.isnull("head"), "head", F.isnull("text"), "text").alias(w) for i, w in enumerate(WORDING)]
    return staged(sightings.where("seen_at IS NOT NULL").select("seq", "start", *ends, "seen_at", "legs", *ids, "head", "text"), "seen")


def _by_heat(rows: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary starts, and those of hot ones if there are any."""
    crowded = rows.groupBy("start").count().where(F.col("count") > hot).select(F.col("start").alias("__start"))
    if crowded.isEmpty():
        return rows, None
    same = F.col("start").eqNullSafe(F.col("__start"))
    return rows.join(crowded, same, "left_anti"), rows.join(crowded, same, "left_semi")


def _within(rows: DataFrame) -> DataFrame:
    """What the start and the wording of each row tell about its route, by windows over the start."""
    start = Window.partitionBy("start")
    low, high = F.min(_route()).over(start), F.max(_route()).over(start)
    last = F.max_by(_route(), F.when(F.expr(_ROUTED), _at())).over(Window.partitionBy("start", *WORDING))
    rows = rows.withColumns({"network": F.max(F.coalesce("legs", F.lit(0))).over(start) > 1, "one": low, "__high": high, "last": last})
    return rows.withColumn("single", F.col("one").isNotNull() & F.col("one").eqNullSafe(F.col("__high"))).drop("__high")


def _across(rows: DataFrame) -> DataFrame:
    """The same by sums: those of a start are joined to those of its wordings, and these to the rows."""
    by_start = start_facts(rows).withColumnRenamed("n", "n_start")
    sums = join_sums(wording_routes(rows).withColumnRenamed("n", "n_wording"), by_start, ["start"], "n_start", "w1")
    return join_sums(rows, staged(sums, "routes"), ["start", *WORDING], "n_wording", "seq").drop("n_wording", "n_start")


def _branched(rows: DataFrame) -> DataFrame:
    several = F.struct(F.lit(L.SEVERAL).alias("origin"), F.lit(None).cast("string").alias("destination"))
    branch = F.when(F.col("network"), "network").when(F.expr(_ROUTED), "own").when(F.col("single"), "single").when(F.col("last").isNotNull(), "wording").otherwise("none")
    rows = rows.withColumn("branch", branch)
    by = lambda name, route: F.when(F.col("branch") == name, route)
    route = F.coalesce(by("network", several), by("own", _route()), by("single", F.col("one")), by("wording", F.col("last")))
    rows = rows.withColumn("__route", route)
    return rows.withColumns({"route_from": F.col("__route.origin"), "route_to": F.col("__route.destination")}).drop("network", "single", "one", "last", "__route")


def _resolved(rows: DataFrame, hot: int, changes: bool) -> DataFrame:
    """The prepared rows with their route and, if wanted, `changed`: whether the wording is another than before in the disruption."""

    def mark(df: DataFrame, long: bool) -> DataFrame:
        if not changes:
            return df
        if long:
            df = with_previous(df, KEY, "seen_at", "seq", WORDING)
        else:
            df = df.withColumn("prev", F.lag(F.struct(*WORDING)).over(Window.partitionBy(*KEY).orderBy("seen_at", "seq")))
        return df.withColumn("changed", ~F.col("prev").eqNullSafe(F.struct(*WORDING))).drop("prev")

    plain, crowded = _by_heat(rows, hot)
    out = mark(_branched(_within(plain)), False)
    return out if crowded is None else out.unionByName(mark(_branched(_across(crowded)), True))


def resolve(seen: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """The sightings with `route_from`, `route_to` and `branch`, the rule that gave them; other columns are left out.

    In turn: a start that ever had several legs is one network event; the
    sighting's own route; the only route that its start carries; the latest
    route of the same start and wording; none. A null start is a start of its
    own; see `prepared` for other nulls.
    """
    return _resolved(prepared(seen), hot, False)


def route_label(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat_ws(" to ", a, b)).otherwise(F.coalesce(a, b, F.lit(L.UNNAMED)))


def updates(seen: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """The sightings of each disruption that brought a wording other than the one before."""
    return _resolved(prepared(seen), hot, True).where("changed").select(*KEY, "seen_at", "seq", "head", "text")


def wordings(rows: DataFrame) -> DataFrame:
    """Each wording of prepared rows once, with its figure of minutes, whether it is about capacity, and its causes.

    A reading takes much time for few bytes, so the wordings are dealt out over
    all shuffle partitions, by their id as the join after it needs them, before
    they are read.
    """
    once = rows.groupBy(*WORDING, "head", "text").agg(F.count("*").alias("__n")).drop("__n")
    once = once.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *WORDING)
    capacity = F.concat_ws(" ", "head", "text").rlike(L.java(L.CAPACITY))
    return with_reading(once.withColumns({"minutes": claimed_minutes(F.col("head"), F.col("text")), "capacity": capacity})).drop("unread")


def disruptions(sightings: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """One row per (start, route): first and last time, updates, latest wording, worst figure, capacity and causes.

    Disruptions of capacity notices are marked, not dropped. `causes` joins
    the readings of the wordings in their order of appearance, the first of
    each category; categories are few, so the array is bounded. The wordings
    themselves are not gathered into a row; see `updates`. Each distinct
    wording is read once, each step sums what the step before has summed.
    """
    rows = prepared(sightings)
    at = _at()
    changed = F.when(F.col("changed"), at)
    slim = _resolved(rows.drop("head", "text"), hot, True)
    uses = slim.groupBy(*KEY, *WORDING).agg(F.min(changed).alias("first"), F.max(changed).alias("last"), F.count_if("changed").alias("n"), F.max("seen_at").alias("last_seen"), F.count("*").alias("sightings"))
    read = uses.join(wordings(rows), WORDING)
    stated = read.select("*", F.posexplode_outer("causes").alias("pos", "cause")).withColumn("one", F.coalesce(F.col("pos"), F.lit(0)) == 0)
    once = lambda c: F.coalesce(F.sum(F.when(F.col("one"), F.col(c))), F.lit(0)).alias(c)
    place = F.when(F.col("cause").isNotNull(), F.struct("first", "pos"))
    by_category = stated.groupBy(*KEY, F.col("cause.category").alias("category")).agg(
        once("n"), once("sightings"), F.max("last_seen").alias("last_seen"), F.min("first").alias("first"), F.max_by(F.struct("head", "text"), "last").alias("latest"), F.max("last").alias("last"),
        F.max("minutes").alias("minutes"), F.bool_and("capacity").alias("capacity"), F.min_by("cause", place).alias("cause"), F.min(place).alias("place"),
    )
    causes = F.array_sort(F.collect_list(F.when(F.col("cause").isNotNull(), F.struct("place", "cause"))))
    out = by_category.groupBy(*KEY).agg(
        F.sum("n").alias("n_updates"), F.sum("sightings").alias("sightings"), F.max("last_seen").alias("last_seen"), F.min("first").alias("first"), F.max_by("latest", "last").alias("latest"),
        F.max("last").alias("last"), F.max("minutes").alias("minutes"), F.bool_and("capacity").alias("is_capacity"), causes.alias("found"),
    )
    return out.select(
        *KEY, route_label(F.col("route_from"), F.col("route_to")).alias("route"), "latest.head", "latest.text", F.col("first.seen_at").alias("first_seen"), "last_seen", F.col("last.seen_at").alias("last_update"), "sightings", "n_updates",
        "minutes", "is_capacity", F.col("first.seq").alias("first_seq"), F.transform("found", lambda x: x["cause"].dropFields("at")).alias("causes"),
    )
