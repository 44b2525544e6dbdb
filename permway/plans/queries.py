"""The named queries over the tables of a data directory."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permway.functions import textops
from permway.functions.causes import segments, with_reading
from permway.functions.lexicon import TAIL, java
from permway.operators import calendar, fold, golden, ingest, metrics, nested, normalise_time, rejects, snapshots
from permway.sources.tables import table

#: Parameters of the calendar: the first instant of collection, and the clock of a build.
COLLECTION_START = "2025-10-18 00:00:00"
NOW = "2026-10-30 12:00:00"


def _sightings(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of our subject; `seq` is the order of arrival."""
    return ingest.ours(table(spark, d, "sightings").withColumn("seq", F.col("sighting_id")))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "poll_runs")


def _read(spark: SparkSession, d: str) -> DataFrame:
    """Notices with their readings."""
    return with_reading(table(spark, d, "notices").select("notice_id", "head", "text"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    """Disruptions without those of capacity notices."""
    return fold.disruptions(_sightings(spark, d)).where("NOT is_capacity")


def _us(c: str, to: str | None = None):
    return F.unix_micros(c).alias(to or c)


def runs_horizon(spark, d):
    return ingest.horizon(_runs(spark, d)).select(_us("horizon"), "runs")


def _log(spark, d):
    """Runs of the raw log lines that are JSON."""
    return ingest.decode_lines(table(spark, d, "raw_lines").where("file_name LIKE '%.jsonl'").select("line_id", "line"))


def log_decode(spark, d):
    return _log(spark, d).select("line_id", "http_status", "network_error", "fetched_at_utc", "body")


def log_horizon(spark, d):
    return ingest.horizon(_log(spark, d)).select(_us("horizon"), "runs")


def log_items(spark, d):
    rows = ingest.items(ingest.good_runs(_log(spark, d)), ["line_id"])
    return rows.select("line_id", "item_pos", "head", "text", "start", "origin", "destination", "legs", F.concat_ws("|", "codes").alias("codes"))


def sightings_decode(spark, d):
    rows = ingest.items(ingest.timed_runs(_runs(spark, d)), ["run_id", "seen_at"])
    return rows.select("run_id", "item_pos", "head", "text", "start", "origin", "destination", "legs", _us("seen_at"))


def notices_decode(spark, d):
    rows = ingest.items(ingest.good_runs(_runs(spark, d)), ["run_id"])
    return rows.select("run_id", "item_pos", "head", "text", "start", F.concat_ws("|", "codes").alias("codes"))


def subject_filter(spark, d):
    return ingest.ours(table(spark, d, "notices")).select("notice_id")


def plain_text(spark, d):
    return table(spark, d, "notices").select("notice_id", textops.plain(F.col("head")).alias("head"), textops.plain(F.col("text")).alias("text"))


def readable_text(spark, d):
    return table(spark, d, "notices").select("notice_id", textops.readable(F.col("head")).alias("head"), textops.readable(F.col("text")).alias("text"))


def _sentences(spark, d):
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("raw")) for i, c in enumerate(("head", "text"))]))
    clean = table(spark, d, "notices").select("notice_id", fields.alias("f")).select("notice_id", "f.field", textops.readable(F.col("f.raw")).alias("clean"))
    rows = clean.select("notice_id", "field", F.posexplode_outer(textops.split_sentences(F.col("clean"))).alias("pos", "sentence"))
    return rows.where("pos IS NOT NULL")


def sentence_split(spark, d):
    return _sentences(spark, d)


def marker_segments(spark, d):
    rows = _sentences(spark, d).select("notice_id", "field", "pos", F.posexplode_outer(segments("sentence")).alias("seg", "s")).where("seg IS NOT NULL")
    return rows.select("notice_id", "field", "pos", "seg", "s.marker", "s.clause")


def clause_cut(spark, d):
    cut = F.btrim(F.split("sentence", java(TAIL), 2)[0], F.lit(" ,.-"))
    return _sentences(spark, d).select("notice_id", "field", "pos", cut.alias("clause"))


def cause_read(spark, d):
    rows = _read(spark, d).select("notice_id", F.posexplode_outer("causes").alias("pos", "c")).where("pos IS NOT NULL")
    return rows.select("notice_id", "pos", "c.category", "c.family", "c.label", "c.phrase", "c.matched", "c.marker", "c.role", "c.earlier")


def unread_clauses(spark, d):
    return metrics.unread_histogram(_read(spark, d))


def silent_notices(spark, d):
    return metrics.silent(_read(spark, d)).select("notice_id")


def category_histogram(spark, d):
    return metrics.category_histogram(_read(spark, d))


def family_histogram(spark, d):
    return metrics.family_histogram(_read(spark, d))


def origin_causes(spark, d):
    rows = _read(spark, d).select("notice_id", F.filter("causes", lambda c: c["family"] == "origin").alias("causes"))
    return rows.where(F.size("causes") > 0).select("notice_id", F.concat_ws(",", F.transform("causes", lambda c: c["category"])).alias("origins"))


def shown_causes(spark, d):
    named = F.filter("causes", lambda c: c["family"] != "unstated")
    shown = F.when(F.size(named) > 0, named).otherwise(F.col("causes"))
    return _read(spark, d).select("notice_id", F.concat_ws(",", F.transform(shown, lambda c: c["category"])).alias("shown"))


def claimed_minutes(spark, d):
    n = table(spark, d, "notices")
    return n.select("notice_id", textops.claimed_minutes(F.col("head"), F.col("text")).alias("minutes"))


def distinct_notices(spark, d):
    seen = table(spark, d, "sightings").select("sighting_id", "head", "text", "start", _us("seen_at", "first_seen"))
    return ingest.distinct_notices(seen, "sighting_id")


def poll_notices(spark, d):
    """The same over the polls, with the location codes and the time text of each wording's first item."""
    seen = ingest.items(ingest.good_runs(_runs(spark, d)), ["run_id", "fetched_at_utc"]).withColumnRenamed("fetched_at_utc", "first_seen")
    rows = ingest.distinct_notices(seen.withColumn("seq", F.struct("run_id", "item_pos")), "seq")
    return rows.select("head", "text", "start", F.concat_ws("|", "codes").alias("codes"), "first_seen", "sightings")


def network_starts(spark, d):
    return fold.start_facts(_sightings(spark, d)).where("network").select("start")


def routes_by_start(spark, d):
    rows = _sightings(spark, d).select("start", F.nullif("origin", F.lit("")).alias("origin"), F.nullif("destination", F.lit("")).alias("destination"))
    return rows.where("origin IS NOT NULL OR destination IS NOT NULL").groupBy("start", "origin", "destination").agg(F.count("*").alias("n"))


def resolve_route(spark, d):
    return fold.resolve(_sightings(spark, d)).select(F.col("seq").alias("sighting_id"), "route_from", "route_to", "branch")


def updates_log(spark, d):
    rows = fold.updates(_sightings(spark, d))
    return rows.select("start", "route_from", "route_to", _us("seen_at"), "seq", "head", "text")


def disruptions(spark, d):
    rows = fold.disruptions(_sightings(spark, d))
    return rows.select("start", "route", "head", "text", _us("first_seen"), _us("last_seen"), "sightings", "n_updates", "minutes", "is_capacity", F.concat_ws(",", F.transform("causes", lambda c: c["category"])).alias("causes"))


def capacity_split(spark, d):
    return fold.disruptions(_sightings(spark, d)).groupBy("is_capacity").agg(F.count("*").alias("n"))


def capacity_by_month(spark, d):
    return metrics.capacity_by_month(fold.disruptions(_sightings(spark, d)))


def month_list(spark, d):
    return calendar.months(_found(spark, d), ingest.horizon(_runs(spark, d)), COLLECTION_START)


def day_counts(spark, d):
    rows = calendar.day_counts(_found(spark, d), ingest.horizon(_runs(spark, d)), COLLECTION_START, NOW)
    return rows.select("ym", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "future")


def day_band(spark, d):
    rows = day_counts(spark, d)
    return rows.select("day", calendar.band(F.col("total"), F.col("future")).alias("band"), calendar.caption(F.col("total"), F.col("future")).alias("caption"))


def day_family_counts(spark, d):
    return calendar.day_families(_found(spark, d)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "family", "n")


def month_tiles(spark, d):
    return metrics.tiles(_found(spark, d))


def routes_named(spark, d):
    return metrics.routes_named(_found(spark, d))


def origin_ranking(spark, d):
    return metrics.origin_ranking(_found(spark, d))


def paged_cases(spark, d):
    return metrics.paged(_found(spark, d)).select("ym", "place", "page", "pages", "start", "route", _us("first_seen"), "first_seq")


def disruption_order(spark, d):
    return metrics.in_order(_found(spark, d)).select("place", "start", "route", _us("first_seen"), "first_seq")


def staleness(spark, d):
    at = F.lit(NOW).cast("timestamp")
    return ingest.horizon(_runs(spark, d)).select((at > F.col("horizon") + F.expr("INTERVAL 10 HOURS")).alias("stale"), F.date_format("horizon", "yyyy-MM-dd HH:mm").alias("stamp"))


def _golden(spark, d):
    """Pinned readings of the wordings with an even id, and current ones of those whose id isn't divisible by 3.

    In the current ones a category was renamed and clauses that nobody reads
    are said in capitals, so that both kinds of differences occur, and each
    side has wordings that the other lacks.
    """
    notices = table(spark, d, "notices")
    edited = F.transform("causes", lambda c: c.withField("category", F.when(c["category"] == "signalling", "points").otherwise(c["category"])))
    current = golden.build(notices.where("notice_id % 3 <> 0")).withColumns({"causes": edited, "unread": F.transform("unread", F.upper)})
    return golden.build(notices.where("notice_id % 2 = 0")), current


def golden_diff(spark, d):
    return golden.differences(*_golden(spark, d)).select("head", "text", "causes_moved", "unread_moved")


def golden_new(spark, d):
    return golden.gained(*_golden(spark, d)).select("head", "text")


def golden_merge(spark, d):
    return golden.merge(*_golden(spark, d)).select("head", "text", F.concat_ws(",", F.transform("causes", lambda c: c["category"])).alias("causes"))


def p1_found(spark, d):
    return normalise_time.found(table(spark, d, "sightings"), _runs(spark, d))


def p2_found(spark, d):
    return rejects.found(table(spark, d, "raw_lines"))


def p2_loaded(spark, d):
    return rejects.loaded(table(spark, d, "raw_lines"))


def p5_found(spark, d):
    return snapshots.found(_runs(spark, d))


def p5_fields(spark, d):
    return snapshots.changes(_runs(spark, d)).where("delta = 'changed'").select("run_id", "item_ref", F.explode("fields").alias("field"))


def p6_found(spark, d):
    return nested.found(_runs(spark, d))


def p6_items(spark, d):
    return nested.flatten(_runs(spark, d), ("item",))["item"].select("run_id", "item_pos", "pk", "parent_pk", "item_ref", "head", "text", "start")


def p6_vias(spark, d):
    return nested.flatten(_runs(spark, d), ("via",))["via"].select("run_id", "item_pos", "pos", "sub_pos", "pk", "parent_pk", "stop", "platform_no", "platform_side")


def p6_calls(spark, d):
    return nested.flatten(_runs(spark, d), ("call",))["call"].select("run_id", "item_pos", "pos", "sub_pos", "pk", "parent_pk", "due")


_NAMES = [
    log_decode, log_horizon, log_items, runs_horizon, sightings_decode, notices_decode, subject_filter, plain_text, readable_text, sentence_split, marker_segments, clause_cut, cause_read, unread_clauses, silent_notices,
    category_histogram, family_histogram, origin_causes, shown_causes, claimed_minutes, distinct_notices, poll_notices, network_starts, routes_by_start, resolve_route, updates_log, disruptions,
    capacity_split, capacity_by_month, month_list, day_counts, day_band, day_family_counts, month_tiles, routes_named, origin_ranking, paged_cases, disruption_order, staleness, golden_diff, golden_new,
    golden_merge, p1_found, p2_found, p2_loaded, p5_found, p5_fields, p6_found, p6_items, p6_vias, p6_calls,
]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMES}
