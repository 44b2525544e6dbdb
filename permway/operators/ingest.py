"""From raw polls to runs, items, sightings and notices."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from permway.functions import lexicon as L
from permway.functions.textops import strip

RUN = "http_status VARIANT, network_error VARIANT, fetched_at_utc STRING, body VARIANT"
# What counts as no error, as JSON.
_NOTHING = ("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")


_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _one_value(text: Column) -> Column:
    """Whether a text that is one JSON value, or several members, between braces is one value: what could close the one kind of bracket breaks the other."""
    return F.size(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", _STRICT)) == 1


def read_log(spark: SparkSession, data_dir: str) -> DataFrame:
    """The lines of `raw/messages-*.jsonl` as runs, with `seq` in path and line order; ids alone don't follow the order of the paths."""
    lines = spark.read.text(f"{data_dir}/raw/messages-*.jsonl")
    seq = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return decode_lines(lines.select(seq.alias("seq"), F.col("value").alias("line")))


def decode_lines(lines: DataFrame) -> DataFrame:
    """Log lines as runs: `http_status`, `network_error`, `fetched_at_utc`, `body` beside the other columns of `lines`.

    Lines that are no JSON objects are skipped. Fields are judged by their JSON
    type: a status counts only as a number, a body only as text, and an error
    is none if it is null, false, zero or empty; text such as "false" is one.
    """
    read = F.from_json(F.concat(F.lit('{"r":'), "line", F.lit("}")), f"r STRUCT<{RUN}>", _STRICT)["r"]
    rows = lines.where(F.ltrim("line").startswith("{")).withColumn("__r", F.when(_one_value(F.col("line")), read)).where("__r IS NOT NULL")
    json = lambda f: F.to_json(f"__r.{f}")
    error, status = json("network_error"), json("http_status")
    typed = {
        "http_status": F.when(~status.startswith('"') & (F.pmod(status.try_cast("double"), F.lit(1.0)) == 0), status.try_cast("double").try_cast("int")),
        "network_error": F.when(~error.isin(*_NOTHING), F.col("__r.network_error").try_cast("string")),
        "fetched_at_utc": F.col("__r.fetched_at_utc"),
        "body": F.when(json("body").startswith('"'), F.col("__r.body").try_cast("string")),
    }
    return rows.select(*[c for c in lines.columns if c not in ("line", *typed)], *[c.alias(n) for n, c in typed.items()])


def json_array(text: Column) -> Column:
    """The elements of a JSON array as JSON texts; null for anything else, also for an array with something after it.

    The text is read between braces, and must be one value between brackets too.
    """
    elements = F.from_json(F.concat(F.lit('{"b":'), text, F.lit("}")), "b array<string>", _STRICT)["b"]
    return F.when(_one_value(text) & F.ltrim(F.translate(text, "\t\r\n", "   ")).startswith("["), elements)


def good_runs(runs: DataFrame) -> DataFrame:
    """Runs with status 200, no error and a body that is a JSON array, as `items` (array of JSON texts)."""
    ok = runs.where("http_status = 200 AND (network_error IS NULL OR network_error = '')")
    return ok.withColumn("items", json_array(F.col("body"))).where("items IS NOT NULL")


def timed_runs(runs: DataFrame) -> DataFrame:
    """Good runs whose time is in the log's form, as `seen_at`."""
    at = F.try_to_timestamp("fetched_at_utc", F.lit("yyyy-M-d'T'H:m:s'Z'"))
    return good_runs(runs).withColumn("seen_at", at).where("seen_at IS NOT NULL")


def horizon(runs: DataFrame) -> DataFrame:
    """One row: the latest time of a timed run and their number, before any item is dropped."""
    return timed_runs(runs).agg(F.max("seen_at").alias("horizon"), F.count("*").alias("runs"))


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(f"item.{name}"), F.lit("")))


def items(runs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per item that is an object: `keep`, `item_pos`, fields stripped, first leg's stops and number of legs."""
    rows = runs.select(*keep, F.posexplode("items").alias("item_pos", "raw")).where(F.ltrim("raw").startswith("{"))
    schema = "head STRING, text STRING, start STRING, locationCodes STRING, eventStops STRING"
    rows = rows.withColumn("item", F.from_json("raw", schema))
    legs = F.from_json("item.eventStops", "array<string>")
    codes = F.from_json("item.locationCodes", "array<string>")
    first = F.from_json(F.get(F.col("legs"), F.lit(0)), "sStop STRING, eStop STRING")
    rows = rows.withColumns({"legs": legs, "codes": F.coalesce(codes, F.array().cast("array<string>"))}).withColumn("leg", first)
    stop = lambda n: F.nullif(strip(F.col(f"leg.{n}")), F.lit(""))
    return rows.select(
        *keep, "item_pos", _text("head").alias("head"), _text("text").alias("text"), _text("start").alias("start"),
        stop("sStop").alias("origin"), stop("eStop").alias("destination"), F.coalesce(F.size("legs"), F.lit(0)).alias("legs"), "codes",
    )


def sightings(runs: DataFrame, keep: list[str]) -> DataFrame:
    """The items of timed runs that are of our subject."""
    return ours(items(timed_runs(runs), [*keep, "seen_at"]))


def ours(df: DataFrame) -> DataFrame:
    """Without test alerts and without lifts and escalators that are out; each field is judged alone. Null fields count as empty."""
    head, text = (F.coalesce(F.col(c), F.lit("")) for c in ("head", "text"))
    machine, alert = L.java(L.MACHINE_OUT), L.java(L.TEST_ALERT)
    return df.where(~(head.rlike(alert) | text.rlike(alert)) & ~(head.rlike(machine) | text.rlike(machine)))


def distinct_notices(seen: DataFrame, seq: str) -> DataFrame:
    """Each wording once, with its number of sightings and the attributes of its first one in the order `seq`."""
    extra = [c for c in ("start", "codes", "first_seen") if c in seen.columns]
    first = F.min_by(F.struct(*extra), F.col(seq))
    return seen.groupBy("head", "text").agg(first.alias("first"), F.count("*").alias("sightings")).select("head", "text", "first.*", "sightings")
