"""Problem 5: what changed between consecutive full snapshots of a table.

A snapshot is unpivoted into cells (key, field, hash of the value) with one
presence marker per key. Compared with the snapshot before it counts +1, for
the one after it -1; the grouped sums that are not zero are the changes.
"""

import json
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permway.functions import strictjson
from permway.functions.instants import instant
from permway.operators.chain import with_neighbours
from permway.sources.shared import staged

#: The field of a presence marker; no JSON key is null.
PRESENCE = None
#: Snapshots that a worker parses at a time.
CHUNK = 256
_ITEMS = "run_id bigint, feed string, utc_us bigint, items array<struct<ref: string, cells: array<struct<field: string, h1: bigint, h2: bigint>>>>"


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


_CANONICAL = json.JSONEncoder(sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str).encode


#: Values, written as texts of up to so many characters, whose hashes a worker remembers: snapshots repeat most of them.
MEMO_VALUES, MEMO_CHARS = 50_000, 600


def _hash(text: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return _signed(h >> 64), _signed(h & (1 << 64) - 1)


class Hashes:
    """128 bits of JSON values, as two signed numbers.

    A text is hashed as it is behind a quote, with which no other canonical
    value begins. Other values are remembered by Python's notation of them,
    which is cheaper than their canonical form and as distinct.
    """

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, value) -> tuple[int, int]:
        text = isinstance(value, str)
        key = '"' + value if text else repr(value)
        if (found := self.known.get(key)) is None:
            found = _hash(key if text else _CANONICAL(value))
            if len(key) <= MEMO_CHARS:
                if len(self.known) >= MEMO_VALUES:
                    self.known.clear()
                self.known[key] = found
        return found


value_hash = Hashes()


def cells_of(body: str | None, key: str = "itemRef") -> list | None:
    """The items of a strict JSON array as (key, cells); None if it isn't one.

    Elements that are not objects or have no key are left out; of a key listed
    twice the first counts.
    """
    value = strictjson.loads(body)
    if not isinstance(value, list):
        return None
    items: dict[str, list] = {}
    for item in value:
        if isinstance(item, dict) and item.get(key) is not None:
            ref = strictjson.label(item[key])
            if ref not in items:
                items[ref] = [(PRESENCE, 0, 0), *((strictjson.clean(f), *value_hash(v)) for f, v in item.items())]
    return list(items.items())


def snapshots(poll_runs: DataFrame) -> DataFrame:
    """The good polls: `run_id`, `feed`, `utc_us` and their items as cells; stored, so that each body is parsed once."""
    good = poll_runs.where("http_status = 200 AND network_error IS NULL AND body IS NOT NULL AND fetched_at_utc IS NOT NULL")
    good = good.select("run_id", "feed", instant(F.col("fetched_at_utc"), "UTC")["utc_us"].alias("utc_us"), "body").where("utc_us IS NOT NULL")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):  # the parsed items of a whole batch of large bodies would be too much at once
                pdf = batch.iloc[at : at + CHUNK]
                items = [cells_of(b) for b in pdf["body"]]
                pdf = pdf.drop(columns="body")[[i is not None for i in items]]
                yield pdf.assign(items=[[(r, c) for r, c in i] for i in items if i is not None])

    return staged(good.mapInPandas(read, _ITEMS), "snapshots")


def changed_cells(poll_runs: DataFrame) -> DataFrame:
    """Nonzero cells `run_id, item_ref, field, h1, h2, n` of each snapshot against the one before."""
    read = snapshots(poll_runs)
    links = with_neighbours(read.select("run_id", "feed", "utc_us"), "feed", "utc_us", "run_id")
    links = links.select("run_id", F.col("prev_id").alias("prev"), F.col("next_id").alias("next"))
    one = read.select("run_id", "items").join(links, "run_id")
    # A snapshot counts +1 in its own comparison and -1 in the next one's.
    sides = F.filter(
        F.array(
            F.struct(F.when(F.col("prev").isNotNull(), F.col("run_id")).alias("at"), F.lit(1).alias("sign")),
            F.struct(F.col("next").alias("at"), F.lit(-1).alias("sign")),
        ),
        lambda s: s["at"].isNotNull(),
    )
    rows = one.select(F.explode("items").alias("item"), sides.alias("sides"))
    rows = rows.select("item.ref", F.explode("item.cells").alias("cell"), "sides").select("ref", "cell.*", F.explode("sides").alias("side"))
    summed = rows.groupBy(F.col("side.at").alias("run_id"), F.col("ref").alias("item_ref"), "field", "h1", "h2").agg(F.sum("side.sign").alias("n"))
    return summed.where("n <> 0")


def changes(poll_runs: DataFrame) -> DataFrame:
    """`run_id, item_ref, delta, fields`: added, removed or changed items and their changed fields.

    `fields` is null for added and removed items. Polls with null or unreadable
    times, failed polls and bodies that are no strict JSON array are no
    snapshots; the first snapshot of a feed yields nothing. A null feed is a
    feed of its own.
    """
    cells = changed_cells(poll_runs)
    marker = F.max(F.when(F.col("field").isNull(), F.col("n")))
    fields = F.array_sort(F.collect_set("field"))
    found = cells.groupBy("run_id", "item_ref").agg(marker.alias("present"), fields.alias("fields"))
    delta = F.when(F.col("present") > 0, "added").when(F.col("present") < 0, "removed").otherwise("changed")
    return found.select("run_id", "item_ref", delta.alias("delta"), F.when(F.col("present").isNull(), F.col("fields")).alias("fields"))


def found(poll_runs: DataFrame) -> DataFrame:
    """p5_found: the changes without their fields."""
    return changes(poll_runs).drop("fields")
