"""Problem 6: deeply nested records to flat tables with parent links.

One depth-first visit of a record emits, for every object in it, a row with a
table tag, its primary key, its parent's key and its payload. The rows are
written once, partitioned by tag, and each table is read back with its schema.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permway.functions import strictjson
from permway.sources.shared import shared_dir


@dataclass(frozen=True)
class Table:
    """One flat table of a nested record: where its elements lie, what its columns are, and the tables below.

    `source` is the field of the parent that holds the elements, `columns` maps
    column names to paths in an element; an empty path is the element itself,
    which then must be text. Any other element must be an object. `label` is
    the path of its label.
    """

    tag: str
    source: str
    columns: dict[str, tuple[str, ...]]
    label: tuple[str, ...] = ()
    below: tuple["Table", ...] = field(default=())

    def schema(self) -> str:
        names = ", ".join(f"{c} STRING" for c in self.columns)
        return f"{names}, rest STRING" if self.objects else names

    @property
    def objects(self) -> bool:
        return all(self.columns.values())

    def all(self) -> Iterator["Table"]:
        yield self
        for t in self.below:
            yield from t.all()


CALL = Table("call", "calls", {"due": ("due",)}, ("due",))
VIA = Table("via", "via", {"stop": ("stop",), "platform_no": ("platform", "no"), "platform_side": ("platform", "side")}, ("stop",), (CALL,))
LEG = Table("leg", "eventStops", {"s_stop": ("sStop",), "e_stop": ("eStop",)}, ("sStop",), (VIA,))
CODE = Table("code", "locationCodes", {"code": ()})
ITEM = Table("item", "", {"item_ref": ("itemRef",), "head": ("head",), "text": ("text",), "start": ("start",)}, ("itemRef",), (CODE, LEG))

#: Columns that every table has.
KEYS = ("run_id", "item_pos", "pos", "sub_pos")
_EMITTED = "run_id bigint, item_pos int, pos int, sub_pos int, pk string, parent_pk string, label string, payload string, tag string"


def _as_list(value) -> list:
    """The elements where a list is usual: none for null, a single value as a list of one."""
    return value if isinstance(value, list) else [] if value is None else [value]


def _at(value, path: tuple[str, ...]):
    for name in path:
        value = value.get(name) if isinstance(value, dict) else None
    return value


def _rest(element: dict, table: Table) -> str | None:
    """The fields of an element that no column and no table below takes, as JSON. A field that a column takes in part counts as taken if it has no other parts."""
    known: dict[str, set[str]] = {}
    for name, *deeper in table.columns.values():
        known.setdefault(name, set()).update(deeper)
    taken = {t.source for t in table.below} | {n for n, parts in known.items() if not parts or element.get(n) is None or (isinstance(element.get(n), dict) and set(element[n]) <= parts)}
    rest = {n: v for n, v in element.items() if n not in taken}
    return strictjson.clean(strictjson.canonical(rest)) if rest else None


def _visit(run_id: int, table: Table, value, places: tuple[int, ...], parent: str, tags: frozenset[str]) -> Iterator[tuple]:
    """Rows of the elements of one field, each before those below it."""
    for n, element in enumerate(_as_list(value)):
        if not isinstance(element, dict if table.objects else str):
            continue
        own = (*places, n)
        pk = f"{parent}/{n}" if table is ITEM else f"{parent}/{table.tag[0] if table is not CALL else 'a'}{n}"
        if table.tag in tags:
            fields = {c: v if (v := _at(element, p)) is None else strictjson.label(v) for c, p in table.columns.items()}
            if table.objects and (rest := _rest(element, table)):
                fields["rest"] = rest
            yield run_id, *(*own[:3], -1, -1)[:3], pk, parent, strictjson.label(_at(element, table.label)), strictjson.canonical(fields), table.tag
        for t in table.below:
            yield from _visit(run_id, t, element.get(t.source), own, pk, tags)


ALL_TAGS = tuple(t.tag for t in ITEM.all())


def visit(run_id: int, body: str | None, tags: tuple[str, ...] = ALL_TAGS) -> Iterator[tuple]:
    """Rows of one body, depth first, parents before children; none unless it is a strict JSON array."""
    value = strictjson.loads(body)
    return _visit(run_id, ITEM, value, (), str(run_id), frozenset(tags)) if isinstance(value, list) else iter(())


def emit(poll_runs: DataFrame, tags: tuple[str, ...] = ALL_TAGS) -> DataFrame:
    """All rows of the tags of all bodies, in one pass and without a shuffle."""
    columns = [c.split()[0] for c in _EMITTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for run_id, body in zip(pdf["run_id"], pdf["body"], strict=True):
                rows.extend(visit(run_id, body, tags))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return poll_runs.where("body IS NOT NULL AND run_id IS NOT NULL").select("run_id", "body").mapInPandas(run, _EMITTED)


def flatten(poll_runs: DataFrame, tags: tuple[str, ...] = ALL_TAGS, path: str | None = None) -> dict[str, DataFrame]:
    """The tables `item`, `code`, `leg`, `via` and `call`, or those of `tags`.

    Each has `run_id, item_pos, pos, sub_pos` (-1 where a level doesn't apply),
    `pk`, `parent_pk`, `label` and its own fields; `rest` is JSON of the fields
    that have no column. A child's `parent_pk` is the `pk` of its parent, an
    item's the text of its `run_id`. Null bodies and bodies that are no strict
    JSON array give no rows. The rows are written to `path`, by default below
    the shared folder.
    """
    spark: SparkSession = poll_runs.sparkSession
    path = path or shared_dir(spark, "nested")
    emit(poll_runs, tags).write.partitionBy("tag").parquet(path)
    rows = spark.read.schema(_EMITTED).parquet(path)
    out = {}
    for table in ITEM.all():
        if table.tag in tags:
            typed = rows.where(F.col("tag") == table.tag).withColumn("__payload", F.from_json("payload", table.schema()))
            out[table.tag] = typed.select(*KEYS, "pk", "parent_pk", "label", "__payload.*")
    return out


def found(poll_runs: DataFrame) -> DataFrame:
    """p6_found: codes, legs and via stops with their places and labels."""
    kinds = ("code", "leg", "via")
    tables = flatten(poll_runs, kinds)
    parts = [tables[t].select("run_id", "item_pos", F.lit(t).alias("kind"), "pos", "sub_pos", "label") for t in kinds]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
