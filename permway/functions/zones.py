"""Versioned tables of the offset changes of time zones, for vectorised use."""

import datetime as dt
import io
import pickle
import zlib
import zoneinfo
from functools import lru_cache
from pathlib import Path

import numpy as np

US = 1_000_000
#: Years of a table: from before the first zone to one whole cycle of the calendar after the last change that is no yearly rule.
FIRST_YEAR, LAST_YEAR = 1800, 2500
#: The Gregorian calendar repeats, with its days of the week, after 400 years; so do yearly rules.
CYCLE_S = 146_097 * 86_400

# Abbreviations as they are understood in Ireland, minutes from UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0,
    "IST": 60, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120,
}


def tzdata_version() -> str:
    """The release of the zone rules that this process reads, or `unknown`."""
    for base in zoneinfo.TZPATH:
        for name in ("+VERSION", "tzdata.zi"):
            if (p := Path(base, name)).exists():
                return p.open(encoding="ascii").readline().replace("# version", "").strip()
    try:
        from importlib.metadata import version

        return version("tzdata")
    except Exception:
        return "unknown"


class ZoneTable:
    """The changes of one zone: `at` (UTC seconds), offset `before` and `after` (seconds).

    `cut` is the local clock reading from which the later offset holds. It is
    the change read with the larger of both offsets, so a reading that the
    clock shows twice counts as its earlier instant and one that it skips is
    read with the offset before the change.
    """

    def __init__(self, zone: str, version: str, at: np.ndarray, before: np.ndarray, after: np.ndarray):
        self.zone, self.version = zone, version
        self.at, self.before, self.after = at, before, after
        self.cut = at + np.maximum(before, after)
        self.low = at + np.minimum(before, after)
        first = before[:1] if len(before) else np.zeros(1, np.int64)
        self.offsets = np.concatenate([first, after])
        self.end = int(dt.datetime(LAST_YEAR, 1, 1, tzinfo=dt.UTC).timestamp()) - 30 * 86_400

    @classmethod
    def build(cls, zone: str, rules: bytes, version: str) -> "ZoneTable":
        """From a zone's compiled rules: probe them weekly and bisect to the second where the offset moves."""
        tz = zoneinfo.ZoneInfo.from_file(io.BytesIO(rules), key=zone)
        off = lambda s: int(dt.datetime.fromtimestamp(s, tz).utcoffset().total_seconds())
        week = 7 * 86400
        start, end = (int(dt.datetime(y, 1, 1, tzinfo=dt.UTC).timestamp()) for y in (FIRST_YEAR, LAST_YEAR))
        rows, low, was = [], start, off(start)
        for s in range(start + week, end, week):
            if (now := off(s)) != was:
                a, b = low, s
                while b - a > 1:
                    mid = (a + b) // 2
                    a, b = (mid, b) if off(mid) == was else (a, mid)
                rows.append((b, was, now))
                was = now
            low = s
        cols = np.array(rows or [(start, was, was)], dtype=np.int64).T
        return cls(zone, version, *cols)

    def to_utc(self, local_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of local readings; and 0 plain, 1 shown twice, 2 never shown. Years after the table repeat those of its last cycle."""
        beyond = np.maximum(0, -(-(local_s - self.end) // CYCLE_S)) * CYCLE_S
        local_s = local_s - beyond
        i = np.searchsorted(self.cut, local_s, side="right")
        utc = local_s - self.offsets[i]
        j = np.minimum(i, len(self.cut) - 1)
        inside = (i < len(self.cut)) & (local_s >= self.low[j])
        twice = self.after[j] < self.before[j]
        return utc + beyond, np.where(inside, np.where(twice, 1, 2), 0).astype(np.int8)


class Zones:
    """The rules of all zones as one process had them, to be sent to others, and the tables made from them when they are needed."""

    def __init__(self, version: str, rules: dict[str, bytes]):
        self.version, self.rules = version, rules
        self.by_lower = {name.lower(): name for name in rules}
        self.tables: dict[str, ZoneTable] = {}

    @classmethod
    def installed(cls) -> "Zones":
        rules: dict[str, bytes] = {}
        for name in sorted(zoneinfo.available_timezones()):
            paths = [p for base in zoneinfo.TZPATH if (p := Path(base, *name.split("/"))).is_file()]
            if paths:
                rules[name] = paths[0].read_bytes()
            else:
                from importlib import resources

                rules[name] = resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()
        return cls(tzdata_version(), rules)

    def table(self, zone: str) -> ZoneTable | None:
        """The table of a zone by its name in any case, made once; None if there is no such zone."""
        name = self.by_lower.get(zone.lower())
        if name is None:
            return None
        if name not in self.tables:
            self.tables[name] = ZoneTable.build(name, self.rules[name], self.version)
        return self.tables[name]

    def packed(self) -> bytes:
        """Some hundred kilobytes, whatever the data: there are about 600 zones."""
        return zlib.compress(pickle.dumps((self.version, self.rules)), 9)


@lru_cache(maxsize=1)
def zones() -> Zones:
    """The zones of this process."""
    return Zones.installed()


@lru_cache(maxsize=2)
def unpacked(data: bytes) -> Zones:
    """The zones of the process that packed them, once for each worker."""
    return Zones(*pickle.loads(zlib.decompress(data)))


def zone_table(zone: str) -> ZoneTable | None:
    """The table of a zone by the rules of this process."""
    return zones().table(zone)
