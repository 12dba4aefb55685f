"""Timestamps of mixed formats and zones become UTC instants (problem 6).

The distinct (raw text, zone) pairs form a dictionary; each pair is parsed once,
the dictionary is kept as a table and only pairs it lacks are parsed next time;
normalised instants are joined back to the rows.

Defined results
* a zone or offset inside the text holds, else the row's zone, else UTC; an unknown zone name in the column counts as UTC,
  an unknown one inside the text makes the text no instant;
* wall time that occurs twice is the earlier instant, wall time that is skipped moves on by the gap;
* a date alone is its midnight; d.m.y has the day first, m/d/y the month first; digits past the microsecond are cut off;
* bare numbers count from 1970 in seconds, milli- or microseconds, whichever falls into YEARS; otherwise they are no instant;
* null, empty, blank, very long and meaningless texts, impossible dates and times are no instant (null);
* repeated rows stay repeated, extra columns are kept, an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.session import forget_at_exit, hot_join, scratch_path

#: Instants that bare numbers may denote: from the first year up to, not including, the last.
YEARS = (2024, 2026)
MAX_CHARS = 100  # no accepted form is longer
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
#: Hours ahead of UTC of zone abbreviations.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "west": 1, "bst": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3, "ist": 5.5, "jst": 9, "kst": 9,
    "awst": 8, "acst": 9.5, "acdt": 10.5, "aest": 10, "aedt": 11, "nzst": 12, "nzdt": 13, "brt": -3, "art": -3, "wat": 1, "cat": 2, "eat": 3, "sast": 2,
    "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "akst": -9, "akdt": -8, "hst": -10,
}

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?m\.?)?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?(?::?\d{2})?)|\s*(?P<abbr>z|[a-z]{3,4}))?(?:\s*\[(?P<box>[a-z_]+(?:/[a-z0-9_+-]+)*)\]|\s+(?P<name>[a-z_]+(?:/[a-z0-9_+-]+)+))?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_MONTH = r"(?P<mon>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_FORMS = [
    re.compile(p + "$", re.ASCII)
    for p in (
        rf"(?P<y>\d{{4}})-(?P<m>\d{{1,2}})-(?P<d>\d{{1,2}})(?:(?:t|\s+){_TIME}{_ZONE})?",
        rf"(?P<y>\d{{4}})/(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})(?:(?:t|\s+){_TIME}{_ZONE})?",
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})t(?P<h>\d{2})(?P<mi>\d{2})(?:(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?" + _ZONE,
        rf"(?P<d>\d{{1,2}})\.(?P<m>\d{{1,2}})\.(?P<y>\d{{4}})(?:,?\s+{_TIME}{_ZONE})?",
        rf"(?P<m>\d{{1,2}})/(?P<d>\d{{1,2}})/(?P<y>\d{{4}})(?:,?\s+{_TIME}{_ZONE})?",
        rf"{_WEEKDAY}(?P<d>\d{{1,2}})[ -]{_MONTH}[ -](?P<y>\d{{4}})(?:,?\s+{_TIME}{_ZONE})?",
        rf"{_WEEKDAY}{_MONTH}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})(?:,?\s+{_TIME}{_ZONE})?",
    )
]
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_NUMBER_RANGE = tuple((datetime(y, 1, 1, tzinfo=UTC) - _EPOCH) // timedelta(microseconds=1) for y in YEARS)


@lru_cache(maxsize=4096)
def _zone(name: str | None) -> timezone | ZoneInfo | None:
    """None for an unknown name."""
    if not name or not name.strip():
        return UTC
    name = name.strip()
    if name.lower() in ABBREVIATIONS:
        return timezone(timedelta(hours=ABBREVIATIONS[name.lower()]))
    for spelt in (name, "/".join("_".join(w[:1].upper() + w[1:] for w in x.split("_")) for x in name.split("/"))):
        try:
            return ZoneInfo(spelt)
        except (KeyError, ValueError, OSError):
            continue
    return None


def parse_instant(raw: str | None, tz: str | None) -> int | None:
    """Microseconds since 1970 in UTC of the instant ``raw`` denotes, or None."""
    if raw is None or len(raw) > 4 * MAX_CHARS:
        return None
    text = raw.strip().lower()
    if not text or len(text) > MAX_CHARS:
        return None
    if text.isascii() and text.isdigit():
        n = int(text)
        return next((n * x for x in (1_000_000, 1_000, 1) if _NUMBER_RANGE[0] <= n * x < _NUMBER_RANGE[1]), None)
    m = next((m for p in _FORMS if (m := p.match(text))), None)
    if not m:
        return None
    g = m.groupdict()
    hour = int(g["h"] or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (g["ap"] == "p")
    month = MONTHS[g["mon"]] if g.get("mon") else int(g["m"])
    try:
        wall = datetime(int(g["y"]), month, int(g["d"]), hour, int(g["mi"] or 0), int(g["s"] or 0), int(((g["f"] or "") + "000000")[:6]))
    except ValueError:
        return None
    if off := g.get("off"):
        digits = off[1:].replace(":", "") + "0000"
        if int(digits[2:4]) > 59 or int(digits[:2]) > 18:
            return None
        gap = timedelta(hours=int(digits[:2]), minutes=int(digits[2:4]), seconds=int(digits[4:6]))
        zone: timezone | ZoneInfo | None = timezone(-gap if off[0] == "-" else gap)
    elif g.get("abbr"):
        if g["abbr"] not in ABBREVIATIONS:
            return None
        zone = timezone(timedelta(hours=ABBREVIATIONS[g["abbr"]]))
    elif inside := g.get("box") or g.get("name"):
        if (zone := _zone(inside)) is None:
            return None
    else:
        zone = _zone(tz) or UTC
    try:  # fold 0: the earlier of two instants, and past a gap by its length
        return (wall.replace(tzinfo=zone) - _EPOCH) // timedelta(microseconds=1)
    except OverflowError:
        return None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [parse_instant(r, z) for r, z in zip(b.column("raw").to_pylist(), b.column("tz").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("raw"), b.column("tz"), pa.array(got, pa.int64()), b.column("n")], ["raw", "tz", "us", "n"])


class InstantDictionary:
    """The kept table (raw, tz, us, n) of all pairs met so far; ``n`` counts the rows of the batch that brought the pair."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema("raw string, tz string, us bigint, n bigint").parquet(self.path)

    def add(self, pairs: DataFrame) -> None:
        """Parse the pairs (raw, tz) that the table lacks, and append them."""
        new = pairs.filter("raw IS NOT NULL").select("raw", F.coalesce("tz", F.lit("")).alias("tz")).groupBy("raw", "tz").agg(F.count("*").alias("n"))
        if (known := self.read()) is not None:
            new = new.join(known.select("raw", "tz"), ["raw", "tz"], "left_anti")
        new.mapInArrow(_parse, "raw string, tz string, us bigint, n bigint").write.mode("append").parquet(self.path)


def normalise(df: DataFrame, raw: str, tz: str, out: str = "utc_us", dictionary: InstantDictionary | None = None, found_only: bool = False) -> DataFrame:
    """``df`` with the column ``out``: the instant of ``raw`` in microseconds, null if it denotes none (such rows go with ``found_only``)."""
    d = dictionary or InstantDictionary(df.sparkSession, scratch_path(df.sparkSession, "instants"))
    d.add(df.select(F.col(raw).alias("raw"), F.col(tz).alias("tz")))
    if dictionary is None:
        forget_at_exit(df.sparkSession, d.path)
    known = d.read().filter("us IS NOT NULL")
    total = known.agg(F.sum("n")).first()[0] or 0
    known = known.select(F.col("raw").alias("__raw"), F.col("tz").alias("__tz"), F.col("us").alias(out), F.col("n").alias("__n"))
    keyed = df.withColumns({"__raw": F.col(raw), "__tz": F.coalesce(F.col(tz), F.lit(""))})
    found = hot_join(keyed.filter("__raw IS NOT NULL"), known, ["__raw", "__tz"], "__n", total).drop("__n")
    if not found_only:
        none = keyed.join(known.select("__raw", "__tz"), ["__raw", "__tz"], "left_anti").withColumn(out, F.lit(None).cast("bigint"))
        found = found.unionByName(none)
    return found.drop("__raw", "__tz")


def utc_text(us: Column) -> Column:
    """2025-03-10T22:00:00.000000Z, whatever the session's zone."""
    seconds, rest = F.floor(us / 1_000_000).cast("bigint"), F.pmod(us, F.lit(1_000_000))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
    of_day = F.pmod(seconds, F.lit(86_400))
    parts = (F.floor(of_day / 3600), F.floor(of_day % 3600 / 60), of_day % 60)
    return F.format_string("%sT%02d:%02d:%02d.%06dZ", day.cast("string"), *[p.cast("int") for p in parts], rest)
