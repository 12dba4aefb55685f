"""Timestamps of mixed forms."""

from datetime import UTC, datetime

import pytest
from memloom.operators import instants as I
from pyspark.sql import functions as F

CASES = [
    ("2025-05-06T22:09:42+10:00[Australia/Sydney]", "UTC", "2025-05-06 12:09:42"), ("05/05/2025 07:36 PM", "Europe/Helsinki", "2025-05-05 16:36:00"), ("05/05/2025 12:00 AM", None, "2025-05-05 00:00:00"),
    ("May 22, 2024 08:28 AM PDT", None, "2024-05-22 15:28:00"), ("9 Oct 2025 20:54 GMT", "Asia/Tokyo", "2025-10-09 20:54:00"), ("20250621T044534Z", None, "2025-06-21 04:45:34"),
    ("2024-08-11 06:28:08 America/New_York", None, "2024-08-11 10:28:08"), ("2024-03-10 02:30:00", "America/New_York", "2024-03-10 07:30:00"), ("2024-11-03 01:30:00", "America/New_York", "2024-11-03 05:30:00"),
    ("2024-11-03", "America/New_York", "2024-11-03 04:00:00"), ("1746540452", None, "2025-05-06 14:07:32"), ("1746540452238", None, "2025-05-06 14:07:32.238"), (" 08.06.2025 11:30:41 ", "UTC", "2025-06-08 11:30:41"),
    ("Mon, 11 Aug 2025 06:45:02 +0200", None, "2025-08-11 04:45:02"), ("2024-02-22T13:23:10.270005999Z", None, "2024-02-22 13:23:10.270005"), ("2025-01-01 00:00:00", "No/Where", "2025-01-01 00:00:00"),
    ("2024-13-05 08:00:00", None, None), ("2025-02-29", None, None), ("25:61", None, None), ("", None, None), ("  ", None, None), (None, None, None), ("n/a", None, None), ("12", None, None),
    ("2025-01-01 24:10:00", None, None), ("13/13/2025", None, None), ("2025-01-01 10:00 No/Where", None, None), ("9" * 5000, None, None), ("2025-06-01T00:00:00" + " " * 5000, None, None),
]


@pytest.mark.parametrize(("raw", "tz", "want"), CASES)
def test_parse(raw, tz, want):
    got = I.parse_instant(raw, tz)
    assert (None if got is None else datetime.fromtimestamp(0, UTC).timestamp() + got / 1e6) == (None if want is None else datetime.fromisoformat(want).replace(tzinfo=UTC).timestamp())


def test_table_and_increment(spark, tmp_path):
    d = I.InstantDictionary(spark, f"file://{tmp_path}/dict")
    df = spark.createDataFrame([(i, r, z, "x") for i, (r, z, _) in enumerate(CASES)] + [(99, "2024-11-03", "America/New_York", "x")] * 2, "id int, raw string, tz string, us string")
    out = I.normalise(df, "raw", "tz", "utc_us", d)
    assert out.count() == df.count() and out.columns == ["id", "raw", "tz", "us", "utc_us"]
    first = d.read().count()
    more = I.normalise(spark.createDataFrame([(1, "2025-01-01", None), (2, "2024-11-03", "America/New_York")], "id int, raw string, tz string"), "raw", "tz", "utc_us", d)
    assert more.filter("utc_us IS NOT NULL").count() == 2 and d.read().count() == first + 1
    one = out.filter("id = 0").select(I.utc_text(F.col("utc_us")).alias("t")).first().t
    assert one == "2025-05-06T12:09:42.000000Z"


def test_empty(spark):
    empty = spark.createDataFrame([], "raw string, tz string")
    assert I.normalise(empty, "raw", "tz").count() == 0
    assert I.normalise(empty, "raw", "tz", found_only=True).count() == 0


def test_hot_value(spark):
    df = spark.createDataFrame([(i, "2025-01-01" if i % 3 else f"2025-01-01 00:{i % 60:02d}:00", "UTC") for i in range(900)], "id int, raw string, tz string")
    out = I.normalise(df, "raw", "tz")
    assert out.filter("utc_us IS NOT NULL").count() == 900
