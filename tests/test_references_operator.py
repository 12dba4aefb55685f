"""Dangling references against a plain model."""

import random
from datetime import datetime, timedelta

import pytest
from memloom.operators import references as R

LINK = "id string, ref string, created_at timestamp, extra string"
T0 = datetime(2025, 1, 1)


def at(h):
    return None if h is None else T0 + timedelta(hours=h)


def found(spark, links, parents, gone):
    links = spark.createDataFrame(links, LINK)
    parents = spark.createDataFrame(parents, "id string, created_at timestamp, key string")
    gone = spark.createDataFrame(gone, "entity string, record_id string, deleted_at timestamp, tbl string")
    out = R.dangling([R.Reference(links, "links", "ref", "p")], {"p": parents}, gone, {"p": "thing"})
    return sorted((r.rec_id or "") for r in out.collect())


def test_cases(spark):
    parents = [("A-1", at(1), ""), ("b2", at(5), ""), ("c3", None, ""), ("d4", at(2), ""), ("E5", at(1), ""), ("e-5", at(9), "")]
    gone = [("thing", " D4 ", at(2), ""), ("other", "a1", at(50), ""), ("thing", "e5", at(3), ""), ("thing", None, at(1), ""), ("thing", "b2", None, ""), (None, "b2", at(9), "")]
    links = [
        ("ok form", " a1\t", at(2), None), ("early", "B2", at(4), None), ("late", "b-2", at(5), None), ("no parent time", "C3", at(0), None), ("deleted", "d4", at(9), None),
        ("again early", "e5", at(4), None), ("again", "e5", at(9), None), ("blank", " \t", at(1), None), ("null", None, at(1), None), ("missing", "zz", at(1), None),
        ("missing", "zz", at(1), None), ("no time", "b2", None, None), ("no time missing", "yy", None, None), ("long", "x" * 50_000, at(1), None), (None, "zz", at(1), None),
    ]
    assert found(spark, links, parents, gone) == sorted(["early", "deleted", "again early", "missing", "no time missing", "long", ""])


def test_empty(spark):
    assert found(spark, [("a", "x", at(1), None)], [], []) == ["a"]
    assert found(spark, [], [("x", at(1), "")], []) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_key_and_many_ranges(spark, monkeypatch, seed):
    monkeypatch.setattr(R, "RANGE_PARENTS", 7)
    monkeypatch.setattr(R, "RANGE_REFERENCES", 11)
    rng = random.Random(seed)
    parents = {f"p{i}": rng.randrange(50) for i in range(60)}
    gone = [("thing", f"p{rng.randrange(60)}", at(rng.randrange(50)), "") for _ in range(20)]
    links = [(f"l{i}", "p0" if i % 3 == 0 else f"p{rng.randrange(70)}", at(rng.randrange(60)), None) for i in range(400)]
    last = {}
    for _, k, t, _ in gone:
        last[k] = max(t, last.get(k, t))
    want = [i for i, k, t, _ in links if k not in parents or (k in last and last[k] >= at(parents[k])) or at(parents[k]) > t]
    assert found(spark, links, [(k, at(v), "") for k, v in parents.items()], gone) == sorted(want)
