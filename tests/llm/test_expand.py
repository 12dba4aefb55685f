"""Classes of equal records, whatever their size, against all pairs."""

from itertools import combinations

import pytest
from memloom.llm import expand


@pytest.mark.parametrize("block", [3, 1_000])
def test_pairs_of_classes(spark, monkeypatch, block):
    monkeypatch.setattr(expand, "BLOCK", block)
    of = {**{f"h{k:02}": 1 for k in range(20)}, **{f"g{k:02}": 2 for k in range(11)}, "s1": 3, "s2": 3, "t": 4, "u": 5}
    pairs = [(1, 2), (2, 3), (1, 4), (3, 4), (4, 5)]
    want = {(x, y) for x, y in combinations(sorted(of), 2) if of[x] == of[y] or (of[x], of[y]) in pairs or (of[y], of[x]) in pairs}
    members = spark.createDataFrame([*of.items(), ("both", 4), ("both", 5)], "id string, of bigint")
    want |= {tuple(sorted(("both", x))) for x, k in of.items() if {(k, 4), (4, k), (k, 5), (5, k)} & {*pairs, (4, 4), (5, 5)}}
    got = [tuple(r) for r in expand.record_pairs(spark.createDataFrame(pairs, "a bigint, b bigint"), members).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_none(spark):
    assert expand.record_pairs(spark.createDataFrame([], "a bigint, b bigint"), spark.createDataFrame([], "id string, of bigint")).count() == 0
