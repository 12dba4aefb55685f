"""Copies in other forms."""

from memloom.llm import copies as C

SCHEMA = "id string, memory_type string, summary string, leaf string, n int"


def found(spark, rows):
    df = spark.createDataFrame([(i, k, s, "x", 1) for i, k, s in rows], SCHEMA)
    return sorted(map(tuple, C.copies(df).collect()))


def test_forms(spark):
    rows = [("a", "event", "Ate two figs."), ("b", " EV-ent", "ate  TWO (figs)"), ("c", "fact", "ate two figs"), ("d", "event", "x: 1; y: 2"), ("e", "event", "Y: 2 | X: 1"), ("f", "event", "y: 2\nx: 1\n"), ("g", "event", "y 2 x 1 more"),
            ("h", "event", "one; two"), ("i", "event", "two; one"), ("j", "event", None), ("k", "event", "..."), ("l", None, "lone"), ("m", "", "LONE"), (None, "event", "ate two figs"), ("a", "event", "Ate two figs.")]
    assert found(spark, rows) == [("a", "b"), ("d", "e"), ("d", "f"), ("l", "m")]


def test_plain_text_joins_fields(spark):
    rows = [("a", "t", "x 1 y 2"), ("b", "t", "x: 1; y: 2"), ("c", "t", "y: 2; x: 1"), ("d", "t", "y2x1")]
    assert found(spark, rows) == [("a", "b"), ("a", "c"), ("a", "d")]


def test_chains(spark):
    # the same letters cut into other fields join two orders
    rows = [("a", "t", "ab: c; d: e"), ("b", "t", "d: e; ab: c"), ("c", "t", "a: b; cd: e"), ("d", "t", "cd: e; a: b"), ("e", "t", "z: z; q: q")]
    assert found(spark, rows) == [("a", "b"), ("a", "c"), ("a", "d")]


def test_hot_group_and_empty(spark):
    rows = [(f"h{i:04}", "t", "The same!" if i % 3 else f"other {i}") for i in range(600)]
    assert len(found(spark, rows)) == 399
    assert found(spark, []) == []
    long = "w " * 100_000
    assert found(spark, [("a", "t", long), ("b", "t", long.upper())]) == [("a", "b")]
    df = spark.createDataFrame([("a", "t", "x y", "l", 1), ("b", "T", "X-Y", "l", 1), ("c", "t", "z", "l", 1)], SCHEMA)
    assert sorted(map(tuple, C.collapsed(df).collect())) == [("a", 2), ("c", 1)]
