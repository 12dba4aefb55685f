"""Memories put into whole conversations, with and without a system message."""

import duckdb
from conftest import rows
from memloom.plans import catalogue

BLOCK = "<memory_context>\n- likes tea\n- has a dog\n</memory_context>"


def test_whole_conversations(spark, tmp_path):
    said = [("a", 0, "system", "Be kind."), *[("a", k, "user", f"m{k}") for k in range(1, 6)], *[("b", k, "user", f"m{k}") for k in range(5)], ("c", 0, "user", "hi"), ("c", 1, "user", "m"), ("c", 2, "system", "late"), ("c", 2, "system", "late")]
    df = spark.createDataFrame(said, "conv_id string, turn bigint, role string, content string")
    df.write.parquet(f"{tmp_path}/conv1.parquet")
    got = catalogue.inject_context(spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == [("a", 6, "system", f"Be kind.\n\n{BLOCK}"), ("b", 6, "system", BLOCK), ("c", 3, "user", "hi")]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conv1 AS SELECT * FROM read_parquet('{tmp_path}/conv1.parquet/*.parquet')")
    assert rows(got) == rows(c.execute(catalogue.SQL["inject_context"]).df())
