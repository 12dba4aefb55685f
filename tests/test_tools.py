"""Statistics of tool calls beyond a million a tool."""

from memloom.plans import catalogue


def test_all_calls_count(spark, tmp_path):
    n = 1_000_003
    first = "CASE WHEN id < 3 THEN 1000000.0D ELSE 1.0D END"
    rows = spark.range(n).selectExpr("id AS event_id", "timestamp_micros(id) AS ts", "id % 7 AS user_id", "'click' AS event_type", f"{first} AS value", "'{\"k\": 12}' AS props")
    rows.union(rows.limit(2).selectExpr("event_id", "ts", "user_id", "CAST(NULL AS STRING)", "value", "props")).write.parquet(f"{tmp_path}/events.parquet")
    (r,) = catalogue.tool_stats(spark, str(tmp_path)).collect()
    assert (r.tool_name, r.total_calls, r.recent_calls_analyzed) == ("click", n, n)
    assert r.avg_time_cost == round((3e6 + n - 3) / n, 6) and r.success_rate == round((n - 3) / n, 6)
