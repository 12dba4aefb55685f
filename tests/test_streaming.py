"""Streams give what a batch over the same rows gives."""

from memloom.streaming import triggers


def test_message_batches(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else None, f"m{t}") for c in (1, 2) for t in range(5)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = []
    stream = spark.readStream.schema("conv_id bigint, turn bigint, role string, content string").parquet(f"{tmp_path}/in")
    q = triggers.memorise_stream(stream, lambda df, n: got.extend(df.collect()), f"{tmp_path}/check", least=2)
    q.awaitTermination(120)
    assert sorted((r.conv_id, r.n, r.first_turn, r.last_turn) for r in got) == [(1, 5, 0, 4), (2, 5, 0, 4)]
    assert got[0].text.startswith("[user]: m0\n[user]: m1")


def test_late_counts(spark, tmp_path):
    from conftest import DATA

    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(DATA)
    out = triggers.late_tolerant_counts(stream.withColumn("ts", stream["ts"].cast("timestamp")))
    q = out.writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM late").first().n == spark.read.parquet(f"{DATA}/events.parquet").count()
