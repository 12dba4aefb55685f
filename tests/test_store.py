"""Logs and their state, filters, links and reinforcement against plain models."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from memloom.functions import vectors
from memloom.operators import filters, links, mutations, ranking, schema
from memloom.operators.store import MemoryStore
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def test_schema(spark):
    with pytest.raises(TypeError):
        schema.memory_schema("resources", StructType.fromDDL("url string"))
    assert schema.memory_schema("category_items").fieldNames()[-1] == "user_id"


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, None, 1)], "id int, u string, k int")
    ids = lambda w: sorted(r.id for r in filters.where(df, w).collect())
    assert ids(None) == ids({"u": None}) == [1, 2, 3] and ids({"u": "a"}) == ids({"u__in": "a"}) == [1] and ids({"u__in": ["a", "b"], "k": 1}) == [1] and ids({"u__in": []}) == []
    with pytest.raises(ValueError):
        filters.where(df, {"u__gt": "a"})
    with pytest.raises(ValueError):
        filters.where(df, {"nope": 1})
    with pytest.raises(ValueError):
        filters.normalise_where({"k": 1}, schema.DEFAULT_SCOPE)
    gone, kept = filters.split(df, {"u": "a"})
    assert gone.count() == 1 and kept.count() == 2


@pytest.mark.parametrize(("sim", "n", "days", "want"), [(0.8, 1, None, 0.277258872), (0.8, 1, 0, 0.554517744), (0.8, 1, 30, 0.277299682), (0.8, 10, 30, 0.959299289), (0.5, 3, 60, 0.173337812), (0.8, 1, -30, 1.108872272)])
def test_salience(spark, sim, n, days, want):
    last = "NULL" if days is None else f"TIMESTAMP '2025-06-01 00:00:00' - INTERVAL '{days}' DAY" if days >= 0 else f"TIMESTAMP '2025-06-01 00:00:00' + INTERVAL '{-days}' DAY"
    c = vectors.salience(F.lit(sim), F.lit(n), F.expr(f"CAST({last} AS TIMESTAMP)"), F.expr("TIMESTAMP '2025-06-01 00:00:00'"))
    assert math.isclose(spark.range(1).select(c.alias("x")).first().x, want, abs_tol=1e-8)


def test_ranking(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [1.0]), ("f", [float("nan"), 1.0]), ("g", [0.0, 0.0]), ("h", [1.0, None])], "id string, embedding array<float>")
    got = [(r.id, round(r.score, 4)) for r in ranking.cosine_top_k(df, [1.0, 0.0], 10).orderBy("rank").collect()]
    assert got == [("a", 1.0), ("b", 1.0), ("c", 0.0), ("g", 0.0)]
    by_column = [r.id for r in ranking.cosine_top_k(df, vectors.literal([1.0, 0.0]), 10).orderBy("rank").collect()]
    assert by_column == ["a", "b", "c", "g"]
    with pytest.raises(ValueError):
        ranking.search(df, [1.0, 0.0], ranking="other")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_state_of_random_logs(spark, seed):
    rng = random.Random(seed)
    log, state = [], {}
    for seq in range(300):
        i, op = rng.randrange(20), rng.choice(["put", "patch", "patch", "delete"])
        a, b = rng.choice([None, rng.randrange(9)]), rng.choice([None, rng.randrange(9)])
        extra = rng.choice([None, json.dumps({rng.choice("xyz"): rng.randrange(9)}), "broken"])
        log.append((i, seq, op, a, b, extra))
        new = {} if extra in (None, "broken") else json.loads(extra)
        if op == "put":
            state[i] = (a, b, new)
        elif op == "delete":
            state.pop(i, None)
        elif i in state:
            o = state[i]
            state[i] = (o[0] if a is None else a, o[1] if b is None else b, {**o[2], **new})
    rng.shuffle(log)
    df = spark.createDataFrame(log, "id int, seq int, op string, a int, b int, extra string")
    got = {r.id: (r.a, r.b, json.loads(r.extra) if r.extra else {}) for r in mutations.state_of(df, merged=("extra",)).collect()}
    assert got == state


def test_reinforced(spark):
    t = datetime(2025, 1, 1)
    rows = [("1", t, "Tea", "fact", "u"), ("2", t + timedelta(1), " tea ", "fact", "u"), ("3", t, "tea", "fact", None), ("4", t, "tea", "fact", None), ("5", t, "tea", "tool", "u"), ("6", t, "tea", "tool", "u")]
    df = spark.createDataFrame(rows, "id string, created_at timestamp, summary string, memory_type string, user_id string")
    got = {r.id: (r.reinforcement_count, r.last_reinforced_at) for r in mutations.reinforced(df, ["user_id"], ["created_at", "id"]).collect()}
    assert got == {"1": (2, t + timedelta(1)), "3": (2, t), "5": (1, t), "6": (1, t)}
    a, b = df.filter("id IN ('1', '3', '5')"), df.filter("id IN ('2', '4', '6')")
    step = mutations.reinforce_into(mutations.reinforced(a, ["user_id"], ["created_at", "id"]), b, ["user_id"], ["created_at", "id"])
    assert {r.id: (r.reinforcement_count, r.last_reinforced_at) for r in step.collect()} == got


def test_links(spark):
    old = spark.createDataFrame([("i", "a"), ("i", "b")], "item_id string, category_id string")
    new = spark.createDataFrame([("i", "b"), ("i", "c"), ("i", "c")], "item_id string, category_id string")
    assert sorted(map(tuple, links.membership_changes(old, new).collect())) == [("i", "a", "unlink"), ("i", "b", "keep"), ("i", "c", "link")]
    assert mutations.linked(old, new).count() == 3 and mutations.unlinked(old, new).count() == 1


def test_store(spark, tmp_path):
    store = MemoryStore(spark, f"file://{tmp_path}/s")
    items = spark.createDataFrame([("a", "fact", "one", "u"), ("b", "fact", "two", "v")], "id string, memory_type string, summary string, user_id string")
    store.append("memory_items", items)
    store.append("category_items", spark.createDataFrame([("l", "a", "c", "u"), ("m", "b", "c", "v")], "id string, item_id string, category_id string, user_id string"))
    store.update("memory_items", spark.createDataFrame([("a", "uno", '{"x": 1}')], "id string, summary string, extra string"))
    store.update("memory_items", spark.createDataFrame([("a", '{"y": 2}')], "id string, extra string"))
    r = store.get("memory_items", "a").first()
    assert (r.summary, r.memory_type, json.loads(r.extra)) == ("uno", "fact", {"x": 1, "y": 2})
    with pytest.raises(KeyError):
        store.update("memory_items", spark.createDataFrame([("zz", "x")], "id string, summary string"))
    with pytest.raises(ValueError):
        store.append("memory_items", spark.createDataFrame([(1,)], "nope int"))
    assert [x.id for x in store.table("memory_items", {"user_id": "v"}).collect()] == ["b"] and store.links_of("a").count() == 1
    store.compact("memory_items", f"file://{tmp_path}/t")
    assert MemoryStore(spark, f"file://{tmp_path}/t").table("memory_items").count() == 2
    gone = store.clear("memory_items", {"user_id": "u"})
    assert [x.id for x in gone.collect()] == ["a"] and [x.id for x in store.table("category_items").collect()] == ["m"]
    store.delete("memory_items", spark.createDataFrame([("nothing",)], "id string"))
    store.clear_all()
    assert store.table("memory_items").count() == 0 and store.table("category_items").count() == 0
    store.validate()
