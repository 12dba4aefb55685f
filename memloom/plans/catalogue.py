"""Queries of the engine's own operators over the memory tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import text, vectors
from memloom.models import client
from memloom.operators import filters, links, mutations, ranking, tools
from memloom.operators.store import MemoryStore
from memloom.plans import prompts
from memloom.plans.service import MemoryService, Settings, with_extra
from memloom.session import load, scratch_path
from memloom.streaming import triggers

AS_OF = "2026-01-01 00:00:00"


def _as_of():  # noqa: ANN202
    return F.lit(AS_OF).cast("timestamp")



def _items(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "memory_items")


def _usable(df: DataFrame) -> DataFrame:
    return df.filter((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull()))


def _query(s: SparkSession, d: str) -> list[float]:
    """The vector of the first item by id: one row comes to the driver and travels on as a constant."""
    row = _usable(_items(s, d)).filter(~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)).select("id", "embedding")
    return list(row.orderBy("id").limit(1).first().embedding)


def _rounded(df: DataFrame, *more: str) -> DataFrame:
    return df.select("id", (F.round("score", 6) + 0.0).alias("score"), *[F.col(c).cast("bigint") if c == "rank" else F.col(c) for c in more])


# scans, filters, projections


def scope_eq(s, d):  # noqa: ANN001, ANN201
    return filters.where(_items(s, d), {"user_id": "u001"}).select("id", "memory_type")


def scope_in(s, d):  # noqa: ANN001, ANN201
    return filters.where(_items(s, d), {"user_id__in": ["u001", "u003"], "memory_type": "event"}).select("id", "user_id")


def scope_none_skipped(s, d):  # noqa: ANN001, ANN201
    return filters.where(load(s, d, "resources"), {"user_id": None, "modality__in": "audio"}).select("id", "url")


def project_no_embedding(s, d):  # noqa: ANN001, ANN201
    return filters.without_embedding(load(s, d, "memory_categories")).select("id", "name", "description", "summary", "user_id")


def point_lookup(s, d):  # noqa: ANN001, ANN201
    return filters.without_embedding(_items(s, d).filter(F.col("id") == _items(s, d).agg(F.min("id")).first()[0])).select("id", "summary", "user_id")


def links_of_item(s, d):  # noqa: ANN001, ANN201
    one = load(s, d, "category_items").filter("length(item_id) = 36").agg(F.max("item_id")).first()[0]
    return load(s, d, "category_items").filter(F.col("item_id") == one).select("id", "category_id").distinct()


def items_by_ref_id(s, d):  # noqa: ANN001, ANN201
    refs = _items(s, d).filter(F.col("user_id") == "u001").select(F.get_json_object("extra", "$.ref_id").alias("ref_id")).filter("ref_id IS NOT NULL")
    return filters.by_reference(_items(s, d), refs).select("id", "ref_id")


def score_threshold_limit(s, d):  # noqa: ANN001, ANN201
    return _rounded(filters.at_least(ranking.cosine_top_k(_usable(_items(s, d)), _query(s, d), 50), 0.35, 10), "rank")


# ranking


def cosine_topk(s, d):  # noqa: ANN001, ANN201
    return _rounded(ranking.cosine_top_k(_usable(_items(s, d)), _query(s, d), 10), "rank")


def cosine_all(s, d):  # noqa: ANN001, ANN201
    return _rounded(ranking.scored(_usable(_items(s, d)), _query(s, d)))


def topk_per_scope(s, d):  # noqa: ANN001, ANN201
    return _rounded(ranking.top_k_per(ranking.scored(_usable(_items(s, d)), _query(s, d)), 3, ["user_id"]), "user_id", "rank")


def salience_topk(s, d):  # noqa: ANN001, ANN201
    hits = ranking.search(with_extra(_usable(_items(s, d))), _query(s, d), 10, "salience", _as_of())
    return _rounded(hits, "rank")


def salience_score(s, d):  # noqa: ANN001, ANN201
    return _rounded(ranking.salience_scored(with_extra(_usable(_items(s, d))), _query(s, d), _as_of()))


def recency_decay(s, d):  # noqa: ANN001, ANN201
    rows = with_extra(_items(s, d))
    return rows.select("id", F.round(vectors.recency(F.col("last_reinforced_at"), _as_of(), 60.0), 6).alias("recency"), F.round(vectors.reinforcement(F.col("reinforcement_count")), 6).alias("reinforcement"))


def rag_category_tier(s, d):  # noqa: ANN001, ANN201
    pool = filters.with_summary(_usable(load(s, d, "memory_categories")))
    hits = ranking.cosine_top_k(pool, _query(s, d), 5)
    return links.materialise(hits, pool).select("id", "name", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def rag_item_tier(s, d):  # noqa: ANN001, ANN201
    pool = filters.where(_usable(_items(s, d)), {"user_id": "u001"})
    return links.materialise(ranking.cosine_top_k(pool, _query(s, d), 5), pool).select("id", "summary", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def rag_resource_tier(s, d):  # noqa: ANN001, ANN201
    pool = filters.with_vector(_usable(load(s, d, "resources")))
    return links.materialise(ranking.cosine_top_k(pool, _query(s, d), 5), pool).select("id", "caption", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def rag_three_tier(s, d):  # noqa: ANN001, ANN201
    tiers = (("category", filters.with_summary(_usable(load(s, d, "memory_categories")))), ("item", _usable(_items(s, d))), ("resource", _usable(load(s, d, "resources"))))
    q = _query(s, d)
    parts = [_rounded(ranking.cosine_top_k(df, q, 5), "rank").withColumn("tier", F.lit(name)) for name, df in tiers]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# hashes, reinforcement, state


def content_hash(s, d):  # noqa: ANN001, ANN201
    return _items(s, d).select("id", text.content_hash(F.col("summary"), F.col("memory_type")).alias("content_hash"))


def dedupe_reinforce(s, d):  # noqa: ANN001, ANN201
    out = mutations.reinforced(_items(s, d).filter("summary IS NOT NULL").select("id", "created_at", "summary", "memory_type"), [], ["created_at", "id"])
    return out.select("id", "content_hash", F.col("reinforcement_count").cast("bigint").alias("reinforcement_count"), F.unix_micros("last_reinforced_at").alias("last_us"))


def reinforce_by_scope(s, d):  # noqa: ANN001, ANN201
    out = mutations.reinforced(_items(s, d).filter("summary IS NOT NULL").select("id", "created_at", "summary", "memory_type", "user_id"), ["user_id"], ["created_at", "id"])
    return out.groupBy("user_id").agg(F.count("*").alias("n_items"), F.sum("reinforcement_count").alias("n_rows"))


def _event_log(s: SparkSession, d: str) -> DataFrame:
    """Events as a log of changes to users' records."""
    kind = F.when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "error", "delete").otherwise("patch")
    return load(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), kind.alias("op"), F.when(F.col("event_type") != "view", F.col("value")).alias("value"), F.when(F.col("event_type") != "click", F.get_json_object("props", "$.k").cast("int")).alias("k"))


def latest_state(s, d):  # noqa: ANN001, ANN201
    return mutations.state_of(_event_log(s, d))


def tombstone_delete(s, d):  # noqa: ANN001, ANN201
    gone = load(s, d, "tombstones").filter("entity = 'memory_item'")
    return mutations.without_deleted(_items(s, d), gone).select("id", "user_id")


def clear_scope(s, d):  # noqa: ANN001, ANN201
    gone, kept = mutations.cleared(_items(s, d), {"user_id": "u001"})
    return gone.select("id", F.lit("gone").alias("side")).unionByName(kept.select("id", F.lit("kept").alias("side")))


def category_get_or_create(s, d):  # noqa: ANN001, ANN201
    have = load(s, d, "memory_categories").select("id", "created_at", "updated_at", "name", "description", "embedding", "summary", "user_id")
    wanted = have.filter("user_id < 'u003'").select(F.concat(F.lit(" "), F.upper("name")).alias("name"), F.lit("filled in").alias("description"), "embedding", F.when(F.col("user_id") == "u001", "u001").otherwise("new").alias("user_id"))
    out = mutations.with_categories(have, wanted.dropDuplicates(["name", "user_id"]), ["user_id"], _as_of())
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("description") == "filled in").alias("n_filled"))


def link_idempotent(s, d):  # noqa: ANN001, ANN201
    all_links = load(s, d, "category_items").filter("item_id IS NOT NULL AND category_id IS NOT NULL").dropDuplicates(["item_id", "category_id"])
    old = all_links.filter("user_id < 'u020'")
    return mutations.linked(old, all_links).groupBy("category_id").agg(F.count("*").alias("n_links"))


def links_without_dangling(s, d):  # noqa: ANN001, ANN201
    return mutations.without_dangling(load(s, d, "category_items"), _items(s, d), load(s, d, "memory_categories")).select("id").distinct()


# joins


def category_items_semi(s, d):  # noqa: ANN001, ANN201
    hits = filters.where(load(s, d, "memory_categories"), {"user_id": "u001"})
    return links.items_of_categories(load(s, d, "category_items"), hits, _items(s, d)).select("id", F.col("first_link.id").alias("link_id"))


def resources_for_items(s, d):  # noqa: ANN001, ANN201
    return links.resources_of_items(filters.where(_items(s, d), {"user_id__in": ["u001", "u002"]}), load(s, d, "resources")).select("id", "url")


def llm_rank_join_order(s, d):  # noqa: ANN001, ANN201
    best = _items(s, d).filter("user_id = 'u002'").select("id").orderBy(F.desc("id")).limit(5).agg(F.reverse(F.array_sort(F.collect_list("id"))).alias("ids"))
    ids = best.select(F.concat("ids", F.array(F.lit("unknown")), F.slice("ids", 1, 1)).alias("ids"))
    return links.in_model_order(ids, _items(s, d)).select(F.col("pos").cast("bigint").alias("pos"), "id", "memory_type")


def category_name_map(s, d):  # noqa: ANN001, ANN201
    asked = _items(s, d).select("id", "user_id", F.array(F.lit(" GARDEN "), F.lit("languages"), F.lit("no such"), F.lit("garden")).alias("names"))
    return links.category_ids(asked, load(s, d, "memory_categories"), ["user_id"]).select("id", "category_id", F.col("pos").cast("bigint").alias("pos"))


def category_membership_diff(s, d):  # noqa: ANN001, ANN201
    rows = load(s, d, "category_items").select("item_id", "category_id", "created_at")
    early, late = rows.filter("created_at < '2025-06-01'"), rows.filter("created_at >= '2025-01-01'")
    return links.membership_changes(early, late).groupBy("change").agg(F.count("*").alias("n"))


def category_updates(s, d):  # noqa: ANN001, ANN201
    out = links.category_updates(load(s, d, "category_items"), _items(s, d))
    return out.select("category_id", "part", F.size("updates").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("updates", lambda u: F.concat(u["item_id"], F.coalesce(u["summary"], F.lit("")))), "|")).alias("digest"))


def category_lines(s, d):  # noqa: ANN001, ANN201
    rows = load(s, d, "memory_categories").withColumn("line", F.concat(F.lit("- "), text.category_text(F.col("name"), F.col("description"))))
    return links.joined_lines(rows, ["user_id"], "line", ["created_at", "id"])


# citations


def _cited(s: SparkSession, d: str) -> DataFrame:
    short = text.short_reference(F.col("id"))
    said = F.concat(F.coalesce("summary", F.lit("")), F.lit(" [ref:"), short, F.lit(", x-1] , and [ref:"), F.reverse(short), F.lit(","), short, F.lit("]  ."))
    return _items(s, d).select("id", F.when(F.col("memory_type") == "event", said).otherwise(F.col("summary")).alias("said"))


def extract_refs(s, d):  # noqa: ANN001, ANN201
    return _cited(s, d).select("id", F.posexplode(text.references(F.col("said"))).alias("pos", "ref")).withColumn("pos", F.col("pos").cast("bigint"))


def strip_refs(s, d):  # noqa: ANN001, ANN201
    return _cited(s, d).select("id", F.md5(text.strip_references(F.regexp_replace("said", r"[^\x20-\x7e]", " "))).alias("digest"))


def cite_refs(s, d):  # noqa: ANN001, ANN201
    return _cited(s, d).select("id", text.numbered_citations(F.col("said")).alias("cited"))


def short_ref_id(s, d):  # noqa: ANN001, ANN201
    return _items(s, d).select("id", text.short_reference(F.col("id")).alias("ref_id"))


def ref_writeback(s, d):  # noqa: ANN001, ANN201
    rows = load(s, d, "category_items").select("category_id", "item_id", F.unix_micros("created_at").alias("pos"))
    cited = rows.groupBy("category_id").agg(F.concat(F.lit("[ref:"), text.short_reference(F.min("item_id")), F.lit(","), text.short_reference(F.max("item_id")), F.lit("]")).alias("summary"))
    return links.write_back(rows, cited)


def reference_map(s, d):  # noqa: ANN001, ANN201
    return _items(s, d).select("id", text.reference_line(text.short_reference(F.col("id")), F.col("summary")).alias("line"))


# conversations and answers


def conversation_format(s, d):  # noqa: ANN001, ANN201
    turns = load(s, d, "conv1").select("conv_id", "turn", "role", "content").distinct()
    msgs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    shaped = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit("").alias("created_at")))
    return msgs.select("conv_id", F.size("m").cast("bigint").alias("n"), F.md5(text.conversation_lines(shaped)).alias("digest"))


def last_user_message(s, d):  # noqa: ANN001, ANN201
    return ranking.last_user_message(load(s, d, "conv1"))


def _injected(rows: DataFrame) -> DataFrame:
    turns = rows.select("conv_id", "turn", "role", "content").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    shaped = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    out = turns.select("conv_id", text.inject_memories(shaped, F.array(F.lit("likes tea"), F.lit("has a dog"))).alias("m"))
    return out.select("conv_id", F.size("m").cast("bigint").alias("n"), F.col("m")[0]["role"].alias("first_role"), F.col("m")[0]["content"].alias("first_content"))


def inject_context(s, d):  # noqa: ANN001, ANN201
    return _injected(load(s, d, "conv1"))


def segment_slice(s, d):  # noqa: ANN001, ANN201
    doc = load(s, d, "documents").filter("text IS NOT NULL")
    return doc.select("doc_id", F.md5(text.segment_text(F.col("text"), F.lit(2), F.lit(5))).alias("digest"))


def json_blob(s, d):  # noqa: ANN001, ANN201
    return _items(s, d).select("id", text.json_blob(F.concat(F.lit("answer: "), "extra", F.lit(" - done"))).alias("blob"))


def tag_content(s, d):  # noqa: ANN001, ANN201
    raw = F.concat(F.lit("x <Caption> "), F.coalesce("memory_type", F.lit("")), F.lit(" </CAPTION> <caption>later</caption>"))
    return _items(s, d).select("id", text.tag_content(raw, "caption").alias("caption"))


def decision_parse(s, d):  # noqa: ANN001, ANN201
    raw = F.when(F.col("memory_type") == "event", "<decision>no_retrieve</decision>").when(F.col("memory_type") == "skill", "we must RETRIEVE more").when(F.col("memory_type") == "tool", "NO RETRIEVE needed")
    return _items(s, d).select("id", text.decision(raw).alias("decision"), text.judgement(raw).alias("judgement"))


def filename_from_url(s, d):  # noqa: ANN001, ANN201
    given = F.when(F.col("modality") == "audio", F.concat(F.col("url"), F.lit(".php?type=mp3&id="), F.col("user_id"))).otherwise(F.col("url"))
    return load(s, d, "resources").select("id", text.file_name(given, F.col("modality")).alias("file_name"))


def segment_url(s, d):  # noqa: ANN001, ANN201
    return load(s, d, "resources").select("id", text.segment_url(F.col("url"), F.lit(2), F.lit(3)).alias("url"))


def patch_parse(s, d):  # noqa: ANN001, ANN201
    raw = F.when(F.col("memory_type") == "event", F.lit('ok {"need_update": true, "updated_content": " new "}')).when(F.col("memory_type") == "tool", F.lit('{"need_update": true, "updated_content": "empty"}')).otherwise(F.lit("none"))
    out = text.category_patch(raw)
    return _items(s, d).select("id", F.coalesce(out["need_update"], F.lit(False)).alias("need_update"), F.coalesce(out["content"], F.lit("")).alias("content"))


def category_summary_prompt(s, d):  # noqa: ANN001, ANN201
    rows = links.category_updates(load(s, d, "category_items"), _items(s, d)).join(load(s, d, "memory_categories").select(F.col("id").alias("category_id"), "name", "summary"), "category_id")
    return rows.select("category_id", "part", F.length(prompts.category_summary(F.col("name"), F.col("summary"), F.col("updates"))).cast("bigint").alias("chars"))


def format_scores(s, d):  # noqa: ANN001, ANN201
    hits = ranking.cosine_top_k(_usable(_items(s, d)), _query(s, d), 5)
    return hits.select("id", text.scored_line("item", F.col("summary"), F.col("score")).alias("line"))


# tools and calls


def _calls(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select(F.col("event_type").alias("tool_name"), "user_id", "event_id", "ts", (F.col("value") < 50).alias("success"), F.col("value").alias("time_cost"), (F.col("value") / 10).alias("score"), (F.get_json_object("props", "$.k").cast("int") - 10).alias("token_cost"))


def tool_stats(s, d):  # noqa: ANN001, ANN201
    out = tools.statistics(_calls(s, d), ["tool_name"], ["ts", "event_id"], None)
    return out.select("tool_name", "total_calls", "recent_calls_analyzed", *[F.round(c, 6).alias(c) for c in ("avg_time_cost", "success_rate", "avg_score", "avg_token_cost")])


def tool_stats_recent_n(s, d):  # noqa: ANN001, ANN201
    out = tools.statistics(_calls(s, d), ["user_id"], ["ts", "event_id"], 20)
    return out.select("user_id", "total_calls", "recent_calls_analyzed", *[F.round(c, 6).alias(c) for c in ("avg_time_cost", "success_rate", "avg_score", "avg_token_cost")])


def tool_call_hash(s, d):  # noqa: ANN001, ANN201
    rows = load(s, d, "events")
    return rows.select("event_id", text.tool_call_hash(F.col("event_type"), F.col("props"), F.col("user_id").cast("string")).alias("call_hash"))


def llm_call_stats(s, d):  # noqa: ANN001, ANN201
    log = load(s, d, "events").select(F.col("event_type").alias("operation"), F.when(F.col("value") > 100, "error").otherwise("success").alias("status"), F.length("props").alias("chars"), F.col("value").alias("seconds"), F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit("s").alias("step_id"))
    return client.call_statistics(log.filter(filters.call_filter(operations=["CLICK", "view", "purchase"]))).select("operation", "n_calls", "n_errors", F.col("chars").cast("bigint").alias("chars"), F.round("avg_seconds", 6).alias("avg_seconds"))


# pipelines and streams

_STUB = {
    "Answer with one <item>": "<item><memory><content>Keeps the yard tidy</content><categories><category>preferences</category></categories></memory><memory><content>Met a friend</content><categories><category>people</category><category>events</category></categories></memory></item>",
    "Rewrite the category": "# summary",
}


def memorize_stub(s, d):  # noqa: ANN001, ANN201
    """Every conversation as a resource of its user, through the whole writing pipeline with a stub model."""
    turns = load(s, d, "conv1").select("conv_id", "turn", "role", "content", "user_id").distinct().groupBy("conv_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("m"))
    batch = turns.select(F.concat(F.lit("/in/"), "conv_id", F.lit(".json")).alias("url"), F.lit("conversation").alias("modality"), F.to_json(F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("raw_text"))
    store = MemoryStore(s, scratch_path(s, "store"))
    MemoryService(store, client.stub_factory(16, _STUB), Settings(reinforce=True)).memorize(batch, {"user_id": "u"})
    counts = [store.table(e).groupBy().agg(F.count("*").alias("n")).select(F.lit(e).alias("entity"), "n") for e in ("resources", "memory_items", "memory_categories", "category_items")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def _streamed(s: SparkSession, d: str, table: str, name: str, shape, complete: bool = False) -> DataFrame:  # noqa: ANN001
    """A table read as a stream until it is at its end; micro-batches go to a scratch table."""
    whole = load(s, d, table)
    stream = s.readStream.schema(whole.schema).parquet(f"{d}/{table}*.parquet")
    out = scratch_path(s, name)
    put = lambda df, n: df.write.mode("overwrite" if complete else "append").parquet(out)
    q = shape(stream).writeStream.outputMode("complete" if complete else "append").option("checkpointLocation", scratch_path(s, f"{name}-log")).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return s.read.parquet(out)


def stream_count_trigger(s, d):  # noqa: ANN001, ANN201
    """Batches of at least two messages as they come; a single one waits for the next."""
    got = _streamed(s, d, "conv1", "batches", lambda m: triggers.message_batches(m.filter("role IS NOT NULL"), 2, None))
    return got.groupBy("conv_id").agg(F.sum("n").alias("n_messages"), F.max("last_turn").alias("last_turn"))


def stream_window_counts(s, d):  # noqa: ANN001, ANN201
    got = _streamed(s, d, "events", "windows", lambda e: triggers.late_tolerant_counts(e.withColumn("ts", F.col("ts").cast("timestamp"))), complete=True)
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


_NAMES = """scope_eq scope_in scope_none_skipped project_no_embedding point_lookup links_of_item items_by_ref_id score_threshold_limit cosine_topk cosine_all topk_per_scope salience_topk
salience_score recency_decay rag_category_tier rag_item_tier rag_resource_tier rag_three_tier content_hash dedupe_reinforce reinforce_by_scope latest_state tombstone_delete clear_scope
category_get_or_create link_idempotent links_without_dangling category_items_semi resources_for_items llm_rank_join_order category_name_map category_membership_diff category_updates category_lines
extract_refs strip_refs cite_refs short_ref_id ref_writeback reference_map conversation_format last_user_message inject_context segment_slice json_blob tag_content decision_parse filename_from_url
segment_url patch_parse category_summary_prompt format_scores tool_stats tool_stats_recent_n tool_call_hash llm_call_stats memorize_stub stream_count_trigger stream_window_counts"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_Q = """q AS (SELECT embedding::DOUBLE[] AS q FROM memory_items WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x != 0)) > 0 ORDER BY id LIMIT 1)"""


def _scored(table: str, where: str = "true") -> str:
    return f"""(SELECT * FROM (SELECT t.*, list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)) + 1e-9) AS score
      FROM (SELECT *, embedding::DOUBLE[] AS e FROM {table} WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND {where}) t, q) WHERE NOT isnan(score))"""


def _top(table: str, k: int, where: str = "true") -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {_scored(table, where)} QUALIFY rank <= {k})"


_COUNT = "coalesce(try_cast(json_extract_string(extra, '$.reinforcement_count') AS INT), 1)"
_LAST = "try_cast(json_extract_string(extra, '$.last_reinforced_at') AS TIMESTAMPTZ)"
_DAYS = f"((epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us({_LAST})) / 86400e6)"


def _recency(half_life: int) -> str:
    return f"CASE WHEN {_LAST} IS NULL THEN 0.5 ELSE exp(-0.693 * {_DAYS} / {half_life}) END"


_SAL = f"(SELECT * EXCLUDE score, score * ln({_COUNT} + 1) * ({_recency(30)}) AS score FROM {_scored('memory_items')})"
_WS = r"[\s\x1c-\x1f\x85\p{Z}]+"
_HASH = f"substring(sha256(memory_type || ':' || trim(regexp_replace(lower(summary), '{_WS}', ' ', 'g'))), 1, 16)"
_TRIM = f"regexp_replace(@, '^{_WS}|{_WS}$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.replace("@", c)


_SHORT = "substring(replace(id, '-', ''), 1, 6)"
_CITED = f"""c AS (SELECT id, CASE WHEN memory_type = 'event' THEN coalesce(summary, '') || ' [ref:' || {_SHORT} || ', x-1] , and [ref:' || reverse({_SHORT}) || ',' || {_SHORT} || ']  .' ELSE summary END AS said FROM memory_items)"""
_REFS = r"regexp_extract_all(said, '\[ref:([a-zA-Z0-9_,\-]+)\]', 1)"
_CATEXT = f"""CASE WHEN length({_trim("coalesce(description, '')")}) > 0 THEN coalesce(nullif({_trim("name")}, ''), 'Untitled') || ': ' || {_trim("description")} ELSE coalesce(nullif({_trim("name")}, ''), 'Untitled') END"""
_PARTS = f"(SELECT category_id, ceil(count(*) / {links.UPDATES}.0)::BIGINT AS parts FROM category_items GROUP BY 1)"
_PART = "('0x' || md5(item_id)[1:8])::BIGINT % parts"
_STATS = "avg(value) AS a, avg(CASE WHEN value < 50 THEN 1 ELSE 0 END) AS s, avg(value / 10) AS c, coalesce(avg(CASE WHEN json_extract_string(props, '$.k')::INT >= 10 THEN json_extract_string(props, '$.k')::INT - 10 END), 0) AS t"

SQL = {
    "scope_eq": "SELECT id, memory_type FROM memory_items WHERE user_id = 'u001'",
    "scope_in": "SELECT id, user_id FROM memory_items WHERE user_id IN ('u001', 'u003') AND memory_type = 'event'",
    "scope_none_skipped": "SELECT id, url FROM resources WHERE modality = 'audio'",
    "project_no_embedding": "SELECT id, name, description, summary, user_id FROM memory_categories",
    "point_lookup": "SELECT id, summary, user_id FROM memory_items WHERE id = (SELECT min(id) FROM memory_items)",
    "links_of_item": "SELECT DISTINCT id, category_id FROM category_items WHERE item_id = (SELECT max(item_id) FROM category_items WHERE length(item_id) = 36)",
    "items_by_ref_id": "SELECT id, json_extract_string(extra, '$.ref_id') AS ref_id FROM memory_items WHERE json_extract_string(extra, '$.ref_id') IN (SELECT json_extract_string(extra, '$.ref_id') FROM memory_items WHERE user_id = 'u001')",
    "score_threshold_limit": f"WITH {_Q} SELECT id, round(score, 6) + 0.0 AS score, rank FROM {_top('memory_items', 50)} WHERE score >= 0.35 ORDER BY rank LIMIT 10",
    "cosine_topk": f"WITH {_Q} SELECT id, round(score, 6) + 0.0 AS score, rank FROM {_top('memory_items', 10)}",
    "cosine_all": f"WITH {_Q} SELECT id, round(score, 6) + 0.0 AS score FROM {_scored('memory_items')}",
    "topk_per_scope": f"WITH {_Q} SELECT id, round(score, 6) + 0.0 AS score, user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rank FROM {_scored('memory_items')} QUALIFY rank <= 3",
    "salience_topk": f"WITH {_Q} SELECT id, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {_SAL} QUALIFY rank <= 10",
    "salience_score": f"WITH {_Q} SELECT id, round(score, 6) + 0.0 AS score FROM {_SAL}",
    "recency_decay": f"SELECT id, round({_recency(60)}, 6) AS recency, round(ln({_COUNT} + 1), 6) AS reinforcement FROM memory_items",
    "rag_category_tier": f"WITH {_Q} SELECT id, name, round(score, 6) + 0.0 AS score, rank FROM {_top('memory_categories', 5, 'length(summary) > 0')}",
    "rag_item_tier": f"""WITH {_Q} SELECT id, summary, round(score, 6) + 0.0 AS score, rank FROM {_top("memory_items", 5, "user_id = 'u001'")}""",
    "rag_resource_tier": f"WITH {_Q} SELECT id, caption, round(score, 6) + 0.0 AS score, rank FROM {_top('resources', 5)}",
    "rag_three_tier": f"WITH {_Q} SELECT id, round(score, 6) + 0.0 AS score, rank, 'category' AS tier FROM {_top('memory_categories', 5, 'length(summary) > 0')} UNION ALL SELECT id, round(score, 6) + 0.0, rank, 'item' FROM {_top('memory_items', 5)} UNION ALL SELECT id, round(score, 6) + 0.0, rank, 'resource' FROM {_top('resources', 5)}",
    "content_hash": f"SELECT id, {_HASH} AS content_hash FROM memory_items",
    "dedupe_reinforce": f"SELECT arg_min(id, (created_at, id)) AS id, {_HASH} AS content_hash, count(*) AS reinforcement_count, epoch_us(max(created_at)) AS last_us FROM memory_items WHERE summary IS NOT NULL GROUP BY {_HASH}, CASE WHEN memory_type = 'tool' THEN id END",
    "reinforce_by_scope": f"SELECT user_id, count(*) AS n_items, sum(n)::BIGINT AS n_rows FROM (SELECT user_id, count(*) AS n FROM memory_items WHERE summary IS NOT NULL GROUP BY user_id, {_HASH}, CASE WHEN memory_type = 'tool' THEN id END) GROUP BY 1",
    "latest_state": """WITH l AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'patch' END AS op, CASE WHEN event_type != 'view' THEN value END AS value, CASE WHEN event_type != 'click' THEN json_extract_string(props, '$.k')::INT END AS k FROM events),
      b AS (SELECT id, max(seq) AS start, arg_max(op, seq) AS last FROM l WHERE op != 'patch' GROUP BY 1) SELECT l.id, arg_max(value, seq) FILTER (value IS NOT NULL) AS value, arg_max(k, seq) FILTER (k IS NOT NULL) AS k FROM l JOIN b USING (id) WHERE last = 'put' AND seq >= start GROUP BY 1""",
    "tombstone_delete": "SELECT id, user_id FROM memory_items WHERE id NOT IN (SELECT record_id FROM tombstones WHERE entity = 'memory_item')",
    "clear_scope": "SELECT id, CASE WHEN user_id = 'u001' THEN 'gone' ELSE 'kept' END AS side FROM memory_items",
    "category_get_or_create": f"""WITH h AS (SELECT lower({_trim("name")}) AS k, user_id, description FROM memory_categories), w AS (SELECT DISTINCT lower({_trim("name")}) AS k, CASE WHEN user_id = 'u001' THEN 'u001' ELSE 'new' END AS user_id FROM memory_categories WHERE user_id < 'u003'),
      a AS (SELECT h.user_id, CASE WHEN w.k IS NOT NULL AND length(trim(coalesce(h.description, ''))) = 0 THEN 'filled in' ELSE h.description END AS description FROM h LEFT JOIN w ON h.k = w.k AND h.user_id IS NOT DISTINCT FROM w.user_id
        UNION ALL SELECT w.user_id, 'filled in' FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.k = w.k AND h.user_id = w.user_id)) SELECT user_id, count(*) AS n, count(*) FILTER (description = 'filled in') AS n_filled FROM a GROUP BY 1""",
    "link_idempotent": "SELECT category_id, count(DISTINCT item_id) AS n_links FROM category_items WHERE item_id IS NOT NULL AND category_id IS NOT NULL GROUP BY 1",
    "links_without_dangling": "SELECT DISTINCT id FROM category_items WHERE item_id IN (SELECT id FROM memory_items) AND category_id IN (SELECT id FROM memory_categories)",
    "category_items_semi": "SELECT i.id, arg_min(l.id, (l.created_at, l.id)) AS link_id FROM category_items l JOIN memory_items i ON i.id = l.item_id WHERE l.category_id IN (SELECT id FROM memory_categories WHERE user_id = 'u001') GROUP BY 1",
    "resources_for_items": "SELECT id, url FROM resources WHERE id IN (SELECT resource_id FROM memory_items WHERE user_id IN ('u001', 'u002'))",
    "llm_rank_join_order": "WITH r AS (SELECT id, memory_type, row_number() OVER (ORDER BY id DESC) - 1 AS pos FROM memory_items WHERE user_id = 'u002') SELECT pos, id, memory_type FROM r WHERE pos < 5 UNION ALL SELECT (SELECT least(count(*), 5) FROM r) + 1, id, memory_type FROM r WHERE pos = 0",
    "category_name_map": f"SELECT i.id, c.id AS category_id, min(n.pos) AS pos FROM memory_items i, (VALUES ('garden', 0::BIGINT), ('languages', 1), ('no such', 2), ('garden', 3)) n(name, pos), memory_categories c WHERE c.user_id = i.user_id AND lower({_trim('c.name')}) = n.name GROUP BY 1, 2",
    "category_membership_diff": """WITH o AS (SELECT DISTINCT item_id, category_id FROM category_items WHERE created_at < TIMESTAMPTZ '2025-06-01 00:00:00+00'), n AS (SELECT DISTINCT item_id, category_id FROM category_items WHERE created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00'),
      b AS (SELECT count(*) AS k FROM o JOIN n USING (item_id, category_id)), c AS (SELECT 'keep' AS change, k AS n FROM b UNION ALL SELECT 'unlink', (SELECT count(*) FROM o) - k - 0 FROM b UNION ALL SELECT 'link', (SELECT count(*) FROM n) - k FROM b) SELECT * FROM c WHERE n > 0""",
    "category_updates": f"SELECT category_id, {_PART} AS part, count(*) AS n, md5(string_agg(item_id || coalesce(summary, ''), '|' ORDER BY created_at, item_id, summary NULLS FIRST)) AS digest FROM (SELECT DISTINCT category_id, item_id FROM category_items) l JOIN (SELECT id AS item_id, created_at, summary FROM memory_items) i USING (item_id) JOIN {_PARTS} USING (category_id) GROUP BY 1, 2",
    "category_lines": f"SELECT user_id, string_agg('- ' || ({_CATEXT}), chr(10) ORDER BY created_at, id) AS text FROM memory_categories GROUP BY 1",
    "extract_refs": f"WITH {_CITED}, r AS (SELECT id, list_filter(list_transform(flatten(list_transform({_REFS}, lambda m: string_split(m, ','))), lambda x: trim(x)), lambda x: x != '') AS r FROM c), u AS (SELECT id, unnest(r) AS ref, unnest(range(len(r))) AS p FROM r), f AS (SELECT id, ref, min(p) AS p FROM u GROUP BY 1, 2) SELECT id, ref, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS pos FROM f",
    "strip_refs": rf"WITH {_CITED}, p AS (SELECT id, regexp_replace(said, '[^\x20-\x7e]', ' ', 'g') AS said FROM c) SELECT id, md5(CASE WHEN length(said) > 0 THEN trim(regexp_replace(regexp_replace(regexp_replace(said, '\[ref:([a-zA-Z0-9_,\-]+)\]', '', 'g'), '\s+([.,;:!?])', '\1', 'g'), '\s+', ' ', 'g')) ELSE said END) AS digest FROM p",
    "short_ref_id": f"SELECT id, {_SHORT} AS ref_id FROM memory_items",
    "ref_writeback": "WITH s AS (SELECT category_id, item_id, epoch_us(created_at) AS pos, substring(replace(item_id, '-', ''), 1, 6) AS ref_id FROM category_items WHERE category_id IS NOT NULL AND item_id IS NOT NULL), m AS (SELECT category_id, substring(replace(min(item_id), '-', ''), 1, 6) AS a, substring(replace(max(item_id), '-', ''), 1, 6) AS b FROM s GROUP BY 1), k AS (SELECT s.category_id, ref_id, arg_max(item_id, (pos, item_id)) AS item_id FROM s JOIN m USING (category_id) WHERE (ref_id = a AND regexp_full_match(a, '[a-zA-Z0-9_\\-]+') OR ref_id = b AND regexp_full_match(b, '[a-zA-Z0-9_\\-]+')) AND regexp_full_match(a || b, '[a-zA-Z0-9_\\-]*') GROUP BY 1, 2) SELECT DISTINCT item_id, ref_id FROM k",
    "reference_map": f"SELECT id, '- [ref:' || {_SHORT} || '] ' || CASE WHEN length(summary) > 100 THEN left(summary, 100) || '...' ELSE summary END AS line FROM memory_items",
    "last_user_message": "SELECT conv_id, arg_max(content, turn) AS query FROM conv1 WHERE lower(trim(role)) = 'user' AND length(trim(content)) > 0 GROUP BY 1",
    "inject_context": """WITH t AS (SELECT DISTINCT conv_id, turn, role, content FROM conv1), s AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'system') > 0 AS sys, arg_min(role, turn) AS r, arg_min(content, turn) AS c FROM t GROUP BY 1),
      b AS (SELECT '<memory_context>' || chr(10) || '- likes tea' || chr(10) || '- has a dog' || chr(10) || '</memory_context>' AS b)
      SELECT conv_id, n + CASE WHEN sys THEN 0 ELSE 1 END AS n, CASE WHEN sys THEN r ELSE 'system' END AS first_role, CASE WHEN NOT sys THEN b WHEN r = 'system' THEN c || chr(10) || chr(10) || b ELSE c END AS first_content FROM s, b""",
    "json_blob": r"SELECT id, nullif(regexp_extract('answer: ' || extra || ' - done', '(?s)\{.*\}'), '') AS blob FROM memory_items",
    "tag_content": f"SELECT id, nullif({_trim("coalesce(memory_type, '')")}, '') AS caption FROM memory_items",
    "decision_parse": "SELECT id, CASE WHEN memory_type IN ('event', 'tool') THEN 'NO_RETRIEVE' ELSE 'RETRIEVE' END AS decision, 'MORE' AS judgement FROM memory_items",
    "filename_from_url": r"""SELECT id, CASE WHEN modality = 'audio' THEN 'audio_' || user_id || '.mp3' ELSE (CASE WHEN regexp_extract(url, '([^/]*)$', 1) LIKE '%.%' THEN regexp_extract(url, '([^/]*)$', 1) ELSE 'resource.' || CASE modality WHEN 'video' THEN 'mp4' WHEN 'image' THEN 'jpg' WHEN 'document' THEN 'txt' ELSE 'bin' END END) END AS file_name FROM resources""",
    "segment_url": r"SELECT id, CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^.+\.[^.]+$') THEN regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]+$', 1) || '_#segment_2' || regexp_extract(url, '(\.[^.]+)$', 1) ELSE regexp_extract(url, '([^/]*)$', 1) || '_#segment_2' END AS url FROM resources",
    "patch_parse": "SELECT id, coalesce(memory_type IN ('event', 'tool'), false) AS need_update, CASE WHEN memory_type = 'event' THEN 'new' ELSE '' END AS content FROM memory_items",
    "tool_stats": f"SELECT event_type AS tool_name, count(*) AS total_calls, count(*) AS recent_calls_analyzed, round(a, 6) AS avg_time_cost, round(s, 6) AS success_rate, round(c, 6) AS avg_score, round(t, 6) AS avg_token_cost FROM events JOIN (SELECT event_type AS e, {_STATS} FROM events GROUP BY 1) ON e = event_type GROUP BY event_type, a, s, c, t",
    "tool_stats_recent_n": f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), g AS (SELECT user_id, any_value(n) AS n, count(*) AS m, {_STATS} FROM r WHERE r <= 20 GROUP BY 1) SELECT user_id, n AS total_calls, m AS recent_calls_analyzed, round(a, 6) AS avg_time_cost, round(s, 6) AS success_rate, round(c, 6) AS avg_score, round(t, 6) AS avg_token_cost FROM g",
    "tool_call_hash": "SELECT event_id, md5(event_type || '|' || props || '|' || user_id) AS call_hash FROM events",
    "llm_call_stats": "SELECT event_type AS operation, count(*) AS n_calls, count(*) FILTER (value > 100) AS n_errors, sum(length(props))::BIGINT AS chars, round(avg(value), 6) AS avg_seconds FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1",
    "stream_count_trigger": "SELECT conv_id, count(*)::BIGINT AS n_messages, max(turn) AS last_turn FROM conv1 WHERE role IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "stream_window_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "segment_slice": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, array_to_string(l[least(2, len(l) - 1) + 1:least(5, len(l) - 1) + 1], chr(10)) AS t FROM l) SELECT doc_id, CASE WHEN length("
    + _trim("t")
    + ") > 0 THEN md5(t) END AS digest FROM p",
    "format_scores": f"WITH {_Q} SELECT id, 'item: ' || coalesce(summary, '') || chr(10) || 'Score: ' || printf('%.3f', score) AS line FROM {_top('memory_items', 5)}",
    "category_summary_prompt": f"""SELECT c.id AS category_id, u.part, {len(prompts.CATEGORY_SUMMARY.format(target_length=400))} + length(chr(10) || chr(10) || 'Category: ' || name || chr(10) || chr(10) || 'Summary so far:' || chr(10) || coalesce(c.summary, '') || chr(10) || chr(10) || 'New items:' || chr(10)) + u.n AS chars
      FROM memory_categories c JOIN (SELECT category_id, {_PART} AS part, coalesce(sum(2 + length(summary)), 0)::BIGINT + greatest(count(summary) - 1, 0) AS n FROM (SELECT DISTINCT category_id, item_id FROM category_items) l JOIN memory_items i ON i.id = l.item_id JOIN {_PARTS} USING (category_id) GROUP BY 1, 2) u ON u.category_id = c.id""",
    "conversation_format": "WITH t AS (SELECT DISTINCT conv_id, turn, role, content FROM conv1), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, regexp_replace(coalesce(content, ''), '"
    + r"\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
    + "', ' ', 'g') AS c FROM t) SELECT conv_id, count(*) AS n, md5(string_agg('[' || i || '] [' || coalesce(nullif("
    + _trim("role")
    + ", ''), 'user') || ']: ' || "
    + _trim("c")
    + ", chr(10) ORDER BY i)) AS digest FROM n GROUP BY 1",
}
