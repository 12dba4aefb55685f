"""Further queries of the engine's own operators: texts and answers, media, merged patches, pipelines - with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import extraction, text
from memloom.models import client
from memloom.operators import filters, links, mutations, ranking, tools
from memloom.operators.store import MemoryStore
from memloom.plans import prompts
from memloom.plans.catalogue import _CITED, _HASH, _PART, _PARTS, _Q, _REFS, _SHORT, _WS, _cited, _event_log, _items, _query, _rounded, _scored, _top, _trim, _usable
from memloom.plans.service import MemoryService, Settings
from memloom.session import load, scratch_path
from memloom.sources import files

# texts and answers


def _said(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).select("id", "memory_type", F.coalesce(F.nullif(text.strip(F.col("summary")), F.lit("")), F.lit("nothing")).alias("said"))


def _conversations(s: SparkSession, d: str) -> DataFrame:
    turns = load(s, d, "conv1").select("conv_id", "turn", "role", "content").distinct()
    return turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit("").alias("created_at"))).alias("m"))


def text_hash(s, d):  # noqa: ANN001, ANN201
    return _items(s, d).select("id", text.text_hash(F.col("summary")).alias("one"), text.texts_hash(F.array(F.coalesce("summary", F.lit("")), F.coalesce("memory_type", F.lit("")))).alias("several"))


def numbered_lines(s, d):  # noqa: ANN001, ANN201
    return load(s, d, "memory_categories").select("id", F.md5(text.numbered_lines(F.col("summary"))).alias("digest"))


def lines_between(s, d):  # noqa: ANN001, ANN201
    return _conversations(s, d).select("conv_id", F.md5(text.lines_between(text.conversation_lines(F.col("m")), F.lit(2), F.lit(4))).alias("digest"))


def query_history(s, d):  # noqa: ANN001, ANN201
    """What was said before the last message of every conversation, as the context of a query."""
    return _conversations(s, d).select("conv_id", F.md5(text.history(F.slice("m", 1, F.greatest(F.size("m") - 1, F.lit(0))))).alias("digest"))


def escape_braces(s, d):  # noqa: ANN001, ANN201
    return _items(s, d).select("id", text.escape_braces(F.col("extra")).alias("escaped"))


def rewritten_query(s, d):  # noqa: ANN001, ANN201
    raw = F.when(F.col("memory_type") == "event", F.concat(F.lit("so <rewritten_query> "), "summary", F.lit(" </rewritten_query>"))).otherwise(F.col("summary"))
    return _items(s, d).select("id", text.rewritten_query(raw, F.lit("asked")).alias("query"))


def multimodal_parse(s, d):  # noqa: ANN001, ANN201
    raw = F.when(F.col("memory_type") == "event", F.concat(F.lit("<Detailed_Description> "), "said", F.lit("</detailed_description><caption> seen </caption>"))).otherwise(F.col("said"))
    return _said(s, d).withColumn("m", text.multimodal(raw, "detailed_description")).select("id", "m.content", "m.caption")


def segments_parse(s, d):  # noqa: ANN001, ANN201
    raw = F.when(F.col("memory_type") == "event", '{"segments": [{"start": 0, "end": "3"}, {"start": "x", "end": 1}]}').when(F.col("memory_type") == "skill", 'as asked: {"segments": [{"start": 2, "end": 5}]} done').otherwise("none")
    return _items(s, d).withColumn("found", text.segments(raw)).select("id", F.coalesce(F.size("found"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.col("found")[0]["end"], F.lit(-1)).cast("bigint").alias("first_end"))


def xml_memory_parse(s, d):  # noqa: ANN001, ANN201
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^ -~]|[<>]", " ")
    raw = F.concat(F.lit("note <item><memory><content>"), plain("summary"), F.lit("</content><categories><category>"), plain("memory_type"), F.lit("</category><category>x & y</category></categories></memory><memory><content>alone</content></memory></item>"))
    found = _items(s, d).select("id", F.explode(extraction.entries_of_xml(raw)).alias("e"))
    return found.select("id", "e.content", F.array_join("e.categories", "|").alias("categories"))


def json_memory_parse(s, d):  # noqa: ANN001, ANN201
    raw = F.concat(F.lit("answer: "), F.to_json(F.struct(F.array(F.struct(F.col("summary").alias("content"), F.array("memory_type", F.lit(" ")).alias("categories"))).alias("memories_items"))), F.lit(" end"))
    return _items(s, d).select("id", F.explode(text.entries_of_json(raw)).alias("e")).select("id", "e.content", F.array_join("e.categories", "|").alias("categories"))


def format_items(s, d):  # noqa: ANN001, ANN201
    """The three best items of every user as one text."""
    best = ranking.top_k_per(ranking.scored(_usable(_items(s, d)), _query(s, d)), 3, ["user_id"])
    return links.joined_lines(best.withColumn("line", text.scored_line("item", F.col("summary"))), ["user_id"], "line", ["rank"], "\n\n")


def hit_excerpts(s, d):  # noqa: ANN001, ANN201
    return ranking.cosine_top_k(_usable(_items(s, d)), _query(s, d), 3).select("id", text.excerpt(F.col("summary")).alias("line"))


def reference_map_text(s, d):  # noqa: ANN001, ANN201
    """The three best items of every user as a list of what may be cited."""
    best = ranking.top_k_per(ranking.scored(_usable(_items(s, d)), _query(s, d)), 3, ["user_id"])
    listed = best.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", text.short_reference(F.col("id")).alias("id"), "summary"))).alias("items"))
    return listed.select("user_id", text.reference_map(F.col("items")).alias("text"))


def cited_items(s, d):  # noqa: ANN001, ANN201
    said = F.concat(F.lit("see [ref:none,"), "id", F.lit("] and [ref:"), "id", F.lit("]"))
    return links.cited_items(_items(s, d).select("id", said.alias("summary")), _items(s, d)).select("cited_by", F.col("pos").cast("bigint").alias("pos"), "item_id", "memory_type")


def cited_ids(s, d):  # noqa: ANN001, ANN201
    return links.cited_ids(_cited(s, d), "said")


def vector_json(s, d):  # noqa: ANN001, ANN201
    rows = _usable(_items(s, d)).filter(~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    v = text.vector_of_json(F.to_json("embedding"))
    return rows.select("id", F.size(v).cast("bigint").alias("n"), F.array_max(v).cast("float").cast("double").alias("most"), F.element_at(v, -1).cast("float").cast("double").alias("last"))


def items_by_hash(s, d):  # noqa: ANN001, ANN201
    rows = _items(s, d).withColumn("extra", F.to_json(F.struct(text.content_hash(F.col("summary"), F.col("memory_type")).alias("content_hash"))))
    one = rows.filter("summary IS NOT NULL").orderBy("id").select(F.get_json_object("extra", "$.content_hash")).first()[0]
    return filters.with_hash(rows, one).select("id", "user_id")


# calls and media


def call_usage(s, d):  # noqa: ANN001, ANN201
    k = F.get_json_object("props", "$.k").cast("int")
    chat = F.format_string('{"usage": {"prompt_tokens": %d, "completion_tokens": %d, "total_tokens": %d}, "choices": [{"finish_reason": "%s"}]}', F.col("user_id").cast("int"), k, F.col("user_id").cast("int") + k, F.col("event_type"))
    embed = F.format_string('{"usage": {"total_tokens": %d}}', k)
    rows = load(s, d, "events").select("event_id", text.usage(chat).alias("c"), text.usage(embed, "embed").alias("e"))
    return rows.select("event_id", "c.input_tokens", "c.output_tokens", "c.total_tokens", "c.finish_reason", F.col("e.input_tokens").alias("embed_tokens"))


def tool_calls_nested(s, d):  # noqa: ANN001, ANN201
    """Statistics over the last two calls kept with an item, after one is appended."""

    def call(plus: float) -> F.Column:
        given = {"tool_name": F.col("event_type"), "input": F.lit("x=1"), "output": F.col("user_id").cast("string"), "success": F.col("value") < 50, "time_cost": F.col("value") + plus, "score": F.col("value") / 10, "token_cost": F.get_json_object("props", "$.k").cast("int") - 10, "call_hash": F.lit("")}
        return F.struct(*[v.alias(n) for n, v in given.items()]).cast(tools.CALL)

    rows = load(s, d, "events").select("event_id", tools.append_call(F.lit("tool"), F.array(call(0.0), call(1.0)), call(2.0)).alias("calls"))
    out = rows.select("event_id", F.element_at("calls", -1)["call_hash"].alias("call_hash"), tools.statistics_of(F.col("calls"), 2).alias("s"))
    return out.select("event_id", "call_hash", "s.*")


def chat_stub(s, d):  # noqa: ANN001, ANN201
    return _items(s, d).select("id", client.stub_factory().chat(F.col("summary")).alias("answer"))


def embed_stub(s, d):  # noqa: ANN001, ANN201
    out = _items(s, d).select("id", client.stub_factory().embed(F.col("summary")).alias("v"))
    return out.select("id", F.when(F.col("v").isNull(), 0).otherwise(F.size("v")).cast("bigint").alias("dimensions"))


def media_stub(s, d):  # noqa: ANN001, ANN201
    models = client.stub_factory()
    rows = load(s, d, "resources").withColumn("content", F.encode("url", "UTF-8"))
    seen = text.multimodal(models.media(F.col("content"), F.col("url"), "vision", "look"), "detailed_description")
    return rows.select("id", seen["content"].alias("seen"), models.media(F.col("content"), F.col("url"), "transcribe").alias("heard"))


def audio_texts(s, d):  # noqa: ANN001, ANN201
    rows = load(s, d, "resources").select("id", "url", F.encode("url", "UTF-8").alias("content"), F.when(F.col("user_id") == "u001", F.col("caption")).alias("raw_text"))
    return files.audio_texts(rows, lambda c, n: client.stub_factory().media(c, n, "transcribe")).select("id", "text")


def fetched_texts(s, d):  # noqa: ANN001, ANN201
    def fetch(url: str) -> bytes:
        if url.startswith("/"):
            raise OSError("not remote")
        return url.upper().encode()

    got = files.fetched(load(s, d, "resources"), fetch).withColumn("modality", F.lit("document"))
    return files.as_text(got).select("url", "raw_text", "error")


def _exported(s: SparkSession, d: str) -> str:
    path = scratch_path(s, "markdown")
    files.export_markdown(load(s, d, "memory_categories").repartition("name"), path)
    return path


def markdown_files(s, d):  # noqa: ANN001, ANN201
    """Categories written as Markdown, one folder a name, and their lines read back."""
    back = s.read.text(_exported(s, d))
    return back.groupBy(F.col("name").cast("string").alias("name")).agg(F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars"))


def local_texts(s, d):  # noqa: ANN001, ANN201
    """The same files, each read whole as a resource."""
    got = files.local_resources(s, f"{_exported(s, d)}/*/*.txt", "document")
    return got.select(F.regexp_extract("url", "name=([^/]*)/", 1).alias("name"), F.length("raw_text").cast("bigint").alias("n_chars"))


# state


def partial_update_merge(s, d):  # noqa: ANN001, ANN201
    """Records from a log of puts, patches and deletions whose JSON column is merged key by key."""
    log = _event_log(s, d).drop("value", "k")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    extra = load(s, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit('{"'), "event_type", F.lit('": '), cents, F.lit(', "k": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("extra"))
    return mutations.state_of(log.join(extra, "seq"), merged=("extra",))


def reinforce_incremental(s, d):  # noqa: ANN001, ANN201
    """A state and the rows that came later, folded together."""
    rows = _items(s, d).filter("summary IS NOT NULL AND memory_type IS NOT NULL").select("id", "created_at", "summary", "memory_type", "user_id")
    early = F.col("created_at") < F.lit("2025-03-01").cast("timestamp")
    state = mutations.reinforced(rows.filter(early), ["user_id"], ["created_at", "id"])
    out = mutations.reinforce_into(state, rows.filter(~early), ["user_id"], ["created_at", "id"])
    return out.select("id", F.col("reinforcement_count").cast("bigint").alias("reinforcement_count"), F.unix_micros("last_reinforced_at").alias("last_us"))


def unlink(s, d):  # noqa: ANN001, ANN201
    rows = load(s, d, "category_items")
    return mutations.unlinked(rows, rows.filter("user_id = 'u001'")).select("id").distinct()


# pipelines


def _service(s: SparkSession, d: str, answers: dict[str, str] | None = None, **settings) -> MemoryService:  # noqa: ANN003
    """A service over a store that holds the tables."""
    store = MemoryStore(s, scratch_path(s, "store"))
    for entity in ("resources", "memory_items", "memory_categories"):
        store.append(entity, load(s, d, entity).select(*store.table(entity).columns))
    store.append("category_items", load(s, d, "category_items").filter("item_id IS NOT NULL AND category_id IS NOT NULL").select(*store.table("category_items").columns))
    return MemoryService(store, client.stub_factory(64, answers), Settings(route_intention=False, sufficiency_check=False, **settings))


def list_scoped(s, d):  # noqa: ANN001, ANN201
    service = _service(s, d)
    parts = [service.run(f"list_{e}", where={"user_id": "u001"}).select("id", F.lit(e).alias("entity"), "summary") for e in ("memory_items", "memory_categories")]
    return parts[0].unionByName(parts[1])


def clear_memory(s, d):  # noqa: ANN001, ANN201
    """What a clear of one scope gives back, and what it leaves."""
    service = _service(s, d)
    gone = service.run("clear_memory", where={"user_id": "u001"})
    one = lambda df, side, e: df.groupBy().agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), F.lit(e).alias("entity"), "n")
    counts = [one(df, side, e) for e in ("resources", "memory_items", "memory_categories") for side, df in (("gone", gone[e]), ("left", service.store.table(e)))]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def retrieve_rag(s, d):  # noqa: ANN001, ANN201
    """The staged retrieval of one scope by vectors."""
    found = _service(s, d).retrieve([{"role": "user", "content": "anything"}], {"user_id": "u001"}, _query(s, d))
    parts = [_rounded(found[k], "rank").withColumn("tier", F.lit(k)) for k in ("items", "resources")]
    return parts[0].unionByName(parts[1])


def retrieve_llm(s, d):  # noqa: ANN001, ANN201
    """The staged retrieval of one scope in a model's order; the stub names three categories and the items they lead to."""
    first = lambda df, n: [r.id for r in df.select("id").distinct().orderBy("id").limit(n).collect()]
    mine = load(s, d, "memory_categories").filter("user_id = 'u001'")
    categories = first(mine, 3)
    linked = links.items_of_categories(load(s, d, "category_items"), mine.filter(F.col("id").isin(categories)), _items(s, d).filter("user_id = 'u001'"))
    items = first(linked, 40)
    resources = first(links.resources_of_items(_items(s, d).filter(F.col("id").isin(items)), load(s, d, "resources").filter("user_id = 'u001'")), 40)
    answers = {f"under the key {k}": json.dumps({k: ids}) for k, ids in (("categories", categories[::-1]), ("items", items[::-1]), ("resources", [*resources[::-1], "no such"]))}
    found = _service(s, d, answers, method="llm", item_k=40, resource_k=40).retrieve([{"role": "user", "content": "anything"}], {"user_id": "u001"})
    parts = [found[k].select("id", F.col("rank").cast("bigint").alias("rank"), F.lit(k).alias("tier")) for k in ("categories", "items", "resources")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def patch_items(s, d):  # noqa: ANN001, ANN201
    """Items of one user changed, those of another deleted: what that means to their categories, and which summaries are written anew."""
    service = _service(s, d, {"need_update": '{"need_update": true, "updated_content": "anew"}'})
    changed = service.update_items(_items(s, d).filter("user_id = 'u001'").select("id", F.lit("changed").alias("summary")))
    deleted = service.delete_items(_items(s, d).filter("user_id = 'u002'").select("id"), propagate=False)
    rows = changed.select("item_id", "category_id", "change").unionByName(deleted.select("item_id", "category_id", "change"))
    anew = service.store.table("memory_categories").filter("summary = 'anew'").select(F.lit(None).cast("string").alias("item_id"), F.col("id").alias("category_id"), F.lit("anew").alias("change"))
    return rows.unionByName(anew)


def category_summary_fold(s, d):  # noqa: ANN001, ANN201
    """Every category's summary after all its items, by a stub that answers with a hash of what it is asked."""
    updates = links.category_updates(load(s, d, "category_items"), _items(s, d))
    return _service(s, d)._summaries(updates)


QUERIES = {
    f.__name__: f
    for f in (
        text_hash, numbered_lines, lines_between, query_history, escape_braces, rewritten_query, multimodal_parse, segments_parse, xml_memory_parse, json_memory_parse, format_items, hit_excerpts, reference_map_text,
        cited_items, cited_ids, vector_json, items_by_hash, call_usage, tool_calls_nested, chat_stub, embed_stub, media_stub, audio_texts, fetched_texts, markdown_files, local_texts, partial_update_merge,
        reinforce_incremental, unlink, list_scoped, clear_memory, retrieve_rag, retrieve_llm, patch_items, category_summary_fold,
    )
}

_LINES = r"""t AS (SELECT DISTINCT conv_id, turn, role, content FROM conv1), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS k,
  regexp_replace(coalesce(content, ''), '\r\n|[\n\x0B\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]', ' ', 'g') AS c FROM t)"""
_SAID = f"(SELECT id, memory_type, coalesce(nullif({_trim('summary')}, ''), 'nothing') AS said FROM memory_items)"
_K = "json_extract_string(props, '$.k')::INT"
_BEST = f"(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, id) AS rank FROM {_scored('memory_items')} QUALIFY rank <= 3)"
_BYTES = "strlen(url)"
_EXT = r"lower(regexp_extract(url, '\.([^./]+)$', 1))"
_MD = "regexp_replace(name, '[^A-Za-z0-9_\\-]+', '_', 'g') AS name, regexp_replace(coalesce(summary, ''), '</?content>', '', 'g') AS t"
_OWN = "CASE WHEN memory_type = 'tool' THEN id END"
_C3 = "(SELECT id FROM memory_categories WHERE user_id = 'u001' ORDER BY id LIMIT 3)"
_PROMPT = f"""'{prompts.CATEGORY_SUMMARY.format(target_length=400).replace("'", "''")}' || chr(10) || chr(10) || 'Category: ' || name || chr(10) || chr(10) || 'Summary so far:' || chr(10) || coalesce(c.summary, '') || chr(10) || chr(10) || 'New items:' || chr(10) || u.lines"""
SQL = {
    "text_hash": "SELECT id, CASE WHEN length(summary) > 0 THEN sha256(summary) END AS one, sha256(coalesce(summary, '') || chr(0) || coalesce(memory_type, '') || chr(0)) AS several FROM memory_items",
    "numbered_lines": f"WITH l AS (SELECT id, string_split(summary, chr(10)) AS l FROM memory_categories), b AS (SELECT id, l, list_transform(l, lambda x: length(regexp_replace(x, '{_WS}', '', 'g')) > 0) AS b FROM l) SELECT id, md5(array_to_string(list_transform(l, lambda x, i: CASE WHEN b[i] THEN '[' || len(list_filter(b[1:i - 1], lambda y: y)) || '] ' || x ELSE x END), chr(10))) AS digest FROM b",
    "lines_between": f"WITH {_LINES} SELECT conv_id, md5(string_agg('[' || i || '] [' || coalesce(nullif({_trim('role')}, ''), 'user') || ']: ' || {_trim('c')}, chr(10) ORDER BY i) FILTER (i BETWEEN 2 AND 4)) AS digest FROM n GROUP BY 1",
    "query_history": f"WITH {_LINES} SELECT conv_id, md5(coalesce(string_agg('- [' || coalesce(role, 'user') || ']: ' || {_trim('c')}, chr(10) ORDER BY i) FILTER (i < k - 1), 'No query context.')) AS digest FROM n GROUP BY 1",
    "escape_braces": "SELECT id, replace(replace(extra, '{', '{{'), '}', '}}') AS escaped FROM memory_items",
    "rewritten_query": f"SELECT id, CASE WHEN memory_type = 'event' THEN coalesce(nullif({_trim('summary')}, ''), 'asked') ELSE 'asked' END AS query FROM memory_items",
    "multimodal_parse": f"SELECT id, said AS content, CASE WHEN memory_type = 'event' THEN 'seen' ELSE nullif(substring({_trim('''split_part(said, '.', 1)''')}, 1, 200), '') END AS caption FROM {_SAID}",
    "segments_parse": "SELECT id, CASE WHEN memory_type IN ('event', 'skill') THEN 1 ELSE 0 END::BIGINT AS n, CASE memory_type WHEN 'event' THEN 3 WHEN 'skill' THEN 5 ELSE -1 END::BIGINT AS first_end FROM memory_items",
    "xml_memory_parse": "WITH p AS (SELECT id, trim(regexp_replace(coalesce(summary, ''), '[^ -~]|[<>]', ' ', 'g')) AS content, trim(regexp_replace(coalesce(memory_type, ''), '[^ -~]|[<>]', ' ', 'g')) AS kind FROM memory_items) SELECT id, content, CASE WHEN kind = '' THEN '' ELSE kind || '|' END || 'x & y' AS categories FROM p WHERE content != ''",
    "json_memory_parse": f"SELECT id, {_trim('summary')} AS content, coalesce({_trim('memory_type')}, '') AS categories FROM memory_items WHERE length({_trim('summary')}) > 0",
    "format_items": f"WITH {_Q} SELECT user_id, string_agg('item: ' || coalesce(summary, ''), chr(10) || chr(10) ORDER BY rank) AS text FROM {_BEST} GROUP BY 1",
    "hit_excerpts": f"WITH {_Q} SELECT id, left(summary, 100) || '...' AS line FROM {_top('memory_items', 3)}",
    "reference_map_text": f"WITH {_Q} SELECT user_id, 'Items that may be cited:' || chr(10) || string_agg('- [ref:' || {_SHORT} || '] ' || CASE WHEN length(summary) > 100 THEN left(summary, 100) || '...' ELSE summary END, chr(10) ORDER BY rank) AS text FROM {_BEST} GROUP BY 1",
    "cited_items": "SELECT id AS cited_by, 1::BIGINT AS pos, id AS item_id, memory_type FROM memory_items",
    "cited_ids": f"WITH {_CITED} SELECT DISTINCT trim(r) AS ref_id FROM (SELECT unnest(flatten(list_transform({_REFS}, lambda m: string_split(m, ',')))) AS r FROM c) WHERE trim(r) != ''",
    "vector_json": "SELECT id, 64::BIGINT AS n, list_max(embedding)::DOUBLE AS most, embedding[64]::DOUBLE AS last FROM memory_items WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0",
    "items_by_hash": f"SELECT id, user_id FROM memory_items WHERE {_HASH} = (SELECT {_HASH} FROM memory_items WHERE summary IS NOT NULL ORDER BY id LIMIT 1)",
    "call_usage": f"SELECT event_id, user_id::BIGINT AS input_tokens, {_K}::BIGINT AS output_tokens, (user_id + {_K})::BIGINT AS total_tokens, event_type AS finish_reason, {_K}::BIGINT AS embed_tokens FROM events",
    "tool_calls_nested": f"SELECT event_id, md5(event_type || '|x=1|' || user_id) AS call_hash, 3::BIGINT AS total_calls, 2::BIGINT AS recent_calls_analyzed, round(value + 1.5, 3) AS avg_time_cost, CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END::DOUBLE AS success_rate, round(value / 10, 3) AS avg_score, greatest({_K} - 10, 0)::DOUBLE AS avg_token_cost FROM events",
    "chat_stub": "SELECT id, 'stub:' || substring(sha256(summary), 1, 16) AS answer FROM memory_items",
    "embed_stub": f"SELECT id, CASE WHEN length({_trim('summary')}) > 0 THEN 16 ELSE 0 END::BIGINT AS dimensions FROM memory_items",
    "media_stub": f"SELECT id, CASE {_EXT} WHEN 'png' THEN 'image/png' WHEN 'gif' THEN 'image/gif' WHEN 'webp' THEN 'image/webp' ELSE 'image/jpeg' END || ' of ' || {_BYTES} || ' bytes' AS seen, 'transcript of ' || url || ', ' || {_BYTES} || ' bytes' AS heard FROM resources",
    "audio_texts": f"SELECT id, coalesce(nullif(trim(CASE WHEN user_id = 'u001' THEN caption END), ''), CASE WHEN {_EXT} IN ('mp3', 'mp4', 'mpeg', 'mpga', 'm4a', 'wav', 'webm') THEN 'transcript of ' || url || ', ' || {_BYTES} || ' bytes' WHEN {_EXT} IN ('txt', 'text') THEN url END) AS text FROM resources",
    "fetched_texts": "SELECT url, CASE WHEN url NOT LIKE '/%' THEN upper(url) END AS raw_text, CASE WHEN url LIKE '/%' THEN 'not remote' END AS error FROM resources",
    "markdown_files": f"SELECT name, sum(len(string_split(t, chr(10))))::BIGINT AS n_lines, sum(length(replace(t, chr(10), '')))::BIGINT AS n_chars FROM (SELECT {_MD} FROM memory_categories) GROUP BY 1",
    "local_texts": f"SELECT name, sum(length(t) + 1)::BIGINT AS n_chars FROM (SELECT {_MD} FROM memory_categories) GROUP BY 1",
    "partial_update_merge": f"""WITH l AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'put' WHEN 'error' THEN 'delete' ELSE 'patch' END AS op, event_type, round(value * 100)::BIGINT AS cents, {_K} AS k FROM events),
      b AS (SELECT id, max(seq) AS start, arg_max(op, seq) AS last FROM l WHERE op != 'patch' GROUP BY 1), m AS (SELECT l.* FROM l JOIN b USING (id) WHERE last = 'put' AND seq >= start),
      v AS (SELECT id, seq, event_type AS key, cents AS v FROM m UNION ALL SELECT id, seq, 'k', k FROM m), w AS (SELECT id, key, arg_max(v, seq) AS v FROM v GROUP BY 1, 2)
      SELECT id, '{{' || string_agg('"' || key || '": ' || v, ', ' ORDER BY key) || '}}' AS extra FROM w GROUP BY 1""",
    "reinforce_incremental": f"SELECT arg_min(id, (created_at, id)) AS id, count(*) AS reinforcement_count, epoch_us(max(created_at)) AS last_us FROM memory_items WHERE summary IS NOT NULL AND memory_type IS NOT NULL GROUP BY user_id, {_HASH}, {_OWN}",
    "unlink": "SELECT DISTINCT id FROM category_items a WHERE NOT EXISTS (SELECT 1 FROM category_items b WHERE b.user_id = 'u001' AND b.item_id = a.item_id AND b.category_id = a.category_id)",
    "list_scoped": "SELECT id, 'memory_items' AS entity, summary FROM memory_items WHERE user_id = 'u001' UNION ALL SELECT id, 'memory_categories', summary FROM memory_categories WHERE user_id = 'u001'",
    "clear_memory": " UNION ALL ".join(f"SELECT CASE WHEN coalesce(user_id = 'u001', false) THEN 'gone' ELSE 'left' END AS side, '{e}' AS entity, count(*) AS n FROM {e} GROUP BY 1" for e in ("resources", "memory_items", "memory_categories")),
    "retrieve_rag": f"""WITH {_Q} SELECT id, round(score, 6) + 0.0 AS score, rank, 'items' AS tier FROM {_top("memory_items", 5, "user_id = 'u001'")} UNION ALL SELECT id, round(score, 6) + 0.0, rank, 'resources' FROM {_top("resources", 5, "user_id = 'u001'")}""",
    "retrieve_llm": f"""WITH c AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS rank FROM {_C3}), i AS (SELECT DISTINCT id, resource_id FROM memory_items WHERE user_id = 'u001' AND id IN (SELECT item_id FROM category_items WHERE category_id IN (SELECT id FROM c)) ORDER BY id LIMIT 40),
      r AS (SELECT id FROM resources WHERE user_id = 'u001' AND id IN (SELECT resource_id FROM i) ORDER BY id LIMIT 40)
      SELECT id, rank, 'categories' AS tier FROM c UNION ALL SELECT id, row_number() OVER (ORDER BY id DESC), 'items' FROM i UNION ALL SELECT id, row_number() OVER (ORDER BY id DESC), 'resources' FROM r""",
    "patch_items": """WITH k AS (SELECT DISTINCT item_id, category_id, i.user_id FROM category_items l JOIN memory_items i ON i.id = l.item_id WHERE category_id IS NOT NULL AND i.user_id IN ('u001', 'u002') AND (i.user_id = 'u002' OR summary IS DISTINCT FROM 'changed'))
      SELECT item_id, category_id, CASE user_id WHEN 'u001' THEN 'keep' ELSE 'unlink' END AS change FROM k UNION ALL SELECT NULL, id, 'anew' FROM memory_categories WHERE id IN (SELECT category_id FROM k WHERE user_id = 'u001')""",
    "category_summary_fold": f"""SELECT c.id AS category_id, 'stub:' || substring(sha256({_PROMPT}), 1, 16) AS summary FROM memory_categories c JOIN (SELECT category_id, {_PART} AS part, coalesce(string_agg('- ' || summary, chr(10) ORDER BY created_at, item_id), '') AS lines
      FROM (SELECT DISTINCT category_id, item_id FROM category_items) l JOIN (SELECT id AS item_id, created_at, summary FROM memory_items) i USING (item_id) JOIN {_PARTS} USING (category_id) GROUP BY 1, 2) u ON u.category_id = c.id""",
}
