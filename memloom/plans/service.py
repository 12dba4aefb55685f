"""The service: memorise resources, retrieve memories, change single items - as pipelines over lazy tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, islice
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import extraction, text
from memloom.models.client import ClientFactory
from memloom.operators import filters, links, mutations, ranking
from memloom.operators.schema import MEMORY_TYPES
from memloom.operators.store import MemoryStore
from memloom.plans import prompts
from memloom.plans.pipeline import Context, Pipelines, Runners, Stage, StageHooks, stage
from memloom.session import cut
from memloom.sources import files, frames

#: Lines of a pool that one prompt shows to the model.
PROMPT_LINES = 1_000


@dataclass
class Settings:
    """What changes the meaning of queries."""

    method: str = "rag"
    route_intention: bool = True
    sufficiency_check: bool = True
    category_enabled: bool = True
    item_enabled: bool = True
    resource_enabled: bool = True
    category_k: int = 5
    item_k: int = 5
    resource_k: int = 5
    ranking: str = "similarity"
    recency_decay_days: float = 30.0
    use_category_references: bool = False
    memory_types: tuple[str, ...] = ("profile", "event")
    categories: tuple[tuple[str, str], ...] = (("preferences", "What the user likes and dislikes"), ("events", "What happened"), ("people", "Who the user knows"))
    reinforce: bool = False
    item_references: bool = False
    summary_length: int = 400
    custom_prompts: Mapping[str, str] = field(default_factory=dict)


def with_extra(items: DataFrame) -> DataFrame:
    """Items with the counts their extra JSON keeps."""
    get = lambda p: F.get_json_object("extra", p)
    return items.withColumns({"reinforcement_count": F.coalesce(get("$.reinforcement_count").try_cast("int"), F.lit(1)), "last_reinforced_at": F.try_to_timestamp(get("$.last_reinforced_at"))})


class MemoryService:
    def __init__(self, store: MemoryStore, models: ClientFactory, settings: Settings | None = None, runner: str = "local") -> None:
        self.store, self.models, self.settings = store, models, settings or Settings()
        self.scope = store.scope.fieldNames()
        self.hooks, self.runners, self.runner = StageHooks(), Runners(), runner
        self.pipelines = Pipelines(frozenset({"llm", "vector", "db", "io"}), frozenset(models.profiles))
        self._register()

    # pipelines

    def _register(self) -> None:
        s, put = stage, self.pipelines.register
        put("memorize", [
            s("ingest_resource", self._ingest, "resources", "ingested", "io"), s("preprocess_multimodal", self._preprocess, "ingested", "texts", "llm"),
            s("extract_items", self._extract, "texts", "entries", "llm"), s("dedupe_merge", lambda st, _: {}, "entries", "entries"),
            s("categorize_items", self._categorize, "entries texts", "items relations", "db vector"), s("persist_index", self._persist, "items relations", "updates", "db llm"),
            s("build_response", lambda st, _: {"response": {k: filters.without_embedding(st[k]) for k in ("new_resources", "items", "relations")}}, "items", "response"),
        ], "resources user")
        tiers = [
            s("route_category", self._route_category, "query where", "categories", "db vector"), s("sufficiency_after_category", self._enough_after("categories"), "categories", "proceed", "llm"),
            s("recall_items", self._recall_items, "query where proceed", "items", "db vector"), s("sufficiency_after_items", self._enough_after("items"), "items", "proceed", "llm"),
            s("recall_resources", self._recall_resources, "query where proceed", "resources", "db vector"), s("build_context", self._context, "categories items resources", "response"),
        ]
        given = "query history where original vector"
        put("retrieve_rag", [s("route_intention", self._gate, "query history", "needs_retrieval query", "llm"), *tiers], given)
        by_model = {"route_category": self._model_categories, "recall_items": self._model_items, "recall_resources": self._model_resources}
        put("retrieve_llm", [s("route_intention", self._gate, "query history", "needs_retrieval query", "llm"), *[Stage(t.name, by_model.get(t.name, t.handler), t.requires, t.produces, t.capabilities) for t in tiers]], given)
        for kind in ("create", "update", "delete"):
            put(f"patch_{kind}", [s(f"{kind}_item", getattr(self, f"_{kind}"), "items", "changes", "db"), s("persist_index", self._patch, "changes", "patched", "llm db"), s("build_response", lambda st, _: {"response": st["changes"]}, "changes", "response")], "items categories propagate")
        put("list_memory_items", [s("list", lambda st, _: {"response": filters.without_embedding(self.store.table("memory_items", st["where"]))}, "where", "response", "db")], "where")
        put("list_memory_categories", [s("list", lambda st, _: {"response": filters.without_embedding(self.store.table("memory_categories", st["where"]))}, "where", "response", "db")], "where")
        put("clear_memory", [s("clear", lambda st, _: {"response": {k: filters.without_embedding(v) for k, v in self.store.clear_all(st["where"]).items()}}, "where", "response", "db")], "where")

    def run(self, name: str, **state: Any) -> Any:
        context = Context(self.store.spark, self.models)
        return self.runners.resolve(self.runner)(self.pipelines.build(name), state, context, self.hooks)["response"]

    # writing

    def memorize(self, resources: DataFrame, user: Mapping[str, Any]) -> dict[str, DataFrame]:
        """``resources`` (url, modality, raw_text): stored, split into texts, mined for items, linked to categories."""
        return self.run("memorize", resources=resources, user=dict(user))

    def _scoped(self, df: DataFrame, user: Mapping[str, Any]) -> DataFrame:
        return df.withColumns({f.name: F.lit(user.get(f.name)).cast(f.dataType) for f in self.store.scope})

    def _ingest(self, st: dict, _: Context) -> dict:
        named = st["resources"].withColumn("local_path", text.file_name(F.col("url"), F.col("modality")))
        return {"ingested": self._scoped(named, st["user"])}

    def _preprocess(self, st: dict, _: Context) -> dict:
        """One row a text: a conversation by its segments, anything else as it is condensed or described.

        Media come in a binary column ``content``; what can't be read has a null text and gives no items.
        """
        rows = st["ingested"]
        if "content" not in rows.columns:
            rows = rows.withColumn("content", F.lit(None).cast("binary"))
        keep = ["url", "modality", "local_path", "caption", "text", *self.scope]
        of = lambda kind: rows.filter(F.col("modality") == kind)

        def described(df: DataFrame, kind: str, answer: Any) -> DataFrame:
            made = df.withColumn("made", text.multimodal(answer, prompts.CONTENT_TAG[kind]))
            return made.withColumns({"text": F.coalesce("made.content", "raw_text"), "caption": F.col("made.caption")}).select(*keep)

        condensed = lambda df, kind: described(df, kind, self.models.chat(F.concat(F.lit(prompts.PREPROCESS[kind] + "\n\n"), "raw_text")))
        seen = lambda df, kind: described(df, kind, self.models.media(F.col("content"), F.col("url"), "vision", prompts.PREPROCESS[kind]))
        heard = files.audio_texts(of("audio"), lambda content, name: self.models.media(content, name, "transcribe")).withColumn("raw_text", F.col("text"))
        film = of("video")
        shot = frames.frames(film.select("url", "content").dropDuplicates(["url"])).select("url", F.col("frame").alias("content"))
        plain = rows.filter(~F.col("modality").isin("conversation", *prompts.CONTENT_TAG)).withColumns({"text": F.col("raw_text"), "caption": F.lit(None).cast("string")})
        parts = [self._segmented(of("conversation")).select(*keep), condensed(of("document"), "document"), condensed(heard, "audio"), seen(of("image"), "image"), seen(film.drop("content").join(shot, "url", "left"), "video"), plain.select(*keep)]
        made = reduce(DataFrame.unionByName, parts)
        made = made.withColumns({"id": F.sha2(F.concat_ws("|", F.lit("resource"), "url", *self.scope), 256), "caption": F.nullif(text.strip(F.col("caption")), F.lit(""))})
        return {"texts": cut(made, "texts")}  # models are asked once, however often the texts are read

    def _segmented(self, talk: DataFrame) -> DataFrame:
        """A row for every segment the model finds, with a caption it is asked for; one without a caption if it finds none."""
        talk = talk.withColumn("text", text.format_conversation(F.col("raw_text")))
        answer = self.models.chat(F.concat(F.lit(prompts.PREPROCESS["conversation"] + "\n\n"), "text"))
        whole = F.array(F.struct(F.lit(0).alias("start"), (F.size(F.split("text", "\n")) - 1).alias("end")))
        talk = talk.withColumn("found", text.segments(answer)).withColumn("segments", F.coalesce("found", whole)).select("*", F.posexplode("segments").alias("part", "segment"))
        talk = talk.withColumn("text", text.segment_text(F.col("text"), F.col("segment.start"), F.col("segment.end"))).filter("text IS NOT NULL")
        talk = talk.withColumn("url", text.segment_url(F.col("url"), F.col("part"), F.size("segments")))
        return talk.withColumn("caption", self.models.chat(F.when(F.col("found").isNotNull(), F.col("text")), system=prompts.SEGMENT))

    def _extract(self, st: dict, _: Context) -> dict:
        known = ", ".join(n for n, _ in self.settings.categories)
        fan = st["texts"].withColumn("memory_type", F.explode(F.array(*[F.lit(t) for t in self.settings.memory_types])))
        asked = prompts.extraction(F.col("memory_type"), F.col("text"), F.lit(known), dict(self.settings.custom_prompts))
        fan = fan.withColumn("entry", F.explode(extraction.entries_of_xml(self.models.chat(asked))))
        return {"entries": fan.select(F.col("id").alias("resource_id"), "memory_type", F.col("entry.content").alias("summary"), F.col("entry.categories").alias("names"), F.col("entry.when_to_use").alias("when_to_use"), *self.scope)}

    def _bootstrap(self, user: Mapping[str, Any]) -> DataFrame:
        spark = self.store.spark
        wanted = self._scoped(spark.createDataFrame(list(self.settings.categories), "name string, description string"), user)
        wanted = wanted.withColumn("embedding", self.models.embed(text.category_text(F.col("name"), F.col("description"))))
        have = self.store.table("memory_categories", {k: v for k, v in user.items() if v is not None})
        both = mutations.with_categories(have, wanted, self.scope, F.current_timestamp())
        self.store.append("memory_categories", both.join(have.select("id"), "id", "left_anti"))
        return self.store.table("memory_categories", {k: v for k, v in user.items() if v is not None})

    def _categorize(self, st: dict, _: Context) -> dict:
        categories = self._bootstrap(st["user"])
        now = F.current_timestamp()
        new_resources = st["texts"].select("id", now.alias("created_at"), now.alias("updated_at"), "url", "modality", "local_path", "caption", self.models.embed(F.col("caption")).alias("embedding"), *self.scope)
        self.store.append("resources", new_resources)
        rows = st["entries"].withColumn("content_hash", text.content_hash(F.col("summary"), F.col("memory_type")))
        ident = F.sha2(F.concat_ws("|", F.lit("item"), *(["content_hash"] if self.settings.reinforce else ["resource_id", "content_hash"]), *self.scope), 256)
        extra = F.to_json(F.struct("content_hash", F.lit(1).alias("reinforcement_count"), "when_to_use"))
        items = rows.withColumn("id", ident).groupBy("id").agg(*[F.min(c).alias(c) for c in ("resource_id", "memory_type", "summary", "content_hash", "when_to_use", *self.scope)], F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
        items = items.withColumns({"created_at": now, "updated_at": now, "embedding": self.models.embed(F.col("summary")), "extra": extra})
        items = cut(items, "items")  # model answers are asked for once
        fresh = items.join(self.store.table("memory_items").select("id"), "id", "left_anti")
        fresh = cut(fresh, "fresh")
        again = items.join(self.store.table("memory_items").select("id", F.col("extra").alias("old")), "id")
        count = F.coalesce(F.get_json_object("old", "$.reinforcement_count").cast("int"), F.lit(1)) + 1
        self.store.append("memory_items", again.select("id", now.alias("updated_at"), F.to_json(F.struct(count.alias("reinforcement_count"), now.alias("last_reinforced_at"))).alias("extra")), "patch")
        named = links.category_ids(items.select("id", "names", *self.scope), categories, self.scope)
        relations = cut(named.select(F.sha2(F.concat_ws("|", F.lit("link"), F.col("id"), "category_id"), 256).alias("id"), F.col("id").alias("item_id"), "category_id").join(items.select(F.col("id").alias("item_id"), *self.scope), "item_id"), "relations")
        self.store.append("category_items", relations.withColumns({"created_at": now, "updated_at": now}).join(self.store.table("category_items").select("id"), "id", "left_anti"))
        self.store.append("memory_items", fresh.drop("names", "content_hash", "when_to_use"))
        return {"new_resources": new_resources, "items": items.drop("names"), "relations": relations, "categories": categories}

    def _persist(self, st: dict, _: Context) -> dict:
        """Rolling summaries of the categories touched, and short ids of items that they cite."""
        updates = links.category_updates(st["relations"], st["items"])
        made = self._summaries(updates).select(F.col("category_id").alias("id"), "summary")
        self.store.append("memory_categories", made.withColumn("updated_at", F.current_timestamp()), "patch")
        if self.settings.item_references:
            listed = updates.select("category_id", "part", F.posexplode("updates").alias("at", "u")).select("category_id", F.struct("part", "at").alias("pos"), "u.item_id")
            cited = links.write_back(listed, self.store.table("memory_categories").select(F.col("id").alias("category_id"), "summary"))
            self.store.append("memory_items", cited.select(F.col("item_id").alias("id"), F.to_json(F.struct("ref_id")).alias("extra"), F.current_timestamp().alias("updated_at")), "patch")
        return {"updates": updates}

    def _summaries(self, updates: DataFrame) -> DataFrame:
        """(category_id, summary): the model folds the items of a part into a summary, and the summaries of parts again, until there is one."""
        ask = lambda old, cited: text.strip_fences(self.models.chat(prompts.category_summary(F.col("name"), old, F.col("updates"), cited, self.settings.summary_length)))
        names = self.store.table("memory_categories").select(F.col("id").alias("category_id"), "name", F.col("summary").alias("old"))
        rows = updates.join(names, "category_id")
        made = cut(rows.select("category_id", "part", "name", ask(F.when(F.col("part") == 0, F.col("old")), self.settings.item_references).alias("summary")), "summaries")
        while not made.filter("part > 0").isEmpty():
            listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "summary"))), lambda x: F.struct(F.lit(None).cast("string").alias("item_id"), x["summary"].alias("summary")))
            again = made.groupBy("category_id", "name", F.floor(F.col("part") / links.UPDATES).alias("part")).agg(listed.alias("updates"))
            one, several = again.filter("size(updates) = 1"), again.filter("size(updates) > 1")
            folded = several.select("category_id", "part", "name", ask(F.lit(None).cast("string"), False).alias("summary"))
            made = cut(one.select("category_id", "part", "name", F.col("updates")[0]["summary"].alias("summary")).unionByName(folded), "summaries")
        return made.select("category_id", "summary")

    # reading

    def retrieve(self, queries: list[Mapping[str, Any]], where: Mapping[str, Any] | None = None, vector: list[float] | None = None) -> dict[str, Any]:
        """The last query is asked, the earlier ones are its context; with a vector no embedding is needed."""
        if not queries:
            raise ValueError("empty_queries")
        texts = [q["content"] if isinstance(q["content"], str) else q["content"]["text"] for q in queries]
        if not texts[-1].strip():
            raise ValueError("EMPTY")
        history = "\n".join(f"- [{q.get('role', 'user')}]: {t}" for q, t in zip(queries[:-1], texts, strict=False)) or "No query context."
        state = {"query": texts[-1], "original": texts[-1], "history": history, "where": filters.normalise_where(where, self.store.scope), "vector": vector}
        return self.run(f"retrieve_{self.settings.method}", **state)

    def _decide(self, query: str, history: str, found: str = "") -> tuple[bool, str]:
        """Asks the model on the driver: the one place where a plan waits for an answer."""
        raw = self.models.get().call("chat", f"{prompts.GATE}\n\nQuery: {query}\n\nContext:\n{history}\n\nFound:\n{found}")
        row = self.store.spark.range(1).select(text.decision(F.lit(raw)).alias("d"), text.rewritten_query(F.lit(raw), F.lit(query)).alias("q")).first()
        return row.d == "RETRIEVE", row.q

    def _gate(self, st: dict, _: Context) -> dict:
        if not self.settings.route_intention:
            return {"needs_retrieval": True, "proceed": True}
        needed, query = self._decide(st["query"], st["history"])
        return {"needs_retrieval": needed, "proceed": needed, "query": st["query"] if st["history"] == "No query context." else query}

    def _query_vector(self, st: dict) -> list[float]:
        return st.get("vector") or self.models.get().call("embed", [st["query"]])[0]

    def _none(self, entity: str) -> DataFrame:
        return filters.without_embedding(self.store.table(entity)).withColumns({"score": F.lit(0.0), "rank": F.lit(0)}).limit(0)

    def _route_category(self, st: dict, _: Context) -> dict:
        if not (self.settings.category_enabled and st["proceed"]):
            return {"categories": self._none("memory_categories")}
        pool = filters.with_summary(self.store.table("memory_categories", st["where"])).withColumn("embedding", self.models.embed(F.col("summary")))
        hits = ranking.cosine_top_k(pool, self._query_vector(st), self.settings.category_k)
        return {"categories": filters.without_embedding(hits)}

    def _enough_after(self, tier: str):  # noqa: ANN202
        def run(st: dict, _: Context) -> dict:
            if not self.settings.sufficiency_check or not st["proceed"]:
                return {"proceed": st["proceed"]}
            column = "summary"
            found = "\n\n".join(r[0] or "" for r in st[tier].orderBy("rank").select(column).limit(100).collect())
            more, query = self._decide(st["query"], st["history"], found)
            return {"proceed": more, **({"query": query, "vector": None} if more else {})}

        return run

    def _recall_items(self, st: dict, _: Context) -> dict:
        if not (self.settings.item_enabled and st["proceed"]):
            return {"items": self._none("memory_items")}
        pool = with_extra(self.store.table("memory_items", st["where"]))
        hits = ranking.search(pool, self._query_vector(st), self.settings.item_k, self.settings.ranking, half_life_days=self.settings.recency_decay_days)
        return {"items": filters.without_embedding(hits)}

    def _recall_resources(self, st: dict, _: Context) -> dict:
        if not (self.settings.resource_enabled and st["proceed"]):
            return {"resources": self._none("resources")}
        pool = filters.with_vector(self.store.table("resources", st["where"]))
        return {"resources": filters.without_embedding(ranking.cosine_top_k(pool, self._query_vector(st), self.settings.resource_k))}

    def _ranked_ids(self, st: dict, lines: list[str], key: str, k: int) -> DataFrame:
        """The model's order of the lines of one prompt, as an array of ids."""
        shown = "\n".join(lines)
        raw = self.models.get().call("chat", f"{prompts.RANK.format(top_k=k, key=key)}\n\nQuery: {st['query']}\n\n{shown}")
        return self.store.spark.range(1).select(F.coalesce(F.from_json(F.get_json_object(text.json_blob(F.lit(raw)), f"$.{key}"), "array<string>"), F.array().cast("array<string>")).alias("ids"))

    def _by_model(self, st: dict, pool: DataFrame, line: Any, key: str, k: int) -> DataFrame:
        """The model ranks the pool; its order is kept, its ids are checked against the pool.

        A pool of more lines than PROMPT_LINES is ranked in blocks, and the blocks' winners again, until one prompt holds them.
        """
        size = max(PROMPT_LINES, 2 * k)
        listed = pool.select(F.concat(F.lit("- "), "id", F.lit(": "), line).alias("l"), "id").orderBy("id")
        rows = ((r.id, r.l) for r in listed.toLocalIterator() if r.l)
        while True:
            block, after = list(islice(rows, size)), next(rows, None)
            if after is None:
                break
            rows, winners = chain([after], rows), []
            while block:
                of = dict(block)
                best = dict.fromkeys(x for x in self._ranked_ids(st, list(of.values()), key, k).first().ids if x in of)
                winners += [(x, of[x]) for x in islice(best, k)]
                block = list(islice(rows, size))
            rows = iter(winners)
        ids = self._ranked_ids(st, [x for _, x in block], key, k)
        return links.in_model_order(ids, pool).withColumns({"rank": F.col("pos") + 1, "score": F.lit(None).cast("double")}).drop("pos")

    def _model_categories(self, st: dict, _: Context) -> dict:
        if not (self.settings.category_enabled and st["proceed"]):
            return {"categories": self._none("memory_categories")}
        pool = self.store.table("memory_categories", st["where"])
        return {"categories": self._by_model(st, pool, text.category_text(F.col("name"), F.coalesce("summary", "description")), "categories", self.settings.category_k)}

    def _model_items(self, st: dict, _: Context) -> dict:
        if not (self.settings.item_enabled and st["proceed"]):
            return {"items": self._none("memory_items")}
        pool = self.store.table("memory_items", st["where"])
        if self.settings.use_category_references:
            cited = filters.by_reference(pool, links.cited_ids(st["categories"])).drop("ref_id")
            pool = pool if cited.isEmpty() else cited
        else:
            pool = links.items_of_categories(self.store.table("category_items"), st["categories"], pool).drop("first_link")
        return {"items": self._by_model(st, pool, F.col("summary"), "items", self.settings.item_k)}

    def _model_resources(self, st: dict, _: Context) -> dict:
        if not (self.settings.resource_enabled and st["proceed"]):
            return {"resources": self._none("resources")}
        pool = links.resources_of_items(st["items"], self.store.table("resources", st["where"]))
        return {"resources": self._by_model(st, pool, F.coalesce("caption", "url"), "resources", self.settings.resource_k)}

    def _context(self, st: dict, _: Context) -> dict:
        keys = ("needs_retrieval", "categories", "items", "resources")
        return {"response": {k: st[k] for k in keys} | {"original_query": st["original"], "rewritten_query": st["query"], "next_step_query": st["query"] if st["proceed"] else None}}

    # single items

    def create_items(self, items: DataFrame, categories: DataFrame | None = None, propagate: bool = True) -> Any:
        """``items`` (id, memory_type, summary, scope); ``categories`` (item_id, category_id)."""
        return self.run("patch_create", items=items, categories=categories, propagate=propagate)

    def update_items(self, items: DataFrame, categories: DataFrame | None = None, propagate: bool = True) -> Any:
        """Non-null columns change; without ``categories`` links stay, with it they become what it says."""
        return self.run("patch_update", items=items, categories=categories, propagate=propagate)

    def delete_items(self, ids: DataFrame, propagate: bool = True) -> Any:
        return self.run("patch_delete", items=ids, categories=None, propagate=propagate)

    def _create(self, st: dict, _: Context) -> dict:
        wrong = st["items"].filter(~F.col("memory_type").isin(*MEMORY_TYPES)).limit(1).collect()
        if wrong:
            raise ValueError(f"unknown memory type {wrong[0].memory_type!r}")
        now = F.current_timestamp()
        self.store.append("memory_items", st["items"].withColumns({"embedding": self.models.embed(F.col("summary")), "created_at": now, "updated_at": now}))
        return {"changes": self._relink(st, None, st["items"].select("id", F.lit(None).cast("string").alias("before"), F.col("summary").alias("after")))}

    def _update(self, st: dict, _: Context) -> dict:
        old = self._kept(st["items"])
        rows = st["items"]
        self.store.update("memory_items", rows.withColumn("embedding", self.models.embed(F.col("summary"))) if "summary" in rows.columns else rows)
        after = rows.select("id", F.col("summary").alias("after")) if "summary" in rows.columns else rows.select("id", F.lit(None).cast("string").alias("after"))
        return {"changes": self._relink(st, old, old.join(after, "id").withColumn("after", F.coalesce("after", "before")))}

    def _kept(self, ids: DataFrame) -> DataFrame:
        """Texts before a change, read before it is written."""
        return cut(self.store.table("memory_items").join(ids.select("id"), "id", "left_semi").select("id", F.col("summary").alias("before")), "before")

    def _delete(self, st: dict, _: Context) -> dict:
        old = self._kept(st["items"])
        mine = cut(self.store.table("category_items").join(old.select(F.col("id").alias("item_id")), "item_id", "left_semi").select("item_id", "category_id").distinct(), "links")
        self.store.delete("memory_items", old.select("id"))
        return {"changes": mine.join(old.withColumnRenamed("id", "item_id"), "item_id").withColumns({"after": F.lit(None).cast("string"), "change": F.lit("unlink")})}

    def _relink(self, st: dict, old: DataFrame | None, texts: DataFrame) -> DataFrame:
        """(item_id, category_id, change, before, after); a null text means the item isn't in the category on that side."""
        now = F.current_timestamp()
        have = cut(self.store.table("category_items").join(texts.select(F.col("id").alias("item_id")), "item_id", "left_semi").select("id", "item_id", "category_id"), "links")
        wanted = st.get("categories") if st.get("categories") is not None else have
        changes = cut(links.membership_changes(have, wanted), "changes")
        ident = F.sha2(F.concat_ws("|", F.lit("link"), "item_id", "category_id"), 256)
        self.store.append("category_items", changes.filter("change = 'link'").select(ident.alias("id"), "item_id", "category_id", now.alias("created_at"), now.alias("updated_at")))
        self.store.append("category_items", have.join(changes.filter("change = 'unlink'"), ["item_id", "category_id"], "left_semi").select("id"), "delete")
        out = changes.join(texts.withColumnRenamed("id", "item_id"), "item_id")
        out = out.withColumns({"before": F.when(F.col("change") != "link", F.col("before")), "after": F.when(F.col("change") != "unlink", F.col("after"))})
        return out.filter((F.col("change") != "keep") | ~F.col("before").eqNullSafe(F.col("after")))

    def _patch(self, st: dict, _: Context) -> dict:
        if not st.get("propagate", True):
            return {"patched": None}
        names = self.store.table("memory_categories").select(F.col("id").alias("category_id"), "name", "summary")
        asked = st["changes"].join(names, "category_id").withColumn("prompt", prompts.category_patch(F.col("name"), F.col("summary"), F.col("before"), F.col("after")))
        made = asked.withColumn("p", text.category_patch(self.models.chat(F.col("prompt")))).filter("p.need_update")
        new = made.groupBy(F.col("category_id").alias("id")).agg(F.max("p.content").alias("summary"))
        self.store.append("memory_categories", new.withColumn("updated_at", F.current_timestamp()), "patch")
        return {"patched": new}


def tools(service: MemoryService, user_id: str) -> dict[str, Any]:
    """Functions for an agent: save a text, search with a least score."""

    def save(content: str, memory_type: str = "knowledge", category_ids: list[str] | None = None) -> str:
        spark = service.store.spark
        row = spark.createDataFrame([(content, memory_type, user_id)], "summary string, memory_type string, user_id string")
        row = row.withColumn("id", F.sha2(F.concat_ws("|", "user_id", "memory_type", "summary"), 256)).persist()
        ident = row.first().id
        cats = spark.createDataFrame([(ident, c) for c in category_ids or []], "item_id string, category_id string")
        service.create_items(row, cats)
        return ident

    def search(query: str, limit: int = 5, least_score: float = 0.0) -> list[dict[str, Any]]:
        found = service.retrieve([{"role": "user", "content": query}], {"user_id": user_id})["items"]
        return [{"id": r.id, "summary": r.summary, "score": r.score} for r in filters.at_least(found, least_score, limit).collect()]

    return {"save_memory": save, "search_memory": search}


def with_memories(service: MemoryService, chat: Any, user_id: str):  # noqa: ANN201
    """A chat function whose messages carry what is remembered; a failed lookup leaves them as they are."""

    def run(messages: list[dict[str, str]], **more: Any) -> Any:
        asked = next((m["content"] for m in reversed(messages) if m["role"] == "user"), None)
        try:
            found = tools(service, user_id)["search_memory"](asked) if asked else []
            block = "<memory_context>\n" + "\n".join(f"- {f['summary']}" for f in found) + "\n</memory_context>"
            if found:
                at = next((i for i, m in enumerate(messages) if m["role"] == "system"), None)
                new = {"role": "system", "content": block if at is None else f"{messages[at]['content']}\n\n{block}"}
                messages = [new, *messages] if at is None else [new if i == at else m for i, m in enumerate(messages)]
        except Exception:
            pass
        return chat(messages, **more)

    return run
