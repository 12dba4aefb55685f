"""Pipelines, models and the service end to end with a stub."""

import re
from datetime import datetime

import pytest
from memloom.models import client as M
from memloom.operators import links
from memloom.operators.store import MemoryStore
from memloom.plans import pipeline as P
from memloom.plans import prompts
from memloom.plans.service import MemoryService, Settings, tools, with_memories
from memloom.sources import files, frames
from pyspark.sql import functions as F

ITEM = "<item><memory><content>Likes green tea</content><categories><category>Preferences</category></categories></memory><memory><content>Met Ann in May</content><categories><category>people</category><category>events</category></categories></memory></item>"


def test_pipelines():
    p = P.Pipelines(frozenset({"db"}))
    add = lambda n: lambda st, c: {"x": st["x"] + [n]}
    p.register("w", [P.stage("a", add("a"), "x", "x"), P.stage("b", add("b"), "x", "x", "db")], "x")
    assert p.insert_before("w", "b", P.stage("m", add("m"), "x", "x")) == 2 and p.insert_after("w", "b", P.stage("z", add("z"), "x", "x")) == 3
    assert p.replace("w", "m", P.stage("n", add("n"), "x", "x")) == 4 and p.remove("w", "a") == 5 and p.configure("w", "n", k=1) == 6 and p.revision_token() == "w:v6"
    seen, hooks = [], P.StageHooks()
    for k in (1, 2):
        hooks.add("before", lambda s, st, k=k: seen.append(("before", k, s.name)))
        hooks.add("after", lambda s, st, k=k: seen.append(("after", k, s.name)))
    assert P.run_stages(p.build("w"), {"x": []}, P.Context(), hooks)["x"] == ["n", "b", "z"]
    assert seen[:4] == [("before", 1, "n"), ("before", 2, "n"), ("after", 2, "n"), ("after", 1, "n")]
    for bad in ([P.stage("a", add("a"), "y", "x")], [P.stage("a", add("a"), "x"), P.stage("a", add("a"), "x")], [P.stage("a", add("a"), "x", "", "gpu")], [P.stage("a", add("a"), "x", "", "", chat_profile="other")]):
        with pytest.raises(ValueError):
            p.register("bad", bad, "x")
    with pytest.raises(KeyError):
        p.remove("w", "nope")
    with pytest.raises(KeyError):
        P.run_stages((P.stage("a", add("a"), "x"),), {}, P.Context())
    with pytest.raises(TypeError):
        P.run_stages((P.stage("a", lambda st, c: 1),), {}, P.Context())
    with pytest.raises(ValueError):
        P.Runners().resolve("nope")


def test_models_and_hooks():
    hooks, seen = M.HookRegistry(), []
    hooks.add("before", lambda c: seen.append(("late", c.operation)), priority=5)
    gone = hooks.add("before", lambda c: seen.append(("early", c.operation)))
    hooks.add("after", lambda c, a: seen.append(("after", c.status)), {"operation": "CHAT", "statuses": ["success"]})
    hooks.add("on_error", lambda c, e: seen.append(("error", c.error)))
    hooks.add("before", lambda c: 1 / 0, priority=9)
    f = M.ClientFactory({"default": lambda: M.StubClient(8, {"ping": "pong"})}, hooks)
    assert f.get().call("chat", "ping") == "pong" and len(f.get().call("embed", ["a b", "c"])[0]) == 8
    gone()
    f.get().call("embed", ["x"])
    assert seen == [("early", "chat"), ("late", "chat"), ("after", "success"), ("early", "embed"), ("late", "embed"), ("late", "embed")] and len(hooks.failures) == 3
    with pytest.raises(KeyError):
        f.get("nope")
    sent = []
    c = M.JsonClient(lambda url, p: sent.append((url, p)) or {"choices": [{"message": {"content": "hi"}}], "data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}, "m", "e", batch=2)
    assert c.chat("q", "s", 5) == "hi" and c.embed(["a", "b"]) == [[1.0], [2.0]] and sent[0][1]["messages"][0]["role"] == "system" and c.vision("p", b"x", "image/png") == "hi"


def test_prompts():
    assert prompts.blocks({"b": (1, "two"), "a": (1, "one"), "n": (-1, "no"), "e": (0, " ")}) == "one\n\ntwo" and prompts.blocks("x") == "x"
    assert prompts.resolve(None, {"audio": "A"}, "audio") == "A" and prompts.resolve("o", {}, "audio") == "o"


@pytest.fixture
def service(spark, tmp_path):
    answers = {"Answer with one <item>": ITEM, "Split the numbered": '{"segments":[{"start":0,"end":1},{"start":2,"end":2}]}', "Rewrite the category": "```markdown\n# sum\n```", "need_update": '{"need_update": true, "updated_content": "patched"}', "needs memories": "<decision>RETRIEVE</decision>"}
    settings = Settings(memory_types=("profile",), route_intention=False, sufficiency_check=False, reinforce=True)
    return MemoryService(MemoryStore(spark, f"file://{tmp_path}/m"), M.stub_factory(16, answers), settings)


def test_memorise_and_retrieve(spark, service):
    raw = '[{"role":"user","content":"I like tea"},{"role":"assistant","content":"ok"},{"role":"user","content":"met Ann"}]'
    batch = spark.createDataFrame([("/in/talk.json", "conversation", raw), ("/in/doc.txt", "document", "Some text.")], "url string, modality string, raw_text string")
    out = service.memorize(batch, {"user_id": "u"})
    assert out["items"].count() == 2 and "embedding" not in out["items"].columns
    t = service.store.table
    assert sorted(r.url for r in t("resources").collect()) == ["/in/doc.txt", "talk_#segment_0.json", "talk_#segment_1.json"]
    assert t("memory_items").count() == 2 and t("category_items").count() == 3 and {r.summary for r in t("memory_categories").collect()} == {"# sum"}
    service.memorize(batch.limit(1), {"user_id": "u"})
    assert t("memory_items").count() == 2 and t("category_items").count() == 3 and t("memory_categories").count() == 3
    assert '"reinforcement_count": 2' in t("memory_items").first().extra
    service.memorize(batch.limit(1), {"user_id": "v"})
    found = service.retrieve([{"role": "user", "content": "green tea"}], {"user_id": "u"})
    assert [r.summary for r in found["items"].orderBy("rank").collect()][0] == "Likes green tea" and found["categories"].count() == 3 and found["resources"].count() == 3
    assert tools(service, "u")["search_memory"]("Likes green tea", 1, 0.5)[0]["summary"] == "Likes green tea"
    said = with_memories(service, lambda m: m, "u")([{"role": "user", "content": "tea?"}])
    assert said[0]["role"] == "system" and "Likes green tea" in said[0]["content"]
    with pytest.raises(ValueError):
        service.retrieve([])
    with pytest.raises(ValueError):
        service.retrieve([{"role": "user", "content": "x"}], {"nope": 1})


def test_media_and_captions(spark, service):
    raw = '[{"role":"user","content":"a"},{"role":"user","content":"b"},{"role":"user","content":"c"}]'
    rows = [("/in/t.json", "conversation", raw, None), ("/in/p.png", "image", None, b"12345"), ("/in/s.wav", "audio", None, b"123"), ("/in/n.wav", "audio", "said already", None), ("/in/f.mp4", "video", None, b"no film"), ("/in/d.txt", "document", None, None), ("/in/x.txt", "text", "as it is", None)]
    service.run("memorize", resources=spark.createDataFrame(rows, "url string, modality string, raw_text string, content binary"), user={"user_id": "u"})
    got = {r.url: (r.modality, r.caption) for r in service.store.table("resources").collect()}
    assert got["/in/p.png"] == ("image", "image/png") and got["/in/f.mp4"] == ("video", None) and got["/in/d.txt"] == ("document", None) and got["/in/x.txt"] == ("text", None)
    assert got["t_#segment_0.json"][1] != got["t_#segment_1.json"][1] and got["t_#segment_0.json"][1].startswith("stub:") and got["/in/s.wav"][1].startswith("stub:")
    texts = {r.url: r.text for r in service._preprocess(service._ingest({"resources": spark.createDataFrame(rows, "url string, modality string, raw_text string, content binary"), "user": {}}, None), None)["texts"].collect()}
    assert texts["/in/p.png"] == "image/png of 5 bytes" and texts["/in/f.mp4"] is None and texts["/in/d.txt"] is None and texts["/in/x.txt"] == "as it is" and texts["t_#segment_1.json"] == "[2] [user]: c"


def test_large_categories_are_folded_in_parts(spark, service, monkeypatch):
    monkeypatch.setattr(links, "UPDATES", 4)
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = table([(f"i{k:02}", "c1") for k in range(40)] + [("i00", "c2"), ("i00", "c2")], "item_id string, category_id string")
    items = table([(f"i{k:02}", datetime(2025, 1, 1), f"s{k}") for k in range(40)], "id string, created_at timestamp, summary string")
    updates = links.category_updates(edges, items, 4).persist()
    sizes = [len(r.updates) for r in updates.collect() if r.category_id == "c1"]
    assert sum(sizes) == 40 and max(sizes) <= 12 and len(sizes) > 5

    class Model:
        def chat(self, prompt, system=None):
            return F.concat(F.lit("<"), F.array_join(F.regexp_extract_all(prompt, F.lit("- (.*)"), F.lit(1)), "+"), F.lit(">"))

    service.models = Model()
    service.store.append("memory_categories", table([("c1", "one"), ("c2", "two")], "id string, name string"))
    got = {r.category_id: r.summary for r in service._summaries(updates).collect()}
    assert got["c2"] == "<s0>" and sorted(re.findall(r"s\d+", got["c1"])) == sorted(f"s{k}" for k in range(40)) and got["c1"].startswith("<<<")


def test_retrieve_by_model(spark, service):
    service.memorize(spark.createDataFrame([("/in/doc.txt", "document", "Some text.")], "url string, modality string, raw_text string"), {"user_id": "u"})
    ids = {e: [r.id for r in service.store.table(e).orderBy("id").collect()] for e in ("memory_categories", "memory_items", "resources")}
    service.settings.method = "llm"
    service.settings.route_intention = service.settings.sufficiency_check = True
    answer = {"under the key categories": '{"categories": ["%s", "nope", 3]}' % ids["memory_categories"][1], "under the key items": '{"items": ["%s", "%s"]}' % tuple(ids["memory_items"][::-1]), "under the key resources": '{"resources": ["%s"]}' % ids["resources"][0], "needs memories": "<decision>RETRIEVE</decision><rewritten_query>again</rewritten_query>"}
    service.models = M.stub_factory(16, answer)
    linked = {r.item_id for r in service.store.table("category_items").collect() if r.category_id == ids["memory_categories"][1]}
    found = service.retrieve([{"role": "user", "content": "a"}, {"role": "user", "content": "b"}], {"user_id": "u"})
    assert [r.id for r in found["categories"].collect()] == [ids["memory_categories"][1]] and found["rewritten_query"] == "again"
    assert [r.id for r in found["items"].orderBy("rank").collect()] == [i for i in ids["memory_items"][::-1] if i in linked]
    assert found["resources"].count() == 1
    service.models = M.stub_factory(16, {"needs memories": "<decision>NO_RETRIEVE</decision>"})
    none = service.retrieve([{"role": "user", "content": "a"}])
    assert none["needs_retrieval"] is False and none["items"].count() == 0


def test_model_ranks_every_row_of_a_pool(spark, service):
    shown = []

    class Model:
        def get(self):
            return self

        def call(self, operation, prompt):
            lines = [x.split(": ") for x in prompt.split("\n") if x.startswith("- ")]
            shown.append([i[2:] for i, _ in lines])
            return '{"items": [%s]}' % ", ".join(f'"{i[2:]}"' for i, _ in sorted(lines, key=lambda x: -int(x[1]))[:3])

    service.models = Model()
    pool = spark.range(3_500).selectExpr("format_string('i%04d', id) AS id", "id * 7919 % 3500 AS n")
    got = service._by_model({"query": "the largest"}, pool, pool.n.cast("string"), "items", 3)
    assert [r.n for r in got.orderBy("rank").collect()] == [3499, 3498, 3497]
    assert sorted({i for block in shown for i in block}) == [f"i{k:04}" for k in range(3_500)] and [len(b) for b in shown] == [1000, 1000, 1000, 500, 12]
    shown.clear()
    assert service._by_model({"query": "q"}, pool.limit(1_000), pool.n.cast("string"), "items", 3).count() == 3 and len(shown) == 1
    assert service._by_model({"query": "q"}, pool.limit(0), pool.n.cast("string"), "items", 3).count() == 0


def test_single_items(spark, service):
    t = service.store.table
    service._bootstrap({"user_id": "u"})
    cats = [r.id for r in t("memory_categories").orderBy("id").collect()]
    row = lambda s: spark.createDataFrame([("i", "profile", s, "u")], "id string, memory_type string, summary string, user_id string")
    pair = lambda *cs: spark.createDataFrame([("i", c) for c in cs], "item_id string, category_id string")
    service.create_items(row("first"), pair(cats[0], cats[1]))
    assert t("category_items").count() == 2 and {r.summary for r in t("memory_categories").collect()} == {"patched", None}
    out = service.update_items(row("second"), pair(cats[1], cats[2]))
    assert sorted((r.change, r.before, r.after) for r in out.collect()) == [("keep", "first", "second"), ("link", None, "second"), ("unlink", "first", None)] or t("category_items").count() == 2
    assert t("memory_items").first().summary == "second"
    service.update_items(row("third"))
    assert t("category_items").count() == 2
    service.delete_items(spark.createDataFrame([("i",)], "id string"))
    assert t("memory_items").count() == 0 and t("category_items").count() == 0
    with pytest.raises(ValueError):
        service.create_items(spark.createDataFrame([("j", "other", "x", "u")], "id string, memory_type string, summary string, user_id string"))
    service.run("clear_memory", where={})
    assert t("memory_categories").count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.wav").write_bytes(b"123")
    rows = files.local_resources(spark, f"file://{tmp_path}/a.txt", "document").collect()
    assert [(r.local_path, r.raw_text) for r in rows] == [("a.txt", "one\ntwo")]
    got = files.audio_texts(files.binaries(spark, f"file://{tmp_path}").selectExpr("*", "CAST(NULL AS STRING) AS raw_text"), lambda c, n: M.stub_factory().media(c, n, "transcribe"))
    assert sorted(r.text for r in got.collect())[0] == "one\ntwo" and any("transcript of" in r.text for r in got.collect())

    def fetch(u):
        if u == "bad":
            raise OSError("no")
        return u.encode()

    rows = files.as_text(files.fetched(spark.createDataFrame([("x",), ("bad",)], "url string"), fetch).selectExpr("*", "'text' AS modality")).collect()
    assert [(r.raw_text, r.error) for r in rows] == [("x", None), (None, "no")]
    files.export_markdown(spark.createDataFrame([("my cat", "<content># x</content>")], "name string, summary string"), f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out/name=my_cat").first().value == "# x"
    assert frames.frame_times(8.0, 3) == [2.0, 4.0, 6.0]
    with pytest.raises(ValueError):
        frames.run_program(["rm", "x"])
    with pytest.raises(ValueError):
        frames.safe_path("-x")
