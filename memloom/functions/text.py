"""Scalar text functions as Column expressions; all stay inside the JVM unless said otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python splits it, over the whole basic plane.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1c-\x1e\x85  ]"
_REF = r"\[ref:([a-zA-Z0-9_,\-]+)\]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}|{SPACE}$", "")


def normalise(c: Column) -> Column:
    """Trimmed and lower-cased."""
    return F.lower(strip(c))


def content_hash(summary: Column, memory_type: Column) -> Column:
    """16 hex digits that agree for texts equal up to case and white space within one type."""
    plain = F.trim(F.regexp_replace(F.lower(summary), SPACE, " "))
    return F.substring(F.sha2(F.concat(memory_type, F.lit(":"), plain), 256), 1, 16)


def tool_call_hash(tool: Column, given: Column, output: Column) -> Column:
    """Of calls whose input is a text; for structured input see ``json_input``."""
    return F.md5(F.concat(tool, F.lit("|"), given, F.lit("|"), output))


def text_hash(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.sha2(c, 256))


def texts_hash(c: Column) -> Column:
    """Of a list of texts, each closed by a NUL."""
    return F.when(F.size(c) > 0, F.sha2(F.array_join(F.transform(c, lambda x: F.concat(x, F.lit("\0"))), ""), 256))


def references(c: Column) -> Column:
    """Ids cited as [ref:a,b], each once, in order of appearance."""
    cited = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_REF), F.lit(1))
    ids = F.flatten(F.transform(cited, lambda m: F.transform(F.split(m, ","), lambda x: F.trim(x))))
    return F.array_distinct(F.filter(ids, lambda x: x != ""))


def strip_references(c: Column) -> Column:
    """The text without citations, spaces before punctuation and double spaces."""
    bare = F.regexp_replace(F.regexp_replace(c, _REF, ""), SPACE + r"([.,;:!?])", "$1")
    return F.when(F.length(c) > 0, F.trim(F.regexp_replace(bare, SPACE, " "))).otherwise(c)


def numbered_citations(c: Column) -> Column:
    """Citations become [n], with the ids listed at the end; unchanged without any."""
    ids = references(c)
    pieces = F.split(c, r"\[ref:[a-zA-Z0-9_,\-]+\]", -1)
    cited = F.regexp_extract_all(c, F.lit(_REF), F.lit(1))

    def numbers(m: Column) -> Column:
        some = F.filter(F.transform(F.split(m, ","), lambda x: F.trim(x)), lambda x: x != "")
        return F.concat(F.lit("["), F.array_join(F.transform(some, lambda x: F.array_position(ids, x).cast("string")), ","), F.lit("]"))

    marks = F.transform(cited, numbers)
    body = F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    listed = F.array_join(F.transform(ids, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    return F.when(F.size(ids) > 0, F.concat(body, F.lit("\n\nReferences:\n"), listed)).otherwise(c)


def reference_line(ref_id: Column, summary: Column) -> Column:
    return F.concat(F.lit("- [ref:"), ref_id, F.lit("] "), F.when(F.length(summary) > 100, F.concat(F.left(summary, F.lit(100)), F.lit("..."))).otherwise(summary))


def reference_map(items: Column) -> Column:
    """Lines for an array of (id, summary) below a heading; empty for none."""
    lines = F.array_join(F.transform(items, lambda x: reference_line(x["id"], x["summary"])), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit("Items that may be cited:\n"), lines)).otherwise("")


def short_reference(c: Column) -> Column:
    return F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 6)


def json_blob(c: Column) -> Column:
    """From the first brace to the last; null without."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def escape_braces(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def tag_content(c: Column, tag: str) -> Column:
    return F.nullif(strip(F.regexp_extract(c, f"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def decision(c: Column) -> Column:
    """RETRIEVE or NO_RETRIEVE, the latter only where it is said."""
    said = F.upper(F.coalesce(tag_content(c, "decision"), c, F.lit("")))
    return F.when(said.contains("NO_RETRIEVE") | said.contains("NO RETRIEVE"), "NO_RETRIEVE").otherwise("RETRIEVE")


def judgement(c: Column) -> Column:
    """ENOUGH where it is said, else MORE."""
    said = F.upper(F.coalesce(tag_content(c, "judgement"), c, F.lit("")))
    return F.when(said.contains("ENOUGH"), "ENOUGH").otherwise("MORE")


def rewritten_query(c: Column, query: Column) -> Column:
    return F.coalesce(tag_content(c, "rewritten_query"), query)


def multimodal(c: Column, content_tag: str, caption_tag: str = "caption") -> Column:
    """(content, caption) of a description; the first sentence stands in for a caption."""
    content = F.coalesce(tag_content(c, content_tag), strip(c))
    first = F.substring(strip(F.split_part(content, F.lit("."), F.lit(1))), 1, 200)
    return F.struct(content.alias("content"), F.coalesce(tag_content(c, caption_tag), F.nullif(first, F.lit(""))).alias("caption"))


_SEGMENTS = "struct<segments:array<struct<start:string,end:string>>>"


def segments(c: Column) -> Column:
    """Segments (start, end) of a JSON answer, whole or inside other text; null if none is usable."""

    def usable(parsed: Column) -> Column:
        rows = F.transform(parsed["segments"], lambda s: F.struct(s["start"].try_cast("int").alias("start"), s["end"].try_cast("int").alias("end")))
        some = F.filter(rows, lambda s: s["start"].isNotNull() & s["end"].isNotNull())
        return F.when(F.size(some) > 0, some)

    return F.coalesce(usable(F.from_json(c, _SEGMENTS)), usable(F.from_json(json_blob(c), _SEGMENTS)))


def lines_between(c: Column, start: Column, end: Column) -> Column:
    """Lines marked [n] with n from ``start`` to ``end``; null if there are none."""

    def number(line: Column) -> Column:
        return F.regexp_extract(line, r"^\[(\d+)\]", 1).try_cast("int")

    kept = F.filter(F.split(c, "\n"), lambda x: (number(x) >= start) & (number(x) <= end))
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def segment_text(c: Column, start: Column, end: Column) -> Column:
    """Lines by position, both ends included and held to what exists; null if blank."""
    lines = F.split(c, "\n")
    last = F.size(lines) - 1
    a, b = F.greatest(F.lit(0), F.least(start, last)), F.greatest(F.lit(0), F.least(end, last))
    some = F.when(b >= a, F.array_join(F.slice(lines, a + 1, b - a + 1), "\n"))
    return F.when(F.length(strip(some)) > 0, some)


def entries(c: Column) -> Column:
    """Entries (content, categories) without blanks; the input is an array of such structs."""
    clean = F.transform(c, lambda e: F.struct(strip(e["content"]).alias("content"), F.filter(F.transform(e["categories"], strip), lambda x: x != "").alias("categories")))
    return F.filter(clean, lambda e: F.length(e["content"]) > 0)


def entries_of_json(c: Column) -> Column:
    """Entries of the JSON form of an extraction."""
    parsed = F.from_json(json_blob(c), "struct<memories_items:array<struct<content:string,categories:array<string>>>>")
    return F.coalesce(entries(parsed["memories_items"]), F.array().cast("array<struct<content:string,categories:array<string>>>"))


def category_patch(c: Column) -> Column:
    """(need_update, content) of a patch answer; the word empty means a blank content."""
    parsed = F.from_json(json_blob(c), "struct<need_update:boolean,updated_content:string>")
    text = strip(parsed["updated_content"])
    given = F.coalesce(parsed["need_update"], F.lit(False)) & (F.length(text) > 0)
    return F.struct(given.alias("need_update"), F.when(given, F.when(F.lower(text) == "empty", "").otherwise(text)).otherwise("").alias("content"))


def strip_fences(c: Column) -> Column:
    """Markdown without the fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[a-zA-Z]*", ""), r"```$", ""))


def segment_url(url: Column, index: Column, total: Column) -> Column:
    name = F.regexp_extract(url, r"([^/]*)$", 1)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    suffix = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"(\.[^.]+)$", 1)).otherwise("")
    return F.when(total > 1, F.concat(stem, F.lit("_#segment_"), index.cast("string"), suffix)).otherwise(url)


def category_text(name: Column, description: Column) -> Column:
    """What stands for a category when it is embedded."""
    n = F.coalesce(F.nullif(strip(name), F.lit("")), F.lit("Untitled"))
    d = F.coalesce(strip(description), F.lit(""))
    return F.when(F.length(d) > 0, F.concat(n, F.lit(": "), d)).otherwise(n)


def category_lines(c: Column) -> Column:
    """A prompt's list of an array of (name, description)."""
    return F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), category_text(x["name"], x["description"]))), "\n")


def messages(raw: Column) -> Column:
    """Messages (role, content, created_at) of a conversation's JSON: a list, or an object that holds one as content; null for anything else."""
    flat = "array<struct<role:string,content:string,created_at:string>>"
    head = F.left(F.ltrim(raw), F.lit(1))
    wrapped = F.from_json(F.get_json_object(raw, "$.content"), flat)
    return F.when(head == "[", F.from_json(raw, flat)).when(head == "{", F.when(F.left(F.get_json_object(raw, "$.content"), F.lit(1)) == "[", wrapped))


def message_text(content: Column) -> Column:
    """The text of a message: its content, or the text inside a structured one; on one line."""
    inner = F.when(F.left(F.ltrim(content), F.lit(1)) == "{", F.get_json_object(content, "$.text"))
    return strip(F.regexp_replace(F.coalesce(inner, content, F.lit("")), LINE_BREAK, " "))


def conversation_lines(msgs: Column) -> Column:
    """[n] time [role]: text, one line a message."""

    def line(m: Column, i: Column) -> Column:
        when = F.coalesce(F.concat(F.nullif(strip(m["created_at"]), F.lit("")), F.lit(" ")), F.lit(""))
        return F.concat(F.lit("["), i.cast("string"), F.lit("] "), when, F.lit("["), F.coalesce(F.nullif(strip(m["role"]), F.lit("")), F.lit("user")), F.lit("]: "), message_text(m["content"]))

    return F.array_join(F.transform(msgs, line), "\n")


def format_conversation(raw: Column) -> Column:
    """Lines of a conversation's JSON, or the text as it is."""
    return F.coalesce(conversation_lines(messages(raw)), raw)


@F.pandas_udf(T.StringType())
def numbered_lines(texts: pd.Series) -> pd.Series:
    """[n] before every line that isn't blank; in Arrow batches, since an expression would copy what it has at every line."""

    def number(t: str) -> str:
        n, out = 0, []
        for line in t.split("\n"):
            if line.strip():
                line, n = f"[{n}] {line}", n + 1
            out.append(line)
        return "\n".join(out)

    return texts.map(number, na_action="ignore")


def excerpt(c: Column, n: int = 100) -> Column:
    return F.concat(F.left(c, F.lit(n)), F.lit("..."))


def history(msgs: Column) -> Column:
    """Earlier turns as a prompt's context."""
    lines = F.array_join(F.transform(msgs, lambda m: F.concat(F.lit("- ["), F.coalesce(m["role"], F.lit("user")), F.lit("]: "), message_text(m["content"]))), "\n")
    return F.when(F.size(msgs) > 0, lines).otherwise("No query context.")


def query_text(content: Column) -> Column:
    """The text of a query; an error for a blank one."""
    text = message_text(content)
    return F.when(F.length(text) > 0, text).otherwise(F.raise_error(F.lit("EMPTY")).cast("string"))


def scored_line(kind: str, title: Column, score: Column | None = None) -> Column:
    """A hit as a line of a prompt, with its score if there is one."""
    head = F.concat(F.lit(f"{kind}: "), F.coalesce(title, F.lit("")))
    return head if score is None else F.concat(head, F.format_string("\nScore: %.3f", score))


def inject_memories(msgs: Column, memories: Column) -> Column:
    """Messages whose system message, a new one if need be, lists the memories."""
    block = F.concat(F.lit("<memory_context>\n"), F.array_join(F.transform(memories, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n</memory_context>"))
    at = F.array_position(F.transform(msgs, lambda m: m["role"]), "system")
    added = F.transform(
        msgs, lambda m, i: F.when(i + 1 == at, F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("\n\n"), block).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content")))
    )
    new = F.concat(F.array(F.struct(F.lit("system").alias("role"), block.alias("content"))), added)
    return F.when(F.size(memories) == 0, F.transform(msgs, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).when(at > 0, added).otherwise(new)


def usage(raw: Column, kind: str = "chat") -> Column:
    """Token counts of a provider's JSON answer."""
    get = lambda p: F.get_json_object(raw, p).try_cast("bigint")
    total = get("$.usage.total_tokens")
    given = F.coalesce(get("$.usage.prompt_tokens"), get("$.usage.input_tokens"))
    return F.struct(
        (F.coalesce(given, total) if kind == "embed" else given).alias("input_tokens"),
        F.coalesce(get("$.usage.completion_tokens"), get("$.usage.output_tokens")).alias("output_tokens"),
        total.alias("total_tokens"),
        F.coalesce(get("$.usage.prompt_tokens_details.cached_tokens"), get("$.usage.input_tokens_details.cached_tokens")).alias("cached_tokens"),
        F.coalesce(get("$.usage.completion_tokens_details.reasoning_tokens"), get("$.usage.output_tokens_details.reasoning_tokens")).alias("reasoning_tokens"),
        F.get_json_object(raw, "$.choices[0].finish_reason").alias("finish_reason"),
    )


def file_name(url: Column, modality: Column) -> Column:
    """A name to keep a fetched file under: the path's own, else one made of the query and the modality."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", "")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    kind = F.regexp_extract(url, r"[?&]type=([^&#]+)", 1)
    own = F.regexp_extract(url, r"[?&]id=([^&#]+)", 1)
    by_kind = F.when(modality == "audio", "mp3").when(modality == "video", "mp4").when(modality == "image", "jpg").when(modality == "document", "txt").otherwise("bin")
    made = F.when((kind != "") & (own != ""), F.concat(F.lit("audio_"), own, F.lit("."), kind)).otherwise(F.concat(F.lit("resource."), by_kind))
    return F.when((name == "") | ~name.contains(".") | name.endswith(".php"), made).otherwise(name)


def vector_of_json(c: Column) -> Column:
    """A vector written as JSON; null if it can't be read."""
    return F.from_json(c, "array<double>")


def parse_iso(c: Column) -> Column:
    return F.try_to_timestamp(c)
