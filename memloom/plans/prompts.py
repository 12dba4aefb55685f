"""Prompt texts: what is asked of a model, and the grammar of its answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions import text

_ITEM_FORM = "Answer with one <item> element. For every memory add <memory><content>one sentence</content><categories><category>name</category></categories></memory>. Leave out what the text does not say."
MEMORY_TYPES = {
    "profile": "List lasting facts about the user.",
    "event": "List things that happened at some time, with people and places.",
    "knowledge": "List facts and explanations about the world that the text teaches.",
    "behavior": "List habits, preferences and recurring ways of acting.",
    "skill": "List abilities shown, with the steps that make them work.",
    "tool": "List uses of tools: what was called, with what result, and add <when_to_use> to each memory.",
}
PREPROCESS = {
    "conversation": 'Split the numbered conversation into topics. Answer with JSON {"segments":[{"start":0,"end":0}]}, both ends included.',
    "document": "Condense the document. Answer with <processed_content>…</processed_content><caption>one sentence</caption>.",
    "audio": "Clean up the transcript. Answer with <processed_content>…</processed_content><caption>one sentence</caption>.",
    "image": "Describe the picture. Answer with <detailed_description>…</detailed_description><caption>one sentence</caption>.",
    "video": "Describe the frame of the video. Answer with <detailed_description>…</detailed_description><caption>one sentence</caption>.",
}
SEGMENT = "Say in one or two sentences what this part of a conversation is about."
CONTENT_TAG = {"document": "processed_content", "audio": "processed_content", "image": "detailed_description", "video": "detailed_description"}
GATE = "Decide whether the query needs memories. Answer with <decision>RETRIEVE or NO_RETRIEVE</decision><rewritten_query>…</rewritten_query>."
RANK = "Order by relevance to the query and keep at most {top_k}. Answer with JSON that has an array of ids under the key {key}."
CATEGORY_SUMMARY = "Rewrite the category's summary so that it covers the new items, in Markdown, in about {target_length} words."
CATEGORY_SUMMARY_CITED = CATEGORY_SUMMARY + " Cite items as [ref:id]."
CATEGORY_PATCH = 'Say whether the change calls for another summary. Answer with JSON {"need_update": true or false, "updated_content": "…"}; write empty if nothing is left.'


def blocks(given: dict[str, tuple[int, str]] | str, defaults: dict[str, tuple[int, str]] | None = None) -> str:
    """One prompt from named blocks (ordinal, text), by ordinal and name; negative ordinals and empty blocks drop out."""
    if isinstance(given, str):
        return given
    some = {**(defaults or {}), **given}
    return "\n\n".join(t for _, _, t in sorted((o, n, t.strip()) for n, (o, t) in some.items() if o >= 0 and t.strip()))


def resolve(override: str | dict | None, by_modality: dict[str, str], modality: str, default: str = "") -> str:
    return blocks(override) if override else by_modality.get(modality, default)


def extraction(memory_type: Column, resource: Column, categories: Column, custom: dict[str, str] | None = None) -> Column:
    """The prompt that asks for one type of memories in a text."""
    texts = {**MEMORY_TYPES, **(custom or {})}
    asked = F.coalesce(*[F.when(memory_type == k, F.lit(v)) for k, v in texts.items()])
    return F.concat(asked, F.lit(f"\n{_ITEM_FORM}\n\nCategories:\n"), text.escape_braces(categories), F.lit("\n\nText:\n"), text.escape_braces(resource))


def category_summary(name: Column, old: Column, updates: Column, cited: bool = False, target_length: int = 400) -> Column:
    head = (CATEGORY_SUMMARY_CITED if cited else CATEGORY_SUMMARY).format(target_length=target_length)
    lines = F.transform(updates, lambda u: text.reference_line(text.short_reference(u["item_id"]), u["summary"]) if cited else F.concat(F.lit("- "), u["summary"]))
    return F.concat(F.lit(head + "\n\nCategory: "), name, F.lit("\n\nSummary so far:\n"), F.coalesce(old, F.lit("")), F.lit("\n\nNew items:\n"), F.array_join(lines, "\n"))


def category_patch(name: Column, old: Column, before: Column, after: Column) -> Column:
    change = F.when(before.isNull(), F.concat(F.lit("Added: "), after)).when(after.isNull(), F.concat(F.lit("Removed: "), before)).otherwise(F.concat(F.lit("Changed from: "), before, F.lit("\nto: "), after))
    return F.concat(F.lit(CATEGORY_PATCH + "\n\nCategory: "), name, F.lit("\n\nSummary:\n"), F.coalesce(old, F.lit("")), F.lit("\n\n"), change)
