"""Extraction answers in XML, read by a hardened parser in Arrow batches."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOTS = ("item", "profile", "behaviors", "events", "knowledge", "skills")
ENTRIES = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("when_to_use", T.StringType())]))


def parse_entries(raw: str | None) -> list[dict]:
    """Memories with a content and at least one category below the first root that is present; [] for what isn't XML.

    Document types and entities are refused, so an answer can't expand without bound.
    """
    if not raw or "<!" in raw:
        return []
    root = next((r for r in ROOTS if f"<{r}>" in raw and f"</{r}>" in raw), None)
    if root is None:
        return []
    part = raw[raw.index(f"<{root}>") : raw.rindex(f"</{root}>") + len(root) + 3].replace("&", "&amp;")
    try:
        tree = ET.fromstring(part)
    except ET.ParseError:
        return []
    out = []
    for m in tree.iter("memory"):
        content = (m.findtext("content") or "").strip()
        names = [n for c in m.iter("category") if (n := (c.text or "").strip())]
        if content and names:
            out.append({"content": content, "categories": names, "when_to_use": (m.findtext("when_to_use") or "").strip() or None})
    return out


@F.pandas_udf(ENTRIES)
def entries_of_xml(raw: pd.Series) -> pd.Series:
    return raw.map(parse_entries)


def strip_content_tags(markdown: str) -> str:
    return re.sub(r"</?content>", "", markdown)
