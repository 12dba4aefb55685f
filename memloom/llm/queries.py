"""Queries of the problems tagged llm, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import abuse, copies, leaks, near, neighbours, personal, tokenise
from memloom.session import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items with nearly the same words."""
    return near.near_pairs(load(spark, d, "memory_items"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of every item, and its number of links."""
    return near.near_classes(load(spark, d, "memory_items"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of items and resources with nearly the same vector."""
    return neighbours.similar_pairs([load(spark, d, "memory_items"), load(spark, d, "resources")])


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar items or resources of every fiftieth by id hash."""
    return neighbours.nearest([load(spark, d, "memory_items"), load(spark, d, "resources")])


def _texts(spark: SparkSession, d: str) -> DataFrame:
    turns = load(spark, d, "conv1").select(F.lit("conv1").alias("tbl"), F.expr("conv_id || ':' || turn").alias("rec_id"), F.col("content").alias("text"))
    return turns.unionByName(load(spark, d, "memory_items").select(F.lit("memory_items").alias("tbl"), F.col("id").alias("rec_id"), F.col("summary").alias("text")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The kinds of personal data in every message and item."""
    return personal.report(_texts(spark, d), ["tbl", "rec_id"], "text")


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every message and item with placeholders for personal data."""
    return personal.masked(_texts(spark, d), "text", b"not a secret: this key is for test data")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that repeat another item in another form."""
    return copies.copies(load(spark, d, "memory_items"))


def p5_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct item with the number of its copies."""
    return copies.collapsed(load(spark, d, "memory_items"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenise.encode(load(spark, d, "documents"), "doc_id", "text")


def p7_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and the longest document per source."""
    docs = load(spark, d, "documents")
    n = tokenise.encode(docs, "doc_id", "text").select("doc_id", F.size("ids").alias("n"))
    return n.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with twelve words of an item, word for word."""
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "benchmark"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with twelve words of an item, up to two words changed, left out or put in."""
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "benchmark"), edits=2)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """For every leaked item the number of documents it leaked into."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return abuse.score(docs, *abuse.train(docs, load(spark, d, "labels")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scored(spark, d).filter("abusive").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, abusive documents and their share."""
    by = load(spark, d, "documents").select("doc_id", "source").join(_scored(spark, d), "doc_id").groupBy("source")
    return by.agg(F.count("*").alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("int")).alias("rate"))


_P2 = """
WITH s AS (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]+'))) AS w FROM memory_items WHERE summary IS NOT NULL),
t AS (SELECT id, len(w) AS n, unnest(w) AS t FROM s WHERE len(w) > 0),
o AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM o WHERE 10 * o >= 7 * (na + nb - o)
"""
_P3 = """
WITH v AS (SELECT id, embedding::DOUBLE[] AS e FROM (SELECT id, embedding FROM memory_items UNION ALL SELECT id, embedding FROM resources)
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0)
SELECT a.id AS id_a, b.id AS id_b FROM v a JOIN v b ON a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
"""
_P8 = """
WITH w AS (SELECT 0 AS side, doc_id AS k, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[a-z0-9]+') FROM benchmark),
p AS (SELECT side, k, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12),
g AS (SELECT DISTINCT side, k, array_to_string(ws[i:i + 11], ' ') AS g FROM p),
hit AS (SELECT DISTINCT a.k AS doc_id, b.k AS item_id FROM g a JOIN g b USING (g) WHERE a.side = 0 AND b.side = 1)
"""
_P5 = """
WITH r AS (
  SELECT id, regexp_replace(lower(coalesce(memory_type, '')), '[^a-z0-9]+', '', 'g') AS kind, regexp_replace(lower(summary), '[^a-z0-9]+', '', 'g') AS seq,
    list_filter(string_split_regex(summary, '[;|\\n\\r\\x0B\\f\\x{85}\\x{2028}\\x{2029}]'), lambda p: regexp_matches(p, '\\S')) AS parts
  FROM memory_items WHERE id IS NOT NULL),
f AS (
  SELECT id, kind || '|' || seq AS leaf,
    CASE WHEN len(parts) >= 2 AND len(list_filter(parts, lambda p: NOT regexp_full_match(trim(p, ' \t\n\r\f'), '(?s)[^:\\s][^:]*:.*\\S.*'))) = 0
      THEN kind || '||' || list_aggregate(list_sort(list_transform(parts, lambda p: regexp_replace(lower(p), '[^a-z0-9]+', '', 'g'))), 'string_agg', '|') END AS node
  FROM r WHERE length(seq) > 0),
l AS (SELECT id, coalesce(node, min(node) OVER (PARTITION BY leaf), leaf) AS label FROM f),
g AS (SELECT id, min(id) OVER (PARTITION BY label) AS first_id, count(*) OVER (PARTITION BY label) AS n FROM l)
"""

QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p3_found": p3_found, "p3_nearest": p3_nearest, "p4_found": p4_found, "p4_masked": p4_masked, "p5_found": p5_found, "p5_collapsed": p5_collapsed, "p7_ids": p7_ids, "p7_by_source": p7_by_source, "p8_found": p8_found, "p8_near": p8_near, "p8_items": p8_items, "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL = {
    "p3_found": _P3,
    "p2_found": _P2,
    "p5_found": _P5 + "SELECT DISTINCT first_id, id AS copy_id FROM g WHERE id != first_id",
    "p8_found": _P8 + "SELECT doc_id, item_id FROM hit",
    "p8_items": _P8 + "SELECT item_id, count(*) AS n_docs FROM hit GROUP BY 1",
    "p5_collapsed": _P5 + "SELECT first_id, max(n) AS n_copies FROM g GROUP BY 1",
}
