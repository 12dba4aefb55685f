"""Copies of a record that differ in form only (problem 5).

Every record is hashed bottom-up: leaves are normalised to their letters a-z and
digits; an ordered node digests its text, an unordered one the sorted digests of its
children; the root digests the type and the node. Records meet at equal roots, and
a meeting counts only if the full canonical structures agree.

Defined results
* a null type counts as an empty one; summaries that are null, empty or without letters and digits are in no group;
* a text of fields and a plain text with the same sequence of letters and digits are copies of each other, too, and
  whatever is a copy of a copy belongs to the group;
* rows repeated under one id are one record; a null id is no record; very long texts are hashed whole;
* an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import cut, hot_join

#: Forms of groups up to which their 64-bit hashes are broadcast.
FEW = 500_000
_PARTS = "[;|\\n\\r\\x0B\\f\\x85\\u2028\\u2029]"
_FIELD = "(?s)^\\s*[^:\\s][^:]*:.*\\S.*$"


def letters(c: Column) -> Column:
    """The sequence of letters a-z and digits, case aside."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def _digest(c: Column) -> Column:
    return F.unhex(F.md5(c))


def merkle(df: DataFrame, key: str, kind: str, text: str) -> DataFrame:
    """(id, leaf, node, seq, canon): ``leaf`` is the root over the plain sequence, ``node`` the root over unordered fields, empty for plain text."""
    parts = F.filter(F.split(text, _PARTS), lambda p: p.rlike("\\S"))
    rows = df.select(F.col(key).alias("id"), letters(F.coalesce(F.col(kind), F.lit(""))).alias("kind"), letters(F.col(text)).alias("seq"), parts.alias("parts"))
    rows = rows.filter("id IS NOT NULL AND length(seq) > 0")
    fields = (F.size("parts") >= 2) & F.forall("parts", lambda p: F.regexp_replace(p, "^\\s+|\\s+$", "").rlike(_FIELD))
    children = F.array_sort(F.transform("parts", lambda p: F.md5(letters(p))))
    return rows.select(
        "id",
        _digest(F.concat_ws("|", F.lit("plain"), "kind", "seq")).alias("leaf"),
        F.when(fields, _digest(F.concat_ws("|", F.lit("fields"), "kind", F.array_join(children, "|")))).otherwise(F.unhex(F.lit(""))).alias("node"),
        F.concat_ws("|", "kind", "seq").alias("seq"),
        F.when(fields, F.concat_ws("|", "kind", F.array_join(F.array_sort(F.transform("parts", letters)), "|"))).alias("canon"),
    )


def _settle(forms: DataFrame) -> DataFrame:
    """(leaf, node, label): one label for forms joined by a leaf or a node, however long the chain.

    A leaf shared by plain and field texts is settled by one minimum; only leaves under several nodes
    need rounds, and those are few (the same letters cut into other fields).
    """
    nodes = F.when(F.length("node") > 0, F.col("node"))
    by_leaf = forms.groupBy("leaf").agg(F.min(nodes).alias("lo"), F.max(nodes).alias("hi"))
    label = forms.join(by_leaf, "leaf").withColumn("label", F.coalesce(nodes, "lo", "leaf"))
    many = cut(label.filter("lo < hi AND length(node) > 0").select("leaf", "node"), "chains")
    if many.isEmpty():
        return label.select("leaf", "node", "label")
    now = many.select("node", F.col("node").alias("at")).distinct()
    while True:
        best = many.join(now, "node").groupBy("leaf").agg(F.min("at").alias("at"))
        after = cut(many.join(best, "leaf").groupBy("node").agg(F.min("at").alias("at")), "chains")
        if after.join(now.withColumnRenamed("at", "was"), "node").filter("at < was").isEmpty():
            break
        now = after
    return label.join(now.withColumnRenamed("node", "label"), "label", "left").select("leaf", "node", F.coalesce("at", "label").alias("label"))


def _grouped(df: DataFrame, key: str, kind: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Records (id, leaf, node, seq), and their forms with first_id and n_records of the whole group.

    Equal forms collapse on the map side, so a group of any size travels as one row a partition.
    """
    rows = merkle(df, key, kind, text)
    met = cut(rows.groupBy("leaf", "node", "seq").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min("canon").alias("canon"), F.max("canon").alias("canon_hi")), "forms")
    apart = met.filter("length(node) > 0").groupBy("node").agg(F.min("canon").alias("lo"), F.max("canon_hi").alias("hi")).filter("lo != hi").select("node")
    if not apart.isEmpty():  # one digest, several structures: those are told apart by a longer digest
        wrong = apart.withColumn("wrong", F.lit(True))
        longer = lambda d: d.join(wrong, "node", "left").withColumn("node", F.when(F.col("wrong"), F.unhex(F.sha2("canon", 512))).otherwise(F.col("node"))).drop("wrong")
        met, rows = longer(met), longer(rows)
    labelled = met.join(_settle(met.select("leaf", "node").distinct()), ["leaf", "node"])
    whole = labelled.groupBy("label").agg(F.min("first").alias("first_id"), F.sum("n").alias("n_records"))
    forms = cut(labelled.select("leaf", "node", "seq", "label", "n").join(whole, "label").drop("label"), "groups")
    return rows, forms


def copies(df: DataFrame, key: str = "id", kind: str = "memory_type", text: str = "summary") -> DataFrame:
    """(first_id, copy_id): every record of a group but its first, beside the first."""
    rows, forms = _grouped(df, key, kind, text)
    many = forms.filter("n_records > 1")
    n, total = many.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n <= FEW:  # only records of groups are shuffled then; a false meeting of hashes ends in the join
        name = F.xxhash64("leaf", "node").alias("form")
        rows = rows.withColumn("form", name).join(F.broadcast(many.select(name).distinct()), "form", "left_semi")
    met = hot_join(rows.select("id", "leaf", "node", "seq"), many.select("leaf", "node", "seq", "first_id", "n"), ["leaf", "node", "seq"], "n", total)
    return met.filter("id != first_id").select("first_id", F.col("id").alias("copy_id")).distinct()


def collapsed(df: DataFrame, key: str = "id", kind: str = "memory_type", text: str = "summary") -> DataFrame:
    """(first_id, n_copies): one row per record, with the number of rows that say the same."""
    _, forms = _grouped(df, key, kind, text)
    return forms.groupBy("first_id").agg(F.max("n_records").alias("n_copies"))
