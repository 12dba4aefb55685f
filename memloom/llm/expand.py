"""Pairs of classes of equal records become pairs of records.

A class of more than BLOCK records is cut into blocks by a hash; every pair of blocks is a group of its
own, of at most about BLOCK x BLOCK results, so that a class that holds a third of all rows is spread over
the cluster. Nothing is left out: each block of one class meets each block of the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.session import cut

#: Records of a class from which it is cut into blocks of about so many.
BLOCK = 2_000
#: Classes of that size up to which their sizes are broadcast.
FEW = 500_000


def record_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), the smaller id first, each once: records of the classes of ``pairs`` (a, b), a != b, and those of one class.

    ``members`` (id, of) has each record of a class once.
    """
    large = cut(members.groupBy("of").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"), "large")
    n = large.count()
    within = lambda m: m.select(F.col("id").alias("x"), "of").join(m.select(F.col("id").alias("y"), "of"), "of").filter("x < y").select("x", "y")
    a, b = members.select(F.col("id").alias("x"), F.col("of").alias("a")), members.select(F.col("id").alias("y"), F.col("of").alias("b"))
    if not n:
        met = pairs.join(a, "a").join(b, "b").select("x", "y").unionByName(within(members))
    else:
        sizes = F.broadcast(large) if n <= FEW else large
        blocks = lambda d, k: d.join(sizes.select(F.col("of").alias(k), F.col("blocks").alias(f"n{k}")), k, "left").withColumn(f"n{k}", F.coalesce(f"n{k}", F.lit(1)))
        sized = blocks(blocks(pairs.select("a", "b"), "a"), "b").unionByName(large.select(F.col("of").alias("a"), F.col("of").alias("b"), F.col("blocks").alias("na"), F.col("blocks").alias("nb")))
        plain = sized.filter("na = 1 AND nb = 1").join(a, "a").join(b, "b").select("x", "y")
        cells = sized.filter("na > 1 OR nb > 1").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).filter("a != b OR i <= j")
        own = lambda d, k: blocks(d, k).withColumn("i" if k == "a" else "j", F.pmod(F.xxhash64("x" if k == "a" else "y"), F.col(f"n{k}")).cast("int")).drop(f"n{k}")
        cells = cells.select("a", "b", "i", "j")
        # each side goes to its cells first, so that no row of a cell meets more than the block opposite
        left, right = cells.join(own(a, "a"), ["a", "i"]), cells.join(own(b, "b"), ["b", "j"])
        apart = left.join(right, ["a", "b", "i", "j"]).filter("a != b OR i < j OR x < y").select("x", "y")
        met = plain.unionByName(apart).unionByName(within(members.join(sizes, "of", "left_anti")))
    return met.filter("x != y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
