"""References to records that do not exist (problem 1).

Parents become sorted arrays, one per range of a 64-bit key hash; reference
rows are routed to their range, salted where a range is hot, and each partition
probes the array of its range with whole Arrow batches by binary search.

Defined results
* a null or blank reference is no reference; ids agree without surrounding white space, dashes and case;
* a parent without created_at counts as always there, unless any deletion of it is recorded;
* a tombstone without deleted_at or with a null id deletes nothing;
* a reference without created_at can only dangle because its target is missing or deleted;
* repeated rows give one result row; empty tables give an empty parent set (all references dangle) or an empty result;
* a null row id is kept as a null rec_id (one row per table and field).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.session import BROADCAST_ROWS, cut, spread

#: Parents in one sorted array, and references probed against one copy of it.
RANGE_PARENTS = 50_000
RANGE_REFERENCES = 200_000
ALWAYS = -(2**63)
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


@dataclass(frozen=True)
class Reference:
    """``df[field]`` of table ``tbl`` points at records of the target ``to``."""

    df: DataFrame
    tbl: str
    field: str
    to: str


def canonical_id(c: Column) -> Column:
    """An id without surrounding white space, dashes and letter case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", ""), "-", ""))


def is_reference(c: Column) -> Column:
    return F.length(F.regexp_replace(c, _SPACE, "")) > 0


def parents_alive(targets: dict[str, DataFrame], deletions: DataFrame, entities: dict[str, str]) -> DataFrame:
    """(target, key, alive_us): from when a record is there and not deleted at or after that time.

    ``entities`` names the entity of ``deletions`` for each target that can be deleted.
    """
    rows = None
    for name, df in targets.items():
        part = df.select(F.lit(name).alias("target"), canonical_id(df["id"]).alias("key"), F.unix_micros(df["created_at"]).alias("made"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.filter("key IS NOT NULL")
    kind = F.create_map(*[F.lit(x) for pair in ((v, k) for k, v in entities.items()) for x in pair])
    gone = (
        deletions.select(kind[F.col("entity")].alias("target"), canonical_id(F.col("record_id")).alias("key"), F.unix_micros("deleted_at").alias("gone"))
        .filter("target IS NOT NULL AND key IS NOT NULL AND gone IS NOT NULL")
        .groupBy("target", "key")
        .agg(F.max("gone").alias("gone"))
    )
    made = F.coalesce(F.col("made"), F.lit(ALWAYS))
    return (
        rows.join(gone, ["target", "key"], "left")
        .filter(F.col("gone").isNull() | (made > F.col("gone")))
        .groupBy("target", "key")
        .agg(F.min(made).alias("alive_us"))
    )


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (range, salt, parent first, hash): each array is built once, then probed batch by batch."""
    at, building, h, keys, alive = None, [], np.empty(0, np.int64), None, np.empty(0, np.int64)
    schema = None

    def close() -> None:
        nonlocal h, keys, alive, building
        if building:
            t = pa.Table.from_batches(building).combine_chunks()
            h, keys, alive = t["h"].to_numpy(), t["key"].combine_chunks(), t["us"].to_numpy()
            building = []

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        kind = batch.column("ref").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])])
        for lo, hi in zip(edges, [*edges[1:], len(cell)], strict=True):
            part = batch.slice(int(lo), int(hi - lo))
            if cell[lo] != at:
                at, building, h, keys, alive = cell[lo], [], np.empty(0, np.int64), None, np.empty(0, np.int64)
            if not kind[lo]:
                building.append(part.select(["h", "key", "us"]))
                continue
            close()
            ok = _present(part, h, keys, alive)
            out = part.filter(pa.array(~ok)).select(["tbl", "field", "rec_id", "us"])
            schema = out.schema
            if out.num_rows:
                yield out
    if schema is None:
        yield from ()


def _present(part: pa.RecordBatch, h: np.ndarray, keys: pa.Array | None, alive: np.ndarray) -> np.ndarray:
    want, us = part.column("h").to_numpy(), part.column("us")
    when = us.fill_null(2**63 - 1).to_numpy()
    ok = np.zeros(len(want), bool)
    if not len(h):
        return ok
    pos, todo = np.searchsorted(h, want, "left"), np.arange(len(want))
    while len(todo):  # more than one turn only where two keys share a 64-bit hash
        todo = todo[pos[todo] < len(h)]
        todo = todo[h[pos[todo]] == want[todo]]
        if not len(todo):
            break
        same = pc.equal(keys.take(pa.array(pos[todo])), part.column("key").take(pa.array(todo))).to_numpy(zero_copy_only=False).astype(bool)
        hit = todo[same]
        ok[hit] = alive[pos[hit]] <= when[hit]
        todo = todo[~same]
        pos[todo] += 1
    return ok


def dangling(references: list[Reference], targets: dict[str, DataFrame], deletions: DataFrame, entities: dict[str, str]) -> DataFrame:
    """(tbl, field, rec_id, created_at) of every reference that dangles, each once."""
    alive = cut(parents_alive(targets, deletions, entities).withColumn("h", F.xxhash64("target", "key")), "alive")
    spark = alive.sparkSession
    n_ranges = max(1, -(-alive.count() // RANGE_PARENTS))
    width = 2**64 // n_ranges + 1
    # equal ranges of a uniform hash need no sampling; the arithmetic stays inside 64 bits by halving first
    at = F.floor((F.shiftright(F.col("h"), 1) + F.lit(2**62)) / F.lit(width / 2)).cast("int")
    rng = F.least(F.greatest(at, F.lit(0)), F.lit(n_ranges - 1))

    rows = None
    for r in references:
        c = r.df[r.field]
        part = r.df.filter(is_reference(c)).select(
            F.lit(r.tbl).alias("tbl"), F.lit(r.field).alias("field"), r.df["id"].alias("rec_id"), canonical_id(c).alias("key"),
            F.xxhash64(F.lit(r.to), canonical_id(c)).alias("h"), F.unix_micros(r.df["created_at"]).alias("us"),
        )
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("range", rng)
    salts = cut(rows.groupBy("range").agg(F.ceil(F.count("*") / RANGE_REFERENCES).cast("int").alias("salts")), "salts")
    cells = salts.agg(F.sum("salts")).first()[0] or 1
    small = n_ranges <= BROADCAST_ROWS
    salts = F.broadcast(salts) if small else salts
    refs = rows.join(salts, "range").withColumn("salt", F.pmod(F.xxhash64("rec_id", "field"), F.col("salts")).cast("int"))
    copies = alive.withColumn("range", rng).join(salts, "range").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    cell = (F.col("range").cast("long") * F.lit(2**31) + F.col("salt")).alias("cell")
    none = F.lit(None).cast("string")
    both = copies.select(cell, F.lit(False).alias("ref"), "h", "key", F.col("alive_us").alias("us"), none.alias("tbl"), none.alias("field"), none.alias("rec_id")).unionByName(
        refs.select(cell, F.lit(True).alias("ref"), "h", "key", "us", "tbl", "field", "rec_id")
    )
    ordered = spread(both, "cell", cells).sortWithinPartitions("cell", "ref", "h")
    found = ordered.mapInArrow(_probe, "tbl string, field string, rec_id string, us bigint")
    return found.groupBy("tbl", "field", "rec_id").agg(F.min("us").alias("us")).select("tbl", "field", "rec_id", F.timestamp_micros("us").alias("created_at"))


def by_period(found: DataFrame) -> DataFrame:
    """Dangling references per table, field and month of the referring row's created_at."""
    return found.groupBy("tbl", "field", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n_dangling"))
