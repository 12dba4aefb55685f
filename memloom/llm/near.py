"""Near-duplicate records: all pairs of word sets above a Jaccard similarity (problem 2).

A size-aware join. Sets of at most a boundary size list their fixed-size subsets: two of
them reach the threshold exactly if they share a subset of the overlap their sizes
demand. Larger sets scan inverted lists, those of light (rare) words only; what is
left are pairs without a common light word, and those may differ in so few of
their heavy words that of as many parts as allowed differences, plus one, some part -
again a subset, of the heavy words - is the same in both; or, of half as many and so
larger parts, some part is the same up to one word. The boundaries of sizes and
of word frequencies and the kind of parts are chosen by cost, from the size and
frequency histograms, one counting pass and the words of at most SAMPLE sets.

Within a list only pairs pass whose parity sketches, of 64 and then of 128 bits, differ in no more bits
than the sets may differ in words, which no true pair fails; what passes is verified on the words.
Every step is exact. Equal sets are joined once and expanded at the end.

Defined results
* words are maximal runs of a-z and digits after lower-casing; order and repetition don't matter;
* null, empty and blank texts and texts without words are in no pair; null keys neither;
* rows repeated under one key are one record with the union of pairs; pairs come once, the smaller key first;
* lists longer than GROUP rows are split into pairs of blocks, each a task's step of its own; no list is cut short;
* very long texts are compared whole; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import ceil, comb, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.llm.expand import record_pairs
from memloom.session import cut, spread

THRESHOLD = Fraction(7, 10)
#: Costs of a row that is shuffled and of a pair that is checked, in nanoseconds, and the frequency boundaries
#: weighed: those at which a set costs so many checks on average.
ROW_COST, CHECK_COST = 2_500, 2
CHECKS = tuple(125 * 2**k for k in range(11))
#: Heavy words are broadcast, so the frequency boundary rises until there are no more than these.
HEAVY = 500_000
#: Rows of one list that meet in one step; longer ones are split. Rows of lists a worker holds at a time.
GROUP, CHUNK = 30_000, 150_000
#: Rows of lists that go to one task, about.
ROWS_A_TASK = 1_000_000
#: Lists from so many rows on are compared in blocks of rows.
LONG, BLOCK = 96, 128
#: Candidate pairs up to which the sets they need are fetched by broadcast.
FEW_PAIRS = 500_000
#: Sets whose words tell how often parts meet by chance. It only steers the cost; what is found doesn't depend on it.
SAMPLE = 1_000
#: 1 of so many rows is counted to find long lists.
COUNTED = 16
_KEYED = "key bigint, side tinyint, set bigint, size int, fa bigint, fb bigint"


def word_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, words): sorted 64-bit hashes of the distinct words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9]+"), F.lit(0)))
    hashed = F.array_sort(F.transform(words, lambda w: F.xxhash64(w)))
    return df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("id"), hashed.alias("words")).filter(F.size("words") > 0)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mult)
    return x ^ (x >> np.uint64(32))


class Plan:
    """The boundaries of one join, and what follows from them."""

    def __init__(self, threshold: Fraction, sizes: dict[int, int], counts: list[tuple[int, int]]) -> None:
        """``sizes``: sets by size; ``counts``: (frequency, words with it), ascending."""
        self.threshold = threshold
        self.slack = (1 - threshold) / (1 + threshold)  # of the summed sizes, the most two sets may differ in
        self.sets = max(1, sum(sizes.values()))
        checks, heavy, budget = 0.0, sum(w for _, w in counts), [c * self.sets for c in CHECKS]
        #: (highest frequency of a light word, number of heavy words, pair checks in lists of light words), ascending
        self.choices: list[tuple[int, int, float]] = []
        for k, (f, w) in enumerate(counts):
            checks, heavy = checks + w * f * f / 2, heavy - w
            after = checks + counts[k + 1][1] * counts[k + 1][0] ** 2 / 2 if k + 1 < len(counts) else float("inf")
            if heavy > HEAVY or not any(checks <= c < after for c in budget) and after <= budget[0]:
                continue
            if self.choices and checks > budget[-1]:
                break
            if any(checks <= c < after for c in budget) or not self.choices:
                self.choices.append((f, heavy, checks))
        self.choices = self.choices or [(0, sum(w for _, w in counts), 0.0)]
        self.light, self.heavy, _ = self.choices[0]
        # a small set may have as many subsets as it has words, so that it costs no more rows than its lists would
        self.small = max((s for s in range(1, 13) if self.subsets(s) <= s + 1), default=0)
        self.classes: list[int] = []
        self.one_off: set[tuple[int, int]] = set()
        self.rows = 0

    def choose(self, met: dict[int, dict[int, int]], lists: dict[int, int], sample: list[np.ndarray]) -> None:
        """Settle the frequency boundary, and how the heavy words of each pair of classes are cut.

        ``met``: sets by spare, ``lists``: rows of light words, for each choice; ``sample``: the ranks of the words of some sets.
        """
        best = float("inf")
        for k in sorted(met):
            light, heavy, checks = self.choices[k]
            ranks = [np.sort(r[(r >= 0) & (r < heavy)]) for r in sample]
            words = sum(map(len, ranks)) / max(1, len(ranks))
            cost, off, many = ROW_COST * lists[k] + CHECK_COST * checks, set(), lists[k]
            seen: dict[int, tuple[float, float]] = {}
            for q, n in met[k].items():
                for o, m in met[k].items():
                    r = q + o
                    if r < 0 or o < q:
                        continue
                    if r not in seen:
                        seen[r] = (_meetings(ranks, r + 1, False), _meetings(ranks, r // 2 + 1, True))
                    pairs, rows = (n * m / 2 if q == o else n * m), (n if q == o else n + m)
                    whole = ROW_COST * rows * (r + 1) + CHECK_COST * pairs * seen[r][0]
                    less = ROW_COST * rows * (r // 2 + 1 + words) + CHECK_COST * pairs * seen[r][1]
                    cost += min(whole, less)
                    many += round(rows * (r + 1 if whole <= less else r // 2 + 1 + words))
                    if less < whole:
                        off.add((q, o))
            if cost < best:
                best, self.light, self.heavy, self.classes, self.one_off, self.rows = cost, light, heavy, sorted(met[k]), off, many

    def overlap(self, a: int, b: int) -> int:
        return ceil(self.threshold / (1 + self.threshold) * (a + b))

    def wanted(self, s: int) -> range:
        """The overlaps a set of this size may need with a partner."""
        return range(ceil(self.threshold * s), s + 1)

    def subsets(self, s: int) -> int:
        return sum(comb(s, c) for c in self.wanted(s))

    def spare(self, size: np.ndarray, light: np.ndarray) -> np.ndarray:
        """The most differing heavy words of a pair without common light words is at most the sum of both sets' values."""
        p, q = self.slack.numerator, self.slack.denominator
        return -((q * light - p * size) // q)


def _meetings(ranks: list[np.ndarray], parts: int, one_off: bool) -> float:
    """How often two sets of the sample meet in a part, on average; with ``one_off`` also in what is left of it without one word."""
    n = len(ranks)
    if n < 2:
        return 0.0
    own, flat = np.repeat(np.arange(n), [len(r) for r in ranks]), np.concatenate(ranks)
    cell, word = own * parts + flat % parts, _mix(flat.astype(np.uint64) + np.uint64(1))
    content = np.zeros(n * parts, np.uint64)
    np.add.at(content, cell, word)
    keys = _mix(content + np.tile(np.arange(parts, dtype=np.uint64), n))
    if one_off:
        keys = np.concatenate([keys, _mix(content[cell] - word + (cell % parts).astype(np.uint64))])
    times = np.unique(keys, return_counts=True)[1].astype(float)
    return float((times * (times - 1)).sum() / (n * (n - 1)))


class Splitter:
    """Turns sets into rows of lists."""

    def __init__(self, plan: Plan, heavy: np.ndarray) -> None:
        self.plan, self.heavy = plan, heavy  # heavy: (hash, rank by frequency), sorted by hash

    def measure(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        words = batch.column("words")
        ends = words.offsets.to_numpy()
        flat = words.values.to_numpy()[ends[0] : ends[-1]]
        size = np.diff(ends)
        own = np.repeat(np.arange(len(size)), size)
        at = np.minimum(np.searchsorted(self.heavy[0], flat), max(0, len(self.heavy[0]) - 1))
        rank = np.where(self.heavy[0][at] == flat, self.heavy[1][at], -1) if len(self.heavy[0]) else np.full(len(flat), -1)
        return flat, size, own, np.where(rank < self.plan.heavy, rank, -1)

    def ranks(self, words: pa.Array) -> list[np.ndarray]:
        """The ranks of the heavy words of every set, -1 for a light one."""
        _, size, _, rank = self.measure(pa.RecordBatch.from_arrays([words], ["words"]))
        return np.split(rank, np.cumsum(size)[:-1]) if len(size) else []

    def classes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(choice, spare, sets, rows of lists), for every choice of the frequency boundary."""
        plan = self.plan
        for b in batches:
            _, size, own, rank = self.measure(b)
            scans = size > plan.small * float(plan.threshold)
            out = []
            for k, (_, heavy, _) in enumerate(plan.choices):
                light = np.bincount(own[(rank < 0) | (rank >= heavy)], minlength=len(size))[scans]
                q, at, n = np.unique(plan.spare(size[scans], light), return_inverse=True, return_counts=True)
                out.append((np.full(len(q), k), q, n, np.bincount(at, light, minlength=len(q)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["k", "q", "n", "rows"])

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4_000):
                yield self._rows(b.slice(lo, 4_000))

    def _rows(self, b: pa.RecordBatch) -> pa.RecordBatch:
        plan = self.plan
        flat, size, own, rank = self.measure(b)
        spare = plan.spare(size, np.bincount(own[rank < 0], minlength=len(size)))
        first = np.cumsum(size) - size
        mixed = _mix(flat.view(np.uint64))
        bit = np.uint64(1) << (mixed & np.uint64(63))
        whole = np.bitwise_xor.reduceat(bit, first)  # 64 positions for all words, and the part of half of them: together 128 positions
        half = np.bitwise_xor.reduceat(np.where(mixed >> np.uint64(6) & np.uint64(1), bit, np.uint64(0)), first)
        keys, sides, sets = [], [], []

        def put(key: np.ndarray, side: int, of: np.ndarray) -> None:
            keys.append(key)
            sides.append(np.full(len(key), side, np.int8))
            sets.append(of)

        scans = size > plan.small * float(plan.threshold)  # also small sets that a larger one can reach
        light = (rank < 0) & scans[own]
        put(_mix(mixed[light] ^ np.uint64(0x5851F42D4C957F2D)), 0, own[light])
        for i in np.flatnonzero((size <= plan.small) & (size > 1)):
            ws = np.sort(mixed[first[i] : first[i] + size[i]])
            for c in plan.wanted(int(size[i])):
                some = np.array(list(combinations(range(int(size[i])), c)))
                put(_mix(_mix(ws)[some].sum(axis=1, dtype=np.uint64) + np.uint64(c)), 0, np.full(len(some), i))
        heavy = np.flatnonzero((rank >= 0) & scans[own])
        for q in np.unique(spare[scans]):
            of = np.flatnonzero(scans & (spare == q))
            place = np.full(len(size), -1)
            place[of] = np.arange(len(of))
            mine = heavy[spare[own[heavy]] == q]
            for other in plan.classes:
                spare_words = int(q) + other
                if spare_words < 0:
                    continue
                one_off = (min(q, other), max(q, other)) in plan.one_off
                parts = spare_words // 2 + 1 if one_off else spare_words + 1
                side = 0 if q == other else 1 if q < other else 2
                cell = place[own[mine]] * parts + rank[mine] % parts
                content = np.zeros(len(of) * parts, np.uint64)
                np.add.at(content, cell, mixed[mine])
                count = np.bincount(cell, minlength=len(content))
                # if every part has a word more than may be missing from it, the part that meets isn't empty, and empty ones aren't needed
                empty_too = (count.reshape(-1, parts) <= one_off).any(axis=1)
                label = _mix(np.uint64((min(q, other) & 0xFFFF) << 32 | (max(q, other) & 0xFFFF) << 16) + np.arange(parts, dtype=np.uint64))
                key = _mix(_mix(content).reshape(-1, parts) + label[None, :])
                take = (count.reshape(-1, parts) > 0) | empty_too[:, None]
                put(key[take], side, np.repeat(of, parts).reshape(-1, parts)[take])
                if one_off:  # a part that differs in one word is the same without it
                    left = (count[cell] > 1) | empty_too[cell // parts]
                    put(_mix(_mix(content[cell] - mixed[mine]) + label[cell % parts])[left], side, own[mine][left])
        of = np.concatenate(sets)
        ids = b.column("set").to_numpy()
        cols = [np.concatenate(keys).view(np.int64), np.concatenate(sides), ids[of], size[of].astype(np.int32), whole[of].view(np.int64), half[of].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "side", "set", "size", "fa", "fb"])


def _meet(slack: Fraction):  # noqa: ANN202
    """Pairs within each list, rows sorted by key and size."""
    p, q = slack.numerator, slack.denominator

    def kept(i, j, side, sets, size, fa, fb):  # noqa: ANN001, ANN202
        whole, half = fa[i] ^ fa[j], fb[i] ^ fb[j]
        bits = np.bitwise_count(half).astype(np.int64) + np.bitwise_count(whole ^ half)
        ok = (bits * q <= p * (size[i] + size[j])) & ((side[i] == 0) | (side[i] != side[j])) & (sets[i] != sets[j])
        return sets[i[ok]], sets[j[ok]]

    def short(key, side, sets, size, fa, fb):  # noqa: ANN001, ANN202
        """Rows k apart are compared for all lists at once."""
        i, k = np.arange(len(key) - 1), 0
        while len(i):
            k += 1
            i = i[i + k < len(key)]
            i = i[key[i] == key[i + k]]
            j = i + k
            near = np.bitwise_count(fa[i] ^ fa[j]).astype(np.int64) * q <= p * (size[i] + size[j])
            yield kept(i[near], j[near], side, sets, size, fa, fb)

    def long(side, sets, size, fa, fb):  # noqa: ANN001, ANN202
        """A block of rows against the rest of its list, whose sizes ascend."""
        for lo in range(0, len(sets), BLOCK):
            hi = min(lo + BLOCK, len(sets))
            bound = np.minimum(p * (size[hi - 1] + size[lo:]) // q, 64).astype(np.uint8)
            i, j = np.nonzero(np.bitwise_count(fa[lo:hi, None] ^ fa[None, lo:]) <= bound[None, :])
            up = j > i
            yield kept(lo + i[up], lo + j[up], side, sets, size, fa, fb)

    def pairs(key, *cols) -> pa.RecordBatch:  # noqa: ANN001
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        runs = np.diff(edges)
        is_long = np.repeat(runs >= LONG, runs)
        found = list(short(key[~is_long], *(c[~is_long] for c in cols)))
        for e, n in zip(edges[:-1][runs >= LONG], runs[runs >= LONG], strict=True):
            found += long(*(c[e : e + n] for c in cols))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if len(rest[0]) < CHUNK:
                continue
            end = int(np.searchsorted(rest[0], rest[0][-1], "left"))  # the last list may go on
            if end:
                yield _checked(pairs, [c[:end] for c in rest])
                rest = [c[end:] for c in rest]
        if rest is not None and len(rest[0]):
            yield _checked(pairs, rest)

    return run


def _checked(pairs, cols: list[np.ndarray]) -> pa.RecordBatch:  # noqa: ANN001
    """Lists of one row can't give a pair; the others go on."""
    key = cols[0]
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    keep = same[1:] | same[:-1]
    key, side, sets, size, fa, fb = (c[keep] for c in cols)
    if len(key) < 2:
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["a", "b"])
    return pairs(key, side, sets, size.astype(np.int64), fa.view(np.uint64), fb.view(np.uint64))


def _split_long(rows: DataFrame) -> DataFrame:
    """Rows of long lists go to pairs of blocks instead; there are fewer than rows / GROUP such lists."""
    seen = rows.filter(F.pmod(F.xxhash64("set"), F.lit(COUNTED)) == 0).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP // COUNTED)
    long = [(r.key, -(-r.n * COUNTED // GROUP) + 1) for r in seen.toLocalIterator()]
    if not long:
        return rows
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame(long, "key bigint, blocks int"))
    joined = rows.join(table, "key", "left")
    mine = F.pmod(F.xxhash64("set", F.lit(7)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    apart = joined.filter("blocks IS NOT NULL").withColumn("mine", mine).withColumn("other", other)
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    own = F.col("side") == 0
    first = F.when(own, lo).when(F.col("side") == 1, F.col("mine")).otherwise(F.col("other"))
    second = F.when(own, hi).when(F.col("side") == 1, F.col("other")).otherwise(F.col("mine"))
    side = F.when(own & (lo == hi), 0).when(own, F.when(F.col("mine") == lo, 1).otherwise(2)).otherwise(F.col("side")).cast("tinyint")
    apart = apart.select(F.xxhash64("key", first, second).alias("key"), side.alias("side"), "set", "size", "fa", "fb")
    return joined.filter("blocks IS NULL").drop("blocks").unionByName(apart)


def similar_sets(sets: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) of different sets (set, words) that reach the threshold; a < b."""
    spark = sets.sparkSession
    sizes = {r.s: r.n for r in sets.groupBy(F.size("words").alias("s")).agg(F.count("*").alias("n")).collect()}
    frequency = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    frequency = cut(frequency, "frequency")
    # frequencies are counted in steps of a 32nd octave, so the histogram is about a thousand rows
    step = F.pow(F.lit(2.0), F.floor(F.log2("f") * 32 + 1) / 32)
    counts = [(int(r.f), r.n) for r in frequency.groupBy(step.alias("f")).agg(F.count("*").alias("n")).orderBy("f").collect()]
    plan = Plan(threshold, sizes, counts)
    found = frequency.filter(F.col("f") > plan.light).withColumn("step", step).orderBy(F.desc("step"), "w").select("w").toPandas()["w"].to_numpy(np.int64)
    order = np.argsort(found)
    splitter = Splitter(plan, np.stack([found[order], np.arange(len(found))[order]]))
    met: dict[int, dict[int, int]] = {}
    lists: dict[int, int] = {}
    for r in sets.mapInArrow(splitter.classes, "k bigint, q bigint, n bigint, rows bigint").groupBy("k", "q").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")).collect():
        met.setdefault(r.k, {})[r.q] = r.n
        lists[r.k] = lists.get(r.k, 0) + r.rows
    some = sets.orderBy(F.xxhash64("set"), "set").select("words").limit(SAMPLE).toArrow().combine_chunks()["words"]
    ranks = [r for c in some.chunks for r in splitter.ranks(c)]
    plan.choose(met, lists, ranks)
    rows = _split_long(sets.mapInArrow(splitter.rows, _KEYED))
    met = spread(rows, "key", plan.rows // ROWS_A_TASK).sortWithinPartitions("key", "size").mapInArrow(_meet(plan.slack), "a bigint, b bigint").distinct()
    met = cut(met, "candidates")
    n = met.count()
    ids = met.select(F.col("a").alias("set")).union(met.select("b")).distinct()
    needed = sets.join(F.broadcast(ids) if n <= FEW_PAIRS else ids, "set", "left_semi")
    needed = cut(needed, "verify") if n <= FEW_PAIRS else needed
    both = met.join(needed.select(F.col("set").alias("a"), F.col("words").alias("wa")), "a").join(needed.select(F.col("set").alias("b"), F.col("words").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    union = F.size("wa") + F.size("wb") - common
    ok = common * threshold.denominator >= union * threshold.numerator
    return both.filter(ok & (F.size("wa") > 0)).select("a", "b", (common / union).alias("jaccard"))


def _collapsed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, set); different sets (set, words), each with the words of its smallest id; and those with copies (set, first, n).

    Sets are named by a hash and told apart by 128 bits; only the copies are ever shuffled, without their words.
    """
    each = cut(word_sets(df, key, text).select("id", F.xxhash64("words").alias("set"), F.xxhash64("words", F.lit(1)).alias("twin"), "words"), "words")
    members = each.select("id", "set", "twin")
    copies = cut(members.distinct().groupBy("set", "twin").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "copies")
    few = copies.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS
    sets = each.join(F.broadcast(copies) if few else copies, ["set", "twin"], "left").filter("first IS NULL OR id = first")
    return members.select("id", "set"), sets.select("set", "words"), copies.select("set", "first", "n")


def _linked_members(members: DataFrame, pairs: DataFrame, copies: DataFrame) -> tuple[DataFrame, bool]:
    """Members (id, set) of the sets that are in a pair or have copies, and whether those sets are few."""
    linked = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).union(copies.select("set")).distinct()
    few = linked.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS
    return cut(members.join(F.broadcast(linked) if few else linked, "set", "left_semi").distinct(), "members"), few


def near_pairs(df: DataFrame, key: str = "id", text: str = "summary", threshold: Fraction = THRESHOLD) -> DataFrame:
    """(id_a, id_b): every pair of records that reaches the threshold."""
    members, sets, copies = _collapsed(df, key, text)
    pairs = cut(similar_sets(sets, threshold).select("a", "b"), "pairs")
    of, _ = _linked_members(members, pairs, copies)
    return record_pairs(pairs, of.withColumnRenamed("set", "of"))


def near_classes(df: DataFrame, key: str = "id", text: str = "summary", threshold: Fraction = THRESHOLD) -> DataFrame:
    """(id, class_id, n_links): for every record with words the smallest id of its class, and how many records it is linked to."""
    members, sets, copies = _collapsed(df, key, text)
    pairs = cut(similar_sets(sets, threshold).select("a", "b"), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of, few = _linked_members(members, pairs, copies)
    names = cut(of.groupBy("set").agg(F.min("id").alias("first"), F.count("*").alias("n")), "names")
    linked = cut(both.join(names.select(F.col("set").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("links")), "links")
    label = linked.select(F.col("a").alias("set")).join(names.select("set", F.col("first").alias("label")), "set")
    while True:  # every round halves the longest chain: a neighbour's label, then the label's label
        near = both.join(label.withColumnRenamed("set", "b"), "b").groupBy(F.col("a").alias("set")).agg(F.min("label").alias("near"))
        hop = cut(label.join(near, "set").select("set", F.least("label", "near").alias("label"), F.col("label").alias("was")), "labels")
        owner = names.select(F.col("first").alias("label"), F.col("set").alias("at")).join(hop.select(F.col("set").alias("at"), F.col("label").alias("far")), "at").drop("at")
        after = cut(hop.join(owner, "label", "left").select("set", F.least("label", "far").alias("label"), "was"), "labels")
        if after.filter("label < was").isEmpty():
            break
        label = after.drop("was")
    info = names.join(label.select("set", "label"), "set", "left").join(linked.withColumnRenamed("a", "set"), "set", "left")
    info = info.select("set", F.coalesce("label", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = members.distinct().join(F.broadcast(info) if few else info, "set", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
