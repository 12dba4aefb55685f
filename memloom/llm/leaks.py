"""Evaluation passages inside training text (problem 8).

Texts are sequences of words, a passage is a window of an item. With no edits allowed, windows of
documents are looked up by a bucket of a walk over them, and equal ones always meet. With edits, a passage
is cut into one part more than edits: some part is left as it is, wherever words are changed, left out or put
in. Every place in a document with a part's words is a candidate, and the words on either side are verified by edit
distance to any length of text there. Nothing is missed either way.

The item side is a stated set. It is read in blocks of at most BLOCK_WORDS words, so what
a worker holds is bounded; documents are passed once per block, without a shuffle.

Defined results
* words are maximal runs of a-z and digits after lower-casing; items of fewer words than a window match nothing, nor do documents of fewer than that less the edits;
* null and empty texts and null keys match nothing; an item or document given twice gives one result row;
* one document row per task step, so a source or copy group of any size needs no shuffle; very long texts are read whole;
* empty tables give an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
#: Independent walks, tables of sampled positions for each, positions in a sample, and the seed of them all.
WALKS, TABLES, SAMPLED, SEED = 8, 3, 5, 20_240_131
#: Words of items held by a worker at a time.
BLOCK_WORDS = 2_000_000
_WORD = re.compile("[a-z0-9]+")
_OUTSIDE = -1


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits between each row of ``a`` and all beginnings of that of ``b``."""
    n, m = a.shape[1], b.shape[1]
    before = np.broadcast_to(np.arange(m + 1), (len(a), m + 1)).copy()
    for i in range(n):
        now = np.empty_like(before)
        now[:, 0] = i + 1
        cost = a[:, i : i + 1] != b
        for j in range(m):
            now[:, j + 1] = np.minimum(np.minimum(now[:, j], before[:, j + 1]) + 1, before[:, j] + cost[:, j])
        before = now
    return before


def edit_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits between each row of ``a`` and of ``b``."""
    return _last_row(a, b)[:, b.shape[1]]


def _mixed(rows: np.ndarray) -> np.ndarray:
    """One number for each row."""
    h = np.zeros(len(rows), np.int64)
    for column in rows.T:
        h = (h ^ (column.astype(np.int64) + 3)) * 0x1E3779B97F4A7C15
        h ^= h >> 29
    return h


class PassageIndex:
    """Windows of a block of items, by walk bucket."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int = WINDOW, edits: int = 0) -> None:
        self.window, self.edits = window, edits
        rng = np.random.default_rng(SEED)
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.code = {w: i for i, w in enumerate(vocabulary)}
        steps = 3 * window
        walks, tables = (WALKS, TABLES) if edits else (1, 1)
        self.moves = rng.integers(0, 2, (walks, steps, len(vocabulary) + 2), dtype=np.int8)  # the last two: the end and outside words
        self.at = np.sort(np.stack([[rng.choice(2 * window, SAMPLED, replace=False) for _ in range(tables)] for _ in range(walks)]))
        self.mult = rng.integers(1, 2**62, (walks, tables, SAMPLED), dtype=np.int64) | 1
        rows, own = [], []
        for key, ws in items:
            ids = [self.code[w] for w in ws]
            for i in range(len(ids) - window + 1):
                rows.append(ids[i : i + window])
                own.append(key)
        self.windows = np.array(rows, np.int32).reshape(-1, window)
        self.own = np.array(own, object)
        if not 0 <= edits < window:
            raise ValueError("a passage needs more words than edits")
        cuts = np.linspace(0, window, edits + 2).astype(int)
        self.parts = list(zip(cuts[:-1].tolist(), np.diff(cuts).tolist(), strict=True))

    @cached_property
    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted buckets of the windows, and whose they are."""
        return [(b[o], o) for b in self.buckets(self.windows) for o in [np.argsort(b, kind="stable")]]

    @cached_property
    def part_tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same of each part of the windows."""
        return [(b[o], o) for at, n in self.parts for b in [_mixed(self.windows[:, at : at + n])] for o in [np.argsort(b, kind="stable")]]

    def buckets(self, windows: np.ndarray) -> list[np.ndarray]:
        """The walks of every window, and one bucket for each sample of their positions."""
        n, w = windows.shape
        padded, rows, out = np.concatenate([windows, np.full((n, 1), _OUTSIDE - 1, windows.dtype)], axis=1), np.arange(n), []
        for moves, samples, mults in zip(self.moves, self.at, self.mult, strict=True):
            at = np.zeros(n, np.int64)
            walk = np.empty((int(samples.max()) + 1, n), np.int64)
            for step in range(len(walk)):
                walk[step] = here = padded[rows, at]
                at = np.minimum(at + moves[step, here], w)
            for where, mult in zip(samples, mults, strict=True):
                h = np.zeros(n, np.int64)
                for p, m in zip(where, mult, strict=True):
                    h = (h ^ (walk[p] + 3)) * m
                    h ^= h >> 29
                out.append(h)
        return out

    def search(self, docs: list[list[str]]) -> set[tuple[int, int]]:
        """(document number, window number) of windows that the document has within the allowed edits."""
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        total, w = int(size.sum()), self.window
        if total < w - self.edits or not len(self.windows):
            return set()
        get = self.code.get
        flat = np.fromiter((get(x, _OUTSIDE) for d in docs for x in d), np.int32, total)
        ends = np.cumsum(size)
        doc = np.repeat(np.arange(len(docs)), size)
        outside = np.concatenate([[0], np.cumsum(flat == _OUTSIDE)])
        if self.edits:
            return self._edited(flat, doc, ends, outside)
        start = np.arange(total - w + 1)
        start = start[(outside[start + w] == outside[start]) & (start + w <= ends[doc[start]])]
        found: set[tuple[int, int]] = set()
        for lo in range(0, len(start), 200_000):
            found |= self._meet(flat, doc, start[lo : lo + 200_000])
        return found

    def _edited(self, flat: np.ndarray, doc: np.ndarray, ends: np.ndarray, outside: np.ndarray) -> set[tuple[int, int]]:
        """Places of an unchanged part of a window, and what is around them."""
        around = self.window + self.edits
        padded = np.concatenate([np.full(around, _OUTSIDE, flat.dtype), flat, np.full(around, _OUTSIDE, flat.dtype)])
        owner = np.concatenate([np.full(around, -1), doc, np.full(around, -1)])
        found: set[tuple[int, int]] = set()
        for (at, n), (keys, order) in zip(self.parts, self.part_tables, strict=True):
            start = np.arange(max(0, len(flat) - n + 1))
            start = start[(outside[start + n] == outside[start]) & (start + n <= ends[doc[start]])]
            for some in range(0, len(start), 200_000):
                place = start[some : some + 200_000]
                bucket = _mixed(flat[place[:, None] + np.arange(n)])
                lo, many = np.searchsorted(keys, bucket, "left"), np.searchsorted(keys, bucket, "right")
                many -= lo
                last = np.cumsum(many)
                for first in range(0, int(last[-1]), 100_000):
                    pair = np.arange(first, min(first + 100_000, int(last[-1])))
                    mine = np.searchsorted(last, pair, "right")
                    theirs = order[lo[mine] + pair - (last[mine] - many[mine])]
                    here = place[mine]
                    ok = self._around(padded, owner, here + around, theirs, at, n) <= self.edits
                    found |= set(zip(doc[here[ok]].tolist(), theirs[ok].tolist(), strict=True))
        return found

    def _around(self, padded: np.ndarray, owner: np.ndarray, place: np.ndarray, theirs: np.ndarray, at: int, n: int) -> np.ndarray:
        """The least edits of windows whose part at ``at`` is in the text at ``place``; more than allowed if it isn't."""
        window, mine = self.windows[theirs], owner[place][:, None]

        def text(where: np.ndarray) -> np.ndarray:
            # a word beyond the text's ends costs as much as one left out
            return np.where(owner[where] == mine, padded[where], _OUTSIDE)

        left, right = at, self.window - at - n
        same = (padded[place[:, None] + np.arange(n)] == window[:, at : at + n]).all(axis=1)
        before = _last_row(window[:, :at][:, ::-1], text(place[:, None] - 1 - np.arange(left + self.edits))).min(axis=1)
        after = _last_row(window[:, at + n :], text(place[:, None] + n + np.arange(right + self.edits))).min(axis=1)
        return np.where(same, before + after, self.edits + 1)

    def _meet(self, flat: np.ndarray, doc: np.ndarray, start: np.ndarray) -> set[tuple[int, int]]:
        """Windows of one length at ``start``; all that are equal, most of those within the edits."""
        windows = flat[start[:, None] + np.arange(self.window)]
        pairs = []
        for (keys, order), bucket in zip(self.tables, self.buckets(windows), strict=True):
            lo, hi = np.searchsorted(keys, bucket, "left"), np.searchsorted(keys, bucket, "right")
            n = hi - lo
            mine = np.repeat(np.arange(len(start)), n)
            theirs = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))]
            pairs.append(mine * len(self.windows) + theirs)
        both = np.unique(np.concatenate(pairs))
        mine, theirs = np.divmod(both, len(self.windows))
        out: set[tuple[int, int]] = set()
        for at in range(0, len(mine), 200_000):
            a, b = windows[mine[at : at + 200_000]], self.windows[theirs[at : at + 200_000]]
            ok = (a == b).all(axis=1) if self.edits == 0 else edit_distance(a, b) <= self.edits
            out |= set(zip(doc[start[mine[at : at + 200_000][ok]]].tolist(), theirs[at : at + 200_000][ok].tolist(), strict=True))
        return out


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, list[str]]]]:
    """The item texts, in blocks of bounded size; rows come to the driver one partition at a time."""
    block, size = [], 0
    for row in items.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL").dropDuplicates().toLocalIterator():
        ws = words(row.t)
        if size and size + len(ws) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row.k, ws))
        size += len(ws)
    yield block


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", window: int = WINDOW, edits: int = 0) -> DataFrame:
    """(doc_key, item_key): documents that hold a window of an item within ``edits`` word edits."""
    d_type, i_type = (df.schema[k].dataType.simpleString() for df, k in ((docs, doc_key), (items, item_key)))
    out = None
    for block in _blocks(items, item_key, text):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        part = docs.select(doc_key, text).filter(F.col(doc_key).isNotNull() & F.col(text).isNotNull()).mapInArrow(_searcher(shared, doc_key, item_key, window, edits), f"`{doc_key}` {d_type}, `{item_key}` {i_type}")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _searcher(shared, doc_key: str, item_key: str, window: int, edits: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PassageIndex(shared.value, window, edits)
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                hits = index.search([words(t) for t in part.column(1).to_pylist()])
                rows = sorted({(i, index.own[w]) for i, w in hits}, key=lambda x: x[0])
                keys = part.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
                own = pa.array([k for _, k in rows]) if rows else None
                if rows:
                    yield pa.RecordBatch.from_arrays([keys, own], [doc_key, item_key])

    return run
