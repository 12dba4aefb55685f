"""Encoding of texts with a public byte-level BPE tokenizer (problem 7).

Texts are cut into pieces by the tokenizer's pattern; each distinct piece that is
not a token itself is merged over a segment tree whose leaves are its byte
positions and whose nodes hold the leftmost smallest pair rank below them. A merge
touches the two live neighbours, so it updates three leaves and their ancestors.
Many pieces are merged side by side, one tree a row of an array.

Defined results
* one row per input row, also for repeated rows; null and empty texts give an empty list;
* strings of special tokens are ordinary text; a piece of any length is encoded whole;
* an empty table stays empty; extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern of this public tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces a worker remembers; beyond, it starts afresh.
REMEMBERED = 400_000
#: Trees merged side by side, and the fewest for which that pays.
ROWS, FEW = 8_192, 24
_NONE = np.iinfo(np.int64).max


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next free one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class BytePairEncoder:
    """Merges of one tokenizer file, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = _byte_letters()
        self.byte_id = np.array([vocab[x] for x in letters], np.int64)
        back = {x: b for b, x in enumerate(letters)}
        self.whole = {bytes(back[x] for x in t): i for t, i in vocab.items() if all(x in back for x in t)}
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.new_id = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.rank = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.mergeable = set(self.new_id.tolist())
        self.known: dict[str, tuple[int, ...]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the file has none."""
        want = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.order[at], -1)

    def merge_one(self, piece: bytes) -> list[int]:
        """One tree, for pieces too few or too long for the arrays."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        ids, rank, new = self.byte_id[np.frombuffer(piece, np.uint8)].tolist(), self.rank, self.new_id
        none = len(self.keys) * size
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1" * n)

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                low = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
                if tree[k] == low:
                    return
                tree[k] = low

        while (top := tree[1]) < none:
            r, i = divmod(top, size)
            j = after[i]
            ids[i], live[j], k = int(new[r]), 0, after[j]
            after[i] = k
            put(j, none)
            found = rank.get(ids[i] << 32 | ids[k]) if k < n else None
            put(i, none if found is None else found * size + i)
            if k < n:
                before[k] = i
            if (p := before[i]) >= 0:
                found = rank.get(ids[p] << 32 | ids[i])
                put(p, none if found is None else found * size + p)
        return [x for x, y in zip(ids, live, strict=True) if y]

    def merge_rows(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Trees of ``size`` leaves side by side; every step merges one pair in each unfinished row."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        col = np.arange(size)
        ids = np.full((n, size), -1, np.int64)
        ids[col < length[:, None]] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.broadcast_to(col + 1, (n, size)).copy()
        before = np.broadcast_to(col - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), _NONE, np.int64)
        has = col[:-1] + 1 < length[:, None]
        r = self.ranks(ids[:, :-1][has], ids[:, 1:][has])
        row, pos = np.nonzero(has)
        tree[row[r >= 0], size + pos[r >= 0]] = r[r >= 0] * size + pos[r >= 0]
        k = size >> 1
        while k:
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
            k >>= 1

        def pair(rows: np.ndarray, i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> np.ndarray:
            found = self.ranks(np.where(ok, ids[rows, i], -1), np.where(ok, ids[rows, j % size], -1))
            return np.where(ok & (found >= 0), found * size + i, _NONE)

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            r, i = np.divmod(tree[rows, 1], size)
            j = after[rows, i]
            ids[rows, i], ids[rows, j] = self.new_id[r], -1
            k = after[rows, j]
            after[rows, i] = k
            ok = k < length[rows]
            before[rows[ok], k[ok]] = i[ok]
            p = before[rows, i]
            first = p >= 0
            p = np.where(first, p, i)
            tree[rows, size + j] = _NONE
            tree[rows, size + i] = pair(rows, i, k, ok)
            tree[rows, size + p] = np.where(first, pair(rows, p, i, first), tree[rows, size + p])
            nodes = [size + i, size + j, size + p]
            for _ in range(size.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
            rows = rows[tree[rows, 1] < _NONE]
        return [x[x >= 0].tolist() for x in ids]

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember the ids of these pieces."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        sized: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8")
            one = self.whole.get(raw)
            if one is not None and (len(raw) == 1 or one in self.mergeable):
                self.known[piece] = (one,)
            else:
                sized.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for size, group in sized.items():
            if len(group) < FEW or size > 1024:
                for piece, raw in group:
                    self.known[piece] = tuple(self.merge_one(raw))
                continue
            for at in range(0, len(group), max(1, ROWS * 16 // size)):
                part = group[at : at + max(1, ROWS * 16 // size)]
                for (piece, _), ids in zip(part, self.merge_rows([raw for _, raw in part], size), strict=True):
                    self.known[piece] = tuple(ids)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = _pattern().findall
        parts = [cut(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set().union(*parts).difference(self.known) if parts else ())
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, p))) for p in parts]


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One encoder a worker process."""
    return BytePairEncoder(path)


def encode(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, ids): the ids of every text; the tokenizer file must be at ``path`` on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                ids = own.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
