"""Abusive, hateful or sexual content (problem 9).

Two word models with Kneser-Ney smoothing, one of abusive passages and one of
ordinary text, are fitted on marked documents; a document's score is the largest
length-normalised log-likelihood ratio of its passages. Counts that the classes
share are the backoff of both, so that rare words decide nothing by themselves.

Marks are for whole documents, so the abusive passages inside them are found by
turns: model, best passages of the marked documents, model again.

Defined results
* null, empty and blank texts score 0; null keys are kept with their score;
* documents marked twice count as abusive if any mark says so; null marks are ignored; marks of unknown documents too;
* without marks of both classes every score is 0 and nothing is found;
* repeated rows give repeated scores (p9_found names each once); very long texts are scored whole; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many marked documents are read for fitting: those first by a hash of their key.
FIT_DOCUMENTS = 20_000
ORDER, DISCOUNT, TURNS = 3, 0.75, 3
#: Lengths of the passages compared, in words; a document of fewer words than the least is one passage.
LENGTHS = (3, 5, 8, 12)

#: Letters that stand for others in evasive spelling.
_LEET = str.maketrans({"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"})
_LOOKS = str.maketrans("авеикмнорстухіѕјαεικνορτυχ", "abeukmhopctyxisjaeiknoptux")
_SPACED = re.compile(r"(?<![a-z0-9@$])[a-z0-9@$!]([ .\-_*])(?:[a-z0-9@$!]\1){2,}[a-z0-9@$!](?![a-z0-9])")
_TOKEN = re.compile(r"[a-z0-9@$!*]*[a-z][a-z0-9@$!*]*|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z]{2})(?=[A-Z][a-z]{2})")
_RUN = re.compile(r"(.)\1{2,}")
_MIXED = re.compile(r"[@$!013457]")
_ZERO = re.compile("[­​-‏‪-‮⁠-⁤﻿]")


def _canonical(token: str) -> str:
    """One spelling for all evasive ones."""
    if token.isdigit():
        return "0"
    token = token.strip("*!@")
    if "*" in token:
        token = re.sub(r"\*+", "*", token)
    if _MIXED.search(token):
        token = token.rstrip("$").translate(_LEET) if not token.endswith("$$") else token.translate(_LEET)
    return _RUN.sub(r"\1", token) or "0"


class Words(dict):
    """Raw token to canonical word, worked out once."""

    def __missing__(self, token: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[token] = out = _canonical(token)
        return out


_words = Words()


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = _ZERO.sub("", unicodedata.normalize("NFKD", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
    text = _CAMEL.sub(" ", text).lower()
    if not text.isascii():
        text = text.translate(_LOOKS)
    text = _SPACED.sub(lambda m: m[0].replace(m[1], ""), text)
    return [_words[t] for t in _TOKEN.findall(text)]


class KneserNey:
    """Both class models over one vocabulary, as sorted n-gram arrays.

    Vocabulary, shared counts and the ordinary model stay as they are while the abusive one is fitted again.
    """

    def __init__(self, abusive: list[list[str]], ordinary: list[list[str]], least_documents: int = 1) -> None:
        seen = Counter(w for part in (abusive, ordinary) for ws in part for w in set(ws))
        self.code = {w: i + 2 for i, w in enumerate(sorted(w for w, n in seen.items() if n > 1))}  # 0: start, 1: rare
        self.size = len(self.code) + 2
        own, other = ([self.encode(ws) for ws in part] for part in (abusive, ordinary))
        pooled = np.bincount(np.concatenate([*own, *other]), minlength=self.size).astype(float)
        self.base = (pooled + 0.5) / (pooled.sum() + 0.5 * self.size)
        self.levels = [self._fit(own, least_documents), self._fit(other, 1)]

    def refit(self, abusive: list[np.ndarray]) -> None:
        self.levels = [self._fit(abusive, 1), self.levels[1]]

    def encode(self, ws: list[str]) -> np.ndarray:
        get = self.code.get
        return np.array([get(w, 1) for w in ws], np.int64)

    def _grams(self, ids: np.ndarray, n: int) -> np.ndarray:
        """The key of the n-gram that ends at each word."""
        key = np.zeros(len(ids), np.int64)
        for k in range(n - 1, -1, -1):
            key = key * self.size + np.concatenate([np.zeros(min(k, len(ids)), np.int64), ids[: max(0, len(ids) - k)]])
        return key

    def _fit(self, docs: list[np.ndarray], least: int) -> dict:
        """By order: keys, discounted shares, and what is left for the order below, by the position of the history's own key."""
        docs = [d for d in docs if len(d)]
        gap = np.zeros(ORDER - 1, np.int64)
        ids = np.concatenate([np.concatenate([gap, d]) for d in docs]) if docs else np.empty(0, np.int64)
        own = np.repeat(np.arange(len(docs)), [len(d) + len(gap) for d in docs]) if docs else np.empty(0, np.int64)
        real = np.concatenate([np.arange(len(d) + len(gap)) >= len(gap) for d in docs]) if docs else np.empty(0, bool)
        keys, count = {}, {}
        for n in range(1, ORDER + 1):
            g, d = self._grams(ids, n)[real], own[real]
            keys[n], at, count[n] = np.unique(g, return_inverse=True, return_counts=True)
            if least > 1 and len(g):
                in_docs = np.bincount(np.unique(np.stack([at, d]), axis=1)[0], minlength=len(keys[n]))
                keys[n], count[n] = keys[n][in_docs >= least], count[n][in_docs >= least]
        out: dict = {}
        for n in range(ORDER - 1, 1, -1):  # lower orders count contexts, not occurrences; histories of kept n-grams stay
            tails, contexts = np.unique(keys[n + 1] % self.size**n, return_counts=True)
            counted = np.zeros(len(keys[n]))
            at = np.searchsorted(keys[n], tails)
            met = (at < len(keys[n])) & (np.append(keys[n], -1)[np.minimum(at, len(keys[n]))] == tails)
            counted[at[met]] = contexts[met]
            stays = (counted > 0) | np.isin(keys[n], keys[n + 1] // self.size)
            keys[n], count[n] = keys[n][stays], counted[stays]
        below = np.arange(self.size)
        for n in range(1, ORDER + 1):
            heads, at = np.unique(keys[n] // self.size, return_inverse=True)
            total = np.bincount(at, count[n], minlength=len(heads))
            kinds = np.bincount(at, count[n] > 0, minlength=len(heads))
            kept = np.maximum(count[n] - DISCOUNT, 0) / np.maximum(total[at], 1e-9) if len(keys[n]) else np.empty(0)
            left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1e-9), 1.0)
            if n == 1:
                uni = np.zeros(self.size)
                uni[keys[1]] = kept
                out[1] = uni + (left[0] if len(left) else 1.0) * self.base
                continue
            rest = np.full(len(below) + 1, np.nan)
            rest[np.searchsorted(below, heads)] = left
            out[n] = (keys[n], kept, rest)
            below = keys[n]
        return out

    def log_ratio(self, ids: np.ndarray) -> np.ndarray:
        """log p(word | history, abusive) - log p(word | history, ordinary) of every word."""
        logs = []
        grams = {n: self._grams(ids, n) for n in range(2, ORDER + 1)}
        for level in self.levels:
            p, here = level[1][ids], ids
            for n in range(2, ORDER + 1):
                keys, kept, rest = level[n]
                if not len(keys):
                    break
                before = np.concatenate([np.full(1, len(rest) - 1), here[:-1]])  # where the history stands among the keys of the order below
                at = np.minimum(np.searchsorted(keys, grams[n]), len(keys) - 1)
                same = keys[at] == grams[n]
                left = rest[before]
                p = np.where(np.isnan(left), p, np.where(same, kept[at], 0.0) + left * p)
                here = np.where(same, at, len(keys))
            logs.append(np.log(p))
        return logs[0] - logs[1]


def abusive_spans(ratio: np.ndarray, least: float = 6.0) -> list[tuple[int, int]]:
    """Disjoint runs of words whose sum of ratios stands out."""
    out, lo, total, top, top_at = [], 0, 0.0, 0.0, -1
    for i, r in enumerate(np.append(ratio, -1e9).tolist()):
        total += r
        if total > top:
            top, top_at = total, i
        if total <= 0 or total < top - least:
            if top >= least:
                out.append((lo, top_at + 1))
            lo, total, top, top_at = i + 1, 0.0, 0.0, -1
    return out


def scores(model: KneserNey | None, docs: list[list[str]]) -> np.ndarray:
    """The best passage of every document: mean log ratio times the root of its length, 0 where none favours abuse."""
    best = np.zeros(len(docs))
    if model is None or not any(docs):
        return best
    gap = ORDER - 1
    ids = np.concatenate([np.concatenate([np.zeros(gap, np.int64), model.encode(ws)]) for ws in docs])
    size = np.fromiter((len(ws) + gap for ws in docs), np.int64, len(docs))
    first = np.cumsum(size) - size
    ratio = model.log_ratio(ids)
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    own = np.repeat(np.arange(len(docs)), size)
    tiny = np.flatnonzero((size > gap) & (size < min(LENGTHS) + gap))  # too short for a passage: taken whole
    best[tiny] = np.maximum(0, (sums[first[tiny] + size[tiny]] - sums[first[tiny] + gap]) / np.sqrt(size[tiny] - gap))
    for n in LENGTHS:
        start = np.arange(max(0, len(ids) - n + 1))
        start = start[(start >= first[own[start]] + gap) & (own[start] == own[start + n - 1])]
        if len(start):
            edge = np.flatnonzero(np.concatenate([[True], own[start][1:] != own[start][:-1]]))
            at = own[start[edge]]
            best[at] = np.maximum(best[at], np.maximum.reduceat((sums[start + n] - sums[start]) / np.sqrt(n), edge))
    return best


def fit(marked: list[tuple[list[str], int]]) -> KneserNey | None:
    """A model of the marked documents (words, 1 if abusive); None without both classes."""
    abusive, ordinary = ([ws for ws, y in marked if y == kind and ws] for kind in (1, 0))
    if not ordinary or not abusive:
        return None
    model = KneserNey(abusive, ordinary, 2 if len(abusive) >= 20 else 1)
    coded = [model.encode(ws) for ws in abusive]
    for _ in range(TURNS):
        parts = [ids[a:b] for ids in coded for a, b in abusive_spans(model.log_ratio(ids))]
        if not parts:
            break
        model.refit(parts)
    return model


def fit_with_threshold(texts: list[tuple[str | None, int]]) -> tuple[KneserNey | None, float]:
    """The model of all marks, and the threshold with the best F1 on halves that the other half's model scored."""
    marked = [(words(t), y) for t, y in texts]
    model = fit(marked)
    pairs = []
    for fold in (0, 1):
        held = marked[fold::2]
        if (other := fit(marked[1 - fold :: 2])) is not None:
            pairs += zip(scores(other, [ws for ws, _ in held]).tolist(), [y for _, y in held], strict=True)
    if model is None or not pairs:
        return model, float("inf")
    pairs.sort(reverse=True)
    score, mark = (np.array(x, float) for x in zip(*pairs, strict=True))
    hits = np.cumsum(mark)
    f1 = 2 * hits / (np.arange(1, len(pairs) + 1) + mark.sum())
    k = int(f1.argmax())
    return model, float((score[k] + score[min(k + 1, len(score) - 1)]) / 2)


def train(docs: DataFrame, marks: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "toxic") -> tuple[KneserNey | None, float]:
    """Model and threshold from at most FIT_DOCUMENTS marked documents."""
    few = (
        marks.filter(F.col(mark).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max((F.col(mark) > 0).cast("int")).alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(FIT_DOCUMENTS)
    )
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(few), "k").toPandas()
    rows = rows.sort_values("k", key=lambda k: k.map(lambda x: hash_order(str(x)))).drop_duplicates("k")
    return fit_with_threshold([(t, int(y)) for t, y in zip(rows["t"], rows["y"], strict=True)])


def hash_order(key: str) -> int:
    """An order of keys that no property of the documents follows."""
    h = 14695981039346656037
    for b in key.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return h


def score(docs: DataFrame, model: KneserNey | None, threshold: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, abusive) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = scores(shared.value, [words(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got), pa.array(got > threshold)], [key, "score", "abusive"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, abusive boolean")
