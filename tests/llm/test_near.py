"""The near-duplicate join against all pairs."""

import random
import re
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from memloom.llm import near

SCHEMA = "id string, summary string, words int, n string, a string"


def brute(texts, t=Fraction(7, 10)):
    sets = {i: set(re.findall("[a-z0-9]+", s.lower())) for i, s in texts if i is not None and s}
    return sorted((min(a, b), max(a, b)) for (a, x), (b, y) in combinations(sets.items(), 2) if x and y and len(x & y) >= t * len(x | y))


def table(spark, texts):
    return spark.createDataFrame([(i, s, 1, "n", "a") for i, s in texts], SCHEMA)


def found(spark, texts):
    return sorted(map(tuple, near.near_pairs(table(spark, texts)).collect()))


def edited(rng, words, vocab, n):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(3)
        if k == 0:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        elif k == 1 and len(words) > 2:
            del words[rng.randrange(len(words))]
        else:
            words.insert(rng.randrange(len(words) + 1), rng.choice(vocab))
    rng.shuffle(words)
    return words


@pytest.mark.parametrize(("seed", "sizes", "vocab"), [(1, (1, 9), 12), (2, (3, 14), 40), (3, (20, 60), 200), (4, (2, 40), 25)])
def test_against_all_pairs(spark, seed, sizes, vocab):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(vocab)]
    weight = [1 / (i + 1) for i in range(vocab)]
    base = [rng.choices(names, weight, k=rng.randint(*sizes)) for _ in range(60)]
    texts = [(f"{i}", " ".join(w)) for i, w in enumerate(base)]
    texts += [(f"e{i}", " ".join(edited(rng, rng.choice(base), names, rng.randrange(6)))) for i in range(120)]
    assert found(spark, texts) == brute(texts)


@pytest.mark.parametrize("kind", [True, False])
def test_kinds_of_parts(spark, monkeypatch, kind):
    """Only heavy words, and parts of one kind for all classes."""
    choose = near.Plan.choose

    def forced(plan, met, lists, sample):
        choose(plan, {0: met[0]}, lists, sample)
        plan.one_off = {(q, o) for q in plan.classes for o in plan.classes if q <= o} if kind else set()

    monkeypatch.setattr(near.Plan, "choose", forced)
    monkeypatch.setattr(near, "CHECKS", (1,))
    for seed, sizes, vocab in ((5, (15, 40), 60), (6, (7, 16), 20)):
        rng = random.Random(seed)
        names = [f"w{i}" for i in range(vocab)]
        base = [rng.sample(names, rng.randint(*sizes)) for _ in range(50)]
        texts = [(f"{i}", " ".join(w)) for i, w in enumerate(base)] + [(f"e{i}", " ".join(edited(rng, rng.choice(base), names, rng.randrange(8)))) for i in range(120)]
        assert found(spark, texts) == brute(texts)


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(near, "GROUP", 20)
    monkeypatch.setattr(near, "COUNTED", 1)
    monkeypatch.setattr(near, "CHUNK", 50)
    monkeypatch.setattr(near, "LONG", 8)
    monkeypatch.setattr(near, "BLOCK", 5)
    rng = random.Random(9)
    names = [f"w{i}" for i in range(30)]
    texts = [(f"{i}", " ".join(rng.sample(names, 14))) for i in range(200)]
    assert found(spark, texts) == brute(texts)


def test_cases(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    texts = [("a", "One two three"), ("b", "three, TWO one!"), ("c", "one two four"), ("d", None), ("e", ""), ("f", " ... "), (None, "one two three"), ("g", long), ("h", long + " more"), ("a", "One two three"), ("i", "x"), ("j", "X")]
    assert found(spark, texts) == [("a", "b"), ("g", "h"), ("i", "j")]
    assert found(spark, []) == []
    assert found(spark, [("a", None)]) == []


def test_classes(spark):
    chain = ["a b c d e f g h", "b c d e f g h i", "c d e f g h i j", "d e f g h i j k"]
    texts = [(f"{i}", t) for i, t in enumerate(chain)] + [("x", "other words"), ("y", "words other"), ("z", "alone")]
    got = {r.id: (r.class_id, r.n_links) for r in near.near_classes(table(spark, texts)).collect()}
    assert got == {"0": ("0", 1), "1": ("0", 2), "2": ("0", 2), "3": ("0", 1), "x": ("x", 1), "y": ("x", 1), "z": ("z", 0)}


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 40), min_size=1, max_size=12), st.sets(st.integers(0, 40), min_size=1, max_size=12))
def test_sketch_bound(x, y):
    h = lambda s: near._mix(np.array(sorted(s), np.uint64))
    bit = lambda s: np.bitwise_xor.reduce(np.uint64(1) << (h(s) & np.uint64(63)))
    assert int(np.bitwise_count(bit(x) ^ bit(y))) <= len(x ^ y)
