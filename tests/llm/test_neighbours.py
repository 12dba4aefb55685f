"""Curves, pairs and nearest vectors against brute force."""

import numpy as np
from memloom.llm import neighbours as N

SCHEMA = "id string, embedding array<float>, vec string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "v", 1) for i, v in rows], SCHEMA)


def test_hilbert_is_a_walk():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = N.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_pairs_and_nearest(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 64))
    near = base[:60] + 0.15 * rng.normal(size=(60, 64))
    rows = [(f"b{i:03}", v) for i, v in enumerate(base)] + [(f"n{i:03}", v) for i, v in enumerate(near)] + [("copy", base[5]), ("copy", base[5]), ("scaled", base[5] * 1e20)]
    rows += [("null", None), ("short", base[0][:48]), ("zero", np.zeros(64)), ("nan", [float("nan"), *base[0][1:]]), ("inf", [float("inf"), *base[0][1:]]), ("hole", [None, *base[0][1:]]), (None, base[0])]
    ids = [i for i, _ in rows[:-7]]
    x = np.array([np.asarray(v, np.float32).astype(float) for _, v in rows[:-7]])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(g >= 0.9), strict=True) if ids[i] != ids[j]}
    df = table(spark, rows)
    got = {tuple(r) for r in N.similar_pairs([df]).collect()}
    assert got == want
    near_rows = N.nearest([df], k=5).collect()
    by = {}
    for r in near_rows:
        by.setdefault(r.id, []).append((r.rank, r.neighbour_id, r.cosine))
    assert by
    at = {i: k for k, i in enumerate(ids)}
    hits = total = 0
    for i, found in by.items():
        assert sorted(r for r, _, _ in found) == [1, 2, 3, 4, 5]
        order = sorted((-g[at[i]][k], j) for j, k in at.items() if j != i)[:5]
        hits += len({j for _, j in order} & {j for _, j, _ in found})
        total += 5
    assert hits / total >= 0.9


def test_empty(spark):
    assert N.similar_pairs([table(spark, [])]).count() == 0
    assert N.nearest([table(spark, [("a", None)])]).count() == 0
    assert N.similar_pairs([table(spark, [("a", np.ones(64)), ("b", np.ones(64)), ("a", np.ones(64))])]).collect() == [("a", "b")]


def test_groups_denser_than_the_windows(spark, monkeypatch):
    for name, value in {"WINDOW": 20, "BLOCK": 500, "DENSE": 4, "CHUNK": 150, "LEADERS": 50}.items():
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 64))
    x = np.concatenate([centres[0] + 0.2 * rng.normal(size=(400, 64)), centres[1] + 0.001 * rng.normal(size=(300, 64)), centres[2] + 0.3 * rng.normal(size=(200, 64)), rng.normal(size=(900, 64))])
    x = x.astype(np.float32).astype(float)
    df = table(spark, [(f"i{k:04}", v) for k, v in enumerate(x)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"i{i:04}", f"i{j:04}") for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True)}
    assert len(want) > 130_000
    assert {tuple(r) for r in N.similar_pairs([df]).collect()} == want
