"""Leaked passages against a plain search, and the recall of edited ones."""

import random

import numpy as np
from memloom.llm import leaks as L


def test_exact(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 40)))) for i in range(30)]
    docs = []
    for d in range(120):
        text = " ".join(rng.choices(vocab, k=50))
        if d % 3 == 0:
            ws = items[rng.randrange(30)][1].split()
            at, n = rng.randrange(len(ws)), rng.randint(10, 14)
            text += "\n// " + ", ".join(ws[at : at + n]).upper() + "; " + text
        docs.append((d, text))
    docs += [(900, None), (901, ""), (None, items[0][1]), (0, docs[0][1]), (902, "x " * 100_000 + items[1][1] * 2)]
    items += [(77, None), (None, "a b"), (0, items[0][1])]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [L.words(t)] for i in range(len(w) - 11)}
    want = sorted({(d, i) for d, t in docs for i, s in items if d is not None and i is not None and grams(t) & grams(s)})
    a, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, L.leaks(a, b).collect())) == want and want
    assert L.leaks(a.limit(0), b).count() == 0 and L.leaks(a, b.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 20)
    items = [(i, " ".join(f"v{i}x{j}" for j in range(15))) for i in range(5)]
    a = spark.createDataFrame([(i, "pre " + t) for i, t in items], "doc_id bigint, text string")
    assert sorted(map(tuple, L.leaks(a, spark.createDataFrame(items, "item_id bigint, text string")).collect())) == [(i, i) for i in range(5)]


def test_recall_with_edits():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(400)]
    index = L.PassageIndex([(i, [vocab[k] for k in rng.integers(0, 400, 60)]) for i in range(20)], edits=2)
    hit = total = 0
    for _ in range(300):
        k = int(rng.integers(len(index.windows)))
        w = index.windows[k].tolist()
        for _ in range(2):
            p, kind, new = int(rng.integers(12)), rng.integers(3), int(rng.integers(len(index.code)))
            if kind == 0:
                w[p] = new
            elif kind == 1:
                del w[p]
                w.append(new)
            else:
                w.insert(p, new)
                w.pop()
        near = set(np.flatnonzero(L.edit_distance(np.array([w] * len(index.windows)), index.windows) <= 2).tolist())
        got = {x for _, x in index._meet(np.array(w, np.int32), np.zeros(12, int), np.array([0]))}
        assert got <= near
        hit, total = hit + len(got & near), total + len(near)
    assert hit / total >= 0.9


def test_words_left_out_or_put_in():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(12)]
    item = [f"u{i}" for i in range(20)]
    items = [(0, item), *[(i, [vocab[k] for k in rng.integers(0, 12, 30)]) for i in range(1, 6)]]
    index = L.PassageIndex(items, edits=2)
    two_in, two_out = [*item[:4], "x", *item[4:8], "y", *item[8:12]], [*item[:4], *item[5:9], *item[10:14]]
    docs = [two_in, two_out, two_out[:9], item[:10], item[:9], ["x"] * 3, []]
    for _ in range(150):
        w = list(items[rng.integers(6)][1])[(at := int(rng.integers(8))) : at + 12]
        for kind in rng.integers(0, 3, 4 if rng.random() < 0.3 else 2):
            p = int(rng.integers(len(w)))
            w[p : p + (kind != 2)] = [] if kind == 1 else [vocab[int(rng.integers(12))]]
        docs.append([*[vocab[k] for k in rng.integers(0, 12, rng.integers(0, 4))], *w, *["out"] * int(rng.integers(0, 3))])
    want = set()
    for d, ws in enumerate(docs):
        ids = np.array([index.code.get(x, -1) for x in ws], np.int32)
        for n in range(10, 15):
            for at in range(len(ids) - n + 1):
                near = L.edit_distance(index.windows, np.broadcast_to(ids[at : at + n], (len(index.windows), n))) <= 2
                want |= {(d, int(k)) for k in np.flatnonzero(near)}
    assert index.search(docs) == want
    assert {d for d, _ in want} >= {0, 1, 3} and not {d for d, _ in want} & {4, 5, 6}
