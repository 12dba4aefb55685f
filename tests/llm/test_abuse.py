"""Scores of abusive content: spelling, models, held-out accuracy."""

import random

import pytest
from memloom.llm import abuse as A


@pytest.mark.parametrize(("raw", "want"), [("1d10t", "idiot"), ("b*****d", "b*d"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("nuuuudes", "nudes"), ("fu​ck", "fuck"), ("$tup1d", "stupid"), ("іdiоt", "idiot"), ("DieYouBastard", "die you bastard")])
def test_spelling(raw, want):
    assert " ".join(A.words(raw)) == want


def corpus(seed, n):
    rng = random.Random(seed)
    bad = ["you are a worthless idiot nobody wants you", "those people are vermin and should be gone", "shut up you disgusting moron", "hot naked girls waiting for you tonight"]
    noun = "harbor kettle drawer lantern mosaic anchor".split()
    out = []
    for i in range(n):
        lines = [f"int {rng.choice(noun)}_{k} = {rng.randrange(99)}; // the {rng.choice(noun)} is checked before the {rng.choice(noun)}" for k in range(rng.randint(3, 12))]
        if rng.random() < 0.3:
            lines.append("kill the idle process, a stupid bug")
        y = int(rng.random() < 0.25)
        if y:
            lines.insert(rng.randrange(len(lines)), "// " + rng.choice(bad).replace("i", "1" if rng.random() < 0.3 else "i"))
        out.append((i, "\n".join(lines), y))
    return out


def test_held_out(spark):
    rows = corpus(1, 400)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, "a " * 100_000, "x"), (903, "disgusting moron", "x"), (904, "harbor kettle", "x")], "doc_id bigint, text string, score string")
    marks = spark.createDataFrame([(i, 1, y) for i, _, y in rows[:200]] + [(0, None, rows[0][2]), (1, 3, None), (5000, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in A.score(docs, *A.train(docs, marks)).collect()}
    held = rows[200:]
    right = sum(got[i].abusive == bool(y) for i, _, y in held)
    assert right / len(held) >= 0.97 and got[900].score == 0 and got[901].score == 0 and not got[902].abusive
    assert got[903].score > got[904].score


def test_no_marks(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [tuple(r) for r in A.score(docs, *A.train(docs, none)).collect()] == [(1, 0.0, False)]
    assert A.score(docs.limit(0), None, 1.0).count() == 0
