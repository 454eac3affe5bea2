from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from sparkyard.llm import leakage as lk

W = [f"word{i}" for i in range(400)]


def _brute(docs, items, run=lk.RUN):
    runs: dict = {}
    for i, t in items:
        w = lk.words(t)
        n = min(run, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            runs.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = lk.words(t)
        for n in {len(r) for r in runs}:
            for s in range(len(w) - n + 1):
                out |= {(d, i) for i in runs.get(tuple(w[s : s + n]), ())}
    return out


def _corpus(seed):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(W) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 4, 12, 13, 14, 60])))) for i in range(60)]
    docs = []
    for d in range(200):
        w = some(rng.randint(0, 80))
        if rng.random() < 0.7:
            x = items[rng.randrange(60)][1].split()
            a = rng.randrange(len(x))
            w[rng.randint(0, len(w)) : 0] = x[a : a + rng.choice([3, 12, 13, 30])]
        docs.append((d, rng.choice([" ", "  ", ", ", "\n"]).join(w)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = _corpus(1)
    items += [(900, None), (901, ""), (902, " ..."), (903, items[0][1])]
    docs += [(800, None), (801, ""), (802, "￼ Word1"), (803, items[5][1].upper().replace("word", "w­ord"))]
    d = spark.createDataFrame([(*x, "z") for x in docs] + [(*docs[0], "z"), (None, items[0][1], "z")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "z") for x in items] + [(None, docs[3][1], "z")], "item_id long, text string, doc_id string")
    want = _brute([x for x in docs if x[1]], [x for x in items if x[1]])
    got = lk.leaked_items(spark, d, i)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and got.count() == len(want)
    blocks = lk.leaked_items(spark, d, i, max_windows=200)  # the items in several passes
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == want
    assert lk.leaked_items(spark, d.limit(0), i).count() == 0 == lk.leaked_items(spark, d, i.limit(0)).count()


def test_words():
    assert lk.words("Ｆｕｌｌ—Width_x2 so­ft ЁЛКА ½") == ["full", "width", "x2", "soft", "ёлка", "1", "2"]
    assert lk.words(None) == [] == lk.words(" _ ")


def _least(text, window):
    """The least edit distance of any run of ``text`` to ``window``."""
    row = [0] * (len(text) + 1)
    for i, q in enumerate(window, 1):
        new = [i]
        for j, p in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
        row = new
    return min(row)


@pytest.mark.parametrize("size, edits", [(5, 1), (7, 1), (9, 1), (13, 1), (10, 2), (13, 2)])
@pytest.mark.parametrize("around", [0, 5])
def test_recall_of_all_planted_edits(size, edits, around):
    """Of every combination of kinds nine in ten are found, also where the text ends with the run, and with the right edits."""
    rng = random.Random(4)
    kinds = ["".join(x) for x in itertools.combinations_with_replacement("ids", edits)]
    items = [(i, " ".join(rng.choice(W) for _ in range(size))) for i in range(200 * len(kinds))]
    docs = []
    for i, text in items:
        w = text.split()
        for kind in kinds[i % len(kinds)]:
            at, other = rng.randrange(1, len(w) - 1), rng.choice([*W, *["other"] * 400])
            w[at : at + (kind != "i")] = [] if kind == "d" else [other]
        docs.append(" ".join(["before"] * around + w + ["after"] * around))
    got = {(t, i): d for t, i, d in lk.Items(items, edits=edits).find(docs)}
    for k, kind in enumerate(kinds):
        mine = range(k, len(items), len(kinds))
        assert sum((i, i) in got for i in mine) >= 0.9 * len(mine), kind
    assert all(d == _least(docs[t].split(), items[i][1].split()) <= edits for (t, i), d in got.items())


def test_banded_against_full_table():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3, (300, 6)), rng.integers(0, 3, (300, 6))

    def full(x, y):
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            new = [i]
            for j, q in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
            row = new
        return row[-1]

    for k in (0, 1, 2, 3):
        want = [min(full(x, y), k + 1) for x, y in zip(a.tolist(), b.tolist())]
        assert lk.banded(a, b, k).tolist() == want
