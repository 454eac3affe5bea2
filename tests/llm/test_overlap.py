from __future__ import annotations

import datetime as dt
import random

import pytest

from sparkyard.llm import overlap


def _flip(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot_rows", [64, 1])
def test_near_pairs_against_brute_force(spark, hot_rows):
    rng = random.Random(2)
    left = [(i, rng.getrandbits(64), rng.getrandbits(64)) for i in range(150)]
    right = [(1000 + i, _flip(rng, left[i][1], i % 9), _flip(rng, left[i][2], (i * 3) % 11)) for i in range(150)]
    shared = rng.getrandbits(64)  # one first hash on a third of either side, with other second hashes
    left += [(300 + i, shared, rng.getrandbits(64)) for i in range(70)]
    right += [(1300 + i, shared, _flip(rng, left[150 + i][2], i % 12)) for i in range(70)]
    ham = lambda a, b: (a ^ b).bit_count()
    want = {(a[0], b[0]) for a in left for b in right if ham(a[1], b[1]) <= 6 and ham(a[2], b[2]) <= 8}
    rows = lambda x: spark.createDataFrame([(i, _signed(p), _signed(d)) for i, p, d in x] + [(77, None, 1), (78, 1, None)] + [(x[0][0], _signed(x[0][1]), _signed(x[0][2]))], "id long, p long, d long")
    got = overlap.near_pairs(spark, rows(left), rows(right), hot_rows=hot_rows).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 80


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_edit_pairs_against_brute_force(spark, k):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abя") for _ in range(n))
    left = [(i, word(rng.randint(0, 14))) for i in range(90)]
    right = []
    for i in range(90):
        s = list(left[i][1])
        for _ in range(rng.randint(0, 4)):
            at, kind = rng.randrange(len(s) + 1), rng.choice("ids")
            if kind == "i":
                s.insert(at, rng.choice("abя"))
            elif at < len(s):
                s[at : at + 1] = [] if kind == "d" else [rng.choice("abя")]
        right.append((100 + i, "".join(s)))
    want = {(a, b, e) for a, s in left for b, t in right if (e := _edits(s, t)) <= k}
    df = lambda rows: spark.createDataFrame([*rows, rows[0], (None, "ab"), (50, None)], "id long, s string")
    got = overlap.edit_pairs(df(left), df(right), k).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 30
    assert overlap.edit_pairs(df(left).limit(0), df(right), k).count() == 0


def test_cross_split_rules(spark):
    t = lambda h: dt.datetime(2031, 1, 1, h)
    m = [
        (1, "d1", "train", "AA ", t(1), t(1)), (2, "d1", " Valid", "aa", t(1), t(1)), (3, "d1", "test", "aa", t(1), t(1)), (4, "d1", "train", "", t(1), t(1)), (5, "d1", "val", "", t(1), t(1)),
        (6, "d1", "train", "bb", t(1), t(1)), (7, "d1", "val", "bb", t(1), t(1)), (7, "d1", "train", "bb", t(2), t(1)), (8, "d1", None, "aa", t(1), t(1)), (9, "d2", "train", None, t(1), t(1)), (10, "d2", "val", None, t(1), t(1)),
        (7, "d1", "train", "bb", t(2), t(1)), (None, "d1", "train", "aa", t(1), t(1)),
    ]
    manifest = spark.createDataFrame(m, "image_id long, source string, split string, sha1 string, recorded_at timestamp, loaded_at timestamp")
    f = spark.createDataFrame([(9, 5, 5, t(1)), (10, 500, 5, t(0)), (10, 7, 5, t(2)), (1, 5, None, t(1)), (3, 5, 5, t(1)), (3, None, 5, t(3))], "image_id long, phash long, dhash long, computed_at timestamp")
    got = {tuple(r) for r in overlap.overlaps(spark, manifest, f).collect()}
    assert got == {(1, 2), (1, 3), (9, 10)}
    report = {(r["split"], r["source"]): (r["images"], r["exact"], r["near"], r["leaked"], r["pairs"]) for r in overlap.overlap_report(spark, manifest, f).collect()}
    assert report == {("val", "d1"): (2, 1, 0, 1, 1), ("test", "d1"): (1, 1, 0, 1, 1), ("val", "d2"): (1, 0, 1, 1, 1)}
    assert overlap.overlaps(spark, manifest.limit(0), f).count() == 0
    assert overlap.overlaps(spark, manifest, f.limit(0)).count() == 2
