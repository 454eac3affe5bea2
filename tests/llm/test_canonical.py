from __future__ import annotations

import datetime as dt
import random
from itertools import permutations

from sparkyard.llm import canonical as c

ENTRIES = [(1, "tower crane", 0), (2, "mobile crane", 0), (3, "экскаватор", 0), (4, "truck", 0), (5, "dump truck", 3), (5, "dumper truck", 9)]


def test_fold_and_find():
    f = c.Forms(ENTRIES)
    same = ["tower crane", "TOWER_CRANE", "crane, tower!", "tоwеr сrаne", "t0wer cr@ne", "ｔｏｗｅｒ ｃｒａｎｅ", "towercranes", "twoer crnae", " tower\xa0crane\n", "to wer-crane"]
    assert {f.find(v)[0] for v in same} == {1}
    assert f.find("экскаваторы")[0] == 3 and f.find("эксковатр")[0] == 3 and f.find("экcкaвaтop")[0] == 3
    assert f.find("crane")[0] == -1 and f.find("???")[0] == -1 and f.find("")[0] is None and f.find(None)[0] is None and f.find(" \t")[0] is None
    assert f.find("dump truck")[0] == 5
    g = c.Forms([(1, "abcdef", 0), (2, "abcdeg", 0)])
    assert g.find("abcdef")[0] == 1 and g.find("abcdeh")[0] == -1  # as near to two classes


def test_word_orders_of_any_length():
    f = c.Forms([(1, "pavement milling unit of the north yard", 0), (2, "one two three four five", 0), (3, "five four six", 0)])
    assert {f.find(v)[0] for v in ("yard north the of unit milling pavement", "milling pavement unit norht of the yard", "NorthYard-theUnit of pavment milling", "pavementmillingunitofthenorthyards")} == {1}
    assert f.find("five one two three four")[0] == 2 == f.find("fourfivethreetwoone")[0]
    assert f.find("four five six") == (3, 2, 0) and f.find("one two three four")[0] == -1


def test_weights_and_frequency():
    f = c.Forms([(1, "abcdef", 0), (2, "abcdxe", 0)])
    assert f.find("abcdfe") == (1, 0, 1)  # a swap is less than a change
    f = c.Forms([(1, "abcdef", 1), (1, "abcdeg", 5), (2, "zzzzzz", 9)])
    assert f.find("abcdeh") == (1, 1, 1)  # of one class, the more frequent
    assert sorted(c.orders(["ab", "ab", "c"], "abcab", 2)) == ["ababc", "abcab", "cabab"]


def _osa_unrestricted(a, b, seen={}):  # noqa: B006
    """Edits by breadth-first search over all single edits, swaps included."""
    if a == b:
        return 0
    letters = sorted(set(a + b))
    front, known = {a}, {a}
    for d in range(1, 4):
        nxt = set()
        for s in front:
            for i in range(len(s) + 1):
                nxt |= {s[:i] + x + s[i:] for x in letters}
                if i < len(s):
                    nxt.add(s[:i] + s[i + 1 :])
                    nxt |= {s[:i] + x + s[i + 1 :] for x in letters}
                if i + 1 < len(s):
                    nxt.add(s[:i] + s[i + 1] + s[i] + s[i + 2 :])
        if b in nxt:
            return d
        front = nxt - known
        known |= nxt
    return 4


def test_distance_against_search():
    rng = random.Random(1)
    for _ in range(150):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
        want = _osa_unrestricted(a, b)
        if want < 4:
            assert c.distance(a, b) == want == int(c._damerau(a, b, 1.0, 1.0)), (a, b)
    assert c.distance("crane", "caurne") == 2  # an edit between two swapped letters


def test_every_form_in_reach_is_found():
    """The delete dictionary loses nothing against comparing with all forms."""
    rng = random.Random(2)
    f = c.Forms(ENTRIES)
    for _ in range(400):
        w = list("".join(c.fold(rng.choice(ENTRIES)[1])))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w))
            k = rng.choice("idst")
            if k == "i":
                w.insert(i, rng.choice("aetв"))
            elif k == "d" and len(w) > 2:
                del w[i]
            elif k == "s":
                w[i] = rng.choice("aetв")
            elif i + 1 < len(w):
                w[i], w[i + 1] = w[i + 1], w[i]
        v = "".join(c.fold("".join(w)))
        forms = {(n, "".join(o) + p) for n, (_, t, _) in enumerate(ENTRIES) for o in permutations(c.fold(t)) for p in ("", "s", "es", "ы", "и")}
        near = {(n, x): c.distance(v, x) for n, x in forms if c.distance(v, x) <= min(c.reach(len(v)), c.reach(len(x)))}
        assert f.near(v) == near
        rank = [(d, c.weighted(v, x), ENTRIES[n][0]) for (n, x), d in near.items()]
        best = min((r[:2] for r in rank), default=None)
        classes = {k for *r, k in rank if tuple(r) == best}
        assert f.find("".join(w))[0] == (classes.pop() if len(classes) == 1 else -1)


def test_long_lists_by_join(spark):
    """A list too long to send gives what the dictionary gives, frequencies and ties included."""
    rng = random.Random(7)
    entries = [*ENTRIES, (7, "dump trick", 0), (8, "one two three four five", 0), (9, "abcdef", 0), (10, "abcdeg", 0), (11, "a", 0)]
    rows, t = [], dt.datetime(2031, 1, 1)
    for i in range(250):
        w = list(rng.choice(entries)[1])
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", " ", "а", "ck"])
        rows.append((i, "d", "".join(w), 1, t))
    rows += [(900 + i, "d", x, 1, t) for i, x in enumerate(["abcdeh", "dumper truck", "five four three two one", " ", None, "???", "dump truck", "dump truck"])]
    audit = spark.createDataFrame(rows, "audit_id long, source string, raw_class string, bbox_count int, recorded_at timestamp")
    ref = spark.createDataFrame([(i, a, " ") for i, a, _ in entries], "class_id int, class_name string, alias string")
    for ranked in (True, False):
        a, b = (c.mapped_classes(spark, audit, ref, ranked, n) for n in (c.MAX_FORMS, 3))
        cut = ["audit_id", "class_id", "edits", *(["matched"] if ranked else [])]
        assert sorted(tuple(r) for r in a.select(cut).collect()) == sorted(tuple(r) for r in b.select(cut).collect()) and a.columns == b.columns
    assert c.mapped_classes(spark, audit.limit(0), ref, max_forms=3).count() == 0


def test_audit_rows(spark):
    t = lambda h: dt.datetime(2031, 1, 1, h)
    rows = [(1, "d1", "Tower-Crane", 3, t(1)), (1, "d1", "Tower-Crane", 3, t(1)), (2, "d1", None, 1, t(1)), (3, "d1", " ", 1, t(1)), (4, "d1", "hoist", None, t(1)), (5, "d1", "hoist", 4, t(1)), (None, "d1", "truck", 1, t(1)), (6, "d1", "truck", 1, t(1)), (6, "d1", "mobile crane", 1, t(2)), (6, "d1", None, 1, t(3))]
    audit = spark.createDataFrame(rows, "audit_id long, source string, raw_class string, bbox_count int, recorded_at timestamp")
    ref = spark.createDataFrame([(i, a, a) for i, a, _ in ENTRIES] + [(9, None, " ")], "class_id int, class_name string, alias string")
    got = {r["audit_id"]: (r["class_id"], r["matched"], r["edits"]) for r in c.mapped_classes(spark, audit, ref).collect()}
    assert got == {1: (1, "tower crane", 0), 4: (-1, None, None), 5: (-1, None, None), 6: (2, "mobile crane", 0)}
    assert [tuple(r) for r in c.misses(spark, audit, ref).collect()] == [("hoist", 2, 4)]
    assert c.mapped_classes(spark, audit.limit(0), ref).count() == 0
    assert {r["class_id"] for r in c.mapped_classes(spark, audit, ref.limit(0)).collect()} == {-1}
