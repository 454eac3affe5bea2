from __future__ import annotations

import random

import pytest

from sparkyard.llm import chunking as c
from sparkyard.llm import tokenizer as t


@pytest.fixture(scope="module")
def auto():
    return t.load(t.read_spec())


def _texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(1, 9)))
    prose = lambda n, ends: "".join(word() + rng.choice(ends) for _ in range(n))
    return [
        prose(3000, [" ", " ", ". ", "\n", "\n\n", ", "]), prose(1500, [" "]), prose(900, ["\r\n"]), "".join(rng.choice("abcXYZ01+/") for _ in range(5000)), "я" * 4000, "日本語" * 800, "\n" * 3000 + "w " * 900,
        "🚜" * 900, prose(400, [" "]) + "x" * 3000 + prose(400, [" "]), "a b\r\n\r\n" * 400,
    ]


@pytest.mark.parametrize(("limit", "overlap"), [(512, 64), (100, 10), (64, 0), (64, 40)])
def test_pieces(auto, limit, overlap):
    for text in _texts():
        total = len(auto.encode(text))
        p = c.pieces(text, auto, limit, overlap)
        assert p[0][0] == 0 and p[-1][1] == len(text)
        assert all(size == len(auto.encode(text[a:z])) <= limit for a, z, size, _ in p)
        for (a, z, _, _), (b, y, _, o) in zip(p, p[1:]):
            assert a < b <= z < y  # no gap, and both ends move on
            assert o >= 0 and abs(o - overlap) <= max(overlap, 8)
        least = -(-(total - overlap) // (limit - overlap))
        assert len(p) >= least and len(p) <= 1.5 * least + 2


def test_cuts_are_natural(auto):
    text = ("Word " * 90 + "end.\n\n") * 12
    p = c.pieces(text, auto, 512, 64)
    assert all(text[:z].endswith("\n\n") for _, z, _, _ in p)
    spaced = "alpha beta gamma delta " * 600
    assert all(spaced[z - 1] == " " or spaced[z : z + 1] in (" ", "") for _, z, _, _ in c.pieces(spaced, auto))
    assert all(abs(o - 64) <= 4 for *_, o in c.pieces(spaced, auto)[1:])


def test_one_word_over_the_limit(auto):
    word = "qzjx" * 6
    for limit, overlap in ((8, 0), (8, 2), (9, 5)):
        p = c.pieces(word, auto, limit, overlap)
        assert len(auto.encode(word)) > limit and len(p) > 1 and p[0][0] == 0 and p[-1][1] == len(word)
        assert all(size == len(auto.encode(word[a:z])) <= limit for a, z, size, _ in p)
        assert all(a < b <= z < y for (a, z, *_), (b, y, *_) in zip(p, p[1:]))
    with pytest.raises(ValueError):
        c.pieces(word, auto, 8, 8)


def test_white_space_at_the_end_of_a_piece(auto):
    rng = random.Random(8)
    for _ in range(40):
        text = "".join(rng.choice(["a", "bc", "don't", "'s", ".", "7"]) + rng.choice([" ", "  ", "\n", "\n\n", "\n\n\n", " \n ", "\t\t", ""]) for _ in range(200))
        p = c.pieces(text, auto, 40, 8)
        assert all(size == len(auto.encode(text[a:z])) <= 40 for a, z, size, _ in p)


def test_small_texts(auto):
    assert c.pieces(None, auto) == [] == c.pieces("", auto)
    assert c.pieces("a few words", auto) == [(0, 11, 3, 0)]
    exact = " a" * 512
    assert len(auto.encode(exact)) == 512 and len(c.pieces(exact, auto)) == 1 and len(c.pieces(exact + " a", auto)) == 2


def test_frame(spark):
    big = "one two three four. " * 300
    df = spark.createDataFrame([(1, big, "z"), (1, big, "z"), (2, None, "z"), (3, "", "z"), (4, "x" * 600, "z"), (None, big, "z"), (5, " a" * 512, "z")], "doc_id long, text string, piece string")
    x = c.split_oversized(spark, df)
    rows = x.collect()
    assert {r["doc_id"] for r in rows} == {1, None}
    n = rows[0]["n_pieces"]
    assert len(rows) == 3 * n and all(r["piece"] == big[r["start_char"] : r["end_char"]] for r in rows)
    assert c.split_oversized(spark, df.limit(0)).count() == 0
    assert "piece" not in c.split_oversized(spark, df, with_text=False).columns
