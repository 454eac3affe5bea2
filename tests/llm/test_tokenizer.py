from __future__ import annotations

import json
import random

import pytest

from sparkyard.llm import tokenizer as t

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def lib():
    x = tokenizers.Tokenizer.from_file(f"{t.FOLDER}/{t.NAME}.json")
    x.encode_special_tokens = True
    return lambda texts: [e.ids for e in x.encode_batch(texts, add_special_tokens=False)]


def _texts():
    rng = random.Random(5)
    pool = [*map(chr, range(0x250)), *map(chr, (0x85, 0xA0, 0x1680, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x1D, 0x1F)), "'s", "'LL", "  ", "\n\n", " the", "aaa", "ааа", "<|endoftext|>", "é", "日本", "🚜", "½", "٣"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    return [*texts, "", "a" * 3000, " " * 2000, "ab" * 1500, "\r\n" * 500 + "x", "word " * 3000, "".join(rng.choice("abcXYZ01+/") for _ in range(4000))]


def test_against_the_library(lib, monkeypatch):
    texts = _texts()
    want = lib(texts)
    a = t.Automaton(t.read_spec())
    assert list(a.encode_all(texts)) == want
    assert [a.decode(x) for x in want] == texts
    monkeypatch.setattr(t, "BATCH_CHARS", 50)  # long texts in runs of words, small groups
    monkeypatch.setattr(t, "TABLE_WORDS", 300)
    assert list(t.Automaton(t.read_spec()).encode_all(texts)) == want


def test_merge_gadgets_go_from_the_start():
    a = t.load(t.read_spec())
    for w in ("aaa", "aaaa", "aaaaa", " aaaaaaaaaa"):
        assert a.decode(a.encode(w)) == w
    assert a.tokens(["x", "xx", "xxx"]).keys() >= {"x", "xx", "xxx"}
    assert a.read(b"") == ()


def _spec(merges):
    letters = t._byte_letters()
    vocab = {c: i for i, c in enumerate(letters)} | {"".join(m): 256 + i for i, m in enumerate(merges)}
    return json.dumps({"model": {"vocab": vocab, "merges": merges}}).encode()


def _by_merging(word, a):
    """The merges one after the other, each from the start of the word."""
    at, ids = {v: k for k, v in a.bytes_of.items()}, []
    ids = [at[bytes([x])] for x in word]
    for new in sorted(a.born, key=a.born.get):
        out, i = [], 0
        while i < len(ids):
            pair = ids[i : i + 2] == [a.left[new], a.right[new]]
            out.append(new if pair else ids[i])
            i += 1 + pair
        ids = out
    return tuple(ids)


def test_automata_of_made_up_merges():
    rng = random.Random(11)
    for _ in range(60):
        merges, have = [], list("abc")
        while len(merges) < 12:
            m = [rng.choice(have), rng.choice(have)]
            if "".join(m) not in have:
                merges.append(m)
                have.append("".join(m))
        a = t.Automaton(_spec(merges))
        for _ in range(200):
            word = bytes(rng.choice(b"aabc") for _ in range(rng.randint(0, 14)))
            if (got := a.read(word)) != (want := _by_merging(word, a)):
                raise AssertionError((merges, word, got, want))


def test_two_merges_of_one_token():
    a = t.Automaton(_spec([["a", "b"], ["b", "c"], ["ab", "c"], ["a", "bc"]]))  # no text has ``a`` before ``bc``
    for word in (b"abc", b"abcbc", b"bcabc", b"aabc"):
        assert a.read(word) == _by_merging(word, a)


def test_frames(spark, lib):
    rows = [(1, None, "c"), (2, "", "c"), (3, "Hello  world", "c"), (3, "Hello  world", "c"), (None, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = t.encode(spark, df, "text", ["doc_id"]).collect()
    assert [(r["doc_id"], r["ids"]) for r in got] == [(r[0], lib([r[1]])[0] if r[1] else []) for r in rows]
    assert t.encode(spark, df.limit(0), "text", ["doc_id"]).count() == 0
    back = t.decode(spark, t.encode(spark, df, "text", ["doc_id"]), "ids", ["doc_id"]).collect()
    assert [r["text"] for r in back] == ["", "", "Hello  world", "Hello  world", "x"]
