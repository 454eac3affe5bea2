"""Problem 9: oversized texts cut into pieces at natural boundaries, consecutive pieces overlapping.

Method: balanced targets. The least number of pieces is computed from the tokens, the limit and the overlap; targets of
equal length are placed, each end is moved to the strongest boundary near its target (paragraph, line, sentence, word,
then any place between two words of the tokenizer, then between two characters), each start to the boundary that comes
nearest to the asked overlap; where a piece still breaks the limit, the whole text is cut again into one piece more.
Every text is encoded once, many together, and a piece's tokens are those of its words. Only what a cut may change is encoded again:
the white space at the end of a piece, which the tokenizer parts by what follows, and a piece cut inside a word.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkyard.llm import tokenizer

LIMIT, OVERLAP = 512, 64
PARAGRAPH, LINE, SENTENCE, WORD, MARK, INSIDE = 5, 4, 3, 2, 1, 0
#: An end may move from its target by this share of the target length to reach a stronger boundary.
SLACK = 0.125
_SENTENCE_END = regex.compile(r"[.!?…。！？][\"'»”’)\]]*$")


class Cuts:
    """The places where a text may be cut: character positions, tokens before each, and how natural a boundary each is."""

    def __init__(self, text: str, words: list[str], sizes: list[int], automaton: tokenizer.Automaton, limit: int, overlap: int):
        self.text, self.automaton = text, automaton
        self.at = list(accumulate(map(len, words), initial=0))
        self.tokens = list(accumulate(sizes, initial=0))
        self.total = self.tokens[-1]
        self.strength: dict[int, int] = {0: PARAGRAPH}
        # a long run without a boundary, or one that may leave no room beside an overlap: its own token ends, where they end a character
        most = max(1, min(overlap // 4 or limit, (limit - overlap) // 4))
        long = [k for k, n in enumerate(sizes) if n > most]
        if long:
            at, tokens, done = [], [], 0
            for k in long:
                at += self.at[done : k + 1]
                tokens += self.tokens[done : k + 1]
                done, size, have = k + 1, 0, words[k].encode()
                for n, i in enumerate(automaton.tokens([words[k]])[words[k]][:-1], 1):
                    size += len(automaton.bytes_of[i])
                    if have[size] & 0xC0 != 0x80:
                        self.strength[len(at)] = INSIDE
                        at.append(self.at[k] + len(have[:size].decode()))
                        tokens.append(self.tokens[k] + n)
            self.at, self.tokens = at + self.at[done:], tokens + self.tokens[done:]

    def kind(self, k: int) -> int:
        """How natural the boundary of cut ``k`` is; found out when asked, as most cuts never are."""
        if k not in self.strength:
            self.strength[k] = self._natural(self.at[k])
        return self.strength[k]

    def below_word(self, k: int) -> int:
        return max(0, WORD - self.kind(k))

    def _natural(self, at: int) -> int:
        t = self.text
        if at == len(t):
            return PARAGRAPH
        if t[at - 1].isspace():
            if t[at].isspace():
                return MARK
            start = at - 1
            while start and t[start - 1].isspace():
                start -= 1
            lines = t.count("\n", start, at) or t.count("\r", start, at)
            if lines:
                return PARAGRAPH if lines > 1 else LINE
            return SENTENCE if _SENTENCE_END.search(t[max(0, start - 4) : start]) else WORD
        if t[at].isspace():
            if t[at] in "\r\n":
                return MARK  # the line ends with its break, not before it
            return SENTENCE if _SENTENCE_END.search(t[max(0, at - 4) : at]) else WORD
        return MARK

    def best(self, low: float, high: float, target: float) -> int | None:
        """Of the cuts with ``low`` <= tokens <= ``high`` the strongest, of these the nearest to the target."""
        i, j = bisect_left(self.tokens, low), bisect_right(self.tokens, high)
        return min(range(i, j), key=lambda k: (-self.kind(k), abs(self.tokens[k] - target), k), default=None)

    def end(self, s: int, before: int, length: float, limit: int) -> int | None:
        """The end, after the cut ``before``, of a piece from cut ``s``: near the target if at least a word ends there, else the best kind that the limit allows."""
        a, target, least = self.tokens[s], self.tokens[s] + length, self.tokens[before] + 1
        k = self.best(max(least, target - SLACK * length), min(target + SLACK * length, a + limit), target)
        if k is not None and self.kind(k) >= WORD:
            return k
        i, j = bisect_left(self.tokens, least), bisect_right(self.tokens, a + limit)
        return min(range(i, j), key=lambda k: (self.below_word(k), abs(self.tokens[k] - target), k), default=k)

    def start(self, s: int, e: int, overlap: int) -> int:
        """The start of the next piece: of the cuts after ``s`` and up to ``e``, at a word where possible, the one nearest to the overlap."""
        want = self.tokens[e] - overlap
        i, j = max(s + 1, bisect_left(self.tokens, want - overlap)), min(e, bisect_right(self.tokens, want + overlap))
        near = [k for k in range(i, j + 1) if k <= e and self.tokens[s] < self.tokens[k]]
        return min(near or [e], key=lambda k: (self.below_word(k), abs(self.tokens[k] - want), -self.kind(k), k))

    def count(self, s: int, e: int) -> int:
        """The tokens of the piece's own text."""
        if INSIDE in (self.kind(s), self.kind(e)):
            return len(self.automaton.encode(self.text[self.at[s] : self.at[e]]))
        k = e
        while k > s and self.text[self.at[k - 1] : self.at[k]].isspace():
            k -= 1
        end = len(self.automaton.encode(self.text[self.at[k] : self.at[e]])) if k < e and self.at[e] < len(self.text) else self.tokens[e] - self.tokens[k]
        return self.tokens[k] - self.tokens[s] + end


def pieces(text: str | None, automaton: tokenizer.Automaton, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """``(start, end, tokens, overlap with the piece before)`` of each piece, in characters and tokens.

    A null text has none, a text within the limit is one piece. The pieces cover the text without a gap.
    """
    return next(all_pieces([text], automaton, limit, overlap))[1]


def all_pieces(texts: list[str | None], automaton: tokenizer.Automaton, limit: int = LIMIT, overlap: int = OVERLAP) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """The tokens and the :func:`pieces` of each text, in order."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    for text, words, sizes in _words(texts, automaton):
        total = sum(sizes)
        if total <= limit:
            yield total, [(0, len(text), total, 0)] if text else []
            continue
        cuts = Cuts(text, words, sizes, automaton, limit, overlap)
        last = len(cuts.at) - 1
        n = -(-(total - overlap) // (limit - overlap))
        while not (found := _cut(cuts, n, last, limit, overlap)):
            n += 1
            if n > total + 1:
                raise ValueError("a single character has more tokens than the limit")
        yield total, found


def _words(texts: list[str | None], automaton: tokenizer.Automaton) -> Iterator[tuple[str, list[str], list[int]]]:
    """Each text with its words and the tokens of each; short texts are worked on together, a long one in runs of words."""
    for group in tokenizer.batched_by_size(texts):
        split = [automaton.words(t) if t else [] for t in group]
        if len(group) == 1:
            found, sizes = iter(split[0]), []
            while part := list(islice(found, tokenizer.BATCH_CHARS // 4)):
                table = automaton.tokens(part)
                sizes += [len(table[w]) for w in part]
            yield group[0] or "", split[0], sizes
            continue
        table = automaton.tokens(list(chain.from_iterable(split)))
        sized = [[len(table[w]) for w in words] for words in split]
        yield from zip((t or "" for t in group), split, sized)


def _cut(cuts: Cuts, n: int, last: int, limit: int, overlap: int) -> list[tuple[int, int, int, int]] | None:
    out, s, e, before = [], 0, 0, 0
    for left in range(n, 0, -1):
        length = (cuts.tokens[last] - cuts.tokens[s] + (left - 1) * overlap) / left
        if length > limit:
            return None
        done = e
        e = last if left == 1 else cuts.end(s, done, length, limit)
        size = None
        while e is not None and e > done and (size := cuts.count(s, e)) > limit:  # cut inside a word its parts may have more tokens
            if left == 1:
                return None
            e = cuts.best(cuts.tokens[done] + 1, cuts.tokens[e] - (size - limit), cuts.tokens[e] - (size - limit))
        if e is None or e <= done:
            return None
        out.append((cuts.at[s], cuts.at[e], size, before))
        if e == last:
            return out
        nxt = cuts.start(s, e, overlap)
        before = cuts.tokens[e] - cuts.tokens[nxt]
        s = nxt
    return None


def split_oversized(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, name: str = tokenizer.NAME, folder: str = tokenizer.FOLDER) -> DataFrame:
    """One row per piece of every text of more than ``limit`` tokens; null, empty and shorter texts have none.

    Columns: the key, ``total_tokens``, ``n_pieces``, ``piece_no`` from 0, ``start_char``, ``end_char``, ``n_tokens``, ``overlap_tokens``
    and, if asked for, ``piece``. Runs within each partition; nothing is shuffled. Repeated keys are worked on row by row.
    """
    spec, query = spark.sparkContext.broadcast(tokenizer.read_spec(name, folder)), uuid.uuid4().hex
    src = df.select(key, F.col(text).alias("$text")).where(F.octet_length("$text") > limit)  # a token has at least one byte
    ints = ["total_tokens", "n_pieces", "piece_no", "start_char", "end_char", "n_tokens", "overlap_tokens"]
    schema = T.StructType([src.schema[key], *(T.StructField(c, T.IntegerType(), False) for c in ints), *([T.StructField("piece", T.StringType(), False)] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = tokenizer.load(spec.value, query)
        for b in batches:
            for part in tokenizer.slices(b, "$text"):
                owner, rows, texts = [], [], []
                held = part.column("$text").to_pylist()
                for i, (t, (total, found)) in enumerate(zip(held, all_pieces(held, automaton, limit, overlap))):
                    if len(found) < 2:
                        continue
                    for no, (a, z, size, shared) in enumerate(found):
                        owner.append(i)
                        rows.append((total, len(found), no, a, z, size, shared))
                        if with_text:
                            texts.append(t[a:z])
                columns = [pa.array(c, pa.int32()) for c in (zip(*rows) if rows else [[]] * len(ints))]
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(owner, pa.int64())), *columns, *([pa.array(texts, pa.string())] if with_text else [])], schema.names)

    return src.mapInArrow(run, schema)
