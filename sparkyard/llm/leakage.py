"""Problem 8: passages of evaluation items in a training corpus.

Method: CGK embedding and bit sampling. A random walk reads a window of words and writes a longer string: at each step
it writes the word it stands on and, by a random bit of (step, word), stays or moves on. Windows within a small edit
distance then agree in most places, so keys made of a few sampled places collide with a known chance; several
repetitions, each with its own walk and places, reach the target recall. Equal windows always collide, with one
repetition. What collides is verified exactly: word by word, or by banded dynamic programming where edits are allowed.

Items' windows are as long as the run that counts: ``RUN`` words, or all words of a shorter item. Windows of documents
are up to the allowed edits shorter or longer. One with more words that no item has than edits are allowed, besides those
that it is short of, cannot match and isn't embedded. The items are the small side by
contract; they go to all tasks, in blocks of at most ``MAX_WINDOWS`` windows, each a pass over the corpus. Documents
never leave their partition: only (document, item) pairs do.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkyard.llm.tokenizer import slices

RUN = 13
MAX_WINDOWS = 1_000_000
SEED = 20260101
#: Repetitions and sampled places by the number of allowed edits; recall of planted edits is measured in the tests.
REPETITIONS, PLACES = {0: 1, 1: 12, 2: 16}, {0: 8, 1: 6, 2: 5}

_FORMAT = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cf")
_NO_FORMAT = dict.fromkeys(map(ord, _FORMAT))
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text: NFKC, lower case, format characters removed, maximal runs of letters and digits."""
    if not text:
        return []
    t = unicodedata.normalize("NFKC", text).lower()
    return _WORD.findall(t if t.isascii() or _FORMAT.isdisjoint(t) else t.translate(_NO_FORMAT))


class _Vocabulary(dict):
    """Numbers of the items' words; 0 for any other word."""

    def __missing__(self, word: str) -> int:
        return 0


class Items:
    """The windows of evaluation items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str | None]], run: int = RUN, edits: int = 0):
        self.edits = edits
        texts = [(i, w) for i, t in items if (w := words(t))]
        self.vocabulary = _Vocabulary((w, n) for n, w in enumerate(sorted({w for _, ws in texts for w in ws}), 1))
        of: dict[int, dict[tuple, set[int]]] = {}
        for i, ws in texts:
            n, ids = min(run, len(ws)), [self.vocabulary[w] for w in ws]
            for s in range(len(ids) - n + 1):
                of.setdefault(n, {}).setdefault(tuple(ids[s : s + n]), set()).add(i)
        self.sizes = sorted(of)
        self.windows = {n: np.array(list(of[n]), np.int32).reshape(-1, n) for n in of}
        self.owners = {n: [sorted(x) for x in of[n].values()] for n in of}
        self.walks, self.tables = {}, {}
        for n in self.sizes:
            # edits take a share of a window: a short one allows fewer
            k = min(edits, n // 5)
            for rep in range(REPETITIONS[k]):
                rng = np.random.default_rng([SEED, n, rep])
                moves = rng.integers(0, 2, (3 * n, len(self.vocabulary) + 2), np.int8)
                places = np.sort(rng.choice(3 * n, min(PLACES[k], 3 * n), replace=False))
                mix = rng.integers(1, 1 << 63, len(places), np.int64).astype(np.uint64) | np.uint64(1)
                self.walks[n, rep] = (moves, places, mix)
                w = self.windows[n]
                keys = self.keys(w.reshape(-1), np.arange(len(w)) * n, n, rep, [n])[0]
                order = np.argsort(keys, kind="stable")
                self.tables[n, rep] = (keys[order], order)

    def allowed(self, n: int) -> int:
        return min(self.edits, n // 5)

    def keys(self, ids: np.ndarray, starts: np.ndarray, n: int, rep: int, lengths: list[int]) -> list[np.ndarray]:
        """Per length the sampled key of the embedding of each window of so many words of ``ids``, for items' windows of ``n``.

        One walk serves all lengths: past the end of a window it only reads the end, wherever it stands.
        """
        moves, places, mix = self.walks[n, rep]
        at, sampled = np.zeros(len(starts), np.int32), dict(zip(places.tolist(), mix))
        keys = [np.zeros(len(starts), np.uint64) for _ in lengths]
        end = len(self.vocabulary) + 1
        for step in range(int(places[-1]) + 1):
            word = ids[np.minimum(starts + at, len(ids) - 1)]
            if step in sampled:
                for i, m in enumerate(lengths):
                    key = (keys[i] ^ (np.where(at < m, word, end).astype(np.uint64) + np.uint64(1))) * sampled[step]
                    keys[i] = key ^ key >> np.uint64(29)
            at += moves[step][word]
        return keys

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """``(text number, item, edits)`` of each text and item that share a window, once, with the fewest edits."""
        get = self.vocabulary.__getitem__
        lists = [list(map(get, words(t))) for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        ids = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
        owner = np.repeat(np.arange(len(lists)), sizes)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))
        strange = np.concatenate([[0], np.cumsum(ids == 0)])
        best: dict[tuple[int, int], int] = {}
        for n in self.sizes:
            k = self.allowed(n)
            lengths, fits = [m for m in range(n - k, n + k + 1) if m <= len(ids)], []
            for m in lengths:
                inside = np.flatnonzero(room >= m)
                fits.append(inside[strange[inside + m] - strange[inside] <= k - max(0, n - m)])
            starts = np.unique(np.concatenate(fits)) if fits else np.zeros(0, np.int64)
            if not len(starts):
                continue
            rows = [np.searchsorted(starts, x) for x in fits]
            met = _distinct(np.concatenate([self._collisions(ids, starts, rows, n, rep, lengths) for rep in range(REPETITIONS[k])]))
            if not len(met):
                continue
            pairs = np.stack(np.divmod(met, len(self.windows[n])), axis=1)
            for part in np.array_split(pairs, -(-len(pairs) // 100_000)):
                at = part[:, :1] + np.arange(-2 * k, n + 2 * k)
                near = np.clip(at, 0, len(ids) - 1)
                text = np.where((near == at) & (owner[near] == owner[part[:, :1]]), ids[near], -1)
                d = banded(text, self.windows[n][part[:, 1]], k, free=True)
                near = d <= k
                fewest = _distinct((owner[part[near, 0]] * len(self.windows[n]) + part[near, 1]) * (k + 1) + d[near])  # by text and window, then edits
                for s, w, e in zip(*(x.tolist() for x in (*np.divmod(fewest // (k + 1), len(self.windows[n])), fewest % (k + 1)))):
                    for item in self.owners[n][w]:
                        best[s, item] = min(e, best.get((s, item), e))
        for (t, item), d in best.items():
            yield t, item, d

    def _collisions(self, ids: np.ndarray, starts: np.ndarray, rows: list[np.ndarray], n: int, rep: int, lengths: list[int]) -> np.ndarray:
        """The start and the window, as one number, of all that share a key in this repetition; ``rows``: the starts that each length has."""
        keys, order = self.tables[n, rep]
        found = []
        for mine, own in zip(self.keys(ids, starts, n, rep, lengths), rows):
            low, high = np.searchsorted(keys, mine[own], "left"), np.searchsorted(keys, mine[own], "right")
            count = high - low
            hit = np.flatnonzero(count)
            count = count[hit]
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.repeat(starts[own[hit]], count) * len(order) + order[np.repeat(low[hit], count) + nth])
        return _distinct(np.concatenate(found))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values in order, each once; sorting is faster than hashing for millions of numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def banded(a: np.ndarray, b: np.ndarray, k: int, free: bool = False) -> np.ndarray:
    """The edit distance of each row of ``a`` to the same row of ``b``, windows of one length; k + 1 where it is more than ``k``.

    With ``free`` a row of ``a`` has 2 k words more on either side, and the least distance of a run of any length in it counts.
    The table of the dynamic program is only filled within k of its diagonal, or 2 k with ``free``, for all rows at once.
    """
    n, far, wide = b.shape[1], np.int8(k + 1), 2 * k if free else k
    text = a if free else np.pad(a, ((0, 0), (k, k)), constant_values=-1)
    row = [np.full(len(a), 0 if free else o if o >= 0 else far, np.int8) for o in range(-wide, wide + 1)]
    for i in range(n):
        new = []
        for o in range(2 * wide + 1):
            best = row[o] + (text[:, i + o] != b[:, i])
            if o < 2 * wide:
                best = np.minimum(best, row[o + 1] + np.int8(1))
            if o:
                best = np.minimum(best, new[-1] + np.int8(1))
            new.append(np.minimum(best, far).astype(np.int8))
        row = new
    return np.minimum.reduce(row) if free else row[k]


def leaked_items(spark: SparkSession, docs: DataFrame, items: DataFrame, run: int = RUN, edits: int = 0, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``(doc_id, item_id, edits)`` of each document and item that share a run of ``run`` words, or all words of a shorter item.

    With ``edits`` up to that many words of the run may be inserted, deleted or changed (none in runs of under 5 words, one under
    10); such rows are found with the recall of the sampling, rows with 0 edits always. Null and blank texts, and items without words, are in
    no row; null ids are left out; a repeated id counts as one document or item.
    """
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    counted = items.select("text").mapInArrow(_count_words, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks, query = max(1, -(-int(counted) // max_windows)), uuid.uuid4().hex
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("edits", T.IntegerType())])
    src = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text")
    out = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        sent = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])  # a block: at most max_windows words

        def run_block(batches: Iterator[pa.RecordBatch], sent=sent, block=block) -> Iterator[pa.RecordBatch]:
            if (query, block) not in _READY:  # made once in a Python worker for the tasks of a query
                _READY.clear()
                _READY[query, block] = Items(sent.value, run, edits)
            found = _READY[query, block]
            for b in batches:
                for part in slices(b, "text", 4_000_000):
                    ids = part.column("doc_id").to_pylist()
                    rows = [(ids[t], item, d) for t, item, d in found.find(part.column("text").to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([], [], []), _ARROW)], _ARROW.names)

        x = src.mapInArrow(run_block, schema)
        out = x if out is None else out.unionByName(x)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


_READY: dict[tuple[str, int], Items] = {}


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each batch of texts, as :func:`words` has them, so that they bound what is sent to all tasks."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(words(t)) for t in b.column(0).to_pylist())], pa.int64())], ["n"])


_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32())])


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per suite and split of the items: how many there are, how many leak, and into how many documents."""
    hit = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return (
        items.join(hit, "item_id", "left")
        .groupBy("suite", "split")
        .agg(F.count(F.lit(1)).alias("items"), F.count("n_docs").alias("leaked"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("pairs"))
    )
