"""Problem 7: encoding of a corpus with a public byte-level BPE tokenizer.

Method: tokenization automaton. At first one state reads every byte and comes back to itself. The merges are compiled
into it one after the other, in their order: where an arc ``a`` leads to a state that an arc ``b`` leaves, the gadget
of the merge (a, b) splits the state that ``a`` leads to, so that only ``a`` enters it, takes the arc ``b`` away from
it, and lets ``ab`` go past it, from wherever ``a`` went out to where ``b`` went. All arcs of one label lead to one
state, so a state is the token read last. Its arcs are those of the state it was split from, as far as they were there
then; hence only what each gadget takes away is stored, with its time (:meth:`Automaton._gadget`), and a place in the
table of transitions is worked out once, when it is first asked for (:meth:`Automaton.arc`).

The automaton is deterministic and takes every byte string in just one way. A word of the split pattern is read byte by
byte through a prefix tree of the tokens: from each place the arcs of its state lead on, each further place is
reached by one arc, and the labels on the way to the end are the tokens. Decoding emits the bytes of the labels.

Whole texts are encoded; null and empty texts have an empty list; strings that look like special tokens are ordinary
text. Words worked out once are kept in a table for what the same Python worker encodes next for the same query.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every function that takes a tokenizer.
FOLDER = os.environ.get("SPARKYARD_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"

#: Fixed value: the public split pattern of this vocabulary, with white space spelled as the Unicode property.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

#: Characters worked on at once, words kept in the table, the length up to which a word is kept, and transitions kept.
BATCH_CHARS, TABLE_WORDS, TABLE_CHARS, TABLE_ARCS = 400_000, 400_000, 64, 500_000
_SHIFT, _NEVER = 24, float("inf")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones stand for themselves, the rest are moved up from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The automaton of a byte-level BPE tokenizer, compiled from its merges."""

    def __init__(self, spec: bytes):
        """``spec`` is the content of a tokenizer file in JSON with ``model.vocab`` and ``model.merges``."""
        model = json.loads(spec)["model"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        #: the two tokens that made a token, and when; bytes have none and are there from the start
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        #: when the gadget of a merge took the arc of the second token from the state of the first
        self.taken: dict[int, int] = {}
        #: the table of transitions, as far as it was asked for
        self.arcs: dict[int, bool] = {}
        reached = {vocab[c] for c in letters}
        for time, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            if self._gadget(vocab[a], vocab[b], vocab[a + b], time, reached):
                reached.add(vocab[a + b])
        #: the prefix tree of the tokens that some arc has: node and byte to node, node to token
        self.step: dict[int, int] = {}
        self.ends = [-1]
        self.whole: dict[bytes, int] = {}
        for token in reached:
            node = 0
            for x in self.bytes_of[token]:
                key = node << 8 | x
                node = self.step.setdefault(key, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = token
            self.whole[self.bytes_of[token]] = token
        self.split = regex.compile(PATTERN)
        self.table: dict[str, tuple[int, ...]] = {}
        self.once: list[str] = []
        self.query = ""

    def _gadget(self, a: int, b: int, new: int, time: int, reached: set[int]) -> bool:
        """Compile one merge; false if no path has ``a`` before ``b`` any more, so that nothing changes."""
        if a not in reached or b not in reached or not self._has(a, b):
            return False
        self.left[new], self.right[new], self.born[new] = a, b, time
        self.taken[a << _SHIFT | b] = time
        return True

    def _gone(self, state: int, token: int) -> float:
        """When the state lost the arc ``token``: by a gadget of its own, or by one of the state that it was split from, before it was."""
        first = until = _NEVER
        while True:
            time = self.taken.get(state << _SHIFT | token, _NEVER)
            if time < until:
                first = min(first, time)
            if state not in self.right:
                return first
            until, state = self.born[state], self.right[state]

    def _has(self, state: int, token: int) -> bool:
        """Whether the arc ``token`` leaves the state by now: it has not been taken, and the arc of its first half was there when it was made."""
        if self._gone(state, token) < _NEVER:
            return False
        while token in self.left:
            made, token = self.born[token], self.left[token]
            if self._gone(state, token) <= made:
                return False
        return True

    def arc(self, state: int, token: int) -> bool:
        """The table of transitions: whether ``token`` may follow the token ``state``."""
        key = state << _SHIFT | token
        there = self.arcs.get(key)
        if there is None:
            if len(self.arcs) >= TABLE_ARCS:
                self.arcs.clear()
            there = self.arcs[key] = self._has(state, token)
        return there

    def read(self, word: bytes) -> tuple[int, ...]:
        """The labels of the one way on which the automaton takes the word."""
        if word in self.whole:
            return (self.whole[word],)
        step, ends, arc, size = self.step, self.ends, self.arc, len(word)
        label, start = [-1] * (size + 1), [0] * (size + 1)
        for j in range(size):
            state, node = label[j], 0
            for i in range(j, size):
                node = step.get(node << 8 | word[i])
                if node is None:
                    break
                token = ends[node]
                if token >= 0 and label[i + 1] < 0 and (not j or arc(state, token)):
                    label[i + 1], start[i + 1] = token, j
        path = []
        while size:
            path.append(label[size])
            size = start[size]
        return tuple(reversed(path))

    def tokens(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """A table that has the tokens of all these words until the next call."""
        table = self.table
        for w in self.once:
            del table[w]
        new = {w for w in set(words) if w not in table}
        if len(table) + len(new) > TABLE_WORDS:
            table.clear()
            new = set(words)
        read = self.read
        table.update((w, read(w.encode())) for w in new)
        self.once = [w for w in new if len(w) > TABLE_CHARS]  # such words hardly come again
        return table

    def words(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """The ids of each text, in order; short texts are worked on together, a long one in runs of words."""
        for group in batched_by_size(texts):
            if len(group) == 1 and group[0] and len(group[0]) > BATCH_CHARS:
                ids: list[int] = []
                found = (m.group() for m in self.split.finditer(group[0]))
                while part := list(islice(found, BATCH_CHARS // 4)):
                    ids += chain.from_iterable(map(self.tokens(part).__getitem__, part))
                yield ids
                continue
            split = [self.words(t) if t else [] for t in group]
            get = self.tokens(list(chain.from_iterable(split))).__getitem__
            for words in split:
                yield list(chain.from_iterable(map(get, words)))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def batched_by_size(texts: Iterable[str | None], chars: int = BATCH_CHARS) -> Iterator[list[str | None]]:
    """Runs of texts of about ``chars`` characters; a longer text is a run of its own."""
    group, size = [], 0
    for t in texts:
        n = len(t or "")
        if group and size + n > chars:
            yield group
            group, size = [], 0
        group.append(t)
        size += n
    if group:
        yield group


_LOADED: dict[str, Automaton] = {}


def load(spec: bytes, query: str = "") -> Automaton:
    """The automaton of a tokenizer file; one for each Python worker. Tasks of one ``query`` share the words met so far, queries don't."""
    key = hashlib.sha1(spec).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Automaton(spec)
    found = _LOADED[key]
    if found.query != query:
        found.query, found.once = query, []
        found.table.clear()
        found.arcs.clear()
    return found


def read_spec(name: str = NAME, folder: str = FOLDER) -> bytes:
    """The tokenizer file, read by the driver; tasks get its content (1.5 MB) and need no such file."""
    with open(os.path.join(folder, f"{name}.json"), "rb") as f:
        return f.read()


def encode(spark: SparkSession, df: DataFrame, text: str, keep: list[str], out: str = "ids", name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` and the list of token ids of each row's ``text``. Runs within each partition; nothing is shuffled."""
    spec, query = spark.sparkContext.broadcast(read_spec(name, folder)), uuid.uuid4().hex
    src = df.select(*keep, F.col(text).alias("$text"))
    schema = T.StructType([*(src.schema[k] for k in keep), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(spec.value, query)
        for b in batches:
            for part in slices(b, "$text"):
                offsets, ids = [0], []
                for x in automaton.encode_all(part.column("$text").to_pylist()):
                    ids += x
                    offsets.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), lists], schema.names)

    return src.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: str, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``size`` bytes of text, so that memory follows neither the rows of a batch nor their length."""
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(text)).to_pylist()):
        if i > start and held + (n or 0) > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def decode(spark: SparkSession, df: DataFrame, ids: str, keep: list[str], out: str = "text", name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """The columns ``keep`` and the text of each row's ids; a null list gives null, an empty one the empty text."""
    spec, query = spark.sparkContext.broadcast(read_spec(name, folder)), uuid.uuid4().hex
    src = df.select(*keep, F.col(ids).alias("$ids"))
    schema = T.StructType([*(src.schema[k] for k in keep), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(spec.value, query)
        for b in batches:
            texts = [None if x is None else automaton.decode(x) for x in b.column("$ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(texts, pa.string())], schema.names)

    return src.mapInArrow(run, schema)
