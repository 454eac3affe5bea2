"""Problem 5: freely typed values mapped to the closest entry of a reference list.

Method: symmetric delete. Every reference entry is entered in a dictionary under all that up to k deletions make of its
letters; a value looks up all that up to k deletions make of its own, so any form within edit distance k shares one of
them. The letters are put in order first: words come in any order and run together, which changes nothing then, nor do
swapped letters; so one entry stands for all its word orders, however many words it has. What is looked up is verified
and ranked by weighted Damerau-Levenshtein distance to the form, in the word order that fits best, of classes that are
as near by the reference frequency only within one class: a value as near to several classes, and one without a form in
reach, is reported as a miss (-1).

Values and forms are compared folded: NFKC, lower case, look-alike letters and digits brought into the script of the
rest, only letters and digits, without the spaces between words. A reference list of up to ``MAX_FORMS`` entries goes to
all tasks; the values never leave their partition, each distinct one is worked out once in a Python worker and query. A
longer list stays a table: the deletions of its letters and of those of the distinct values are joined
(:func:`map_values_by_join`), with the same result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkyard.functions.text import strip_or_null
from sparkyard.operators.ranking import row_numbers
from sparkyard.session import Scratch

MAX_EDITS = 2
#: Reference entries that are sent to all tasks at most; a dictionary takes about 100 KB an entry.
MAX_FORMS = 5_000
#: Distinct values a Python worker remembers over the tasks of a query.
MEMO = 200_000

# Letters that look alike in the two scripts, position by position, and digits and signs that stand for letters.
_LATIN = "aeopcyxkmtbh"
_CYRILLIC = "аеорсухкмтвн"
_AS_LATIN = {"0": "o", "1": "i", "3": "e", "5": "s", "|": "l", "@": "a", "$": "s"}
_AS_CYRILLIC = {"0": "о", "3": "з", "ё": "е"}
#: Endings of the plural that annotators add.
_PLURALS = ("s", "es", "ы", "и")

_TO_LATIN = str.maketrans(dict(zip(_CYRILLIC, _LATIN)) | _AS_LATIN)
_TO_CYRILLIC = str.maketrans(dict(zip(_LATIN, _CYRILLIC)) | _AS_CYRILLIC)


def fold(text: str) -> list[str]:
    """The words of a value in the folded form."""
    t = unicodedata.normalize("NFKC", text).lower()
    # the letters that the other script has no look-alike of tell the script, else the greater part
    latin, cyrillic = ([c for c in t if low <= c <= high or c == more] for low, high, more in (("a", "z", ""), ("а", "я", "ё")))
    if latin or cyrillic:
        latin, cyrillic = ((sum(c not in alike for c in x), len(x)) for x, alike in ((latin, _LATIN), (cyrillic, _CYRILLIC)))
        t = t.translate(_TO_LATIN if latin >= cyrillic else _TO_CYRILLIC)
    return re.findall(r"[^\W_]+", t)


def reach(n: int, edits: int = MAX_EDITS) -> int:
    """How many edits a value of ``n`` letters may have: none up to 3, one at 4, else ``edits``."""
    return 0 if n <= 3 else min(edits, 1) if n == 4 else edits


def deletes(text: str, k: int) -> set[str]:
    """All that up to ``k`` deletions make of the text, itself included."""
    out = {text}
    for n in range(1, min(k, len(text)) + 1):
        for gone in combinations(range(len(text)), n):
            ends = (-1, *gone, len(text))
            out.add("".join([text[i + 1 : j] for i, j in zip(ends, ends[1:])]))
    return out


def orders(words: list[str], key: str, k: int) -> Iterator[str]:
    """The words run together in every order that may lie within ``k`` edits of ``key``, each once.

    A beginning is given up when it is more than 2 ``k`` insertions, deletions and changes (a swap counts 2) from every beginning of the key.
    """

    def further(done: str, row: list[int], rest: list[str]) -> Iterator[str]:
        if not rest:
            yield done
        for n, word in enumerate(rest):
            if word in rest[:n]:
                continue
            new = row
            for x in word:
                last, new = new, [new[0] + 1]
                for j, y in enumerate(key):
                    new.append(min(last[j] + (x != y), last[j + 1] + 1, new[j] + 1))
            if min(new) <= 2 * k:
                yield from further(done + word, new, rest[:n] + rest[n + 1 :])

    if len(words) == 1:
        yield words[0]
    else:
        yield from further("", list(range(len(key) + 1)), words)


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance, edits between swapped letters allowed."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    return int(_damerau(a, b, 1.0, 1.0)) if a and b else len(a) + len(b)


def weighted(a: str, b: str) -> float:
    """The same with lighter swaps and doubled letters, to rank what is equally far."""
    return _damerau(a, b, 0.9, 0.7)


def _damerau(a: str, b: str, swap: float, double: float) -> float:
    far = float(len(a) + len(b) + 1)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    gap = lambda s, i: double if i and s[i] == s[i - 1] else 1.0
    d[1][1] = 0.0
    for i in range(len(a)):
        d[i + 2][1] = d[i + 1][1] + gap(a, i)
    for j in range(len(b)):
        d[1][j + 2] = d[1][j + 1] + gap(b, j)
    last: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            p, q = last.get(y, 0), seen
            if x == y:
                seen = j
            d[i + 1][j + 1] = min(
                d[i][j] + (x != y),
                d[i][j + 1] + gap(a, i - 1),
                d[i + 1][j] + gap(b, j - 1),
                d[p][q] + (i - p - 1) + swap + (j - q - 1),
            )
        last[x] = i
    return d[-1][-1]


class Forms:
    """The delete dictionary of a reference list ``[(class_id, written form, frequency)]``."""

    def __init__(self, entries: list[tuple[int, str, int]], edits: int = MAX_EDITS):
        self.edits, self.entries = edits, entries
        self.known: dict[str, tuple[int | None, int, int]] = {}
        self.query = ""
        self.words = [fold(text) for _, text, _ in entries]
        #: the letters of an entry and of its plurals, in order and with deletions, to (entry, ending)
        self.index: dict[str, list[tuple[int, str]]] = {}
        for n, words in enumerate(self.words):
            whole = "".join(words)
            for ending in ("", *_PLURALS) if whole else ():
                for x in deletes("".join(sorted(whole + ending)), reach(len(whole + ending), edits)):
                    self.index.setdefault(x, []).append((n, ending))

    def find(self, value: str | None) -> tuple[int | None, int, int]:
        """``(class_id, entry, edits)``: null for a null or blank value, -1 and entry -1 where none, or several classes alike, are in reach."""
        if value is None or not value.strip():
            return None, -1, -1
        key = "".join(fold(value))
        if key not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[key] = self._find(key)
        return self.known[key]

    def near(self, key: str) -> dict[tuple[int, str], int]:
        """The forms in reach, as (entry, letters), with their edits."""
        k, out = reach(len(key), self.edits), {}
        found: dict[int, set[str]] = {}
        for x in deletes("".join(sorted(key)), k):
            for n, ending in self.index.get(x, ()):
                found.setdefault(n, set()).add(ending)
        for n, endings in found.items():
            for order in orders(self.words[n], key, k):
                for ending in endings:
                    form = order + ending
                    most = min(k, reach(len(form), self.edits))
                    if abs(len(form) - len(key)) <= most and (d := distance(key, form)) <= most:
                        out[n, form] = d
        return out

    def _find(self, key: str) -> tuple[int | None, int, int]:
        far = self.near(key)
        if not far:
            return -1, -1, -1
        best = min(far.values())
        rank = [(weighted(key, form), -self.entries[n][2], n) for (n, form), d in far.items() if d == best]
        top = min(rank)
        if len({self.entries[n][0] for w, _, n in rank if w == top[0]}) > 1:
            return -1, -1, best
        return self.entries[top[2]][0], top[2], best

    def nearest(self, key: str) -> list[tuple[int, float, int]]:
        """``(edits, weighted distance, entry)`` of each entry in reach, by its best form."""
        best: dict[int, tuple[int, float]] = {}
        for (n, form), d in self.near(key).items():
            best[n] = min(best.get(n, (d, weighted(key, form))), (d, weighted(key, form)))
        return [(*v, n) for n, v in best.items()]


@lru_cache(maxsize=2)
def forms_of(entries: tuple) -> Forms:
    """The dictionary of a reference list, made once in a Python worker."""
    return Forms(list(entries))


def written_forms(reference: DataFrame) -> DataFrame:
    """``(class_id, form)`` of the reference table ``(class_id, class_name, alias)``: each written form once per class."""
    x = reference.where("class_id IS NOT NULL").select("class_id", F.explode(F.array("class_name", "alias")).alias("form"))
    return x.where(strip_or_null(F.col("form")).isNotNull()).distinct()


def reference_entries(reference: DataFrame, most: int = MAX_FORMS) -> list[tuple[int, str, int]] | None:
    """The written forms in order, all of frequency 0; null if there are more than ``most``."""
    rows = written_forms(reference).limit(most + 1).collect()
    return None if len(rows) > most else sorted((r["class_id"], r["form"], 0) for r in rows)


def with_frequency(spark: SparkSession, df: DataFrame, value: str, entries: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The entries with how often each is written exactly; one aggregation, and at most as many rows as there are entries come back."""
    forms = spark.createDataFrame([(t,) for t in {t for _, t, _ in entries}], "form string")
    n = dict(df.join(F.broadcast(forms), F.col(value) == F.col("form")).groupBy("form").count().collect()) if entries else {}
    return [(c, t, n.get(t, 0)) for c, t, _ in entries]


def map_values(spark: SparkSession, df: DataFrame, value: str, entries: list[tuple[int, str, int]]) -> DataFrame:
    """``df`` with ``class_id`` (-1: a miss, null: nothing written), ``matched`` (the reference form) and ``edits``; columns of these names are replaced."""
    df = df.drop("class_id", "matched", "edits")
    forms, query = spark.sparkContext.broadcast(tuple(entries)), uuid.uuid4().hex

    src = df.withColumn("$value", F.col(value))
    schema = T.StructType([*df.schema.fields, T.StructField("class_id", T.IntegerType()), T.StructField("matched", T.StringType()), T.StructField("edits", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forms_of(forms.value)
        if f.query != query:
            f.known.clear()  # tasks of one query share what values gave, queries don't
            f.query = query
        for b in batches:
            values = b.column("$value").dictionary_encode()
            found = [f.find(v) for v in values.dictionary.to_pylist()]
            rows = [(c, f.entries[n][1] if n >= 0 else None, e if n >= 0 else None) for c, n, e in found]
            columns = [pa.array(x, t).take(values.indices) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), *columns], schema.names)

    return src.mapInArrow(run, schema)


_DELETED = "text string, n long, h long"


def _deleted(edits: int, endings: tuple[str, ...]):
    """Of rows ``(text, n)`` a row for all that deletions make of the letters in order; ``h`` is a hash of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, n in zip(b.column("text").to_pylist(), b.column("n").to_pylist()):
                whole = "".join(fold(text))
                for ending in endings if whole or endings == ("",) else ():
                    keys = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big", signed=True) for x in deletes("".join(sorted(whole + ending)), reach(len(whole + ending), edits))]
                    same = lambda v, t: pa.array([v] * len(keys), t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([same(text, pa.string()), same(n, pa.int64()), pa.array(keys, pa.int64())], ["text", "n", "h"])

    return run


def map_values_by_join(spark: SparkSession, df: DataFrame, value: str, forms: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """As :func:`map_values` for a reference list of any length: ``forms`` is ``(class_id, form, n)`` with the frequency ``n``.

    Both sides' deletions are joined by hash, candidates are verified as in the dictionary, and the best of a value is picked by aggregations over its candidates.
    Distinct values are worked on, so one that many rows share is no more work; the rows get their result by a join whose sides are written before.
    """
    scratch = Scratch(spark, "canonical")
    df = df.drop("class_id", "matched", "edits")
    entries = scratch.save(row_numbers(forms, [], [F.asc("class_id"), F.asc("form")], "entry"), "entries")
    values = scratch.save(df.where(strip_or_null(F.col(value)).isNotNull()).select(F.col(value).alias("text")).distinct(), "values")
    left = values.select("text", F.lit(0).cast("bigint").alias("n")).mapInArrow(_deleted(edits, ("",)), _DELETED)
    right = entries.select(F.col("form").alias("text"), F.col("entry").cast("bigint").alias("n")).mapInArrow(_deleted(edits, ("", *_PLURALS)), _DELETED)
    met = left.select("h", F.col("text").alias("value")).join(right.select("h", F.col("text").alias("form"), F.col("n").alias("entry")), "h").select("value", "form", "entry").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, form, entry in zip(*(b.column(c).to_pylist() for c in ("value", "form", "entry"))):
                out += [(v, entry, d, w) for d, w, _ in Forms([(0, form, 0)], edits).nearest("".join(fold(v)))]
            columns = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.float64()))], ["value", "entry", "edits", "far"])

    near = met.mapInArrow(verify, "value string, entry long, edits int, far double").join(entries.withColumn("entry", F.col("entry").cast("bigint")), "entry")
    near = scratch.save(near.select("value", "edits", "far", "class_id", "form", "n", "entry"), "near")
    best = near.groupBy("value").agg(F.min(F.struct("edits", "far")).alias("b"))
    top = near.join(best, "value").where("edits = b.edits AND far = b.far").groupBy("value").agg(F.count_distinct("class_id").alias("k"), F.min(F.struct(-F.col("n"), "entry", "class_id", "form", "edits")).alias("t"))
    top = scratch.save(top.where("k = 1").select(F.col("value").alias("$v"), F.col("t.class_id").alias("class_id"), F.col("t.form").alias("matched"), F.col("t.edits").alias("edits")), "best")
    x = df.join(top, F.col(value) == F.col("$v"), "left").drop("$v")
    return x.withColumn("class_id", F.when(strip_or_null(F.col(value)).isNotNull(), F.coalesce("class_id", F.lit(-1))))


def current_audit(audit: DataFrame) -> DataFrame:
    """One row per ``audit_id``: of its rows with something written the one with the latest ``recorded_at``, then the greatest value."""
    written = audit.where(F.col("audit_id").isNotNull() & strip_or_null(F.col("raw_class")).isNotNull())
    # looking up is work for the CPU: a set number of partitions, which adaptive execution doesn't merge by their few bytes
    written = written.repartition(int(audit.sparkSession.conf.get("spark.sql.shuffle.partitions")), "audit_id")
    row = F.max(F.struct("recorded_at", "raw_class", F.coalesce("bbox_count", F.lit(0)).alias("bbox_count"), "source")).alias("r")
    return written.groupBy("audit_id").agg(row).select("audit_id", "r.source", "r.raw_class", "r.bbox_count")


def mapped_classes(spark: SparkSession, audit: DataFrame, reference: DataFrame, ranked: bool = True, max_forms: int = MAX_FORMS) -> DataFrame:
    """``(audit_id, source, raw_class, bbox_count, class_id, matched, edits)``.

    If not ``ranked``, ``matched`` may be any of the forms of the class that are as near: frequencies decide nothing else, and aren't counted.
    """
    rows, entries = current_audit(audit), reference_entries(reference, max_forms)
    if entries is None:
        forms = written_forms(reference)
        n = rows.groupBy(F.col("raw_class").alias("form")).agg(F.count(F.lit(1)).alias("n")) if ranked else None
        forms = forms.withColumn("n", F.lit(0).cast("bigint")) if n is None else forms.join(n, "form", "left").select("class_id", "form", F.coalesce("n", F.lit(0)).alias("n"))
        return map_values_by_join(spark, rows, "raw_class", forms)
    return map_values(spark, rows, "raw_class", with_frequency(spark, rows, "raw_class", entries) if ranked else entries)


def misses(spark: SparkSession, audit: DataFrame, reference: DataFrame) -> DataFrame:
    """The unmatched spellings with how many rows and boxes each has."""
    m = mapped_classes(spark, audit, reference, ranked=False).where("class_id = -1")
    return m.groupBy("raw_class").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("bbox_count").alias("boxes"))
