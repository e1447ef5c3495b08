"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all windows of every text.

Words are ASCII-lower-cased runs of digits, letters a-z and characters beyond ASCII. The windows of an item are its runs
of 13 words (an item with fewer words is one window). Up to ``BLOCK_WINDOWS`` windows and ``BLOCK_BYTES``, counted after they were written
out, the set is broadcast whole as flat arrays sorted by hash, and a window whose hash hits is compared word by word before it counts. Beyond that, what is broadcast is
a Bloom filter of the hashes with ``FILTER_BITS`` bits, whatever the number of windows; document windows that pass it are written out and
joined with the table of windows on hash and words, which compares them word by word as well. Either way a task's memory has a bound
that the benchmark doesn't move.

Defined results: a null or wordless text has no windows and is clean; an item without words or without id is ignored; repeated items
count once; an empty benchmark leaves every document clean; repeated rows are each judged; texts are read whole; a window of several
items counts for all of them. Columns n_words, n_hit, hits, items and contaminated of the input give way to the operator's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Saved, with_text_columns

WINDOW = 13
#: Windows that are broadcast, and their bytes: words, item ids and 20 bytes more for each.
BLOCK_WINDOWS, BLOCK_BYTES = 400_000, 60 << 20
#: 4 MB; a larger benchmark lets more windows through to the join.
FILTER_BITS = 1 << 25

_ITEM_FIELDS = [T.StructField("windows", T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("words", T.BinaryType())])))]
_HIT_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("__hits", T.ArrayType(T.IntegerType())), T.StructField("__items", T.ArrayType(T.StringType()))]
_MET = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), *_ITEM_FIELDS[0].dataType.elementType.fields]))
_MET_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("__row", T.LongType()), T.StructField("__met", _MET)]
_COLUMNS = ("n_words", "n_hit", "hits", "items", "contaminated")


def _words(column: pa.Array) -> tuple[bytes, tv.Words]:
    data, offsets = tv.utf8(column)
    data = tv.LOWER[data]
    mask = tv.ALNUM[data]
    text = np.where(mask, data, np.uint8(32)).tobytes()
    return text, tv.Words(data, offsets, mask)


def _spelt(text: bytes, words: tv.Words, first: int, n: int) -> bytes:
    return b" ".join(text[words.starts[first] : words.ends[first + n - 1]].split())


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", n: int = WINDOW) -> DataFrame:
    """item (string), n, key and words of each distinct window of each item."""

    def compute(column: pa.Array) -> list[pa.Array]:
        spelt, words = _words(column)
        found = []
        for i, count in enumerate(words.counts):
            size = min(n, int(count))
            seen = {}
            for first in range(words.at[i], words.at[i + 1] - size + 1) if size else ():
                seen.setdefault(_spelt(spelt, words, first, size), first)
            own = []
            for phrase, first in seen.items():
                h = np.full(1, size, tv.U)
                for j in range(size):
                    h += words.hash[first + j : first + j + 1] * tv._PLACE[j]
                own.append({"n": size, "key": int(tv.mix(h).view(np.int64)[0]), "words": phrase})
            found.append(own)
        return [pa.array(found, pa.list_(pa.struct([("n", pa.int32()), ("key", pa.int64()), ("words", pa.binary())])))]

    items = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    return with_text_columns(items, ["item"], compute, _ITEM_FIELDS).select("item", F.inline("windows")).distinct()


class WindowSet:
    """Windows by number of words and hash, as flat arrays: a row for each window and item, sorted by hash."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("n", "ascending"), ("key", "ascending")])
        self.n, self.key = (rows.column(c).to_numpy() for c in ("n", "key"))
        self.words, self.item = (rows.column(c).combine_chunks() for c in ("words", "item"))
        self.spans = {int(n): (int(np.searchsorted(self.n, n)), int(np.searchsorted(self.n, n, side="right"))) for n in np.unique(self.n)}

    def meeting(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the ``keys`` are there, and the first row of each."""
        begin, end = self.spans[n]
        known = self.key[begin:end]
        near = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = np.flatnonzero(known[near] == keys)
        return found, near[found] + begin

    def items(self, row: int, n: int, spelt: bytes) -> list[str]:
        """Items of the rows from ``row`` on with that row's hash whose words are ``spelt``."""
        out, key, end = [], self.key[row], self.spans[n][1]
        while row < end and self.key[row] == key:
            if self.words[row].as_py() == spelt:
                out.append(self.item[row].as_py())
            row += 1
        return out


def _scan(column: pa.Array, known: WindowSet) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set]]:
    """Words of each text, and its hit word positions and items."""
    text, words = _words(column)
    docs = len(words.counts)
    hit, items = np.zeros(len(words.hash) + 1, np.int32), [set() for _ in range(docs)]
    for n in known.spans:
        at, window = words.windows(n)
        for i, row in zip(*known.meeting(n, window.view(np.int64)), strict=True):
            first = int(at[i])
            got = known.items(int(row), n, _spelt(text, words, first, n))
            if got:
                hit[first : first + n] = 1
                items[int(np.searchsorted(words.at, first, side="right")) - 1].update(got)
    return words.counts, words.at, hit, items


def _whole_set(docs: DataFrame, windows: Saved, keep: list[str], text: str) -> DataFrame:
    """``keep`` with n_words, __hits and __items, by a broadcast of all ``windows``."""
    shipped = docs.sparkSession.sparkContext.broadcast(WindowSet(windows.df.toArrow()))  # counted: within BLOCK_WINDOWS and BLOCK_BYTES

    def compute(column: pa.Array) -> list[pa.Array]:
        counts, at, hit, items = _scan(column, shipped.value)
        hits = [np.flatnonzero(hit[at[i] : at[i + 1]]) for i in range(len(counts))]
        flat = np.concatenate(hits).astype(np.int32) if hits else np.zeros(0, np.int32)
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, hits)]), pa.int32()), pa.array(flat))
        return [pa.array(counts.astype(np.int64)), listed, pa.array([sorted(s) for s in items], pa.list_(pa.string()))]

    return with_text_columns(docs, keep, compute, _HIT_FIELDS, text)


def _places(keys: np.ndarray) -> list[np.ndarray]:
    """Two bits of the filter for each key."""
    return [(tv.mix(keys + tv.U(i)) % tv.U(FILTER_BITS)).astype(np.int64) for i in (1, 2)]


def _filter_of(windows: DataFrame) -> np.ndarray:
    """The Bloom filter of all keys: bits are set in bytes, which are put together by place, FILTER_BITS / 8 rows at most."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy().view(tv.U)
            places = np.unique(np.concatenate(_places(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 3), pa.array((1 << (places & 7)).astype(np.int32))], names=["byte", "bit"])

    rows = windows.select("key").mapInArrow(run, "byte long, bit int").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return bits


def _by_join(docs: DataFrame, windows: Saved, keep: list[str], text: str) -> DataFrame:
    """The same by a filter of bounded size and a join of what passes it."""
    sizes = [r[0] for r in windows.df.select("n").distinct().collect()]  # 1 to 13
    shipped = docs.sparkSession.sparkContext.broadcast(_filter_of(windows.df))
    seen = {"rows": 0}

    def compute(column: pa.Array) -> list[pa.Array]:
        spelt, words = _words(column)
        bits = shipped.value
        met: list[list[dict]] = [[] for _ in words.counts]
        for n in sizes:
            at, keys = words.windows(n)
            one, two = _places(keys)
            for i in np.flatnonzero((bits[one >> 3] >> (one & 7)) & (bits[two >> 3] >> (two & 7)) & 1):
                first = int(at[i])
                doc = int(np.searchsorted(words.at, first, side="right")) - 1
                met[doc].append({"at": first - int(words.at[doc]), "n": n, "key": int(keys[i : i + 1].view(np.int64)[0]), "words": _spelt(spelt, words, first, n)})
        begin = (TaskContext.get().partitionId() << 40) + seen["rows"]
        seen["rows"] += len(met)
        kind = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("words", pa.binary())]))
        return [pa.array(words.counts.astype(np.int64)), pa.array(np.arange(begin, begin + len(met))), pa.array(met, kind)]

    scanned = Saved(with_text_columns(docs, keep, compute, _MET_FIELDS, text), "scanned")  # row numbers are fixed from here on
    met = scanned.df.select("__row", F.inline("__met")).join(windows.df.hint("merge"), ["n", "key", "words"])
    spots = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence("at", F.col("at") + F.col("n") - 1)))))
    found = Saved(met.groupBy("__row").agg(spots.alias("__hits"), F.array_sort(F.collect_set("item")).alias("__items")), "found")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return scanned.df.drop("__met").join(found.df.hint("merge"), "__row", "left").select(*keep, "n_words", empty("__hits", "int"), empty("__items", "string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", n: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words, n_hit, hits (positions of hit words), items (sorted ids) and contaminated.

    A document is contaminated if at least a twentieth of its words are hit. To cut only the hit words out, drop the words at
    ``hits``; to remove whole documents, filter on ``contaminated``.
    """
    keep = [c for c in keep if c not in _COLUMNS]
    windows = Saved(benchmark_windows(benchmark, item, "text", n), "windows")
    count, size = windows.df.agg(F.count("*"), F.coalesce(F.sum(F.length("words") + F.octet_length("item") + 20), F.lit(0))).first()
    found = (_whole_set if count <= block_windows and size <= BLOCK_BYTES else _by_join)(docs, windows, keep, text)
    n_hit = F.size("__hits").cast("long")
    return found.select(
        *keep, "n_words", n_hit.alias("n_hit"), F.col("__hits").alias("hits"), F.col("__items").alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def items_sha256(items: list[str]) -> str:
    """What the query's ``items_sha256`` holds, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
