"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics come from the bytes and words of each text in vectorised passes. Learning reads every labelled document;
its statistics, a few numbers a document, are quantised into ``BINS`` bins and the trees grow on gradient histograms: on the driver for
``LOCAL`` documents or fewer, beyond that each level is a sum over a table of bins (``grow_table``). Scoring flattens all trees into arrays (feature, threshold, left, right,
value) and walks every document of a batch through a tree at once.

Defined results: a null or empty text has statistics 0 and a score like any other; with no labels, or labels of one kind
only, the score is that kind's smoothed share; of labels that disagree on a document the majority holds, 0 on a tie
(``one_label``); repeated rows have equal scores; long texts are read whole; an empty table gives an empty result. Equal gains of a split go to the
first statistic and the lowest bin. Columns score and predicted of the input give way to the operator's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Saved, bounded_batches, one_label, sized, with_text_columns

#: Documents whose statistics the driver may hold; rows of bins that one task sums up.
LOCAL, TASK_ROWS = 20_000, 50_000
BINS = 64
#: Trees after which the rows' sums of values are written out; parts of a gradient that are counted, so that sums are exact in any order.
WRITTEN, PARTS = 10, 1 << 30
TREES, DEPTH, RATE, LEAF_L2, MIN_LEAF = 60, 4, 0.2, 1.0, 10


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _LOWER, _DIGIT = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("0123456789")
_CLASSES = {
    "upper": _UPPER, "lower": _LOWER, "digit": _DIGIT, "stop": _bytes(".?"), "comma": _bytes(",;:"), "bang": _bytes("!"), "bar": _bytes("|"),
    "symbol": _bytes("#$%&*@^~_=+<>"), "quote": _bytes("\"'()[]{}"), "line": _bytes("\n"), "blank": tv.BLANK, "beyond": np.arange(256) >= 128,
}
FEATURES = [
    "log_bytes", "log_words", "word_length", "long_words", "short_words", "distinct_words", "distinct_lines", "words_a_line", "repeated_windows", "longest_word",
    *_CLASSES,
]


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = tv.utf8(column)
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    sums = tv.prefix(data)
    words = tv.Words(data, offsets, ~tv.BLANK[data], sums)
    owner = np.repeat(np.arange(n), words.counts)
    long = (words.ends - words.starts).astype(np.int64)
    some = np.maximum(words.counts, 1)

    def distinct(keys: np.ndarray, owners: np.ndarray) -> np.ndarray:
        # the lowest bits of a hash give way to the text's number, so that one plain sort brings equal ones of a text together
        low = tv.U((1 << n.bit_length()) - 1)
        both = np.sort(keys & ~low | owners.astype(tv.U))
        first = np.concatenate([[True], both[1:] != both[:-1]]) if len(both) else np.zeros(0, bool)
        return np.bincount((both[first] & low).astype(np.int64), minlength=n)

    lines_from, lines_to = tv.runs(data != 10, offsets)
    line_owner = np.searchsorted(offsets, lines_from, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    at, window = words.windows(3)
    windows = np.bincount(owner[at], minlength=n)
    longest = np.zeros(n)
    full = words.counts > 0
    if len(long):
        longest[full] = np.maximum.reduceat(long, words.at[:-1][full])
    out = [
        np.log1p(size), np.log1p(words.counts), tv.sums_by_text(long, words.at) / some, tv.sums_by_text(long > 12, words.at) / some,
        tv.sums_by_text(long < 4, words.at) / some, distinct(words.hash, owner) / some,
        distinct(tv.span_hash(sums, lines_from, lines_to), line_owner) / np.maximum(lines, 1), words.counts / np.maximum(lines, 1),
        1 - distinct(window, owner[at]) / np.maximum(windows, 1), longest,
    ]
    # a text's bytes are counted by value, in one pass for all classes
    values = np.array([np.bincount(data[begin:end], minlength=256) for begin, end in zip(offsets[:-1], offsets[1:], strict=True)]).reshape(n, 256)
    out += [c / np.maximum(size, 1) for c in (values @ np.stack(list(_CLASSES.values()), axis=1).astype(np.int64)).T]
    return np.stack(out, axis=1).astype(np.float64)


@dataclass
class Trees:
    """All trees in flat arrays; ``root`` has each tree's first node; a leaf points to itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Trees for the log-odds of y, from histograms of gradients over the bins of x."""
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        at = len(nodes["value"])
        for k, v in zip(nodes, (0, np.inf, at, at, value), strict=True):
            nodes[k].append(v)
        return at

    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            root = node(0.0)
            roots.append(root)
            todo, level = [(root, np.arange(len(y)))], 0
            while todo and level < depth:
                following = []
                for at, rows in todo:
                    gain, where = 1e-6, None
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j in range(x.shape[1]):
                        size = len(edges[j]) + 1
                        b = binned[rows, j]
                        gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], None))
                        if not len(gl):
                            continue
                        gained = gl**2 / (hl + LEAF_L2) + (gs - gl) ** 2 / (hs - hl + LEAF_L2) - gs**2 / (hs + LEAF_L2)
                        gained[(nl < MIN_LEAF) | (len(rows) - nl < MIN_LEAF)] = -1
                        best = int(gained.argmax())
                        if gained[best] > gain:
                            gain, where = gained[best], (j, best)
                    if where is None:
                        continue
                    j, cut = where
                    goes = binned[rows, j] <= cut
                    nodes["feature"][at], nodes["threshold"][at] = j, edges[j][cut]
                    for side, part in (("left", rows[goes]), ("right", rows[~goes])):
                        child = node(float(RATE * g[part].sum() / (h[part].sum() + LEAF_L2)))
                        nodes[side][at] = child
                        following.append((child, part))
                todo, level = following, level + 1
            at = np.full(len(y), root)
            for _ in range(depth):
                f = np.array(nodes["feature"])[at]
                at = np.where(x[np.arange(len(y)), f] <= np.array(nodes["threshold"])[at], np.array(nodes["left"])[at], np.array(nodes["right"])[at])
            raw = raw + np.array(nodes["value"])[at]
    arrays = {k: np.array(v, np.int64 if k in ("feature", "left", "right") else float) for k, v in nodes.items()}
    return Trees(base=base, root=np.array(roots, np.int64), depth=depth, **arrays)


def _walk(nodes: dict[str, np.ndarray], roots: list[int], depth: int, bins: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``total`` with the values of all trees but the last one added for each row of ``bins``, and the node of the last tree where it is."""
    rows, at = np.arange(len(bins)), np.zeros(len(bins), np.int64)
    for root in roots:
        total = total + nodes["value"][at] if root != roots[0] else total
        at = np.full(len(bins), root)
        for _ in range(depth):
            at = np.where(bins[rows, nodes["feature"][at]] <= nodes["cut"][at], nodes["left"][at], nodes["right"][at])
    return total, at


def grow_table(rows: DataFrame, n_features: int, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """The trees of ``grow`` for a table (y double, x array) of any size: its rows stay in tasks, a level's histograms are summed by Spark.

    Edges of bins are quantiles from a sketch of all rows, to one of 10 000 parts.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    counted = rows.agg(F.count("*").alias("n"), F.sum("y").alias("s")).first()
    n, ones = counted["n"], counted["s"] or 0.0
    if n <= LOCAL:
        got = rows.orderBy("x", "y").collect()
        return grow(np.array([r["x"] for r in got]).reshape(-1, n_features), np.array([r["y"] for r in got]), trees, depth)
    share = (ones + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "cut", "left", "right", "value")}
    roots: list[int] = []

    def node(value: float) -> int:
        at = len(nodes["value"])
        for k, v in zip(nodes, (0, np.inf, 255, at, at, value), strict=True):
            nodes[k].append(v)
        return at

    def flat() -> dict[str, np.ndarray]:
        return {k: np.array(v, np.int64 if k in ("feature", "cut", "left", "right") else float) for k, v in nodes.items()}

    if 0 < ones < n:
        quantiles = [i / BINS for i in range(1, BINS)]
        found = rows.agg(*(F.percentile_approx(F.get("x", F.lit(j)), quantiles, 10_000).alias(f"q{j}") for j in range(n_features))).first()
        edges = [np.unique(np.array(q)) for q in found]

        def quantised(batches):
            for batch in batches:
                x = batch.column("x").flatten().to_numpy().reshape(-1, n_features)
                bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (batch.column("y").to_numpy(), bins)], names=["y", "bins"])

        tasks = 1 + n // TASK_ROWS
        binned = Saved(rows.repartition(tasks).select("y", "x").mapInArrow(quantised, "y binary, bins binary"), "tree-bins")
        # blocks of rows that stay with the executors (labels, bins, sums of the trees so far); an RDD, as hundreds of small jobs on it need no plan
        blocks = binned.df.rdd.map(lambda r: (np.frombuffer(r["y"]), np.frombuffer(r["bins"], np.uint8).reshape(-1, n_features), base)).coalesce(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        before = None
        for tree in range(trees):
            if tree and tree % WRITTEN == 0:
                before, blocks = blocks, blocks.map(_adder(flat(), roots[-WRITTEN:], depth)).persist(StorageLevel.MEMORY_AND_DISK)
            roots.append(node(0.0))
            todo = [roots[-1]]
            for _ in range(depth):
                sums = _histograms(blocks, flat(), roots[tree // WRITTEN * WRITTEN :], todo, depth, n_features)
                if before:
                    before.unpersist()
                    before = None
                following = []
                for at, (g, h, count) in zip(todo, sums, strict=True):
                    gs, hs, ns = g[0].sum(), h[0].sum(), count[0].sum()
                    gl, hl, nl = (np.cumsum(v, axis=1)[:, :-1] for v in (g, h, count))
                    gained = gl**2 / (hl + LEAF_L2) + (gs - gl) ** 2 / (hs - hl + LEAF_L2) - gs**2 / (hs + LEAF_L2)
                    gained[(nl < MIN_LEAF) | (ns - nl < MIN_LEAF)] = -1
                    for j, e in enumerate(edges):
                        gained[j, len(e) :] = -1
                    j, cut = np.unravel_index(int(gained.argmax()), gained.shape)
                    if gained[j, cut] <= 1e-6:
                        continue
                    nodes["feature"][at], nodes["cut"][at], nodes["threshold"][at] = int(j), int(cut), float(edges[j][cut])
                    left = (gl[j, cut], hl[j, cut])
                    for side, (a, b) in (("left", left), ("right", (gs - left[0], hs - left[1]))):
                        nodes[side][at] = node(float(RATE * a / (b + LEAF_L2)))
                        following.append(nodes[side][at])
                todo = following
                if not todo:
                    break
        blocks.unpersist()
        binned.drop()
    arrays = flat()
    arrays.pop("cut")
    return Trees(base=base, root=np.array(roots, np.int64), depth=depth, **arrays)


def _adder(nodes: dict[str, np.ndarray], roots: list[int], depth: int):
    def added(block):
        y, bins, total = block
        total, at = _walk(nodes, roots, depth, bins, total)
        return y, bins, total + nodes["value"][at]

    return added


def _histograms(blocks: RDD, nodes: dict[str, np.ndarray], roots: list[int], todo: list[int], depth: int, features: int) -> np.ndarray:
    """Sums of gradients, second derivatives and rows by node of ``todo``, statistic and bin."""
    place = np.full(len(nodes["value"]), -1)
    place[todo] = np.arange(len(todo))
    shape = (len(todo), features, BINS)

    def summed(block):
        y, bins, total = block
        out = np.zeros((3, len(todo) * features * BINS), np.int64)
        total, at = _walk(nodes, roots, depth, bins, total)
        here = place[at] >= 0
        p = 1 / (1 + np.exp(-(total + np.zeros(len(y)))[here]))
        g, h = (np.rint(v * PARTS) for v in (y[here] - p, p * (1 - p)))
        cells = ((place[at[here]] * features)[:, None] + np.arange(features)) * BINS + bins[here]
        for k, v in enumerate((g, h, None)):  # a block's sums are whole numbers below 2**53
            out[k] = np.bincount(cells.ravel(), None if v is None else np.repeat(v, features), out.shape[1])
        return out

    out = blocks.map(summed).treeReduce(np.add).astype(float)
    out[:2] /= PARTS
    return out.reshape(3, *shape).transpose(1, 0, 2, 3)


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, id: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Trees from all labelled documents for which ``allowed`` (a column of the label table) holds."""
    rows = Saved(one_label(labels.filter(F.col(label).isNotNull() & allowed), id, label), "quality-labels")
    field = T.StructField("x", T.ArrayType(T.DoubleType()))

    def compute(column: pa.Array) -> list[pa.Array]:
        x = features(column)
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))]

    chosen = docs.select(id, text).join(sized(rows.df, rows.count()), id)
    seen = Saved(with_text_columns(chosen, [label], compute, [field], text).select(F.col(label).cast("double").alias("y"), "x"), "quality-features")
    trees = grow_table(seen.df, len(FEATURES))
    rows.drop()
    seen.drop()
    return trees


def score(docs: DataFrame, trees: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with score (0 to 1) and predicted (1 from 0.5)."""

    def compute(column: pa.Array) -> list[pa.Array]:
        got = trees.score(features(column))
        return [pa.array(got), pa.array((got >= 0.5).astype(np.int32))]

    return with_text_columns(docs, keep, compute, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text)
