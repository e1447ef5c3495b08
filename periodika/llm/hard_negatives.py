"""Hard-negative mining over vectors: anchors of a cluster share candidate lists that are sorted once by an angular upper bound.

A row's whole vector has the components floor(256 x), and its score for an anchor is the inner product of both. For a cluster of
anchors with centre m whose members are at most r away from it as an angle, a candidate c can score with a member a no more than
|a| |c| cos(max(0, angle(c, m) - r)). A list is a block of rows in the falling order of that bound, sorted once for the cluster; every
member walks it until the bound of what is left is below its own threshold, the least score that could still enter its results. Nothing
after that point can, so the results are exact.

1. Anchors are dealt to ``CLUSTERS`` clusters (centres from a bounded sample) and go out in broadcasts of ``CHUNK`` anchors at most.
2. Rows are dealt at random to rounds, each ``GROWTH`` times as large as all before it. After a round the best of all tasks are
   merged, and the next round starts from the thresholds reached, so that what tasks emit stays about ``GROWTH`` times the results.
3. One search finds each anchor's positives, a second one the negatives in the window that each positive's score opens. Anchors with
   positives of equal score share that search.

Rows aren't shuffled; a task holds one block and the chunk's best rows. A vector that many rows have is walked like any other.

Defined results: rows with a null id, label, vector or component, or one that isn't finite, take no part. Nor do those with a component
of ``GREATEST`` or more in size, or more than ``DIMENSIONS`` of them, whose scores would leave exact arithmetic. Of rows with one id the least by
label and vector takes part. Vectors of different lengths aren't compared. A positive with a score below 0 has no
negatives, one with 0 those with 0. No rows, no anchors, or one label only give an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Saved, bounded_batches, bounded_sample, fresh_path, sized

CLUSTERS, CHUNK = 64, 16_384
#: Anchors that the clusters' centres are learned from.
SAMPLE = 4096
#: Rows of a list, of the first round and of a task at most; how much a round grows.
BLOCK_ROWS, FIRST, TASK_ROWS, GROWTH = 16_384, 8192, 131_072, 8
GREATEST, DIMENSIONS = 32_768, 8192
_LEAST, _MOST = -(1 << 62), 1 << 62
_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor_id", "key", "vec_id", "score")])


def whole_rows(vectors: DataFrame, id: str, vector: str, label: Column) -> DataFrame:
    """vec_id, label and whole vector v of the rows that take part, repeated ids included."""
    v = F.col(vector)
    fits = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float(GREATEST))) & (F.size(v) <= DIMENSIONS)
    rows = vectors.filter(F.col(id).isNotNull() & label.isNotNull() & fits)
    return rows.select(F.col(id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("int")).alias("v"))


def _one_each(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows, one for each id, and their number."""
    per = rows.groupBy("vec_id").agg(F.count("*").alias("c"))
    n, most = per.agg(F.count("*"), F.coalesce(F.max("c"), F.lit(0))).first()
    if most > 1:
        again = Saved(per.filter("c > 1").select("vec_id"), "repeated")
        side = sized(again.df, again.count())
        once = rows.join(side, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")
        rows = rows.join(side, "vec_id", "left_anti").select("vec_id", "label", "v").unionByName(once)
    return rows, n


class _Rounds:
    """The rows in a table with a folder for each round."""

    def __init__(self, rows: DataFrame, n: int):
        ends = [FIRST]
        while ends[-1] < n:
            ends.append(ends[-1] * (GROWTH + 1))
        place, number = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30), F.lit(len(ends) - 1)
        for i in range(len(ends) - 2, -1, -1):
            number = F.when(place < ends[i] / n, i).otherwise(number)
        self.spark, self.path, self.schema = rows.sparkSession, fresh_path(rows.sparkSession, "vectors"), rows.schema
        self.sizes = [min(b, n) - a for a, b in zip([0, *ends], ends, strict=False)]
        rows.withColumn("round", number).write.partitionBy("round").parquet(self.path)
        self.df = self.spark.read.schema(T.StructType([*rows.schema, T.StructField("round", T.IntegerType())])).parquet(self.path)

    def of(self, i: int) -> DataFrame:
        slots = 2 * self.spark.sparkContext.defaultParallelism
        tasks = max(-(-self.sizes[i] // TASK_ROWS), min(slots, -(-self.sizes[i] // (FIRST // 2))), 1)
        return self.df.filter(F.col("round") == i).select("vec_id", "label", "v").coalesce(tasks)


def _matrices(ids: pa.Array, labels: pa.Array, vectors: pa.Array):
    """Of the rows with vectors of each length: length, ids, labels and a matrix."""
    ids, labels = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in (ids, labels))
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), ids[at], labels[at], flat[offsets[at][:, None] + np.arange(d)]


def _lengths(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", m, m))


def _directions(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(_lengths(m), 1e-12)[:, None]


def _angles(m: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles to a centre; 0 for a vector of length 0, whose scores are 0 and which no bound may shrink."""
    cosine = _directions(m) @ centre
    return np.where(_lengths(m) > 0, np.arccos(np.clip(cosine, -1, 1)), 0.0)


def centres(sample: list[np.ndarray], k: int = CLUSTERS, rounds: int = 8) -> np.ndarray:
    """Centres of direction of at most ``k`` clusters of vectors of one length: spherical k-means from spread starts."""
    m = _directions(np.asarray(sample, np.float64))
    k = max(1, min(k, len(m) // 8))
    at = m[np.linspace(0, len(m) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.argmax(m @ at.T, axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, m)
        full = _lengths(sums) > 1e-9
        at = np.where(full[:, None], _directions(sums), at)
    return at


def _clustered(anchors: DataFrame) -> Saved:
    """The anchors with the number of their cluster; a length of vectors that the sample lacks is one of its own, below 0."""
    sample: dict[int, list] = {}
    for r in bounded_sample(anchors, "vec_id", SAMPLE).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(np.array(r["v"], np.float64))
    known = {d: (i * CLUSTERS, centres(m)) for i, (d, m) in enumerate(sorted(sample.items()))}

    def run(batches):
        for b in batches:
            for d, ids, labels, m in _matrices(*b.columns):
                first, at = known.get(d, (-1 - d, None))
                own = np.full(len(ids), first) if at is None else first + np.argmax(_directions(m) @ at.T, axis=1)
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * d, pa.int32()), pa.array(m.reshape(-1), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), v, pa.array(own, pa.int64())], names=["vec_id", "label", "v", "cluster"])

    schema = T.StructType([*anchors.schema, T.StructField("cluster", T.LongType())])
    return Saved(anchors.mapInArrow(run, schema), "anchors")


def _chunks(anchors: Saved):
    """Conditions on (cluster, salt) that each hold for ``CHUNK`` anchors or so at most; a larger cluster is split by salts."""
    held, n = F.lit(False), 0
    for cluster, c in sorted((r[0], r[1]) for r in anchors.df.groupBy("cluster").count().collect()):
        if c > CHUNK:
            parts = -(-c // CHUNK)
            for i in range(parts):
                yield (F.col("cluster") == cluster) & (F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(parts)) == i)
            continue
        if n and n + c > CHUNK:
            yield held
            held, n = F.lit(False), 0
        held, n = held | (F.col("cluster") == cluster), n + c
    if n:
        yield held


class Search:
    """What a chunk of anchors looks for. A slot is an anchor with a window of scores (``floor`` to ``cap``) and a key; it wants its ``k`` best rows,
    of its own label or of others."""

    def __init__(self, anchors: list, slots: list[tuple[int, int, int, int]], k: int, same: bool):
        """anchors: rows (vec_id, label, v, cluster); slots: (place of the anchor in that list, key, floor, cap)."""
        self.ids, self.labels = (np.array([r[c] for r in anchors], np.int64) for c in ("vec_id", "label"))
        self.owner, self.keys, self.floor, self.cap = (np.array(x, np.int64) for x in zip(*slots, strict=True))
        self.k, self.same, self.block_rows = k, same, BLOCK_ROWS
        self.place, self.groups = np.zeros(len(anchors), np.int64), []
        of: dict[tuple, list[int]] = {}
        for i, r in enumerate(anchors):
            of.setdefault((len(r["v"]), r["cluster"]), []).append(i)
        slot_group = np.zeros(len(anchors), np.int64)
        for g, ((d, _), members) in enumerate(sorted(of.items())):
            m = np.array([anchors[i]["v"] for i in members], np.int32).reshape(len(members), d)
            centre = _directions(_directions(m).sum(axis=0)[None])[0]
            self.place[members], slot_group[members] = np.arange(len(members)), g
            self.groups.append({"d": d, "m": m, "size": _lengths(m), "centre": centre, "radius": float(_angles(m, centre).max()) + 1e-6})
        for g, group in enumerate(self.groups):
            group["slots"] = np.flatnonzero(slot_group[self.owner] == g)

    def reached(self, kth: list) -> None:
        """Takes over the scores of the k-th best rows so far: nothing below can enter."""
        at = {(int(self.ids[o]), int(k)): i for i, (o, k) in enumerate(zip(self.owner, self.keys, strict=True))}
        for anchor_id, key, score in kth:
            i = at[anchor_id, key]
            self.floor[i] = max(self.floor[i], score)

    def walk(self, d: int, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, best: tuple, floor: np.ndarray) -> tuple:
        """The best rows with those of one block; ``floor``, the slots' thresholds, rises on the way."""
        size = _lengths(m)
        for group in self.groups:
            if group["d"] != d or not len(group["slots"]):
                continue
            bound = size * np.cos(np.maximum(0.0, _angles(m, group["centre"]) - group["radius"]))
            bound += np.abs(bound) * 1e-9 + 1e-6
            order = np.argsort(-bound, kind="stable")
            open_, at, step = group["slots"], 0, 256
            kind = _exact(float(group["size"].max(initial=0)) * float(size.max(initial=0)))
            mine, theirs = group["m"].astype(kind), m.astype(kind)
            while at < len(order):
                open_ = open_[group["size"][self.place[self.owner[open_]]] * bound[order[at]] >= floor[open_]]
                if not len(open_):
                    break
                part = order[at : at + step]
                for begin in range(0, len(open_), max(1, (1 << 20) // len(part))):
                    slots = open_[begin : begin + max(1, (1 << 20) // len(part))]
                    members, own = np.unique(self.owner[slots], return_inverse=True)
                    score = (mine[self.place[members]] @ theirs[part].T)[own].astype(np.int64)
                    alike = labels[part][None] == self.labels[self.owner[slots]][:, None]
                    fits = (score >= floor[slots][:, None]) & (score <= self.cap[slots][:, None])
                    fits &= alike & (ids[part][None] != self.ids[self.owner[slots]][:, None]) if self.same else ~alike
                    if len(part) > self.k and fits.sum() > 2 * self.k * len(slots):
                        kth = np.partition(np.where(fits, score, _LEAST), -self.k, axis=1)[:, -self.k]
                        fits &= score >= kth[:, None]
                    row, column = np.nonzero(fits)
                    if len(row):
                        best = self._merged(best, (slots[row], score[row, column], ids[part][column]), slots, floor)
                at, step = at + step, min(2048, 2 * step)
        return best

    def _merged(self, best: tuple, new: tuple, slots: np.ndarray, floor: np.ndarray) -> tuple:
        """``best`` with new rows of ``slots``; the others' stay as they are."""
        touched = np.zeros(len(floor), bool)
        touched[slots] = True
        old = touched[best[0]]
        slot, score, row = (np.concatenate([a[old], b]) for a, b in zip(best, new, strict=True))
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        last = rank == self.k - 1
        floor[slot[last]] = np.maximum(floor[slot[last]], score[last])
        keep = rank < self.k
        return tuple(np.concatenate([a[~old], b[keep]]) for a, b in zip(best, (slot, score, row), strict=True))

    def run(self, batches):
        """Arrow batches of rows to one batch of the partition's best: the body of a task."""
        floor, best = self.floor.copy(), tuple(np.zeros(0, np.int64) for _ in range(3))
        held, n = [], 0

        def walked(best):
            whole = pa.Table.from_batches(held).combine_chunks()
            for d, ids, labels, m in _matrices(*(whole.column(c).combine_chunks() for c in ("vec_id", "label", "v"))):
                best = self.walk(d, ids, labels, m, best, floor)
            return best

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= self.block_rows:
                best, held, n = walked(best), [], 0
        if n:
            best = walked(best)
        slot, score, row = best
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[self.owner[slot]], self.keys[slot], row, score)], names=_FOUND.names)


def _exact(most: float) -> type:
    """The fastest numbers that hold inner products up to ``most`` exactly, in any order of summing."""
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _searched(rounds: _Rounds, search: Search) -> Saved:
    """anchor_id, key, vec_id, score and rank of the best rows of each slot over all rounds."""
    spark, best = rounds.spark, None
    order = Window.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "vec_id")
    for i in range(len(rounds.sizes)):
        shared = spark.sparkContext.broadcast(search)
        found = rounds.of(i).mapInArrow(lambda batches, shared=shared: shared.value.run(batches), _FOUND)
        both = found if best is None else found.unionByName(best.df.drop("rank"))
        merged = Saved(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= search.k), "best")
        shared.destroy()
        if best is not None:
            best.drop()
        best = merged
        if i + 1 < len(rounds.sizes):
            search.reached([tuple(r) for r in best.df.filter(F.col("rank") == search.k).select("anchor_id", "key", "score").collect()])
    return best


def mine(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", every: int = 100, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are the rows whose id ``every`` divides. Their positives are the ``positives`` best rows of their label; for each of them the
    result has the ``negatives`` best rows of other labels whose score is between the window's hundredths of the positive's. Equal scores come
    in the order of ids.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, n = _one_each(whole_rows(vectors, id, vector, F.col(label) if isinstance(label, str) else label))
    out = fresh_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(out)
    if n:
        rounds = _Rounds(rows, n)
        anchors = _clustered(rounds.df.filter(F.col("vec_id") % every == 0).drop("round"))
        low, high = window
        for chunk in _chunks(anchors):
            own = anchors.df.filter(chunk).collect()
            near = _searched(rounds, Search(own, [(i, 0, _LEAST, _MOST) for i in range(len(own))], positives, True))
            at = {r["vec_id"]: i for i, r in enumerate(own)}
            slots = [(at[r[0]], r[1], -(-low * r[1] // 100), high * r[1] // 100) for r in near.df.filter("score >= 0").select("anchor_id", "score").distinct().collect()]
            if slots:
                far = _searched(rounds, Search(own, slots, negatives, False))
                pairs = near.df.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("key")).hint("merge").join(far.df, ["anchor_id", "key"])
                pairs.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("key").alias("positive_score"), F.col("score").alias("negative_score")).write.mode("append").parquet(out)
                far.drop()
            near.drop()
        anchors.drop()
    return spark.read.schema(schema).parquet(out)
