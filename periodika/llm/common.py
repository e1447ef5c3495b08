"""Shared helpers of the training-data operators: tables in the shared folder, joins of checked size, Arrow passes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it was written out first and has at most so many (narrow) rows.
BROADCAST_ROWS = 500_000

#: Bytes of an Arrow batch between the JVM and Python; Spark's own bound is 64 MB, and each task holds several at a time.
BATCH_BYTES = 4 << 20

_LOCAL: list[str] = []


def bounded_batches(spark: SparkSession) -> None:
    """Has this session send Arrow batches of ``BATCH_BYTES`` or so to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset and all runs on this machine, a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="periodika-"))
        at = _LOCAL[0]
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path there, with the scheme of its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


class Saved:
    """A table written to the shared folder: it cuts the lineage and outlives executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, fresh_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def count(self) -> int:
        return self.df.count()

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the join strategy its counted ``rows`` allow: broadcast, else sort-merge (which AQE splits on skew)."""
    return F.broadcast(df) if rows <= most else df.hint("merge")


def set_apart(df: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all columns but ``needed`` under names that no operator gives, and a function that puts names and order back."""
    apart = {c: c if c in needed else f"__kept_{i}" for i, c in enumerate(df.columns)}
    inner = df.select(*(F.col(f"`{c}`").alias(name) for c, name in apart.items()))
    return inner, lambda out: out.select(*(F.col(name).alias(c) for c, name in apart.items()))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(df: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """About ``most`` rows (of each value of ``by``), chosen by a hash of ``key``; all rows where there are fewer."""
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1_000_000)) / 1_000_000.0
    if by is None:
        return df.filter(unit < min(1.0, most / max(1, df.count())))
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        if value is not None:
            share = F.when(F.col(by) == F.lit(value), min(1.0, most / n)).otherwise(share)
    return df.filter(unit < share)


def one_label(labels: DataFrame, id: str, *names: str) -> DataFrame:
    """A row for each non-null id with its 0/1 labels ``names``: of rows that disagree the majority holds, 0 on a tie; null if all are."""
    counted = lambda c: F.when(F.count(c) > 0, F.when(2 * F.sum(F.col(c)) > F.count(c), 1).otherwise(0)).alias(c)
    return labels.filter(F.col(id).isNotNull()).groupBy(id).agg(*(counted(c) for c in names))


def slices(batch: pa.RecordBatch, at: int, most: int):
    """Pieces of a batch with at most ``most`` bytes of text in column ``at`` (a longer text is a piece of its own)."""
    n, begin = batch.num_rows, 0
    if not n:
        return
    col = batch.column(at)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).cumsum()
    done = 0
    while begin < n:
        end = max(begin + 1, int(sizes.searchsorted(done + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin, done = end, int(sizes[end - 1])


def with_text_columns(
    df: DataFrame, keep: list[str], compute: Callable[[pa.Array], list[pa.Array]], fields: list[T.StructField], text: str = "text", most: int = 1 << 20
) -> DataFrame:
    """Columns ``keep`` of ``df`` and new ``fields`` that ``compute`` derives from each piece of whole texts.

    ``compute`` gets a string array (nulls allowed) and returns one array for each field. A kept column whose name a new
    field has gives way to it.
    """
    bounded_batches(df.sparkSession)
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    source = [F.col(f"`{c}`") for c in keep]
    at = keep.index(text) if text in keep else len(keep)
    if at == len(keep):
        source.append(F.col(text).alias("__text"))
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    names, n = schema.names, len(keep)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, at, most):
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], *compute(piece.column(at))], names=names)

    return df.select(*source).mapInArrow(run, schema)
