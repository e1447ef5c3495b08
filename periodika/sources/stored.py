"""Tables in the shared folder: intermediate ones, a hash store that grows batch by batch, and tables written as one unit."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one where none is set and all runs on this machine, as in tests."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and (not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at and not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="periodika-"))
    return (at or _LOCAL[0]).rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, without its lineage, and there when executors are lost."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Written tables of at most so many rows and bytes of text are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def sized(written: DataFrame, *texts: str) -> DataFrame:
    """A written table with the join strategy that its rows, which are counted, and the bytes of its columns ``texts`` allow: broadcast, else sort-merge."""
    size = F.lit(0)
    for c in texts:
        size = size + F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    rows, size = written.agg(F.count("*"), size).first()
    return F.broadcast(written) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else written.hint("merge")


class Files:
    """The few file system calls that Spark's own API lacks, through Hadoop, so that any store will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.system = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def qualified(self) -> tuple[str, str]:
        """The root with its scheme: as a URI, and as Spark's readers show it in paths."""
        at = self.system.makeQualified(self._path(""))
        return at.toUri().toString(), at.toString()

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder; nothing if it isn't there."""
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def exists(self, name: str) -> bool:
        return self.system.exists(self._path(name))

    def held(self, name: str) -> tuple[int, int]:
        """Files and bytes below a folder; none if it isn't there."""
        if not self.exists(name):
            return 0, 0
        summary = self.system.getContentSummary(self._path(name))
        return summary.getFileCount(), summary.getLength()

    def delete(self, name: str) -> None:
        self.system.delete(self._path(name), True)

    def mark(self, name: str) -> None:
        """An empty file, created in one step."""
        self.system.create(self._path(name), True).close()


class HashStore:
    """All content hashes that any batch has stored, keyed by their first digit, in runs of batches.

    Batch n adds run ``n-n``; before it looks, ``MERGED`` earlier runs of one length that lie side by side become one, so a hash is rewritten once
    for each power of ``MERGED`` batches, and a batch looks into a few runs, however many batches there were. A run counts when its mark is
    there, which is made after its files. A batch that is run again replaces its own run, which no merge has touched yet. Only the folders of first digits that occur in a batch
    are read.
    """

    MERGED = 8

    def __init__(self, spark: SparkSession, root: str, key: str = "file_hash", digits: int = 1):
        self.spark, self.root, self.key, self.digits = spark, root.rstrip("/"), key, digits
        self.files = Files(spark, root)
        self.schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("batch", T.LongType()), T.StructField("prefix", T.StringType())])

    def runs(self, before: int | None = None) -> list[tuple[int, int]]:
        """First and last batch of the runs that count, the longest ones; ``before``: of batches below it only."""
        marks = [re.fullmatch(r"(\d+)-(\d+)\.done", x) for x in self.files.names()]
        spans = sorted(((int(m[1]), int(m[2])) for m in marks if m), key=lambda s: (s[0], -s[1]))
        out: list[tuple[int, int]] = []
        for first, last in spans:
            if (before is None or last < before) and (not out or first > out[-1][1]):
                out.append((first, last))
        return out

    def table(self, before: int | None = None, prefixes: list[str] | None = None) -> DataFrame:
        """The hashes with the batch that stored them."""
        runs = self.runs(before)
        if not runs:
            return self.spark.createDataFrame([], self.schema).select(self.key, "batch")
        out = self._read(runs)
        return (out if prefixes is None else out.filter(F.col("prefix").isin(prefixes))).select(self.key, "batch")

    def _prefix(self):
        return F.substring(self.key, 1, self.digits)

    def unseen(self, batch: DataFrame, number: int) -> DataFrame:
        """A row for each hash of the batch that no earlier batch has stored. Write or ``add`` it before the next batch."""
        self._merge(number)
        first = batch.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        if not self.runs(number):
            return first
        prefixes = [r[0] for r in first.select(self._prefix().alias("p")).distinct().collect()]  # 16 for one hexadecimal digit
        return first.join(self.table(number, prefixes).select(self.key).hint("merge"), self.key, "left_anti").select(batch.columns)

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.root).parquet(*[f"{self.root}/run={a}-{b}" for a, b in runs])

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        name = f"{first}-{last}"
        self.files.delete(f"{name}.done")
        # by ranges, so that a folder of very many hashes has many files, and these have bounds of their own
        rows.withColumn("prefix", self._prefix()).repartitionByRange("prefix", self.key).sortWithinPartitions("prefix", self.key).write.mode("overwrite").partitionBy("prefix").parquet(f"{self.root}/run={name}")
        self.files.mark(f"{name}.done")

    def add(self, hashes: DataFrame, number: int) -> None:
        """Stores what batch ``number`` has brought."""
        self._write(hashes.select(self.key, F.lit(number).cast("long").alias("batch")), number, number)

    def _merge(self, before: int) -> None:
        runs = self.runs(before)
        for i in range(len(runs) - self.MERGED + 1):
            part = runs[i : i + self.MERGED]
            size = part[0][1] - part[0][0] + 1
            if part[0][0] % (size * self.MERGED) == 0 and all(b - a + 1 == size for a, b in part):
                self._write(self._read(part).drop("prefix"), part[0][0], part[-1][1])
                for a, b in part:
                    self.files.delete(f"{a}-{b}.done")
                    self.files.delete(f"run={a}-{b}")
                return self._merge(before)


class Unit:
    """Tables that are written batch by batch, all of a batch or nothing.

    Each table of batch n lies in ``<table>/batch=n``; the batch counts when ``commits/n`` is there, which is made last. A batch that was broken off is
    written anew as a whole when it comes again, one that has its commit is left alone.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, root)

    def committed(self) -> list[int]:
        return sorted(int(x) for x in self.files.names("commits") if x.isdigit())

    def write(self, number: int, body: Callable[[], None]) -> bool:
        """Has ``body`` put the tables of batch ``number`` and commits them; whether there was anything to do."""
        if self.files.exists(f"commits/{number}"):
            return False
        body()
        self.files.mark(f"commits/{number}")
        return True

    def put(self, df: DataFrame, name: str, number: int, **options) -> DataFrame:
        """One table of a batch that isn't committed yet, read again. ``options``: of Spark's writer."""
        path = f"{self.root}/{name}/batch={number}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, name: str, schema: str, before: int) -> DataFrame:
        """What the last committed batch below ``before`` has of a table, without looking at any other; an empty table if there is none."""
        earlier = [n for n in self.committed() if n < before]
        if not earlier:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/batch={earlier[-1]}")

    def table(self, name: str, schema: T.StructType | str, before: int | None = None) -> DataFrame:
        """All committed rows of a table with their ``batch``; ``before``: of batches below it only."""
        schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        whole = T.StructType([*schema, T.StructField("batch", T.LongType())])
        there = [n for n in self.committed() if before is None or n < before]
        if not there:
            return self.spark.createDataFrame([], whole)
        # one folder with a partition for each batch: what isn't committed is pruned by its number
        found = self.spark.read.schema(whole).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        spans: list[list[int]] = []
        for n in there:
            if spans and spans[-1][1] == n - 1:
                spans[-1][1] = n
            else:
                spans.append([n, n])
        held = F.lit(False)
        for a, b in spans:  # batches follow one another, so that this is one span, or two after a break
            held = held | F.col("batch").between(a, b)
        return found.filter(held)
