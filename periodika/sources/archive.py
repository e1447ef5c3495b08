"""Sources and sinks of the archive: file listings, incremental scans, logs, taxonomy files, exports."""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import ranks
from .stored import Files, stored


def scan_files(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """S1. path, modificationTime, length and content of all files below ``root``, empty ones included; content is read only where selected.

    Spark's reader lists in the driver: ``list_files`` is for more files than that holds.
    """
    filled = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # that reader passes over empty files
    empty = list_files(spark, root, glob).filter("length = 0").withColumn("content", F.lit(bytearray()))
    return filled.unionByName(empty)


#: Files that a partition of a listing has, and folders' entries that a task gives on at once.
LISTED = 50_000


def _entries(system: FileSystem, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """Name, whether it is a folder, size and time in milliseconds of what lies in a folder. A local one is read entry by entry, others at once."""
    if system.type_name == "local":
        with os.scandir(folder) as found:
            for x in found:
                with contextlib.suppress(FileNotFoundError):  # gone by now
                    s = x.stat()
                    yield x.name, x.is_dir(), s.st_size, s.st_mtime_ns // 1_000_000
    else:
        for x in system.get_file_info(FileSelector(folder)):
            yield x.base_name, x.type == FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1_000_000


def list_files(spark: SparkSession, root: str, glob: str = "*.pdf") -> DataFrame:
    """S1. path, modificationTime and length of all files below ``root``, empty ones included. None is opened.

    Tasks list the folders, level by level, and write what they find as they go, so that the driver holds no file of it. Names that
    Spark's readers take for hidden are left out.
    """
    at = Files(spark, root)
    if not at.exists(""):
        raise FileNotFoundError(root)
    uri, shown = at.qualified()
    wanted = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern())
    names = ["path", "ms", "length", "folder"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=names)

    def run(batches):
        system, base = FileSystem.from_uri(uri)
        rows = []
        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            with contextlib.suppress(FileNotFoundError):  # a folder that is gone by now
                for name, inside, size, ms in _entries(system, f"{base.rstrip('/')}/{folder}"):
                    hidden = name[0] == "." or name[0] == "_" and "=" not in name or name.endswith("._COPYING_")
                    if not hidden and (inside or wanted.fullmatch(name)):
                        rows.append((f"{folder}/{name}" if folder else name, ms, size, inside))
                    if len(rows) == LISTED:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    tasks, total, out = spark.sparkContext.defaultParallelism, 0, None
    folders = spark.createDataFrame([("",)], "path string")
    while folders is not None:
        found = stored(folders.mapInArrow(run, "path string, ms long, length long, folder boolean"), "listed")
        out = found if out is None else out.unionByName(found)
        below, files = found.agg(F.count_if("folder"), F.count_if(~F.col("folder"))).first()
        total += files
        folders = found.filter("folder").select("path").repartition(min(below, 8 * tasks), "path") if below else None
    rows = out.filter("NOT folder").repartition(max(tasks, -(-total // LISTED)))
    return rows.select(F.concat(F.lit(f"{shown.rstrip('/')}/"), "path").alias("path"), F.timestamp_millis("ms").alias("modificationTime"), "length")


def file_hash(df: DataFrame, content: str = "content") -> DataFrame:
    """S2."""
    return df.withColumn("file_hash", F.sha2(F.col(content).cast("binary"), 256))


def _input(root: str) -> Callable[[str], BinaryIO]:
    """Opens files by their paths below ``root``, through Arrow's file systems."""
    system, base = FileSystem.from_uri(root)
    return lambda path: system.open_input_stream(f"{base.rstrip('/')}/{path}")


def hash_files(files: DataFrame, root: str, task_bytes: int = 64 << 20, opened: Callable[[str], Callable[[str], BinaryIO]] = _input) -> DataFrame:
    """S2. path and file_hash (SHA-256) of ``files`` (path below ``root``, size): these are opened, once each, and read in pieces of 1 MB.

    Tasks get about ``task_bytes`` each. A file that is gone by then isn't in the result. ``root`` is a URI that Arrow knows (file, hdfs, s3, gs).
    """
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, min(n, max(-(-size // task_bytes), files.sparkSession.sparkContext.defaultParallelism)))

    def run(batches):
        at = opened(root)
        for batch in batches:
            paths, hashes = [], []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                try:
                    with at(path) as f:
                        while piece := f.read(1 << 20):
                            digest.update(piece)
                except FileNotFoundError:
                    continue
                paths.append(path)
                hashes.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(hashes, pa.string())], names=["path", "file_hash"])

    # the number is given, so that adaptive execution doesn't put the few bytes of all these paths into one task
    return files.select("path").repartition(tasks, "path").mapInArrow(run, "path string, file_hash string")


def write_files(rows: DataFrame, root: str) -> None:
    """A file below ``root`` for each row (path, content): for archives that are made from tables. A row that is run again writes the same file."""

    def run(batches):
        system, base = FileSystem.from_uri(root)
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = f"{base.rstrip('/')}/{path}"
                system.create_dir(at.rpartition("/")[0], recursive=True)
                with system.open_output_stream(at) as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def classify_scan(files: DataFrame, known: DataFrame, tolerance: int = 1, hashes: Callable[[DataFrame], DataFrame] | None = None, entry: str = "path") -> DataFrame:
    """S3. What a scan found: unchanged, relocated, duplicate, modified or new for each file, missing for each known path that is gone.

    A file of the same path, size and time (less than ``tolerance`` seconds apart) is unchanged, and nobody opens it: files are classified by
    their listing first, and ``hashes`` gets only those that are left (path, size) and gives path and file_hash, as ``hash_files`` does. Where
    hashes are at hand, ``files`` has them as ``file_hash``. A listing with several files at one path (of several discs) has a column ``entry``
    that tells them apart; ``hashes`` then gets and gives that as well, and of equal paths the least entry is first. Of new files with one hash the first path is new, the others duplicates. A known
    path with several rows counts with its newest one; of several known files of one hash the one at the file's own path counts, else the
    one with the smallest id. A document that was found elsewhere is relocated and not missing.
    """
    by_path = known.groupBy("path").agg(F.max_by(F.struct("size", "id"), F.struct("mtime", "id")).alias("k"), F.max("mtime").alias("k_mtime"))
    same = F.coalesce((F.col("size") == F.col("k.size")) & (F.abs(F.col("mtime") - F.col("k_mtime")) < tolerance), F.lit(False))
    own = list(dict.fromkeys(["path", entry]))
    seen = stored(files.join(by_path.hint("merge"), "path", "left").withColumn("same", same), "listing")
    unchanged = seen.filter("same").select("path", F.col("k.id").alias("known_id"), F.lit("unchanged").alias("class"))
    rest = seen.filter("NOT same")
    if hashes is not None:
        # written, as it is looked at twice: each file is opened once
        found_hashes = stored(hashes(rest.select(*own, "size")).select(entry, "file_hash"), "hashes")
        rest = rest.drop("file_hash").join(found_hashes.hint("merge"), entry)
    rest = rest.select(F.struct(*own).alias("at"), "path", "file_hash", "k.id")
    # the known document of a hash: the one at the file's own path, else the least id; the first new path of it
    at_hash = known.groupBy("file_hash").agg(F.min(F.struct("id", "path")).alias("h"))
    here = known.groupBy("file_hash", "path").agg(F.min("id").alias("own_id"))
    first = rest.groupBy("file_hash").agg(F.min("at").alias("first"))
    found = rest.join(at_hash.hint("merge"), "file_hash", "left").join(here.hint("merge"), ["file_hash", "path"], "left").join(first.hint("merge"), "file_hash", "left")
    kind = (
        F.when(F.col("own_id").isNotNull(), "unchanged").when(F.col("h.id").isNotNull(), "relocated").when(F.col("at") > F.col("first"), "duplicate")
        .when(F.col("id").isNotNull(), "modified").otherwise("new")
    )
    looked = stored(found.select("path", F.coalesce("own_id", "h.id", "id").alias("known_id"), kind.alias("class")), "looked")
    gone = known.select("path", F.col("id").alias("known_id")).join(seen.select("path").hint("merge"), "path", "left_anti")
    moved = looked.filter("class = 'relocated'").select("known_id").distinct()
    missing = gone.join(moved.hint("merge"), "known_id", "left_anti").select("path", "known_id", F.lit("missing").alias("class"))
    return unchanged.unionByName(looked).unionByName(missing)


def stable_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """S4. Files with equal size and time in two listings."""
    return second.join(first.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")


def path_dimensions(df: DataFrame, path: str = "file_path") -> DataFrame:
    """S5. collection (first directory, null for none), sub_dirs, filename and stem of a relative path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return df.withColumns(
        {
            "collection": F.when(n > 1, F.element_at(parts, 1)), "sub_dirs": F.when(n > 2, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), "/")).otherwise(""),
            "filename": F.element_at(parts, -1), "stem": F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""),
        }
    )


def get_or_create_dimension(names: DataFrame, dim: DataFrame, any_case: bool = False) -> DataFrame:
    """S6. ``dim`` (id, name) with a row more for each unseen name; new ids follow the greatest, in the order of the names."""
    key = (lambda c: F.lower(c)) if any_case else (lambda c: c)
    unseen = names.filter("name IS NOT NULL").select("name", key(F.col("name")).alias("k")).groupBy("k").agg(F.min("name").alias("name"))
    unseen = unseen.join(dim.select(key(F.col("name")).alias("k")).hint("merge"), "k", "left_anti")
    top = dim.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = ranks(unseen.select("name"), F.col("name"), name="r")
    return dim.select("id", "name").unionByName(new.select((F.lit(top) + F.col("r")).cast(dim.schema["id"].dataType).alias("id"), "name"))


LOG = T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "level", "logger", "message", "component")])


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """S7. Log records of JSON-line files, rotated ones included; lines that aren't JSON are dropped.

    ``component`` is the file's name up to its first full stop, whatever a record says of itself.
    """
    rows = spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).drop("component")
    return rows.withColumn("component", log_component(F.col("_metadata.file_name"))).select(LOG.names)


def log_component(file_name: Column) -> Column:
    """S7. ``worker`` of ``worker.log``, ``worker.log.1`` and so on."""
    return F.regexp_extract(file_name, r"^([^.]+)", 1)


def latest_logs(logs: DataFrame, level: str | None = None, component: str | None = None, limit: int = 200) -> DataFrame:
    """S7. The newest records; a time without zone is UTC, one that can't be read comes last."""
    out = logs.withColumn("at", F.try_to_timestamp(F.regexp_replace("timestamp", "T", " ")))
    if level:
        out = out.filter(F.col("level") == level.upper())
    if component:
        out = out.filter(F.col("component") == component)
    return out.orderBy(F.desc_nulls_last("at"), "message").limit(min(limit, 1000))


def read_taxonomy_json(spark: SparkSession, path: str) -> DataFrame:
    """S8. The text of taxonomy files, for ``taxonomy.parse_taxonomy``."""
    return spark.read.text(path, wholetext=True)


def corpus_json(df: DataFrame) -> DataFrame:
    """S9. A row of JSON for each row."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_corpus_json(df: DataFrame, path: str) -> None:
    """S9. One JSON object on each line below ``path``, in as many files as the table has partitions."""
    corpus_json(df).write.mode("overwrite").text(path)


def write_export_json(df: DataFrame, path: str) -> None:
    """S9. One readable JSON document in one file below ``path``: for exports that a person sends on, of a size that a request holds."""
    rows = df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*sorted(df.columns)))), {"pretty": "true"}).alias("value"))
    rows.write.mode("overwrite").text(path)


def relative_words(words: DataFrame, width: float, height: float) -> DataFrame:
    """S12. Word boxes relative to the page, without NUL characters."""
    part = lambda a, b, whole: ((F.col(b) - F.col(a)) / whole)
    return words.select(
        "magazine_id", "page_number", "n", F.replace(F.col("text"), F.lit("\0"), F.lit("")).alias("text"), (F.col("x0") / width).alias("x"), (F.col("y0") / height).alias("y"),
        part("x0", "x1", width).alias("w"), part("y0", "y1", height).alias("h"),
    )


def explode_words(pages: DataFrame, words: str = "words") -> DataFrame:
    """S12. A row for each word of pages that hold arrays of words."""
    return pages.select("magazine_id", "page_number", F.posexplode(words).alias("n", "word")).select("magazine_id", "page_number", "n", "word.*")


def abs_seconds(a: Column, b: Column) -> Column:
    """Seconds between two timestamps, without sign."""
    return F.abs(F.unix_seconds(a) - F.unix_seconds(b))
