"""S11, R1. The search documents and their index as stored tables that are refreshed in place.

Documents lie in ``buckets`` folders by magazine; a refresh rewrites the folders of the magazines that changed and no other. The index grows by
generations: a refresh adds one with the changed magazines' rows and their tombstones, which take these magazines' rows of all earlier
generations out of every query. Generations are written where their pages' words are counted, in runs sorted by term, without a shuffle; a query's terms skip the
rest of each run by its bounds. ``compact`` writes what is alive as a new base, in ranges of terms. A generation counts when its commit is there, so a query sees
all of a refresh's index or nothing; a refresh that broke off between documents and index is simply done again.

Defined results: a changed magazine without fresh pages disappears; one that wasn't there is added; an empty set of changes makes a generation
that changes nothing. Fresh documents of magazines that aren't among the changed ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stored import Files, Unit, sized, stored
from . import search

_TEXT, _WHOLE, _SMALL = T.StringType(), T.LongType(), T.IntegerType()
_COLUMNS = {"term": _TEXT, "attr": _SMALL, "page_id": _TEXT, "magazine_id": _WHOLE, "tf": _WHOLE, "positions": T.ArrayType(_SMALL)}
INDEX = T.StructType([T.StructField(c, kind) for c, kind in _COLUMNS.items()])
TOMBSTONES = T.StructType([T.StructField("magazine_id", _WHOLE)])
VARIANTS = T.StructType([T.StructField("variant", _TEXT), T.StructField("term", _TEXT)])
#: Changed magazines since the last base up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Generations since the base that ``refresh`` lets pile up before it compacts.
MOST_GENERATIONS = 16
#: Files of a bucket, and their mean bytes, beyond and below which a refresh deals its rows out anew, so that small files don't pile up.
BUCKET_FILES, SMALL_FILE = 8, 8 << 20
#: Of documents and index. A row group of the index is about a sorted run.
_DOCUMENTS, _RUNS = {"compression": "zstd"}, {"compression": "zstd", "parquet.block.size": 16 << 20}


class SearchStore:
    """``buckets``: folders of the documents; as a refresh rewrites whole ones, take so many that one has a few hundred MB.

    ``partitions``: ranges of terms that ``compact`` writes.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, partitions: int = 64):
        self.spark, self.root, self.buckets, self.partitions = spark, root.rstrip("/"), buckets, partitions
        self.files, self.unit = Files(spark, self.root), Unit(spark, self.root)

    def _bucketed(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("bucket", F.pmod(F.xxhash64(F.col("magazine_id").cast("long")), F.lit(self.buckets)).cast("int"))

    def _dealt(self, docs: DataFrame) -> DataFrame:
        return self._bucketed(docs).repartitionByRange("bucket", "magazine_id", "page_id")  # a large bucket is many tasks

    def _write_documents(self, bucketed: DataFrame) -> None:
        rows = bucketed.sortWithinPartitions("bucket")
        rows.write.mode("overwrite").options(**_DOCUMENTS).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/documents")

    def _write_generation(self, index: DataFrame, changed: DataFrame, base: bool) -> int:
        number = (self.unit.committed() or [-1])[-1] + 1

        def body() -> None:
            self.unit.put(index.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in INDEX)), "index", number, **_RUNS)
            self.unit.put(changed.select(F.col("magazine_id").cast("long").alias("magazine_id")).distinct(), "tombstones", number)
            if base:
                self.files.mark(f"bases/{number}")

        self.unit.write(number, body)
        return number

    def _since(self) -> int:
        committed = set(self.unit.committed())
        return max((int(n) for n in self.files.names("bases") if n.isdigit() and int(n) in committed), default=0)

    def build(self, docs: DataFrame) -> None:
        """Stores all documents and a base of their index, whatever was there before."""
        self.files.delete("documents")
        self._write_documents(self._dealt(docs))
        written = self.documents() if any(n.startswith("bucket=") for n in self.files.names("documents")) else docs
        self._write_generation(search.index_runs(written), docs.select("magazine_id").limit(0), True)

    def refresh(self, fresh: DataFrame, changed: DataFrame) -> None:
        """Replaces all that is stored of the magazines in ``changed`` (magazine_id) by their documents in ``fresh``."""
        changed = stored(changed.select("magazine_id").distinct(), "changed")
        ids = sized(changed)
        new = stored(fresh.join(ids, "magazine_id", "left_semi").select(fresh.columns), "fresh")
        touched = [r[0] for r in self._bucketed(changed).select("bucket").distinct().collect()]  # ``buckets`` at most
        old = self.stored_documents().filter(F.col("bucket").isin(touched))
        # folders are replaced when all of their rows are written, so they can be read meanwhile; an emptied folder has no row to be written by
        kept = old.join(ids, "magazine_id", "left_anti").select(fresh.columns)
        full = {r[0] for r in self._bucketed(kept.select("magazine_id").union(new.select("magazine_id"))).select("bucket").distinct().collect()}
        held = [self.files.held(f"documents/bucket={b}") for b in touched]
        files, size = sum(n for n, _ in held), sum(b for _, b in held)
        if files > BUCKET_FILES * len(touched) and size < SMALL_FILE * files:
            self._write_documents(self._dealt(kept.unionByName(new)))
        else:  # rows that stay aren't shuffled: a file holds one bucket's
            self._write_documents(self._bucketed(kept).unionByName(self._dealt(new)))
        for bucket in touched:
            if bucket not in full:
                self.files.delete(f"documents/bucket={bucket}")
        self._write_generation(search.index_runs(new), changed, False)
        if len([n for n in self.unit.committed() if n > self._since()]) >= MOST_GENERATIONS:
            self.compact()

    def compact(self) -> None:
        """Writes the living rows as a new base, in ranges of terms; older generations are left to whoever still reads them, ``clean`` deletes them."""
        ranged = self.index().repartitionByRange(self.partitions, "term", "page_id").sortWithinPartitions("term", "page_id")
        self._write_generation(ranged, self.spark.createDataFrame([], TOMBSTONES), True)

    def clean(self) -> None:
        """Deletes the generations before the base. Not while queries run that were planned on them."""
        for n in [n for n in self.unit.committed() if n < self._since()]:
            for name in (f"commits/{n}", f"bases/{n}", f"index/batch={n}", f"tombstones/batch={n}", f"variants/batch={n}", f"spelt/{n}"):
                self.files.delete(name)

    def stored_documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/documents")

    def documents(self) -> DataFrame:
        return self.stored_documents().drop("bucket")

    def _generations(self, name: str, schema: T.StructType) -> DataFrame:
        return self.unit.table(name, schema).filter(F.col("batch") >= self._since())

    def index(self) -> DataFrame:
        """The living rows of all generations since the base. Filters on terms reach the files, whose rows are sorted by term within runs."""
        dead = self._generations("tombstones", TOMBSTONES).groupBy("magazine_id").agg(F.max("batch").alias("last"))
        dead = stored(dead, "tombstones")
        dead = F.broadcast(dead) if dead.count() <= BROADCAST_ROWS else dead.hint("merge")
        rows = self._generations("index", INDEX)
        return rows.join(dead, (rows["magazine_id"] == dead["magazine_id"]) & (rows["batch"] < dead["last"]), "left_anti").drop("batch")

    def variants(self) -> DataFrame:
        """(variant, term) of all generations since the base; a term that has died finds nothing in the index.

        Variants are many times the terms, so a generation's are written when they are first asked for, and only those of terms that no generation before
        it has; ``spelt/n`` is there when they are whole.
        """
        terms = self._generations("index", INDEX).select("term", "batch")
        for n in [n for n in self.unit.committed() if n >= self._since()]:
            if not self.files.exists(f"spelt/{n}"):
                new = terms.filter(F.col("batch") == n).select("term").distinct()
                new = new.join(terms.filter(F.col("batch") < n).select("term").distinct().hint("merge"), "term", "left_anti")
                self.unit.put(search.term_variants(new).repartitionByRange("variant", "term").sortWithinPartitions("variant"), "variants", n)
                self.files.mark(f"spelt/{n}")
        return self._generations("variants", VARIANTS).select("variant", "term").distinct()
