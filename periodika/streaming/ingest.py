"""ST5. Documents to pages, metadata, contents, articles, links and an orphan queue, batch by batch and exactly once.

A micro-batch of documents is written as one unit (``Unit``): its tables first, then its commit. A batch that broke off between two
tables is written again as a whole; one that was committed isn't touched. What a batch adds depends on it and on earlier committed batches
only, so a replay gives the same.

A document is known by its content: one whose hash an earlier batch has stored, or that comes twice in a batch, is skipped (the smallest id
counts). A document that comes again with new content takes the place of its earlier version in ``current``; nothing stored is rewritten.

Defined results: a document without id or hash is left out; one without pages is ``failed`` and says why, and has no other rows; a page
without text has no language and no lines; an empty batch is committed as such. Articles are named by document and position. Further
columns of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..operators import quality, toc
from ..operators.taxonomy import attach_keywords
from ..sources.archive import path_dimensions
from ..sources.stored import HashStore, Unit, sized
from .jobs import run_available

UNREAD = "No page of this document could be read."
SCHEMAS = {
    "documents": "magazine_id long, file_hash string, collection string, issue_type string, issue_number string, publication_date date, issue_month_label string, scan_status string, error_message string",
    "pages": "magazine_id long, page_number int, raw_text string, language string",
    "contents": "magazine_id long, toc_status string, message string",
    "articles": "magazine_id long, article_id string, position int, title string, start_page int, end_page int",
    "links": "magazine_id long, subtheme_id int, article_id string",
    "orphans": "magazine_id long, article_id string, title string",
}

#: What is only written to be read again inside a batch.
STEPS = ("arrived", "text", "lines", "repeated", "classified", "contents-pages", "entries")


class Ingestion:
    """``pages_of``: for a batch's documents (magazine_id), their pages (magazine_id, page_number, raw_text). Reading files is the caller's.

    ``fuzzy``: whether headings that were misread count when pages of contents are looked for.
    """

    def __init__(self, spark: SparkSession, root: str, pages_of: Callable[[DataFrame], DataFrame], subthemes: DataFrame, fuzzy: bool = True):
        self.spark, self.pages_of, self.subthemes, self.fuzzy = spark, pages_of, subthemes, fuzzy
        self.unit, self.hashes = Unit(spark, root), HashStore(spark, f"{root.rstrip('/')}/hashes")

    def batch(self, docs: DataFrame, number: int) -> None:
        """One micro-batch of documents (id, title, file_path, file_hash): the body of ``foreachBatch``."""
        if self.unit.write(number, lambda: self._tables(docs, number)):
            for name in STEPS:
                self.unit.files.delete(f"{name}/batch={number}")

    def _tables(self, docs: DataFrame, number: int) -> None:
        put = lambda name, df: self.unit.put(df.select(*(f.name for f in self._schema(name))), name, number)
        named = docs.filter("id IS NOT NULL AND file_hash IS NOT NULL").select("id", "title", "file_path", "file_hash")
        first = named.groupBy("file_hash").agg(F.min_by(F.struct("id", "title", "file_path"), "id").alias("d")).select("d.*", "file_hash")
        # of several versions of one document in a batch the one of the least hash counts
        first = first.groupBy("id").agg(F.min_by(F.struct("title", "file_path", "file_hash"), "file_hash").alias("d")).select("id", "d.*")
        new = self.unit.put(self.hashes.unseen(first, number), "arrived", number)
        ids = new.select(F.col("id").alias("magazine_id"))

        text = self.pages_of(ids).select("magazine_id", F.col("page_number").cast("int").alias("page_number"), "raw_text")
        text = self.unit.put(text.join(ids.hint("merge"), "magazine_id", "left_semi"), "text", number)
        pages = put("pages", quality.with_language(text))
        documents = put("documents", self._documents(new, pages))

        lines = self.unit.put(quality.page_lines(pages.filter("raw_text IS NOT NULL")), "lines", number)
        repeated = self.unit.put(quality.repeated_lines(lines), "repeated", number)
        classified = self.unit.put(toc.classify_lines(lines, repeated), "classified", number)
        found = self.unit.put(toc.find_toc_pages(lines, self.fuzzy, classified), "contents-pages", number)
        entries = toc.parse_entries(classified.join(sized(found), ["magazine_id", "page_number"], "left_semi"))
        entries = self.unit.put(toc.plausible_entries(entries, pages), "entries", number)
        read = documents.filter("scan_status = 'done'").select(F.col("magazine_id").alias("id"))
        put("contents", toc.toc_status(read, found, entries))
        ranged = toc.article_ranges(entries)
        articles = put("articles", ranged.withColumn("article_id", F.concat_ws("-", F.col("magazine_id").cast("string"), F.col("position").cast("string"))))

        links = attach_keywords(articles.select(F.col("article_id").alias("id"), "title"), self.subthemes)
        links = links.select("subtheme_id", "article_id").distinct().join(articles.select("article_id", "magazine_id").hint("merge"), "article_id")
        links = put("links", links.withColumn("subtheme_id", F.col("subtheme_id").cast("int")))
        put("orphans", articles.join(links.select("article_id").hint("merge"), "article_id", "left_anti"))
        self.hashes.add(new, number)

    def _documents(self, new: DataFrame, pages: DataFrame) -> DataFrame:
        """Metadata from path and title; the date and the number that the title lacks from the first page."""
        cover = pages.groupBy("magazine_id").agg(F.min(F.when(F.col("page_number") == 1, F.col("raw_text"))).alias("cover"), F.count("raw_text").alias("read"))
        rows = path_dimensions(new.withColumnRenamed("id", "magazine_id")).join(cover.hint("merge"), "magazine_id", "left")
        rows = rows.withColumn("m", X.issue_metadata(F.col("title"), F.col("collection")))
        failed = F.coalesce("read", F.lit(0)) == 0
        return rows.select(
            "magazine_id", "file_hash", "collection", X.issue_type(F.col("title"), F.col("sub_dirs")).alias("issue_type"), F.coalesce("m.issue_number", X.cover_number(F.col("cover"))).alias("issue_number"),
            F.coalesce("m.publication_date", F.make_date(X.cover_year(F.col("cover")), F.lit(1), F.lit(1))).alias("publication_date"), F.col("m.label").alias("issue_month_label"),
            F.when(failed, "failed").otherwise("done").alias("scan_status"), F.when(failed, UNREAD).alias("error_message"),
        )

    def _schema(self, name: str) -> StructType:
        return StructType.fromDDL(SCHEMAS[name])

    def table(self, name: str) -> DataFrame:
        """All committed rows of one of ``SCHEMAS``, with their batch."""
        return self.unit.table(name, SCHEMAS[name])

    def current(self, name: str) -> DataFrame:
        """The rows of each document's latest version."""
        latest = self.table("documents").groupBy("magazine_id").agg(F.max("batch").alias("batch"))
        return self.table(name).join(latest.hint("merge"), ["magazine_id", "batch"], "left_semi").drop("batch")

    def run(self, documents: DataFrame, name: str) -> None:
        """Takes in what a stream of documents has now; goes on where the run of this name stopped."""
        run_available(self.spark, documents, self.unit.root, name=name, each=self.batch, keep=False)
