"""Quality gates on page text, running headers and reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stored import sized, stored

# Frequent French and English words that real prose can't do without: fixed values.
COMMON_WORDS = [
    "le", "la", "les", "de", "des", "un", "une", "et", "à", "dans", "pour", "que", "qui", "est", "sur", "avec", "par", "ce", "en", "au", "aux",
    "the", "and", "of", "to", "in", "for", "is", "on", "with", "by", "at", "from", "this", "that", "are", "was",
]
MIN_CHARS, MIN_TOKENS, MIN_SHARE, MIN_PAGES, MIN_PAGE_SHARE = 20, 15, 0.10, 3, 0.05


def page_lines(pages: DataFrame) -> DataFrame:
    """One row for each line of each page: magazine_id, page_number, line_no from 1, line (stripped)."""
    # outer, as Spark would filter by the split text before it splits it once more
    rows = pages.select("magazine_id", "page_number", F.posexplode_outer(X.lines(F.col("raw_text"))).alias("at", "raw")).filter("at IS NOT NULL")
    return rows.select("magazine_id", "page_number", (F.col("at") + 1).alias("line_no"), X.strip(F.col("raw")).alias("line"))


def has_native_text(pages: DataFrame) -> DataFrame:
    """D1. Whether every page of a document has 20 characters or more."""
    long = F.length(X.strip(F.coalesce("raw_text", F.lit("")))) >= MIN_CHARS
    return pages.groupBy("magazine_id").agg(F.bool_and(long).alias("native"))


def garbled_documents(pages: DataFrame) -> DataFrame:
    """D2. Documents whose pages lack common words: three such pages or more, and 5 % of those with tokens enough to judge."""
    tokens = F.regexp_extract_all(F.lower("raw_text"), F.lit("([a-zà-öø-ÿ]{2,})"), 1)
    common = F.array(*map(F.lit, COMMON_WORDS))
    judged = pages.select("magazine_id", tokens.alias("t")).select("magazine_id", F.size("t").alias("n"), F.size(F.filter("t", lambda t: F.array_contains(common, t))).alias("hits"))
    enough = F.coalesce(F.col("n") >= MIN_TOKENS, F.lit(False))
    counts = judged.groupBy("magazine_id").agg(F.count_if(enough).alias("judged"), F.count_if(enough & (F.col("hits") / F.greatest("n", F.lit(1)) < MIN_SHARE)).alias("garbled_pages"))
    return counts.withColumn("garbled", (F.col("garbled_pages") >= MIN_PAGES) & (F.col("garbled_pages") >= MIN_PAGE_SHARE * F.col("judged")))


def ocr_decision(pages: DataFrame) -> DataFrame:
    """D3. copy, skip-text or force-ocr for each document."""
    both = has_native_text(pages).join(garbled_documents(pages).select("magazine_id", "garbled"), "magazine_id")
    return both.select("magazine_id", F.when(F.col("garbled"), "force-ocr").when(F.col("native"), "copy").otherwise("skip-text").alias("decision"))


# Short words of four languages for the page language profile: fixed values, the 12 or so most frequent ones of each.
PROFILES = {
    "fr": ["le", "la", "les", "de", "des", "un", "une", "et", "dans", "pour", "que", "qui", "du", "en", "sur", "au", "par"],
    "en": ["the", "and", "of", "to", "in", "for", "is", "on", "with", "by", "at", "that", "it", "be", "as", "are", "this"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "den", "mit", "von", "zu", "für", "sich", "auf"],
    "es": ["el", "los", "las", "y", "que", "del", "se", "una", "por", "con", "para", "como", "su"],
}
MIXED_SHARE = 0.3


def language_scores(c: Column) -> Column:
    """Array of struct(share, lang), the likeliest first: each language's part of all profile words found."""
    # each step is bound, so that it is done once; words of no profile go first, by one look into a set
    every = sorted({w for words in PROFILES.values() for w in words})
    tokens = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}]+)"), 1), lambda t: t.isin(every))
    found = lambda tokens, words: F.size(F.filter(tokens, lambda t: t.isin(words)))
    counts = X.bound(tokens, lambda tokens: F.array(*(F.struct(found(tokens, words).alias("n"), F.lit(lang).alias("lang")) for lang, words in PROFILES.items())))

    def shares(counts: Column) -> Column:
        total = F.greatest(F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"]), F.lit(1))
        return X.bound(total, lambda n: F.transform(counts, lambda x: F.struct((x["n"] / n).alias("share"), x["lang"].alias("lang"))))

    return F.reverse(F.array_sort(X.bound(counts, shares)))


def with_language(pages: DataFrame) -> DataFrame:
    """D4. ``pages`` with ``language``: fr, en or mixed; null for pages under 20 characters. Profiles of frequent words stand in for a detector library."""
    s = F.col("__s")
    first, second = F.element_at(s, 1), F.element_at(s, 2)
    mixed = ~first["lang"].isin("fr", "en") | (second["lang"].isin("fr", "en") & (second["share"] > MIXED_SHARE))
    short = F.length(X.strip(F.coalesce("raw_text", F.lit("")))) < MIN_CHARS
    kept = [c for c in pages.columns if c != "language"]
    rows = pages.select(*kept, short.alias("__short"), language_scores(F.coalesce("raw_text", F.lit(""))).alias("__s"))
    return rows.select(*kept, F.when(F.col("__short") | (first["share"] == 0), None).when(mixed, "mixed").otherwise(first["lang"]).alias("language"))


def page_language(pages: DataFrame) -> DataFrame:
    """D4. magazine_id, page_number and ``language`` of each page, as ``with_language`` has it."""
    return with_language(pages).select("magazine_id", "page_number", "language")


def template(line: Column) -> Column:
    """A line in lower case with its digits masked."""
    return F.lower(F.regexp_replace(line, "[0-9]+", "#"))


def repeated_lines(lines: DataFrame, least: int = MIN_PAGES) -> DataFrame:
    """D5. Templates of lines that stand on ``least`` pages of a document or more: running headers and footers."""
    rows = lines.filter("line <> ''").select("magazine_id", template(F.col("line")).alias("template"), "page_number")
    # dealt by what is counted on, so that the pages of a template are told apart where they are counted
    return rows.repartition("magazine_id", "template").groupBy("magazine_id", "template").agg(F.count_distinct("page_number").alias("pages")).filter(F.col("pages") >= least)


def without_repeated_lines(lines: DataFrame, keep_bare_numbers: bool = False, repeated: DataFrame | None = None) -> DataFrame:
    """``lines`` with those of ``repeated_lines`` blanked. Bare page numbers are among them unless ``keep_bare_numbers``.

    ``repeated``: the templates of the whole document as a written table, where ``lines`` are a part or another reading of it or it is at hand.
    """
    found = stored(repeated_lines(lines), "repeated") if repeated is None else repeated
    found = found.select("magazine_id", "template", F.lit(True).alias("__repeated"))
    if keep_bare_numbers:
        found = found.filter("template <> '#'")
    marked = lines.withColumn("template", template(F.col("line"))).join(sized(found, "template"), ["magazine_id", "template"], "left")
    return marked.select("magazine_id", "page_number", "line_no", F.when(F.col("__repeated"), "").otherwise(F.col("line")).alias("line"))


MIN_GAP = 60.0


def reading_order_columns(words: DataFrame, page_width: float = 600.0) -> DataFrame:
    """D6. Lines in column order: the left column from top to bottom, then the right one.

    A line of words is split at its widest gap if that is a gutter (the later one on a tie), else it is on the side where its
    middle is.
    """
    line = Window.partitionBy("magazine_id", "page_number", "block", "line")
    placed = words.withColumn("pos", F.row_number().over(line.orderBy("x0", "n")))
    gap = F.lead("x0").over(line.orderBy("pos")) - F.col("x1")
    cut = placed.withColumn("gap", gap).withColumn("cut", F.when(F.col("gap").isNotNull(), F.struct("gap", "pos"))).withColumn("cut", F.max("cut").over(line))
    whole = F.when((F.min("x0").over(line) + F.max_by("x1", "pos").over(line)) / 2 < page_width / 2, 0).otherwise(1)
    side = F.when(F.coalesce(F.col("cut.gap") >= MIN_GAP, F.lit(False)), F.when(F.col("pos") <= F.col("cut.pos"), 0).otherwise(1)).otherwise(whole)
    sided = cut.withColumn("side", side).withColumn("top", F.min("y0").over(line))
    parts = sided.groupBy("magazine_id", "page_number", "side", "top", "block", "line").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("w"))
    return parts.select("magazine_id", "page_number", "side", "top", "block", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("line_text"))


def reading_order_rows(blocks: DataFrame) -> DataFrame:
    """D7. Blocks (y0, y1, x0) in bands of overlapping height, from left to right in each: band and position."""
    page = Window.partitionBy("magazine_id", "page_number")
    order = page.orderBy("y0", "block")
    bottom = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    banded = blocks.withColumn("new", F.when(F.col("y0") < bottom, 0).otherwise(1)).withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("magazine_id", "page_number", "band").orderBy("x0", "y0", "block")
    return banded.withColumn("position", F.row_number().over(inside)).drop("new")
