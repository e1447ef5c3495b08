"""Tables of contents: finding their pages, parsing their entries, and what follows from both.

Everything runs on one table of lines. The entry parser is a small automaton over a page's lines; its states are recovered
with running sums over line order, so it is windows and one grouping, without a UDF.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import text as X
from ..sources.archive import path_dimensions
from ..sources.stored import stored
from .quality import reading_order_columns, reading_order_rows, repeated_lines, without_repeated_lines

# Patterns of lines of a table of contents: fixed values.
TRAILING = r"(?iu)^(.+?)(?:[.·…\s  ]{3,})(?:p\.?\s*)?([0-9]{1,4})(?:\s*[-–]\s*([0-9]{1,4}))?\s*$"
LAST_DIGIT = r"[0-9]\s*$"  # of any line that TRAILING fits
LEADING = r"^([0-9]{1,3})(?:[\s  ]+|\s*[/|·–—-]\s*)([A-ZÀ-Ý].{1,})$"
BARE = r"^([0-9]{1,3})$"
LABEL = r"^[A-ZÀ-Ý0-9][A-ZÀ-Ý0-9 ?!'’.-]{0,30}$"
HEADINGS = ["sommaire", "contents", "content", "summary", "table of contents", "index"]
MAX_HEADING, HEADING_PAGES, TOC_PAGES, MIN_NUMBERS, MIN_DENSITY, MIN_NEXT, MIN_RATIO = 30, 30, 8, 3, 4, 3, 0.85
NONE_FOUND = "Aucune page de sommaire n'a été identifiée dans ce numéro."
UNREADABLE = "Sommaire détecté (page {}) mais aucune entrée n'a pu en être lue."


def line_kind(line: Column) -> Column:
    """T1. blank, trailing, leading, bare, label or text; the first that fits."""
    # what is told by a look at one place of a line is asked before what walks along it
    words = F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != ""))
    label = line.rlike(LABEL) & line.rlike(r"\p{L}") & (words <= 4)
    return F.when(line == "", "blank").when(line.rlike(LAST_DIGIT) & line.rlike(TRAILING), "trailing").when(line.rlike(LEADING), "leading").when(line.rlike(BARE), "bare").when(label, "label").otherwise("text")


def classify_lines(lines: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """T1. Lines with their kind; running headers (``repeated``, else those of the lines themselves) count as blank."""
    return without_repeated_lines(lines, repeated=repeated).withColumn("kind", line_kind(F.col("line")))


def collapsed(line: Column) -> Column:
    """A line with single blanks; letters set apart are joined."""
    tokens = F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")
    return F.when((F.size(tokens) >= 4) & F.forall(tokens, lambda t: F.length(t) == 1), F.array_join(tokens, "")).otherwise(F.array_join(tokens, " "))


def is_heading(line: Column) -> Column:
    """T2. Whether a line is the heading of a table of contents."""
    starts = "(?iu)^(?:" + "|".join(HEADINGS) + r")(?!\p{L})"
    # by its first letters, white space aside, a line is hardly ever one, and need not be taken apart
    first = r"(?iu)^(?U:\s*)(?:" + "|".join(r"(?U:\s*)".join(h.replace(" ", "")) for h in HEADINGS) + ")"
    whole = X.bound(collapsed(line), lambda c: c.rlike(r"^\p{Lu}") & (F.length(c) <= MAX_HEADING) & c.rlike(starts))
    return line.rlike(first) & whole


@F.pandas_udf(BooleanType())
def _near_heading(token: pd.Series) -> pd.Series:
    return token.map(lambda t: t is not None and any(SequenceMatcher(None, t, w).ratio() >= MIN_RATIO for w in HEADINGS))


def fuzzy_headings(lines: DataFrame) -> DataFrame:
    """T3. The lines that look like a heading in part or with a misread letter.

    Each distinct token is judged once; an edit distance that no ratio of 0.85 allows rules most of them out before.
    """
    c = collapsed(F.col("line"))
    separators = r"[/|:•·»«\-–—]+"
    short = (F.length(c) > 0) & (F.length(c) <= MAX_HEADING) & (~c.rlike(r"^\p{Ll}") | c.rlike(separators))
    rows = lines.filter(short).select("magazine_id", "page_number", "line_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-zà-öø-ÿ]{5,})"), 1))).alias("token"))
    near = None
    for w in HEADINGS:
        one = F.levenshtein(F.col("token"), F.lit(w)) <= 0.3 * (F.length("token") + len(w)) / 2 + 1
        near = one if near is None else near | one
    good = rows.select("token").distinct().filter(near).filter(_near_heading("token"))
    return rows.join(good.hint("merge"), "token", "left_semi").select("magazine_id", "page_number", "line_no").distinct()


def entry_density(classified: DataFrame) -> DataFrame:
    """T4. Lines that look like entries, and bare numbers, of each page."""
    entry = F.col("kind").isin("trailing", "leading", "bare")
    return classified.groupBy("magazine_id", "page_number").agg(F.count_if(entry).alias("entries"), F.count_if(F.col("kind") == "bare").alias("bare"))


def find_toc_pages(lines: DataFrame, fuzzy: bool = True, classified: DataFrame | None = None) -> DataFrame:
    """T5. magazine_id, page_number of the pages of each table of contents. ``classified``: the classified lines where they are at hand.

    Headings first; else the first early page with something like a heading and three bare numbers (running headers count
    there); else the early page with most entry lines, four or more. The page after joins if it has three entry lines.
    """
    # used three times below: written once
    classified = stored(classify_lines(lines), "classified") if classified is None else classified
    density = stored(entry_density(classified), "density")
    strict = classified.filter((F.col("page_number") <= HEADING_PAGES) & is_heading(F.col("line"))).select("magazine_id", "page_number", F.lit(1).alias("tier"), F.lit(0).alias("rank")).distinct()
    early = density.filter((F.col("page_number") <= TOC_PAGES) & (F.col("entries") >= MIN_DENSITY))
    w = Window.partitionBy("magazine_id")
    best = early.withColumn("rank", F.row_number().over(w.orderBy(F.desc("entries"), "page_number")) - 1).filter("rank = 0").select("magazine_id", "page_number", F.lit(3).alias("tier"), "rank")
    found = strict.unionByName(best)
    if fuzzy:
        bare = lines.filter((F.col("page_number") <= TOC_PAGES) & F.col("line").rlike(BARE)).groupBy("magazine_id", "page_number").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_NUMBERS)
        near = fuzzy_headings(lines.filter(F.col("page_number") <= TOC_PAGES)).select("magazine_id", "page_number").distinct().join(bare.hint("merge"), ["magazine_id", "page_number"])
        first = near.withColumn("rank", F.row_number().over(w.orderBy("page_number")) - 1).filter("rank = 0").select("magazine_id", "page_number", F.lit(2).alias("tier"), "rank")
        found = found.unionByName(first)
    chosen = found.withColumn("least", F.min("tier").over(w)).filter("tier = least").select("magazine_id", "page_number")
    after = chosen.select("magazine_id", (F.col("page_number") + 1).alias("page_number"))
    full = density.filter(F.col("entries") >= MIN_NEXT).select("magazine_id", "page_number")
    return chosen.unionByName(after.join(full.hint("merge"), ["magazine_id", "page_number"], "left_semi")).distinct()


def parse_entries(classified: DataFrame) -> DataFrame:
    """T6. Entries (line_no, title, start_page, end_page) of each page from its classified lines.

    A segment begins at each blank, trailing, label or leading line. It is in number-first mode if it begins with a leading
    line, or from its first bare number that no text precedes. Each anchor (any line that isn't text) and the text
    lines after it are one group; an anchor takes its title from its own group or from the one before.
    """
    page = Window.partitionBy("magazine_id", "page_number").orderBy("line_no")
    kind = F.col("kind")
    breaks = F.when(kind.isin("blank", "trailing", "label", "leading"), 1).otherwise(0)
    anchors = F.when(kind != "text", 1).otherwise(0)
    sums = classified.withColumn("seg", F.sum(breaks).over(page)).withColumn("ent", F.sum(anchors).over(page))
    segment = Window.partitionBy("magazine_id", "page_number", "seg")
    lead = F.lag("kind").over(segment.orderBy("line_no"))
    opens = F.when((kind == "bare") & (lead.isNull() | (lead != "text")), F.col("line_no"))
    moded = sums.withColumn("opens", opens).withColumn("from_", F.min("opens").over(segment)).withColumn("head", F.min(F.when(kind == "leading", F.col("line_no"))).over(segment))
    mode = F.col("head").isNotNull() | F.coalesce(F.col("line_no") >= F.col("from_"), F.lit(False))
    rows = moded.withColumn("mode", mode)
    anchor = F.when(kind != "text", F.struct("line_no", "kind", "line", "mode"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(kind == "text", F.struct("line_no", "line")))), lambda t: t["line"])
    groups = rows.groupBy("magazine_id", "page_number", "ent").agg(F.min(anchor).alias("a"), texts.alias("texts"))
    by_ent = Window.partitionBy("magazine_id", "page_number").orderBy("ent")
    groups = groups.withColumn("before", F.lag("texts").over(by_ent)).withColumn("before_mode", F.coalesce(F.lag("a.mode").over(by_ent), F.lit(False)))
    nothing = F.array().cast("array<string>")
    last = lambda x: F.slice(x, F.greatest(F.size(x) - 2, F.lit(1)), F.lit(3))
    line, k = F.col("a.line"), F.col("a.kind")
    own = F.when(k == "leading", F.trim(F.regexp_extract(line, LEADING, 2))).when(k == "trailing", F.regexp_replace(F.regexp_extract(line, TRAILING, 1), "^[ .·…]+|[ .·…]+$", ""))
    number_first = (k == "leading") | ((k == "bare") & F.col("a.mode"))
    previous = F.when(F.col("before_mode"), nothing).otherwise(last(F.coalesce("before", nothing)))
    parts = (
        F.when(k == "leading", last(F.concat(F.array(own), F.col("texts")))).when(number_first, last(F.col("texts")))
        .when(k == "bare", previous).when(k == "trailing", F.concat(previous, F.array(own)))
    )
    start = F.when(k == "leading", F.regexp_extract(line, LEADING, 1)).when(k == "bare", line).when(k == "trailing", F.regexp_extract(line, TRAILING, 2))
    end = F.when(k == "trailing", F.nullif(F.regexp_extract(line, TRAILING, 3), F.lit("")))
    out = groups.filter(k.isin("leading", "bare", "trailing")).select(
        "magazine_id", "page_number", F.col("a.line_no").alias("line_no"), X.clean_title(F.trim(F.array_join(parts, " "))).alias("title"), start.cast("int").alias("start_page"), end.cast("int").alias("end_page"),
        number_first.alias("number_first"),
    )
    return out.filter((F.col("title") != "") & (F.col("number_first") | F.col("start_page").between(1, 999))).drop("number_first")


def plausible_entries(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """T7. Entries that point inside the document, with its last page."""
    last = pages.groupBy("magazine_id").agg(F.max("page_number").alias("last_page"))
    return entries.join(last.hint("merge"), "magazine_id").filter((F.col("start_page") > 0) & (F.col("start_page") <= F.col("last_page")))


#: The reading orders of a page, in order of preference.
READINGS = ("as stored", "columns", "rows")


def readings(words: DataFrame, page_width: float = 600.0) -> DataFrame:
    """T8. The lines of each page in each of ``READINGS``: magazine_id, page_number, strategy (its place there), line_no, line.

    From word boxes (block, line, n, text, x0, y0, x1, y1): lines as they are stored; D6's columns, where a line that crosses the gutter is
    two; D7's bands of blocks, each block's lines as stored.
    """
    page = ["magazine_id", "page_number"]
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    plain = words.groupBy(*page, "block", "line").agg(F.min("n").alias("first"), spelt.alias("text"))
    columns = reading_order_columns(words, page_width).withColumnRenamed("line_text", "text")
    boxes = words.groupBy(*page, "block").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"))
    bands = reading_order_rows(boxes).select(*page, "block", "band", "position")
    rows = plain.join(bands.hint("merge"), [*page, "block"])
    out = None
    for i, (lines, order) in enumerate(((plain, ["first"]), (columns, ["side", "top", "block", "line"]), (rows, ["band", "position", "first"]))):
        number = F.row_number().over(Window.partitionBy(*page).orderBy(*order))
        one = lines.select(*page, F.lit(i).alias("strategy"), number.alias("line_no"), F.col("text").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def entries_of_readings(words: DataFrame, lines: DataFrame, found: DataFrame, pages: DataFrame, page_width: float = 600.0) -> DataFrame:
    """T8. The plausible entries (T7) of the pages ``found`` in each reading, with its ``strategy``.

    ``lines`` are all lines of the documents as stored: their running headers count as blank in every reading. Only words of found pages are read.
    """
    near = stored(words.join(found.select("magazine_id", "page_number").distinct().hint("merge"), ["magazine_id", "page_number"], "left_semi"), "contents-words")
    # a page in one reading is a page of its own to the parser
    read = readings(near, page_width).withColumn("page_number", F.struct("strategy", "page_number"))
    classified = stored(classify_lines(read, stored(repeated_lines(lines), "repeated")), "readings")
    entries = parse_entries(classified).withColumns({"strategy": F.col("page_number.strategy"), "page_number": F.col("page_number.page_number")})
    return plausible_entries(entries, pages)


def best_reading(entries: DataFrame) -> DataFrame:
    """T8. Of entries with their ``strategy`` those of the one with most entries for each magazine, the smallest on a tie."""
    counts = entries.groupBy("magazine_id", "strategy").agg(F.count("*").alias("n"))
    best = counts.groupBy("magazine_id").agg(F.max_by("strategy", F.struct("n", -F.col("strategy"))).alias("strategy"))
    return entries.join(best.hint("merge"), ["magazine_id", "strategy"], "left_semi")


def best_strategy(strategies: list[DataFrame]) -> DataFrame:
    """T8. The same for tables of entries, in order of preference."""
    union = None
    for i, entries in enumerate(strategies):
        one = entries.withColumn("strategy", F.lit(i))
        union = one if union is None else union.unionByName(one)
    return best_reading(union)


def article_ranges(entries: DataFrame) -> DataFrame:
    """T9. Entries in page order with their end: their own, else the page before the next one's start, else the last page."""
    w = Window.partitionBy("magazine_id").orderBy("start_page", "page_number", "line_no")
    following = F.greatest("start_page", F.lead("start_page").over(w) - 1)
    return entries.withColumn("position", F.row_number().over(w)).withColumn("end_page", F.coalesce("end_page", following, "last_page"))


def toc_status(magazines: DataFrame, toc_pages: DataFrame, entries: DataFrame) -> DataFrame:
    """T10. done or failed and why, for each magazine."""
    pages = toc_pages.groupBy("magazine_id").agg(F.array_sort(F.collect_set("page_number")).alias("pages"))
    n = entries.groupBy("magazine_id").agg(F.count("*").alias("n"))
    rows = magazines.select(F.col("id").alias("magazine_id")).join(pages.hint("merge"), "magazine_id", "left").join(n.hint("merge"), "magazine_id", "left")
    head, tail = UNREADABLE.split("{}")
    listed = F.concat(F.lit(head), F.array_join("pages", ", "), F.lit(tail))
    has = F.coalesce("n", F.lit(0)) > 0
    return rows.select(
        "magazine_id", F.when(~has & F.col("pages").isNotNull(), "failed").otherwise("done").alias("toc_status"),
        F.when(has, None).when(F.col("pages").isNotNull(), listed).otherwise(F.lit(NONE_FOUND)).alias("message"),
    )


def toc_diagnosis(magazines: DataFrame, articles: DataFrame, collections: DataFrame) -> DataFrame:
    """T11. For each collection with done magazines that lack articles: how many, of how many, by status of the table of contents."""
    has = articles.select(F.col("magazine_id").alias("id")).distinct().withColumn("has", F.lit(True))
    done = magazines.filter("scan_status = 'done'").join(has, "id", "left")
    missing = F.col("has").isNull()
    out = done.groupBy("collection_id").agg(F.count_if(missing).alias("missing"), F.count("*").alias("total"), *(F.count_if(missing & (F.col("toc_status") == s)).alias(s) for s in ("done", "failed", "pending")))
    named = out.filter("missing > 0").join(collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection")), "collection_id", "left")
    return named.orderBy(F.desc("missing"), F.desc("total"), "collection")


def heading_candidates(lines: DataFrame, pages: int = 12) -> DataFrame:
    """T11. Short lines of the first pages that might be headings, and how often they occur."""
    return lines.filter((F.col("page_number") <= pages) & F.length("line").between(3, 30)).groupBy(F.lower("line").alias("line")).agg(F.count("*").alias("n"))


def rebuild_metadata(magazines: DataFrame, collections: DataFrame, pages: DataFrame) -> DataFrame:
    """T12. The magazines whose stored collection, type, number, date or label differ from what their path, title and cover say.

    The collection is the first directory; ``new_collection_id`` is null where there is no such collection yet (``get_or_create_dimension`` of the
    names makes it). Directories below it speak for the type. What the title lacks, date or number, is read from the first page.
    """
    named = path_dimensions(magazines).withColumn("m", X.issue_metadata(F.col("title"), F.col("collection")))
    cover = pages.filter("page_number = 1").groupBy(F.col("magazine_id").alias("id")).agg(F.min("raw_text").alias("cover_text"))
    dims = collections.select(F.col("id").alias("new_collection_id"), F.col("name").alias("collection"))
    stored = collections.select(F.col("id").alias("collection_id"), F.col("name").alias("stored_collection"))
    rows = named.join(cover.hint("merge"), "id", "left").join(dims, "collection", "left").join(stored, "collection_id", "left")
    year = F.make_date(X.cover_year(F.col("cover_text")), F.lit(1), F.lit(1))
    out = rows.select(
        "id", "stored_collection", F.col("collection").alias("new_collection"), "new_collection_id", "issue_type", X.issue_type(F.col("title"), F.col("sub_dirs")).alias("new_issue_type"),
        "issue_number", F.coalesce("m.issue_number", X.cover_number(F.col("cover_text"))).alias("new_issue_number"), "publication_date", F.coalesce("m.publication_date", year).alias("new_publication_date"),
        "issue_month_label", F.col("m.label").alias("new_issue_month_label"),
    )
    same = F.col("stored_collection").eqNullSafe(F.col("new_collection"))
    for c in ("issue_type", "issue_number", "publication_date", "issue_month_label"):
        same = same & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return out.filter(~same)


def dedupe_articles(articles: DataFrame) -> DataFrame:
    """T13. Articles without the later ones of equal magazine, title and start."""
    w = Window.partitionBy("magazine_id", "title", "start_page").orderBy("id")
    return articles.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def count_duplicates(articles: DataFrame) -> DataFrame:
    """T13, dry run. ``duplicates``: how many articles ``dedupe_articles`` would take out, and ``groups``: of how many groups."""
    n = articles.groupBy("magazine_id", "title", "start_page").agg(F.count("*").alias("n")).filter("n > 1")
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("groups"))
