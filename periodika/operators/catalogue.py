"""Catalogue operators: filters over magazines and articles, facets, navigation and dashboard figures.

Every operator is a plan over DataFrames; children are counted before they are joined, so no join multiplies another's rows.
Tables of collections, tags and themes are small dimensions and left to the optimiser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stored import stored
from .ranks import ranks

#: Magazines on one page of a list up to which the page is broadcast.
BROADCAST_ROWS = 10_000


def filter_magazines(
    magazines: DataFrame, collection_tags: DataFrame | None = None, articles: DataFrame | None = None, *, unassigned: bool = False, collection_id: int | None = None,
    tag_id: int | None = None, year: int | None = None, issue_type: str | None = None, statuses: list[str] | None = None, has_toc: bool | None = None,
) -> DataFrame:
    """F1. Unassigned, else collection, else tag; and year, type, status, table of contents."""
    out = magazines
    if unassigned:
        out = out.filter(F.col("collection_id").isNull())
    elif collection_id is not None:
        out = out.filter(F.col("collection_id") == collection_id)
    elif tag_id is not None:
        out = out.join(collection_tags.filter(F.col("tag_id") == tag_id).select("collection_id"), "collection_id", "left_semi")
    if year is not None:
        out = out.filter(F.year("publication_date") == year)
    if issue_type is not None:
        out = out.filter(F.col("issue_type") == issue_type)
    if statuses:
        out = out.filter(F.col("scan_status").isin(statuses))
    if has_toc is not None:
        out = out.join(articles.select(F.col("magazine_id").alias("id")), "id", "left_semi" if has_toc else "left_anti")
    return out


def count_magazines(magazines: DataFrame, *args, **filters) -> DataFrame:
    """F2."""
    return filter_magazines(magazines, *args, **filters).agg(F.count_distinct("id").alias("n"))


def search_articles(articles: DataFrame, magazines: DataFrame, collections: DataFrame, q: str, *, collection_id: int | None = None, unassigned: bool = False, page: int = 1, limit: int = 50) -> DataFrame:
    """F3. Titles that hold ``q`` literally, whatever the case."""
    hits = articles.filter(F.lower("title").contains(q.lower())).select(F.col("id").alias("article_id"), F.col("title").alias("article"), "start_page", "magazine_id")
    wanted = filter_magazines(magazines, unassigned=unassigned, collection_id=collection_id).select(F.col("id").alias("magazine_id"), F.col("title").alias("magazine"), "publication_date", "collection_id")
    named = wanted.join(collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection")), "collection_id", "left")
    ordered = hits.join(named, "magazine_id").orderBy("article", F.desc_nulls_last("publication_date"), "start_page", "article_id")
    return ordered.offset((page - 1) * limit).limit(limit)


def without_toc(magazines: DataFrame, articles: DataFrame) -> DataFrame:
    """F4. Done magazines without any article."""
    return magazines.filter("scan_status = 'done'").join(articles.select(F.col("magazine_id").alias("id")), "id", "left_anti")


def articles_to_classify(articles: DataFrame, links: DataFrame, magazines: DataFrame, collections: DataFrame) -> DataFrame:
    """F6. Articles without link that were never sent, with their collection."""
    left = articles.filter(~F.col("sent")).join(links.select(F.col("article_id").alias("id")), "id", "left_anti")
    where = magazines.select(F.col("id").alias("magazine_id"), "collection_id").join(collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection")), "collection_id", "left")
    return left.join(where, "magazine_id").select("id", "title", F.coalesce("collection", F.lit("sans collection")).alias("collection"))


def validate_articles(articles: DataFrame) -> DataFrame:
    """F7. The rows with ``reject_reason``, null for a valid one."""
    n = F.length("title")
    reason = (
        F.when(F.col("title").isNull() | (n < 1), "title empty").when(n > 500, "title too long").when(F.col("start_page").isNull() | (F.col("start_page") < 1), "start below 1")
        .when(F.col("end_page") < 1, "end below 1").when(F.col("end_page") < F.col("start_page"), "end before start")
    )
    return articles.withColumn("reject_reason", reason)


def restart_failed(magazines: DataFrame) -> DataFrame:
    """F8. Failed magazines are queued again; those that a stop left in processing become failed, with a message."""
    stuck = F.col("scan_status") == "processing"
    failed = F.col("scan_status") == "failed"
    message = F.when(stuck, "interrupted").when(~failed, F.col("error_message"))
    return magazines.withColumn("error_message", message).withColumn("scan_status", F.when(failed, "queued").when(stuck, "failed").otherwise(F.col("scan_status")))


def error_census(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """F9. For each named (table, column): rows with a message, and rows that cleaning changes."""
    out = None
    for name, (df, column) in tables.items():
        clean = X.sanitize_error(F.col(column))
        one = df.agg(F.count_if(F.col(column).isNotNull()).alias("filled"), F.count_if(~F.col(column).eqNullSafe(clean)).alias("changed")).withColumn("place", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def list_magazines(magazines: DataFrame, pages: DataFrame, articles: DataFrame, *, sort: str = "date", page: int = 1, limit: int = 50) -> DataFrame:
    """A1. Magazines with their numbers of pages and articles; sort is date, added or updated."""
    keys = {"date": F.desc_nulls_last("publication_date"), "added": F.desc("created_s"), "updated": F.desc("updated_s")}
    top = magazines.orderBy(keys[sort], "title", "id").offset((page - 1) * limit).limit(limit)
    # written, as it is used four times; only the pages and articles of these magazines are counted
    top = stored(top, "listed")
    shown = top.select(F.col("id").alias("magazine_id"))
    shown = F.broadcast(shown) if limit <= BROADCAST_ROWS else shown.hint("merge")
    n_pages = pages.join(shown, "magazine_id", "left_semi").groupBy("magazine_id").agg(F.count("*").alias("page_count"))
    n_articles = articles.join(shown, "magazine_id", "left_semi").groupBy("magazine_id").agg(F.count("*").alias("article_count"))
    out = top.withColumnRenamed("id", "magazine_id").join(n_pages.hint("merge"), "magazine_id", "left").join(n_articles.hint("merge"), "magazine_id", "left")
    return out.fillna(0, ["page_count", "article_count"]).orderBy(keys[sort], "title", "magazine_id")


def facets(magazines: DataFrame) -> DataFrame:
    """A2. Counts by year, newest first, and of special issues, in one pass."""
    years = magazines.select(F.year("publication_date").alias("year"), "issue_type")
    return (
        years.groupingSets([["year"], ["issue_type"]], "year", "issue_type").agg(F.count("*").alias("n"), F.grouping("year").alias("by_type"))
        .filter("(by_type = 0 AND year IS NOT NULL) OR (by_type = 1 AND issue_type IN ('hs', 'sp'))")
        .select(F.when(F.col("by_type") == 0, F.col("year").cast("string")).otherwise(F.col("issue_type")).alias("facet"), "n")
    )


def library_overview(collections: DataFrame, magazines: DataFrame, collection_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """A3. Every collection with its count, its newest cover and its tags, and a row for what has no collection."""
    newest = F.struct(F.col("publication_date").isNotNull().alias("dated"), "publication_date", "created_s", "id")
    stats = magazines.groupBy("collection_id").agg(
        F.count("*").alias("n"), F.max_by("cover", F.when(F.col("cover").isNotNull(), newest)).alias("cover")
    )
    named = collection_tags.join(tags.withColumnRenamed("id", "tag_id").withColumnRenamed("name", "tag"), "tag_id")
    tag_lists = named.groupBy("collection_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    listed = collections.select(F.col("id").alias("collection_id"), "name").join(stats, "collection_id", "left").join(tag_lists, "collection_id", "left")
    rest = stats.filter("collection_id IS NULL").select("collection_id", F.lit(None).cast("string").alias("name"), "n", "cover", F.lit(None).cast("string").alias("tags"))
    return listed.unionByName(rest).select("collection_id", "name", F.coalesce("n", F.lit(0)).alias("n"), "cover", F.coalesce("tags", F.lit("")).alias("tags"))


def taxonomy_level1(themes: DataFrame, subthemes: DataFrame, links: DataFrame) -> DataFrame:
    """A4. Themes with their subthemes and articles; themes without links are left out."""
    joined = links.join(subthemes.select(F.col("id").alias("subtheme_id"), "theme_id"), "subtheme_id").join(themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme")), "theme_id")
    return joined.groupBy("theme_id", "theme").agg(F.count_distinct("subtheme_id").alias("subthemes"), F.count_distinct("article_id").alias("articles")).orderBy(F.desc("articles"), "theme")


def taxonomy_level2(subthemes: DataFrame, links: DataFrame, theme_id: int) -> DataFrame:
    """A5. The subthemes of a theme with their numbers of links, 0 included."""
    counts = links.groupBy(F.col("subtheme_id").alias("id")).agg(F.count("*").alias("n"))
    return subthemes.filter(F.col("theme_id") == theme_id).join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "name")


def taxonomy_level3(links: DataFrame, articles: DataFrame, magazines: DataFrame, collections: DataFrame, subtheme_id: int) -> DataFrame:
    """A6. The articles of a subtheme by collection, the largest collection first, each with its rank."""
    wanted = links.filter(F.col("subtheme_id") == subtheme_id).select(F.col("article_id").alias("id"))
    where = magazines.select(F.col("id").alias("magazine_id"), F.col("title").alias("magazine"), "publication_date", "collection_id")
    rows = articles.join(wanted, "id", "left_semi").join(where, "magazine_id")
    rows = rows.join(collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection")), "collection_id", "left").withColumn("collection", F.coalesce("collection", F.lit("Sans collection")))
    # ranks over all in ranges; a collection's own begin at its first
    numbered = stored(ranks(rows, F.col("collection"), F.desc_nulls_last("publication_date"), F.col("magazine"), F.col("start_page"), F.col("id"), name="at"), "ranked")
    groups = numbered.groupBy(F.col("collection").alias("c")).agg(F.count("*").alias("group_size"), F.min("at").alias("first"))
    sized = numbered.join(groups.hint("merge"), F.col("collection") == F.col("c"))
    return sized.select("collection", "group_size", (F.col("at") - F.col("first") + 1).alias("position"), F.col("id").alias("article_id"), "title", "magazine", "start_page")


def dashboard_stats(magazines: DataFrame, articles: DataFrame, links: DataFrame, users: DataFrame, days: int = 7) -> DataFrame:
    """A7. One row of figures; each table is summed by itself."""
    status = lambda *s: F.count_if(F.col("scan_status").isin(*s))
    m = magazines.agg(F.count("*").alias("total"), status("done").alias("done"), status("processing").alias("processing"), status("failed").alias("failed"), status("detected", "stable", "queued").alias("pending"))
    a = articles.agg(F.count("*").alias("articles"))
    c = links.agg(F.count_distinct("article_id").alias("covered"))
    u = users.agg(F.count_if(F.col("days_ago") <= days).alias("new_users"))
    key = [F.lit(1).alias("k")]
    out = m.select("*", *key)
    for one in (a, c, u):
        out = out.join(one.select("*", *key), "k")
    return out.drop("k").withColumn("coverage", F.when(F.col("articles") > 0, F.round(100 * F.col("covered") / F.col("articles"), 1)).otherwise(0.0))


def recently_updated(magazines: DataFrame, pages: DataFrame, articles: DataFrame, limit: int = 10) -> DataFrame:
    """A7. The magazines last updated, with counts."""
    return list_magazines(magazines, pages, articles, sort="updated", limit=limit)


def collection_subthemes(links: DataFrame, articles: DataFrame, magazines: DataFrame, subthemes: DataFrame, collection_id: int) -> DataFrame:
    """A8. Subthemes that occur in a collection, with their distinct articles."""
    inside = magazines.filter(F.col("collection_id") == collection_id).select(F.col("id").alias("magazine_id"))
    rows = links.join(articles.select(F.col("id").alias("article_id"), "magazine_id"), "article_id").join(inside, "magazine_id", "left_semi")
    return rows.groupBy("subtheme_id").agg(F.count_distinct("article_id").alias("articles")).join(subthemes.select(F.col("id").alias("subtheme_id"), "name"), "subtheme_id")


def batch_status(magazines: DataFrame, ids: DataFrame) -> DataFrame:
    """A9. Counts by status of one scan's magazines, and whether all have ended."""
    one = magazines.join(ids, "id", "left_semi")
    status = lambda *s: F.count_if(F.col("scan_status").isin(*s))
    out = one.agg(F.count("*").alias("n"), status("detected", "stable", "queued").alias("detected"), status("processing").alias("processing"), status("done").alias("done"), status("failed").alias("failed"))
    return out.withColumn("finished", F.col("done") + F.col("failed") == F.col("n"))


def backup_health(runs: DataFrame, now_s: Column, alert_hours: int = 36) -> DataFrame:
    """A10. Last run, last success and the alert they call for."""
    last = runs.agg(F.max("finished_s").alias("last_run"), F.max_by("succeeded", "finished_s").alias("last_ok"), F.max(F.when(F.col("succeeded"), F.col("finished_s"))).alias("last_success"))
    late = F.col("last_success").isNull() | (now_s - F.col("last_success") > alert_hours * 3600)
    return last.withColumn("alert", F.when(F.col("last_run").isNull(), None).when(~F.col("last_ok"), "last run failed").when(late, "no recent success"))


def list_dimension(df: DataFrame, by: list[str], page: int = 1, limit: int = 50) -> DataFrame:
    """A11."""
    return df.orderBy(*by).offset((page - 1) * limit).limit(limit)


def group_by_issue_type(magazines: DataFrame, collection_id: int) -> DataFrame:
    """A12. A collection's magazines: normal, hs, sp, newest first in each, with their positions."""
    rank = F.when(F.col("issue_type") == "normal", 0).when(F.col("issue_type") == "hs", 1).otherwise(2)
    w = Window.partitionBy("issue_type").orderBy(F.desc_nulls_last("publication_date"), "id")
    rows = magazines.filter(F.col("collection_id") == collection_id)
    return rows.select(rank.alias("group_rank"), "issue_type", F.row_number().over(w).alias("position"), "id", "title")


def articles_by_magazine(rows: DataFrame, order: str) -> DataFrame:
    """A12. Articles with the first place of their magazine's group, by which groups are ordered, and their place inside it."""
    by_magazine = Window.partitionBy("magazine_id")
    return rows.withColumns({"group_rank": F.min(order).over(by_magazine), "position": F.row_number().over(by_magazine.orderBy(order))})


def set_collection_tags(collection_tags: DataFrame, tags: DataFrame, magazines: DataFrame, collection_id: int, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A13. The bridge with the collection's tags replaced by ``wanted`` (tag_id), the ids that are no tags, and the magazines whose search documents must be
    refreshed (magazine_id). With an unknown id nothing is replaced."""
    unknown = wanted.join(tags.select(F.col("id").alias("tag_id")), "tag_id", "left_anti").distinct()
    refused = unknown.agg((F.count("*") > 0).alias("refused"))  # one row
    mine = F.col("collection_id") == collection_id
    old = collection_tags.select("collection_id", "tag_id", F.lit(False).alias("new"))
    new = wanted.join(tags.select(F.col("id").alias("tag_id")), "tag_id", "left_semi").distinct().select(F.lit(collection_id).cast(collection_tags.schema["collection_id"].dataType).alias("collection_id"), "tag_id", F.lit(True).alias("new"))
    both = old.unionByName(new).crossJoin(F.broadcast(refused))
    bridge = both.filter((F.col("new") & ~F.col("refused")) | (~F.col("new") & (~mine | F.col("refused")))).select("collection_id", "tag_id")
    refresh = magazines.filter(mine).crossJoin(F.broadcast(refused)).filter("NOT refused").select(F.col("id").alias("magazine_id"))
    return bridge, unknown, refresh


def cascade_delete(magazines: DataFrame, pages: DataFrame, articles: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A14. Magazines, pages, articles and links that are left when the magazines ``gone`` (id) go."""
    of = gone.select(F.col("id").alias("magazine_id"))
    lost = articles.join(of, "magazine_id", "left_semi").select(F.col("id").alias("article_id"))
    return magazines.join(gone, "id", "left_anti"), pages.join(of, "magazine_id", "left_anti"), articles.join(of, "magazine_id", "left_anti"), links.join(lost, "article_id", "left_anti")


def drop_collection(magazines: DataFrame, gone: DataFrame) -> DataFrame:
    """A14. Magazines whose collection is among ``gone`` (collection_id) lose it."""
    marked = magazines.join(gone.select("collection_id", F.lit(True).alias("__gone")).distinct(), "collection_id", "left")
    return marked.withColumn("collection_id", F.when(F.col("__gone").isNull(), F.col("collection_id"))).drop("__gone")


def first_tags(collection_tags: DataFrame) -> DataFrame:
    """A15. One tag for each collection, the smallest: the way back from a bridge to a key."""
    return collection_tags.groupBy("collection_id").agg(F.min("tag_id").alias("tag_id"))


def backfill(magazines: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """A15. Type read from the title and whether any article of the magazine has a link."""
    linked = articles.join(links.select(F.col("article_id").alias("id")), "id", "left_semi").select(F.col("magazine_id").alias("id")).distinct()
    out = magazines.withColumn("issue_type", X.issue_type(F.col("title"))).join(linked.withColumn("themed", F.lit(True)), "id", "left")
    return out.withColumn("themed", F.coalesce("themed", F.lit(False)))


def classification_status(articles: DataFrame, links: DataFrame, requests: DataFrame, pauses: DataFrame, now: Column, per_day: int, reserve: int = 2) -> DataFrame:
    """A16. Articles that wait, requests of the Pacific day of ``now`` against what the day allows, and the pause that holds and until when."""
    waiting = articles.filter(~F.col("sent")).join(links.select(F.col("article_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("pending"))
    day = lambda c: F.to_date(F.from_utc_timestamp(c, "America/Los_Angeles"))
    today = requests.filter(day(F.col("ts")) == day(now)).agg(F.count("*").alias("today"))
    pause = pauses.filter(F.col("until") > now).agg(F.max_by("reason", "until").alias("paused"), F.max("until").alias("until"))
    key = F.lit(1).alias("k")
    return waiting.select("*", key).join(today.select("*", key), "k").join(pause.select("*", key), "k").select("pending", "today", F.lit(per_day - reserve).alias("allowed"), "paused", "until")


def run_figures(batch: DataFrame, links: DataFrame, created: DataFrame, articles: DataFrame, all_links: DataFrame) -> DataFrame:
    """A16. What one classification run did: articles attached, subthemes created, and articles that still wait."""
    key = F.lit(1).alias("k")
    attached = links.join(batch.select("article_id"), "article_id", "left_semi").agg(F.count_distinct("article_id").alias("attached"))
    made = created.agg(F.count("*").alias("created"))
    known = all_links.select(F.col("article_id").alias("id")).unionByName(links.select(F.col("article_id").alias("id"))).unionByName(batch.select(F.col("article_id").alias("id")))
    left = articles.filter(~F.col("sent")).join(known, "id", "left_anti").agg(F.count("*").alias("remaining"))
    return attached.select("*", key).join(made.select("*", key), "k").join(left.select("*", key), "k").drop("k")
