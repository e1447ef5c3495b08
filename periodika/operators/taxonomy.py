"""Keyword taxonomy: attaching articles, coverage, orphans, imports and exports.

A taxonomy file is at most ``MAX_TAXONOMY_BYTES``, so its keywords are a table of proven size and are broadcast; articles are
never moved to find their keywords.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .ranks import ranks

MAX_TAXONOMY_BYTES = 2 * 1024 * 1024

# Words too frequent to tell a subject: fixed values.
STOP_WORDS = [
    "avec", "sans", "pour", "dans", "chez", "tout", "tous", "toute", "toutes", "plus", "moins", "bien", "cette", "cet", "ces", "leur", "leurs",
    "notre", "nos", "votre", "vos", "mais", "donc", "quand", "comme", "faire", "fait", "etre", "avoir", "peut", "faut", "sont", "ont", "une", "des",
    "les", "que", "qui", "quoi", "dont", "vous", "nous", "elle", "elles", "ils", "the", "and", "for", "with", "your", "you", "our", "this", "that",
    "from", "how", "what", "why", "all", "new", "best", "get", "are", "can", "has",
]


def keywords_of(subthemes: DataFrame) -> DataFrame:
    """subtheme_id, place, keyword, pattern and block of every keyword that isn't blank."""
    rows = subthemes.select(F.col("id").alias("subtheme_id"), F.posexplode("keywords").alias("place", "keyword"))
    k = F.col("keyword")
    return rows.select("subtheme_id", "place", "keyword", X.keyword_pattern(k).alias("pattern"), X.block(k).alias("block")).filter("pattern IS NOT NULL")


#: Keywords that are broadcast; more are joined by sort-merge.
BROADCAST_KEYWORDS = 100_000


def keyword_matches(articles: DataFrame, keywords: DataFrame) -> DataFrame:
    """subtheme_id, place, article_id of every keyword found in a title.

    A keyword is looked up by its first word among the title's words (also without a final s or x), and only then is its pattern
    tried. Keywords are counted first: up to ``BROADCAST_KEYWORDS`` they are broadcast, beyond that the same join is a sort-merge join. A keyword
    without a word is looked up by its first character among the characters of the titles that are neither letters nor blanks.
    """
    signs = r"[^\p{L}\p{N}_\s]"
    of_word = lambda w: F.concat(F.lit("w"), F.regexp_replace(w, "[sx]$", ""))
    of_sign = lambda c: F.concat(F.lit("-"), c)
    key = F.when(F.col("block") != "", of_word(F.col("block"))).otherwise(of_sign(F.regexp_extract(X.norm(F.col("keyword")), signs, 0)))
    blocked = keywords.withColumn("block", key).filter("block <> '-'").select("subtheme_id", "place", "pattern", "block")
    counts = blocked.agg(F.count("*").alias("n"), F.count_if(F.col("block").startswith("-")).alias("odd")).first()
    titles = articles.select(F.col("id").alias("article_id"), X.norm(F.col("title")).alias("norm"))
    words = F.transform(X.tokens(F.col("norm")), of_word)
    if counts["odd"]:
        words = F.concat(words, F.transform(F.regexp_extract_all("norm", F.lit(signs), 0), of_sign))
    spread = titles.select("article_id", "norm", F.explode(F.array_distinct(words)).alias("block"))
    side = F.broadcast(blocked) if counts["n"] <= BROADCAST_KEYWORDS else blocked.hint("merge")
    return spread.join(side, "block").filter(F.expr("norm RLIKE pattern")).select("subtheme_id", "place", "article_id")


def attach_keywords(articles: DataFrame, subthemes: DataFrame) -> DataFrame:
    """K1. (subtheme_id, article_id) where any keyword of the subtheme is in the article's title."""
    return keyword_matches(articles, keywords_of(subthemes)).select("subtheme_id", "article_id").distinct()


def attach_one_magazine(articles: DataFrame, subthemes: DataFrame, magazine_id: int) -> DataFrame:
    """K2."""
    return attach_keywords(articles.filter(F.col("magazine_id") == magazine_id), subthemes)


def sterile_keywords(articles: DataFrame, subthemes: DataFrame) -> DataFrame:
    """K3. Keywords that no title has, with their places in their lists."""
    keywords = keywords_of(subthemes)
    found = keyword_matches(articles, keywords).select("subtheme_id", "place").distinct()
    return keywords.join(found.hint("merge"), ["subtheme_id", "place"], "left_anti").select("subtheme_id", "place", "keyword")


def _items(json: Column) -> Column:
    """The elements of a JSON array as JSON texts; null for anything else."""
    return F.from_json(F.when(json.rlike(r"^\s*\["), json), T.ArrayType(T.StringType()))


def _text(json: Column, name: str) -> Column:
    """A text field of a JSON object, stripped; empty if it isn't there, and for anything that is no object."""
    return F.coalesce(X.strip(F.get_json_object(json, f"$.{name}")), F.lit(""))


def parse_taxonomy(payloads: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """S8. Entries (place, theme, subtheme, keywords) of taxonomy documents, and what was refused and why.

    Every element is read by itself, so one that is malformed is refused and the others hold. ``place`` orders the entries of one document.
    """
    doc = payloads.select(F.octet_length(column).alias("size"), F.col(column).alias("d"), _items(F.get_json_object(column, "$.thematiques")).alias("themes"))
    refused_root = (F.col("size") > MAX_TAXONOMY_BYTES) | F.col("themes").isNull() | (F.size("themes") == 0)
    none = F.lit(None).cast("string")
    refused = doc.filter(F.coalesce(refused_root, F.lit(True))).select(none.alias("theme"), none.alias("subtheme"), F.when(F.col("size") > MAX_TAXONOMY_BYTES, "too large").otherwise("no list of themes").alias("reason"))
    good = doc.filter(~F.coalesce(refused_root, F.lit(True)))
    themes = good.select(F.posexplode("themes").alias("i", "t")).select("i", _text(F.col("t"), "nom").alias("theme"), F.posexplode_outer(_items(F.get_json_object("t", "$.sous_thematiques"))).alias("j", "s"))
    kept = F.filter(F.transform(F.coalesce(_items(F.get_json_object("s", "$.mots_cles")), F.array().cast("array<string>")), X.strip), lambda k: k.isNotNull() & (k != ""))
    rows = themes.select(F.struct("i", "j").alias("place"), "theme", _text(F.col("s"), "nom").alias("subtheme"), kept.alias("keywords"))
    reason = F.when(F.col("theme") == "", "theme without name").when(F.col("subtheme") == "", "subtheme without name").when(F.size("keywords") == 0, "no keyword")
    judged = rows.withColumn("reason", reason)
    return judged.filter("reason IS NULL").drop("reason"), refused.unionByName(judged.filter("reason IS NOT NULL").select("theme", "subtheme", "reason"))


def import_taxonomy(entries: DataFrame, themes: DataFrame, subthemes: DataFrame) -> DataFrame:
    """K4. All subthemes after an import: listed ones get their new keywords, the others stay; new ones have no id yet.

    Themes are matched whatever their case and keep their stored spelling, new ones that of their first entry; subthemes are matched by exact
    name in their theme. Of entries that repeat a subtheme the last one holds. Nothing is written.
    """
    stored = themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme"), F.lower("name").alias("key"))
    now = subthemes.join(stored.hint("merge"), "theme_id").select("id", "key", F.col("name").alias("subtheme"), F.col("keywords").alias("old"))
    listed = entries.withColumn("key", F.lower("theme"))
    new = listed.groupBy("key", "subtheme").agg(F.max_by("keywords", "place").alias("new"))
    spelt = listed.groupBy("key").agg(F.min_by("theme", "place").alias("first")).join(stored.select("key", "theme").hint("merge"), "key", "full").select("key", F.coalesce("theme", "first").alias("theme"))
    both = now.join(new.hint("merge"), ["key", "subtheme"], "full").join(spelt.hint("merge"), "key", "left")
    action = F.when(F.col("id").isNull(), "created").when(F.col("new").isNull(), "kept").otherwise("updated")
    return both.select("id", "theme", "subtheme", F.coalesce("new", "old").alias("keywords"), action.alias("action"))


def import_report(articles: DataFrame, imported: DataFrame) -> DataFrame:
    """K4. For each imported subtheme the articles it would hold, and its keywords that no title has; the corpus, and how much of it is covered."""
    named = imported.filter("action <> 'kept'").withColumn("id", F.xxhash64("theme", "subtheme"))
    keywords = keywords_of(named)
    hits = keyword_matches(articles, keywords)
    links = hits.select("subtheme_id", "article_id").distinct()
    per = named.join(links.groupBy(F.col("subtheme_id").alias("id")).agg(F.count("*").alias("n")).hint("merge"), "id", "left")
    lines = per.select(F.concat_ws(" > ", "theme", "subtheme").alias("line"), F.coalesce("n", F.lit(0)).alias("n"))
    sterile = keywords.join(hits.select("subtheme_id", "place").distinct().hint("merge"), ["subtheme_id", "place"], "left_anti")
    sterile = sterile.join(named.select(F.col("id").alias("subtheme_id"), "theme", "subtheme").hint("merge"), "subtheme_id").select(F.concat_ws(" > ", F.lit("sterile"), "theme", "subtheme", "keyword").alias("line"), F.lit(0).cast("long").alias("n"))
    total = articles.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    covered = links.agg(F.count_distinct("article_id").alias("c")).withColumn("k", F.lit(1))
    figures = total.join(F.broadcast(covered), "k").select(F.inline(F.array(*(F.struct(F.lit(name).alias("line"), n.alias("n")) for name, n in (("corpus", F.col("n")), ("covered", F.col("c")), ("uncovered", F.col("n") - F.col("c")))))))
    return lines.unionByName(sterile).unionByName(figures)


def recompute_all(articles: DataFrame, themes: DataFrame, subthemes: DataFrame) -> DataFrame:
    """K5. Keyword links of every subtheme, counted, by theme and name."""
    n = attach_keywords(articles, subthemes).groupBy(F.col("subtheme_id").alias("id")).agg(F.count("*").alias("n"))
    named = subthemes.select("id", "theme_id", "name").join(themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme")), "theme_id").join(n.hint("merge"), "id", "left")
    return named.select("theme", "name", F.coalesce("n", F.lit(0)).alias("n")).orderBy("theme", "name")


def merge_links(old: DataFrame, attached: DataFrame) -> DataFrame:
    """K6. Links after a recomputation: keyword links are replaced, the model's stay and aren't doubled."""
    kept = old.filter("source <> 'mots_cles'")
    new = attached.select("subtheme_id", "article_id").distinct().join(kept.select("subtheme_id", "article_id").hint("merge"), ["subtheme_id", "article_id"], "left_anti")
    return kept.select("subtheme_id", "article_id", "source").unionByName(new.select("subtheme_id", "article_id", F.lit("mots_cles").alias("source")))


def orphans(articles: DataFrame, links: DataFrame) -> DataFrame:
    """K7. Articles without any link."""
    return articles.join(links.select(F.col("article_id").alias("id")), "id", "left_anti")


def orphan_words(orphan_articles: DataFrame, limit: int = 40, least: int = 4) -> DataFrame:
    """K8. The words that most orphan titles have, ``limit`` of them."""
    words = F.filter(F.regexp_extract_all(X.norm(F.col("title")), F.lit("([a-z0-9]+)"), 1), lambda w: (F.length(w) >= least) & ~F.array_contains(F.array(*map(F.lit, STOP_WORDS)), w))
    counts = orphan_articles.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(limit)


def _with_collection(articles: DataFrame, magazines: DataFrame, collections: DataFrame, how: str) -> DataFrame:
    where = magazines.select(F.col("id").alias("magazine_id"), "collection_id")
    return articles.join(where, "magazine_id").join(collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection")), "collection_id", how)


def corpus_by_collection(articles: DataFrame, magazines: DataFrame, collections: DataFrame) -> DataFrame:
    """K9. Distinct titles of each collection (the first of those that differ in case or blanks), with magazines and characters."""
    rows = _with_collection(articles, magazines, collections, "inner").withColumn("clean", X.strip(F.col("title"))).filter("clean <> ''")
    w = Window.partitionBy("collection", F.lower("clean")).orderBy("id")
    firsts = rows.withColumn("r", F.row_number().over(w)).filter("r = 1")
    titles = firsts.groupBy("collection").agg(F.count("*").alias("titles"), F.sum(F.length("clean")).alias("chars"))
    issues = rows.groupBy("collection").agg(F.count_distinct("magazine_id").alias("magazines"))
    return titles.join(issues, "collection").orderBy(F.desc("titles"), "collection")


def corpus_titles(articles: DataFrame, magazines: DataFrame, collections: DataFrame) -> DataFrame:
    """K9. The titles themselves, a row each."""
    rows = _with_collection(articles, magazines, collections, "inner").withColumn("clean", X.strip(F.col("title"))).filter("clean <> ''")
    w = Window.partitionBy("collection", F.lower("clean")).orderBy("id")
    return rows.withColumn("r", F.row_number().over(w)).filter("r = 1").select("collection", F.col("clean").alias("title"))


def orphans_by_collection(articles: DataFrame, links: DataFrame, magazines: DataFrame, collections: DataFrame) -> DataFrame:
    """K10. Distinct orphan titles with their collection."""
    rows = _with_collection(orphans(articles, links), magazines, collections, "left")
    return rows.select(F.coalesce("collection", F.lit("(sans collection)")).alias("collection"), "title").distinct()


def existing_taxonomy(themes: DataFrame, subthemes: DataFrame, keep_empty: bool = False, most_keywords: int | None = None) -> DataFrame:
    """K11. Themes with their subthemes; with ``keep_empty`` also themes without any, and at most ``most_keywords`` keywords each."""
    keywords = F.col("keywords") if most_keywords is None else F.slice("keywords", 1, most_keywords)
    lists = subthemes.groupBy("theme_id").agg(F.array_sort(F.collect_list(F.struct(F.col("name"), F.array_join(keywords, "|").alias("keywords")))).alias("subs"))
    return themes.select(F.col("id").alias("theme_id"), F.col("name").alias("theme")).join(lists, "theme_id", "left" if keep_empty else "inner").select(
        "theme", F.coalesce(F.array_join(F.transform("subs", lambda s: F.concat_ws("=", s["name"], s["keywords"])), ";"), F.lit("")).alias("subthemes")
    )


def export_volumetry(articles: DataFrame, links: DataFrame, magazines: DataFrame, collections: DataFrame, threshold: int = 600_000) -> DataFrame:
    """K12. Sizes of an export, and whether it passes the threshold for one request."""
    titles = orphans_by_collection(articles, links, magazines, collections)
    sizes = titles.agg(F.count("*").alias("unique_titles"), F.count_distinct("collection").alias("collections"), F.coalesce(F.sum(F.length("title")), F.lit(0)).alias("chars"))
    counts = articles.agg(F.count("*").alias("articles")).withColumn("k", F.lit(1))
    lost = orphans(articles, links).agg(F.count("*").alias("orphans")).withColumn("k", F.lit(1))
    return sizes.withColumn("k", F.lit(1)).join(counts, "k").join(lost, "k").drop("k").withColumn("too_large", F.col("chars") > threshold)


def coverage_stats(articles: DataFrame, links: DataFrame, warn_below: float = 50.0) -> DataFrame:
    """K17. Articles, those with a link, and the share."""
    a = articles.agg(F.count("*").alias("articles")).withColumn("k", F.lit(1))
    c = links.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi").agg(F.count_distinct("article_id").alias("covered")).withColumn("k", F.lit(1))
    percent = F.when(F.col("articles") > 0, F.round(100 * F.col("covered") / F.col("articles"), 1)).otherwise(0.0)
    warn = (F.col("articles") == 0) | (100 * F.col("covered") < warn_below * F.col("articles"))
    return a.join(c, "k").drop("k").withColumn("percent", percent).withColumn("warn", warn)


def fold_batches(costs: Column, most_items: int, most_cost: int) -> Column:
    """Batch numbers of items in an array, by greedy packing: an array as long as ``costs``."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("cost"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] >= most_items) | (acc["cost"] + c > most_cost))
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(
            batch.alias("batch"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), F.when(full, c.cast("long")).otherwise(acc["cost"] + c).alias("cost"),
            F.concat(acc["out"], F.array(batch)).alias("out"),
        )

    return F.aggregate(costs, start, step, lambda acc: acc["out"])


MAX_ITEMS, MAX_TOKENS = 300, 100_000
#: Rows that one task packs at a time.
PACK_ROWS = 1 << 16


def _numbered(rows: DataFrame, by: str, width: int = 4096) -> DataFrame:
    """``rows`` (``by``, id, cost) with ``rn``, from 0 in the order of (id, cost) inside each ``by``; ids are ranked in ranges of ``width``."""
    ranged = rows.withColumn("__range", F.floor(F.col("id") / width))
    sizes = ranged.groupBy(by, "__range").agg(F.count("*").alias("n"))
    offsets = sizes.select(F.col(by).alias("__by"), F.col("__range").alias("__at"), (F.sum("n").over(Window.partitionBy(by).orderBy("__range")) - F.col("n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__range").orderBy("id", "cost")) - 1
    numbered = ranged.withColumn("__rn", inside).join(offsets.hint("merge"), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__at")))
    return numbered.select(by, "id", "cost", (F.col("__rn") + F.col("__before")).alias("rn"))


def _next_starts(costs: np.ndarray, own: int, most_items: int, most_cost: int) -> np.ndarray:
    """For each of the first ``own`` items, where the next batch begins if one begins there."""
    total = np.concatenate([[0], np.cumsum(costs)])
    i = np.arange(own)
    return np.maximum(i + 1, np.minimum(np.minimum(i + most_items, len(costs)), np.searchsorted(total, total[:own] + most_cost, "right") - 1))


def pack_ranges(rows: DataFrame, by: str, most_items: int, most_cost: int, width: int = PACK_ROWS) -> DataFrame:
    """``by``, id and batch of ``rows`` (``by``, id, cost): greedy packing in the order of ids inside each ``by``, in parallel ranges.

    A batch holds ``most_items`` at most, so a range of rows depends on what came before only by the place, one of its first
    ``most_items`` + 1, where its first batch begins. Each range, with the first rows of the next one, gives the place in the next
    range and the number of batches for every such place; one row for a range then carries the open batch on, and the ranges
    are numbered in parallel.
    """
    width = max(width, most_items)
    numbered = _numbered(rows, by)
    own = numbered.withColumn("range", F.floor(F.col("rn") / width))
    lent = own.filter((F.col("range") > 0) & (F.col("rn") % width < most_items)).withColumn("range", F.col("range") - 1)
    shared = own.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False)))
    kind = rows.schema[by].dataType.simpleString()

    def ends(part):
        part = part.sort_values("rn")
        n = int(part["own"].sum())
        after = _next_starts(part["cost"].to_numpy(np.int64), n, most_items, most_cost)
        exits, counts = np.arange(n + most_items + 1), np.zeros(n + most_items + 1, np.int64)
        for i in range(n - 1, -1, -1):
            exits[i], counts[i] = exits[after[i]], counts[after[i]] + 1
        first = slice(0, most_items + 1)
        return pd.DataFrame({by: part[by].iloc[:1].to_numpy(), "range": part["range"].iloc[:1].to_numpy(), "exits": [(exits[first] - n).tolist()], "counts": [counts[first].tolist()]})

    def carry(part):
        part = part.sort_values("range")
        place, batch, entries, bases = 0, 0, [], []
        for exits, counts in zip(part["exits"], part["counts"], strict=True):
            entries.append(place)
            bases.append(batch)
            place, batch = int(exits[place]), batch + int(counts[place])
        return pd.DataFrame({by: part[by].to_numpy(), "range": part["range"].to_numpy(), "entry": entries, "base": bases})

    def number(part):
        part = part.sort_values("rn")
        n, place = int(part["own"].sum()), int(part["entry"].iloc[0])
        after = _next_starts(part["cost"].to_numpy(np.int64), n, most_items, most_cost)
        starts = np.zeros(n, np.int64)
        while place < n:
            starts[place] = 1
            place = int(after[place])
        batch = int(part["base"].iloc[0]) - 1 + np.cumsum(starts)
        return pd.DataFrame({by: part[by].iloc[:n].to_numpy(), "id": part["id"].iloc[:n].to_numpy(), "batch": batch})

    tables = shared.groupBy(by, "range").applyInPandas(ends, f"`{by}` {kind}, range long, exits array<long>, counts array<long>")
    entries = tables.groupBy(by).applyInPandas(carry, f"`{by}` {kind}, range long, entry long, base long").select(F.col(by).alias("__by"), F.col("range").alias("__at"), "entry", "base")
    known = shared.join(entries.hint("merge"), F.col(by).eqNullSafe(F.col("__by")) & (F.col("range") == F.col("__at"))).drop("__by", "__at")
    return known.groupBy(by, "range").applyInPandas(number, f"`{by}` {kind}, id {rows.schema['id'].dataType.simpleString()}, batch int")


def json_length(c: Column) -> Column:
    """Signs of a text as a JSON string, quotes included; 4 for null. Signs beyond ASCII stand for themselves."""
    short, control = F.regexp_count(c, F.lit(r'["\\\\\n\r\t\x08\x0C]')), F.regexp_count(c, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))
    return F.when(c.isNull(), 4).otherwise(F.length(c) + 2 + short + 5 * control)


# What a request has around the values of an item: a fixed value.
ITEM = '{"article_id": , "titre": , "collection": }'


def item_cost(id: Column, title: Column, collection: Column, empty_request: int = 0) -> Column:
    """K13. Tokens that an item adds to a request: a quarter of its JSON with id, title and collection, rounded as the whole is.

    ``empty_request``: signs of the request without items and without taxonomy; its remainder by 4 decides how an item is rounded.
    """
    n = len(ITEM) + F.length(id.cast("string")) + json_length(title) + json_length(collection)
    return (F.floor((n + (empty_request + 3)) / 4) - (empty_request + 3) // 4).cast("int")


def pack_batches(articles: DataFrame, base_cost: int, partition_by: str | None = None, empty_request: int = 0) -> DataFrame:
    """K13. Articles (id, title, collection) in batches of 300 items and 100 000 tokens at most, in the order of their ids.

    ``base_cost`` are the tokens of a request without items, its taxonomy included. While 300 of the costliest items fit beside it, only the
    count can close a batch, and row numbers give the batch. Otherwise packing depends on all that came before; it goes on in ranges
    of rows, inside each value of ``partition_by`` or over all.
    """
    collection = F.col("collection") if "collection" in articles.columns else F.lit(None).cast("string")
    rows = articles.select(F.col(partition_by) if partition_by else F.lit(0).alias("__all"), "id", item_cost(F.col("id"), F.col("title"), collection, empty_request).alias("cost"))
    if partition_by is None:
        most = rows.agg(F.coalesce(F.max("cost"), F.lit(0))).first()[0]
        if base_cost + MAX_ITEMS * most <= MAX_TOKENS:
            return ranks(articles.select("id"), F.col("id"), name="rn").select("id", F.floor((F.col("rn") - 1) / MAX_ITEMS).alias("batch"))
        return pack_ranges(rows, "__all", MAX_ITEMS, MAX_TOKENS - base_cost).select("id", F.col("batch").cast("long").alias("batch"))
    return pack_ranges(rows, partition_by, MAX_ITEMS, MAX_TOKENS - base_cost)


def split_failed_batch(batch: DataFrame) -> DataFrame:
    """K14. A batch without usable answer in two: ``half`` 0 comes next, then 1. One item stays whole."""
    w = Window.partitionBy("batch").orderBy("id")
    n = F.count("*").over(Window.partitionBy("batch"))
    first = F.greatest(F.floor(n / 2), F.lit(1))
    return batch.withColumn("half", F.when(F.row_number().over(w) <= first, 0).otherwise(1))


def failure_streak(attempts: DataFrame, pause_after: int = 3) -> DataFrame:
    """K14. Attempts (account, at, ok) with the number of failures in a row up to each, and whether a pause begins there."""
    order = Window.partitionBy("account").orderBy("at", "id")
    run = attempts.withColumn("run", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(order))
    streak = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(Window.partitionBy("account", "run").orderBy("at", "id"))
    return run.withColumn("streak", streak).withColumn("pause", F.col("streak") == pause_after).drop("run")


def valid_keywords(proposals: DataFrame, articles: DataFrame, most: int = 8, least_chars: int = 4, floor: int = 5, share: float = 0.02) -> DataFrame:
    """K15. Of the proposed (proposal_id, place, keyword), the usable ones, at most 8 each: long enough, new, and not too frequent."""
    clean = proposals.withColumn("keyword", F.lower(X.strip(F.col("keyword")))).filter(F.length("keyword") >= least_chars)
    first = clean.groupBy("proposal_id", "keyword").agg(F.min("place").alias("place"))
    as_subthemes = first.select("keyword").distinct().select(F.xxhash64("keyword").alias("id"), F.array("keyword").alias("keywords"))
    hits = attach_keywords(articles, as_subthemes).groupBy(F.col("subtheme_id").alias("kid")).agg(F.count("*").alias("hits"))
    total = articles.agg(F.count("*").alias("total")).withColumn("k", F.lit(1))
    rows = first.withColumn("kid", F.xxhash64("keyword")).join(hits.hint("merge"), "kid", "left").withColumn("k", F.lit(1)).join(F.broadcast(total), "k")  # one row
    usable = rows.filter(F.coalesce("hits", F.lit(0)) <= F.greatest(F.lit(float(floor)), share * F.col("total")))
    w = Window.partitionBy("proposal_id").orderBy("place")
    return usable.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("proposal_id", "keyword", F.col("r").alias("place"))


ANSWER = T.StructType(
    [
        T.StructField("article_id", T.LongType()), T.StructField("sous_thematique_id", T.LongType()),
        T.StructField("nouvelle", T.StructType([T.StructField("thematique", T.StringType()), T.StructField("nom", T.StringType()), T.StructField("mots_cles", T.StringType())])),
    ]
)


def name_key(c: Column) -> Column:
    """What two names share if they are one: no accents, case or double blanks."""
    return F.regexp_replace(X.strip(X.norm(c)), r"(?U)\s+", " ")


def apply_labels(batch: DataFrame, answers: DataFrame, themes: DataFrame, subthemes: DataFrame, articles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """K16. Links and new subthemes from a model's JSON answers (batch_id, answer) for a batch (batch_id, article_id).

    Every element of an answer is read by itself: malformed ones, articles outside the batch, unknown ids and unknown themes are passed
    over; of several answers for one article the first valid one counts. A new subtheme that exists under the same name (accents, case
    and blanks aside) is that one; else it is created once, with the usable keywords (``valid_keywords`` over ``articles``) of its first proposal.
    """
    rows = answers.select("batch_id", F.posexplode(_items(F.col("answer"))).alias("place", "x")).select("batch_id", "place", F.from_json("x", ANSWER).alias("a")).select("batch_id", "place", "a.*")
    inside = rows.join(batch.select("batch_id", "article_id").hint("merge"), ["batch_id", "article_id"], "left_semi")
    known = inside.join(subthemes.select(F.col("id").alias("sous_thematique_id"), F.lit(True).alias("known")).hint("merge"), "sous_thematique_id", "left")
    of_theme = themes.select(F.col("id").alias("theme_id"), F.lower(X.strip(F.col("name"))).alias("theme_key"))
    named = known.withColumn("theme_key", F.lower(X.strip(F.col("nouvelle.thematique")))).join(of_theme.hint("merge"), "theme_key", "left")
    named = named.withColumn("name", X.strip(F.col("nouvelle.nom"))).withColumn("name_key", name_key(F.col("nouvelle.nom")))
    new_ok = F.col("theme_id").isNotNull() & (F.coalesce(F.length("name"), F.lit(0)) > 0) & (F.length("name") <= 255)
    valid = named.filter(F.coalesce("known", F.lit(False)) | new_ok)
    w = Window.partitionBy("batch_id", "article_id").orderBy("place")
    first = valid.withColumn("r", F.row_number().over(w)).filter("r = 1")
    old = subthemes.groupBy("theme_id", name_key(F.col("name")).alias("name_key")).agg(F.min("id").alias("same_id"))
    placed = first.join(old.hint("merge"), ["theme_id", "name_key"], "left").withColumn("subtheme_id", F.when(F.coalesce("known", F.lit(False)), F.col("sous_thematique_id")).otherwise(F.col("same_id")))
    order = F.struct("batch_id", "place")
    created = placed.filter("subtheme_id IS NULL").groupBy("theme_id", "name_key").agg(F.min_by("name", order).alias("name"), F.min_by("nouvelle.mots_cles", order).alias("proposed"))
    if articles is None:
        created = created.drop("proposed")
    else:
        keyed = created.withColumn("proposal_id", F.xxhash64("theme_id", "name_key"))
        proposals = keyed.select("proposal_id", F.posexplode(_items(F.col("proposed"))).alias("place", "keyword"))
        usable = valid_keywords(proposals, articles).groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("place", "keyword"))).alias("k"))
        created = keyed.join(usable.hint("merge"), "proposal_id", "left").select("theme_id", "name_key", "name", F.coalesce(F.transform("k", lambda k: k["keyword"]), F.array().cast("array<string>")).alias("keywords"))
    fresh = F.col("subtheme_id").isNull()
    links = placed.select("article_id", "subtheme_id", F.when(fresh, F.col("theme_id")).alias("new_theme_id"), F.when(fresh, F.col("name_key")).alias("new_key"), F.lit("gemini").alias("source"))
    return links, created


def stamp_batch(articles: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """K16. ``articles`` with ``sent`` and ``sent_at`` set for all articles of the batch, answered or not."""
    marked = articles.join(batch.select(F.col("article_id").alias("id"), F.lit(True).alias("__sent")).distinct().hint("merge"), "id", "left")
    before = F.col("sent_at") if "sent_at" in articles.columns else F.lit(None).cast("timestamp")
    return marked.withColumn("sent_at", F.when(F.col("__sent"), at).otherwise(before)).withColumn("sent", F.coalesce("__sent", "sent")).drop("__sent")
