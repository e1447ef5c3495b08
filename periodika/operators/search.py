"""Full-text search over pages: an inverted index as a table, matching, grouping by magazine, and boxes of hits.

All terms of a query must match (the last one also as a prefix); relevance is by terms matched exactly, then where and how
often. A query's terms are a handful of literals, so they filter the index by its term column and nothing else is read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.stored import sized, stored
from .ranks import ranks

MAX_RANKED = 500


def search_documents(pages: DataFrame, magazines: DataFrame, collections: DataFrame, collection_tags: DataFrame) -> DataFrame:
    """S10. One row for each page with all that search filters on; tag_ids is empty where there are none."""
    tags = collection_tags.groupBy("collection_id").agg(F.array_sort(F.collect_list("tag_id")).alias("tag_ids"))
    m = magazines.select(F.col("id").alias("magazine_id"), F.col("title").alias("magazine_title"), "issue_number", "issue_month_label", "publication_date", "collection_id")
    m = m.join(collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection_name")), "collection_id", "left").join(tags, "collection_id", "left")
    page = F.concat_ws("-", F.col("magazine_id").cast("string"), F.col("page_number").cast("string")).alias("page_id")
    return pages.join(m.hint("merge"), "magazine_id").select(
        page, "magazine_id", "page_number", "magazine_title", "issue_number", F.col("issue_month_label").alias("issue_month"), "collection_name", F.year("publication_date").alias("year"), "publication_date",
        F.coalesce("raw_text", F.lit("")).alias("raw_text"), "collection_id", F.coalesce("tag_ids", F.array().cast("array<int>")).alias("tag_ids"),
    )


def refresh_search_documents(old: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """S11. ``old`` with all pages of the magazines in ``changed`` (magazine_id) replaced by those of ``fresh``; ``SearchStore`` does so in place."""
    return old.join(changed.hint("merge"), "magazine_id", "left_anti").unionByName(fresh.join(changed.hint("merge"), "magazine_id", "left_semi"))


def build_inverted_index(docs: DataFrame) -> DataFrame:
    """R1. term, attr (0 text, 1 magazine title), page_id, magazine_id, tf and positions."""
    # words are counted within their page's row, so that texts are grouped and not each word
    return _index(docs.groupBy("page_id", "magazine_id").agg(*(F.collect_list(c).alias(c) for c in _TEXTS)), _postings)


_TEXTS = ("raw_text", "magazine_title")


def index_runs(docs: DataFrame) -> DataFrame:
    """R1. The rows of ``build_inverted_index`` of a written table, in runs sorted by term; only pages of several rows are shuffled, the others are whole as they are."""
    page = ["page_id", "magazine_id"]
    repeated = stored(docs.groupBy(page).agg(F.count("*").alias("n")).filter("n > 1").select(page), "repeated")
    one, some = docs, None
    if not repeated.isEmpty():
        again, same = sized(repeated, "page_id").alias("r"), F.expr("d.page_id <=> r.page_id AND d.magazine_id <=> r.magazine_id")
        one, some = (docs.alias("d").join(again, same, kind).select("d.*") for kind in ("left_anti", "left_semi"))
    runs = lambda batches: _sorted_runs(_postings(batches))
    out = _index(one.select(*page, *(F.array_compact(F.array(c)).alias(c) for c in _TEXTS)), runs)
    return out if some is None else out.unionByName(build_inverted_index(some).sortWithinPartitions("term"))


def _index(pages: DataFrame, postings) -> DataFrame:
    """Postings of pages that have arrays of their texts and titles."""
    fields = [pages.schema[c] for c in ("page_id", "magazine_id")]
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("attr", T.IntegerType()), *fields, T.StructField("tf", T.LongType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return pages.select("page_id", "magazine_id", *(F.transform(c, X.terms).alias(c) for c in _TEXTS)).mapInArrow(postings, schema)


def _postings(batches):
    """For each page (id, magazine, lists of words of its texts and of its titles) and word: tf and positions."""
    for batch in batches:
        for attr in (0, 1):
            texts = batch.column(2 + attr)
            lists = texts.flatten()
            words = lists.flatten()
            if not len(words):
                continue
            of = pc.list_parent_indices(lists).to_numpy()
            row = pc.list_parent_indices(texts).to_numpy()[of]
            at = np.arange(len(words)) - np.searchsorted(of, of)
            known = words.dictionary_encode()
            code = known.indices.to_numpy()
            order = np.lexsort((at, code, row))
            row, code = row[order], code[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])]))
            ends = np.append(first, len(words))
            page = pa.array(row[first])
            yield pa.RecordBatch.from_arrays(
                [
                    known.dictionary.take(pa.array(code[first])), pa.array(np.full(len(first), attr, np.int32)), batch.column(0).take(page), batch.column(1).take(page),
                    pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[order].astype(np.int32))),
                ], names=["term", "attr", "page_id", "magazine_id", "tf", "positions"],
            )


#: Bytes of postings that are sorted at once, and rows that go out at once.
RUN_BYTES, RUN_ROWS = 64 << 20, 1 << 16


def _sorted_runs(batches):
    """The batches' rows, sorted by term within runs of about ``RUN_BYTES``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= RUN_BYTES:
            yield from _by_term(held)
            held, size = [], 0
    yield from _by_term(held)


def _by_term(batches):
    if not batches:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    known = rows["term"].combine_chunks().dictionary_encode()
    place = np.empty(len(known.dictionary), np.int64)
    place[pc.sort_indices(known.dictionary).to_numpy()] = np.arange(len(place))
    order = np.argsort(place[known.indices.to_numpy()], kind="stable")
    for at in range(0, len(order), RUN_ROWS):
        yield from rows.take(pa.array(order[at : at + RUN_ROWS])).combine_chunks().to_batches()


def store_index(index: DataFrame, path: str, partitions: int = 64) -> None:
    """R1. Writes the index sorted by term in ``partitions`` ranges of terms: a query's literal terms skip files and row groups by their bounds."""
    index.repartitionByRange(partitions, "term", "page_id").sortWithinPartitions("term", "page_id").write.mode("overwrite").parquet(path)


def query_terms(q: str) -> tuple[list[str], list[list[str]]]:
    """Single terms and phrases of a query, in the index's form."""
    phrases = [X.plain_terms(p) for p in re.findall(r'"([^"]+)"', q)]
    return X.plain_terms(re.sub(r'"[^"]+"', " ", q)), [p for p in phrases if p]


def _typos(term: str) -> int:
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


#: Longer terms have no table of variants, which would grow with the square of their length: they are compared one by one.
LONG = 40
#: Terms near a query's words that are looked for as literals; more are joined.
LITERAL_TERMS = 2000


def _shorter(terms: Column) -> Column:
    """Every text of an array with one sign left out."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    return F.array_distinct(F.flatten(F.transform(F.filter(terms, lambda t: t != ""), cut)))


def term_variants(terms: DataFrame) -> DataFrame:
    """R2. (variant, term): each term (column ``term``) with up to two signs left out, so that terms near a word are found by equality.

    Two words at an edit distance of d become equal by leaving out d signs or fewer of each. Words of 5 to 8 signs may differ by 1 and longer
    ones by 2 (``_typos``), so terms under 4 signs have no variants and those under 7 lose one sign. A term of more than ``LONG`` signs has
    one row, with a null variant.
    """
    t, n = F.array("term"), F.length("term")
    once = _shorter(t)
    some = F.when(n > LONG, F.array(F.lit(None).cast("string"))).when(n >= 7, F.concat(t, once, _shorter(once))).when(n >= 4, F.concat(t, once))
    return terms.select("term", F.explode(F.array_distinct(some)).alias("variant")).select("variant", "term")


def _cut_text(word: str, d: int) -> set[str]:
    out, last = {word}, {word}
    for _ in range(d):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


def near_terms(variants: DataFrame, words: list[str]) -> DataFrame:
    """R2. (i, term): the terms of a variants' table within the allowed distance of the i-th word, by equality of variants.

    The literal variants of a query's words reach the table's files, which are sorted by variant.
    """
    out = None
    for i, w in enumerate(words):
        d = _typos(w)
        if not d:
            continue
        same = variants.filter(F.col("variant").isin(sorted(_cut_text(w, d)))) if len(w) <= LONG + d else variants.limit(0)
        if len(w) >= LONG - d:
            same = same.unionByName(variants.filter(F.col("variant").isNull() & F.length("term").between(len(w) - d, len(w) + d)))
        one = same.filter(F.levenshtein("term", F.lit(w)) <= d).select(F.lit(i).alias("i"), "term").distinct()
        out = one if out is None else out.unionByName(one)
    return out


def matching_pages(index: DataFrame, q: str, typos: bool = False, variants: DataFrame | None = None) -> DataFrame:
    """R2. page_id, magazine_id, exact (terms matched without typo), attr, tf of the pages that match all terms, in no order.

    ``variants``: the table of ``term_variants``; without it typos are looked for by comparing each word with every term.
    """
    terms, phrases = query_terms(q)
    wanted = [*terms, *(w for p in phrases for w in p)]
    if not wanted:
        return index.select("page_id", "magazine_id", F.lit(0).cast("long").alias("exact"), F.lit(0).alias("attr"), F.lit(0).cast("long").alias("tf")).limit(0)
    t = F.col("term")
    near: dict[int, list[str]] = {}
    joined = None
    if typos and variants is not None and any(_typos(w) for w in wanted):
        found = near_terms(variants, wanted)
        rows = found.limit(LITERAL_TERMS + 1).collect()
        if len(rows) <= LITERAL_TERMS:
            for r in rows:
                near.setdefault(r["i"], []).append(r["term"])
        else:
            joined = stored(found.groupBy("term").agg(F.collect_set("i").alias("near")), "near-terms")

    def fits(i: int, w: str) -> Column:
        out = t == w
        if i == len(terms) - 1:
            out = out | t.startswith(w)
        if near.get(i):
            out = out | t.isin(sorted(near[i]))
        if joined is not None:
            out = out | F.coalesce(F.array_contains("near", i), F.lit(False))
        elif typos and variants is None and _typos(w):
            out = out | (F.levenshtein(t, F.lit(w)) <= _typos(w))
        return out

    tests = [fits(i, w) for i, w in enumerate(wanted)]
    some = tests[0]
    for one in tests[1:]:
        some = some | one
    hits = (index if joined is None else index.join(joined.hint("merge"), "term", "left")).filter(some)
    exact = F.array(*(F.when(t == w, F.lit(i)) for i, w in enumerate(wanted)))
    which = F.array(*(F.when(test, F.lit(i)) for i, test in enumerate(tests)))
    rows = hits.select("page_id", "magazine_id", "attr", "tf", F.filter(which, lambda x: x.isNotNull()).alias("which"), F.filter(exact, lambda x: x.isNotNull()).alias("exact"), "term", "positions")
    pages = rows.groupBy("page_id", "magazine_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("which")))).alias("found"), F.size(F.array_distinct(F.flatten(F.collect_list("exact")))).cast("long").alias("exact"),
        F.min("attr").alias("attr"), F.sum(F.when(F.col("attr") == 0, F.col("tf")).otherwise(0)).alias("tf"),
        *(F.flatten(F.collect_list(F.when((F.col("attr") == 0) & (t == w), F.col("positions")))).alias(f"at_{w}") for w in sorted({w for p in phrases for w in p})),
    ).filter(F.col("found") == len(wanted))
    for p in phrases:
        starts = F.col(f"at_{p[0]}")
        rest = [(j, F.col(f"at_{w}")) for j, w in enumerate(p) if j]
        pages = pages.filter(F.exists(starts, lambda s: _all_at(s, rest)))
    return pages.select("page_id", "magazine_id", "exact", "attr", "tf")


def match_pages(index: DataFrame, q: str, typos: bool = False, limit: int | None = MAX_RANKED, variants: DataFrame | None = None) -> DataFrame:
    """R2. page_id, magazine_id, exact, tf and rank of the matching pages: most exact terms first, then text before title, then frequency.

    The first ``limit`` pages are numbered as one sorted array of that size; without a limit ranks are made in ranges, in parallel.
    """
    pages = matching_pages(index, q, typos, variants)
    if limit is None:
        return ranks(pages, F.desc("exact"), F.col("attr"), F.desc("tf"), F.col("page_id")).select("page_id", "magazine_id", "exact", "tf", F.col("rank").cast("int").alias("rank"))
    top = pages.orderBy(F.desc("exact"), "attr", F.desc("tf"), "page_id").limit(limit)
    rows = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("exact")).alias("e"), "attr", (-F.col("tf")).alias("f"), "page_id", "magazine_id", "exact", "tf"))).alias("rows"))
    return rows.select(F.posexplode("rows").alias("at", "r")).select("r.page_id", "r.magazine_id", "r.exact", "r.tf", (F.col("at") + 1).alias("rank"))


def _all_at(start: Column, rest: list[tuple[int, Column]]) -> Column:
    out = F.lit(True)
    for j, positions in rest:
        out = out & F.array_contains(positions, start + j)
    return out


def search_filters(docs: DataFrame, *, magazine_id: int | None = None, title: str | None = None, year: int | None = None, issue_number: str | None = None, tags: list[int] | None = None, collections: list[int] | None = None) -> DataFrame:
    """F5."""
    out = docs
    for column, value in (("magazine_id", magazine_id), ("magazine_title", title), ("year", year), ("issue_number", issue_number)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    if tags:
        out = out.filter(F.arrays_overlap("tag_ids", F.array(*map(F.lit, tags))))
    if collections:
        out = out.filter(F.col("collection_id").isin(collections))
    return out


def group_by_magazine(hits: DataFrame, magazines: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    """R3. One row for each magazine: its best page and its number of matching pages; most pages first, then the newest."""
    best = hits.groupBy("magazine_id").agg(F.count("*").alias("occurrence_count"), F.min(F.struct("rank", "page_id")).alias("best"))
    dated = best.join(magazines.select(F.col("id").alias("magazine_id"), F.coalesce(F.col("publication_date").cast("string"), F.lit("")).alias("date")).hint("merge"), "magazine_id")
    ordered = dated.orderBy(F.desc("occurrence_count"), F.desc("date"), "best.rank")
    return ordered.offset((page - 1) * limit).limit(limit).select("magazine_id", "occurrence_count", F.col("best.page_id").alias("page_id"), F.col("best.rank").alias("rank"))


def count_groups(hits: DataFrame) -> DataFrame:
    """R3. The number of magazines with hits: the total that pages of ``group_by_magazine`` are part of."""
    return hits.agg(F.count_distinct("magazine_id").alias("total"))


def hit_boxes(words: DataFrame, terms: list[str]) -> DataFrame:
    """R5. Word boxes whose bare lower form is one of the terms."""
    return words.filter(F.lower(F.regexp_replace("text", r"(?U)\W+", "")).isin(terms))


def find_in_document(hits: DataFrame, words: DataFrame, terms: list[str], magazine_id: int) -> DataFrame:
    """R4. The matching pages of one magazine in page order, with their numbers of boxes, 1 at least. ``hits``: of ``matching_pages``, which ranks nothing."""
    boxes = hit_boxes(words.filter(F.col("magazine_id") == magazine_id), terms).groupBy("page_number").agg(F.count("*").alias("n"))
    pages = hits.filter(F.col("magazine_id") == magazine_id).select("page_id", F.element_at(F.split("page_id", "-"), -1).cast("int").alias("page_number"))
    return pages.join(boxes.hint("merge"), "page_number", "left").select("page_id", "page_number", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).alias("occurrence_count")).orderBy("page_number")


def occurrence_navigation(hits: DataFrame) -> DataFrame:
    """R6. The hit before and after each one in its magazine, around the ends."""
    order = Window.partitionBy("magazine_id").orderBy("page_number")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hits.select(
        "magazine_id", "page_number", F.coalesce(F.lag("page_number").over(order), F.last("page_number").over(whole)).alias("previous"),
        F.coalesce(F.lead("page_number").over(order), F.first("page_number").over(whole)).alias("next"),
    )
