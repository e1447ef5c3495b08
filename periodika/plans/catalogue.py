"""Registered queries: catalogue, filters and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalogue as C
from .registry import query

STRIP = "strip_accents(lower({}))"


@query("f1_filter_magazines", """SELECT id, title FROM v_magazine m WHERE collection_id IN (SELECT collection_id FROM v_collection_tag WHERE tag_id = 2)
    AND year(publication_date) >= 1990 AND year(publication_date) = 1997 AND scan_status IN ('done', 'queued') AND EXISTS (SELECT 1 FROM v_article a WHERE a.magazine_id = m.id)""")
def _(v):
    return C.filter_magazines(v("v_magazine"), v("v_collection_tag"), v("v_article"), tag_id=2, year=1997, statuses=["done", "queued"], has_toc=True).select("id", "title")


@query("f1_unassigned", "SELECT id, title FROM v_magazine WHERE collection_id IS NULL AND issue_type = 'normal'")
def _(v):
    return C.filter_magazines(v("v_magazine"), unassigned=True, collection_id=3, issue_type="normal").select("id", "title")


@query("f2_count_magazines", "SELECT count(DISTINCT id) AS n FROM v_magazine WHERE collection_id = 3 AND scan_status IN ('done')")
def _(v):
    return C.count_magazines(v("v_magazine"), collection_id=3, statuses=["done"])


@query("f3_search_articles", """SELECT a.id AS article_id, a.title AS article, a.start_page, a.magazine_id, m.title AS magazine, CAST(m.publication_date AS STRING) AS publication_date, c.name AS collection
    FROM v_article a JOIN v_magazine m ON m.id = a.magazine_id LEFT JOIN v_collection c ON c.id = m.collection_id WHERE contains(lower(a.title), 'ring')
    ORDER BY a.title, m.publication_date DESC NULLS LAST, a.start_page, a.id LIMIT 50""")
def _(v):
    out = C.search_articles(v("v_article"), v("v_magazine"), v("v_collection"), "RING")
    return out.select("article_id", "article", "start_page", "magazine_id", "magazine", F.col("publication_date").cast("string").alias("publication_date"), "collection")


@query("f4_without_toc", "SELECT id, title FROM v_magazine m WHERE scan_status = 'done' AND NOT EXISTS (SELECT 1 FROM v_article a WHERE a.magazine_id = m.id)")
def _(v):
    return C.without_toc(v("v_magazine"), v("v_article")).select("id", "title")


@query("f6_articles_to_classify", """SELECT a.id, a.title, coalesce(c.name, 'sans collection') AS collection FROM v_article a JOIN v_magazine m ON m.id = a.magazine_id LEFT JOIN v_collection c ON c.id = m.collection_id
    WHERE NOT a.sent AND NOT EXISTS (SELECT 1 FROM v_link l WHERE l.article_id = a.id)""")
def _(v):
    return C.articles_to_classify(v("v_article"), v("v_link"), v("v_magazine"), v("v_collection"))


_DIRTY = "SELECT id, CASE WHEN id % 31 = 0 THEN '' ELSE title END AS title, CASE WHEN id % 29 = 0 THEN 0 ELSE start_page END AS start_page, CASE WHEN id % 7 = 0 THEN start_page - 2 + id % 5 ELSE end_page END AS end_page FROM v_article"


@query("f7_validate_articles", f"""SELECT id, CASE WHEN title IS NULL OR length(title) < 1 THEN 'title empty' WHEN length(title) > 500 THEN 'title too long' WHEN start_page IS NULL OR start_page < 1 THEN 'start below 1'
    WHEN end_page < 1 THEN 'end below 1' WHEN end_page < start_page THEN 'end before start' END AS reject_reason FROM ({_DIRTY})""")
def _(v):
    a = v("v_article")
    dirty = a.select(
        "id", F.when(F.col("id") % 31 == 0, "").otherwise(F.col("title")).alias("title"), F.when(F.col("id") % 29 == 0, 0).otherwise(F.col("start_page")).alias("start_page"),
        F.when(F.col("id") % 7 == 0, F.col("start_page") - 2 + F.col("id") % 5).otherwise(F.col("end_page")).alias("end_page"),
    )
    return C.validate_articles(dirty).select("id", "reject_reason")


@query("f8_restart_failed", """SELECT id, CASE scan_status WHEN 'failed' THEN 'queued' WHEN 'processing' THEN 'failed' ELSE scan_status END AS scan_status,
    CASE scan_status WHEN 'processing' THEN 'interrupted' WHEN 'failed' THEN NULL ELSE error_message END AS error_message FROM v_magazine""")
def _(v):
    return C.restart_failed(v("v_magazine")).select("id", "scan_status", "error_message")


_CLEAN = "left(regexp_replace(string_split(message, chr(10))[1], '/(?:[^/\\s]+/)+', '', 'g'), 300)"


@query("f9_sanitize_errors", f"SELECT id, {_CLEAN} AS clean FROM v_error")
def _(v):
    return v("v_error").select("id", X.sanitize_error(F.col("message")).alias("clean"))


@query("f9_error_census", f"""SELECT 'events' AS place, count(*) FILTER (message IS NOT NULL) AS filled, count(*) FILTER (message IS DISTINCT FROM {_CLEAN}) AS changed FROM v_error
    UNION ALL SELECT 'magazines', count(*) FILTER (message IS NOT NULL), count(*) FILTER (message IS DISTINCT FROM {_CLEAN}) FROM (SELECT error_message AS message FROM v_magazine)""")
def _(v):
    return C.error_census({"events": (v("v_error"), "message"), "magazines": (v("v_magazine"), "error_message")})


@query("f10_summarize_error_lines", """WITH raw AS (SELECT id, list_filter(list_transform(string_split(message, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM v_error),
    parts AS (SELECT id, l, list_slice(list_filter(l, lambda x: regexp_matches(x, '(?i)error|erreur|exception|unrecoverable|syntaxerror')), 1, 5) AS c, list_slice(l, greatest(len(l) - 4, 1), len(l)) AS t FROM raw)
    SELECT id, CASE WHEN len(l) = 0 THEN '(aucune sortie d''erreur)' ELSE array_to_string(list_slice(list_concat(c, list_filter(t, lambda x: NOT list_contains(c, x))), 1, 5), ' | ') END AS summary FROM parts""")
def _(v):
    return v("v_error").select("id", X.error_summary(F.col("message")).alias("summary"))


_NAMED = "SELECT m.*, c.name AS collection FROM v_magazine m LEFT JOIN v_collection c ON c.id = m.collection_id"


def _named(v):
    return v("v_magazine").join(v("v_collection").select(F.col("id").alias("collection_id"), F.col("name").alias("collection")), "collection_id", "left")


@query("f11_format_heading", f"SELECT id, CASE WHEN collection IS NULL THEN title ELSE concat_ws(' - ', collection, issue_number, nullif(concat_ws(' ', issue_month_label, CAST(year(publication_date) AS STRING)), '')) END AS heading FROM ({_NAMED})")
def _(v):
    return _named(v).select("id", X.heading(F.col("collection"), F.col("issue_number"), F.col("issue_month_label"), F.year("publication_date"), F.col("title")).alias("heading"))


@query("f12_article_reference", """SELECT id, coalesce(nullif(concat_ws(' · ', nullif(concat_ws(' ', issue_month_label, CAST(year(publication_date) AS STRING)), ''), CASE WHEN issue_number IS NOT NULL THEN 'n°' || issue_number END), ''), title) AS reference FROM v_magazine""")
def _(v):
    return v("v_magazine").select("id", X.reference(F.col("issue_number"), F.col("issue_month_label"), F.year("publication_date"), F.col("title")).alias("reference"))


@query("x1_norm", "SELECT id, replace(strip_accents(lower(title)), 'ß', 'ss') AS n FROM v_article UNION ALL SELECT magazine_id * 1000 + page_number, replace(strip_accents(lower(raw_text)), 'ß', 'ss') FROM v_page")
def _(v):
    pages = v("v_page").select((F.col("magazine_id") * 1000 + F.col("page_number")).alias("id"), F.col("raw_text").alias("title"))
    return v("v_article").select("id", "title").unionByName(pages).select("id", X.norm(F.col("title")).alias("n"))


@query("x2_keyword_pattern", r"""SELECT id, k, CASE WHEN len(w) > 0 THEN '(?U)\b' || array_to_string(list_transform(w, lambda x: x || '[sx]?'), '\s+') || '\b' END AS pattern
    FROM (SELECT id, k, list_filter(string_split_regex(strip_accents(lower(k)), '\s+'), lambda x: x <> '') AS w FROM (SELECT id, unnest(keywords) AS k FROM v_subtheme UNION ALL SELECT id, title FROM v_article))""")
def _(v):
    words = v("v_subtheme").select("id", F.explode("keywords").alias("k")).unionByName(v("v_article").select("id", F.col("title").alias("k")))
    return words.select("id", "k", X.keyword_pattern(F.col("k")).alias("pattern"))


@query("x3_parse_issue_metadata", """SELECT id, CASE WHEN id % 6 = 0 OR true THEN CAST(100 + id % 800 AS STRING) END AS issue_number, CASE WHEN id % 6 <> 5 THEN CAST(1990 + id % 30 AS INT) END AS year,
    CASE WHEN id % 6 < 4 THEN CAST(1 + id % 12 AS INT) END AS month, CASE WHEN id % 6 IN (0, 2, 3) THEN issue_month_label WHEN id % 6 = 1 THEN CASE WHEN issue_month_label = 'Avril' THEN 'Avril' ELSE issue_month_label || '-Avril' END END AS label FROM v_magazine""")
def _(v):
    m = X.issue_metadata(F.col("title"), F.regexp_extract("file_path", "^([^/]+)/", 1))
    return v("v_magazine").select("id", m.alias("m")).select("id", "m.issue_number", "m.year", "m.month", "m.label")


@query("x4_cover_fallback", r"""SELECT m.id, coalesce(CAST(m.publication_date AS STRING), CAST(make_date(CAST(nullif(regexp_extract(p.raw_text || ' ' || CAST(1900 + m.id % 120 AS STRING), '\b((?:19|20)\d{2})\b', 1), '') AS INT), 1, 1) AS STRING)) AS publication_date,
    coalesce(m.issue_number, nullif(regexp_extract(p.raw_text || ' N° ' || CAST(m.id % 500 AS STRING), '(?i)n[°ºo]\s*[:\s]?\s*(\d{1,4})', 1), '')) AS issue_number
    FROM v_magazine m LEFT JOIN v_page p ON p.magazine_id = m.id AND p.page_number = 1""")
def _(v):
    first = v("v_page").filter("page_number = 1").select(F.col("magazine_id").alias("id"), "raw_text")
    rows = v("v_magazine").join(first.hint("merge"), "id", "left")
    year = X.cover_year(F.concat("raw_text", F.lit(" "), (1900 + F.col("id") % 120).cast("string")))
    number = X.cover_number(F.concat("raw_text", F.lit(" N° "), (F.col("id") % 500).cast("string")))
    return rows.select("id", F.coalesce(F.col("publication_date").cast("string"), F.make_date(year, F.lit(1), F.lit(1)).cast("string")).alias("publication_date"), F.coalesce("issue_number", number).alias("issue_number"))


@query("x5_issue_type", "SELECT id, CASE id % 11 WHEN 0 THEN 'hs' ELSE CASE WHEN id % 11 = 1 THEN 'sp' ELSE 'normal' END END AS kind FROM v_magazine")
def _(v):
    return v("v_magazine").select("id", X.issue_type(F.col("title")).alias("kind"))


@query("x6_clean_title", """SELECT id, CASE WHEN id % 4 = 0 THEN CASE WHEN length(t) < 15 THEN '' ELSE t END ELSE raw END AS clean FROM (SELECT id, title || ' special issue' AS t0, CASE WHEN id % 3 = 0 THEN title ELSE title || ' special issue' END AS t,
    CASE WHEN id % 3 = 0 THEN title ELSE title || ' special issue' END AS raw FROM v_article)""")
def _(v):
    t = F.when(F.col("id") % 3 == 0, F.col("title")).otherwise(F.concat("title", F.lit(" special issue")))
    raw = F.when(F.col("id") % 4 == 0, F.concat(t, F.lit(" - couv_B35.indd"))).otherwise(t)
    return v("v_article").select("id", X.clean_title(raw).alias("clean"))


@query("x7_estimate_tokens", "SELECT id, CAST(ceil(length(title) / 4.0) AS BIGINT) AS tokens FROM v_article")
def _(v):
    return v("v_article").select("id", X.estimate_tokens(F.col("title")).alias("tokens"))


@query("x8_highlight", """SELECT magazine_id, page_number, regexp_replace(replace(replace(replace(replace(raw_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '(?i)(the|c\\+\\+)', '<mark>\\1</mark>', 'g') AS marked FROM v_page""")
def _(v):
    return v("v_page").select("magazine_id", "page_number", X.highlight(F.col("raw_text"), ["the", "c++"]).alias("marked"))


@query("x9_snippet", """WITH w AS (SELECT magazine_id, page_number, list_filter(string_split_regex(raw_text, '\\s+'), lambda x: x <> '') AS w FROM v_page), a AS (SELECT *, list_position(list_transform(w, lambda x: contains(strip_accents(lower(x)), 'tion')), true) AS spot FROM w)
    SELECT magazine_id, page_number, array_to_string(CASE WHEN coalesce(spot, 0) > 0 THEN w[greatest(1, spot - 20) : greatest(1, spot - 20) + 39] ELSE w[1:40] END, ' ') AS snippet FROM a""")
def _(v):
    return v("v_page").select("magazine_id", "page_number", X.snippet(F.col("raw_text"), "tion").alias("snippet"))


@query("x9_snippet_accents", """WITH w AS (SELECT magazine_id, page_number, list_filter(string_split_regex(raw_text, '\\s+'), lambda x: x <> '') AS w FROM v_page), a AS (SELECT *, list_position(list_transform(w, lambda x: contains(strip_accents(lower(x)), 'fur') OR contains(strip_accents(lower(x)), 'etre')), true) AS spot FROM w)
    SELECT magazine_id, page_number, array_to_string(CASE WHEN coalesce(spot, 0) > 0 THEN w[greatest(1, spot - 20) : greatest(1, spot - 20) + 39] ELSE w[1:40] END, ' ') AS snippet FROM a""")
def _(v):
    return v("v_page").select("magazine_id", "page_number", X.snippet(F.col("raw_text"), ["FÜR", "être"]).alias("snippet"))


@query("x10_occurrence_scale", "SELECT magazine_id, n / max(n) OVER () AS scale FROM (SELECT magazine_id, CAST(count(*) AS DOUBLE) AS n FROM v_page GROUP BY 1)")
def _(v):
    n = v("v_page").groupBy("magazine_id").agg(F.count("*").cast("double").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.withColumn("k", F.lit(1)).join(F.broadcast(most.withColumn("k", F.lit(1))), "k").select("magazine_id", X.occurrence_scale(F.col("n"), F.col("most")).alias("scale"))  # one row


_COUNTED = "LEFT JOIN (SELECT magazine_id, count(*) AS pc FROM v_page GROUP BY 1) p ON p.magazine_id = m.id LEFT JOIN (SELECT magazine_id, count(*) AS ac FROM v_article GROUP BY 1) a ON a.magazine_id = m.id"


@query("a1_list_magazines", f"SELECT m.id AS magazine_id, m.title, coalesce(pc, 0) AS page_count, coalesce(ac, 0) AS article_count FROM v_magazine m {_COUNTED} ORDER BY m.publication_date DESC NULLS LAST, m.title, m.id LIMIT 50 OFFSET 50")
def _(v):
    return C.list_magazines(v("v_magazine"), v("v_page"), v("v_article"), page=2).select("magazine_id", "title", "page_count", "article_count")


@query("a2_facets", """SELECT CAST(year(publication_date) AS STRING) AS facet, count(*) AS n FROM v_magazine WHERE publication_date IS NOT NULL GROUP BY 1
    UNION ALL SELECT issue_type, count(*) FROM v_magazine WHERE issue_type IN ('hs', 'sp') GROUP BY 1""")
def _(v):
    return C.facets(v("v_magazine"))


@query("a3_library_overview", """WITH s AS (SELECT collection_id, count(*) AS n, max_by(cover, publication_date IS NOT NULL || '|' || coalesce(CAST(publication_date AS STRING), '') || '|' || lpad(CAST(created_s AS STRING), 15, '0')) FILTER (cover IS NOT NULL) AS cover FROM v_magazine GROUP BY 1),
    t AS (SELECT collection_id, string_agg(t.name, ',' ORDER BY t.name) AS tags FROM v_collection_tag ct JOIN v_tag t ON t.id = ct.tag_id GROUP BY 1)
    SELECT c.id AS collection_id, c.name, coalesce(s.n, 0) AS n, s.cover, coalesce(t.tags, '') AS tags FROM v_collection c LEFT JOIN s ON s.collection_id = c.id LEFT JOIN t ON t.collection_id = c.id
    UNION ALL SELECT NULL, NULL, n, cover, '' FROM s WHERE collection_id IS NULL""")
def _(v):
    return C.library_overview(v("v_collection"), v("v_magazine"), v("v_collection_tag"), v("v_tag"))


@query("a4_taxonomy_level1", """SELECT t.id AS theme_id, t.name AS theme, count(DISTINCT s.id) AS subthemes, count(DISTINCT l.article_id) AS articles
    FROM v_link l JOIN v_subtheme s ON s.id = l.subtheme_id JOIN v_theme t ON t.id = s.theme_id GROUP BY 1, 2""")
def _(v):
    return C.taxonomy_level1(v("v_theme"), v("v_subtheme"), v("v_link"))


@query("a5_taxonomy_level2", "SELECT s.id, s.name, count(l.article_id) AS n FROM v_subtheme s LEFT JOIN v_link l ON l.subtheme_id = s.id WHERE s.theme_id = 2 OR s.theme_id = 99 GROUP BY 1, 2")
def _(v):
    return C.taxonomy_level2(v("v_subtheme"), v("v_link"), 2)


@query("a6_taxonomy_level3", """WITH r AS (SELECT coalesce(c.name, 'Sans collection') AS collection, a.id AS article_id, a.title, m.title AS magazine, a.start_page, m.publication_date FROM v_link l JOIN v_article a ON a.id = l.article_id
    JOIN v_magazine m ON m.id = a.magazine_id LEFT JOIN v_collection c ON c.id = m.collection_id WHERE l.subtheme_id = 20)
    SELECT collection, count(*) OVER (PARTITION BY collection) AS group_size, row_number() OVER (PARTITION BY collection ORDER BY publication_date DESC NULLS LAST, magazine, start_page, article_id) AS position, article_id, title, magazine, start_page FROM r""")
def _(v):
    return C.taxonomy_level3(v("v_link"), v("v_article"), v("v_magazine"), v("v_collection"), 20)


@query("a7_dashboard_stats", """SELECT total, done, processing, failed, pending, articles, covered, new_users, CASE WHEN articles > 0 THEN round(100 * covered / articles, 1) ELSE 0.0 END AS coverage FROM
    (SELECT count(*) AS total, count(*) FILTER (scan_status = 'done') AS done, count(*) FILTER (scan_status = 'processing') AS processing, count(*) FILTER (scan_status = 'failed') AS failed, count(*) FILTER (scan_status IN ('detected', 'stable', 'queued')) AS pending FROM v_magazine),
    (SELECT count(*) AS articles FROM v_article), (SELECT count(DISTINCT article_id) AS covered FROM v_link), (SELECT count(*) FILTER (days_ago <= 7) AS new_users FROM v_user)""")
def _(v):
    return C.dashboard_stats(v("v_magazine"), v("v_article"), v("v_link"), v("v_user"))


@query("a7_recently_updated", f"SELECT m.id AS magazine_id, m.title, coalesce(pc, 0) AS page_count, coalesce(ac, 0) AS article_count FROM v_magazine m {_COUNTED} ORDER BY m.updated_s DESC, m.title, m.id LIMIT 10")
def _(v):
    return C.recently_updated(v("v_magazine"), v("v_page"), v("v_article")).select("magazine_id", "title", "page_count", "article_count")


@query("a8_collection_subthemes", """SELECT l.subtheme_id, s.name, count(DISTINCT l.article_id) AS articles FROM v_link l JOIN v_article a ON a.id = l.article_id JOIN v_magazine m ON m.id = a.magazine_id
    JOIN v_subtheme s ON s.id = l.subtheme_id WHERE m.collection_id = 5 GROUP BY 1, 2""")
def _(v):
    return C.collection_subthemes(v("v_link"), v("v_article"), v("v_magazine"), v("v_subtheme"), 5).select("subtheme_id", "name", "articles")


@query("a9_batch_status", """SELECT count(*) AS n, count(*) FILTER (scan_status IN ('detected', 'stable', 'queued')) AS detected, count(*) FILTER (scan_status = 'processing') AS processing, count(*) FILTER (scan_status = 'done') AS done,
    count(*) FILTER (scan_status = 'failed') AS failed, count(*) FILTER (scan_status IN ('done', 'failed')) = count(*) AS finished FROM v_magazine WHERE id IN (SELECT id FROM v_scan)""")
def _(v):
    return C.batch_status(v("v_magazine"), v("v_scan").select("id"))


_RUNS = "SELECT CAST(floor(epoch(max(ts))) AS BIGINT) AS finished_s, max_by(event_type, ts) <> 'error' AS succeeded FROM events GROUP BY CAST(ts AS DATE)"


@query("a10_backup_health", f"""SELECT last_run, last_ok, last_success, CASE WHEN last_run IS NULL THEN NULL WHEN NOT last_ok THEN 'last run failed' WHEN last_success IS NULL OR 1706745600 - last_success > 129600 THEN 'no recent success' END AS alert FROM
    (SELECT max(finished_s) AS last_run, max_by(succeeded, finished_s) AS last_ok, max(finished_s) FILTER (succeeded) AS last_success FROM ({_RUNS}))""")
def _(v):
    e = v.table("events")
    runs = e.groupBy(F.to_date("ts")).agg(F.unix_seconds(F.max("ts").cast("timestamp")).alias("finished_s"), (F.max_by("event_type", "ts") != "error").alias("succeeded"))
    return C.backup_health(runs, F.lit(1706745600))


@query("a11_list_dimension", "SELECT id, name FROM v_collection ORDER BY name, id LIMIT 10 OFFSET 10")
def _(v):
    return C.list_dimension(v("v_collection"), ["name", "id"], page=2, limit=10)


@query("a11_magazine_articles", "SELECT magazine_id, id, title, start_page, row_number() OVER (PARTITION BY magazine_id ORDER BY start_page, id) AS position FROM v_article")
def _(v):
    from pyspark.sql import Window

    w = Window.partitionBy("magazine_id").orderBy("start_page", "id")
    return v("v_article").select("magazine_id", "id", "title", "start_page", F.row_number().over(w).alias("position"))


@query("a12_group_by_issue_type", """SELECT CASE issue_type WHEN 'normal' THEN 0 WHEN 'hs' THEN 1 ELSE 2 END AS group_rank, issue_type, row_number() OVER (PARTITION BY issue_type ORDER BY publication_date DESC NULLS LAST, id) AS position, id, title
    FROM v_magazine WHERE collection_id = 4""")
def _(v):
    return C.group_by_issue_type(v("v_magazine"), 4)


def _wanted(v, *ids):
    return v("v_tag").filter("id <= 2").select(F.element_at(F.array(*map(F.lit, ids)), F.col("id")).alias("tag_id"))


@query("a13_set_collection_tags", "SELECT collection_id, tag_id FROM v_collection_tag WHERE collection_id <> 3 UNION ALL SELECT 3, id FROM v_tag WHERE id IN (1, 4)")
def _(v):
    return C.set_collection_tags(v("v_collection_tag"), v("v_tag"), v("v_magazine"), 3, _wanted(v, 1, 4))[0]


@query("a13_unknown_tags", "SELECT 'bridge' AS what, collection_id AS id, tag_id FROM v_collection_tag UNION ALL SELECT 'unknown', NULL, 99")
def _(v):
    bridge, unknown, refresh = C.set_collection_tags(v("v_collection_tag"), v("v_tag"), v("v_magazine"), 3, _wanted(v, 1, 99))
    none = F.lit(None).cast("int")
    rows = bridge.select(F.lit("bridge").alias("what"), F.col("collection_id").alias("id"), "tag_id").unionByName(unknown.select(F.lit("unknown").alias("what"), none.alias("id"), "tag_id"))
    return rows.unionByName(refresh.select(F.lit("refresh").alias("what"), F.col("magazine_id").cast("int").alias("id"), none.alias("tag_id")))


@query("a13_magazines_to_refresh", "SELECT id AS magazine_id FROM v_magazine WHERE collection_id = 3")
def _(v):
    return C.set_collection_tags(v("v_collection_tag"), v("v_tag"), v("v_magazine"), 3, _wanted(v, 1, 4))[2]


@query("a14_cascade_delete", """SELECT 'magazines' AS what, count(*) AS n FROM v_magazine WHERE id % 10 <> 0 UNION ALL SELECT 'pages', count(*) FROM v_page WHERE magazine_id % 10 <> 0 UNION ALL SELECT 'articles', count(*) FROM v_article WHERE magazine_id % 10 <> 0
    UNION ALL SELECT 'links', count(*) FROM v_link WHERE article_id NOT IN (SELECT id FROM v_article WHERE magazine_id % 10 = 0)""")
def _(v):
    left = C.cascade_delete(v("v_magazine"), v("v_page"), v("v_article"), v("v_link"), v("v_magazine").filter("id % 10 = 0").select("id"))
    counts = [df.agg(F.lit(n).alias("what"), F.count("*").alias("n")) for n, df in zip(("magazines", "pages", "articles", "links"), left, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("a14_drop_collection", "SELECT id, CASE WHEN collection_id IN (2, 5) THEN NULL ELSE collection_id END AS collection_id FROM v_magazine")
def _(v):
    return C.drop_collection(v("v_magazine"), v("v_collection").filter("id IN (2, 5)").select(F.col("id").alias("collection_id"))).select("id", "collection_id")


@query("a15_backfill", "SELECT id, issue_type, id IN (SELECT magazine_id FROM v_article WHERE id IN (SELECT article_id FROM v_link)) AS themed FROM v_magazine")
def _(v):
    return C.backfill(v("v_magazine"), v("v_article"), v("v_link")).select("id", "issue_type", "themed")


@query("a15_first_tags", "SELECT collection_id, min(tag_id) AS tag_id FROM v_collection_tag GROUP BY 1")
def _(v):
    return C.first_tags(v("v_collection_tag"))


@query("a16_classification_status", """SELECT (SELECT count(*) FROM v_article WHERE NOT sent AND id NOT IN (SELECT article_id FROM v_link)) AS pending,
    (SELECT count(*) FROM v_request WHERE CAST(ts - INTERVAL 8 HOUR AS DATE) = DATE '2024-01-15') AS today, 18 AS allowed, (SELECT max_by(event_type, ts) FROM events WHERE ts > TIMESTAMP '2024-01-15 20:00:00') AS paused, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events WHERE ts > TIMESTAMP '2024-01-15 20:00:00') AS until""")
def _(v):
    pauses = v.table("events").select(F.col("event_type").alias("reason"), F.col("ts").cast("timestamp").alias("until"))
    now = F.lit("2024-01-15 20:00:00").cast("timestamp")
    out = C.classification_status(v("v_article"), v("v_link"), v("v_request").withColumn("ts", F.col("ts").cast("timestamp")), pauses, now, 20)
    return out.withColumn("until", F.date_format("until", "yyyy-MM-dd HH:mm:ss"))


@query("a16_run_figures", """SELECT (SELECT count(DISTINCT article_id) FROM v_link WHERE article_id % 20 = 0 AND article_id IN (SELECT id FROM v_article WHERE id % 10 = 0)) AS attached, (SELECT count(*) FROM v_subtheme WHERE id >= 100) AS created,
    (SELECT count(*) FROM v_article WHERE NOT sent AND id % 10 <> 0 AND id NOT IN (SELECT article_id FROM v_link)) AS remaining""")
def _(v):
    links = v("v_link")
    batch = v("v_article").filter("id % 10 = 0").select(F.col("id").alias("article_id"))
    return C.run_figures(batch, links.filter("article_id % 20 = 0"), v("v_subtheme").filter("id >= 100"), v("v_article"), links.filter("article_id % 20 <> 0"))


@query("a12_articles_by_magazine", "SELECT id, magazine_id, min(id) OVER (PARTITION BY magazine_id) AS group_rank, row_number() OVER (PARTITION BY magazine_id ORDER BY id) AS position FROM v_article")
def _(v):
    return C.articles_by_magazine(v("v_article").select("id", "magazine_id"), "id").select("id", "magazine_id", "group_rank", "position")
