"""Registered queries: page quality and tables of contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as D
from ..operators import toc as T
from ..sources.stored import stored
from .registry import query

_WORDS = ", ".join(f"'{w}'" for w in D.COMMON_WORDS)
_NATIVE = "SELECT magazine_id, bool_and(length(regexp_replace(coalesce(raw_text, ''), '^\\s+|\\s+$', '', 'g')) >= 20) AS native FROM v_page GROUP BY 1"
_GARBLED = f"""SELECT magazine_id, count(*) FILTER (n >= 15) AS judged, count(*) FILTER (n >= 15 AND hits / n < 0.1) AS garbled_pages,
    count(*) FILTER (n >= 15 AND hits / n < 0.1) >= 3 AND count(*) FILTER (n >= 15 AND hits / n < 0.1) >= 0.05 * count(*) FILTER (n >= 15) AS garbled
    FROM (SELECT magazine_id, CAST(len(t) AS DOUBLE) AS n, len(list_filter(t, lambda x: x IN ({_WORDS}))) AS hits FROM (SELECT magazine_id, regexp_extract_all(lower(raw_text), '[a-zà-öø-ÿ]{{2,}}') AS t FROM v_page)) GROUP BY 1"""


@query("d1_has_native_text", _NATIVE)
def _(v):
    return D.has_native_text(v("v_page"))


@query("d2_garbled_documents", _GARBLED)
def _(v):
    return D.garbled_documents(v("v_page"))


@query("d3_ocr_decision", f"SELECT magazine_id, CASE WHEN garbled THEN 'force-ocr' WHEN native THEN 'copy' ELSE 'skip-text' END AS decision FROM ({_NATIVE}) JOIN ({_GARBLED}) USING (magazine_id)")
def _(v):
    return D.ocr_decision(v("v_page"))


_SCORES = ", ".join("{'s': CAST(len(list_filter(t, lambda x: x IN (" + ", ".join(f"'{w}'" for w in ws) + f"))) AS INT), 'l': '{lang}'}}" for lang, ws in D.PROFILES.items())


@query("d4_page_language", f"""WITH c AS (SELECT magazine_id, page_number, length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')) < 20 AS short, list_reverse_sort([{_SCORES}]) AS s FROM (SELECT *, regexp_extract_all(lower(raw_text), '\\pL+') AS t FROM v_page)),
    r AS (SELECT *, greatest(list_sum(list_transform(s, lambda x: x.s)), 1) AS total FROM c)
    SELECT magazine_id, page_number, CASE WHEN short OR s[1].s = 0 THEN NULL WHEN s[1].l NOT IN ('fr', 'en') OR (s[2].l IN ('fr', 'en') AND s[2].s / total > 0.3) THEN 'mixed' ELSE s[1].l END AS language FROM r""")
def _(v):
    return D.page_language(v("v_page"))


_TEMPLATES = "SELECT magazine_id, lower(regexp_replace(line, '[0-9]+', '#', 'g')) AS template, count(DISTINCT page_number) AS pages FROM v_toc_line WHERE line <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 3"


@query("d5_repeated_lines", _TEMPLATES)
def _(v):
    return D.repeated_lines(v("v_toc_line"))


@query("d5_repeated_page_lines", """SELECT magazine_id, lower(regexp_replace(line, '[0-9]+', '#', 'g')) AS template, count(DISTINCT page_number) AS pages
    FROM (SELECT magazine_id, page_number, regexp_replace(unnest(string_split(raw_text, chr(10))), '^\\s+|\\s+$', '', 'g') AS line FROM v_page) WHERE line <> '' GROUP BY 1, 2 HAVING count(DISTINCT page_number) >= 3""")
def _(v):
    return D.repeated_lines(D.page_lines(v("v_page")))


@query("d6_reading_order_columns", """WITH p AS (SELECT *, row_number() OVER l AS pos, lead(x0) OVER l - x1 AS gap FROM v_word WINDOW l AS (PARTITION BY magazine_id, page_number, block, line ORDER BY x0, n)),
    c AS (SELECT *, max(gap) OVER g AS widest, min(y0) OVER g AS top, (min(x0) OVER g + max_by(x1, pos) OVER g) / 2 AS middle FROM p WINDOW g AS (PARTITION BY magazine_id, page_number, block, line)),
    d AS (SELECT *, max(CASE WHEN gap = widest THEN pos END) OVER (PARTITION BY magazine_id, page_number, block, line) AS cut FROM c),
    s AS (SELECT *, CASE WHEN coalesce(widest >= 60, false) THEN CASE WHEN pos <= cut THEN 0 ELSE 1 END WHEN middle < 300 THEN 0 ELSE 1 END AS side FROM d)
    SELECT magazine_id, page_number, side, top, block, line, string_agg(text, ' ' ORDER BY pos) AS line_text FROM s GROUP BY ALL""")
def _(v):
    return D.reading_order_columns(v("v_word"))


_BLOCKS = "SELECT magazine_id, page_number, block, min(y0) + block % 3 AS y0, max(y1) + 12 * (block % 2) AS y1, 600 - min(x0) - 5 * block AS x0 FROM v_word GROUP BY 1, 2, 3"


@query("d7_reading_order_rows", f"""WITH b AS ({_BLOCKS}), g AS (SELECT *, CASE WHEN y0 < max(y1) OVER (PARTITION BY magazine_id, page_number ORDER BY y0, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM b),
    h AS (SELECT *, CAST(sum(new) OVER (PARTITION BY magazine_id, page_number ORDER BY y0, block ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM g)
    SELECT magazine_id, page_number, block, band, row_number() OVER (PARTITION BY magazine_id, page_number, band ORDER BY x0, y0, block) AS position FROM h""")
def _(v):
    blocks = v("v_word").groupBy("magazine_id", "page_number", "block").agg(
        (F.min("y0") + F.col("block") % 3).alias("y0"), (F.max("y1") + 12 * (F.col("block") % 2)).alias("y1"), (600 - F.min("x0") - 5 * F.col("block")).alias("x0")
    )
    return D.reading_order_rows(blocks).select("magazine_id", "page_number", "block", "band", "position")


_TRAILING = "(?i)^(.+?)(?:[.·…\\s]{3,})(?:p\\.?\\s*)?([0-9]{1,4})(?:\\s*[-–]\\s*([0-9]{1,4}))?\\s*$"
_LEADING = "^([0-9]{1,3})(?:\\s+|\\s*[/|·–—-]\\s*)([A-ZÀ-Ý].{1,})$"
_KINDS = f"""tpl AS ({_TEMPLATES}), kinds AS (SELECT magazine_id, page_number, line_no, line, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '{_TRAILING}') THEN 'trailing' WHEN regexp_matches(line, '{_LEADING}') THEN 'leading'
    WHEN regexp_matches(line, '^[0-9]{{1,3}}$') THEN 'bare' WHEN len(list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '')) <= 4 AND regexp_matches(line, '^[A-ZÀ-Ý0-9][A-ZÀ-Ý0-9 ?!''’.-]{{0,30}}$') AND regexp_matches(line, '\\pL') THEN 'label' ELSE 'text' END AS kind
    FROM (SELECT l.magazine_id, l.page_number, l.line_no, CASE WHEN t.template IS NULL THEN l.line ELSE '' END AS line FROM v_toc_line l LEFT JOIN tpl t ON t.magazine_id = l.magazine_id AND t.template = lower(regexp_replace(l.line, '[0-9]+', '#', 'g'))))"""
_HEADING = "regexp_matches(line, '^\\p{Lu}') AND length(line) <= 30 AND regexp_matches(lower(line), '^(?:sommaire|contents|content|summary|table of contents|index)(?:[^\\pL]|$)')"
_DENSITY = "dens AS (SELECT magazine_id, page_number, count(*) FILTER (kind IN ('trailing', 'leading', 'bare')) AS entries, count(*) FILTER (kind = 'bare') AS bare FROM kinds GROUP BY 1, 2)"
_CHOSEN = """chosen AS (SELECT magazine_id, page_number FROM (SELECT *, min(tier) OVER (PARTITION BY magazine_id) AS least FROM tier) WHERE tier = least),
    tocp AS (SELECT magazine_id, page_number FROM chosen UNION SELECT d.magazine_id, d.page_number FROM dens d JOIN chosen c ON c.magazine_id = d.magazine_id AND d.page_number = c.page_number + 1 WHERE d.entries >= 3)"""
_PAGES = f"""{_DENSITY},
    tier AS (SELECT DISTINCT magazine_id, page_number, 1 AS tier FROM kinds WHERE page_number <= 30 AND {_HEADING} UNION ALL SELECT magazine_id, page_number, 3 FROM (SELECT *, row_number() OVER (PARTITION BY magazine_id ORDER BY entries DESC, page_number) AS r FROM dens WHERE page_number <= 8 AND entries >= 4) WHERE r = 1),
    {_CHOSEN}"""
_ENTRIES = f"""s1 AS (SELECT *, sum(CASE WHEN kind IN ('blank', 'trailing', 'label', 'leading') THEN 1 ELSE 0 END) OVER w AS seg, sum(CASE WHEN kind <> 'text' THEN 1 ELSE 0 END) OVER w AS ent FROM kinds WINDOW w AS (PARTITION BY magazine_id, page_number ORDER BY line_no)),
    s2 AS (SELECT *, lag(kind) OVER (PARTITION BY magazine_id, page_number, seg ORDER BY line_no) AS prev FROM s1),
    s3 AS (SELECT *, min(CASE WHEN kind = 'bare' AND (prev IS NULL OR prev <> 'text') THEN line_no END) OVER g AS sw, bool_or(kind = 'leading') OVER g AS lead FROM s2 WINDOW g AS (PARTITION BY magazine_id, page_number, seg)),
    gr AS (SELECT magazine_id, page_number, ent, min(line_no) FILTER (kind <> 'text') AS line_no, max(kind) FILTER (kind <> 'text') AS kind, max(line) FILTER (kind <> 'text') AS line, bool_or(lead OR coalesce(line_no >= sw, false)) FILTER (kind <> 'text') AS mode,
      coalesce(list(line ORDER BY line_no) FILTER (kind = 'text'), []) AS texts FROM s3 GROUP BY 1, 2, 3),
    g2 AS (SELECT *, lag(texts) OVER w AS b, coalesce(lag(mode) OVER w, false) AS bm FROM gr WINDOW w AS (PARTITION BY magazine_id, page_number ORDER BY ent)),
    g3 AS (SELECT *, CASE WHEN bm OR b IS NULL THEN [] ELSE b[-3:] END AS p, CASE kind WHEN 'leading' THEN trim(regexp_extract(line, '{_LEADING}', 2)) WHEN 'trailing' THEN regexp_replace(regexp_extract(line, '{_TRAILING}', 1), '^[ .·…]+|[ .·…]+$', '', 'g') END AS own FROM g2 WHERE kind IN ('leading', 'bare', 'trailing')),
    ent AS (SELECT magazine_id, page_number, line_no, trim(array_to_string(CASE WHEN kind = 'leading' THEN list_concat([own], texts)[-3:] WHEN kind = 'bare' AND mode THEN texts[-3:] WHEN kind = 'bare' THEN p ELSE list_concat(p, [own]) END, ' ')) AS title,
      CAST(CASE kind WHEN 'leading' THEN regexp_extract(line, '{_LEADING}', 1) WHEN 'bare' THEN line ELSE regexp_extract(line, '{_TRAILING}', 2) END AS INT) AS start_page,
      CASE WHEN kind = 'trailing' THEN CAST(nullif(regexp_extract(line, '{_TRAILING}', 3), '') AS INT) END AS end_page FROM g3)"""
_ON_PAGES = "onp AS (SELECT e.* FROM ent e JOIN tocp t USING (magazine_id, page_number) WHERE title <> ''), pl AS (SELECT o.*, l.last_page FROM onp o JOIN (SELECT magazine_id, max(page_number) * 5 AS last_page FROM v_toc_line GROUP BY 1) l USING (magazine_id) WHERE start_page > 0 AND start_page <= last_page)"


def _on_pages(v):
    lines = stored(v("v_toc_line"), "lines")
    classified = stored(T.classify_lines(lines), "classified")
    found = stored(T.find_toc_pages(lines, False, classified), "found")
    entries = T.parse_entries(classified.join(found.hint("merge"), ["magazine_id", "page_number"], "left_semi"))
    return lines, found, T.plausible_entries(entries, lines.withColumn("page_number", F.col("page_number") * 5))


@query("t1_classify_lines", f"WITH {_KINDS} SELECT magazine_id, page_number, line_no, kind FROM kinds")
def _(v):
    return T.classify_lines(v("v_toc_line")).select("magazine_id", "page_number", "line_no", "kind")


@query("t2_is_heading", f"SELECT magazine_id, page_number, line_no, {_HEADING} AS heading FROM v_toc_line")
def _(v):
    return v("v_toc_line").select("magazine_id", "page_number", "line_no", T.is_heading(F.col("line")).alias("heading"))


@query("t3_is_heading_fuzzy", "SELECT DISTINCT magazine_id, page_number, line_no FROM v_toc_line WHERE line = 'SOMMAIRE'")
def _(v):
    spoilt = F.when(F.col("line") == "SOMMAIRE", "cm/contenis").otherwise(F.col("line"))
    return T.fuzzy_headings(v("v_toc_line").withColumn("line", spoilt))


@query("t4_entry_density", f"WITH {_KINDS}, {_PAGES} SELECT * FROM dens")
def _(v):
    return T.entry_density(T.classify_lines(v("v_toc_line")))


@query("t5_find_toc_pages", f"WITH {_KINDS}, {_PAGES} SELECT magazine_id, page_number FROM tocp")
def _(v):
    return T.find_toc_pages(v("v_toc_line"), fuzzy=False)


@query("t5_find_toc_pages_fuzzy", f"""WITH {_KINDS}, {_DENSITY}, early AS (SELECT magazine_id, page_number FROM v_toc_line WHERE page_number <= 8 AND regexp_matches(line, '^[0-9]{{1,3}}$') GROUP BY 1, 2 HAVING count(*) >= 3),
    near AS (SELECT magazine_id, min(page_number) AS page_number FROM early JOIN (SELECT DISTINCT magazine_id, page_number FROM v_toc_line WHERE line = 'SOMMAIRE') USING (magazine_id, page_number) GROUP BY 1),
    tier AS (SELECT magazine_id, page_number, 2 AS tier FROM near UNION ALL SELECT magazine_id, page_number, 3 FROM (SELECT *, row_number() OVER (PARTITION BY magazine_id ORDER BY entries DESC, page_number) AS r FROM dens WHERE page_number <= 8 AND entries >= 4) WHERE r = 1), {_CHOSEN}
    SELECT magazine_id, page_number FROM tocp""")
def _(v):
    spoilt = F.when(F.col("line") == "SOMMAIRE", "cm/contenis").otherwise(F.col("line"))
    return T.find_toc_pages(v("v_toc_line").withColumn("line", spoilt))


@query("t6_parse_entries", f"WITH {_KINDS}, {_ENTRIES} SELECT * FROM ent WHERE title <> ''")
def _(v):
    return T.parse_entries(T.classify_lines(v("v_toc_line")))


@query("t7_plausible_entries", f"WITH {_KINDS}, {_PAGES}, {_ENTRIES}, {_ON_PAGES} SELECT * FROM pl")
def _(v):
    return _on_pages(v)[2]


_READ = """w AS (SELECT v_toc_word.* FROM v_toc_word JOIN tocp USING (magazine_id, page_number)),
    l0 AS (SELECT magazine_id, page_number, block, line, min(n) AS first, string_agg(text, ' ' ORDER BY n) AS text FROM w GROUP BY ALL),
    p1 AS (SELECT *, row_number() OVER l AS pos, lead(x0) OVER l - x1 AS gap FROM w WINDOW l AS (PARTITION BY magazine_id, page_number, block, line ORDER BY x0, n)),
    c1 AS (SELECT *, max(gap) OVER g AS widest, min(y0) OVER g AS top, (min(x0) OVER g + max_by(x1, pos) OVER g) / 2 AS middle FROM p1 WINDOW g AS (PARTITION BY magazine_id, page_number, block, line)),
    d1 AS (SELECT *, max(CASE WHEN gap = widest THEN pos END) OVER (PARTITION BY magazine_id, page_number, block, line) AS cut FROM c1),
    l1 AS (SELECT magazine_id, page_number, side, top, block, line, string_agg(text, ' ' ORDER BY pos) AS text FROM (SELECT *, CASE WHEN coalesce(widest >= 60, false) THEN CASE WHEN pos <= cut THEN 0 ELSE 1 END WHEN middle < 300 THEN 0 ELSE 1 END AS side FROM d1) GROUP BY ALL),
    b2 AS (SELECT magazine_id, page_number, block, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0 FROM w GROUP BY ALL),
    g2_ AS (SELECT *, CASE WHEN y0 < max(y1) OVER (PARTITION BY magazine_id, page_number ORDER BY y0, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM b2),
    h2 AS (SELECT *, sum(new) OVER (PARTITION BY magazine_id, page_number ORDER BY y0, block ROWS UNBOUNDED PRECEDING) AS band FROM g2_),
    rd AS (SELECT magazine_id * 3 AS magazine_id, page_number, row_number() OVER (PARTITION BY magazine_id, page_number ORDER BY first) AS line_no, text AS line FROM l0
      UNION ALL SELECT magazine_id * 3 + 1, page_number, row_number() OVER (PARTITION BY magazine_id, page_number ORDER BY side, top, block, line), text FROM l1
      UNION ALL SELECT magazine_id * 3 + 2, page_number, row_number() OVER (PARTITION BY magazine_id, page_number ORDER BY band, x0, y0, block, first), text FROM l0 JOIN h2 USING (magazine_id, page_number, block))"""
_KINDS_READ = _KINDS[_KINDS.index("kinds AS (") :].replace("kinds AS (", "kinds2 AS (").replace("v_toc_line", "rd").replace("t.magazine_id = l.magazine_id", "t.magazine_id = l.magazine_id // 3")
_PLAUSIBLE_READ = f"""{_KINDS_READ}, {_ENTRIES.replace("FROM kinds", "FROM kinds2")}, pl AS (SELECT e.magazine_id // 3 AS magazine_id, CAST(e.magazine_id % 3 AS INT) AS strategy, page_number, line_no, title, start_page, end_page FROM ent e
    JOIN (SELECT magazine_id, max(page_number) * 5 AS last_page FROM v_toc_line GROUP BY 1) l ON l.magazine_id = e.magazine_id // 3 WHERE title <> '' AND start_page BETWEEN 1 AND last_page)"""


@query("t8_readings", f"WITH {_KINDS}, {_PAGES}, {_READ} SELECT magazine_id // 3 AS magazine_id, CAST(magazine_id % 3 AS INT) AS strategy, page_number, line_no, line FROM rd")
def _(v):
    found = T.find_toc_pages(v("v_toc_line"), fuzzy=False)
    return T.readings(v("v_toc_word").join(found.hint("merge"), ["magazine_id", "page_number"], "left_semi"))


def _readings(v):
    lines = stored(v("v_toc_line"), "lines")
    return T.entries_of_readings(v("v_toc_word"), lines, T.find_toc_pages(lines, fuzzy=False), lines.withColumn("page_number", F.col("page_number") * 5))


@query("t8_best_strategy", f"""WITH {_KINDS}, {_PAGES}, {_READ}, {_PLAUSIBLE_READ}, n AS (SELECT magazine_id, strategy, row_number() OVER (PARTITION BY magazine_id ORDER BY count(*) DESC, strategy) AS r FROM pl GROUP BY 1, 2)
    SELECT pl.* FROM pl JOIN n USING (magazine_id, strategy) WHERE r = 1""")
def _(v):
    """Entries of the pages of contents, from their word boxes, in the reading that finds most."""
    return T.best_reading(_readings(v)).select("magazine_id", "strategy", "page_number", "line_no", "title", "start_page", "end_page")


@query("t8_entries_by_reading", f"WITH {_KINDS}, {_PAGES}, {_READ}, {_PLAUSIBLE_READ} SELECT magazine_id, strategy, count(*) AS entries FROM pl GROUP BY 1, 2")
def _(v):
    return _readings(v).groupBy("magazine_id", "strategy").agg(F.count("*").alias("entries"))


@query("t9_article_ranges", f"""WITH {_KINDS}, {_PAGES}, {_ENTRIES}, {_ON_PAGES} SELECT magazine_id, title, start_page, row_number() OVER w AS position, coalesce(end_page, greatest(start_page, lead(start_page) OVER w - 1), last_page) AS end_page
    FROM pl WINDOW w AS (PARTITION BY magazine_id ORDER BY start_page, page_number, line_no)""")
def _(v):
    return T.article_ranges(_on_pages(v)[2]).select("magazine_id", "title", "start_page", "position", "end_page")


@query("t10_toc_status", f"""WITH {_KINDS}, {_PAGES}, {_ENTRIES}, {_ON_PAGES}, p AS (SELECT magazine_id, string_agg(CAST(page_number AS STRING), ', ' ORDER BY page_number) AS pages FROM tocp GROUP BY 1), n AS (SELECT magazine_id, count(*) AS n FROM pl WHERE start_page > 20 GROUP BY 1)
    SELECT m.id AS magazine_id, CASE WHEN n IS NULL AND pages IS NOT NULL THEN 'failed' ELSE 'done' END AS toc_status, CASE WHEN n > 0 THEN NULL WHEN pages IS NOT NULL THEN 'Sommaire détecté (page ' || pages || ') mais aucune entrée n''a pu en être lue.'
    ELSE 'Aucune page de sommaire n''a été identifiée dans ce numéro.' END AS message FROM v_magazine m LEFT JOIN p ON p.magazine_id = m.id LEFT JOIN n ON n.magazine_id = m.id""")
def _(v):
    _, found, entries = _on_pages(v)
    return T.toc_status(v("v_magazine"), found, entries.filter("start_page > 20"))


@query("t11_toc_diagnosis", """SELECT m.collection_id, c.name AS collection, count(*) FILTER (miss) AS missing, count(*) AS total, count(*) FILTER (miss AND toc_status = 'done') AS done, count(*) FILTER (miss AND toc_status = 'failed') AS failed,
    count(*) FILTER (miss AND toc_status = 'pending') AS pending FROM (SELECT *, id NOT IN (SELECT magazine_id FROM v_article) AS miss FROM v_magazine WHERE scan_status = 'done') m LEFT JOIN v_collection c ON c.id = m.collection_id GROUP BY 1, 2 HAVING count(*) FILTER (miss) > 0""")
def _(v):
    return T.toc_diagnosis(v("v_magazine"), v("v_article"), v("v_collection"))


@query("t11_heading_candidates", "SELECT lower(line) AS line, count(*) AS n FROM v_toc_line WHERE page_number <= 12 AND length(line) BETWEEN 3 AND 30 GROUP BY 1")
def _(v):
    return T.heading_candidates(v("v_toc_line"))


@query("t12_rebuild_metadata", """WITH new AS (SELECT m.*, c.name AS stored, split_part(file_path, '/', 1) AS new_collection, CASE WHEN id_ % 11 = 0 OR id_ % 13 = 0 THEN 'hs' WHEN id_ % 11 = 1 THEN 'sp' ELSE 'normal' END AS new_issue_type, CAST(100 + id_ % 800 AS STRING) AS new_issue_number,
    make_date(CASE WHEN id_ % 6 = 5 THEN CAST(1900 + id_ % 120 AS INT) ELSE CAST(1990 + id_ % 30 AS INT) END, CASE WHEN id_ % 6 >= 4 THEN 1 ELSE CAST(1 + id_ % 12 AS INT) END, 1) AS new_publication_date,
    CASE WHEN id_ % 6 IN (0, 2, 3) OR (id_ % 6 = 1 AND issue_month_label = 'Avril') THEN issue_month_label WHEN id_ % 6 = 1 THEN issue_month_label || '-Avril' END AS new_issue_month_label
    FROM (SELECT *, id AS id_ FROM v_magazine) m LEFT JOIN v_collection c ON c.id = m.collection_id)
    SELECT n.id, new_collection, CASE WHEN d.id % 3 <> 0 THEN d.id END AS new_collection_id, new_issue_type, new_issue_number, CAST(new_publication_date AS STRING) AS new_publication_date, new_issue_month_label FROM new n LEFT JOIN v_collection d ON d.name = new_collection
    WHERE CASE WHEN n.collection_id % 3 <> 0 THEN stored END IS DISTINCT FROM new_collection OR issue_type <> new_issue_type OR issue_number IS DISTINCT FROM new_issue_number OR publication_date IS DISTINCT FROM new_publication_date OR issue_month_label IS DISTINCT FROM new_issue_month_label""")
def _(v):
    inner = F.when(F.col("id") % 13 == 0, F.regexp_replace("file_path", "^([^/]+)/", "$1/2019/Hors Séries/")).otherwise(F.col("file_path"))
    covers = v("v_magazine").select(F.col("id").alias("magazine_id"), F.lit(1).alias("page_number"), F.concat(F.lit("paru en "), (1900 + F.col("id") % 120).cast("string")).alias("raw_text"))
    out = T.rebuild_metadata(v("v_magazine").withColumn("file_path", inner), v("v_collection").filter("id % 3 <> 0"), covers)
    return out.select("id", "new_collection", "new_collection_id", "new_issue_type", "new_issue_number", F.col("new_publication_date").cast("string").alias("new_publication_date"), "new_issue_month_label")


@query("t13_dedupe_articles", "SELECT min(id) AS id, magazine_id, title, start_page FROM v_article GROUP BY 2, 3, 4")
def _(v):
    return T.dedupe_articles(v("v_article")).select("id", "magazine_id", "title", "start_page")


@query("t13_count_duplicates", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) AS groups FROM (SELECT count(*) AS n FROM v_article GROUP BY magazine_id, title, start_page HAVING count(*) > 1)")
def _(v):
    return T.count_duplicates(v("v_article"))
