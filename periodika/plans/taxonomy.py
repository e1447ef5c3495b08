"""Registered queries: taxonomy, labels, search, sources."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as R
from ..operators import taxonomy as K
from ..operators.search_store import SearchStore
from ..sources import archive as S
from ..sources.stored import fresh_folder, stored
from .registry import query, shared_folder

_NORM = "replace(strip_accents(lower({})), 'ß', 'ss')"
_KEYWORDS = f"""kw AS (SELECT subtheme_id, place, keyword, '\\b' || array_to_string(list_transform(list_filter(string_split_regex({_NORM.format('keyword')}, '\\s+'), lambda x: x <> ''), lambda x: x || '[sx]?'), '\\s+') || '\\b' AS pattern
    FROM (SELECT id AS subtheme_id, unnest(range(0, len(keywords))) AS place, unnest(keywords) AS keyword FROM v_subtheme) WHERE trim(keyword) <> '')"""
_MATCHES = f"{_KEYWORDS}, hit AS (SELECT subtheme_id, place, id AS article_id, magazine_id FROM kw JOIN v_article ON regexp_matches({_NORM.format('title')}, pattern)), k1 AS (SELECT DISTINCT subtheme_id, article_id, magazine_id FROM hit)"
_ORPHANS = "SELECT * FROM v_article a WHERE NOT EXISTS (SELECT 1 FROM v_link l WHERE l.article_id = a.id)"


@query("k1_attach_keywords", f"WITH {_MATCHES} SELECT subtheme_id, article_id FROM k1")
def _(v):
    return K.attach_keywords(v("v_article"), v("v_subtheme"))


@query("k2_attach_one_magazine", f"WITH {_MATCHES} SELECT subtheme_id, article_id FROM k1 WHERE magazine_id = 7")
def _(v):
    return K.attach_one_magazine(v("v_article"), v("v_subtheme"), 7)


@query("k3_sterile_keywords", f"WITH {_MATCHES} SELECT subtheme_id, place, keyword FROM kw WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.subtheme_id = kw.subtheme_id AND hit.place = kw.place)")
def _(v):
    return K.sterile_keywords(v("v_article"), v("v_subtheme"))


def _payload(v):
    """A taxonomy document made from the stored taxonomy, with some entries changed or broken."""
    sub = v("v_subtheme").join(v("v_theme").select(F.col("id").alias("theme_id"), F.upper("name").alias("theme")), "theme_id")
    name = F.when(F.col("id") == 30, "Large things").when(F.col("id") == 42, "").otherwise(F.col("name"))
    words = F.when(F.col("id") == 41, F.array().cast("array<string>")).when(F.col("id") == 20, F.array(F.lit("red"), F.lit(" small "))).otherwise(F.col("keywords"))
    subs = sub.filter("id <> 11").groupBy("theme").agg(F.array_sort(F.collect_list(F.struct(name.alias("nom"), words.alias("mots_cles")))).alias("sous_thematiques"))
    whole = F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("theme").alias("nom"), "sous_thematiques"))).alias("thematiques")))
    more = """["stray", {"nom": "Alimentation ", "sous_thematiques": [7, {"nom": "Vin", "mots_cles": ["anvil"]}, {"nom": "Vin", "mots_cles": ["ring", "quarks"]}]}, """
    return subs.agg(F.replace(whole, F.lit('{"thematiques":['), F.lit('{"thematiques":' + more)).alias("value"))


_ENTRIES = """entries AS (SELECT upper(t.name) AS theme, CASE s.id WHEN 30 THEN 'Large things' WHEN 42 THEN '' ELSE s.name END AS subtheme,
    CASE s.id WHEN 41 THEN [] WHEN 20 THEN ['red', 'small'] ELSE list_filter(list_transform(s.keywords, lambda x: trim(x)), lambda x: x <> '') END AS keywords FROM v_subtheme s JOIN v_theme t ON t.id = s.theme_id WHERE s.id <> 11),
    good AS (SELECT * FROM entries WHERE subtheme <> '' AND len(keywords) > 0 UNION ALL SELECT 'Alimentation', 'Vin', ['ring', 'quarks'])"""
_IMPORTED = f"""{_ENTRIES}, now AS (SELECT s.id, lower(t.name) AS key, t.name AS theme, s.name AS subtheme, s.keywords AS old FROM v_subtheme s JOIN v_theme t ON t.id = s.theme_id),
    imp AS (SELECT now.id, coalesce(now.theme, st.name, g.theme) AS theme, coalesce(now.subtheme, g.subtheme) AS subtheme, coalesce(g.keywords, old) AS keywords, CASE WHEN now.id IS NULL THEN 'created' WHEN g.keywords IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM now FULL JOIN good g ON now.key = lower(g.theme) AND now.subtheme = g.subtheme LEFT JOIN v_theme st ON lower(st.name) = lower(g.theme))"""


@query("s8_read_taxonomy_json", f"""WITH {_ENTRIES} SELECT theme, subtheme, array_to_string(keywords, '|') AS keywords, NULL AS reason FROM good
    UNION ALL SELECT theme, subtheme, NULL, CASE WHEN subtheme = '' THEN 'subtheme without name' ELSE 'no keyword' END FROM entries WHERE subtheme = '' OR len(keywords) = 0
    UNION ALL SELECT 'Alimentation', 'Vin', 'anvil', NULL UNION ALL SELECT '', '', NULL, 'theme without name' UNION ALL SELECT 'Alimentation', '', NULL, 'subtheme without name'""")
def _(v):
    good, bad = K.parse_taxonomy(_payload(v))
    none = F.lit(None).cast("string")
    return good.select("theme", "subtheme", F.array_join("keywords", "|").alias("keywords"), none.alias("reason")).unionByName(bad.select("theme", "subtheme", none.alias("keywords"), "reason"))


@query("k4_import_taxonomy", f"WITH {_IMPORTED} SELECT id, theme, subtheme, array_to_string(keywords, '|') AS keywords, action FROM imp")
def _(v):
    out = K.import_taxonomy(K.parse_taxonomy(_payload(v))[0], v("v_theme"), v("v_subtheme"))
    return out.withColumn("keywords", F.array_join("keywords", "|"))


@query("k4_import_report", f"""WITH {_IMPORTED}, kk AS (SELECT theme || ' > ' || subtheme AS line, unnest(keywords) AS keyword FROM imp WHERE action <> 'kept'),
    pat AS (SELECT line, keyword, '\\b' || array_to_string(list_transform(list_filter(string_split_regex({_NORM.format('keyword')}, '\\s+'), lambda x: x <> ''), lambda x: x || '[sx]?'), '\\s+') || '\\b' AS pattern FROM kk),
    h AS (SELECT line, keyword, id FROM pat JOIN v_article ON regexp_matches({_NORM.format('title')}, pattern)), m AS (SELECT DISTINCT line, id FROM h)
    SELECT i.line, count(m.id) AS n FROM (SELECT theme || ' > ' || subtheme AS line FROM imp WHERE action <> 'kept') i LEFT JOIN m ON m.line = i.line GROUP BY 1
    UNION ALL SELECT 'corpus', count(*) FROM v_article UNION ALL SELECT 'covered', count(DISTINCT id) FROM m UNION ALL SELECT 'uncovered', (SELECT count(*) FROM v_article) - count(DISTINCT id) FROM m
    UNION ALL SELECT 'sterile > ' || line || ' > ' || keyword, 0 FROM pat WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.line = pat.line AND h.keyword = pat.keyword)""")
def _(v):
    return K.import_report(v("v_article"), K.import_taxonomy(K.parse_taxonomy(_payload(v))[0], v("v_theme"), v("v_subtheme")))


@query("k5_recompute_all", f"WITH {_MATCHES} SELECT t.name AS theme, s.name, count(k1.article_id) AS n FROM v_subtheme s JOIN v_theme t ON t.id = s.theme_id LEFT JOIN k1 ON k1.subtheme_id = s.id GROUP BY 1, 2")
def _(v):
    return K.recompute_all(v("v_article"), v("v_theme"), v("v_subtheme"))


@query("k6_merge_links", f"""WITH {_MATCHES} SELECT subtheme_id, article_id, source FROM v_link WHERE source <> 'mots_cles' UNION ALL SELECT subtheme_id, article_id, 'mots_cles' FROM k1
    WHERE NOT EXISTS (SELECT 1 FROM v_link l WHERE l.source <> 'mots_cles' AND l.subtheme_id = k1.subtheme_id AND l.article_id = k1.article_id)""")
def _(v):
    return K.merge_links(v("v_link"), K.attach_keywords(v("v_article"), v("v_subtheme")))


@query("k7_orphans", f"SELECT id, title FROM ({_ORPHANS})")
def _(v):
    return K.orphans(v("v_article"), v("v_link")).select("id", "title")


@query("k7_orphan_examples", f"SELECT id, title FROM ({_ORPHANS}) ORDER BY id LIMIT 30")
def _(v):
    return K.orphans(v("v_article"), v("v_link")).select("id", "title").orderBy("id").limit(30)


_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)


@query("k8_orphan_words", f"""SELECT word, count(*) AS n FROM (SELECT DISTINCT id, unnest(regexp_extract_all({_NORM.format('title')}, '[a-z0-9]+')) AS word FROM ({_ORPHANS})) WHERE length(word) >= 4 AND word NOT IN ({_STOP}) GROUP BY 1 ORDER BY n DESC, word LIMIT 40""")
def _(v):
    return K.orphan_words(K.orphans(v("v_article"), v("v_link")))


_CORPUS = "SELECT c.name AS collection, a.id, a.magazine_id, trim(a.title) AS clean, row_number() OVER (PARTITION BY c.name, lower(trim(a.title)) ORDER BY a.id) AS r FROM v_article a JOIN v_magazine m ON m.id = a.magazine_id JOIN v_collection c ON c.id = m.collection_id WHERE trim(a.title) <> ''"


@query("k9_corpus_by_collection", f"SELECT collection, count(*) FILTER (r = 1) AS titles, CAST(sum(length(clean)) FILTER (r = 1) AS BIGINT) AS chars, count(DISTINCT magazine_id) AS magazines FROM ({_CORPUS}) GROUP BY 1")
def _(v):
    return K.corpus_by_collection(v("v_article"), v("v_magazine"), v("v_collection"))


@query("k9_corpus_titles", f"SELECT collection, clean AS title FROM ({_CORPUS}) WHERE r = 1")
def _(v):
    return K.corpus_titles(v("v_article"), v("v_magazine"), v("v_collection"))


_ORPHAN_TITLES = f"SELECT DISTINCT coalesce(c.name, '(sans collection)') AS collection, o.title FROM ({_ORPHANS}) o JOIN v_magazine m ON m.id = o.magazine_id LEFT JOIN v_collection c ON c.id = m.collection_id"


@query("k10_orphans_by_collection", _ORPHAN_TITLES)
def _(v):
    return K.orphans_by_collection(v("v_article"), v("v_link"), v("v_magazine"), v("v_collection"))


@query("k11_existing_taxonomy", "SELECT t.name AS theme, string_agg(s.name || '=' || array_to_string(s.keywords, '|'), ';' ORDER BY s.name) AS subthemes FROM v_theme t JOIN v_subtheme s ON s.theme_id = t.id GROUP BY 1")
def _(v):
    return K.existing_taxonomy(v("v_theme"), v("v_subtheme"))


@query("k11_taxonomy_for_request", "SELECT t.name AS theme, coalesce(string_agg(s.name || '=' || array_to_string(s.keywords[:1], '|'), ';' ORDER BY s.name), '') AS subthemes FROM v_theme t LEFT JOIN v_subtheme s ON s.theme_id = t.id GROUP BY 1")
def _(v):
    return K.existing_taxonomy(v("v_theme"), v("v_subtheme"), keep_empty=True, most_keywords=1)


@query("k12_export_volumetry", f"""SELECT count(*) AS unique_titles, count(DISTINCT collection) AS collections, CAST(coalesce(sum(length(title)), 0) AS BIGINT) AS chars, (SELECT count(*) FROM v_article) AS articles, (SELECT count(*) FROM ({_ORPHANS})) AS orphans,
    coalesce(sum(length(title)), 0) > 600000 AS too_large FROM ({_ORPHAN_TITLES})""")
def _(v):
    return K.export_volumetry(v("v_article"), v("v_link"), v("v_magazine"), v("v_collection"))


@query("k13_pack_batches", "SELECT id, (row_number() OVER (ORDER BY id) - 1) // 300 AS batch FROM v_article")
def _(v):
    return K.pack_batches(v("v_article"), 5000)


@query("k13_pack_by_collection", """WITH RECURSIVE a AS (SELECT m.collection_id AS c, a.id, CAST(ceil((1021 + length('{"article_id": ' || CAST(a.id AS STRING) || ', "titre": ' || CAST(to_json(a.title) AS STRING) || ', "collection": ' || coalesce(CAST(to_json(k.name) AS STRING), 'null') || '}')) / 4.0) - ceil(1021 / 4.0) AS INT) AS cost,
      row_number() OVER (PARTITION BY m.collection_id ORDER BY a.id) AS r FROM v_article a JOIN v_magazine m ON m.id = a.magazine_id LEFT JOIN v_collection k ON k.id = m.collection_id WHERE m.collection_id IS NOT NULL),
    f AS (SELECT c, id, r, 0 AS batch, cost AS total FROM a WHERE r = 1 UNION ALL SELECT a.c, a.id, a.r, CASE WHEN f.total + a.cost > 100 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.total + a.cost > 100 THEN a.cost ELSE f.total + a.cost END FROM f JOIN a ON a.c = f.c AND a.r = f.r + 1)
    SELECT c AS collection_id, id, batch FROM f""")
def _(v):
    where = v("v_magazine").filter("collection_id IS NOT NULL").select(F.col("id").alias("magazine_id"), "collection_id")
    rows = v("v_article").join(where.hint("merge"), "magazine_id").join(v("v_collection").select(F.col("id").alias("collection_id"), F.col("name").alias("collection")).hint("merge"), "collection_id", "left")
    return K.pack_batches(rows, 99_900, "collection_id", 1021)


@query("k13_pack_by_tokens", """WITH RECURSIVE a AS (SELECT id, CAST(ceil(length('{"article_id": ' || CAST(id AS STRING) || ', "titre": ' || CAST(to_json(title) AS STRING) || ', "collection": null}') / 4.0) AS INT) AS cost, row_number() OVER (ORDER BY id) AS r FROM v_article),
    f AS (SELECT id, r, 0 AS batch, 1 AS n, cost AS total FROM a WHERE r = 1 UNION ALL SELECT a.id, a.r, CASE WHEN n >= 300 OR total + cost > 5500 THEN batch + 1 ELSE batch END, CASE WHEN n >= 300 OR total + cost > 5500 THEN 1 ELSE n + 1 END, CASE WHEN n >= 300 OR total + cost > 5500 THEN cost ELSE total + cost END FROM f JOIN a ON a.r = f.r + 1)
    SELECT id, batch FROM f""")
def _(v):
    """Over all articles, where the taxonomy takes so much of a request that tokens close a batch and not the count."""
    return K.pack_batches(v("v_article"), 94_500)


@query("k14_split_failed_batch", "SELECT id, batch, CASE WHEN row_number() OVER (PARTITION BY batch ORDER BY id) <= greatest(count(*) OVER (PARTITION BY batch) // 2, 1) THEN 0 ELSE 1 END AS half FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 300 AS batch FROM v_article)")
def _(v):
    return K.split_failed_batch(K.pack_batches(v("v_article"), 5000))


@query("k14_failure_streak", """WITH r AS (SELECT event_id AS id, user_id AS account, ts, event_type <> 'error' AS ok, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM events)
    SELECT id, account, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w AS BIGINT) AS streak, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER w = 3 AS pause FROM r WINDOW w AS (PARTITION BY account, run ORDER BY ts, id)""")
def _(v):
    attempts = v.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("account"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return K.failure_streak(attempts).select("id", "account", "streak", "pause")


_PROPOSALS = "SELECT p_partkey AS proposal_id, unnest(range(0, 4)) AS place, unnest([' ' || p_name || ' ', p_name, 'zz' || CAST(p_partkey AS STRING), substr(p_name, 1, 3)]) AS keyword FROM part"


@query("k15_valid_keywords", f"""WITH p AS (SELECT proposal_id, lower(trim(keyword)) AS keyword, min(place) AS place FROM ({_PROPOSALS}) WHERE length(lower(trim(keyword))) >= 4 GROUP BY 1, 2),
    d AS (SELECT keyword, '\\b' || array_to_string(list_transform(string_split_regex({_NORM.format('keyword')}, '\\s+'), lambda x: x || '[sx]?'), '\\s+') || '\\b' AS pattern FROM (SELECT DISTINCT keyword FROM p WHERE keyword NOT LIKE 'zz%')),
    n AS (SELECT keyword, count(DISTINCT id) AS hits FROM d JOIN v_article ON regexp_matches({_NORM.format('title')}, pattern) GROUP BY 1)
    SELECT proposal_id, keyword, row_number() OVER (PARTITION BY proposal_id ORDER BY place) AS place FROM p LEFT JOIN n USING (keyword) WHERE coalesce(hits, 0) <= greatest(5, 0.02 * (SELECT count(*) FROM v_article))""")
def _(v):
    words = F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), F.col("p_name"), F.concat(F.lit("zz"), F.col("p_partkey").cast("string")), F.substring("p_name", 1, 3))
    return K.valid_keywords(v.table("part").select(F.col("p_partkey").alias("proposal_id"), F.posexplode(words).alias("place", "keyword")), v("v_article"))


def _answers(v):
    """One JSON answer for each 100 articles: known ids, new names, unknown themes, repeats and strangers by id."""
    a = v("v_article").filter("copy = 0").select(F.floor(F.col("id") / 100).alias("batch_id"), F.col("id").alias("article_id"))
    known = F.when(F.col("article_id") % 5 == 0, F.lit(20)).when(F.col("article_id") % 5 == 1, F.lit(999)).cast("long")
    theme = F.when(F.col("article_id") % 5 == 2, " COLOUR ").when(F.col("article_id") % 5 == 3, "Nowhere").when(F.col("article_id") % 5 == 4, "Size")
    name = F.when(F.col("article_id") % 10 == 7, "DÉEP green ").when(F.col("article_id") % 5 == 2, "Deep  green").when(F.col("article_id") % 5 == 4, "small  gizmo").otherwise("x")
    one = F.struct("article_id", known.alias("sous_thematique_id"), F.struct(theme.alias("thematique"), name.alias("nom"), F.array(*map(F.lit, (" Quartz", "gizmo", "zz", "quartz", "topaz"))).alias("mots_cles")).alias("nouvelle"))
    again = F.struct((F.col("article_id") + F.when(F.col("article_id") % 7 == 0, 100000).otherwise(0)).alias("article_id"), F.lit(21).cast("long").alias("sous_thematique_id"), F.struct(F.lit(None).cast("string").alias("thematique"), F.lit(None).cast("string").alias("nom"), F.lit(None).cast("array<string>").alias("mots_cles")).alias("nouvelle"))
    rows = a.select("batch_id", F.posexplode(F.array(one, again)).alias("turn", "x"))
    listed = rows.groupBy("batch_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "x"))), lambda r: r["x"])).alias("answer"))
    strays = F.concat(F.lit('["stray", 7, null, {"article_id": "x"}, {"nouvelle": []}, '), F.substring("answer", F.lit(2), F.length("answer")))
    return a, listed.withColumn("answer", strays)


@query("k16_apply_labels", """SELECT id AS article_id, CASE WHEN id % 5 = 0 THEN 20 WHEN id % 5 = 4 THEN 30 WHEN id % 5 IN (1, 3) THEN 21 END AS subtheme_id, CASE WHEN id % 5 = 2 THEN 2 END AS new_theme_id, CASE WHEN id % 5 = 2 THEN 'deep green' END AS new_key, 'gemini' AS source
    FROM v_article WHERE copy = 0 AND NOT (id % 5 IN (1, 3) AND id % 7 = 0)""")
def _(v):
    batch, answers = _answers(v)
    return K.apply_labels(batch, answers, v("v_theme"), v("v_subtheme"))[0]


@query("k16_created_subthemes", "SELECT DISTINCT 2 AS theme_id, 'deep green' AS name_key, 'Deep  green' AS name, 'quartz|topaz' AS keywords FROM v_article WHERE id % 5 = 2 AND copy = 0")
def _(v):
    batch, answers = _answers(v)
    created = K.apply_labels(batch, answers, v("v_theme"), v("v_subtheme"), v("v_article"))[1]
    return created.withColumn("keywords", F.array_join("keywords", "|"))


@query("k16_stamp_batch", "SELECT id, sent OR copy = 0 AS sent, CASE WHEN copy = 0 THEN '2024-02-01' END AS sent_at FROM v_article")
def _(v):
    batch, _ = _answers(v)
    return K.stamp_batch(v("v_article"), batch, F.lit("2024-02-01").cast("timestamp")).select("id", "sent", F.date_format("sent_at", "yyyy-MM-dd").alias("sent_at"))


@query("k17_coverage_stats", """SELECT articles, covered, CASE WHEN articles > 0 THEN round(100 * covered / articles, 1) ELSE 0.0 END AS percent, covered / articles < 0.5 AS warn FROM (SELECT count(*) AS articles FROM v_article), (SELECT count(DISTINCT article_id) AS covered FROM v_link)""")
def _(v):
    return K.coverage_stats(v("v_article"), v("v_link"))


_DOCS = """docs AS (SELECT CAST(p.magazine_id AS STRING) || '-' || CAST(p.page_number AS STRING) AS page_id, p.magazine_id, p.page_number, m.title AS magazine_title, m.issue_number, m.issue_month_label AS issue_month, c.name AS collection_name, year(m.publication_date) AS year, m.publication_date,
    coalesce(p.raw_text, '') AS raw_text, m.collection_id, coalesce(t.tag_ids, []) AS tag_ids FROM v_page p JOIN v_magazine m ON m.id = p.magazine_id LEFT JOIN v_collection c ON c.id = m.collection_id LEFT JOIN (SELECT collection_id, list(tag_id ORDER BY tag_id) AS tag_ids FROM v_collection_tag GROUP BY 1) t ON t.collection_id = m.collection_id)"""
_INDEX = f"""tok AS (SELECT page_id, magazine_id, 0 AS attr, unnest(regexp_extract_all({_NORM.format('raw_text')}, '[\\pL\\pN]+')) AS term, unnest(range(0, len(regexp_extract_all({_NORM.format('raw_text')}, '[\\pL\\pN]+')))) AS position FROM docs
    UNION ALL SELECT page_id, magazine_id, 1, unnest(regexp_extract_all({_NORM.format('magazine_title')}, '[\\pL\\pN]+')), unnest(range(0, len(regexp_extract_all({_NORM.format('magazine_title')}, '[\\pL\\pN]+')))) FROM docs),
    idx AS (SELECT term, attr, page_id, magazine_id, count(*) AS tf, list(position ORDER BY position) AS positions FROM tok GROUP BY 1, 2, 3, 4)"""


def _docs(v):
    return R.search_documents(v("v_page"), v("v_magazine"), v("v_collection"), v("v_collection_tag"))


@query("s10_build_search_docs", f"WITH {_DOCS} SELECT page_id, magazine_id, page_number, magazine_title, issue_number, issue_month, collection_name, year, raw_text, collection_id, array_to_string(tag_ids, ',') AS tag_ids FROM docs")
def _(v):
    return _docs(v).withColumn("tag_ids", F.array_join(F.transform("tag_ids", lambda t: t.cast("string")), ",")).drop("publication_date")


@query("s11_refresh_search_docs", f"WITH {_DOCS} SELECT page_id, CASE WHEN magazine_id % 10 = 3 THEN raw_text ELSE 'old' END AS raw_text FROM docs")
def _(v):
    docs = _docs(v).select("page_id", "magazine_id", "raw_text")
    changed = v("v_magazine").filter("id % 10 = 3").select(F.col("id").alias("magazine_id"))
    return R.refresh_search_documents(docs.withColumn("raw_text", F.lit("old")), docs, changed).select("page_id", "raw_text")


def _store(v):
    """A stored search whose magazines with a remainder of 3 and 7 by 10 were refreshed, in two generations; those of 7 lose their first page."""
    docs = stored(_docs(v), "docs")
    store = SearchStore(v.spark, fresh_folder(v.spark, "search"), buckets=16, partitions=8)
    store.build(docs.withColumns({"raw_text": F.when(F.col("magazine_id") % 10 == 3, F.lit("old text of the with")).otherwise(F.col("raw_text"))}))
    for rest, fresh in ((3, docs), (7, docs.filter("page_number > 1"))):
        store.refresh(fresh, v("v_magazine").filter(F.col("id") % 10 == rest).select(F.col("id").alias("magazine_id")))
    return store


_REFRESHED = "docs_ AS (SELECT * FROM docs WHERE magazine_id % 10 <> 7 OR page_number > 1)"


@query("s11_refresh_in_place", f"WITH {_DOCS}, {_REFRESHED} SELECT page_id, magazine_id, raw_text FROM docs_")
def _(v):
    return _store(v).documents().select("page_id", "magazine_id", "raw_text")


@query("r1_refreshed_index", f"WITH {_DOCS}, {_REFRESHED}, {_INDEX.replace('FROM docs', 'FROM docs_')} SELECT term, attr, page_id, tf, array_to_string(positions, ',') AS positions FROM idx")
def _(v):
    """The index of two generations over a base, as a rebuild would have it."""
    return _store(v).index().select("term", "attr", "page_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query("r1_build_inverted_index", f"WITH {_DOCS}, {_INDEX} SELECT term, attr, page_id, tf, array_to_string(positions, ',') AS positions FROM idx")
def _(v):
    out = R.build_inverted_index(_docs(v))
    return out.select("term", "attr", "page_id", "tf", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


_HITS = f"""{_DOCS}, {_INDEX}, h AS (SELECT *, term = 'the' AS t1, starts_with(term, 'with') AS t2 FROM idx WHERE term = 'the' OR starts_with(term, 'with')),
    pg AS (SELECT page_id, magazine_id, (bool_or(term = 'the'))::BIGINT + (bool_or(term = 'with'))::BIGINT AS exact, min(attr) AS attr, CAST(sum(CASE WHEN attr = 0 THEN tf ELSE 0 END) AS BIGINT) AS tf FROM h GROUP BY 1, 2 HAVING bool_or(t1) AND bool_or(t2)),
    hits AS (SELECT page_id, magazine_id, exact, tf, row_number() OVER (ORDER BY exact DESC, attr, tf DESC, page_id) AS rank FROM pg)"""


def _hits(v):
    return R.match_pages(R.build_inverted_index(_docs(v)), "The with")


@query("r2_match_pages", f"WITH {_HITS} SELECT * FROM hits WHERE rank <= 500")
def _(v):
    return _hits(v)


@query("r2_phrase", f"""WITH {_DOCS}, {_INDEX}, a AS (SELECT page_id, magazine_id, unnest(positions) AS p FROM idx WHERE term = 'of' AND attr = 0), b AS (SELECT page_id, unnest(positions) AS p FROM idx WHERE term = 'the' AND attr = 0) SELECT DISTINCT a.page_id, a.magazine_id FROM a JOIN b ON a.page_id = b.page_id AND b.p = a.p + 1""")
def _(v):
    return R.matching_pages(R.build_inverted_index(_docs(v)), '"of the"').select("page_id", "magazine_id")


@query("r2_typos", f"WITH {_DOCS}, {_INDEX} SELECT DISTINCT page_id FROM idx WHERE levenshtein(term, 'tition') <= 1 OR starts_with(term, 'tition')")
def _(v):
    return R.matching_pages(R.build_inverted_index(_docs(v)), "tition", typos=True).select("page_id")


@query("r2_typo_index", f"WITH {_DOCS}, {_INDEX} SELECT DISTINCT page_id FROM idx WHERE levenshtein(term, 'tition') <= 1 OR starts_with(term, 'tition')")
def _(v):
    """The same by a table of variants."""
    index = stored(R.build_inverted_index(_docs(v)), "index")
    return R.matching_pages(index, "tition", True, R.term_variants(index.select("term").distinct())).select("page_id")


@query("r2_term_variants", f"""WITH {_DOCS}, {_INDEX}, t AS (SELECT DISTINCT term, length(term) AS n FROM idx), one AS (SELECT term, n, substr(term, 1, i - 1) || substr(term, i + 1) AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM t WHERE n BETWEEN 4 AND 40)),
    two AS (SELECT term, substr(v, 1, i - 1) || substr(v, i + 1) AS v FROM (SELECT *, unnest(range(1, n)) AS i FROM one WHERE n >= 7)) SELECT term, count(DISTINCT v) AS variants FROM (SELECT term, term AS v FROM t WHERE n BETWEEN 4 AND 40 UNION ALL SELECT term, v FROM one UNION ALL SELECT * FROM two) GROUP BY 1""")
def _(v):
    return R.term_variants(R.build_inverted_index(_docs(v)).select("term").distinct()).filter("variant IS NOT NULL").groupBy("term").agg(F.count("*").alias("variants"))


@query("r2_ranks_of_all", f"WITH {_HITS} SELECT * FROM hits")
def _(v):
    """All matching pages, numbered in ranges and not in one task."""
    return R.match_pages(stored(R.build_inverted_index(_docs(v)), "index"), "The with", limit=None)


# Words of several scripts, each on the pages of one remainder, written in a form that the query doesn't use.
_SCRIPTS = ["Россий", "Ελλάδα", "한국", "m²", "crème"]


# Two of them may stand in the pages' own texts, as the beginning of a word at least.
_OWN = " UNION ".join(f"SELECT '{w}', page_id FROM idx WHERE starts_with(term, '{bare}')" for w, bare in ((_SCRIPTS[3], "m2"), (_SCRIPTS[4], "creme")))


@query("r2_scripts", f"WITH {_DOCS}, {_INDEX} SELECT word, CAST(magazine_id AS STRING) || '-' || CAST(page_number AS STRING) AS page_id FROM v_page JOIN (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(_SCRIPTS)) + f") AS s(i, word) ON magazine_id % 5 = i UNION {_OWN}")
def _(v):
    docs = _docs(v).withColumn("raw_text", F.concat("raw_text", F.lit(" "), F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("magazine_id") % 5 + 1).cast("int"))))
    index, out = stored(R.build_inverted_index(docs), "index"), None
    for w in _SCRIPTS:
        bare = w if w == _SCRIPTS[2] else unicodedata.normalize("NFD", w.upper())
        one = R.matching_pages(index, bare).select(F.lit(w).alias("word"), "page_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("x9_snippet_scripts", "SELECT magazine_id, page_number, 'it ' || CASE magazine_id % 5 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_SCRIPTS)) + " END AS snippet FROM v_page")
def _(v):
    word = F.element_at(F.array(*map(F.lit, _SCRIPTS)), (F.col("magazine_id") % 5 + 1).cast("int"))
    text = F.concat_ws(" ", F.lit("start of it"), word, F.lit("end"))
    return v("v_page").select("magazine_id", "page_number", X.snippet(text, [w.upper() for w in _SCRIPTS], 2).alias("snippet"))


@query("r2_accents", f"WITH {_DOCS}, {_INDEX} SELECT DISTINCT page_id FROM idx WHERE starts_with(term, 'fur')")
def _(v):
    return R.match_pages(R.build_inverted_index(_docs(v)), "FÜR", limit=None).select("page_id")


@query("r1_store_index", f"WITH {_HITS} SELECT * FROM hits WHERE rank <= 500")
def _(v):
    path = f"{shared_folder(v.spark)}/index-{uuid.uuid4().hex}"
    R.store_index(R.build_inverted_index(_docs(v)), path)
    return R.match_pages(v.spark.read.parquet(path), "The with")


@query("r3_count_groups", f"WITH {_HITS} SELECT count(DISTINCT magazine_id) AS total FROM hits WHERE rank <= 500")
def _(v):
    return R.count_groups(_hits(v))


@query("f5_search_filters", f"WITH {_DOCS} SELECT page_id FROM docs WHERE year = 1999 AND list_has_any(tag_ids, [2, 5]) AND collection_id IN (9, 4, 7, 19)")
def _(v):
    return R.search_filters(_docs(v), year=1999, tags=[2, 5], collections=[9, 4, 7, 19]).select("page_id")


@query("r3_group_by_magazine", f"""WITH {_HITS}, top AS (SELECT * FROM hits WHERE rank <= 500) SELECT magazine_id, count(*) AS occurrence_count, arg_min(page_id, rank) AS page_id, min(rank) AS rank FROM top JOIN v_magazine m ON m.id = magazine_id GROUP BY magazine_id, publication_date
    ORDER BY occurrence_count DESC, coalesce(CAST(publication_date AS STRING), '') DESC, min(rank) LIMIT 20""")
def _(v):
    return R.group_by_magazine(_hits(v), v("v_magazine"))


_BOXES = "SELECT magazine_id, page_number, n FROM v_word WHERE regexp_replace(lower(text), '[^\\pL\\pN_]+', '', 'g') IN ('the', 'with')"


@query("r4_find_in_document", f"WITH {_HITS} SELECT h.page_id, CAST(split_part(h.page_id, '-', 2) AS INT) AS page_number, greatest(count(b.n), 1) AS occurrence_count FROM hits h LEFT JOIN ({_BOXES}) b ON b.magazine_id = h.magazine_id AND b.page_number = CAST(split_part(h.page_id, '-', 2) AS INT) WHERE h.magazine_id = 1 AND h.rank <= 100000 GROUP BY 1, 2")
def _(v):
    index = R.build_inverted_index(_docs(v).filter("magazine_id = 1"))
    return R.find_in_document(R.matching_pages(index, "The with"), v("v_word"), ["the", "with"], 1)


@query("r5_hit_boxes", _BOXES)
def _(v):
    return R.hit_boxes(v("v_word"), ["the", "with"]).select("magazine_id", "page_number", "n")


@query("r6_occurrence_navigation", "SELECT magazine_id, page_number, coalesce(lag(page_number) OVER w, last_value(page_number) OVER a) AS previous, coalesce(lead(page_number) OVER w, first_value(page_number) OVER a) AS next FROM v_page WINDOW w AS (PARTITION BY magazine_id ORDER BY page_number), a AS (PARTITION BY magazine_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def _(v):
    return R.occurrence_navigation(v("v_page"))


@query("s2_file_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def _(v):
    return S.file_hash(v.table("documents"), "text").select("doc_id", "file_hash")


_SCAN = """WITH kp AS (SELECT path, max_by(size, mtime) AS k_size, max(mtime) AS k_mtime, max_by(id, mtime) AS k_id FROM v_known GROUP BY 1), kh AS (SELECT file_hash, min(id) AS h_id FROM v_known GROUP BY 1), ko AS (SELECT file_hash, path, min(id) AS own_id FROM v_known GROUP BY 1, 2),
    s AS (SELECT s.*, kp.*, coalesce(s.size = k_size AND abs(s.mtime - k_mtime) < 1, false) AS same FROM (SELECT path AS p, file_hash, size, mtime FROM v_scan) s LEFT JOIN kp ON kp.path = s.p),
    r AS (SELECT s.p, s.k_id, kh.h_id, ko.own_id, row_number() OVER (PARTITION BY s.file_hash ORDER BY s.p) AS r FROM s LEFT JOIN kh ON kh.file_hash = s.file_hash LEFT JOIN ko ON ko.file_hash = s.file_hash AND ko.path = s.p WHERE NOT same),
    looked AS (SELECT p AS path, coalesce(own_id, h_id, k_id) AS known_id, CASE WHEN own_id IS NOT NULL THEN 'unchanged' WHEN h_id IS NOT NULL THEN 'relocated' WHEN r > 1 THEN 'duplicate' WHEN k_id IS NOT NULL THEN 'modified' ELSE 'new' END AS class FROM r)
    SELECT p AS path, k_id AS known_id, 'unchanged' AS class FROM s WHERE same UNION ALL SELECT * FROM looked
    UNION ALL SELECT path, id, 'missing' FROM v_known WHERE path NOT IN (SELECT path FROM v_scan) AND id NOT IN (SELECT known_id FROM looked WHERE class = 'relocated')"""


@query("s3_classify_scan", _SCAN)
def _(v):
    """Titles come again among many documents, so that a path may be that of several files: each counts by itself."""
    contents = v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    hashes = lambda left: S.file_hash(contents.join(left.select("id").hint("merge"), "id", "left_semi")).select("id", "file_hash")
    return S.classify_scan(v("v_scan").drop("file_hash"), v("v_known"), hashes=hashes, entry="id")


# An archive with a file for each document; some have moved since they were stored, some are gone, some look newer than they were.
_FOLDER = """f_scan AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved/m' ELSE 'm' END || CAST(doc_id AS STRING) || '.pdf' AS path, sha256(text) AS file_hash, strlen(text) AS size, 100 AS mtime, doc_id AS id FROM documents WHERE text IS NOT NULL AND doc_id % 13 <> 0),
    f_known AS (SELECT doc_id AS id, 'm' || CAST(doc_id AS STRING) || '.pdf' AS path, sha256(text) AS file_hash, strlen(text) AS size, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 100 END AS mtime FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0)"""


def _folder(v):
    """The folder's URI, its listing as S1 gives it, and what is known of it."""
    root = fresh_folder(v.spark, "archive")
    docs = v.table("documents").filter("text IS NOT NULL").withColumn("name", F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".pdf")))
    S.write_files(docs.filter("doc_id % 13 <> 0").select(F.concat(F.when(F.col("doc_id") % 7 == 0, "moved/").otherwise(""), "name").alias("path"), F.col("text").alias("content")), root)
    below = F.element_at(F.split("path", "/" + root.rpartition("/")[2] + "/"), -1)
    listing = S.list_files(v.spark, root).select(below.alias("path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    times = stored(listing, "times")
    known = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.col("name").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"), F.octet_length("text").cast("long").alias("size"))
    known = known.join(times.select("path", "mtime").hint("merge"), "path", "left").withColumn("mtime", F.when(F.col("id") % 5 == 0, 0).otherwise(F.coalesce("mtime", F.lit(100))))
    return root, times, known


@query("s1_scan_files", f"WITH {_FOLDER} SELECT path, size FROM f_scan")
def _(v):
    return _folder(v)[1].select("path", "size")


@query("s3_scan_folder", f"""WITH {_FOLDER}, {_SCAN.strip().removeprefix("WITH ").replace("v_scan", "f_scan").replace("v_known", "f_known")}""")
def _(v):
    """Files of a folder, of which only those are opened that the listing leaves open."""
    root, listing, known = _folder(v)
    return S.classify_scan(listing, known, hashes=lambda left: S.hash_files(left, root))


@query("s4_stable_files", "SELECT s.path FROM v_scan s WHERE EXISTS (SELECT 1 FROM v_magazine m WHERE m.file_path = s.path AND m.file_size = s.size AND m.created_s = s.mtime)")
def _(v):
    first = v("v_magazine").select(F.col("file_path").alias("path"), F.col("file_size").alias("size"), F.col("created_s").alias("mtime"))
    return S.stable_files(first, v("v_scan")).select("path")


@query("s5_path_dimensions", "SELECT path, CASE WHEN len(p) > 1 THEN p[1] END AS collection, CASE WHEN len(p) > 2 THEN array_to_string(p[2:-2], '/') ELSE '' END AS sub_dirs, p[-1] AS filename, regexp_replace(p[-1], '\\.[^.]*$', '') AS stem FROM (SELECT path, string_split(path, '/') AS p FROM v_scan)")
def _(v):
    return S.path_dimensions(v("v_scan").select("path"), "path")


@query("s6_get_or_create_dimension", "WITH dim AS (SELECT id, name FROM v_collection WHERE id % 3 = 0) SELECT id, name FROM dim UNION ALL SELECT (SELECT max(id) FROM dim) + row_number() OVER (ORDER BY name), name FROM (SELECT DISTINCT source AS name FROM documents WHERE source NOT IN (SELECT name FROM dim))")
def _(v):
    return S.get_or_create_dimension(v.table("documents").select(F.col("source").alias("name")), v("v_collection").filter("id % 3 = 0"))


_LOG_TIME = "CASE WHEN event_id % 10 = 7 THEN 'broken' WHEN event_id % 10 < 5 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') END"


@query("s7_read_logs", """SELECT event_id AS id, CASE WHEN event_id % 10 <> 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') ELSE 'broken' END AS timestamp FROM events WHERE event_type = 'error' AND user_id % 2 = 0
    ORDER BY CASE WHEN event_id % 10 <> 7 THEN date_trunc('second', ts) END DESC NULLS LAST, CAST(event_id AS STRING) LIMIT 200""")
def _(v):
    """The newest errors of one component, from rotated files of JSON lines, a few of which are no JSON."""
    e = v.table("events")
    stamp = F.when(F.col("event_id") % 10 == 7, "broken").otherwise(F.date_format(e["ts"], "yyyy-MM-dd'T'HH:mm:ss"))
    record = F.struct(stamp.alias("timestamp"), F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.lit("events").alias("logger"), F.col("event_id").cast("string").alias("message"), F.lit("itself").alias("component"))
    line = F.when(F.col("event_id") % 50 == 49, F.concat(F.to_json(record), F.lit("\n  Traceback: not a record"))).otherwise(F.to_json(record))
    name = F.when(F.col("user_id") % 2 == 0, "worker.log").otherwise("api.log")
    turn = F.floor(F.col("event_id") / 5000)  # a file holds so many events at most
    lines = e.select(F.when(turn == 0, name).otherwise(F.concat(name, F.lit("."), turn.cast("string"))).alias("path"), line.alias("line"))
    root = fresh_folder(v.spark, "logs")
    S.write_files(lines.groupBy("path").agg(F.array_join(F.collect_list("line"), "\n").alias("content")), root)
    return S.latest_logs(S.read_logs(v.spark, root), "error", "worker").select(F.col("message").cast("long").alias("id"), "timestamp")


@query("s9_corpus_json", f"""SELECT CAST(to_json({{'chars': chars, 'collection': collection, 'magazines': magazines, 'titles': titles}}) AS STRING) AS value FROM (SELECT collection, count(*) FILTER (r = 1) AS titles,
    CAST(sum(length(clean)) FILTER (r = 1) AS BIGINT) AS chars, count(DISTINCT magazine_id) AS magazines FROM ({_CORPUS}) GROUP BY 1)""")
def _(v):
    return S.corpus_json(K.corpus_by_collection(v("v_article"), v("v_magazine"), v("v_collection")))


@query("s12_explode_words", "SELECT magazine_id, page_number, n, text, x0 / 600 AS x, y0 / 800 AS y, (x1 - x0) / 600 AS w, (y1 - y0) / 800 AS h FROM v_word")
def _(v):
    return S.relative_words(v("v_word"), 600.0, 800.0)
