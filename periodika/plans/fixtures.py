"""Archive tables derived from the test tables, as SQL that Spark and DuckDB both read.

Each view is one SELECT; ``{x}`` marks the few expressions that the two dialects spell differently. ``spark_view`` gives a
DataFrame, ``duck`` the WITH clause for a query of the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["documents", "part", "events", "customer"]

DIALECTS = {
    "spark": {
        "doc_lines": "SELECT doc_id, split(text, '\\n', -1) AS l FROM documents",
        "pages": "SELECT doc_id, p, array_join(slice(l, 3 * p + 1, 3), '\\n') AS raw_text FROM doc_lines LATERAL VIEW explode(sequence(0, CAST((size(l) - 1) DIV 3 AS INT))) t AS p",
        "words": "SELECT magazine_id, page_number, pos AS n, w FROM v_page LATERAL VIEW posexplode(filter(split(raw_text, '[ \\n]'), x -> x <> '')) t AS pos, w",
        "toc_words": "SELECT v_toc_place.*, i, w FROM v_toc_place LATERAL VIEW posexplode(filter(split(line, ' '), x -> x <> '')) t AS i, w",
        "keywords": "split(k, '[|]')",
        "nl": "'\\n'",
        "div": "DIV",
        "sha": "sha2(CAST(text AS BINARY), 256)",
    },
    "duck": {
        "doc_lines": "SELECT doc_id, string_split(text, chr(10)) AS l FROM documents",
        "pages": "SELECT doc_id, p, array_to_string(l[3 * p + 1 : 3 * p + 3], chr(10)) AS raw_text FROM (SELECT doc_id, l, unnest(range(0, CAST((len(l) - 1) // 3 + 1 AS BIGINT))) AS p FROM doc_lines)",
        "words": "SELECT magazine_id, page_number, n, w FROM (SELECT magazine_id, page_number, unnest(range(0, len(ws))) AS n, unnest(ws) AS w FROM (SELECT magazine_id, page_number, list_filter(string_split_regex(raw_text, '[ \\n]'), lambda x: x <> '') AS ws FROM v_page))",
        "toc_words": "SELECT *, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM v_toc_place)",
        "keywords": "string_split(k, '|')",
        "nl": "chr(10)",
        "div": "//",
        "sha": "sha256(text)",
    },
}

_MONTH = "CASE 1 + doc_id % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(["Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre"], 1)) + " END"
_YEAR = "CAST(1990 + doc_id % 30 AS STRING)"
_MM = "lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0')"
_TITLE = f"""source || ' - ' || CAST(100 + doc_id % 800 AS STRING) || ' - ' || CASE doc_id % 6 WHEN 0 THEN {_MONTH} || ' ' || {_YEAR}
  WHEN 1 THEN {_MONTH} || '-Avril ' || {_YEAR} WHEN 2 THEN {_MM} || '-' || {_YEAR} WHEN 3 THEN {_YEAR} || '-' || {_MM} WHEN 4 THEN {_YEAR} ELSE '' END
  || CASE doc_id % 11 WHEN 0 THEN ' Hors-Série' WHEN 1 THEN ' Spécial' ELSE '' END"""

VIEWS = {
    "doc_lines": "{doc_lines}",
    "v_collection": "SELECT DISTINCT CAST(substr(source, 4) AS INT) AS id, source AS name FROM documents WHERE source IS NOT NULL UNION ALL SELECT 900, 'empty'",
    "v_magazine": f"""SELECT doc_id AS id, {_TITLE} AS title, source || '/' || {_TITLE} || '.pdf' AS file_path, {{sha}} AS file_hash, n_chars AS file_size,
        CASE WHEN doc_id % 9 <> 0 THEN CAST(100 + doc_id % 800 AS STRING) END AS issue_number,
        CASE WHEN doc_id % 6 <> 5 THEN make_date(CAST(1990 + doc_id % 30 AS INT), CAST(1 + doc_id % 12 AS INT), 1) END AS publication_date,
        CASE doc_id % 11 WHEN 0 THEN 'hs' WHEN 1 THEN 'sp' ELSE 'normal' END AS issue_type,
        CASE WHEN doc_id % 6 <> 5 THEN {_MONTH} END AS issue_month_label,
        CASE doc_id % 8 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'detected' WHEN 3 THEN 'queued' ELSE 'done' END AS scan_status,
        CASE WHEN doc_id % 8 = 0 THEN 'cannot open /srv/archive/' || source || '/file.pdf' || {{nl}} || 'trace' END AS error_message,
        CASE doc_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'done' END AS toc_status,
        CASE WHEN doc_id % 3 = 0 THEN 'cover-' || CAST(doc_id AS STRING) END AS cover,
        CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST(substr(source, 4) AS INT) END AS collection_id,
        doc_id * 3600 AS created_s, doc_id * 3600 + (doc_id * 7919) % 100000 AS updated_s FROM documents""",
    "v_page": "SELECT doc_id AS magazine_id, CAST(p + 1 AS INT) AS page_number, raw_text FROM ({pages})",
    "v_word": """SELECT magazine_id, page_number, CAST(n {div} 20 AS INT) AS block, CAST(n {div} 8 AS INT) AS line, CAST(n AS INT) AS n, w AS text,
        CAST((n % 8) * 40 + CASE WHEN n % 8 >= 4 AND (n {div} 8) % 2 = 0 THEN 120 ELSE 0 END AS DOUBLE) AS x0, CAST((n % 8) * 40 + CASE WHEN n % 8 >= 4 AND (n {div} 8) % 2 = 0 THEN 120 ELSE 0 END + 30 AS DOUBLE) AS x1,
        CAST((n {div} 8) * 12 AS DOUBLE) AS y0, CAST((n {div} 8) * 12 + 10 AS DOUBLE) AS y1 FROM ({words})""",
    "v_article": """SELECT id, CASE WHEN m % 23 = 5 THEN 0 ELSE m END AS magazine_id, title, start_page, end_page, sent, copy FROM (
        SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM documents) AS m,
          CASE WHEN p_partkey % 5 = 0 THEN replace(t, ' ', '  ') ELSE t END AS title, p_size AS start_page, CASE WHEN p_partkey % 6 = 0 THEN p_size + 3 END AS end_page, p_partkey % 20 = 0 AS sent, 0 AS copy
        FROM (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, 'e', 'é') ELSE p_name END || CASE WHEN p_partkey % 3 = 0 THEN 's' ELSE '' END AS t FROM part)
        UNION ALL SELECT p_partkey + copy * (SELECT max(p_partkey) + 1 FROM part), p_partkey % (SELECT count(*) FROM documents), p_name, p_size, NULL, false, copy FROM part, (VALUES (1), (2)) AS c(copy) WHERE p_partkey % 50 = 1)""",
    "v_toc_line": """SELECT magazine_id, page_number, line_no, line FROM (
        SELECT id {div} 10 AS magazine_id, CASE WHEN id % 10 >= 8 THEN 5 ELSE 4 END AS page_number, CAST((id % 10) * 4 + 1 AS INT) AS line_no, CASE id % 5 WHEN 0 THEN title || ' . . . . . p. ' || CAST(start_page AS STRING) WHEN 1 THEN title || '      ' || CAST(start_page AS STRING) || '-' || CAST(start_page + 2 AS STRING)
          WHEN 2 THEN CAST(start_page AS STRING) || ' / ' || upper(substr(title, 1, 1)) || substr(title, 2) WHEN 3 THEN CAST(start_page AS STRING) ELSE title END AS line FROM v_article WHERE copy = 0
        UNION ALL SELECT id {div} 10, CASE WHEN id % 10 >= 8 THEN 5 ELSE 4 END, CAST((id % 10) * 4 + 2 AS INT), CASE id % 5 WHEN 3 THEN title WHEN 4 THEN CAST(start_page AS STRING) ELSE title || ' and more' END FROM v_article WHERE copy = 0 AND (id % 5 >= 3 OR id % 4 = 0)
        UNION ALL SELECT id {div} 10, CASE WHEN id % 10 >= 8 THEN 5 ELSE 4 END, CAST((id % 10) * 4 + 3 AS INT), CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN 'LE ZOOM' ELSE 'in short' END FROM v_article WHERE copy = 0 AND id % 7 < 3
        UNION ALL SELECT id {div} 10, 4, 0, 'SOMMAIRE' FROM v_article WHERE copy = 0 AND id % 20 = 0
        UNION ALL SELECT id {div} 10, CAST(1 + id % 10 AS INT), 1000, 'Archive ' || CAST(id {div} 10 AS STRING) || ' ... ' || CAST(1 + id % 10 AS STRING) FROM v_article WHERE copy = 0
        UNION ALL SELECT id {div} 10, CAST(1 + id % 10 AS INT), 900, 'prose about ' || title FROM v_article WHERE copy = 0)""",
    # pages of contents as word boxes: one column, two columns on common lines, or blocks side by side that are stored the wrong way round
    "v_toc_place": """SELECT magazine_id, page_number, line, layout, r, CASE layout WHEN 1 THEN CASE WHEN r >= half THEN 1 ELSE 0 END WHEN 2 THEN (r {div} 4) % 2 ELSE 0 END AS side, CASE layout WHEN 1 THEN r % half ELSE r END AS row_no
        FROM (SELECT magazine_id, page_number, line, magazine_id % 3 AS layout, row_number() OVER (PARTITION BY magazine_id, page_number ORDER BY line_no) - 1 AS r, (count(*) OVER (PARTITION BY magazine_id, page_number) + 1) {div} 2 AS half FROM v_toc_line WHERE page_number IN (4, 5))""",
    "v_toc_word": """SELECT magazine_id, page_number, CAST(CASE layout WHEN 2 THEN (r {div} 8) * 2 + 1 - side ELSE 0 END AS INT) AS block, CAST(CASE layout WHEN 2 THEN r % 4 ELSE row_no END AS INT) AS line,
        CAST(CASE layout WHEN 2 THEN ((r {div} 8) * 2 + 1 - side) * 1000 + (r % 4) * 100 ELSE row_no * 100 + side * 50 END + i AS INT) AS n, w AS text, CAST(side * 320 + i * 12 AS DOUBLE) AS x0, CAST(side * 320 + i * 12 + 10 AS DOUBLE) AS x1,
        CAST(CASE layout WHEN 2 THEN (r {div} 8) * 60 + (r % 4) * 12 ELSE row_no * 12 END AS DOUBLE) AS y0, CAST(CASE layout WHEN 2 THEN (r {div} 8) * 60 + (r % 4) * 12 ELSE row_no * 12 END + 10 AS DOUBLE) AS y1 FROM ({toc_words})""",
    "v_theme": "SELECT * FROM (VALUES (1, 'Hardware'), (2, 'Colour'), (3, 'Size'), (4, 'Temperature'), (5, 'Empty')) AS t(id, name)",
    "v_subtheme": """SELECT id, theme_id, name, {keywords} AS keywords FROM (SELECT * FROM (VALUES (10, 1, 'Rings', 'ring|anvil'), (11, 1, 'Bolts', 'bolt|rod'), (12, 1, 'Gear', 'géar|gizmo'),
        (20, 2, 'Red', 'red'), (21, 2, 'Blue', 'blue'), (30, 3, 'Small gizmo', 'small gizmo|Large  Bolt'), (40, 4, 'Hot', 'hot|zzz'), (41, 4, 'Sterile', 'quark|bol'), (42, 4, 'Blank', ' |cold')) AS t(id, theme_id, name, k)
        UNION ALL SELECT 100 + CAST(substr(p_brand, 7) AS INT), 3, p_brand, min(p_name) || '|' || max(p_name) FROM part GROUP BY p_brand)""",
    "v_link": """SELECT 20 AS subtheme_id, id AS article_id, 'mots_cles' AS source FROM v_article WHERE title LIKE 'red%' AND id % 3 <> 0
        UNION ALL SELECT 21, id, 'mots_cles' FROM v_article WHERE title LIKE 'blue%' AND id % 4 <> 0
        UNION ALL SELECT 10, id, 'mots_cles' FROM v_article WHERE title LIKE '%ring' AND id % 5 <> 0
        UNION ALL SELECT 40, id, 'gemini' FROM v_article WHERE id % 20 = 0""",
    "v_tag": "SELECT * FROM (VALUES (1, 'science'), (2, 'history'), (3, 'travel'), (4, 'garden'), (5, 'music')) AS t(id, name)",
    "v_collection_tag": "SELECT c.id AS collection_id, t.id AS tag_id FROM v_collection c JOIN v_tag t ON (c.id + t.id) % 3 = 0",
    "v_scan": """SELECT CASE WHEN id % 7 = 0 THEN 'moved/' || file_path ELSE file_path END AS path, file_hash, file_size AS size, created_s + CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END AS mtime, id
        FROM v_magazine WHERE id % 13 <> 0 AND id % 4 <> 0 OR id % 44 = 0""",
    "v_known": "SELECT id, file_path AS path, file_hash, file_size AS size, created_s AS mtime FROM v_magazine WHERE id % 3 <> 0",
    "v_request": "SELECT event_id AS id, ts, user_id AS account, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events",
    "v_user": "SELECT c_custkey AS id, c_name AS email, CAST(c_custkey % 60 AS INT) AS days_ago FROM customer",
    "v_error": """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'Error: cannot read /var/lib/archive/issue' || CAST(event_id AS STRING) || '.pdf' || {nl} || 'INFO start' || {nl} || '  at line 3'
        WHEN 1 THEN 'INFO one' || {nl} || 'WARNING: page ' || CAST(event_id % 7 AS STRING) || ' is empty' || {nl} || 'failed: no text' WHEN 2 THEN 'INFO only' ELSE '' END AS message FROM events""",
}


def _needed(name: str) -> list[str]:
    """The views that ``name`` stands on, itself last."""
    out: list[str] = []
    text = VIEWS[name] + "".join(DIALECTS["spark"][part] for part in ("pages", "words", "toc_words") if "{" + part + "}" in VIEWS[name])
    for other in VIEWS:
        if other != name and re.search(rf"\b{other}\b", text.replace("{doc_lines}", "")):
            out += [x for x in _needed(other) if x not in out]
    return [*out, name]


def _with(dialect: str, names: list[str]) -> list[str]:
    order: list[str] = []
    for name in names:
        order += [x for x in _needed(name) if x not in order]
    spelt = []
    for name in order:
        sql = VIEWS[name]
        for k, v in DIALECTS[dialect].items():
            sql = sql.replace("{" + k + "}", v)
        spelt.append(f"{name} AS ({sql})")
    return spelt


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame over the tables of ``sf_dir``."""
    tables = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES]
    return spark.sql("WITH " + ", ".join(tables + _with("spark", [name])) + f" SELECT * FROM {name}")


def duck(sql: str) -> str:
    """``sql`` with a WITH clause for the views it names."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    clause = ", ".join(_with("duck", names))
    own = re.match(r"\s*WITH( RECURSIVE)?\b", sql)
    if own and clause:
        return f"WITH{own[1] or ''} {clause}, {sql[own.end() :]}"
    return f"WITH {clause} {sql}" if clause else sql
