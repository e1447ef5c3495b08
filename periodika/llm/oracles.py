"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i2 AS (SELECT item, least(13, len(w)) AS n, w FROM iw WHERE len(w) > 0),
i3 AS (SELECT item, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM i2),
win AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS words FROM i3),
dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d2 AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
d3 AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS words FROM d2),
hit AS (SELECT d3.doc_id, d3.n, d3.p, win.item FROM d3 JOIN win ON win.n = d3.n AND win.words = d3.words),
pos AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS spot FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP4 = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
sized AS (SELECT sh.*, n.n FROM sh JOIN n USING (doc_id)),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least_ AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, dw.doc_id) AS component_id, coalesce(c, dw.doc_id) = dw.doc_id AS kept FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS held FROM p WHERE b >= 100 GROUP BY d HAVING count(*) > 1)
SELECT page_id, b AS payload_bytes, p.d AS payload_digest, CASE WHEN held <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN held <> page_id THEN held END AS refers_to, true AS verified FROM p LEFT JOIN f ON f.d = p.d AND b >= 100
"""

OP10 = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM t WHERE len(w) >= 3)),
twice AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS spot FROM twice) GROUP BY 1),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT t.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM b WHERE source IS NOT NULL GROUP BY 1),
m AS (SELECT (sum(f) + 0.5) / (sum(n) + 1) AS mean, greatest(0, sum(f * f / n) / sum(n) - pow(sum(f) / sum(n), 2)) AS spread, count(*) / sum(n) AS share FROM h),
v AS (SELECT mean, greatest(0, mean * (1 - mean) / greatest(spread - mean * (1 - mean) * share, 1e-12) - 1) AS weight FROM m),
r AS (SELECT source, (f + mean * weight) / (n + weight) AS rate FROM h, v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(rate, 0) <= 0.5 AS kept FROM b LEFT JOIN r USING (source)
"""

ORACLES = {"op2_decontaminate": OP2, "op4_minhash_near_dedup": OP4, "op6_warc": OP6, "op10_quality_rules": OP10}

_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"


def op8_sql() -> str:
    """Rules and as many rounds of trust and distrust as convergence can take, each a view of its own."""
    from .url_filter import DAMPING, LEAST, MOST_ROUNDS, RATIO, RULES

    ordered = sorted(RULES, key=lambda r: -len(r.name))
    fits = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, what)}'" for r in ordered) + " END"
    views = [
        f"u AS (SELECT page_id, html, {_HOST} AS host, {_PATH} AS path FROM pages)",
        f"j AS (SELECT page_id, html, host, path, {fits('name')} AS rule, {fits('verdict')} AS verdict FROM u)",
        "c AS (SELECT host, CAST(count(*) FILTER (verdict = 'allow') AS DOUBLE) AS a, CAST(count(*) FILTER (verdict = 'block') AS DOUBLE) AS b FROM j WHERE host <> '' GROUP BY 1)",
        r"""l0 AS (SELECT host AS src, lower(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:[a-z]+:)?//([^/?#"''<>\s]+)', 1))) AS dst FROM u)""",
        "l AS (SELECT src, dst, count(*) AS n FROM l0 WHERE src <> '' AND src <> dst GROUP BY 1, 2)",
        "names AS (SELECT host FROM c UNION SELECT dst FROM l)",
        "up AS (SELECT host AS src, array_to_string(string_split(host, '.')[i:], '.') AS dst FROM (SELECT host, unnest(range(2, len(string_split(host, '.')) + 1)) AS i FROM names))",
        "fam AS (SELECT src, dst, 1 AS n FROM up WHERE dst IN (SELECT host FROM names))",
        "e AS (SELECT src, dst, CAST(sum(n) AS DOUBLE) AS n FROM (FROM l UNION ALL FROM fam UNION ALL SELECT dst, src, n FROM fam) GROUP BY 1, 2)",
        "fw AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM e)",
        "bw AS (SELECT dst AS src, src AS dst, n / sum(n) OVER (PARTITION BY dst) AS share FROM e)",
    ]
    for way, edges, column in (("t", "fw", "a"), ("d", "bw", "b")):
        views.append(f"{way}s AS (SELECT names.host, coalesce({column} / nullif((SELECT sum({column}) FROM c), 0), 0) AS seed FROM names LEFT JOIN c USING (host))")
        views.append(f"{way}0 AS (SELECT host, seed AS rank FROM {way}s)")
        for i in range(MOST_ROUNDS):
            got = f"SELECT x.dst AS host, sum(r.rank * x.share) AS got FROM {edges} x JOIN {way}{i} r ON r.host = x.src GROUP BY 1"
            views.append(f"{way}{i + 1} AS MATERIALIZED (SELECT s.host, {1 - DAMPING!r} * seed + {DAMPING!r} * coalesce(got, 0) AS rank FROM {way}s s LEFT JOIN ({got}) USING (host))")
        views.append(f"{way} AS (SELECT host, coalesce(rank / nullif((SELECT sum(rank) FROM {way}{MOST_ROUNDS}), 0), 0) AS rank FROM {way}{MOST_ROUNDS})")
    bad = f"SELECT t.host FROM t JOIN d USING (host) WHERE d.rank > {RATIO} * t.rank AND d.rank > {LEAST} / (SELECT count(*) FROM names)"
    return "WITH " + ",\n".join(views) + f"\nSELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN ({bad}) THEN 'block' ELSE 'allow' END) AS verdict FROM j"


ORACLES["op8_url_filter"] = op8_sql()

OP11 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (SELECT pos.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score FROM pos JOIN s USING (anchor_id)
  WHERE s.label <> pos.own AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank FROM neg)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 10
"""


def op13_sql(levels: int = 7, top_levels: int = 4) -> str:
    """The tree level by level: 8^levels documents of a language, 8^top_levels languages."""

    def spelt(*values: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({v} AS VARCHAR)) AS VARCHAR) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"

    lowered = "CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    views = [
        """k AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS step, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
UNION ALL SELECT doc_id, s, step + 1, CASE WHEN step % 9 = 0 THEN xor(crc, CAST(ascii(s[step // 9 + 1]) AS BIGINT)) ELSE xor(crc >> 1, CAST(3988292384 AS BIGINT) * (crc & 1)) END FROM k WHERE step < 9 * len(s))""",
        "c AS (SELECT doc_id, xor(crc, CAST(4294967295 AS BIGINT)) AS crc FROM k WHERE step = 9 * len(s))",
        f"d AS (SELECT documents.doc_id, lang, {spelt('documents.doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf, {spelt('documents.doc_id', 'source', 'lang', 'n_chars', lowered)} AS presented FROM documents LEFT JOIN c USING (doc_id))",
        "n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "t0 AS (SELECT lang, pos, n, leaf AS h FROM n)",
        "x0 AS (SELECT doc_id, lang, leaf, pos, n, presented AS fold, '' AS proof FROM n)",
    ]

    def level(t: str, x: str, i: int, group: str, carried: str) -> None:
        same = f"r.{group} IS NOT DISTINCT FROM x.{group} AND r.run = x.pos // 8 AND x.n > 1"
        left, right = "coalesce(array_to_string(r.hs[1 : x.pos % 8], ''), '')", "coalesce(array_to_string(r.hs[x.pos % 8 + 2 :], ''), '')"
        views.append(f"{t}r{i} AS MATERIALIZED (SELECT {group}, pos // 8 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {t}{i} WHERE n > 1 GROUP BY {group}, pos // 8)")
        views.append(f"{t}{i + 1} AS (SELECT {group}, run AS pos, (n + 7) // 8 AS n, sha256(array_to_string(hs, '')) AS h FROM {t}r{i} UNION ALL SELECT * FROM {t}{i} WHERE n <= 1)")
        views.append(
            f"{x}{i + 1} AS MATERIALIZED (SELECT {carried}, x.pos // 8 AS pos, (x.n + 7) // 8 AS n, CASE WHEN x.n > 1 THEN sha256({left} || x.fold || {right}) ELSE x.fold END AS fold, x.proof || {left} || {right} AS proof "
            f"FROM {x}{i} x LEFT JOIN {t}r{i} r ON {same})"
        )

    for i in range(levels):
        level("t", "x", i, "lang", "x.doc_id, x.lang, x.leaf")
    views.append(f"u0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h, lang FROM t{levels})")
    views.append("v0 AS (SELECT g, pos, n, h FROM u0)")
    views.append(f"y0 AS (SELECT x.doc_id, x.leaf, u0.h AS subroot, 0 AS g, u0.pos, u0.n, x.fold, x.proof FROM x{levels} x JOIN u0 ON u0.lang IS NOT DISTINCT FROM x.lang)")
    for i in range(top_levels):
        level("v", "y", i, "g", "x.doc_id, x.leaf, x.subroot, x.g")
    root = f"(SELECT h FROM v{top_levels})"
    return "WITH RECURSIVE " + ",\n".join(views) + f"\nSELECT doc_id, leaf, subroot, {root} AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = {root} AS verified FROM y{top_levels}"


ORACLES |= {"op11_hard_negatives": OP11, "op13_merkle_manifest": op13_sql()}
