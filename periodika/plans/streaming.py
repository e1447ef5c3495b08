"""Registered queries: streaming jobs over the events table, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.stored import fresh_folder
from ..streaming import jobs as J
from ..streaming.ingest import Ingestion
from .contents import _ENTRIES, _KINDS, _PAGES, _SCORES
from .fixtures import _TITLE
from .registry import query, shared_folder
from .taxonomy import _KEYWORDS, _NORM

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _events(v):
    e = v.table("events")
    return e.withColumn("ts", e["ts"].cast("timestamp"))


def _event_stream(v, files: int | None = 64):
    """``files``: those of a micro-batch; all are one where None is given, for what goes by the order of time, which files need not have."""
    e = v.spark.readStream.schema(v.table("events").schema)
    e = (e.option("maxFilesPerTrigger", files) if files else e).parquet(f"{v.sf_dir}/events.parquet*")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _requests(e):
    return e.select(F.col("event_id").alias("id"), "ts", F.col("user_id").alias("account"), F.floor(F.col("value") * 100).cast("long").alias("tokens"))


_MINUTES = "SELECT strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, account, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens FROM v_request GROUP BY 1, 2"


@query("st1_rate_windows", _MINUTES)
def _(v):
    return J.rate_windows(_requests(_events(v))).withColumn("minute", F.date_format("minute", _STAMP))


_ENDED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"  # windows that the watermark has passed


@query("st1_rate_windows_stream", f"SELECT * FROM ({_MINUTES}) WHERE CAST(minute AS TIMESTAMP) + INTERVAL 1 MINUTE <= {_ENDED}")
def _(v):
    out = J.run_available(v.spark, J.rate_windows(_requests(_event_stream(v))), shared_folder(v.spark))
    return out.withColumn("minute", F.date_format("minute", _STAMP))


@query("st1_day_counts", "SELECT CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) AS STRING) AS day, account, count(*) AS requests FROM v_request GROUP BY 1, 2")
def _(v):
    return J.day_counts(_requests(_events(v))).withColumn("day", F.col("day").cast("string"))


@query("st2_violations", f"SELECT * FROM ({_MINUTES}) WHERE requests > 1 OR tokens > 15000")
def _(v):
    return J.violations(_requests(_events(v)), 1, 15000).withColumn("minute", F.date_format("minute", _STAMP))


def _with_rocksdb(v, run):
    """``run`` with the state store that processors of their own need."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = v.spark.conf.get(provider)
    v.spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        v.spark.conf.set(provider, before)


# Each account's requests in the order of time; a step knows the minute, the day, what they hold so far and the end of a pause.
_ADMIT = """WITH RECURSIVE q AS (SELECT *, epoch_us(ts) // 60000000 AS m, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS d, row_number() OVER (PARTITION BY account ORDER BY ts, id) AS r FROM v_request),
    st AS (SELECT account, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS id, CAST(-1 AS BIGINT) AS m, CAST(0 AS BIGINT) AS n, CAST(0 AS HUGEINT) AS tok, DATE '1970-01-01' AS d, CAST(0 AS BIGINT) AS today, TIMESTAMP '1970-01-01 00:00:00' AS pause, CAST(NULL AS VARCHAR) AS reason FROM v_request GROUP BY account
      UNION ALL SELECT account, r, id, m, CASE WHEN reason IS NULL THEN n + 1 ELSE n END, CASE WHEN reason IS NULL THEN tok + tokens ELSE tok END, d, CASE WHEN reason IS NULL THEN today + 1 ELSE today END,
        CASE reason WHEN 'day' THEN timezone('UTC', timezone('America/Los_Angeles', CAST(d + 1 AS TIMESTAMP))) WHEN 'minute' THEN date_trunc('minute', ts) + INTERVAL 1 MINUTE ELSE pause END, reason
      FROM (SELECT *, CASE WHEN ts < pause THEN 'pause' WHEN today >= 4 THEN 'day' WHEN n >= 5 OR tok + tokens > 15000 THEN 'minute' END AS reason
        FROM (SELECT q.account, q.r, q.id, q.m, q.d, q.ts, q.tokens, CASE WHEN q.m = st.m THEN st.n ELSE 0 END AS n, CASE WHEN q.m = st.m THEN st.tok ELSE 0 END AS tok, CASE WHEN q.d = st.d THEN st.today ELSE 0 END AS today, st.pause FROM st JOIN q ON q.account = st.account AND q.r = st.r + 1)))
    SELECT account, id, reason IS NULL AS admitted, reason, CASE WHEN reason IS NOT NULL THEN strftime(pause, '%Y-%m-%d %H:%M:%S') END AS until FROM st WHERE r > 0"""


@query("st2_admit_stream", _ADMIT)
def _(v):
    out = _with_rocksdb(v, lambda: J.run_available(v.spark, J.admit(_requests(_event_stream(v, None)), 5, 15000, 6), shared_folder(v.spark)))
    return out.select("account", "id", "admitted", "reason", F.date_format("until", _STAMP).alias("until"))


@query("st2_admit_batches", _ADMIT)
def _(v):
    """The same by sorted batches, for accounts of any size."""
    out = J.admit_batches(v.spark, _requests(_event_stream(v, None)), fresh_folder(v.spark, "admission"), "quota", 5, 15000, 6)
    return out.select("account", "id", "admitted", "reason", F.date_format("until", _STAMP).alias("until"))


def _observed(e):
    return e.select(F.concat(F.lit("f"), (F.col("event_id") % 2).cast("string")).alias("path"), F.floor(F.col("event_id") / 4).alias("size"), F.lit(0).alias("mtime"), "ts")


_STABLE = """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, path, min(size) AS size FROM (SELECT unnest([time_bucket(INTERVAL '5 minutes', ts), time_bucket(INTERVAL '5 minutes', ts) - INTERVAL 5 MINUTE]) AS start, 'f' || CAST(event_id % 2 AS STRING) AS path, event_id // 4 AS size, ts FROM events)
    GROUP BY start, path HAVING min(size) = max(size) AND max(ts) - min(ts) >= INTERVAL 8 SECOND"""


@query("st3_stable_files", _STABLE)
def _(v):
    return J.stable_file_stream(_observed(_events(v))).withColumn("start", F.date_format("start", _STAMP))


@query("st3_stable_file_stream", f"SELECT * FROM ({_STABLE}) WHERE CAST(start AS TIMESTAMP) + INTERVAL 10 MINUTE <= {_ENDED}")
def _(v):
    return J.run_available(v.spark, J.stable_file_stream(_observed(_event_stream(v))), shared_folder(v.spark)).withColumn("start", F.date_format("start", _STAMP))


@query("st4_dedupe_stream", "SELECT sha256(event_type || CAST(user_id AS STRING)) AS file_hash, min(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END) AS scan FROM events GROUP BY 1")
def _(v):
    """Two scans of a folder that grows between them: what the first one found doesn't come again."""
    folder = fresh_folder(v.spark, "scans")
    files = _events(v).select("ts", F.sha2(F.concat("event_type", F.col("user_id").cast("string")), 256).alias("file_hash"), (F.col("event_id") % 3 == 0).alias("early"))
    first = None
    for early in (True, False):
        files.filter(F.col("early") == early).drop("early").write.mode("append").parquet(f"{folder}/files")
        stream = v.spark.readStream.schema("ts timestamp, file_hash string").parquet(f"{folder}/files")
        found = J.dedupe_files(v.spark, stream, folder, "scan")
        first = found.agg(F.max("batch")).first()[0] if early else first
    return found.select("file_hash", F.when(F.col("batch") <= first, 1).otherwise(2).alias("scan"))


def _ingest(v, parts=(None,)):
    """The documents taken in by one run or, by their id's remainder, in several runs of one name."""
    folder = fresh_folder(v.spark, "ingest")
    contents = v("v_toc_line").groupBy("magazine_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw_text"))
    pages = contents.unionByName(v("v_page").join(contents.select("magazine_id").distinct().hint("merge"), "magazine_id", "left_anti"))
    title = F.expr(_TITLE)
    docs = v.table("documents").select(F.col("doc_id").alias("id"), title.alias("title"), F.concat("source", F.lit("/"), title, F.lit(".pdf")).alias("file_path"), F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    intake = Ingestion(v.spark, f"{folder}/archive", lambda ids: pages.join(ids.hint("merge"), "magazine_id", "left_semi"), v("v_subtheme"), fuzzy=False)
    for part in parts:
        (docs if part is None else docs.filter(F.col("id") % len(parts) == part)).write.mode("append").parquet(f"{folder}/arrived")
        intake.run(v.spark.readStream.schema(docs.schema).parquet(f"{folder}/arrived"), "intake")
    return intake


_INGESTED = f"""doc AS (SELECT m.* FROM v_magazine m JOIN (SELECT min(id) AS id FROM v_magazine WHERE file_hash IS NOT NULL GROUP BY file_hash) USING (id)),
    ing_page AS (SELECT magazine_id, page_number, string_agg(line, chr(10) ORDER BY line_no) AS raw_text FROM v_toc_line JOIN doc ON doc.id = magazine_id GROUP BY 1, 2
      UNION ALL SELECT magazine_id, page_number, raw_text FROM v_page JOIN doc ON doc.id = magazine_id WHERE magazine_id NOT IN (SELECT magazine_id FROM v_toc_line)),
    ing_line AS (SELECT magazine_id, page_number, unnest(range(1, len(l) + 1)) AS line_no, regexp_replace(unnest(l), '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT *, string_split(raw_text, chr(10)) AS l FROM ing_page)),
    {_KINDS.replace("v_toc_line", "ing_line")}, {_PAGES}, {_ENTRIES},
    pl AS (SELECT e.*, l.last_page FROM ent e JOIN tocp USING (magazine_id, page_number) JOIN (SELECT magazine_id, max(page_number) AS last_page FROM ing_page GROUP BY 1) l USING (magazine_id) WHERE title <> '' AND start_page BETWEEN 1 AND last_page),
    art AS (SELECT magazine_id, CAST(magazine_id AS STRING) || '-' || CAST(row_number() OVER w AS STRING) AS article_id, CAST(row_number() OVER w AS INT) AS position, title, start_page, coalesce(end_page, greatest(start_page, lead(start_page) OVER w - 1), last_page) AS end_page
      FROM pl WINDOW w AS (PARTITION BY magazine_id ORDER BY start_page, page_number, line_no)),
    {_KEYWORDS}, lnk AS (SELECT DISTINCT subtheme_id, article_id, magazine_id FROM kw JOIN art ON regexp_matches({_NORM.format('title')}, pattern))"""


@query("st5_ingest_documents", f"""WITH {_INGESTED} SELECT id AS magazine_id, split_part(file_path, '/', 1) AS collection, CASE id % 11 WHEN 0 THEN 'hs' WHEN 1 THEN 'sp' ELSE 'normal' END AS issue_type, CAST(100 + id % 800 AS STRING) AS issue_number,
    strftime(CASE WHEN id % 6 = 5 THEN make_date(CAST(nullif(regexp_extract(first_page, '\\b((?:19|20)\\d{{2}})\\b', 1), '') AS INT), 1, 1) ELSE make_date(CAST(1990 + id % 30 AS INT), CASE WHEN id % 6 = 4 THEN 1 ELSE CAST(1 + id % 12 AS INT) END, 1) END, '%Y-%m-%d') AS publication_date,
    CASE WHEN id % 6 IN (0, 2, 3) OR (id % 6 = 1 AND issue_month_label = 'Avril') THEN issue_month_label WHEN id % 6 = 1 THEN issue_month_label || '-Avril' END AS issue_month_label, 'done' AS scan_status
    FROM doc LEFT JOIN (SELECT magazine_id, raw_text AS first_page FROM ing_page WHERE page_number = 1) c ON c.magazine_id = doc.id""")
def _(v):
    return _ingest(v).current("documents").select("magazine_id", "collection", "issue_type", "issue_number", F.date_format("publication_date", "yyyy-MM-dd").alias("publication_date"), "issue_month_label", "scan_status")


@query("st5_ingest_pages", f"""WITH {_INGESTED}, c AS (SELECT magazine_id, page_number, raw_text, length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g')) < 20 AS short, list_reverse_sort([{_SCORES}]) AS s FROM (SELECT *, regexp_extract_all(lower(raw_text), '\\pL+') AS t FROM ing_page)),
    r AS (SELECT *, greatest(list_sum(list_transform(s, lambda x: x.s)), 1) AS total FROM c)
    SELECT magazine_id, page_number, raw_text, CASE WHEN short OR s[1].s = 0 THEN NULL WHEN s[1].l NOT IN ('fr', 'en') OR (s[2].l IN ('fr', 'en') AND s[2].s / total > 0.3) THEN 'mixed' ELSE s[1].l END AS language FROM r""")
def _(v):
    return _ingest(v).current("pages")


@query("st5_ingest_contents", f"""WITH {_INGESTED}, p AS (SELECT magazine_id, string_agg(CAST(page_number AS STRING), ', ' ORDER BY page_number) AS pages FROM tocp GROUP BY 1), n AS (SELECT DISTINCT magazine_id, true AS has FROM pl)
    SELECT id AS magazine_id, CASE WHEN has IS NULL AND pages IS NOT NULL THEN 'failed' ELSE 'done' END AS toc_status, CASE WHEN has THEN NULL WHEN pages IS NOT NULL THEN 'Sommaire détecté (page ' || pages || ') mais aucune entrée n''a pu en être lue.'
    ELSE 'Aucune page de sommaire n''a été identifiée dans ce numéro.' END AS message FROM doc LEFT JOIN p ON p.magazine_id = id LEFT JOIN n ON n.magazine_id = id""")
def _(v):
    return _ingest(v).current("contents")


@query("st5_ingest_articles", f"WITH {_INGESTED} SELECT * FROM art")
def _(v):
    return _ingest(v).current("articles")


@query("st5_ingest_stream", f"WITH {_INGESTED} SELECT subtheme_id, article_id FROM lnk")
def _(v):
    """The keyword links of all that was taken in."""
    return _ingest(v).current("links").select("subtheme_id", "article_id")


@query("st5_ingest_orphans", f"WITH {_INGESTED} SELECT magazine_id, article_id, title FROM art WHERE article_id NOT IN (SELECT article_id FROM lnk)")
def _(v):
    return _ingest(v).current("orphans")


@query("st5_incremental_links", f"""WITH {_INGESTED.replace("SELECT min(id) AS id FROM", "SELECT CASE WHEN count(*) FILTER (id % 2 = 0) = 0 THEN min(id) END AS id FROM")} SELECT subtheme_id, article_id FROM lnk""")
def _(v):
    """The second of two runs: its new documents only, of which the first run has stored none by content."""
    out = _ingest(v, (0, 1)).table("links")
    return out.filter(F.col("batch") > 0).select("subtheme_id", "article_id")


_LOGINS = "SELECT strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id % 10 AS key, count(*) AS attempts, count(*) > 1 AS blocked FROM events GROUP BY 1, 2"


@query("st6_login_windows", _LOGINS)
def _(v):
    return J.login_windows(_events(v).withColumn("key", F.col("user_id") % 10), 1).withColumn("start", F.date_format("start", _STAMP))


@query("st6_login_windows_stream", f"SELECT * FROM ({_LOGINS}) WHERE CAST(start AS TIMESTAMP) + INTERVAL 15 MINUTE <= {_ENDED}")
def _(v):
    stream = J.login_windows(_event_stream(v).withColumn("key", F.col("user_id") % 10), 1)
    return J.run_available(v.spark, stream, shared_folder(v.spark)).withColumn("start", F.date_format("start", _STAMP))


_PROGRESS = "SELECT user_id AS document, arg_max(event_id % 100, (ts, event_id)) AS current, 100 AS total FROM events GROUP BY 1"


def _updates(e):
    return e.select(F.col("user_id").alias("document"), F.col("event_id").alias("id"), (F.col("event_id") % 100).alias("current"), F.lit(100).alias("total"), "ts")


@query("st7_progress", _PROGRESS)
def _(v):
    return J.progress(_updates(_events(v)))


@query("st7_progress_stream", _PROGRESS)
def _(v):
    return J.run_available(v.spark, J.progress(_updates(_event_stream(v))), shared_folder(v.spark), "complete")


_LASTS = "SELECT user_id AS document, max(ts) AS ts, arg_max(event_id % 100, (ts, event_id)) AS current FROM events GROUP BY 1"


@query("st7_progress_states", f"""WITH l AS ({_LASTS}) SELECT document, current, 90 AS total, CASE WHEN current >= 90 THEN 'done' ELSE 'running' END AS state FROM l
    UNION ALL SELECT document, current, 90, 'forgotten' FROM l WHERE current < 90 AND ts + INTERVAL 1 HOUR <= {_ENDED}""")
def _(v):
    """What becomes of each document: running or done, and forgotten an hour of event time after its last update."""
    updates = _updates(_event_stream(v)).select("document", "id", "ts", "current", F.lit(90).cast("long").alias("total"))
    return _with_rocksdb(v, lambda: J.run_available(v.spark, J.progress_stream(updates), shared_folder(v.spark), "update"))


@query("st1_late_rows", """WITH p AS (SELECT ts, event_id * 7919 % 1000 // 250 AS batch FROM events), w AS (SELECT batch, max(ts) AS last FROM p GROUP BY 1), m AS (SELECT batch, max(last) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 MINUTE AS mark FROM w)
    SELECT batch, count(*) AS rows, count(*) FILTER (NOT coalesce(time_bucket(INTERVAL '1 minute', ts) + INTERVAL 1 MINUTE <= mark, false)) AS kept, count(*) FILTER (time_bucket(INTERVAL '1 minute', ts) + INTERVAL 1 MINUTE <= mark) AS late FROM p JOIN m USING (batch) GROUP BY 1""")
def _(v):
    """Events that arrive in four files in no order of time, one after another, and what windows of a minute keep of them."""
    folder, part = fresh_folder(v.spark, "late"), F.floor(F.col("event_id") * 7919 % 1000 / 250)
    for i in range(4):
        _events(v).filter(part == i).select("ts").coalesce(1).write.mode("append").parquet(f"{folder}/events")
        stream = v.spark.readStream.schema("ts timestamp").parquet(f"{folder}/events")
        out = J.count_late(v.spark, stream, folder, "minutes")
    return out.select("batch", "rows", "kept", "late")


@query("st8_job_pauses", """SELECT id, reason, strftime(CASE reason WHEN 'quota_day' THEN CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) + 1 AS TIMESTAMP) + INTERVAL 8 HOUR WHEN 'quota_minute' THEN CASE WHEN id % 2 = 0 THEN ts + INTERVAL '8.5 seconds' ELSE date_trunc('minute', ts) + INTERVAL 1 MINUTE END
    WHEN 'api_error' THEN ts + INTERVAL 15 MINUTE ELSE ts + INTERVAL 60 MINUTE END, '%Y-%m-%d %H:%M:%S') AS until FROM (SELECT event_id AS id, ts, CASE event_id % 7 WHEN 0 THEN 'quota_day' WHEN 1 THEN 'quota_minute' WHEN 2 THEN 'model_unknown' WHEN 3 THEN 'key_refused' WHEN 4 THEN 'key_refused' WHEN 5 THEN CASE WHEN event_id % 4 = 3 THEN 'bad_format' END ELSE 'api_error' END AS reason FROM events)
    WHERE reason IS NOT NULL""")
def _(v):
    k = F.col("event_id") % 7
    code = F.element_at(F.array(*map(F.lit, (429, 429, 404, 403, 400, 200, 500))), (k + 1).cast("int"))
    text = F.when(k == 0, "limit PerDay").when((k == 1) & (F.col("event_id") % 2 == 0), "retryDelay: 7.5s").when(k == 4, "bad API key").otherwise("other")
    attempts = _events(v).select(F.col("event_id").alias("id"), F.col("ts").alias("at"), code.alias("code"), text.alias("message"), (F.col("event_id") % 4).alias("streak"))
    return J.job_pauses(attempts).filter("reason IS NOT NULL").select("id", "reason", F.date_format("until", _STAMP).alias("until"))


@query("st9_activity", """WITH d AS (SELECT unnest(range(CAST(min(CAST(ts AS DATE)) - 6 AS TIMESTAMP), CAST(max(CAST(ts AS DATE)) + 1 AS TIMESTAMP), INTERVAL 1 DAY)) AS start FROM events)
    SELECT strftime(start, '%Y-%m-%d') AS start, count(*) AS events, round(sum(value), 4) AS value FROM d JOIN events ON ts >= start AND ts < start + INTERVAL 7 DAY GROUP BY 1""")
def _(v):
    return J.activity(_events(v)).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "events", F.round("value", 4).alias("value"))


@query("st9_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 300 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS events FROM s GROUP BY user_id, s""")
def _(v):
    return J.sessions(_events(v), "300 minutes").withColumn("start", F.date_format("start", _STAMP))
