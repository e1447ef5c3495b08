"""Streaming jobs of the archive. Windowed ones are plain DataFrame functions that run on tables and on streams alike.

Late data: watermark of ten minutes, rows behind it are dropped. State that a job keeps is bounded by its watermark or by its
number of keys. ``run_available`` drives a stream over what is there now, with its checkpoint in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.stored import Files, HashStore, Unit

LATE = "10 minutes"
PACIFIC = "America/Los_Angeles"


def pacific_day(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, PACIFIC))


def next_pacific_midnight(ts: Column) -> Column:
    """The next midnight in the Pacific zone, as UTC."""
    return F.to_utc_timestamp(F.date_add(pacific_day(ts), 1).cast("timestamp"), PACIFIC)


def next_minute(ts: Column) -> Column:
    return F.date_trunc("minute", ts) + F.expr("INTERVAL 1 MINUTE")


def rate_windows(requests: DataFrame) -> DataFrame:
    """ST1. Requests and tokens of each account in each minute (account, ts, tokens)."""
    w = F.window("ts", "1 minute")
    return requests.withWatermark("ts", LATE).groupBy(w, "account").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens")).select(F.col("window.start").alias("minute"), "account", "requests", "tokens")


def day_counts(requests: DataFrame) -> DataFrame:
    """ST1. Requests of each account on each Pacific day."""
    return requests.groupBy(pacific_day(F.col("ts")).alias("day"), "account").agg(F.count("*").alias("requests"))


def violations(requests: DataFrame, per_minute: int, tokens_a_minute: int) -> DataFrame:
    """ST2, without state: minutes in which an account asked for more than its limits."""
    return rate_windows(requests).filter((F.col("requests") > per_minute) | (F.col("tokens") > tokens_a_minute))


#: Seconds that an account's counters are kept: a day and two hours.
KEPT = 26 * 3600
_STATE = "minute long, requests int, tokens long, day string, today int, pause long"
ADMITTED = T.StructType([T.StructField("account", T.LongType()), T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("admitted", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("until", T.TimestampType())])


class Admission(StatefulProcessor):
    """Quotas of one account: a pause that holds, then the day, then the minute's requests, then its tokens. A refusal isn't counted.

    A request of a minute before the account's last one is late: it is refused as such and changes nothing. An account's state ends when the
    watermark is ``KEPT`` past its last minute.
    """

    def __init__(self, per_minute: int, tokens_a_minute: int, per_day: int, reserve: int = 2):
        self.per_minute, self.tokens_a_minute, self.per_day = per_minute, tokens_a_minute, max(per_day - reserve, 0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("quota", _STATE)
        self.handle = handle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["ts", "id"])  # what one micro-batch has of one account
        minute, requests, tokens, day, today, pause = self.state.get() if self.state.exists() else (-1, 0, 0, "", 0, 0)
        out = []
        for r in part.itertuples(index=False):
            at = pd.Timestamp(r.ts)
            at = at.tz_localize("UTC") if at.tzinfo is None else at.tz_convert("UTC")
            local = at.tz_convert(PACIFIC)
            if int(at.timestamp()) // 60 < minute:
                out.append((key[0], r.id, at.tz_localize(None), False, "late", None))
                continue
            if int(at.timestamp()) // 60 != minute:
                minute, requests, tokens = int(at.timestamp()) // 60, 0, 0
            if str(local.date()) != day:
                day, today = str(local.date()), 0
            reason, until = None, None
            if at.timestamp() < pause:
                reason, until = "pause", pd.Timestamp(pause, unit="s", tz="UTC")
            elif today >= self.per_day:
                reason, until = "day", (local.normalize() + pd.Timedelta(hours=36)).normalize().tz_convert("UTC")
            elif requests >= self.per_minute or tokens + r.tokens > self.tokens_a_minute:
                reason, until = "minute", at.floor("min") + pd.Timedelta(minutes=1)
            if reason is None:
                requests, tokens, today = requests + 1, tokens + int(r.tokens), today + 1
            elif reason != "pause":
                pause = int(until.timestamp())
            out.append((key[0], r.id, at.tz_localize(None), reason is None, reason, None if until is None else until.tz_localize(None)))
        self.state.update((minute, requests, tokens, day, today, pause))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((minute * 60 + KEPT) * 1000)
        frame = pd.DataFrame(out, columns=ADMITTED.names)
        frame["until"] = pd.to_datetime(frame["until"])
        yield frame

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def admit(requests: DataFrame, per_minute: int, tokens_a_minute: int, per_day: int) -> DataFrame:
    """ST2. Each request of a stream (account, id, ts, tokens) admitted or refused, why, and until when."""
    return requests.withWatermark("ts", LATE).groupBy("account").transformWithStateInPandas(statefulProcessor=Admission(per_minute, tokens_a_minute, per_day), outputStructType=ADMITTED, outputMode="append", timeMode="eventTime")


_QUOTA = "account long, minute long, requests long, tokens long, day long, today long, pause long"
DECISIONS = "account long, id long, ts timestamp, admitted boolean, reason string, until timestamp"
_MINUTE = 60_000_000


def _decided(per_minute: int, tokens_a_minute: int, per_day: int):
    """The body of a task over rows sorted by account and time: decisions (kind 0), and each account's state after its last row (kind 1)."""

    def run(batches):
        account, state = None, (-1, 0, 0, -1, 0, 0)
        for batch in batches:
            out: list[tuple] = []
            for who, id, at, cost, day, midnight, *stored_state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if who != account:
                    if account is not None:
                        out.append((1, account, None, None, None, None, None, *state))
                    account, state = who, (-1, 0, 0, -1, 0, 0) if stored_state[0] is None else tuple(stored_state)
                minute, requests, tokens, last_day, today, pause = state
                if at // _MINUTE < minute:
                    out.append((0, who, id, at, False, "late", None, *(None,) * 6))
                    continue
                if at // _MINUTE != minute:
                    minute, requests, tokens = at // _MINUTE, 0, 0
                if day != last_day:
                    last_day, today = day, 0
                reason = "pause" if at < pause else "day" if today >= per_day else "minute" if requests >= per_minute or tokens + cost > tokens_a_minute else None
                if reason is None:
                    requests, tokens, today = requests + 1, tokens + cost, today + 1
                elif reason != "pause":
                    pause = midnight if reason == "day" else (minute + 1) * _MINUTE
                out.append((0, who, id, at, reason is None, reason, pause if reason else None, *(None,) * 6))
                state = (minute, requests, tokens, last_day, today, pause)
            if out:
                yield _decision_batch(out)
        if account is not None:
            yield _decision_batch([(1, account, None, None, None, None, None, *state)])

    return run


_DECIDED = {"kind": "int", "who": "long", "id": "long", "at": "long", "admitted": "boolean", "reason": "string", "until": "long"} | dict.fromkeys(("minute", "requests", "tokens", "day", "today", "pause"), "long")
_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _decision_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, kind in zip(zip(*rows, strict=True), _DECIDED.values(), strict=True)], names=list(_DECIDED))


def admit_batches(spark: SparkSession, requests: DataFrame, folder: str, name: str, per_minute: int, tokens_a_minute: int, per_day: int, reserve: int = 2) -> DataFrame:
    """ST2. The decisions (``DECISIONS``) on all requests of a stream (account, id, ts, tokens) that any run of ``name`` has seen.

    As ``admit``, for accounts of any size: each micro-batch is sorted by account and time, which spills to disk, and a task goes through the sorted rows
    Arrow batch by Arrow batch with one account's counters in hand. Counters go from batch to batch in a table, written as one unit with
    the decisions, so a batch that comes again decides the same. An account's counters end ``KEPT`` seconds after its last minute.
    Rows without account or time are left out.
    """
    unit = Unit(spark, f"{folder.rstrip('/')}/{name}-admission")

    def each(batch: DataFrame, number: int) -> None:
        def body() -> None:
            states = unit.last("state", _QUOTA, number)
            rows = batch.filter("account IS NOT NULL AND ts IS NOT NULL").select(
                "account", "id", F.unix_micros("ts").alias("at"), F.coalesce("tokens", F.lit(0)).cast("long").alias("cost"), F.unix_date(pacific_day(F.col("ts"))).cast("long").alias("on"), F.unix_micros(next_pacific_midnight(F.col("ts"))).alias("midnight")
            )
            both = rows.join(states.hint("merge"), "account", "left").select("account", "id", "at", "cost", "on", "midnight", "minute", "requests", "tokens", "day", "today", "pause")
            ordered = both.repartition("account").sortWithinPartitions("account", "at", "id")
            schema = ", ".join(f"{c} {kind}" for c, kind in _DECIDED.items())
            decided = unit.put(ordered.mapInArrow(_decided(per_minute, tokens_a_minute, max(per_day - reserve, 0)), schema), "decided", number)
            unit.put(decided.filter("kind = 0").select(F.col("who").alias("account"), "id", F.timestamp_micros("at").alias("ts"), "admitted", "reason", F.timestamp_micros("until").alias("until")), "decisions", number)
            new = decided.filter("kind = 1").select(F.col("who").alias("account"), *(c.split()[0] for c in _QUOTA.split(", ")[1:]))
            every = new.unionByName(states.join(new.select("account").hint("merge"), "account", "left_anti"))
            last = new.agg(F.max("minute")).first()[0]
            unit.put(every if last is None else every.filter(F.col("minute") >= last - KEPT // 60), "state", number)

        unit.write(number, body)

    run_available(spark, requests, folder, name=name, each=each, keep=False)
    return unit.table("decisions", DECISIONS).drop("batch")


#: Seconds that two observations of a stable file are apart at least.
STABLE_AFTER = 8


def stable_file_stream(observations: DataFrame) -> DataFrame:
    """ST3. Paths observed (path, size, mtime, ts) over ``STABLE_AFTER`` seconds or more within ten minutes, always with one size and time.

    Windows overlap by half, so any two observations up to five minutes apart share one, whatever borders lie between them; a path may
    be stable in two windows.
    """
    seen = F.struct("size", "mtime")
    out = observations.withWatermark("ts", LATE).groupBy(F.window("ts", "10 minutes", "5 minutes"), "path").agg(
        F.min(seen).alias("lo"), F.max(seen).alias("hi"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("apart")
    )
    return out.filter((F.col("lo") == F.col("hi")) & (F.col("apart") >= STABLE_AFTER * 1_000_000)).select(F.col("window.start").alias("start"), "path", F.col("lo.size").alias("size"))


def dedupe_stream(files: DataFrame) -> DataFrame:
    """ST4. The first file of each content hash within the watermark, for streams that go on; ``dedupe_files`` keeps hashes over all runs."""
    return files.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["file_hash"])


def login_windows(attempts: DataFrame, most: int = 5) -> DataFrame:
    """ST6. Attempts of each key in each quarter of an hour, and whether they are too many."""
    out = attempts.withWatermark("ts", LATE).groupBy(F.window("ts", "15 minutes"), "key").agg(F.count("*").alias("attempts"))
    return out.select(F.col("window.start").alias("start"), "key", "attempts", (F.col("attempts") > most).alias("blocked"))


def progress(updates: DataFrame) -> DataFrame:
    """ST7. The last state (current, total) of each document, of a table of updates."""
    return updates.groupBy("document").agg(F.max_by(F.struct("current", "total"), F.struct("ts", "id")).alias("p")).select("document", "p.current", "p.total")


#: Seconds after its last update that a document's progress is forgotten.
FORGOTTEN = 3600
PROGRESS = T.StructType([*(T.StructField(c, T.LongType()) for c in ("document", "current", "total")), T.StructField("state", T.StringType())])
_LAST = "ts long, id long, current long, total long"


class Progress(StatefulProcessor):
    """Where one document stands: its last update, until it is complete or ``FORGOTTEN`` seconds of event time have passed without one.

    Of each micro-batch the last update goes out, as ``running`` or ``done``; what is forgotten goes out once more as such. Both ends
    remove the document's state, so state is as large as what runs. An update older than the last one changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state, self.handle = handle.getValueState("last", _LAST), handle

    def _timer(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at // 1000 + FORGOTTEN * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.state.get() if self.state.exists() else None
        last = before
        for part in rows:  # one row of each frame is kept
            part = part.assign(at=part["ts"].astype("datetime64[us]").astype("int64")).sort_values(["at", "id"])
            r = part.iloc[-1]
            if last is None or (int(r["at"]), int(r["id"])) > (last[0], last[1]):
                last = (int(r["at"]), int(r["id"]), int(r["current"]), int(r["total"]))
        if last is before:
            return
        done = last[2] >= last[3]
        if done:
            self.state.clear()
        else:
            self.state.update(last)
        self._timer(None if done else last[0])
        yield pd.DataFrame([(key[0], last[2], last[3], "done" if done else "running")], columns=PROGRESS.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            last = self.state.get()
            self.state.clear()
            yield pd.DataFrame([(key[0], last[2], last[3], "forgotten")], columns=PROGRESS.names)

    def close(self) -> None:
        pass


def progress_stream(updates: DataFrame) -> DataFrame:
    """ST7. What becomes of each document of a stream of updates (document, id, ts, current, total): ``PROGRESS``, by ``Progress``."""
    return updates.withWatermark("ts", LATE).groupBy("document").transformWithStateInPandas(statefulProcessor=Progress(), outputStructType=PROGRESS, outputMode="update", timeMode="eventTime")


#: last_ts: the latest time of all batches up to this one.
_LATENESS = "rows long, kept long, late long, last_ts timestamp, watermark timestamp"


def count_late(spark: SparkSession, stream: DataFrame, folder: str, name: str, width: str = "1 minute", delay: str = LATE) -> DataFrame:
    """How many rows of each micro-batch are in time for a windowed job of this watermark, and how many are late, with the watermark.

    The watermark of a batch is ``delay`` before the latest time of all earlier batches; a row is late if its window (``width``) had ended by then.
    Both are known from a table with a row for each batch, so that counting goes on over restarts, and a batch that comes again
    counts once. Rows without a time are neither. Spark's own filter applies the watermark of the batch before, so a windowed job keeps at
    least what is counted as kept and may keep late rows of the batch that follows.
    """
    unit = Unit(spark, f"{folder.rstrip('/')}/{name}-late")

    def each(batch: DataFrame, number: int) -> None:
        def body() -> None:
            before = unit.last("lateness", _LATENESS, number).first()  # one row
            last = F.lit(before["last_ts"] if before else None).cast("timestamp")
            mark = last - F.expr(f"INTERVAL {delay}")
            # windows of rows without a time aren't asked for: Spark would leave these rows out
            late = F.coalesce(F.window(F.coalesce("ts", F.lit(0).cast("timestamp")), width)["end"] <= mark, F.lit(False))
            timed = batch.withColumn("late", F.when(F.col("ts").isNotNull(), late))
            counts = timed.agg(F.count("*").alias("rows"), F.count_if(~F.col("late")).alias("kept"), F.count_if("late").alias("late"), F.greatest(F.max("ts"), last).alias("last_ts"))
            unit.put(counts.select("rows", "kept", "late", "last_ts", mark.alias("watermark")), "lateness", number)

        unit.write(number, body)

    run_available(spark, stream, folder, name=name, each=each, keep=False)
    return unit.table("lateness", _LATENESS).select("batch", *(c.split()[0] for c in _LATENESS.split(", ")))


def job_pauses(attempts: DataFrame) -> DataFrame:
    """ST8. For failed attempts (at, code, message, streak): the reason of the pause and when work goes on."""
    at, text = F.col("at"), F.col("message")
    delay = F.regexp_extract(text, r"retryDelay\D*(\d+(?:\.\d+)?)s", 1).try_cast("double")
    reason = (
        F.when((F.col("code") == 429) & text.contains("PerDay"), "quota_day").when(F.col("code") == 429, "quota_minute").when(F.col("code") == 404, "model_unknown")
        .when(F.col("code").isin(401, 403) | ((F.col("code") == 400) & text.contains("API key")), "key_refused").when(F.col("code") == 200, F.when(F.col("streak") >= 3, "bad_format")).otherwise("api_error")
    )
    later = lambda m: at + F.expr(f"INTERVAL {m} MINUTES")
    r = F.col("reason")
    until = (
        F.when(r == "quota_day", next_pacific_midnight(at)).when((r == "quota_minute") & delay.isNotNull(), F.timestamp_micros(F.unix_micros(at) + ((delay + 1) * 1_000_000).cast("long")))
        .when(r == "quota_minute", next_minute(at)).when(r == "api_error", later(15)).when(r.isNotNull(), later(60))
    )
    return attempts.withColumn("reason", reason).withColumn("until", until)


def activity(events: DataFrame, width: str = "7 days", slide: str = "1 day") -> DataFrame:
    """ST9. Events and their users' number in sliding windows."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """ST9. Sessions of each user: events less than ``gap`` apart."""
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("start"), "user_id", "events")


def run_available(spark: SparkSession, stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None, only: Callable[[DataFrame, int], DataFrame] | None = None, name: str | None = None, keep: bool = True, told: Callable[[list], None] | None = None) -> DataFrame | None:
    """Runs ``stream`` over what its source has now; the table that it has written below ``folder``, earlier runs of ``name`` included.

    With a ``name`` the checkpoint stays in place, and the next run of that name goes on where this one stopped: it reads new files only,
    and its state and its numbers of batches continue. Without one the run stands alone. Each batch goes to a folder of its own by number,
    so a batch that is run again replaces itself; in mode ``complete`` the last batch is the result. ``only`` says what of a batch is written,
    ``each`` is called with each batch after it; nothing is written unless ``keep``. ``told`` gets what Spark says of the run's batches.
    """
    place = f"{folder.rstrip('/')}/{name or 'stream-' + uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        if keep:
            target = "batch=all" if mode == "complete" else f"batch={number}"
            (only(batch, number) if only else batch).write.mode("overwrite").parquet(f"{place}/data/{target}")
        if each:
            each(batch, number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if told:
        told(list(query.recentProgress))
    if not keep:
        return None
    if not Files(spark, f"{place}/data").names():
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{place}/data").select(stream.columns)


def dedupe_files(spark: SparkSession, files: DataFrame, folder: str, name: str) -> DataFrame:
    """ST4. Takes in a stream of files (ts, file_hash, ...); every hash that any run of ``name`` has found, once, with the batch that found it.

    No watermark is involved: a file that is found late is no less new, so it isn't dropped, and no hash is ever forgotten.
    """
    store = HashStore(spark, f"{folder.rstrip('/')}/{name}-hashes")

    def each(batch: DataFrame, number: int) -> None:
        store.add(store.unseen(batch, number), number)

    run_available(spark, files, folder, name=name, each=each, keep=False)
    return store.table()
