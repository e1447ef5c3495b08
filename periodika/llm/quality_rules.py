"""Quality rules with host-level verdicts.

One pass over the texts computes statistics of every document and its rule failures. Failures are then counted for each
host (here: the column ``source``), each host's rate is shrunk towards the corpus by a beta prior fitted to all hosts, and
the host's verdict goes back to its documents.

Defined results: a null text has no words and fails; a null host has no verdict of its own (only the document's rules
count); repeated rows are judged, returned and counted like any other; a rate of exactly the limit is kept; texts are read whole; an
empty table gives an empty result. Columns of the input with the names of the result's give way to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Saved, sized, with_text_columns

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A host whose shrunk failure rate is above this loses all its documents.
MAX_HOST_RATE = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATISTICS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]


def statistics(column: pa.Array) -> list[pa.Array]:
    data, offsets = tv.utf8(column)
    n = len(offsets) - 1
    sums, in_word = tv.prefix(data), ~tv.BLANK[data]
    words = tv.Words(data, offsets, in_word, sums)
    doc_of_word = np.repeat(np.arange(n), words.counts)
    chars = tv.sums_by_text(in_word & ((data & 0xC0) != 0x80), offsets)
    symbols = tv.sums_by_text(_SYMBOL[data], offsets)

    lines_from, lines_to = tv.runs(data != 10, offsets)
    first_word = np.searchsorted(words.starts, lines_from)
    worded = first_word < np.searchsorted(words.starts, lines_to)
    lines_from, lines_to = lines_from[worded], lines_to[worded]
    doc_of_line = np.searchsorted(offsets, lines_from, side="right") - 1
    known = tv.span_hash(sums, lines_from, lines_to) ^ tv.mix(doc_of_line.astype(tv.U))
    _, where = np.unique(known, return_index=True)
    repeated_lines = np.bincount(doc_of_line, minlength=n) - np.bincount(doc_of_line[where], minlength=n)

    at, window = words.windows(3)
    covered = np.zeros(len(words.hash) + 1, np.int64)
    if len(at):
        window = window ^ tv.mix(doc_of_word[at].astype(tv.U))
        order = np.argsort(window, kind="stable")
        ranked = window[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for j in range(3):
            covered[at[twice] + j] = 1
    repeats = tv.sums_by_text(covered[:-1], words.at)
    return [pa.array(x.astype(np.int64)) for x in (words.counts, chars, symbols, repeated_lines, repeats)]


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta of the prior from the hosts' counts (``n``, ``failures``), by the method of moments.

    The spread between hosts beyond what chance gives sets the prior's weight, in documents: nothing where hosts differ as much as they
    can, without bound where they differ by chance alone, so that every host then has the corpus' rate.
    """
    row = hosts.agg(
        F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count("*").alias("k"),
        F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("q"), F.sum(1 / F.col("n")).alias("inverse"),
    ).first()
    if not row or not row["n"]:
        return 1.0, 1.0
    mean = (row["f"] + 0.5) / (row["n"] + 1.0)
    spread = max(0.0, row["q"] / row["n"] - (row["f"] / row["n"]) ** 2)
    chance = mean * (1 - mean) * row["k"] / row["n"]
    between = max(spread - chance, 1e-12)
    weight = max(0.0, mean * (1 - mean) / between - 1)
    return mean * weight, (1 - mean) * weight


def judge(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``keep`` columns of ``docs``, the statistics, base_failed, host_rate and kept."""
    measured = with_text_columns(docs, [*dict.fromkeys([*keep, host])], statistics, STATISTICS, text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    saved = Saved(measured.withColumn("base_failed", failed), "quality-rules")
    hosts = Saved(
        saved.df.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("__host")).agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failures")),
        "hosts",
    )
    alpha, beta = beta_prior(hosts.df)
    rates = hosts.df.select("__host", ((F.col("failures") + alpha) / (F.col("n") + alpha + beta)).alias("host_rate"))
    out = saved.df.join(sized(rates, hosts.count()), F.col(host) == F.col("__host"), "left")
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_host_rate)).drop("__host")
