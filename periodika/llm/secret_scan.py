"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Base kinds are ``assign``, ``access`` and ``hex`` (see ``PATTERNS``). The method adds spans of kind ``random``: every run of
characters ``[A-Za-z0-9+/_=-]`` is a candidate, judged as it stands and without its separators, and so
is every part of ``SHORTEST`` characters or more between separators, unless the whole run is found. The encoding of each is inferred (digits,
hexadecimal, letters of one case, base 32, letters of one case and digits, letters, letters and digits, base 64), and three
tests look at its symbols:

* chi-squared of the symbol counts against the alphabet;
* the runs test of symbols above and below the alphabet's middle;
* lag-1 serial correlation of the symbols' ranks.

They are asked twice. A candidate must pass for random: the harmonic mean of their three p-values under uniform symbols is
``LEAST_P`` or more, else p = 1. And it must not pass for text: each statistic has a p-value under natural text of the same
length and encoding (the chance that such text looks as even as the candidate), and Fisher's method combines the three to p. What
natural text looks like is measured on the pieces of all of the corpus' own texts for each encoding (``Natural``), equal texts once;
``DEFAULT`` stands in for encodings that the corpus lacks.

All candidates of the corpus form one family under Benjamini-Hochberg control with length weights
(longer classes weigh more, the mean weight over all candidates is 1); the threshold comes from a histogram of the
weighted p-values, whose size is fixed, so every candidate counts and none is collected. A candidate too short for the most even
string of its encoding to get a p that any threshold allows has p = 1 without being tested (``least_length``): that follows from the
error rate, not from a chosen length, and such candidates count in the family all the same.

Defined results: a null text is an empty text without spans; repeated rows are each scanned and count each in the family; equal
p-values are found or left together; an empty table gives none; texts are scanned whole. Positions are code points, ends exclusive.
Columns base and spans of the input give way to the operator's.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Saved, bounded_sample, set_apart, with_text_columns

#: False discoveries allowed among the added spans.
FDR = 0.001
#: Below this harmonic mean a candidate doesn't pass for random.
LEAST_P = 0.001
#: The length of the pieces that natural text is measured on, and the length of words that stay out.
PIECE, WORD = 32, 11
#: Non-centrality for each symbol of natural text over an alphabet of k symbols, as a share of k - 1, where the corpus has no such text.
DEFAULT = {10: 0.9, 16: 0.5, 26: 0.029, 32: 0.035, 36: 0.028, 52: 0.031, 62: 0.035, 64: 0.035}
#: The same of numbers in groups (dates, telephone numbers) or of fewer digits than ``NUMBER``, whose digits are more even.
NATURAL_NUMBER, NUMBER = 0.1, 20
#: Weight of the length classes up to 19, 24, 32, 48 and beyond.
LENGTHS, WEIGHTS = (19, 24, 32, 48), (0.25, 0.5, 1.0, 1.5, 2.0)
BINS = 400
#: No candidate shorter than this is worth looking for, whatever its encoding.
SHORTEST = 6

PATTERNS = {
    "assign": re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
}
KINDS = [*PATTERNS, "random"]
_CUE = re.compile(r"(?ai:passw|secret|token|api_?key)")
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_IN_RUN = _DIGIT.copy()
_IN_RUN[[*range(65, 91), *range(97, 123), *map(ord, "+/_=-")]] = True
_IN_WORD = _IN_RUN.copy()
_IN_WORD[list(map(ord, "+/_=-"))] = False
_PART = re.compile(r"[A-Za-z0-9]+")
_ALPHABETS = [
    (10, re.compile(r"[0-9]+"), "0123456789"),
    (16, re.compile(r"(?=[A-Fa-f]*[0-9])(?:[0-9a-f]+|[0-9A-F]+)"), "0123456789abcdef"),
    (26, re.compile(r"[A-Z]+|[a-z]+"), "abcdefghijklmnopqrstuvwxyz"),
    (32, re.compile(r"[A-Z2-7]+|[a-z2-7]+"), "abcdefghijklmnopqrstuvwxyz234567"),
    (36, re.compile(r"[A-Z0-9]+|[a-z0-9]+"), "abcdefghijklmnopqrstuvwxyz0123456789"),
    (52, re.compile(r"[A-Za-z]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    (62, re.compile(r"[A-Za-z0-9]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (64, re.compile(r"[A-Za-z0-9+/_=-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, in order."""
    found = []
    if _CUE.search(text):
        found += [(m.start(), 0, m.end()) for m in PATTERNS["assign"].finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in PATTERNS["access"].finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in PATTERNS["hex"].finditer(text)]
    return sorted(found)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(token: str) -> tuple[int, str]:
    """Alphabet size and token in that alphabet's case: the smallest alphabet that fits."""
    for k, fits, _ in _ALPHABETS:
        if fits.fullmatch(token):
            return k, token.lower() if k in (16, 26, 32, 36) else token.replace("-", "+").replace("_", "/").rstrip("=") if k == 64 else token
    return 64, token


_RANKS = {k: {c: i for i, c in enumerate(symbols)} for k, _, symbols in _ALPHABETS}


def statistics(x: np.ndarray, k: int) -> tuple[float, float, float]:
    """Chi-squared, and the normal scores of the runs and of the serial correlation, of symbol ranks ``x`` over k symbols."""
    n = len(x)
    counts = np.bincount(x, minlength=k)
    chi = float((counts * counts).sum()) * k / n - n
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 1 + 2 * a * b / n
        runs = (1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    else:
        runs = -math.sqrt(n)  # one run only
    c = x - x.mean()
    serial = float((c[1:] * c[:-1]).sum() / max(float((c * c).sum()), 1e-9))
    return chi, runs, (serial + 1 / n) * math.sqrt(n)


@dataclass
class Natural:
    """Natural text of each encoding: non-centrality a symbol, and mean (for 1 symbol) and spread of the runs and serial scores."""

    away: dict[int, float]
    scores: dict[int, tuple[tuple[float, float], tuple[float, float]]]

    def p(self, k: int, n: int, chi: float, runs: float, serial: float, number: bool) -> float:
        """Fisher's combination of the chances that natural text of n symbols looks as even in each test."""
        away = n * (NATURAL_NUMBER * (k - 1) if number else self.away.get(k, DEFAULT[k] * (k - 1)))
        d = k - 1
        # non-central chi-squared, its lower tail by Sankaran's normal approximation
        h = 1 - 2 * (d + away) * (d + 3 * away) / (3 * (d + 2 * away) ** 2)
        q = (d + 2 * away) / (d + away) ** 2
        m = (h - 1) * (1 - 3 * h)
        z = ((chi / (d + away)) ** h - (1 + h * q * (h - 1 - 0.5 * (2 - h) * m * q))) / (h * math.sqrt(2 * q) * (1 + 0.5 * m * q))
        logs = math.log(max(_normal_tail(-z), 1e-300))
        for score, (mean, spread), step in zip((runs, serial), self.scores.get(k, ((0.0, 1.0), (0.0, 1.0))), (1 / math.sqrt(n), 0.5 / math.sqrt(n)), strict=True):
            at, mean = abs(score) + step, mean * math.sqrt(n)  # half a step of the score, which is discrete
            logs += math.log(max(_normal_tail((-at - mean) / spread) - _normal_tail((at - mean) / spread), 1e-300))
        half = -logs  # chi-squared of 6 degrees, upper tail
        return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def _most_even(k: int, n: int) -> float:
    """The least chi-squared that n symbols can have."""
    low, more = divmod(n, k)
    return ((k - more) * low * low + more * (low + 1) ** 2) * k / n - n


def least_length(natural: Natural, k: int, fdr: float) -> int:
    """The length from which a string over k symbols can be a discovery: its p can be ``fdr`` times its weight over the least weight."""
    n = SHORTEST
    while n < 200 and natural.p(k, n, _most_even(k, n), 0.0, 0.0, k == 10 and n < NUMBER) > fdr * WEIGHTS[_length_class(n)] / WEIGHTS[0]:
        n += 1
    return n


class Battery:
    """The tests with what natural text looks like and the lengths that follow from it."""

    def __init__(self, natural: Natural, fdr: float = FDR):
        self.natural, self.least = natural, {k: least_length(natural, k, fdr) for k in DEFAULT}

    def p(self, token: str, grouped: bool = False) -> float:
        """The chance that natural text looks as random; 1 if the token doesn't pass for random. ``grouped``: it stood in groups."""
        if len(token) < min(self.least.values()):
            return 1.0
        k, symbols = encoding(token)
        if len(symbols) < self.least[k]:
            return 1.0
        ranks = _RANKS[k]
        x = np.array([ranks[c] for c in symbols if c in ranks], np.int64)
        n = len(x)
        if n < self.least[k]:
            return 1.0
        chi, runs, serial = statistics(x, k)
        d = k - 1
        u = ((max(chi, 0.0) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))  # Wilson and Hilferty
        even = [max(x, 1e-300) for x in (_normal_tail(u), 2 * _normal_tail(abs(runs)), 2 * _normal_tail(abs(serial)))]
        if 3 / sum(1 / x for x in even) < LEAST_P:
            return 1.0
        return self.natural.p(k, n, chi, runs, serial, k == 10 and (grouped or n < NUMBER))

    def judged(self, run: str) -> list[tuple[int, int, float]]:
        """(start, end, p) of a run as a whole and then of its parts between separators.

        A run with separators is tested with and without them; the lesser p counts twice, once for each test.
        """
        parts = [m for m in _PART.finditer(run)]
        if len(parts) == 1 and parts[0][0] == run:
            return [(0, len(run), self.p(run))]
        joined = "".join(m[0] for m in parts)
        whole = min(1.0, 2 * min(self.p(run), self.p(joined, grouped=len(parts) > 1)))
        return [(0, len(run), whole), *((m.start(), m.end(), self.p(m[0])) for m in parts if len(m[0]) >= SHORTEST)]


# What bytes a piece has: digits, capitals, small letters, small and capital letters beyond f, digits that base 32 lacks.
_HAS = np.zeros(256, np.uint8)
for _bit, _chars in enumerate(("0123456789", _ALPHABETS[5][2][:26], _ALPHABETS[5][2][26:], "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ", "0189")):
    _HAS[[ord(c) for c in _chars]] |= 1 << _bit
#: Encodings that are measured. Digits, hexadecimal and base 32 are hardly ever prose: their pieces are numbers and keys, so the default stays.
MEASURED = (26, 36, 52, 62)
_RANK_OF = np.zeros((len(MEASURED), 256), np.int64)
for _i, _k in enumerate(MEASURED):
    for _c, _rank in _RANKS[_k].items():
        _RANK_OF[_i, [ord(_c), ord(_c.upper())] if _k in (26, 36) else ord(_c)] = _rank
#: Cells of a statistic for each unit, and what is added to a cell's number so that none is negative.
STEPS, MIDDLE = 4096, 1 << 19


def _encodings(pieces: np.ndarray) -> np.ndarray:
    """``encoding``'s alphabet of each row of bytes, which are digits and letters."""
    has = np.bitwise_or.reduce(_HAS[pieces], axis=1)
    digit, upper, lower, beyond_lower, beyond_upper, beyond_digit = ((has >> i) & 1 == 1 for i in range(6))
    one_case = ~upper | ~lower
    hexadecimal = digit & (~upper & ~beyond_lower | ~lower & ~beyond_upper)
    return np.select([~upper & ~lower, hexadecimal, ~digit & one_case, ~beyond_digit & one_case, one_case, ~digit], [10, 16, 26, 32, 36, 52], 62)


def _piece_cells(column: pa.Array) -> list[pa.Array]:
    """Of each text's words put together, in pieces of PIECE characters: the cells of each piece's three statistics.

    Words of WORD characters or more are left out: they may be keys.
    """
    data, offsets = tv.utf8(column)
    starts, ends = tv.runs(_IN_WORD[data], offsets)
    short = ends - starts < WORD
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[short]] += 1
    edge[ends[short]] -= 1
    kept = np.cumsum(edge[:-1]) > 0
    at = np.concatenate([[0], np.cumsum(kept)])[offsets]
    n = np.diff(at) // PIECE
    owner = np.repeat(np.arange(len(n)), n)
    first = at[owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
    pieces = data[kept][first[:, None] + np.arange(PIECE)]
    k = _encodings(pieces)
    place = np.searchsorted(MEASURED, k)
    known = np.isin(k, MEASURED)
    pieces, k, place, owner = pieces[known], k[known], place[known], owner[known]
    x = _RANK_OF[place[:, None], pieces]
    symbols = max(MEASURED)
    counts = np.bincount((x + symbols * np.arange(len(x))[:, None]).reshape(-1), minlength=symbols * len(x)).reshape(-1, symbols)
    chi = (counts * counts).sum(1) * k / PIECE - PIECE
    high = x >= k[:, None] / 2
    a = high.sum(1)
    b = PIECE - a
    mean = 1 + 2 * a * b / PIECE
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (PIECE - 1), 1e-9))
    runs = np.where((a > 0) & (b > 0), (1 + (high[:, 1:] != high[:, :-1]).sum(1) - mean) / spread, -math.sqrt(PIECE))
    c = x - x.mean(1, keepdims=True)
    serial = ((c[:, 1:] * c[:, :-1]).sum(1) / np.maximum((c * c).sum(1), 1e-9) + 1 / PIECE) * math.sqrt(PIECE)
    values = np.stack([(chi - (k - 1)) / PIECE, runs / math.sqrt(PIECE), serial / math.sqrt(PIECE)], axis=1)
    cells = ((3 * place[:, None] + np.arange(3)) << 20) + np.rint(values * STEPS).astype(np.int64) + MIDDLE
    ends = 3 * np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells.reshape(-1), pa.int32()))]


def measure(docs: DataFrame, text: str = "text", sample: int | None = None, least: int = 30) -> Natural:
    """What natural text of each encoding looks like in all texts: medians, which a few secrets don't move. ``sample``: in so many of them only.

    A text that several rows have counts once. Statistics are counted in cells of 1/STEPS, so every piece counts and none is collected.
    """
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    if sample is not None:
        texts = bounded_sample(texts, "text", sample)
    fields = [T.StructField("cells", T.ArrayType(T.IntegerType()))]
    pieces = with_text_columns(texts.select("text", F.md5("text").alias("hash")), ["hash"], _piece_cells, fields).groupBy("hash").agg(F.first("cells").alias("cells"))
    cells = pieces.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    value = (F.col("cell") % (1 << 20) - MIDDLE) / STEPS
    cuts = F.percentile(value, F.lit([0.16, 0.5, 0.84]), F.col("n"))
    rows = cells.groupBy(F.shiftright("cell", 20).alias("what")).agg(F.sum("n").alias("n"), cuts.alias("q")).filter(F.col("n") >= least).collect()
    found = {r["what"]: r["q"] for r in rows}
    spread = lambda q: max((q[2] - q[0]) / 2 * math.sqrt(PIECE), 1.0)
    known = [(k, *(found[3 * i + j] for j in range(3))) for i, k in enumerate(MEASURED) if 3 * i in found]
    return Natural({k: max(away[1], 0.0) for k, away, _, _ in known}, {k: ((runs[1], spread(runs)), (serial[1], spread(serial))) for k, _, runs, serial in known})


def _length_class(n: int) -> int:
    return sum(n > x for x in LENGTHS)


def _compute(battery: Battery):
    # a run without digits is in letters or base 64; shorter ones can't be discoveries and are only counted
    letters, any_ = min(battery.least[k] for k in (26, 52, 64)), min(battery.least.values())

    def compute(column: pa.Array) -> list[pa.Array]:
        texts = [t or "" for t in column.to_pylist()]
        base = [[{"start": s, "kind": k, "end": e} for s, k, e in base_spans(text)] for text in texts]
        data, offsets = tv.utf8(column)
        starts, ends = tv.runs(_IN_RUN[data], offsets)
        size = ends - starts
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        worth = (size >= letters) | ((size >= any_) & (digits[ends] > digits[starts]))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        counted = np.bincount(owner[~worth & (size >= SHORTEST)], minlength=len(texts))  # all of the first length class
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        at = chars[starts] - chars[offsets[owner]]
        tested: list[list[dict]] = [[] for _ in texts]
        extra: list[dict[int, int]] = [{0: int(n)} if n else {} for n in counted]
        for i in np.flatnonzero(worth):
            text, begin, run = int(owner[i]), int(at[i]), None
            for start, end, p in battery.judged(texts[text][begin : begin + int(size[i])]):
                cell = (_length_class(end - start), min(BINS, int(-10 * math.log10(p))) if p < 1 else 0)
                in_length, in_bin = run or (0, -1)
                run = run or cell
                if cell[1]:
                    tested[text].append({"start": begin + start, "end": begin + end, "length": cell[0], "bin": cell[1], "in_length": in_length, "in_bin": in_bin, "n": 1})
                else:
                    extra[text][cell[0]] = extra[text].get(cell[0], 0) + 1
        for own, more in zip(tested, extra, strict=True):
            own += [{"start": -1, "end": -1, "length": c, "bin": 0, "in_length": 0, "in_bin": -1, "n": n} for c, n in sorted(more.items())]
        return [
            pa.array(base, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
            pa.array(tested, pa.list_(pa.struct([(n, pa.int32()) for n in _TESTED_NAMES]))),
        ]

    return compute


_TESTED_NAMES = ("start", "end", "length", "bin", "in_length", "in_bin", "n")
_SPAN = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end")]))
_TESTED = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in _TESTED_NAMES]))


def thresholds(histogram: list[tuple[int, int, int]], fdr: float = FDR) -> list[int]:
    """The least bin that counts as a discovery, for each length class, from (length class, bin, candidates) rows.

    Bin b holds p in (10^(-(b+1)/10), 10^(-b/10)], and p / weight is judged by its upper end: Benjamini-Hochberg's step-up
    over at most 5 x 401 cells.
    """
    by_class = [sum(c for k, _, c in histogram if k == n) for n in range(len(WEIGHTS))]
    total = sum(by_class)
    never = [BINS + 1] * len(WEIGHTS)
    if not total:
        return never
    mean = sum(w * c for w, c in zip(WEIGHTS, by_class, strict=True)) / total
    cells = sorted((10 ** (-b / 10) * mean / WEIGHTS[k], k, b, c) for k, b, c in histogram if b > 0)
    found, best = 0, 0.0
    for q, _, _, c in cells:
        found += c
        if q * total <= fdr * found:
            best = q
    return [min((b for b in range(1, BINS + 1) if 10 ** (-b / 10) * mean / w <= best), default=BINS + 1) for w in WEIGHTS]


def scan(docs: DataFrame, keep: list[str], text: str = "text", fdr: float = FDR) -> DataFrame:
    """``keep`` columns of ``docs``, ``base`` and ``spans``: arrays of (start, kind, end) in order; kind is a place in KINDS."""
    fields = [T.StructField("base", _SPAN), T.StructField("__tested", _TESTED)]
    battery = Battery(measure(docs, text), fdr)
    saved = Saved(with_text_columns(docs, keep, _compute(battery), fields, text), "secrets")
    cells = saved.df.select(F.explode("__tested").alias("t")).groupBy("t.length", "t.bin").agg(F.sum("t.n")).collect()  # 5 x 401 rows at most
    limits = F.array(*map(F.lit, thresholds([tuple(r) for r in cells], fdr)))
    added = F.transform(
        F.filter("__tested", lambda t: (t["bin"] > 0) & (t["bin"] >= F.element_at(limits, t["length"] + 1)) & (t["in_bin"] < F.element_at(limits, t["in_length"] + 1))),
        lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end")),
    )
    return saved.df.select(*[c for c in keep if c not in ("base", "spans")], "base", F.array_sort(F.concat("base", added)).alias("spans"))


def spelt(spans: str) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark`` in ``text``, and ``length`` (if there) brought up to date; no other column changes."""
    columns = docs.columns
    docs, restored = set_apart(docs, text, length)
    found = scan(docs, docs.columns, text)
    ordered = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(
            s["end"] > acc["at"],
            F.struct(
                F.concat(
                    acc["out"], F.substring(F.col(text), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                    F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")),
                ).alias("out"),
                s["end"].alias("at"),
            ),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    clean = F.when(F.size("spans") > 0, ordered).otherwise(F.col(text))
    out = found.withColumn(text, clean)
    if length in columns:
        out = out.withColumn(length, F.when(F.size("spans") > 0, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return restored(out)
