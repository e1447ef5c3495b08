"""Licence scans: a trained paragraph classifier with an unknown class, confirmed against templates. DataFrame functions only.

Paragraphs are all lines of a text and, for notices that run over several lines, windows of ``WINDOW`` words, half a window
apart, over each block of lines between blank ones. The classifier is a multinomial logistic regression (``spark.ml``) over the word 1- to
3-grams of templates and distractors; other words have no weight. It learns from pieces of the templates, from the paragraphs of
all texts that hold a template (their family), and, as class ``unknown``, from all other paragraphs,
as they are and with each cue put in, and from distracting sentences; paragraphs with the same grams are one example, and
examples that differ only in grams without weight are fitted as one (``LicenceModel._fit``). Half of the texts are held out, and the least
probability that names a family is the 99.5 % quantile of the unknown ones there, to one of ``CELLS`` parts. A named paragraph is confirmed if it holds ``CONFIRM`` of the word pairs of one of the family's
templates.

Grams are looked up and summed within a paragraph's row, so only the different sets of grams that the model learns from, and paragraphs that count
with what overlaps them, are shuffled. ``scan`` looks paragraphs up once, writes their grams out, and learns from and judges these.
Most paragraphs can't be named whatever the arithmetic says: grams count once, so a family's score is at most its intercept and the
sum of the weights that speak for it. ``LicenceModel.anchors`` are words without which that bound stays below the least
probability for every family (a property of the fitted weights, not a list), and texts, blocks, lines and windows without any are ruled
out before any gram is looked up. No notice is lost by it.

``n_notices`` counts confirmed lines, repeats too, and confirmed windows (overlapping ones once) of a family that no line in
them confirms. ``n_unknown`` counts the other lines that have a cue or that the classifier names, unless they are part of a
confirmed window's notice.

Defined results: null and empty texts have no paragraphs; repeated rows are equal; all rows of one id share that id's
result; rows without id get counts of 0; an empty table gives an empty result; of equally probable families, and of templates
held alike, the first counts; long texts are judged whole; columns of ``docs`` other than id and text are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Saved, sized

# Notices of well-known licence families.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Terms: Apache 2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.", "CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Distributed under the GNU GPL v3.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT License.",
    ],
}
#: Sentences that sound alike and name no family.
DISTRACTORS = [
    "All rights reserved.", "Copyright by the author.", "The licence plate was seen near the station.", "No permission is granted to copy this text.",
    "Licensed to the customer under a separate agreement.", "This work is licensed under a proprietary license.", "He lost his driving license last year.",
    "The software is provided as is without warranty of any kind.", "Released under embargo until Monday.", "Version 3 of the general public report was released.",
    "Redistribution of this report is forbidden.", "The public license office is closed.", "Ask for permission before you copy files from the software.",
]
#: What makes an unconfirmed line an unknown notice; the classifier sees the other lines too.
CUES = r"licen[cs]|copyright|permission|permitted|warrant|redistribut|released under|creative commons|\bcc[ -]by|\bgpl|\bapache 2"
#: Plain strings, one of which is in whatever a cue matches; they rule most lines out faster than the pattern does.
CUE_PARTS = ("licen", "copyright", "permi", "warrant", "redistribut", "released under", "creative commons", "cc by", "cc-by", "gpl", "apache 2")
#: Groups of examples that one task of the fit takes; parts of a probability that it is counted in.
FIT_ROWS, CELLS = 200_000, 1 << 16
#: Grams that join the fit at a time; what a slope may exceed the penalty by, as the fit's rounds are limited.
MORE, SLACK = 64, 0.05
#: Weight of the sum of absolute weights in the fit, which leaves most grams without any.
REGULAR = 1e-3
#: Lines whose words are counted on in one array.
PIECE = 256
CONFIRM = 0.5
WINDOW = 64
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
_PLAIN_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
_PUT_IN = ("license", "licensed under", "permission", "released", "this work is licensed", "under the license")
FAMILIES = list(TEMPLATES)


def words_of(text: str) -> list[str]:
    """The words of a short text, as ``words`` has them in a column."""
    return _PLAIN_WORD.findall(re.sub(r"\bcc-by\b", "cc by", text.lower()))


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def words(lowered: Column) -> Column:
    parted = F.when(lowered.contains("cc-by"), F.regexp_replace(lowered, r"\bcc-by\b", "cc by")).otherwise(lowered)
    return F.regexp_extract_all(parted, F.lit(WORD), 0)


def has_any(lowered: Column, parts: Iterable[str]) -> Column:
    return reduce(or_, (lowered.contains(part) for part in parts), F.lit(False))


def cued(lowered: Column) -> Column:
    return has_any(lowered, CUE_PARTS) & lowered.rlike(CUES)


def spots(marked: Column, n: int, shorter: Column | None = None) -> Column:
    """Where each ``n``-gram of an array of words begins: its place in the vocabulary, -1 for others; ``shorter``: the places of the grams one word shorter."""
    of = [g for g in VOCABULARY if g.count(" ") == n - 1]
    place = lambda g: F.when(g.isin(of), F.get(_listed(_SPOTS), F.crc32(g.cast("binary")) % len(_SPOTS))).otherwise(F.lit(-1)).cast("smallint")
    if shorter is None:
        return F.transform(marked, place)
    # a gram of the vocabulary has its shorter ones there, so only what they leave open is joined
    joined = lambda i: F.concat_ws(" ", *(F.get(marked, i + k) for k in range(n)))
    return F.transform(shorter, lambda p, i: F.when((p >= 0) & (F.get(shorter, i + 1) >= 0), place(joined(i))).otherwise(F.lit(-1).cast("smallint")))


def grams_within(begin: Column, end: Column) -> Column:
    """The grams of a block's words ``begin`` to ``end``, each once, as sorted places in the vocabulary."""
    parts = (F.slice(f"spots_{n}", begin + 1, F.greatest(end - begin - (n - 1), F.lit(0))) for n in (1, 2, 3))
    return F.sort_array(F.array_remove(F.array_distinct(F.concat(*parts)), F.lit(-1).cast("smallint")))


def paragraphs(docs: DataFrame, anchors: list[str] | None = None) -> DataFrame:
    """The lines (unit 0) and windows (unit 1) of each different text of ``docs`` (id, text): id, t, block, unit, no, begin, end, cue, grams.

    ``grams`` are places in ``VOCABULARY``; a block's are looked up once and dealt to its lines and windows. ``begin`` and ``end`` count words in the block; rows that repeat a text repeat its paragraphs. With ``anchors``, only lines
    with a cue or one of these words (or a longer one that holds it) come, and windows with one of the words.
    """
    matches = (lambda c: F.lit(True)) if anchors is None else (lambda c: has_any(c, anchors) | cued(c))
    texts = docs.select("id", F.lower("text").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").filter(matches(F.col("text")))
    blocks = texts.select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", r"\n(?:(?U:[^\S\n])*\n)+", -1)).alias("block", "body")).filter(matches(F.col("body")))

    half = WINDOW // 2
    said = lambda x: F.struct(words(x).alias("words"), matches(x).alias("keep"), cued(x).alias("cue"))
    read = blocks.select("id", "t", "block", F.transform(F.split("body", "\n", -1), said).alias("said"))
    # Columns of their own where more than one expression reads them, so that each is computed once.
    read = read.withColumn("ns", F.transform("said", lambda x: F.size(x["words"]))).withColumn("all_words", F.flatten("said.words"))
    read = read.withColumn("sums", _piece_sums(F.col("ns"))).withColumn("before", _before(F.col("ns"), F.col("sums")))
    ws = F.col("all_words")
    read = read.withColumn("spots_1", spots(ws, 1))
    read = read.withColumn("spots_2", spots(ws, 2, F.col("spots_1")))
    read = read.withColumn("spots_3", spots(ws, 3, F.col("spots_2")))
    unit = lambda u, no, begin, end, cue: F.struct(F.lit(u).alias("unit"), no.alias("no"), begin.alias("begin"), end.alias("end"), cue.alias("cue"), grams_within(begin, end).alias("grams"))
    kept = F.filter(F.transform("said", lambda x, i: F.when(x["keep"], unit(0, i, F.get("before", i), F.get("before", i) + F.get("ns", i), x["cue"]))), lambda x: x.isNotNull())
    numbers = F.sequence(F.lit(0), (F.greatest(F.ceil(F.size(ws) / half) - 1, F.lit(1)) - 1).cast("int"))
    windows = F.transform(numbers, lambda k: unit(1, k, half * k, half * k + F.least(F.size(ws) - half * k, F.lit(WINDOW)), F.lit(False)))
    if anchors is not None:
        windows = F.filter(windows, lambda w: F.arrays_overlap(w["grams"], _listed([_PLACE[a] for a in anchors]))) if anchors else F.filter(windows, lambda w: F.lit(False))
    return read.select("id", "t", "block", F.explode(F.concat(kept, windows)).alias("p")).select("id", "t", "block", "p.*")


def _piece_sums(ns: Column) -> Column:
    """The sums of pieces of ``PIECE`` numbers."""
    pieces = F.sequence(F.lit(0), F.floor((F.size(ns) - 1) / PIECE).cast("int"))
    return F.transform(pieces, lambda c: F.aggregate(F.slice(ns, c * PIECE + 1, F.lit(PIECE)), F.lit(0), lambda s, x: s + x))


def _before(ns: Column, sums: Column) -> Column:
    """For each number the sum of those before it: within pieces, from the sums of the pieces before."""
    start = lambda c: F.aggregate(F.slice(sums, F.lit(1), c), F.lit(0), lambda s, x: s + x)
    grow = lambda done, x: F.array_append(done, F.element_at(done, -1) + x)
    inside = lambda s, c: F.slice(F.aggregate(F.slice(ns, c * PIECE + 1, F.lit(PIECE)), F.array(start(c)), grow), F.lit(1), F.least(F.lit(PIECE), F.size(ns) - c * PIECE))
    return F.flatten(F.transform(sums, inside))


KEYS = ["id", "t", "block", "unit", "no", "begin", "end", "cue"]
#: The grams of templates, distractors and cues.
VOCABULARY = sorted(set().union(*(grams_of(words_of(t)) for t in (*(t for family in TEMPLATES.values() for t in family), *DISTRACTORS, *_PUT_IN))))
_PLACE = {g: i for i, g in enumerate(VOCABULARY)}


def _spread(grams: list[str]) -> list[int]:
    """Their places, each at its CRC-32 modulo the list's length, the first length at which no two meet; -1 elsewhere."""
    sums = [zlib.crc32(g.encode()) for g in grams]
    size = len(grams)
    while len({c % size for c in sums}) < len(grams):
        size += 1
    out = [-1] * size
    for i, c in enumerate(sums):
        out[c % size] = i
    return out


_SPOTS = _spread(VOCABULARY)


def _listed(places: list[int]) -> Column:
    """A literal array of places."""
    return F.split(F.lit(",".join(map(str, places))), ",").cast("array<smallint>")


def places_of(text: str) -> list[int]:
    return sorted(_PLACE[g] for g in grams_of(words_of(text)))


def known_grams(docs: DataFrame, id: str = "doc_id", text: str = "text") -> Saved:
    """KEYS and grams of every paragraph of ``docs``, written out."""
    rows = docs.filter(F.col(text).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(text).alias("text"))
    return Saved(paragraphs(rows).select(*KEYS, "grams"), "licence-grams")


class LicenceModel:
    """weights: gram -> a weight for unknown and each family; bias: their intercepts; least: the least probability that names a family.

    ``grams``: the table of ``known_grams`` for ``docs``, if it is there already.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", grams: DataFrame | None = None):
        self.spark = spark = docs.sparkSession
        given = [t for family in TEMPLATES.values() for t in family]
        self.vocabulary = VOCABULARY
        self.weights = {g: [0.0] * (len(FAMILIES) + 1) for g in self.vocabulary}
        self.pairs = [{" ".join(ws[i : i + 2]) for i in range(len(ws) - 1)} for ws in map(words_of, given)]
        self.family = [k for k, family in enumerate(TEMPLATES.values(), 1) for _ in family]

        own = known_grams(docs, id, text) if grams is None else None
        held = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(2)) == 1
        found = Saved((own.df if own else grams).select(held.alias("held"), "grams").distinct(), "licence-sets")
        if own:
            own.drop()
        label = F.when(self._best_share() >= CONFIRM, self._best_family()).otherwise(0)
        seen = Saved(self._summed(found.df).select("held", label.cast("double").alias("label"), "grams"), "licence-labelled")

        pieces = [(float(k), " ".join(ws[a:b])) for k, t in zip(self.family, given, strict=True) for ws in [words_of(t)] for a, b in ((0, None), (0, max(len(ws) - 1, 1)), (min(1, len(ws) - 1), None))]
        pieces += [(0.0, t) for t in (*DISTRACTORS, *_PUT_IN, "")]
        given_rows = spark.createDataFrame([(k, places_of(t)) for k, t in pieces], "label double, grams array<smallint>")
        learnt = seen.df.filter("NOT held").select("label", "grams").unionByName(given_rows)
        self._fit(learnt)
        chances = self._summed(seen.df.filter("held AND label = 0")).select((F.ceil(self._probability() * CELLS) / CELLS).alias("p")).groupBy("p").count()
        quantile = chances.agg(F.percentile("p", 0.995, F.col("count")).alias("q")).first()["q"]
        self.least = max(0.5, quantile or 0.0)
        common = {self.vocabulary[r["place"]]: r["count"] for r in seen.df.select(F.explode("grams").alias("place")).groupBy("place").count().collect()}  # grams of the vocabulary
        self.anchors = self._anchors({g: n for g, n in common.items() if " " not in g})
        for written in (found, seen):
            written.drop()

    def _fit(self, learnt: DataFrame) -> None:
        """Weights and bias of the regression over all examples: each set of ``learnt`` (label, grams), unknown ones also with each cue put in.

        The penalty leaves most grams without weight, and examples that agree on the others are one to the fit. So it runs on few grams and
        grouped examples, and then the gradient over all examples tells which other grams would get a weight; ``MORE`` of them join until none is
        left. Grams without weight leave before the next fit; one that comes back stays.
        """
        per = {int(r["label"]): r["count"] for r in learnt.groupBy("label").count().collect()}
        unknown = per[0] * (1 + len(_PUT_IN))
        heavy, total = unknown / (sum(per.values()) - per[0]), 2.0 * unknown
        self.bias = [math.log((unknown if k == 0 else heavy * per[k]) / total) for k in range(len(FAMILIES) + 1)]
        none, weight = F.array().cast("array<smallint>"), F.col("count") * F.when(F.col("label") > 0, heavy).otherwise(1.0)
        put_in = F.array(none, *(_listed(places_of(t)) for t in _PUT_IN))
        fitted: list[int] = []
        gone: set[int] = set()
        back: set[int] = set()
        while True:
            among = lambda c: F.filter(c, lambda g: g.isin(fitted)) if fitted else none  # noqa: E731, B023
            place = F.explode(F.concat(F.array(F.lit(-1).cast("smallint")), "grams")).alias("place")  # -1 counts the group's examples
            groups = Saved(learnt.select("label", among("grams").alias("seen"), place).groupBy("label", "seen", "place").count(), "licence-groups")
            copies = groups.df.select("label", "seen", "place", weight.alias("weight"), F.explode(F.when(F.col("label") == 0, put_in).otherwise(F.array(none))).alias("cue"))
            copies = copies.select("*", F.sort_array(F.array_union("seen", among("cue"))).alias("grams"))
            if fitted:
                self._fit_grouped(copies.filter("place = -1").groupBy("label", "grams").agg(F.sum("weight").alias("weight")), fitted)
            pulls = self._pulls(copies, total)
            groups.drop()
            more = sorted((g for g, x in pulls.items() if x > REGULAR * (1 + SLACK) and g not in fitted), key=lambda g: (-pulls[g], g))
            if not more:
                return
            # those that got no weight leave again, once
            left = {g for g in fitted if g not in back and not any(self.weights[self.vocabulary[g]])}
            back |= gone & set(more[:MORE])
            gone |= left
            fitted = sorted({*fitted, *more[:MORE]} - left)

    def _fit_grouped(self, examples: DataFrame, fitted: list[int]) -> None:
        """Weights of the grams ``fitted`` (others have none) and bias from examples (label, grams, weight)."""
        examples = Saved(examples, "licence-examples")
        sums = examples.df.agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") ** 2).alias("squares")).first()
        known = [self.vocabulary[i] for i in fitted]
        listed = F.split(F.lit("\n".join(self.vocabulary)), "\n")
        rows = examples.df.coalesce(1 + sums["n"] // FIT_ROWS).select("label", "weight", F.transform("grams", lambda i: F.get(listed, i.cast("int"))).alias("grams"))
        vectors = CountVectorizerModel.from_vocabulary(known, inputCol="grams", outputCol="features").setBinary(True).transform(rows)
        # deviations, by which the fit scales the penalty, are unbiased for single examples and too large for groups
        penalty = REGULAR * math.sqrt(1 - sums["squares"] / sums["w"] ** 2)
        model = LogisticRegression(maxIter=60, regParam=penalty, elasticNetParam=1.0, family="multinomial", weightCol="weight").fit(vectors)
        matrix = model.coefficientMatrix.toArray()
        self.weights = {g: [0.0] * (len(FAMILIES) + 1) for g in self.vocabulary} | {g: [float(x) for x in matrix[:, i]] for i, g in enumerate(known)}
        self.bias = [float(x) for x in model.interceptVector.toArray()]
        examples.drop()

    def _pulls(self, copies: DataFrame, total: float) -> dict[int, float]:
        """The greatest slope of the loss over all examples along each gram's weights, in the scale of the penalty."""
        scores = self._scores()
        # each step behind a generator, so that what follows doesn't compute it again
        rows = self._summed(copies).select("label", "place", "cue", "weight", F.explode(F.array(F.array(*scores))).alias("scores"))
        rows = rows.select("label", "place", "cue", "weight", F.explode(F.array(F.transform("scores", lambda z: F.exp(z - F.array_max("scores"))))).alias("parts"))
        said = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x)
        to = F.when(F.col("place") < 0, F.col("cue")).otherwise(F.array_except(F.array("place"), "cue"))
        rows = rows.select("label", "parts", "weight", said.alias("said"), F.explode(to).alias("place"))
        off = [F.sum((F.get("parts", F.lit(k)) / F.col("said") - (F.col("label") == k).cast("double")) * F.col("weight")).alias(f"off_{k}") for k in range(len(scores))]
        out = {}
        for r in rows.groupBy("place").agg(F.sum("weight").alias("w"), *off).collect():  # grams of the vocabulary
            share = r["w"] / total
            if 0 < share < 1:
                out[r["place"]] = max(abs(r[f"off_{k}"]) for k in range(len(scores))) / total / math.sqrt(share * (1 - share))
        return out

    # The vocabulary is that of the templates, whose number of grams is fixed: it and the numbers of each gram are literals of the plan.
    def _summed(self, found: DataFrame) -> DataFrame:
        """``found`` with ``sums`` over its column ``grams``: the weights of unknown and each family, then of each template the share of its word pairs."""
        n = len(FAMILIES) + 1 + len(self.pairs)
        rows = [[*self.weights[g], *(1.0 / len(p) if g in p else 0.0 for p in self.pairs)] for g in self.vocabulary]
        numbers = F.split(F.lit(",".join(repr(x) for row in rows for x in row)), ",").cast("array<double>")
        of = lambda g: F.slice(numbers, g.cast("int") * n + 1, F.lit(n))
        none = F.array_repeat(F.lit(0.0), n)
        total = F.aggregate("grams", none, lambda s, g: F.zip_with(s, of(g), lambda a, b: a + b))
        return found.select("*", F.explode(F.array(total)).alias("sums"))  # what a generator returns isn't computed again for each use

    def _share(self, j: int) -> Column:
        return F.get("sums", F.lit(len(FAMILIES) + 1 + j))

    def _held(self) -> Column:
        """The greatest share of each family's templates."""
        of = [[self._share(j) for j, f in enumerate(self.family) if f == k] for k in range(1, len(FAMILIES) + 1)]
        return F.array(*(F.greatest(*ts) if len(ts) > 1 else ts[0] for ts in of))

    def _best_share(self) -> Column:
        return F.array_max(self._held())

    def _best_family(self) -> Column:
        return F.array_position(self._held(), self._best_share())

    def _scores(self) -> list[Column]:
        return [F.get("sums", F.lit(k)) + F.lit(b) for k, b in enumerate(self.bias)]

    def _most(self) -> Column:
        return F.greatest(*self._scores()[1:])

    def _probability(self) -> Column:
        """The probability of the likeliest family."""
        total = F.lit(0.0)
        for z in self._scores():
            total = total + F.exp(z - self._most())
        return 1 / total

    def _anchors(self, common: dict[str, int]) -> list[str]:
        """Words without which no family can reach ``least``, chosen among few occurrences (``common``) first."""
        limit = math.log(self.least / (1 - self.least)) if self.least < 1 else math.inf
        speaks = {g: most for g, ws in self.weights.items() if max(most := [max(0.0, x - ws[0]) for x in ws[1:]]) > 0}

        def bounds(chosen: set[str]) -> list[float]:
            left = [m for g, m in speaks.items() if not chosen & set(g.split(" "))]
            return [b - self.bias[0] + sum(m[k] for m in left) for k, b in enumerate(self.bias[1:])]

        out: set[str] = set()
        while max(bound := bounds(out)) >= limit:
            worth: dict[str, float] = {}
            for g, m in speaks.items():
                if not out & set(g.split(" ")):
                    for w in set(g.split(" ")):
                        worth[w] = worth.get(w, 0.0) + sum(x for x, u in zip(m, bound, strict=True) if u >= limit)
            if not worth:  # the intercepts alone name a family: every paragraph counts
                return sorted({w for g in self.vocabulary for w in g.split(" ")})
            out.add(max(sorted(worth), key=lambda w: worth[w] / (1 + common.get(w, 0))))
        for w in sorted(out, key=lambda w: (-common.get(w, 0), w)):
            if max(bounds(out - {w})) < limit:
                out.discard(w)
        return sorted(out)

    def judge(self, docs: DataFrame) -> DataFrame:
        """KEYS of the paragraphs of ``docs`` (id, text) that count, once each, with family (its number), named, sure and held."""
        return self.judge_grams(paragraphs(docs, self.anchors))

    def judge_grams(self, grams: DataFrame) -> DataFrame:
        """The same from KEYS and grams of paragraphs; those that can't be named or unknown are left out before anything is summed."""
        anchored = F.exists("grams", lambda g: g.isin([_PLACE[a] for a in self.anchors])) if self.anchors else F.lit(False)
        found = self._summed(grams.filter(anchored | F.col("cue")))
        family = F.array_position(F.array(*self._scores()[1:]), self._most()).cast("int")
        out = found.select(*KEYS, family.alias("family"), (self._probability() >= self.least).alias("named"), self._held().alias("held"))
        out = out.withColumn("sure", F.col("named") & (F.element_at("held", F.col("family")) >= CONFIRM))
        return out.filter("sure OR unit = 0 AND (cue OR named)").dropDuplicates(KEYS[:5])  # rows that repeat a text


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", model: LicenceModel | None = None) -> DataFrame:
    """id, n_notices, n_unknown and licences (confirmed families, sorted, comma-joined) of each row of ``docs``."""
    if model:
        judged = Saved(model.judge(docs.select(F.col(id).alias("id"), F.col(text).alias("text"))), "licence-paragraphs")
    else:
        grams = known_grams(docs, id, text)
        judged = Saved(LicenceModel(docs, id, text, grams.df).judge_grams(grams.df), "licence-paragraphs")
        grams.drop()
    lines, windows = (judged.df.filter(F.col("unit") == unit) for unit in (0, 1))
    sure = lines.filter("sure")
    place = ["id", "t", "block"]
    other = sure.select(*(F.col(c).alias(f"l_{c}") for c in (*place, "family", "begin", "end")))
    same = (F.col("id") == F.col("l_id")) & (F.col("t") == F.col("l_t")) & (F.col("block") == F.col("l_block"))
    apart = windows.filter("sure").join(other.hint("merge"), same & (F.col("family") == F.col("l_family")) & (F.col("l_begin") < F.col("end")) & (F.col("l_end") > F.col("begin")), "left_anti")
    fresh = F.col("begin") >= F.coalesce(F.lag("end").over(W.partitionBy(*place, "family").orderBy("no")), F.lit(0))
    notices = Saved(apart.select(*place, "family", "begin", "end", fresh.alias("fresh")), "licence-windows")
    part = notices.df.select(*(F.col(c).alias(f"l_{c}") for c in (*place, "family", "begin", "end")))
    covered = same & (F.col("l_begin") < F.col("end")) & (F.col("l_end") > F.col("begin")) & (F.element_at("held", F.col("l_family")) > 0)
    unknown = lines.filter("(cue OR named) AND NOT sure").join(part.hint("merge"), covered, "left_anti")
    none = F.lit(None).cast("int")
    counted = sure.select("id", F.lit(1).alias("notice"), F.lit(0).alias("unknown"), "family")
    counted = counted.unionByName(notices.df.select("id", F.col("fresh").cast("int").alias("notice"), F.lit(0).alias("unknown"), "family"))
    counted = counted.unionByName(unknown.select("id", F.lit(0).alias("notice"), F.lit(1).alias("unknown"), none.alias("family")))
    names = F.transform(F.collect_set("family"), lambda f: F.element_at(F.array(*map(F.lit, FAMILIES)), f))
    by_id = Saved(
        counted.groupBy("id").agg(F.sum("notice").alias("n_notices"), F.sum("unknown").alias("n_unknown"), F.array_join(F.array_sort(names), ",").alias("licences")), "licences"
    )
    judged.drop()
    notices.drop()
    results = by_id.df.withColumnRenamed("id", "__id")
    out = docs.select(F.col(id)).join(sized(results, by_id.count()), F.col(id) == F.col("__id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(id, zero("n_notices"), zero("n_unknown"), F.coalesce("licences", F.lit("")).alias("licences"))
