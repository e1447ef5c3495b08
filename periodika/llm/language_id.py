"""Language identification with bit-sliced Bloom filters over byte n-grams.

One table of ``CELLS`` words serves all languages: bit l of a cell belongs to language l's Bloom filter, so ANDing the
``HASHES`` cells of an n-gram gives at once the mask of all languages that have it. A text's votes for a language are the
popcount of that bit over its n-grams, corrected for the filter's false positives, f = fill^HASHES: (votes - n f) / (1 - f).

A filter holds the n-grams that are at least ``NEAR`` times as frequent in its language as in any other, the
``GRAMS`` most frequent of them. Learning reads a sample of at most ``SAMPLE`` labelled texts a language (a hash of the id
chooses); classifying reads every text whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if no labels are there. A
text with letters but no known n-gram gets the language with most labelled texts and score 0. Ties go to the language
first in alphabetical order. Beyond 64 languages a cell is several words, one for each 64. Repeated rows, and labels that disagree
on one text, each count; texts are read whole; empty tables give empty results; columns lang_pred and score of the input give
way to the operator's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import bounded_batches, bounded_sample, slices, with_text_columns

SAMPLE = 1500
GRAMS = 20_000
NEAR = 0.5
#: Times that a gram must come in a language's sample, where any comes so often.
LEAST = 3
SIZE = 4
CELLS = 1 << 20
HASHES = 2
_SEED = (tv.U(0x9E3779B97F4A7C15), tv.U(0xC2B2AE3D27D4EB4F))

#: ASCII letters in lower case and all bytes beyond ASCII stay; everything else is a blank.
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers, and where each text's begin: each text has a blank on either side."""
    data, offsets = tv.utf8(column)
    n = len(offsets) - 1
    padded = np.full(len(data) + 2 * n + SIZE, 32, np.uint8)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(n), np.diff(offsets)) + 1] = _LETTERS[data]
    x = padded.astype(np.uint32)
    total = len(data) + 2 * n
    g = x[:total].copy()
    for j in range(1, SIZE):
        g = (g << np.uint32(8)) | x[j : total + j]
    at = offsets + 2 * np.arange(n + 1)
    # runs of blanks tell nothing
    real = ~((padded[:total] == 32) & (padded[1 : total + 1] == 32))
    for j in range(1, SIZE):
        edge = at[1:] - j
        real[edge[edge >= 0]] = False
    kept = np.concatenate([[0], np.cumsum(real)])
    return g[real], kept[at]


@dataclass
class Model:
    languages: list[str]
    cells: np.ndarray  # a row for each 8 or 64 languages
    false_positives: np.ndarray
    fallback: int

    def classify(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The place of the language of each text, and its share of the corrected votes."""
        g, at = grams(column)
        x = g.astype(tv.U)
        places = [((x * seed) >> tv.U(64 - 20)).astype(np.int64) for seed in _SEED[:HASHES]]
        n = np.diff(at)
        votes = np.zeros((len(n), len(self.languages)))
        kind, wide = self.cells.dtype.type, 8 * self.cells.itemsize
        for word, cells in enumerate(self.cells):
            mask = cells[places[0]]
            for place in places[1:]:
                mask = mask & cells[place]
            for i in range(word * wide, min((word + 1) * wide, len(self.languages))):
                f = self.false_positives[i]
                got = tv.sums_by_text(((mask >> kind(i % wide)) & kind(1)).astype(np.int64), at)
                votes[:, i] = np.maximum(0.0, (got - n * f) / (1 - f))
        total = votes.sum(axis=1)
        best = votes.argmax(axis=1)
        share = np.divide(votes[np.arange(len(n)), best], total, out=np.zeros(len(n)), where=total > 0)
        return np.where(total > 0, best, self.fallback), share


def _gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for piece in slices(batch, 1, 2 << 20):
                langs = np.array(piece.column(0).to_pylist(), dtype=object)
                for one in dict.fromkeys(langs):
                    g, _ = grams(piece.column(1).filter(pa.array(langs == one)))
                    found, n = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    bounded_batches(df.sparkSession)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
    return df.select(F.col(lang), F.col(text)).mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the languages of ``labelled``; None if it has none."""
    rows = bounded_sample(labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()), id, sample, lang)
    # a language of so few texts that no gram comes LEAST times keeps those that come most often
    counts = _gram_counts(rows, text, lang).withColumn("top", F.max("n").over(Window.partitionBy("lang"))).filter(F.col("n") >= F.least(F.lit(LEAST), "top")).drop("top")
    share = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    near = share.withColumn("most", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") >= NEAR * F.col("most"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= GRAMS)
    got = ranked.select("lang", "gram").collect()  # GRAMS a language at most
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return None
    kind, wide = (np.uint8, 8) if len(languages) <= 8 else (np.uint64, 64)
    cells = np.zeros((-(-len(languages) // wide), CELLS), kind)
    place = {name: i for i, name in enumerate(languages)}
    grams_of: dict[str, list[int]] = {name: [] for name in languages}
    for r in got:
        grams_of[r["lang"]].append(r["gram"])
    for name, i in place.items():
        x = np.array(grams_of[name], tv.U)
        for seed in _SEED[:HASHES]:
            cells[i // wide, ((x * seed) >> tv.U(64 - 20)).astype(np.int64)] |= kind(1 << i % wide)
    fill = np.array([((cells[i // wide] >> kind(i % wide)) & kind(1)).mean() for i in range(len(languages))])
    by_size = labelled.filter(F.col(lang).isin(languages)).groupBy(lang).count().orderBy(F.desc("count"), lang).first()
    return Model(languages, cells, fill**HASHES, place[by_size[0]])


def identify(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score."""
    if model is None:
        return docs.select(*[c for c in keep if c not in ("lang_pred", "score")], F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB up to 8 languages, else 8 MB for each 64
    names = np.array([*model.languages, "und"], dtype=object)

    def compute(column: pa.Array) -> list[pa.Array]:
        found, share = shipped.value.classify(column)
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
        return [pa.array(names[np.where(lettered, found, len(names) - 1)], pa.string()), pa.array(np.where(lettered, share, 0.0))]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return with_text_columns(docs, keep, compute, fields, text)
