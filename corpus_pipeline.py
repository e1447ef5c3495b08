"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes any further columns, also ones with the names that an operator gives its results: they come back as they were (``set_apart``).
An empty table gives an empty one with the same columns, and texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodika.llm import decontaminate as dc
from periodika.llm import mixing, near_dedup, quality_classifier, secret_scan
from periodika.llm.common import Saved, set_apart, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other (as statistics of 0), rows without id as well; a score of exactly 0.5 stays; repeated
    rows share their fate; of labels that disagree the majority holds, 0 on a tie.
    """
    inner, restored = set_apart(docs, "doc_id", "text")
    trees = quality_classifier.learn(inner, table(spark, sf_dir, "labels").select("doc_id", "quality"), F.lit(True))
    return restored(quality_classifier.score(inner, trees, inner.columns).filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the smallest id: shingles of five words, similarity 0.8.

    Null texts and texts without words have no copies and stay; rows without id stay; of repeated rows one stays; an id with different texts
    is several documents.
    """
    inner, restored = set_apart(docs, "doc_id", "text")
    return restored(near_dedup.deduplicate(inner, k=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go: those of whose words a twentieth or more are in a passage, exactly that included.

    Null and empty texts are clean; rows without id and repeated rows are judged like any other; without a benchmark all stay.
    """
    inner, restored = set_apart(docs, "doc_id", "text")
    return restored(dc.decontaminate(inner, table(spark, sf_dir, "benchmark"), inner.columns).filter(~F.col("contaminated")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark, ``n_chars`` (if there) follows; all rows stay, null texts as they are, repeated rows each.

    Spans that overlap are one mark; of candidates with equal p-values all are found or none; an empty table stays empty.
    """
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rate at which to draw them for the target weights; those with rate 0 go.

    Null and empty texts have 0 tokens and the rate of their posterior; repeated rows have equal rates; the new columns n_tokens, p_clean,
    p_low, p_toxic, rate and converged take the place of columns of these names.
    """
    inner, restored = set_apart(docs, "doc_id", "text")
    mixed = mixing.mix(inner, table(spark, sf_dir, "labels"), inner.columns).filter("rate > 0")
    new = [c for c in mixed.columns if c not in inner.columns]
    old = [c for c in docs.columns if c not in new]
    back = dict(zip(docs.columns, inner.columns, strict=True))
    return mixed.select(*(F.col(back[c]).alias(c) for c in old), *new)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixture", mixture),
]

#: SQL can't express the classifier and the sketches; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        saved = Saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            before.drop()
        docs, before = saved.df, saved
    return docs
