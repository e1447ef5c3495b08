"""The corpus pipeline against brute-force versions of its stages."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

import corpus_pipeline as cp
from periodika.llm.common import table


def _shingles5(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(brute.LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def staged(spark, small, tmp_path_factory):
    """What each stage was given and what it returned."""
    docs, out = table(spark, small, "documents"), []
    for i, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp(f"stage{i}") / "out")
        stage(spark, docs, small).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(staged):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(after.columns == columns for _, _, after in staged[:-1])
    assert set(columns) < set(staged[-1][2].columns)


def test_quality_rejects_what_the_labels_reject(spark, small, staged):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, small, "labels").collect()}
    kept = _texts(staged[0][2])
    judged = [d for d in _texts(staged[0][1]) if d in labels]
    assert sum((d in kept) == (labels[d] == 1) for d in judged) / len(judged) > 0.95


def test_one_of_each_group_stays(staged, monkeypatch):
    before, after = _texts(staged[1][1]), _texts(staged[1][2])
    monkeypatch.setattr(brute, "shingles", _shingles5)
    assert set(after) == {d for d, (_, c) in brute.components(before).items() if d == c}


def test_contaminated_documents_go(spark, small, staged):
    before, after = _texts(staged[2][1]), _texts(staged[2][2])
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()]
    assert set(after) == {d for d, x in brute.contamination(before, items).items() if not x[4]}


def test_secrets_are_replaced(staged):
    before, after = _texts(staged[3][1]), _texts(staged[3][2])
    assert set(before) == set(after)
    assert not any(brute.secrets(t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not brute.secrets(t) and "[secret]" not in after[d])


def test_rates_are_positive(staged):
    rows = staged[4][2].collect()
    assert rows and all(r["rate"] > 0 for r in rows)


CLASH = ["score", "predicted", "n_words", "n_hit", "hits", "items", "contaminated", "base", "spans", "id", "kept", "rate", "print", "n", "keys", "__text"]


@pytest.mark.parametrize("at", range(len(cp.STAGES)))
def test_odd_rows_and_clashing_columns(spark, small, at):
    """Nulls, empty and long texts, repeated rows and an empty table; columns named like the operators' own come back as they were."""
    from pyspark.sql import functions as F

    name, stage = cp.STAGES[at]
    long = " ".join(f"word{i % 977}" for i in range(20_000))
    good = table(spark, small, "documents").orderBy("doc_id").limit(20).collect()
    rows = [(None, None, None, None), (900_001, None, "en", "s"), (900_002, "", "en", "s"), (900_003, long, "en", "s"), (900_004, long + " end", None, None), (900_005, "twice here", "en", "s"), (900_005, "twice here", "en", "s")]
    rows += [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in good]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASH})
    out = stage(spark, df, small)
    last = at == len(cp.STAGES) - 1
    assert last or out.columns == df.columns
    got = out.collect()
    for r in got:
        for c in CLASH if not last else [c for c in CLASH if c != "rate"]:
            assert r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}"
    ids = [r["doc_id"] for r in got]
    if name in ("near-duplicates", "decontamination", "secrets"):
        assert {None, 900_001, 900_002, 900_003} <= set(ids)
        assert ids.count(900_005) == (1 if name == "near-duplicates" else 2) and (900_004 in ids) == (name != "near-duplicates")
        assert next(r["text"] for r in got if r["doc_id"] == 900_003) == long
    empty = stage(spark, df.limit(0), small)
    assert empty.count() == 0 and set(df.columns) <= set(empty.columns) | ({"rate"} if last else set())


def test_run_is_the_stages_one_after_another(spark, small, staged):
    got = sorted((r["doc_id"], r["rate"]) for r in cp.run(spark, small).select("doc_id", "rate").collect())
    assert got == sorted((r["doc_id"], r["rate"]) for r in staged[-1][2].select("doc_id", "rate").collect())
