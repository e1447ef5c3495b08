"""The numbered operators against brute force, round trips and held-out labels, with the defined results of odd inputs."""

from __future__ import annotations

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from periodika.llm import decontaminate as dc
from periodika.llm import components, language_id, license_scan, mixing, near_dedup, quality_classifier, quality_rules, queries, secret_scan, url_filter, warc
from periodika.llm import textvec as tv
from periodika.llm.common import one_label, table

HEX = hashlib.sha256(b"x").hexdigest()
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, None, None), (2, "", "en", "s1"), (3, " \n\t ", "en", "s1"), (4, "one", "en", "s1"), (5, "éà ÜÖ ﬁ \U0001f600 x", "fr", None), (6, LONG, "en", "s2"), (7, LONG + " end", "en", "s2"),
    (8, f'Token: "{HEX}" and password = abcdefghijkl', "en", "s2"), (8, f'Token: "{HEX}" and password = abcdefghijkl', "en", "s2"), (9, "a b c", "de", "s3"), (10, "A B C", "de", "s3"),
    (11, "x\ny\nx\n\n \nx", "es", "s3"), (None, "no id here at all", "en", "s3"), (12, "12 34 !!", "en", "s3"), (13, "\r\x0b tab\x85nel  space", "en", "s3"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents, with columns named like the operators' own."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n_words": F.lit("clash"), "score": F.lit("clash"), "kept": F.lit("clash"), "spans": F.lit("clash"), "id": F.lit("clash"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def test_quality_rules_match_brute_force(docs, texts, spark, odd):
    for df in (docs, odd.select("doc_id", "text", "source", "n_words", "kept")):
        out = quality_rules.judge(df, ["doc_id", "text"]).collect()
        assert len(out) == df.count()
        for r in out:
            assert brute.quality_rules(r["text"]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
    assert quality_rules.judge(docs.limit(0), ["doc_id"]).count() == 0


def test_a_host_of_failures_takes_its_documents_with_it(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, "bad", "short") for i in range(200)] + [(1000, "bad", good)] + [(2000 + i, f"h{i % 5}", good) for i in range(200)] + [(3000, None, good)]
    out = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string"), ["doc_id"]).collect()}
    assert not out[1000]["kept"] and not out[1000]["base_failed"]
    assert out[2000]["kept"] and out[3000]["kept"] and not out[0]["kept"]


def test_decontamination_matches_brute_force(spark, small, docs, texts, odd):
    items = [(r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()] + [(900, None), (901, "..."), (902, "One"), (903, "a b C"), (None, "word1 word2 word3")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(i, t) for i, t in items if i is not None]
    for size in (dc.BLOCK_WINDOWS, 200):
        out = dc.decontaminate(docs.select("doc_id", "text"), bench, ["doc_id"], block_windows=size).collect()
        expected = brute.contamination(texts, want)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), dc.items_sha256(r["items"]), r["contaminated"]) for r in out}
        assert got == expected
    plan = dc.decontaminate(docs.select("doc_id", "text"), bench, ["doc_id"], block_windows=50)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the scan was written out; no task runs one Python node for each part of the benchmark
    for r in [*dc.decontaminate(odd, bench, ["doc_id", "text"]).collect(), *dc.decontaminate(odd, bench.unionByName(bench), ["doc_id", "text"], block_windows=10).collect()]:
        assert brute.contamination({0: r["text"]}, want)[0] == (r["n_words"], r["n_hit"], len(r["items"]), dc.items_sha256(r["items"]), r["contaminated"])
    assert dc.decontaminate(docs, bench.limit(0), ["doc_id"]).filter("contaminated").count() == 0
    assert dc.decontaminate(docs.limit(0), bench, ["doc_id"]).count() == 0


def test_near_duplicates_match_brute_force(spark, small, docs, texts):
    out = near_dedup.near_duplicates(docs, k=4).collect()
    want = brute.components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_duplicates_of_a_large_group_of_edits(spark):
    """Edits of one text, about 0.8 alike: most pairs aren't links, and components need every link that is there."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(words))
            if rng.random() < 0.5:
                words[at] = f"e{rng.randrange(10**6)}"
            else:
                del words[at]
        texts[i + 10] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, k=4).collect()}
    assert got == brute.components(texts)


def _blocks(n, ordered, words=40):
    """Texts of 9 of 12 blocks each: they meet on most band keys and share what most others have."""
    rng = random.Random(1)
    blocks = [" ".join(f"b{i}w{j}" for j in range(words)) for i in range(12)]
    picks = [rng.sample(range(12), 9) for _ in range(n)]
    return {d + 1: " ".join(blocks[i] for i in (sorted(p) if ordered else p)) for d, p in enumerate(picks)}


def test_near_duplicates_of_boilerplate(spark, monkeypatch):
    """Pairs compared grow with the different texts and their links, not with the square of the documents."""
    compared, verified = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, sets, percent: (compared.append(pairs.count()), verified(pairs, sets, percent))[1])
    totals = []
    for n in (200, 400):
        texts = _blocks(n, True)
        compared.clear()
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=4).collect()}
        assert got == brute.components(texts)
        totals.append(sum(compared))
    assert totals[1] < 2.2 * totals[0] and totals[1] < 400 * 399 / 2 / 8


def test_near_duplicates_with_frequent_parts_of_several_sizes(spark):
    """Texts that share only frequent passages, with more or fewer words of their own: links depend on the sizes alone."""
    rng = random.Random(4)
    texts = {}
    for d in range(300):
        parts = rng.choice([[0, 1, 2, 3, 4], [0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [6, 7, 8], [6, 7, 8, 9]])
        texts[d] = " ".join(" ".join(f"b{i}w{j}" for j in range(25)) for i in parts) + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.choice([0, 5, 12, 18, 22, 30])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=4).collect()}
    assert got == brute.components(texts)


def test_components_of_long_paths(spark, monkeypatch):
    rounds, unfinished = [], components._unfinished
    monkeypatch.setattr(components, "_unfinished", lambda edges: (rounds.append(1), unfinished(edges))[1])
    ids = list(range(5000))
    random.Random(1).shuffle(ids)
    links = [*zip(ids, ids[1:], strict=False), (6000, 6001), (6001, 6001), (6001, 6000), (None, 3), (7000, 7000)]
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).df.collect()}
    assert got == {**dict.fromkeys(ids, 0), 6000: 6000, 6001: 6000} and len(rounds) < 20
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).df.count() == 0


def test_near_duplicates_of_odd_documents(spark, odd):
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(odd, k=4).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 8, 9, 10)] == [1, 2, 3, 4, 8, 9, 9]
    assert got[1]["n_shingles"] == 0 and got[4]["n_shingles"] == 1 and got[None]["kept"] and got[None]["component_id"] is None
    assert not got[10]["kept"] and got[6]["component_id"] == got[7]["component_id"] == 6
    left = [r["doc_id"] for r in near_dedup.deduplicate(odd, k=4).collect()]
    assert sorted(x for x in left if x) == [1, 2, 3, 4, 5, 6, 8, 9, 11, 12, 13] and None in left
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0 and near_dedup.deduplicate(odd.limit(0)).columns == odd.columns


def test_an_id_with_two_texts_loses_neither(spark):
    long = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    rows = [(2, long("a"), "x"), (5, long("a"), "copy"), (5, long("b"), "own"), (6, long("b"), "copy of 5"), (7, long("c"), "y"), (7, long("c"), "y"), (None, long("a"), "no id"), (8, None, "none"), (8, None, "none")]
    got = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, note string")).collect()
    assert sorted((r["doc_id"] or 0, r["note"]) for r in got) == [(0, "no id"), (2, "x"), (5, "own"), (7, "y"), (8, "none")]


def test_hashes_of_structured_strings_differ():
    """Thue-Morse strings collide modulo a power of two, whatever the base."""
    import numpy as np

    from periodika.llm import textvec as tv

    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    data = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    words = tv.Words(data, np.array([0, len(data)]), ~tv.BLANK[data])
    assert words.hash[0] == words.hash[2] != words.hash[1]


def test_hashes_do_not_depend_on_the_place_in_a_long_text():
    rng = np.random.default_rng(5)
    for size in (tv.BLOCK - 1, tv.BLOCK, tv.BLOCK + 1, 7 * tv.BLOCK + 3):
        data = rng.integers(97, 123, size).astype(np.uint8)
        span = data[: min(size // 2, tv.BLOCK + 50)]
        at = np.array([0, size // 2])
        data[size // 2 : size // 2 + len(span)] = span
        one, two = tv.span_hash(tv.prefix(data), at, at + len(span))
        assert one == two == tv.span_hash(tv.prefix(span), np.array([0]), np.array([len(span)]))[0]
        assert one != tv.span_hash(tv.prefix(data), at[:1], at[:1] + len(span) - 1)[0]


def test_sums_by_text_with_empty_texts():
    at = np.array([0, 0, 3, 3, 3, 5, 5])
    assert tv.sums_by_text(np.array([1, 2, 3, 4, 5]), at).tolist() == [0, 6, 0, 0, 9, 0]
    assert tv.sums_by_text(np.array([True, False, True, True, True]), at).tolist() == [0, 2, 0, 0, 2, 0]
    assert tv.sums_by_text(np.zeros(0, bool), np.array([0, 0])).tolist() == [0]
    assert tv.sums_by_text(np.zeros(0, bool), np.array([0])).tolist() == []


def test_sketches_estimate_similarity_and_fill_every_bin():
    import numpy as np

    a = np.unique(np.random.default_rng(1).integers(0, 2**62, 2000).astype(np.uint64))
    b = np.concatenate([a[:1600], np.unique(np.random.default_rng(2).integers(0, 2**62, 400).astype(np.uint64))])
    bins = near_dedup.sketches([a, b, a[:1], a[:3]])
    assert (bins != np.uint64(2**64 - 1)).all()
    assert abs((bins[0] == bins[1]).mean() - 1600 / 2400) < 0.1
    assert (near_dedup.sketches([a[:1]]) == bins[2]).all()


def test_secrets_match_brute_force(docs, texts, odd):
    for df in (docs, odd):
        for r in secret_scan.scan(df, ["doc_id", "text"]).select("text", secret_scan.spelt("base").alias("base"), secret_scan.spelt("spans").alias("all")).collect():
            base = brute.secrets(r["text"])
            assert (r["base"].split(",") if r["base"] else []) == base
            assert [s for s in (r["all"].split(",") if r["all"] else []) if not s.startswith("random")] == base
    assert secret_scan.scan(odd.limit(0), ["doc_id"]).count() == 0


def test_random_spans_equal_a_step_up_over_all_candidates(spark, docs, texts):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = ["0123456789abcdef", letters + "0123456789", letters + letters.upper() + "0123456789", letters.upper() + "234567", letters + letters.upper() + "0123456789+/"]
    cases = dict(list(texts.items())[:60])
    for i in range(60):
        keys = ["".join(rng.choice(a) for _ in range(rng.choice([7, 10, 15, 20, 30, 44, 64, 100]))) for a in rng.sample(alphabets, 2)]
        cases[10**6 + i] = f"é see {keys[0]}, {'-'.join(keys)} and facade-decade_added 2024-01-{i + 1:02} tel +49/30/{rng.randrange(10**6)} ENDS-{keys[1][:6]}"
    cases[1] = None
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    natural = secret_scan.measure(docs)
    monkey = secret_scan.measure
    secret_scan.measure = lambda *a, **k: natural
    try:
        out = secret_scan.scan(df, ["doc_id"]).select("doc_id", secret_scan.spelt("spans").alias("s")).collect()
    finally:
        secret_scan.measure = monkey
    want = brute.random_spans(cases, secret_scan.Battery(natural), secret_scan.WEIGHTS, secret_scan.LENGTHS, secret_scan.SHORTEST, secret_scan.FDR, secret_scan.BINS)
    got = {r["doc_id"]: [s for s in r["s"].split(",") if s.startswith("random")] for r in out}
    assert {d: sorted(s) for d, s in got.items()} == {d: sorted(s) for d, s in want.items()}
    assert sum(map(bool, got.values())) > 40


def test_natural_text_is_measured_on_every_text(spark):
    """Against a walk over all pieces of all different texts: each text counts, also beyond the first thousands, and equal ones count once."""
    import math

    rng = random.Random(5)
    texts = ["".join(rng.choice("etaoinshrdlu" * 3 + "bcdfgkmpvwy") + rng.choice(["", "", " ", " ", "é", "-"]) for _ in range(rng.randrange(60, 160))) for _ in range(1500)]
    texts += [t.title() for t in texts[:700]] + ["".join(rng.choice(["Ab", "zz9", "q", "Ω ", "k_"]) for _ in range(90)) for _ in range(700)]
    texts += [f"ba{i % 7}na" * 30 + " the end" for i in range(5)] + ["", "é"]
    natural = secret_scan.measure(spark.createDataFrame([(t,) for t in [*texts, *[texts[0]] * 3000, None]], "text string"))
    seen: dict = {}
    for t in set(texts):
        bare = "".join(w for w in secret_scan._PART.findall(t) if len(w) < secret_scan.WORD)
        for i in range(0, len(bare) - 31, 32):
            k, symbols = secret_scan.encoding(bare[i : i + 32])
            chi, runs, serial = secret_scan.statistics(np.array([secret_scan._RANKS[k][c] for c in symbols]), k)
            seen.setdefault(k, []).append(((chi - (k - 1)) / 32, runs / math.sqrt(32), serial / math.sqrt(32)))
    known = {k: np.percentile(np.array(v), [16, 50, 84], axis=0) for k, v in seen.items() if k in (26, 36, 52, 62) and len(v) >= 30}
    assert len(known) >= 3 and set(natural.away) == set(natural.scores) == set(known)
    near = {"abs": 1.5 / secret_scan.STEPS}
    for k, q in known.items():
        assert natural.away[k] == pytest.approx(max(q[1][0], 0.0), **near)
        for (mean, spread), j in zip(natural.scores[k], (1, 2), strict=True):
            assert mean == pytest.approx(q[1][j], **near)
            assert spread == pytest.approx(max((q[2][j] - q[0][j]) / 2 * math.sqrt(32), 1.0), abs=6 / secret_scan.STEPS)


def test_added_spans_of_the_given_documents_are_keys(docs, texts):
    """No false discovery in the documents at hand: what the battery adds also looks like a key to the eye of a pattern."""
    import re

    rows = secret_scan.scan(docs, ["doc_id"]).select("doc_id", F.explode("spans").alias("s")).filter("s.kind = 3").select("doc_id", "s.start", "s.end").collect()
    for r in rows:
        assert re.fullmatch(r"[0-9a-f]{16,}|AKIA[A-Z0-9]{12,}|(?=.*[0-9])(?=.*[A-Z])[A-Za-z0-9+/_=-]{16,}", texts[r["doc_id"]][r["start"] : r["end"]]), r


def test_lengths_that_no_threshold_allows(spark):
    battery = secret_scan.Battery(secret_scan.Natural({}, {}))
    for k, least in battery.least.items():
        n = least - 1
        if n >= secret_scan.SHORTEST:
            assert battery.natural.p(k, n, secret_scan._most_even(k, n), 0.0, 0.0, k == 10 and n < secret_scan.NUMBER) > secret_scan.FDR


def test_languages_equal_plain_sets(docs, texts):
    """The filters as Python sets of cells, one language and one n-gram at a time; also with more languages than bits in a word."""
    import pyarrow as pa

    model = language_id.learn(docs)
    many = language_id.learn(docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 30).cast("string"))))
    assert len(many.languages) > 64 and len(many.cells) == 2
    some = [t for t in list(texts.values())[:40]] + ["", "x", "été 12"]
    for m in (model, many):
        wide = 8 * m.cells.itemsize
        sets = [{int(c) for c in ((m.cells[i // wide] >> m.cells.dtype.type(i % wide)) & m.cells.dtype.type(1)).nonzero()[0]} for i in range(len(m.languages))]
        best, share = m.classify(pa.array(some))
        for text, b, x in zip(some, best, share, strict=True):
            letters = bytes(c if c >= 128 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in text.encode())
            grams = [g for i in range(len(letters) - 1) if not (g := (b" " + letters + b" ")[i : i + 4]).startswith(b"  ")]
            votes = []
            for cells, f in zip(sets, m.false_positives, strict=True):
                got = sum(all(((int.from_bytes(g, "big") * int(seed)) % 2**64) >> 44 in cells for seed in language_id._SEED) for g in grams)
                votes.append(max(0.0, (got - len(grams) * f) / (1 - f)))
            if sum(votes):
                assert abs(x - max(votes) / sum(votes)) < 1e-9 and votes[b] == max(votes)


def test_randomness_battery_tells_keys_from_words(spark):
    rng = random.Random(3)
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64)) for _ in range(40)]
    words = ["".join(rng.choice(["tion", "ment", "enter", "ation", "eau", "scher", "heit", "ung"]) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(i, f"see {w} now") for i, w in enumerate(keys + words)], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in secret_scan.scan(df, ["doc_id"]).collect()}
    assert sum(bool(out[i]) for i in range(40)) >= 36
    assert not any(out[i] for i in range(40, 240))


def test_randomness_battery_knows_each_encoding(spark):
    rng = random.Random(4)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda symbols, n: "".join(rng.choice(symbols) for _ in range(n))
    kinds = [
        *((a, n) for a in (lower + digits, upper + digits, upper + "234567", lower + upper, lower + upper + digits) for n in (80, 128)),
        ("0123456789ABCDEF", 16), ("0123456789ABCDEF", 19), ("0123456789ABCDEF", 32),
    ]
    keys = [some(a, n) for a, n in kinds for _ in range(20)]
    glued = ["-".join(some("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)) for _ in range(20)]
    glued += ["the-user-key-of-the-service=" + some(lower + upper + digits, 64) for _ in range(20)]
    words = ["-".join(rng.choice(["tion", "ment", "enter", "ation", "eau", "scher", "heit", "ung"]) for _ in range(12)) for _ in range(100)]
    words += [f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}/20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}" for _ in range(100)]
    df = spark.createDataFrame([(i, f"see {w} now") for i, w in enumerate(keys + glued + words)], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in secret_scan.scan(df, ["doc_id"]).collect()}
    n = len(keys) + len(glued)
    for first in range(0, n, 20):
        assert sum(bool(out[i]) for i in range(first, first + 20)) >= 17, first // 20
    assert not any(out[i] for i in range(n, n + 200))
    at = len(keys) + 20
    assert all(max(s["end"] for s in out[i]) == 4 + len(glued[i - len(keys)]) for i in range(at, n) if out[i])


def test_redaction_leaves_no_secret_and_nothing_else_changes(odd):
    before = {(r["doc_id"]): r["text"] for r in odd.collect()}
    out = secret_scan.redact(odd)
    assert out.columns == odd.columns
    for r in out.collect():
        if r["doc_id"] == 8:
            assert r["text"] == '[secret]" and [secret]' and r["n_chars"] == len(r["text"])
        else:
            assert r["text"] == before[r["doc_id"]]


def test_languages_held_out(spark, small, docs):
    out = queries.op1_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_languages_of_odd_documents(docs, odd):
    model = language_id.learn(docs)
    got = {r["doc_id"]: r for r in language_id.identify(odd, model, ["doc_id", "score"]).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 12))
    assert all(got[i]["lang_pred"] in model.languages for i in (4, 5, 6, 9))
    assert language_id.learn(odd.limit(0)) is None
    assert language_id.identify(odd, None, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(odd.limit(0), model, ["doc_id"]).count() == 0


def test_classification_does_not_depend_on_neighbours(docs):
    import pyarrow as pa

    model = language_id.learn(docs)
    some = [r["text"] for r in docs.select("text").limit(20).collect()]
    together = model.classify(pa.array(some))[1].tolist()
    assert together == [model.classify(pa.array([t]))[1][0] for t in some]


def test_quality_held_out(spark, docs):
    big = "/root/testdata/sf0.01"
    out = queries.op7_quality_classifier(spark, big).join(table(spark, big, "labels").select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) / len(out) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in out)


def test_quality_of_odd_documents(spark, small, docs, odd):
    labels = table(spark, small, "labels")
    trees = quality_classifier.learn(docs, labels, F.lit(True))
    got = quality_classifier.score(odd, trees, ["doc_id", "score"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.score(odd.limit(0), trees, ["doc_id"]).count() == 0
    none = quality_classifier.learn(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality_classifier.score(odd, none, ["doc_id"]).collect()} == {0.5}


def test_flat_trees_agree_with_a_walk():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    trees = quality_classifier.grow(x, y, trees=20)

    def walk(row):
        total = trees.base
        for at in trees.root:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97


def _best_rates(p, tokens, targets):
    """Projected gradient descent on the rates themselves, in the token-weighted metric."""
    import numpy as np

    share = tokens / tokens.sum()
    rates = np.ones(len(p))
    step = 0.9 / (np.linalg.eigvalsh((p * share[:, None]).T @ p).max() + mixing.NEARNESS)
    for _ in range(60_000):
        miss = (p * (share * rates)[:, None]).sum(0) - targets
        rates = np.maximum(0, rates - step * (p @ miss + mixing.NEARNESS * (rates - 1)))
    return rates


def test_mixing_finds_the_best_rates(spark, small, docs, odd):
    import numpy as np

    labels = table(spark, small, "labels")
    out = mixing.mix(docs, labels, ["doc_id"]).collect()
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in out])
    tokens, rates = np.array([float(r["n_tokens"]) for r in out]), np.array([r["rate"] for r in out])
    assert np.allclose(p.sum(1), 1) and (rates >= 0).all()
    best = _best_rates(p, tokens, np.array([mixing.TARGETS[d] for d in mixing.DOMAINS]))
    assert np.abs(rates - best).max() < 0.01  # every document's rate
    got, want = ((p * (tokens * x)[:, None]).sum(0) / tokens.sum() for x in (rates, best))
    assert np.abs(got - want).max() < 0.001 and all(r["converged"] for r in out)
    assert mixing.mix(odd, labels, ["doc_id"]).count() == len(ODD)
    assert mixing.mix(odd.limit(0), labels, ["doc_id"]).count() == 0
    assert {round(r["p_clean"], 6) for r in mixing.mix(docs, labels.limit(0), ["doc_id"]).select("p_clean").distinct().collect()} == {1.0}


def test_statistics_of_texts_equal_plain_ones():
    """Bytes by class and distinct words, lines and windows, for texts of all lengths in one piece."""
    import pyarrow as pa

    rng = random.Random(5)
    some = [None, "", "\n", "one", "É|é\tB. b! B\n\nB. b! B", *("".join(rng.choice("aB1 .,!|#é\n\"") for _ in range(rng.randint(0, 400))) for _ in range(300))]
    got = quality_classifier.features(pa.array(some, pa.string()))
    for text, row in zip(some, got, strict=True):
        data = (text or "").encode()
        words, lines = [w for w in data.translate(bytes(32 if tv.BLANK[b] else b for b in range(256))).split(b" ") if w], [x for x in data.split(b"\n") if x]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        want = {
            "distinct_words": len(set(words)) / max(len(words), 1), "distinct_lines": len(set(lines)) / max(len(lines), 1), "repeated_windows": 1 - len(set(windows)) / max(len(windows), 1),
            **{k: sum(bool(member[b]) for b in data) / max(len(data), 1) for k, member in quality_classifier._CLASSES.items()},
        }
        assert {k: row[quality_classifier.FEATURES.index(k)] for k in want} == want


def test_toxic_words_are_counted_while_texts_are_read(spark, small, docs, monkeypatch):
    """Learning reads the labelled texts once; from the counted words follow the statistics that the texts themselves have."""
    import pyarrow as pa

    texts = pa.array([None, "", "bad word bad bad", "fine words here", "word"], pa.string())
    words, odds = mixing._words(texts), np.random.default_rng(1).normal(0, 4, mixing.BUCKETS)
    own = [np.unique(mixing._buckets(words)[words.at[i] : words.at[i + 1]], return_counts=True) for i in range(len(texts))]
    at = np.concatenate([[0], np.cumsum([len(o[0]) for o in own])])
    assert (mixing._strength(odds[np.concatenate([o[0] for o in own])], np.concatenate([o[1] for o in own]), at) == mixing.lexical(words, odds)).all()
    read = []
    monkeypatch.setattr(mixing, "with_text_columns", lambda *a, f=mixing.with_text_columns: read.append(1) or f(*a))
    mixing.learn(docs, table(spark, small, "labels"))
    assert len(read) == 1


def test_reachable_targets_are_met(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.2, 0.2, 0.2], 3000)
    tokens = rng.integers(1, 500, 3000)
    df = spark.createDataFrame([(int(t), *map(float, row)) for t, row in zip(tokens, p, strict=True)], "n long, a double, b double, c double")
    fit = mixing.fit_rates(df, "n", ["a", "b", "c"], [0.8, 0.15, 0.05])
    rate = fit.column(["a", "b", "c"])
    rates = np.array([r[0] for r in df.select(rate.alias("r")).collect()])
    assert fit.converged and np.abs(rates - _best_rates(p, tokens.astype(float), np.array([0.8, 0.15, 0.05]))).max() < 0.01
    assert not mixing.fit_rates(df, "n", ["a", "b", "c"], [0.8, 0.15, 0.05], rounds=1).converged
    row = df.agg(*(F.sum(F.col(x) * F.col("n") * rate).alias(x) for x in "abc")).first()
    assert np.abs(np.array([row[x] for x in "abc"]) / tokens.sum() - [0.8, 0.15, 0.05]).max() < 0.003


def test_labels_that_disagree(spark):
    rows = [(1, 1, 0), (1, 1, 1), (1, 0, None), (2, 0, 1), (2, 1, 1), (3, None, None), (None, 1, 1)]
    got = {r["doc_id"]: (r["quality"], r["toxic"]) for r in one_label(spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), "doc_id", "quality", "toxic").collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (None, None)}


def test_ranks_are_personalised_pagerank(spark):
    """Against a dense solution, on a random graph with hosts without links, and on a chain of 30 hosts."""
    import numpy as np

    rng = random.Random(8)
    links = {(rng.randrange(40), rng.randrange(60)): rng.randrange(1, 4) for _ in range(150)} | {(100 + i, 101 + i): 1 for i in range(30)}
    links = {(a, b): n for (a, b), n in links.items() if a != b}
    edges = spark.createDataFrame([(w, str(a), str(b), n) for (a, b), n in links.items() for w in ("trust", "distrust")], "way string, src string, dst string, n long")
    seeds = {3: 0.25, 7: 0.25, 100: 0.5}
    df = spark.createDataFrame([("trust", str(h), s) for h, s in seeds.items()], "way string, host string, seed double")
    got = {(r["way"], r["host"]): r["rank"] for r in url_filter.spread(url_filter._with_shares(edges), df).df.collect()}
    hosts = sorted({x for e in links for x in e} | set(seeds))
    at = {h: i for i, h in enumerate(hosts)}
    move = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in links.items():
        move[at[b], at[a]] = n / sum(m for (x, _), m in links.items() if x == a)
    seed = np.zeros(len(hosts))
    seed[[at[h] for h in seeds]] = list(seeds.values())
    none = np.flatnonzero(move.sum(0) == 0)
    move[:, none] = seed[:, None]  # what has no links goes back to the seeds
    rank = np.linalg.solve(np.eye(len(hosts)) - 0.85 * move, 0.15 * seed)
    assert sum(abs(got.get(("trust", str(h)), 0.0) - rank[at[h]]) for h in hosts) < 2e-3
    assert got["trust", "130"] > 0 and not any(w == "distrust" for w, _ in got)


def test_licences(spark, odd):
    rows = [
        (1, "Text.\nReleased under the MIT License."), (2, "Licensed under CC BY-NC 4.0.\nMore.\nLicensed under the Apache License, Version 2.0."), (3, "All rights reserved by the licence office."), (4, "Nothing here."),
        (5, "This work is licensed under the GNU General Public License, version 3."), (None, "Released under the MIT License."),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["licences"] for i in (1, 2, 3, 4, 5)] == ["MIT", "Apache-2.0,CC-BY-NC", "", "", "GPL"]
    assert got[3]["n_unknown"] == 1 and got[None]["n_notices"] == 0
    assert license_scan.scan(odd).count() == len(ODD)
    assert license_scan.scan(odd.limit(0)).count() == 0


def test_licences_without_cue_wrapped_and_repeated(spark, docs):
    gpl = "This program is free software: you can\nredistribute it and/or modify it under the\nterms of the GNU General Public License as\npublished by the Free Software Foundation"
    prose = " ".join(f"word{i % 97}" for i in range(200))
    rows = [
        (1, "Distributed under the GNU GPL v3"), (2, "Terms: Apache 2.0"), (3, "text\nCC-BY-SA 4.0"), (4, gpl), (5, prose + "\n" + gpl + "\n" + prose), (6, "Released under the MIT License.\nwords\nReleased under the MIT License."),
        (7, prose), (8, prose + " Released under the MIT License. " + prose), (9, "The public office is closed.\n\nCopyright 1990 by nobody."), (9, "The public office is closed.\n\nCopyright 1990 by nobody."),
    ]
    model = license_scan.LicenceModel(docs)
    got = {r["doc_id"]: (r["n_notices"], r["n_unknown"], r["licences"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model=model).collect()}
    assert got == {
        1: (1, 0, "GPL"), 2: (1, 0, "Apache-2.0"), 3: (1, 0, "CC-BY-SA"), 4: (1, 0, "GPL"), 5: (1, 0, "GPL"), 6: (2, 0, "MIT"), 7: (0, 0, ""), 8: (1, 0, "MIT"), 9: (0, 1, ""),
    }


def test_licences_equal_a_walk_over_all_paragraphs(spark, small, texts, docs):
    """The same model in plain Python over every paragraph: nothing that could be named is ruled out beforehand."""
    rng = random.Random(6)
    templates = [t for family in license_scan.TEMPLATES.values() for t in family] + license_scan.DISTRACTORS
    model = license_scan.LicenceModel(docs)
    assert model.anchors and len(model.anchors) < len({w for g in model.vocabulary for w in g.split(" ")}) / 2
    cases = dict(texts)
    prose = [w for t in list(texts.values())[:20] for w in (t or "").split(" ")][:4000]
    for i in range(250):
        words = [*rng.sample(prose, rng.randrange(0, 150)), *rng.choice(templates).split(" "), *rng.sample(prose, rng.randrange(0, 60)), *rng.choice(templates).split(" ")[rng.randrange(3) :]]
        cases[10**6 + i] = "".join(w + rng.choice([" "] * 7 + ["\n", "\n \n"]) for w in words)
    df = spark.createDataFrame(list(cases.items()), "doc_id long, text string")
    names = license_scan.FAMILIES
    for r in license_scan.scan(df, model=model).collect():
        notices, unknown, families = brute.licences(cases[r["doc_id"]], model, license_scan.CUES, license_scan.CONFIRM, license_scan.WINDOW)
        assert (r["n_notices"], r["n_unknown"], r["licences"]) == (notices, unknown, ",".join(sorted(names[f - 1] for f in families))), cases[r["doc_id"]]


def test_the_licence_model_learns_from_every_text(spark, monkeypatch):
    """Words of the vocabulary that one text alone has are among what is learnt, however many texts there are."""
    rows = [(i, f"plain talk number {i}") for i in range(6000)] + [(10_000 + i, f"{w} apart") for i, w in enumerate(sorted(set(license_scan.words_of(" ".join(license_scan.DISTRACTORS)))))]
    seen = []
    monkeypatch.setattr(license_scan.LicenceModel, "_anchors", lambda self, common: seen.append(common) or ["license"])
    license_scan.LicenceModel(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {w for _, t in rows for w in license_scan.words_of(t)} & set(license_scan.VOCABULARY) == set(seen[0])


def test_trees_of_a_table_are_those_of_all_its_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.random((900, 3)), 1)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.7) ^ (rng.random(900) < 0.1)).astype(float)
    rows = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "y double, x array<double>")
    monkeypatch.setattr(quality_classifier, "LOCAL", 100)
    monkeypatch.setattr(quality_classifier, "TASK_ROWS", 300)
    got, want = quality_classifier.grow_table(rows, 3, trees=12, depth=3), quality_classifier.grow(x, y, trees=12, depth=3)
    assert (got.feature == want.feature).all() and (got.threshold == want.threshold).all()
    assert np.abs(got.score(x) - want.score(x)).max() < 1e-6


def test_the_licence_fit_groups_examples_and_holds_over_all(spark, monkeypatch):
    rng = random.Random(5)
    plain = sorted(set(license_scan.words_of(" ".join(license_scan.DISTRACTORS[5:9]))) - {"license", "licensed"})
    docs = spark.createDataFrame([(i, " ".join(rng.sample(plain, 6))) for i in range(400)], "doc_id long, text string")
    rows, learnt = [], []
    plain_fit = license_scan.LogisticRegression.fit
    monkeypatch.setattr(license_scan.LogisticRegression, "fit", lambda self, vectors: rows.append(vectors.count()) or plain_fit(self, vectors))
    regression = license_scan.LicenceModel._fit
    monkeypatch.setattr(license_scan.LicenceModel, "_fit", lambda self, df: learnt.extend(df.collect()) or regression(self, df))
    model = license_scan.LicenceModel(docs)
    given = [license_scan.places_of(t) for t in license_scan._PUT_IN]
    cases = [(int(r["label"]), set(r["grams"]) | set(cue)) for r in learnt for cue in ([[], *given] if r["label"] == 0 else [[]])]
    assert max(rows) < 0.8 * len(cases)
    y = np.array([k for k, _ in cases])
    x = np.array([[g in grams for g in range(len(license_scan.VOCABULARY))] for _, grams in cases], float)
    w = np.where(y > 0, (y == 0).sum() / (y > 0).sum(), 1.0)
    z = x @ np.array([model.weights[g] for g in license_scan.VOCABULARY]) + model.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    off = p / p.sum(axis=1, keepdims=True) - np.eye(z.shape[1])[y]
    share = w @ x / w.sum()
    some = share > 0
    slope = np.abs(x.T @ (off * w[:, None]) / w.sum()).max(axis=1)[some] / np.sqrt(share * (1 - share))[some]
    assert slope.max() < 1.2 * license_scan.REGULAR


def test_licence_judgements_of_written_grams_are_those_of_texts(spark, docs):
    df = docs.select(F.col("doc_id").alias("id"), "text")
    model, grams = license_scan.LicenceModel(docs), license_scan.known_grams(docs)
    plain = lambda rows: sorted(str(r) for r in rows.drop("held").collect())
    assert plain(model.judge_grams(grams.df)) == plain(model.judge(df)) != []
    grams.drop()


def test_licence_lines_of_long_blocks_are_placed(spark):
    """Words before each line, over several pieces of lines, with empty lines of text and a text that comes twice."""
    lines = [" ".join(f"w{k}" for k in range(i % 7)) or "-" for i in range(2 * license_scan.PIECE + 9)]
    rows = [(1, "\n".join(lines)), (1, "\n".join(lines)), (2, lines[5]), (3, ""), (4, None)]
    got = license_scan.paragraphs(spark.createDataFrame(rows, "id long, text string")).filter("unit = 0").select("id", "no", "begin", "end").distinct().collect()
    at, expected = 0, {(2, 0, 0, 5), (3, 0, 0, 0)}
    for i in range(len(lines)):
        expected.add((1, i, at, at + i % 7))
        at += i % 7
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_licences_in_documents(spark, small, texts):
    lines = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0."}
    for r in queries.op9_license_scan(spark, small).collect():
        assert r["licences"] == ",".join(sorted(k for k, v in lines.items() if v in texts[r["doc_id"]]))


def _zip_members(data: bytes) -> dict:
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {i.filename: z.read(i) for i in z.infolist()}


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(zip64):
    import io
    import zipfile

    out = io.BytesIO()
    w = warc.PackageWriter(out, zip64)
    w.store("archive/data.warc.gz", [b"abc", b"def"])
    w.store("indexes/index.cdxj", [b""])
    w.close()
    assert _zip_members(out.getvalue()) == {"archive/data.warc.gz": b"abcdef", "indexes/index.cdxj": b""}
    source = warc.Memory(out.getvalue())
    members = warc.directory(source, len(out.getvalue()))
    at, size = warc.data_range(source, members["archive/data.warc.gz"])
    assert source.read_at(size, at) == b"abcdef"
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc.gz", b"x" * 100)
    z = warc.Memory(other.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        warc.data_range(z, warc.directory(z, len(other.getvalue()))["archive/data.warc.gz"])
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.directory(warc.Memory(b"no"), 2)


def test_warc_round_trip(spark):
    page = "<p>" + "é" * 60
    rows = [(5, "http://a/x y", page), (3, None, page), (9, "http://b/\r\nc", page), (4, "u", None), (1, "u", "short"), (2, "u", "short"), (None, "u", page), (7, "u", "\r\n\r\nWARC/1.1" * 20), (3, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("package", F.lit("clash"))
    packages = warc.write_packages(df, warc.fresh_path(spark, "test"))
    out = warc.read_packages(spark, packages).collect()
    assert len(out) == len(rows) and all(r["verified"] for r in out)
    for r in out:
        payload = next((h or "") for i, _, h in rows if i == r["page_id"]).encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        revisit = r["page_id"] in (5, 9, None)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == payload
    assert warc.round_trip(df.limit(0)).count() == 0


def test_packages_of_others(spark, tmp_path):
    """Foreign ids, types and digests, string offsets, plain and gzipped records, a gzipped index, bodies in chunks."""
    import base64
    import gzip
    import io
    import json
    import zipfile

    body, chunks = b"<p>hello</p>", b"5\r\n<p>he\r\n7;x=1\r\nllo</p>\r\n0\r\n\r\n"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = lambda head, b: b"HTTP/1.1 200 OK\r\n" + head + b"\r\n\r\n" + b

    def record(kind, block, *more, kind_of="application/http;msgtype=response"):
        fields = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", f"Content-Type: {kind_of}", *more, f"Content-Length: {len(block)}"]
        return b"WARC/1.0\r\n" + "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    records = [
        record("warcinfo", b"software: other\r\n", kind_of="application/warc-fields"), record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", kind_of="application/http;msgtype=request"),
        record("response", http(b"Content-Type: text/html", body), f"WARC-Payload-Digest: {sha1}", "WARC-Target-URI: http://a/"),
        record("response", http(b"Transfer-Encoding: chunked", chunks), f"WARC-Payload-Digest: {sha1}"), record("response", http(b"X: y", b"other"), f"WARC-Payload-Digest: {sha1}"),
        record("revisit", http(b"Content-Type: text/html", b""), f"WARC-Payload-Digest: {sha1}", "WARC-Refers-To: <urn:uuid:response>"), record("resource", b"data", "WARC-Block-Digest: blake9:00", kind_of="text/plain"),
    ]
    with zipfile.ZipFile(tmp_path / "other.wacz", "w", zipfile.ZIP_STORED) as z:
        for name, pack in (("a.warc.gz", gzip.compress), ("b.warc", bytes)):
            parts, lines, at = [], ["!meta 0 {}"], 0
            for r in records:
                data = pack(r)
                lines.append("com,a)/ 2024 " + json.dumps({"offset": str(at), "length": str(len(data)), "filename": name}))
                parts.append(data)
                at += len(data)
            z.writestr(f"archive/{name}", b"".join(parts))
            z.writestr(f"indexes/{name}.cdx.gz", gzip.compress("\n".join(lines).encode()))
    packages = spark.createDataFrame([(f"file://{tmp_path}/other.wacz",)], "package string")
    out = warc.read_packages(spark, packages).orderBy("payload_bytes").collect()
    assert len(out) == 14 and all(r["page_id"] is None and r["record_id"].startswith("<urn:uuid:") for r in out)
    kinds = lambda kind: [(bytes(r["payload"]) if r["payload"] is not None else None, r["verified"]) for r in out if r["record_type"] == kind]
    assert sorted(kinds("response")) == sorted(2 * [(body, True), (body, True), (b"other", False)])
    assert kinds("warcinfo") == 2 * [(b"software: other\r\n", None)] and kinds("resource") == 2 * [(b"data", None)] and kinds("request") == 2 * [(b"", None)]
    assert [(r["payload_bytes"], r["refers_to"], r["refers_to_id"]) for r in out if r["record_type"] == "revisit"] == 2 * [(None, None, "<urn:uuid:response>")]


def test_warc_query_round_trips_all_pages(spark, small):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, small, "pages").collect()}
    out = queries.op6_warc(spark, small).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"]) for r in out} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in pages.items()}


def test_url_rules(spark):
    rows = [
        (1, "http://a.COM/en/1?x", "com/", "allow"), (2, "https://Example.com/en/", "example.com/en/", "block"), (3, "https://www.example.com/en/2#f", "www.example.com/en/", "allow"),
        (4, "x://m.www.example.com/en/z", "www.example.com/en/", "allow"), (5, "http://a.net/es/", "net/es/", "block"), (6, "http://net/fr/x", "net/fr/", "block"), (7, "http://a.net/en", None, None),
        (8, None, None, "allow"), (9, "no url", None, "allow"), (10, "http://b.com", None, None), (11, "http://b.com?x=://", None, None), (12, "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, None, "clash") for i, u, _, _ in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(df, ["page_id", "host"]).collect()}
    assert {i: got[i]["rule"] for i in got} == {i: r for i, _, r, _ in rows}
    assert all(got[i]["verdict"] == v for i, _, _, v in rows if v)
    assert (got[1]["host"], got[1]["path"], got[10]["path"], got[11]["host"], got[9]["host"], got[8]["path"]) == ("a.com", "/en/1", "", "b.com", "", "")
    assert url_filter.judge(df.limit(0), ["page_id"]).count() == 0


def test_trust_and_distrust_spread_over_links(spark):
    link = lambda *hosts: " ".join(f'<a href="https://{h}/">x</a>' for h in hosts)
    rows = [
        (1, "http://good.com/a", link("friend.org")), (2, "http://friend.org/", link("second.org")), (3, "http://second.org/", ""),
        (4, "http://bad.net/es/a", ""), (5, "http://shady.org/", link("bad.net")), (6, "http://alone.org/", ""),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow"}


def test_every_query_returns_all_rows(spark, small):
    n = {"documents": table(spark, small, "documents").count(), "pages": table(spark, small, "pages").count()}
    for name in ("op2_decontaminate", "op3_secret_scan", "op4_minhash_near_dedup", "op5_mixing", "op10_quality_rules"):
        assert queries.QUERIES[name](spark, small).count() == n["documents"], name
    assert queries.op8_url_filter(spark, small).count() == n["pages"]
