"""Hard negatives, SimHash and the Merkle manifest against plain Python, with the defined results of odd inputs."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from periodika.llm import hard_negatives, merkle, queries, simhash
from periodika.llm.common import table

VECTORS = "vec_id long, embedding array<float>, label int, rank string, score string, v string"


def mined(rows, every: int = 100) -> set[tuple]:
    """The contract, pair by pair."""
    by_id: dict = {}
    for id, v, label, *_ in rows:
        if id is None or v is None or label is None or any(x is None or not math.isfinite(x) or abs(x) >= hard_negatives.GREATEST for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        by_id[id] = min(by_id.get(id, (label, whole)), (label, whole))
    out = set()
    for a, (own, va) in by_id.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in by_id.items() if i != a and len(v) == len(va))
        for ps, p, _ in [x for x in scored if x[2] == own][:5]:
            hits = [(-s, i) for s, i, label in scored if label != own and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out |= {(a, p, r, i, -ps, s) for r, (s, i) in enumerate(hits, 1)}
    return out


def _got(df) -> list[tuple]:
    return [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]


def _vectors(seed: int, n: int, d: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(6, d))
    rows = []
    for i in range(n):
        v = directions[rng.integers(6)] * rng.uniform(0.2, 3) + rng.normal(size=d) * rng.uniform(0.05, 1)
        rows.append((int(i - 50), [float(np.float32(x)) for x in v], int(rng.integers(4)), "clash", "clash", "clash"))
    return rows


@pytest.mark.parametrize("block, first", [(64, 50), (16_384, 8192)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block, first):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "FIRST", first)
    monkeypatch.setattr(hard_negatives, "CHUNK", 30 if first == 50 else 16_384)
    rows = _vectors(3, 900, 8)
    same = rows[400][1]
    rows += [(2000 + i, same, i % 3, "", "", "") for i in range(300)]  # one vector of very many rows
    rows += [(3000, [0.0] * 8, 1, "", "", ""), (3001, [0.0] * 8, 2, "", "", ""), (3100, [float("nan")] * 8, 1, "", "", ""), (3200, None, 1, "", "", ""), (3300, [1.0] * 8, None, "", "", "")]
    rows += [(3400, [1.0, None] * 4, 1, "", "", ""), (3500, [float("inf")] * 8, 1, "", "", ""), (None, [1.0] * 8, 1, "", "", ""), (3600, [], 1, "", "", ""), (3601, [], 2, "", "", ""), (3602, [], 1, "", "", "")]
    rows += [(3700, [1e6] * 8, 1, "", "", ""), (3800, [1.0, 2.0], 1, "", "", ""), (3801, [1.5, 2.0], 1, "", "", ""), (3802, [0.5, 1.0], 2, "", "", "")]
    rows += [(100, rows[7][1], 0, "", "", ""), (100, rows[8][1], 3, "", "", ""), (4000, [9000.0] * 8, 1, "", "", ""), (4001, [9001.0] * 8, 1, "", "", ""), (4002, [6000.0] * 8, 2, "", "", "")]
    df = spark.createDataFrame(rows, VECTORS)
    for every in (100, 7):
        got = _got(hard_negatives.mine(df, every=every))
        assert len(got) == len(set(got)) and set(got) == mined(rows, every)


def test_hard_negatives_of_little_or_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1, "", "", "")], VECTORS)).count() == 0  # no anchor
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1, "", "", ""), (1, [1.0], 1, "", "", "")], VECTORS)).count() == 0  # one label


def test_a_walk_ends_where_the_bound_says(spark):
    """Far fewer products than pairs where anchors of a cluster lie close together; equal results."""
    rng = np.random.default_rng(5)
    axes = np.eye(16)[:4]
    m = np.concatenate([a * 4 + rng.normal(size=(3000, 16)) * 0.02 for a in axes])
    rows = np.floor(256 * m).astype(np.int32)
    anchors = [{"vec_id": -1 - i, "label": 0, "v": rows[i].tolist(), "cluster": 0} for i in range(40)]
    search = hard_negatives.Search(anchors, [(i, 0, hard_negatives._LEAST, hard_negatives._MOST) for i in range(40)], 5, True)
    seen: list[int] = []
    best = search.walk(16, np.arange(len(rows)), np.zeros(len(rows), np.int64), rows, tuple(np.zeros(0, np.int64) for _ in range(3)), _Counting(search.floor, seen))
    assert len(best[0]) == 200
    for i in range(40):
        scores = rows.astype(np.int64) @ rows[i].astype(np.int64)
        want = sorted(zip((-scores).tolist(), range(len(rows)), strict=True))[:5]
        assert sorted(zip((-best[1][best[0] == i]).tolist(), best[2][best[0] == i].tolist(), strict=True)) == want
    assert len(seen) < 12  # steps of 256, 512, ...: the first cluster of rows alone, not all 12 000


class _Counting(np.ndarray):
    """An array that notes how often thresholds are asked for."""

    def __new__(cls, values, seen):
        out = np.asarray(values).copy().view(cls)
        out.seen = seen
        return out

    def __array_finalize__(self, other):
        self.seen = getattr(other, "seen", None)

    def __getitem__(self, at):
        if self.seen is not None and isinstance(at, np.ndarray):
            self.seen.append(len(at))
        return np.asarray(super().__getitem__(at))


def test_hard_negatives_query_matches_brute_force(spark, small):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table(spark, small, "embeddings").collect()]
    assert set(_got(queries.op11_hard_negatives(spark, small))) == mined(rows)


# SimHash


def print_of(text: str | None, k: int) -> int:
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict, most: int = 4) -> dict:
    """id -> least id that links reach, by all pairs."""
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                parent[root(a)] = root(b)
    least: dict = {}
    for id, v in prints.items():
        least[root(v)] = min(least.get(root(v), id), id)
    return {id: least[root(v)] for id, v in prints.items()}


def test_simhash_query_matches_brute_force(spark, small):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    prints = {i: print_of(t, 4) for i, t in texts.items()}
    want = components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op12_simhash_near_dedup(spark, small).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_fingerprints_of_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"Word{i * i % 997}" for i in range(3000))
    want = print_of(text, 4)
    monkeypatch.setattr(simhash, "_SHINGLES", 64)
    assert simhash.fingerprint(text, 4) == want
    assert simhash.fingerprint("É A\x0bb\x85c  d e", 4) == print_of("É A\x0bb\x85c  d e", 4)
    assert simhash.fingerprint("one two", 4) == print_of("one two", 4) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(" \n", 4) == simhash.fingerprint(None, 4) == 0


def test_segments_never_miss_a_pair():
    """Every difference of 4 bits or fewer leaves one segment within its radius, for each number of segments."""
    rng = random.Random(1)
    for n in (1000, 1 << 24, 1 << 30):
        cut = simhash.segments(n, 4)
        assert sum(bits for _, bits, _ in cut) == 64
        for _ in range(20_000):
            apart = sum(1 << i for i in rng.sample(range(64), 4))
            assert any(((apart >> lo) & ((1 << bits) - 1)).bit_count() <= radius for lo, bits, radius in cut)


def _cloud(rng, centre: int, n: int, spread: int) -> set[int]:
    return {centre ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, spread))) for _ in range(n)}


@pytest.mark.parametrize("n, dense", [(1000, 256), (1000, 2), (1 << 24, 4), (1 << 30, 256)])
def test_links_of_dense_clouds_match_all_pairs(spark, n, dense):
    rng = random.Random(7)
    values = {0, 1, 2**64 - 1, 31, 1023}
    for spread in (3, 6, 9):
        values |= _cloud(rng, rng.getrandbits(64), 60, spread)
    values |= {rng.getrandbits(64) for _ in range(60)}
    chain = rng.getrandbits(64)
    for i in range(16):  # each 4 bits from the next
        values.add(chain)
        chain ^= 0b1111 << (4 * i)
    prints = {i - 40: v for i, v in enumerate(sorted(values, key=lambda v: hash(v * 31 % 1009)))}
    signed = [(i, v - (1 << 64) if v >> 63 else v, i % 3 + 1) for i, v in prints.items()]
    found = {r["id"]: r["component"] for r in simhash.linked_prints(spark.createDataFrame(signed, "id long, fp long, copies long"), n, 4, dense).df.collect()}
    assert {i: found.get(i, i) for i in prints} == components(prints)


def test_simhash_of_odd_rows(spark):
    long = " ".join(f"w{i % 5003}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, long), (5, long + " end"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (-7, "quite another text of some words"), (-7, "A B C D E F"), (9, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("fp", "id", "component", "copies", "fingerprint")})
    out = simhash.near_duplicates(df, k=4).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[1] == by[2] == by[3] == {1} and by[4] == by[5] == {4} and by[9] == {9}
    assert by[6] == {-7} == by[-7] and by[None] == {None}  # an id of two texts joins them
    assert simhash.near_duplicates(df.limit(0), k=4).count() == 0
    words = spark.createDataFrame([("b", "x y z"), ("a", "X Y z")], "doc_id string, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(words).collect()} == {"a"}


# Merkle


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves: list[str], fanout: int = 8) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and for each leaf the siblings left and right of it level by level."""
    paths, nodes, own = [[] for _ in leaves], leaves, [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        above, held = [], []
        for i in range(0, len(nodes), fanout):
            run = nodes[i : i + fanout]
            for j in range(len(run)):
                for x in own[i + j]:
                    paths[x].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(h(*run))
            held.append([x for o in own[i : i + fanout] for x in o])
        nodes, own = above, held
    return nodes[0], paths


def manifest(rows, tampered) -> list[tuple]:
    """rows: (doc_id, source, lang, n_chars, text)."""
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    sub, out = [], []
    for g in order:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        sub.append(tree([leaf_of(r) for r in by[g]]))
    root, top = tree([s[0] for s in sub])
    for g, (subroot, paths), upper in zip(order, sub, top, strict=True):
        for r, path in zip(by[g], paths, strict=True):
            folded = leaf_of(tampered(r))
            for left, right in path + upper:
                folded = h(left, folded, right)
            out.append((r[0], leaf_of(r), subroot, root, h(*(x for p in path + upper for x in p)), folded, folded == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def lowered(r):
    import zlib

    cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
    return (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}) if cut and r[4] is not None else r[4])


def _key(x) -> list:
    return [str(v) for v in x]


def test_manifest_query_matches_brute_force(spark, small):
    rows = [tuple(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")) for r in table(spark, small, "documents").collect()]
    got = [tuple(r[c] for c in COLUMNS) for r in queries.op13_merkle_manifest(spark, small).collect()]
    assert sorted(got, key=_key) == sorted(manifest(rows, lowered), key=_key)


@pytest.mark.parametrize("levels, sizes", [(1, (1, 8, 9, 64, 65, 583, 0)), (2, (1, 8, 66, 700)), (3, (513, 7))])
def test_butterfly_exchange_matches_whole_trees(spark, monkeypatch, levels, sizes):
    """Short last subtrees at every level, lone leaves and groups of very different sizes."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", merkle.FANOUT**levels)
    names = [None, "", "a", "é", "Z", "zz", "y"] + [f"g{i}" for i in range(70)]
    rows = [(len(names) * i + g, None if i % 5 else "s", name, i, f"Text {i}") for g, (name, n) in enumerate(zip(names, [*sizes, *[1 + i % 3 for i in range(99)]], strict=False)) for i in range(n)]
    rows += [(None, None, "a", None, None), (None, None, "a", None, ""), (77, "x", None, 1, "Same"), (77, "x", None, 1, "Same")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit("clash") for c in ("leaf", "root", "grp", "pos", "key", "n")})
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = [tuple(r[c] for c in COLUMNS) for r in merkle.manifest(df.repartition(5), "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], {"text": text}).collect()]
    assert sorted(got, key=_key) == sorted(manifest(rows, lowered), key=_key)


def test_positions_split_a_row_that_is_repeated_very_often(spark):
    same = spark.range(4000).select(F.lit(1).alias("key"), F.lit("en").alias("grp"), F.lit("x").alias("leaf"))
    out = merkle.positions(same.repartition(4), "grp", "key", "leaf").df
    assert [r["pos"] for r in out.orderBy("pos").collect()] == list(range(4000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together again
    try:
        most = merkle.positions(same.repartition(4), "grp", "key", "leaf").df.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 2500


def test_manifest_of_nothing_and_of_one(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    assert merkle.manifest(spark.createDataFrame([], schema), "doc_id", "lang", names).count() == 0
    r = merkle.manifest(spark.createDataFrame([(1, None, None, 3, "abc")], schema), "doc_id", "lang", names).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] == h("1:1", "-", "-", "1:3", "3:abc") and r["proof_sha256"] == h() and r["verified"]


# What other operators have in common with these


@pytest.mark.parametrize("first", [-1, 1])
def test_an_id_of_several_texts_never_meets_another_id(spark, first):
    """A copy under the smallest id goes, and of an id with two texts that nobody else has both stay, below 0 as well."""
    from periodika.llm import near_dedup

    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(first, a), (3, a), (5, b), (5, c), (5, c), (None, a), (None, a), (-9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = sorted(((r["doc_id"], r["text"][0]) for r in near_dedup.deduplicate(df).collect()), key=str)
    assert got == sorted([(first, "a"), (5, "c"), (None, "a"), (None, "a"), (-9, "b")], key=str)
    assert near_dedup.deduplicate(df.limit(0)).count() == 0
    named = spark.createDataFrame([(f"k{i}", t) for i, t in rows[:5]], "doc_id string, text string")
    assert {(r["doc_id"], r["text"][0]) for r in near_dedup.deduplicate(named).collect()} == {(min(f"k{first}", "k3"), "a"), ("k5", "b"), ("k5", "c")}


def test_a_broadcast_set_of_windows_has_its_stated_size(spark):
    """400 000 windows of 13 words take less than ``BLOCK_BYTES`` and little more in a process; more bytes than that go by the join."""
    import pyarrow as pa

    from periodika.llm import decontaminate as dc

    n = 400_000
    words = pa.array([b" ".join(b"w%05d" % (i * 7 % 99_991) for _ in range(13)) for i in range(n)], pa.binary())
    rows = pa.table({"item": [f"item-{i // 100}" for i in range(n)], "n": pa.array([13] * n, pa.int32()), "key": np.random.default_rng(1).integers(-(2**63), 2**63, n), "words": words})
    known = dc.WindowSet(rows)
    held = known.n.nbytes + known.key.nbytes + known.words.nbytes + known.item.nbytes
    assert held < 1.1 * dc.BLOCK_BYTES
    found, at = known.meeting(13, np.array([known.key[77], 5]))
    assert found.tolist() == [0] and known.items(int(at[0]), 13, known.words[77].as_py()) == [known.item[77].as_py()] and known.items(int(at[0]), 13, b"other") == []


def test_windows_of_many_bytes_go_by_the_join(spark, monkeypatch):
    from periodika.llm import decontaminate as dc

    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two"), (2, "two three"), (3, "one two")], "item_id long, text string")
    plain = sorted(tuple(r) for r in dc.decontaminate(docs, bench, ["doc_id"]).collect())
    monkeypatch.setattr(dc, "BLOCK_BYTES", 10)
    by_join = dc.decontaminate(docs, bench, ["doc_id"])
    assert sorted(tuple(r) for r in by_join.collect()) == plain and plain[0][4] == ["1", "2", "3"]
    assert "MapInArrow" not in by_join._jdf.queryExecution().executedPlan().toString()


def test_a_language_of_one_text_can_be_predicted(spark):
    from periodika.llm import language_id

    english = [(i, f"the quick brown fox number {i} jumps over the lazy dog and the other one of them", "en") for i in range(40)]
    czech = (99, "příliš žluťoučký kůň úpěl ďábelské ódy", "cs")
    labelled = spark.createDataFrame([*english, czech], "doc_id long, text string, lang string")
    model = language_id.learn(labelled)
    assert model.languages == ["cs", "en"]
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(labelled.select("doc_id", "text"), model, ["doc_id"]).collect()}
    assert out[99][0] == "cs" and out[99][1] > 0.5 and all(out[i][0] == "en" for i in range(40))


def test_a_frequent_text_is_in_the_sample_once(spark):
    from periodika.llm import secret_scan
    from periodika.llm.common import bounded_sample

    for i in range(12):  # until the frequent text is one of those that are chosen
        frequent = f"the same text again and again {i} with words enough to be cut into pieces of a certain length"
        df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, frequent).otherwise(F.format_string("text %s", F.col("id").cast("string"))).alias("text"))
        if bounded_sample(df, "text", 400).count() > 1000:
            assert bounded_sample(df, "text", 400).dropDuplicates(["text"]).count() < 1000
            secret_scan.measure(df, sample=400)
            break
    assert secret_scan.measure(df.limit(0)).__class__.__name__ == "Natural"
