"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

The sketch has ``COORDINATES`` bins. Round i < t throws every shingle into one hashed bin with a value in [i, i + 1), round
i >= t throws all shingles into bin i - t; a bin keeps its least value and rounds end when no bin is empty, after 2t rounds
at the latest. Bins agree with the Jaccard similarity as probability, with the concentration of t independent hashes, but a
set of n shingles costs O(n + t log t).

From the sketches to the components:

1. Documents with equal shingle sets are one class, held by its smallest id; only class holders go on.
2. Each of ``BANDS`` bands of ``ROWS`` bins is a key. Two sets of similarity 0.8 miss each other on all keys with
   probability (1 - 0.8^7)^50 < 1e-5. Only keys of two holders or more go on.
3. Shingles that no other set on those keys has can't be in an intersection. With s of its n shingles shared, a set is
   compared only where the sizes n and s allow 0.8; a set with s < 0.8 n has no links at all. This bound loses nothing.
4. On each key, all sets are compared with the set that shares most (a star, not all pairs). Then components.
5. Only where a key still holds several components, sets of different components are compared, through the prefixes of
   their sets in the order of rising frequency (``_crossing``). Nothing is capped.

Every comparison is exact, over the full sets of 64-bit shingle hashes.

Defined results: a text without words, or null, has an empty set, size 0, and is its own component; so is a row without
id, whose component is null and which is kept. Repeated rows have one component; the smallest id's rows are all ``kept``
(``deduplicate`` leaves one of them). Ids can be of any type with an order, negative numbers and strings too. Ties (a key's sets that share
equally much) go to the smaller id, which moves work only. Very long texts are read whole. Further columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import Saved, sized, with_text_columns
from .components import connected_components

ROWS, BANDS = 7, 50
#: Sets that may have a shingle which counts as rare.
RARE = 64
COORDINATES = ROWS * BANDS
_ROUND = tv.mix(np.arange(1, 2 * COORDINATES + 1, dtype=tv.U) * tv.U(0xD1342543DE82EF95))
_COLUMN = tv.mix(np.arange(1, ROWS + 1, dtype=tv.U) * tv.U(0xA0761D6478BD642F)) | tv.U(1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``k`` words."""
    data, offsets = tv.utf8(column)
    data = tv.LOWER[data]
    words = tv.Words(data, offsets, ~tv.BLANK[data])
    at, hashes = words.windows(k)
    bounds = np.searchsorted(at, words.at)
    out = [hashes[:0]] * len(words.counts)
    for i in np.flatnonzero(words.counts >= k):
        own = np.sort(hashes[bounds[i] : bounds[i + 1]])
        out[i] = own[np.concatenate([[True], own[1:] != own[:-1]])]
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        for i, h in zip(short, words.whole(short, n), strict=True):
            out[i] = np.array([h], tv.U)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bins for each of the sets, none of them empty."""
    t, empty = COORDINATES, tv.U(2**64 - 1)
    bins = np.full((len(sets), t), empty, tv.U)
    items = np.concatenate(sets) if sets else np.zeros(0, tv.U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = bins.reshape(-1)
    for i in range(2 * t):
        x = tv.mix(items + _ROUND[i])
        place = (((x >> tv.U(32)) * tv.U(t)) >> tv.U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, owner * t + place, (x & tv.U(0xFFFFFFFF)) | tv.U(i << 32))
        open_ = (bins == empty).any(axis=1) if i < 8 or i % 8 == 0 or i >= t else None
        if open_ is not None:
            left = open_[owner]
            items, owner = items[left], owner[left]
            if not len(items):
                break
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    keys = (bins.reshape(len(bins), BANDS, ROWS) * _COLUMN).sum(axis=2, dtype=tv.U)
    return tv.mix(keys ^ tv.mix(np.arange(BANDS, dtype=tv.U) + tv.U(99)))


def _described(k: int):
    def compute(column: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(column, k)
        some = [s for s in sets if len(s)]
        keys = band_keys(sketches(some)).view(np.int64).reshape(-1)
        ends = np.cumsum([0, *(BANDS if len(s) else 0 for s in sets)])
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))]

    return compute


def _listed(k: int):
    def compute(column: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(column, k)
        ends = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets) if sets else np.zeros(0, tv.U)
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))]

    return compute


def _may_link(n1: Column, s1: Column, n2: Column, s2: Column, percent: int) -> Column:
    both = F.least(s1, s2)
    return 100 * both >= percent * (n1 + n2 - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. b's sets move first: a is the side that many pairs share."""
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")).hint("merge"), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")).hint("merge"), "a")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return both.filter(100 * shared >= percent * (F.size("items_a") + F.size("items_b") - shared)).select("a", "b")


def _need(n: Column, percent: int) -> Column:
    """The least overlap of a set of size n with any set that is ``percent`` alike: that with a set of size 0.8 n."""
    return F.ceil(n * percent / 100)


def _meet(one: DataFrame, two: DataFrame, others: Column, percent: int) -> DataFrame:
    """Pairs of prefix rows (item, id, n, s, pos, component) with one item that sizes and places allow, as a < b.

    Two sets with one item at places i and j share at most min(i, j) items up to there and min(s - i, s' - j) after it.
    """
    one, two = (side.select(*(F.col(c).alias(f"{c}_{i}") for c in side.columns)) for i, side in ((1, one), (2, two)))
    most = F.least("pos_1", "pos_2") + F.least(F.col("s_1") - F.col("pos_1"), F.col("s_2") - F.col("pos_2"))
    fits = (F.col("item_1") == F.col("item_2")) & others & (100 * most >= percent * (F.col("n_1") + F.col("n_2") - most))
    return one.join(two.hint("merge"), fits).select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b")).distinct()


def _frequent_pairs(able: DataFrame, placed: DataFrame, percent: int) -> list[Saved]:
    """Pairs (a, b) that connect what frequent items alone can connect; ``able`` has id, n, f, h1, h2 and component.

    Sets with the same frequent items (h1, h2) are a class, and the smaller a set, the more it links with: if any two
    sets of two classes are linked, so are the smallest ones. So in each class the smallest set of each component is
    compared with the smallest of all (``top``), tops are compared with each other, and a set too large for its own top with the
    other class's top that leaves most room. Their overlaps are those of the classes.
    """
    by_component = able.groupBy("h1", "h2", "f", "component").agg(F.min(F.struct("n", "id")).alias("r"))
    tops = by_component.groupBy("h1", "h2").agg(F.min(F.struct("r.n", "r.id", "component")).alias("top"))
    linked = percent * (F.col("n") + F.col("top.n") - F.col("f")) <= 100 * F.col("f")
    members = Saved(
        by_component.select("h1", "h2", "f", "component", "r.*").join(tops.hint("merge"), ["h1", "h2"])
        .select("id", "n", "f", "component", F.col("top.id").alias("top"), F.col("top.n").alias("top_n"), F.col("top.component").alias("top_component"), linked.alias("linked")),
        "members",
    )
    inside = members.df.filter("id <> top AND linked").select(F.least("id", "top").alias("a"), F.greatest("id", "top").alias("b"))
    heads = Saved(
        members.df.groupBy(F.col("top").alias("id"), F.col("top_n").alias("n"), F.col("f").alias("s"), F.col("top_component").alias("component")).agg(F.max(~F.col("linked")).alias("heavy")), "tops"
    )
    frequent = placed.filter(F.col("c") > RARE)
    mine = frequent.join(heads.df.hint("merge"), "id").withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("c", "item")))
    prefix = Saved(mine.filter(F.col("pos") <= F.col("s") - _need(F.col("n"), percent) + 1).drop("c"), "prefixes")
    # pairs inside an item's largest component are not asked for: the others meet all
    per = prefix.df.groupBy("item", "component").agg(F.count("*").alias("c")).groupBy("item").agg(F.max(F.struct("c", "component"))["component"].alias("largest"))
    fewer = prefix.df.join(per.hint("merge"), "item").filter("component <> largest OR heavy").drop("largest")
    others = (F.col("id_1") != F.col("id_2")) & ((F.col("component_1") != F.col("component_2")) | F.col("heavy_1") | F.col("heavy_2"))
    met = Saved(_meet(fewer, prefix.df, others, percent), "met")
    held = heads.df.join(frequent.hint("merge"), "id").groupBy("id", "n", "component").agg(F.collect_list("item").alias("items"))
    held = Saved(held.join(met.df.select(F.col("a").alias("id")).union(met.df.select("b")).distinct().hint("merge"), "id", "left_semi"), "held-items")
    one, two = (held.df.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "component", "items"))) for x in "ab")
    shared = met.df.join(one.hint("merge"), "a").join(two.hint("merge"), "b").withColumn("both", F.size(F.array_intersect("items_a", "items_b"))).drop("items_a", "items_b")
    crossed = Saved(shared.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))), "crossed")
    between = crossed.df.filter("component_a <> component_b").select("a", "b")
    room = lambda x, y: crossed.df.select(F.col(x).alias("top"), ((100 + percent) * F.col("both") - percent * F.col(f"n_{y}")).alias("room"), F.col(y).alias("other"))
    best = room("a", "b").unionByName(room("b", "a")).groupBy("top").agg(F.max(F.struct("room", "other")).alias("best"))
    heavy = members.df.filter("id <> top AND NOT linked").join(best.hint("merge"), "top").filter(percent * F.col("n") <= F.col("best.room"))
    heavy = heavy.select(F.least("id", "best.other").alias("a"), F.greatest("id", "best.other").alias("b")).filter("a <> b")
    out = Saved(inside.unionByName(between).unionByName(heavy).distinct(), "frequent-pairs")
    for done in (members, heads, prefix, met, held, crossed):
        done.drop()
    return [out]


def _crossing(rest: DataFrame, sets: DataFrame, percent: int) -> Saved:
    """Pairs (a, b) of different components among ``rest`` (id, n, component) that connect all that links connect.

    Items that two sets or more have are put in the order of their number of sets. Two linked sets share an item of their
    prefixes, the first s - 0.8 n + 1 of a set's s shared items, and the first item that they share is there. If it is rare (at
    most ``RARE`` sets have it), the pair comes from an equi-join whose groups hold ``RARE`` rows at most. Else all that they share is
    frequent, and ``_frequent_pairs`` goes by classes.
    """
    ids = Saved(rest.select("id", "n", "component").distinct(), "rest-ids")
    items = sets.join(sized(ids.df.select("id"), ids.count()), "id", "left_semi").select("id", F.explode("items").alias("item"))
    counts = items.groupBy("item").agg(F.count("*").alias("c")).filter("c > 1")
    placed = Saved(items.join(counts.hint("merge"), "item"), "rest-items")
    own = F.when(F.col("c") > RARE, F.col("item"))
    profile = placed.df.groupBy("id").agg(
        F.count("*").alias("s"), F.count(own).alias("f"), F.bit_xor(F.when(own.isNotNull(), F.xxhash64(own))).alias("h1"), F.bit_xor(F.when(own.isNotNull(), F.xxhash64(F.lit(1), own))).alias("h2")
    )
    known = Saved(profile.join(ids.df.hint("merge"), "id").filter(F.col("s") >= _need(F.col("n"), percent)), "rest-known")
    place = F.row_number().over(Window.partitionBy("id").orderBy("c", "item"))
    rare = placed.df.filter(F.col("c") <= RARE).withColumn("pos", place).join(known.df.select("id", "n", "s", "component").hint("merge"), "id")
    rare = Saved(rare.filter(F.col("pos") <= F.col("s") - _need(F.col("n"), percent) + 1).select("item", "id", "n", "s", "pos", "component"), "rare")
    pairs = [Saved(_meet(rare.df, rare.df, F.col("component_1") < F.col("component_2"), percent), "rare-pairs")]
    able = known.df.filter(F.col("f") >= _need(F.col("n"), percent))
    if able.limit(1).count():
        pairs += _frequent_pairs(able, placed.df, percent)
    out = pairs[0].df
    for more in pairs[1:]:
        out = out.unionByName(more.df)
    out = Saved(out.distinct(), "pairs")
    for done in (ids, placed, known, rare, *pairs):
        done.drop()
    return out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id and kept of each row of ``docs``."""
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    fields = [T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    base = Saved(with_text_columns(source, ["id"], _described(k), fields, most=2 << 20), "sets")
    named = base.df.filter(F.col("print").isNotNull() & F.col("id").isNotNull())
    holders = Saved(named.groupBy("print").agg(F.min(F.struct("id", "n", "keys")).alias("h")).select("print", "h.id", "h.n", "h.keys"), "holders")

    keyed = holders.df.select("id", F.explode("keys").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    meets = Saved(keyed.join(full.hint("merge"), "key", "left_semi"), "keys")
    ids = Saved(meets.df.select("id").distinct(), "ids")
    n_ids = ids.count()
    sets = Saved(with_text_columns(source.join(sized(ids.df, n_ids), "id", "left_semi"), ["id"], _listed(k), [T.StructField("items", T.ArrayType(T.LongType()))]), "items")

    # shared: shingles of a set that another one has too
    common = sets.df.select("id", F.explode("items").alias("item"))
    lonely = common.groupBy("item").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1").groupBy("id").agg(F.count("*").alias("alone"))
    sizes = Saved(
        sets.df.select("id", F.size("items").alias("n")).join(lonely.hint("merge"), "id", "left")
        .select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s")).filter(100 * F.col("s") >= percent * F.col("n")),
        "shared",
    )
    able = Saved(meets.df.join(sized(sizes.df, sizes.count()), "id"), "able")
    meets.drop()

    # stars: each key's members against the one that shares most
    hubs = able.df.groupBy("key").agg(
        F.min(F.struct((-F.col("s") / F.col("n")).alias("share"), "id", "n", "s")).alias("hub"), F.count("*").alias("c")
    ).filter("c > 1").select("key", F.col("hub.id").alias("a"), F.col("hub.n").alias("hub_n"), F.col("hub.s").alias("hub_s"))
    stars = able.df.join(hubs.hint("merge"), "key").filter((F.col("id") != F.col("a")) & _may_link(F.col("n"), F.col("s"), F.col("hub_n"), F.col("hub_s"), percent))
    stars = Saved(stars.select("a", F.col("id").alias("b")).distinct(), "stars")
    links = Saved(_verified(stars.df, sets.df, percent), "verified")
    found = connected_components(links.df)

    # pairs of different components on one key
    placed = able.df.join(found.df.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    rest = Saved(placed.join(mixed.hint("merge"), "key", "left_semi").select("id", "n", "component").distinct(), "rest")
    pairs = _crossing(rest.df, sets.df, percent)
    more = Saved(_verified(pairs.df, sets.df, percent), "verified")
    if more.count():
        # the first run's stars stand for its links
        stars_found, found = found, connected_components(found.df.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more.df))
        stars_found.drop()
    for done in (able, rest, pairs, more, links, stars, sets, sizes, ids):
        done.drop()

    # holders -> classes -> documents
    held = Saved(holders.df.select("print", "id").join(found.df.hint("merge"), "id", "left").select("print", F.coalesce("component", "id").alias("component")), "held")
    holders.drop()
    found.drop()
    out = base.df.drop("keys").join(held.df.hint("merge"), "print", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, once each; rows without id stay.

    Of rows with one id and equal texts the least by all columns' hash stays. Rows with one id and different texts are different
    documents: each is grouped by its own text, so none goes because another row of its id is a copy.
    """
    print_ = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    texts = docs.filter(F.col(id).isNotNull()).groupBy(id).agg(F.min(print_).alias("lo"), F.max(print_).alias("hi")).filter("lo <> hi")
    several = bool(texts.limit(1).count())
    # a vertex is an id, or an id and a text where some ids have several; the least one is in either case one of the least id
    by = [id, "__print"] if several else [id]
    rows = docs.withColumn("__print", print_) if several else docs
    vertex = F.when(F.col(id).isNotNull(), F.struct(F.col(id).alias("id"), F.col("__print").alias("print"))) if several else F.col(id)
    found = near_duplicates(rows.select(vertex.alias("v"), F.col(text).alias("text")), "v", "text", k, percent).filter("v IS NOT NULL AND NOT kept")
    gone = Saved(found.select(*((F.col("v.id").alias(id), F.col("v.print").alias("__print")) if several else (F.col("v").alias(id),))).distinct(), "gone")
    left = rows.join(sized(gone.df, gone.count()), by, "left_anti").select(rows.columns)
    repeated = Saved(left.filter(F.col(id).isNotNull()).groupBy(*by).agg(F.count("*").alias("c")).filter("c > 1").select(*by), "repeated")
    n_repeated = repeated.count()
    if n_repeated:
        again = sized(repeated.df, n_repeated)
        once = left.join(again, by, "left_semi").select(rows.columns)
        left = left.join(again, by, "left_anti").select(rows.columns).unionByName(_once(once, by))
    return left.select(docs.columns)


def _once(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row of each value of ``by``: the least by the hash of all columns."""
    columns = rows.columns
    whole = F.struct(F.xxhash64(*(F.col(f"`{c}`") for c in columns)).alias("h"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    return rows.groupBy(*by).agg(F.min_by(whole["row"], whole["h"]).alias("r")).select("r.*").select(columns)
