"""Near-duplicates by SimHash and multi-index hashing.

A bit of a text's fingerprint is 1 if it is set in more than half of the XXH64 values (seed 42) of its word shingles, repeats
included. Fingerprints link at ``most`` differing bits or fewer, and documents belong to the components of these links.

Multi-index hashing: the 64 bits are cut into m segments. Of two fingerprints with at most r = m q + a different bits, one of the first
a + 1 segments differs by q bits at most or one of the others by q - 1. So each fingerprint stands in a table under its own value of each
segment, and asks there for every value in the Hamming ball of that small radius around its own. What meets on a (segment, value) is
compared over all 64 bits. m follows from the counted fingerprints, so that a value isn't shared by too many by chance.

1. Equal fingerprints are one, held by their smallest id; copies never meet.
2. On each value, all that ask are compared with one holder, the one with most copies (a star), which gives first components.
3. Where a value still holds several components, holders and askers of different components are compared, if it has ``DENSE`` holders at
   most: the work is in proportion to the askers.
4. Denser values go by midpoints: two fingerprints at 4 bits or fewer share a value that is 2 bits or fewer away from either, and all
   that are so close to one value are at 4 bits or fewer from each other. So each fingerprint is dealt to the 2 081 values around it, and
   the components that meet on one are one. That is exact and in proportion to the fingerprints, however dense they lie.

Defined results: a text without words, or null, has the fingerprint zero and links like any other; a row without id has a fingerprint
and no component; repeated rows have one component, and an id with several texts joins theirs. An empty table gives an empty result. Ids can
be of any type with an order. Very long texts are read whole, 65 536 shingles at a time.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import Saved, with_text_columns
from .components import connected_components

BITS, SEED = 64, 42
#: Holders of a value up to which its askers are compared with each of them.
DENSE = 256
_SHINGLES = 65_536


def fingerprint(text: str | None, k: int) -> int:
    """The 64 bits of one text as an unsigned number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    whole, k = b" ".join(words), min(k, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, sums = len(words) - k + 1, np.zeros(BITS, np.int64)
    for begin in range(0, n, _SHINGLES):
        end = min(n, begin + _SHINGLES)
        spans = zip(starts[begin:end].tolist(), ends[begin + k - 1 : end + k - 1].tolist(), strict=True)
        hashes = np.array([xxh64_intdigest(whole[a:b], SEED) for a, b in spans], np.uint64)
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * sums > n).tolist())


def _fingerprints(k: int):
    def compute(column: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, k) for t in column.to_pylist()], np.uint64).view(np.int64))]

    return compute


def segments(n: int, most: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment for ``n`` fingerprints."""
    m = next((m for m in (4, 3) if n <= 1 << (BITS // m + 6)), 2)
    cuts = [BITS * i // m for i in range(m + 1)]
    q, a = divmod(most, m)
    radii = [q if i <= a else q - 1 for i in range(m)]
    return [(lo, hi - lo, r) for lo, hi, r in zip(cuts, cuts[1:], radii, strict=False) if r >= 0]


def _ball(bits: int, radius: int) -> list[int]:
    """Every number of so many bits with ``radius`` ones at most, as a signed 64-bit number."""
    masks = [sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _masks(bits: int, radius: int) -> Column:
    return F.lit(_ball(bits, radius)).cast("array<long>")


def _asked(cut: list[tuple[int, int, int]]) -> Column:
    """An array of (segment, value, own) that a fingerprint asks for, own where the value is its own."""

    def part(s: int, lo: int, bits: int, radius: int) -> Column:
        value = F.shiftrightunsigned(F.col("fp"), lo).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        return F.transform(_masks(bits, radius), lambda x: F.struct(F.lit(s).alias("segment"), value.bitwiseXOR(x).alias("value"), (x == 0).alias("own")))

    return F.flatten(F.array(*(part(s, *one) for s, one in enumerate(cut))))


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _through_midpoints(prints: DataFrame, most: int) -> DataFrame:
    """Links (a, b) that join the components of all prints (fp, component) at ``most`` (an even number of) bits or fewer."""
    around = prints.select("component", F.explode(F.transform(_masks(BITS, most // 2), lambda x: F.col("fp").bitwiseXOR(x))).alias("mid"))
    # at most as many fingerprints as a ball has values are around one
    met = around.groupBy("mid").agg(F.collect_set("component").alias("all")).filter(F.size("all") > 1)
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a <> b").distinct()


def linked_prints(prints: DataFrame, n: int, most: int = 4, dense: int = DENSE) -> Saved:
    """id and component of the ids of ``prints`` (id, fp, copies; ``n`` of them, each fp once) that have links."""
    asked = prints.select("id", "fp", "copies", F.explode(_asked(segments(n, most))).alias("k")).select("id", "fp", "copies", "k.*")
    holder = F.max(F.when(F.col("own"), F.struct("copies", "fp", "id")))
    per = asked.groupBy("segment", "value").agg(F.count("*").alias("asking"), F.count(F.when(F.col("own"), 1)).alias("held"), holder.alias("hub")).filter("held > 0 AND asking > 1")
    met = Saved(asked.drop("copies").join(per.select("segment", "value", "held", F.col("hub.fp").alias("hub_fp"), F.col("hub.id").alias("hub")).hint("merge"), ["segment", "value"]), "asked")
    stars = Saved(met.df.filter((F.col("id") != F.col("hub")) & (_apart("fp", "hub_fp") <= most)).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    found = connected_components(stars.df)
    stars.drop()

    placed = Saved(met.df.drop("hub", "hub_fp").join(found.df.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    met.drop()
    mixed = placed.df.groupBy("segment", "value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("segment", "value")
    rest = Saved(placed.df.join(mixed.hint("merge"), ["segment", "value"], "left_semi"), "mixed")
    placed.drop()
    few = rest.df.filter(F.col("held") <= dense)
    holders = few.filter("own").select("segment", "value", F.col("fp").alias("fp_a"), F.col("component").alias("a"))
    direct = few.select("segment", "value", "fp", F.col("component").alias("b")).join(holders.hint("merge"), ["segment", "value"])
    more = direct.filter((F.col("a") != F.col("b")) & (_apart("fp", "fp_a") <= most)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    crowded = Saved(rest.df.filter(F.col("held") > dense).select("fp", "component").distinct(), "crowded")
    if crowded.df.limit(1).count():
        more = more.unionByName(_through_midpoints(crowded.df, most))
    more = Saved(more, "more-links")
    if more.df.limit(1).count():
        before, found = found, connected_components(found.df.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more.df))
        before.drop()
    for done in (rest, crowded, more):
        done.drop()
    return found


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, most: int = 4, dense: int = DENSE) -> DataFrame:
    """id, fp (the fingerprint as a signed number), fingerprint (16 hexadecimal digits) and component_id of each row of ``docs``."""
    if most % 2:
        raise ValueError("midpoints need an even number of bits")
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    base = Saved(with_text_columns(source, ["id"], _fingerprints(k), [T.StructField("fp", T.LongType())]), "fingerprints")
    named = base.df.filter(F.col("id").isNotNull())
    prints = Saved(named.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "prints")
    # an id with several texts holds several fingerprints: they are one vertex
    found = linked_prints(prints.df, prints.count(), most, dense)
    labels = prints.df.select("fp", "id").join(found.df.hint("merge"), "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    labels = _joined_by_ids(named, Saved(labels, "labels"))
    prints.drop()
    found.drop()
    out = base.df.join(labels.df.hint("merge"), "fp", "left")
    spelt = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("id").alias(id), "fp", spelt.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def _joined_by_ids(named: DataFrame, labels: Saved) -> Saved:
    """The labels (fp, component), with components joined whose texts have an id in common."""
    several = named.groupBy("id").agg(F.min("fp").alias("fp"), F.max("fp").alias("last")).filter("fp <> last")
    if not several.limit(1).count():
        return labels
    theirs = named.join(several.select("id").hint("merge"), "id", "left_semi").join(labels.df.hint("merge"), "fp").select("id", "component").distinct()
    links = theirs.groupBy("id").agg(F.min("component").alias("a")).join(theirs.hint("merge"), "id").select("a", F.col("component").alias("b"))
    # the smallest id of a component may be one that its fingerprint's holder isn't
    found = connected_components(links)
    out = Saved(labels.df.join(found.df.withColumnRenamed("component", "least").hint("merge"), labels.df["component"] == found.df["id"], "left").select("fp", F.coalesce("least", "component").alias("component")), "labels")
    labels.drop()
    found.drop()
    return out
