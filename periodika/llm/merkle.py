"""Merkle manifest of a dataset: a tree of SHA-256 digests for each group of rows, a tree over the groups, and a proof for every row.

The digest H of inputs is the lower-case hexadecimal SHA-256 of them, one after another, digests as hexadecimal text. Leaves ascend by
their key; while there are several nodes, every ``FANOUT`` consecutive ones (the last run may be shorter, even one) become their H.

1. Leaves are hashed where they lie and written without their texts, then sorted by ranges of (group, key), which no frequent group or
   repeated row can fill. Counts of each range give a leaf its position in its group.
2. Aligned blocks of ``BLOCK`` leaves, a power of the fanout, are one row each, with the digest of their subtree.
3. Butterfly exchange: in round r the blocks whose numbers differ only in their r-th digit to the base ``FANOUT`` swap the digests of their
   subtrees. Each of them hashes the parent for itself and keeps its siblings as a step of its own proof. A block of a short subtree
   also stands in for the places that its subtree lacks, so that everyone meets all siblings. After the last round every block
   holds the whole path above it; nothing is passed down from the root. A round moves one small row for each block.
4. The groups' roots are the leaves of one more tree, made in the same way.
5. Each block then spells its leaves' proofs, with the path that it has.

Defined results: a null key comes first, equal keys follow in the order of their leaves' digests, equal rows have a place each. A null group
is a group of its own and comes first; groups ascend bytewise. A null value is `-`, so that it differs from an empty text. A lone leaf is
its own root and has an empty proof (the H of nothing). An empty table gives an empty manifest. Very long texts are hashed whole.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Saved, bounded_batches, sized

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
#: Blocks, with all that they know of the tree above them, that a join may broadcast: some 3 KB each.
BROADCAST_BLOCKS = 5000
_STEP = T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())])
_STEPS = T.ArrayType(_STEP)
_RANGE_BITS = 33


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def digest(*values: Column) -> Column:
    """H of values, each `-` if null, else its count of UTF-8 bytes, `:` and the value."""
    spelt = (F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values)
    return F.sha2(F.concat(*spelt).cast("binary"), 256)


def _levels(n: Column) -> Column:
    """Levels above ``n`` leaves: how often they are gathered by the fanout until one is left."""
    return sum(((n > FANOUT**i).cast("int") for i in range(21)), F.lit(0))


def positions(leaves: DataFrame, group: str, *order: str) -> Saved:
    """``leaves`` with their place ``pos`` in their group, from 0, and the size ``n`` of the group.

    The order is that of ``order``, nulls first; rows equal in it have a place each, in any order.
    """
    # rows equal in all of that are told apart, else all of them would be one range
    salted = leaves.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(group, *order, "__salt").sortWithinPartitions(group, *order, "__salt").drop("__salt")
    at = F.monotonically_increasing_id()
    placed = Saved(ranged.withColumns({"__part": F.shiftright(at, _RANGE_BITS), "__at": at.bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))}), "placed")
    per = placed.df.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("c"), F.min("__at").alias("first"))
    before = Window.partitionBy("__g").orderBy("__p")
    per = per.withColumns({"start": F.sum("c").over(before) - F.col("c"), "n": F.sum("c").over(Window.partitionBy("__g"))})
    known = Saved(per.select("__g", "__p", (F.col("start") - F.col("first")).alias("shift"), "n"), "ranges")
    joined = placed.df.join(sized(known.df, known.count()), placed.df[group].eqNullSafe(known.df["__g"]) & (F.col("__part") == F.col("__p")))
    out = Saved(joined.withColumn("pos", F.col("__at") + F.col("shift")).drop("__g", "__p", "__part", "__at", "shift"), "positions")
    placed.drop()
    known.drop()
    return out


def _subtree(leaves: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the leaves up."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([_h("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def _steps(nodes: list[list[str]], i: int) -> list[tuple[str, str]]:
    """The siblings left and right on the way up from leaf ``i``."""
    out = []
    for level in nodes[:-1]:
        first = i // FANOUT * FANOUT
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + FANOUT])))
        i //= FANOUT
    return out


def blocks(placed: DataFrame, group: str, leaf: str, carried: list[str]) -> Saved:
    """A row for each aligned block: grp, block, n (leaves of the group), rows (pos, leaf and ``carried``, in order) and root."""
    row = F.struct("pos", F.col(leaf).alias("leaf"), *carried)
    gathered = placed.groupBy(F.col(group).alias("grp"), F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
    inner = gathered.withColumn("levels", F.least(_levels(F.col("n")), F.lit(LEVELS)))
    at, depth = inner.columns.index("rows"), inner.columns.index("levels")
    schema = T.StructType([*inner.schema, T.StructField("root", T.StringType())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                rows, levels = b.column(at), b.column(depth).to_pylist()
                leaves = rows.flatten().field("leaf").to_pylist()
                ends = np.cumsum([0, *(len(x) for x in rows)])
                roots = [_subtree(leaves[i:j], n)[-1][0] for i, j, n in zip(ends, ends[1:], levels, strict=False)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())], names=schema.names)

    return Saved(inner.mapInArrow(run, schema), "blocks")


def exchanged(roots: DataFrame, most_blocks: int) -> DataFrame:
    """grp, block, root (of the group) and steps above the block, from roots (grp, block, n, root): the butterfly exchange.

    ``most_blocks``: of the largest group; rounds end when one subtree holds it.
    """
    count = F.ceil(F.col("n") / BLOCK)
    now = roots.select("grp", "block", count.alias("count"), "root", F.array().cast(_STEPS).alias("steps"))
    stride, last = 1, None
    while stride < most_blocks:
        wide = stride * FANOUT
        # the last subtree may lack places of its full size: its blocks stand in for them
        short = F.col("count") % stride
        in_last = (short > 0) & (F.col("block") >= F.col("count") - short)
        place = F.col("block") % stride
        places = F.when(in_last, F.sequence(place, F.lit(stride - 1).cast("long"), short)).otherwise(F.array(place))
        sent = now.withColumns({"open": F.col("count") > stride, "home": place, "places": places}).withColumn("place", F.explode("places"))
        digit = F.floor(F.col("block") / stride) % FANOUT
        partners = Window.partitionBy("grp", F.floor(F.col("block") / wide), "place")
        met = sent.withColumn("digit", digit).withColumn("all", F.sort_array(F.collect_list(F.struct("digit", "root")).over(partners))).filter("place = home")
        joined = lambda side: F.concat_ws("", F.transform(F.filter("all", side), lambda x: x["root"]))
        left, right = joined(lambda x: x["digit"] < F.col("digit")), joined(lambda x: x["digit"] > F.col("digit"))
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        after = Saved(
            met.select(
                "grp", "block", "count", F.when(F.col("open"), F.sha2(F.concat(left, "root", right).cast("binary"), 256)).otherwise(F.col("root")).alias("root"),
                F.when(F.col("open"), F.concat("steps", step)).otherwise(F.col("steps")).alias("steps"),
            ),
            f"round-{stride}",
        )
        if last is not None:
            last.drop()
        now, stride, last = after.df, wide, after
    return now.select("grp", "block", "root", "steps")


def _tree(leaves: DataFrame, group: str, leaf: str, carried: list[str], *order: str) -> tuple[Saved, Saved]:
    """The blocks of leaves, and what each of them knows after the exchange (grp, block, root and steps)."""
    placed = positions(leaves, group, *order)
    held = blocks(placed.df, group, leaf, carried)
    most = placed.df.agg(F.max("n")).first()[0] or 0
    placed.drop()
    return held, Saved(exchanged(held.df.select("grp", "block", "n", "root"), -(-most // BLOCK)), "paths")


def _spelt(held: DataFrame, known: DataFrame, n_blocks: int, fields: list[T.StructField], spell) -> DataFrame:
    """Rows that ``spell(rows, levels, above)`` makes of each block, its leaves' rows and the path above it (with the further columns of ``known``)."""
    side = known.select(F.col("grp").alias("__g"), F.col("block").alias("__b"), F.struct(*(c for c in known.columns if c not in ("grp", "block"))).alias("above"))
    side = F.broadcast(side) if n_blocks <= BROADCAST_BLOCKS else side.hint("merge")
    both = held.join(side, held["grp"].eqNullSafe(F.col("__g")) & (F.col("block") == F.col("__b"))).select("grp", "rows", "levels", "above")
    schema = T.StructType(fields)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):  # a block at a time: some thousand rows, a few hundred bytes each
                grp, rows, levels, above = (c[0].as_py() for c in b.slice(i, 1).columns)
                out = spell(grp, rows, levels, above)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(out, arrow, strict=True)], names=schema.names)

    arrow = list(_arrow(schema))
    return both.mapInArrow(run, schema)


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _group_rows(grp, rows, levels, above):
    nodes = _subtree([r["leaf"] for r in rows], levels)
    upper = [(s["left"], s["right"]) for s in above["steps"]]
    steps = [[{"left": a, "right": b} for a, b in _steps(nodes, i) + upper] for i in range(len(rows))]
    return [r["name"] for r in rows], [r["leaf"] for r in rows], [above["root"]] * len(rows), steps


def _proof_rows(grp, rows, levels, above):
    nodes = _subtree([r["leaf"] for r in rows], levels)
    upper = [(s["left"], s["right"]) for s in above["steps"]]
    out: list[list] = [[] for _ in range(8)]
    for i, r in enumerate(rows):
        steps = _steps(nodes, i) + upper
        folded = r["presented"]
        for left, right in steps:
            folded = _h(left + folded + right)
        proof = _h("".join(left + right for left, right in steps))
        for column, x in zip(out, (r["key"], grp, r["leaf"], above["subroot"], above["root"], proof, folded, folded == above["root"]), strict=True):
            column.append(x)
    return out


def manifest(docs: DataFrame, key: str, group: str, values: list[str], presented: dict[str, Column] | None = None) -> DataFrame:
    """key, group, leaf, subroot, root, proof_sha256, folded_root and verified of each row of ``docs``.

    A leaf is the digest of ``values``. ``presented``: expressions for some of them, with which a row is presented to its proof later; ``verified``
    tells whether the root that follows from these is that of the manifest. Without them every row is verified.
    """
    bounded_batches(docs.sparkSession)
    presented = presented or {}
    own, later = ([F.col(f"`{v}`") for v in values], [presented.get(v, F.col(f"`{v}`")) for v in values])
    base = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("grp"), digest(*own).alias("leaf"), digest(*later).alias("presented"))
    leaves = Saved(base, "leaves")
    held, paths = _tree(leaves.df, "grp", "leaf", ["key", "presented"], "key", "leaf")
    leaves.drop()

    roots = Saved(paths.df.filter("block = 0").select(F.lit(0).alias("all"), F.col("grp").alias("name"), "root"), "subroots")
    top, top_paths = _tree(roots.df, "all", "root", ["name"], "name")
    kind = docs.schema[group].dataType
    fields = [T.StructField("name", kind), T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("steps", _STEPS)]
    groups = Saved(_spelt(top.df, top_paths.df, top.count(), fields, _group_rows), "groups")
    side = groups.df.select("name", "subroot", F.col("root").alias("whole"), F.col("steps").alias("beyond"))
    joined = paths.df.join(side.hint("merge"), F.col("grp").eqNullSafe(F.col("name")))
    known = Saved(joined.select("grp", "block", "subroot", F.col("whole").alias("root"), F.concat("steps", "beyond").alias("steps")), "known")
    for done in (paths, roots, top, top_paths, groups):
        done.drop()

    text = lambda name: T.StructField(name, T.StringType())
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField(group, kind), text("leaf"), text("subroot"), text("root"), text("proof_sha256"), text("folded_root"), T.StructField("verified", T.BooleanType())]
    return _spelt(held.df, known.df, known.count(), fields, _proof_rows)
