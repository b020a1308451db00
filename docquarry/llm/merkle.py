"""Merkle manifest of a table: a digest per row, a tree per group, a tree over the groups, and every row's proof.

Rows get their places by range-dealt running totals. Trees are built from blocks of ``2 ** LEVELS``
nodes, one aggregation for ``LEVELS`` levels. Proofs come by pointer jumping: every node first holds its
sibling as the segment towards its parent; joining the nodes with those they point to doubles the distance and
joins the segments, until every leaf points to the root. After a jump of ``2 ** k`` levels only nodes at
multiples of the next distance can be pointed to, so the side that is looked up shrinks from N rows to their
root, and a key is shared by many rows only when that side is small enough for Spark to send it to every task.

A segment has 33 bytes per level: 0 (no sibling), 1 (sibling on the left) or 2 (on the right), and its digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import let
from docquarry.operators.numbering import ordered_totals
from docquarry.session import scope, stage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 8
STEP = 33
#: Number of the tree over all groups.
TOP = -1


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together, strings as UTF-8."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column | str) -> Column:
    """Digest of a row: ``-`` for null, else the value's length in bytes, ``:`` and the value."""
    return digest(*[
        F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        for text in ((F.col(v) if isinstance(v, str) else v).cast("string") for v in values)])


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """``<order>, <group>, leaf, position, subroot, root, proof`` for every row of ``docs``, with the columns of ``carry``.

    ``leaf`` is the digest of ``columns``. In a group leaves ascend by ``order``, null first, then by digest, so that
    repeated rows are leaves of their own; groups ascend bytewise, null first. ``proof`` has the segments of the siblings
    from the leaf to the root. Digests are lowercase hex, proofs binary. Other columns of ``docs`` are ignored;
    an empty table gives no rows. Only digests are shuffled, never texts.
    """
    spark = docs.sparkSession
    carry = carry or {}
    with scope(spark):
        rows = docs.select(
            F.col(order).alias("_order"), F.col(group).alias("_group"),
            F.unhex(leaf_digest(*columns)).alias("_leaf"),
            *[column.alias(f"_carry_{name}") for name, column in carry.items()],
        ).withColumn("_row", F.monotonically_increasing_id())
        placed = ordered_totals(rows, ["_group"], ["_order", "_leaf", "_row"], {"idx": F.lit(1)}, {"idx": "n"})
        placed = stage(placed.drop("_row"), "placed")
        sizes = placed.groupBy("_group").agg(F.first("n").alias("n"))
        trees = stage(ordered_totals(sizes, [], ["_group"], {"tree": F.lit(1)}, {"tree": "n_trees"}).select(
            F.col("_group").alias("_name"), "tree", "n_trees", _height("n").alias("height")), "trees")
        placed = placed.join(trees.drop("n_trees"), F.col("_group").eqNullSafe(F.col("_name"))).drop("_name", "n")
        placed = stage(placed, "leaves")
        inner, subroots = _build(placed.select("tree", "height", "idx", F.col("_leaf").alias("digest")))
        above = subroots.join(trees, "tree").select(
            F.lit(TOP).cast("bigint").alias("tree"), _height("n_trees").alias("height"), F.col("tree").alias("idx"), "digest")
        over, top = _build(stage(above, "subroots"))
        found = top.first()
        root, top_height = (found["digest"], found["height"]) if found else (b"", 0)
        proofs = _jump(inner.unionByName(over), top_height)
        named = subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
        # A group of one row has no tree of its own: its leaf is a leaf of the tree over the groups.
        alone = F.col("height") == 0
        placed = placed.withColumns({"at_tree": F.when(alone, TOP).otherwise(F.col("tree")).cast("bigint"),
                                     "at": F.when(alone, F.col("tree")).otherwise(F.col("idx"))})
        out = placed.join(proofs.withColumnsRenamed({"tree": "at_tree", "idx": "at"}), ["at_tree", "at"], "left").join(
            named, "tree").select(
            F.col("_order").alias(order), F.col("_group").alias(group), F.lower(F.hex("_leaf")).alias("leaf"),
            F.col("idx").alias("position"), "subroot", F.lit(root.hex()).alias("root"),
            F.coalesce("seg", F.lit(b"")).alias("proof"), *[F.col(f"_carry_{name}").alias(name) for name in carry])
        return stage(out, "manifest", keep=True)


def _height(n: str) -> Column:
    """Levels above ``n`` leaves."""
    return F.when(F.col(n) > 1, F.length(F.bin(F.col(n) - 1))).otherwise(0).cast("int")


def _build(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes but the roots as ``tree, level, idx, height, seg``, and the roots as ``tree, height, digest``.

    ``leaves(tree, height, idx, digest)``; every tree has consecutive numbers from 0.
    """
    def above(nodes):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: F.unhex(F.sha2(F.concat(
            F.lower(F.hex(F.get(nodes, 2 * i))), F.coalesce(F.lower(F.hex(F.get(nodes, 2 * i + 1))), F.lit(""))), 256)))

    def sibling(nodes, i):
        return let(F.get(nodes, i.bitwiseXOR(F.lit(1))), lambda other: F.when(other.isNull(), F.lit(bytes(STEP))).otherwise(
            F.concat(F.when(i % 2 == 0, F.lit(b"\2")).otherwise(F.lit(b"\1")), other)))

    def steps_of(level):
        return F.least(F.lit(LEVELS), F.col("height") - level)

    now, base, nodes, roots = leaves, 0, [], []
    tallest = leaves.agg(F.max("height")).first()[0] or 0
    while True:
        roots.append(now.where(F.col("height") == base).select("tree", "height", "digest"))
        if base >= tallest:
            break
        blocks = now.where(F.col("height") > base).groupBy(
            "tree", "height", F.shiftright("idx", LEVELS).alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("own"))
        levels = F.aggregate(
            F.sequence(F.lit(1), steps_of(base)), F.array(F.col("own.digest")),
            lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))
        # A row per node: its sibling, or its own digest at the top of the block.
        flat = stage(blocks.select("tree", "height", "block", levels.alias("levels")).select(
            "tree", "height", "block", F.explode(F.flatten(F.transform("levels", lambda own, step: F.transform(
                own, lambda node, i: F.struct(step.alias("step"), i.alias("i"), F.when(
                    step == F.size("levels") - 1, node).otherwise(sibling(own, i)).alias("data")))))).alias("node"),
        ).select("tree", "height", "block", "node.*"), f"levels_{base}")
        nodes.append(flat.where(F.col("step") < steps_of(base)).select(
            "tree", (F.col("step") + base).alias("level"),
            (F.col("block") * F.expr(f"shiftleft(1L, {LEVELS} - step)") + F.col("i")).alias("idx"), "height",
            F.col("data").alias("seg")))
        tops = flat.where(F.col("step") == steps_of(base)).select(
            "tree", "height", F.col("block").alias("idx"), F.col("data").alias("digest"))
        base += LEVELS
        roots.append(tops.where(F.col("height") < base).select("tree", "height", "digest"))
        now = tops.where(F.col("height") >= base)
    empty = leaves.limit(0).select("tree", F.lit(0).alias("level"), "idx", "height", F.col("digest").alias("seg"))
    return reduce(DataFrame.unionByName, nodes, empty), stage(reduce(DataFrame.unionByName, roots), "roots")


def _jump(nodes: DataFrame, top_height: int) -> DataFrame:
    """``tree, idx, seg`` of all leaves: the segments from each up to the root, as ``nodes`` of ``_build`` give them step by step."""
    last = F.col("level") + 1 == F.col("height")
    own = F.col("tree") != TOP
    pointing = nodes.select(
        "tree", "level", "idx", "seg",
        # The root of a group's tree is the leaf of that number in the tree over the groups.
        F.when(own & last, TOP).otherwise(F.col("tree")).cast("bigint").alias("to_tree"),
        F.when(own & last, 0).otherwise(F.col("level") + 1).alias("to_level"),
        F.when(own & last, F.col("tree")).otherwise(F.shiftright("idx", 1)).alias("to_idx"))
    at_root = (F.col("to_tree") == TOP) & (F.col("to_level") == top_height)
    of_leaf = (F.col("level") == 0) & own
    rows, others = pointing.where(of_leaf), pointing.where(~of_leaf)
    done, distance = [], 1
    rows, others = stage(rows, "rows_1"), stage(others, "others_1")
    while True:
        done.append(rows.where(at_root).select("tree", "idx", "seg"))
        is_open = rows.where(~at_root)
        if is_open.isEmpty():
            break
        rows = stage(_doubled(is_open, others), f"rows_{2 * distance}")
        distance *= 2
        kept = others.where((F.col("tree") == TOP) | (F.col("level") % distance == 0))
        others = stage(kept.where(at_root).unionByName(_doubled(kept.where(~at_root), others)), f"others_{distance}")
    # Groups of one row are leaves of the upper tree themselves, whose nodes point to the root sooner or later.
    while True:
        alone = others.where(F.col("tree") == TOP)
        if alone.where(~at_root).isEmpty():
            break
        others = stage(alone.where(at_root).unionByName(_doubled(alone.where(~at_root), alone)), "others_last")
    done.append(alone.where("level = 0").select("tree", "idx", "seg"))
    return reduce(DataFrame.unionByName, done)


def _doubled(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that point where the node they pointed to points, with both segments."""
    over = others.select(F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("idx").alias("to_idx"),
                         F.col("seg").alias("more"), F.col("to_tree").alias("far_tree"), F.col("to_level").alias("far_level"),
                         F.col("to_idx").alias("far_idx"))
    return rows.join(over, ["to_tree", "to_level", "to_idx"]).select(
        "tree", "level", "idx", F.concat("seg", "more").alias("seg"), F.col("far_tree").alias("to_tree"),
        F.col("far_level").alias("to_level"), F.col("far_idx").alias("to_idx"))


def _steps(proof: Column) -> Column:
    count = F.floor(F.octet_length(proof) / STEP).cast("int")
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _side(proof: Column, step: Column) -> Column:
    return F.substring(proof, step * STEP + 1, F.lit(1))


def _sibling(proof: Column, step: Column) -> Column:
    return F.lower(F.hex(F.substring(proof, step * STEP + 2, F.lit(STEP - 1))))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    def step(below, i):
        return let(_side(proof, i), lambda side: F.sha2(F.concat(
            F.when(side == F.lit(b"\1"), _sibling(proof, i)).otherwise(F.lit("")), below,
            F.when(side == F.lit(b"\2"), _sibling(proof, i)).otherwise(F.lit(""))), 256))
    return F.aggregate(_steps(proof), leaf, step)


def proof_digest(proof: Column) -> Column:
    """Digest of the siblings' digests, from the leaf to the root."""
    siblings = F.transform(F.filter(_steps(proof), lambda i: _side(proof, i) != F.lit(b"\0")), lambda i: _sibling(proof, i))
    return F.sha2(F.array_join(siblings, ""), 256)


def verified(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Rows of ``manifest`` with ``folded_root``, from the leaf in column ``leaf``, and ``verified``."""
    found = rows.withColumn("folded_root", folded(F.col(leaf), F.col("proof")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
