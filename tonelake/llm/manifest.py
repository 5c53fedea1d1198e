"""A Merkle manifest of a table, its levels built by lag and lead over a fixed order.

Every row is a leaf. Inside a tree, FANOUT consecutive nodes have one parent, the last run perhaps
fewer. Rows never move from level to level: the first leaf below a node stands for it, so the siblings
of a node are found a fixed number of rows before and after it, and a first child's row becomes the row
of the parent. Windows cover aligned blocks of leaves, never a whole tree; one row for each block is
the leaf of the next round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.llm.scratch import written

FANOUT = 2
#: Leaves of a block at most; a window holds one block.
BLOCK = 1_024
_STEPS = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its size in bytes before it, so that no two rows are written alike; `-` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(by: Column) -> Column:
    """A name for the tree of a value, never null, in the same order: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), by.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Every row with pos, its place from 0 within its `tree`, and size, the rows of the tree.

    Rows are dealt by ranges of (tree, order) and counted once a range, so no tree has to fit in a
    task. Rows that are alike in all of `order` follow each other in any order, which changes nothing for
    them; a number splits them, so that even very many of them are dealt to several tasks.
    """
    keys = ["tree", *order, "_tie"]
    spread = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    # The number of a row names its partition in the upper bits and its place there in the lower 33.
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    starts = dealt.groupBy("tree", part.alias("_part")).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        "tree",
        "_part",
        "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(tree).alias("size"),
    )
    return (
        dealt.withColumn("_part", part)
        .join(starts, ["tree", "_part"])
        .withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first"))
        .select(*rows.columns, "pos", "size")
    )


def climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """`levels` levels above each row of `nodes` (tree, pos, size, node and others).

    Adds block, the aligned run of fanout ** levels rows a row lies in, and steps, the siblings on the
    row's way up: for each level the hashes left of its node and those right of it, as text. In a block's
    first row, node is then what remains of the block. Levels end where one node remains.
    """
    rows = nodes.withColumn("block", F.expr(f"pos div {fanout**levels}"))
    rows = rows.withColumn("steps", F.array().cast(_STEPS))
    order = Window.partitionBy("tree", "block").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(levels):
        stride = fanout**level
        count = F.expr(f"(size + {stride - 1}) div {stride}")
        at = F.expr(f"pos div {stride}")
        slot = at % fanout
        run = F.least(F.lit(fanout), count - (at - slot))
        left = [
            F.when(slot >= d, F.lag("node", d * stride).over(order)).otherwise("")
            for d in range(fanout - 1, 0, -1)
        ]
        right = [
            F.when(slot + d < run, F.lead("node", d * stride).over(order)).otherwise("")
            for d in range(1, fanout)
        ]
        stands = (F.col("pos") % stride == 0) & (count > 1)
        step = F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right"))
        rows = rows.withColumn("_step", F.when(stands, step))
        # The row that stands for a node is the first of those below it, so they find its step behind them.
        way = F.array_append("steps", F.last("_step", ignorenulls=True).over(so_far))
        parent = F.when(F.col("pos") % (stride * fanout) == 0, digest(F.col("node"), F.col("_step.right")))
        rows = (
            rows.withColumn("steps", F.when(count > 1, way).otherwise(F.col("steps")))
            .withColumn("node", F.when(count <= 1, F.col("node")).otherwise(parent))
            .drop("_step")
        )
    return rows


def grown(nodes: DataFrame, fanout: int, block: int) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of `climb` that a table of leaves (tree, pos, size, node) needs, the leaves' own
    first, and (tree, node), the root of each tree. Each round has `block` times fewer rows."""
    levels = 1
    while fanout ** (levels + 1) <= block:
        levels += 1
    width = fanout**levels
    largest = nodes.agg(F.max("size")).first()[0] or 0
    rounds, now = [], nodes
    while True:
        rounds.append(climb(now, fanout, levels))
        firsts = rounds[-1].where(f"pos % {width} = 0")
        size = F.expr(f"(size + {width - 1}) div {width}").alias("size")
        now = written(firsts.select("tree", F.col("block").alias("pos"), size, "node"), "blocks")
        largest = -(-largest // width)
        if largest <= 1:
            return rounds, now.select("tree", "node")


def _joined(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves' round with the steps of all rounds and of `above` (tree, pos, steps, others)."""
    for rows in reversed(rounds):
        upper = above.withColumnsRenamed({"pos": "block", "steps": "_above"})
        own = [c for c in rows.columns if c not in ("block", "steps", "node", "size")]
        others = [c for c in upper.columns if c not in ("tree", "block", "_above")]
        steps = F.concat("steps", "_above").alias("steps")
        above = rows.join(upper, ["tree", "block"]).select(*own, *others, steps)
    return above


def manifest(leaves: DataFrame, order: Sequence[str], fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """Every row of `leaves` with subroot, root and steps, the siblings on its way to the root.

    `leaves` has by (what names the tree, null allowed), leaf (a hash) and other columns. Leaves of a tree
    ascend by `order`, nulls first, equal ones by leaf. The roots of the trees, ordered by `by` with null
    first, are the leaves of one more tree. No rows give no rows.
    """
    rows = leaves.withColumn("tree", tree_key(F.col("by"))).withColumn("node", F.col("leaf"))
    rounds, subroots = grown(written(placed(rows, [*order, "leaf"]), "leaves"), fanout, block)
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("below"), "node")
    named = named.withColumn("subroot", F.col("node"))
    top_rounds, roots = grown(written(placed(named, ["below"]), "subroots"), fanout, block)
    none = F.array().cast(_STEPS).alias("steps")
    top = _joined(top_rounds, roots.select("tree", F.lit(0).cast("long").alias("pos"), none, F.col("node").alias("root")))
    zero = F.lit(0).cast("long").alias("pos")
    above = top.select(F.col("below").alias("tree"), zero, "steps", "subroot", "root")
    return _joined(rounds, above).select(*leaves.columns, "subroot", "root", "steps")


def siblings(steps: Column) -> Column:
    """H of all siblings, level by level to the root, left to right within a level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf leads to with these siblings."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, by (the language), leaf and shown: the leaf a verifier is shown.

    Where 7 divides the unsigned crc32 of the decimal doc_id, that leaf is of a row with 1 added to
    n_chars; a null n_chars stays null. Columns beside the five of the table are not covered by a leaf.
    """
    def leaf(n_chars: Column) -> Column:
        return digest(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))))

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = hit & F.col("n_chars").isNotNull()
    return docs.select(
        "doc_id",
        F.col("lang").alias("by"),
        leaf(F.col("n_chars")).alias("leaf"),
        F.when(tampered, leaf(F.col("n_chars") + 1)).alias("shown"),
    )


def document_manifest(docs: DataFrame, fanout: int = FANOUT, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents.

    A row twice in the table is two leaves. A null doc_id comes first in its tree and is never
    tampered with; a null lang is a tree of its own, the first; null texts and empty ones differ.
    """
    leaves = written(document_leaves(docs), "document_leaves")
    signed = manifest(leaves, ["doc_id"], fanout, block)
    back = folded(F.coalesce("shown", "leaf"), F.col("steps")).alias("folded_root")
    return signed.select(
        "doc_id", "leaf", "subroot", "root", siblings(F.col("steps")).alias("proof_sha256"), back
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
