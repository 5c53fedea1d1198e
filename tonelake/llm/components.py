"""Connected components by alternating stars, on distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.llm.scratch import written


def _least(edges: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour; partial minima keep a hot node from one task."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    """What tells one set of distinct edges from another: their number and two sums of their hashes."""
    code = F.xxhash64("u", "v")
    found = edges.agg(F.count("*"), F.bit_xor(code), F.sum(code.cast("decimal(20,0)")))
    return tuple(found.first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) reaches.

    Every round ties the larger neighbours of a node to its smallest one, then the smaller ones.
    It ends when a round changes nothing; the number of rounds grows with the logarithm of the
    longest path. Nodes without edges do not appear; no edges give no rows.
    """
    now = written(
        edges.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), "edges"
    )
    state = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.selectExpr("v as u", "u as v"))
        near = _least(both).withColumn("m", F.least("m", "u"))
        large = both.join(near, "u").where("v > u").selectExpr("v as u", "m as v").where("u <> v").distinct()
        low = _least(large)
        small = (
            large.join(low, "u")
            .where("v <> m")
            .selectExpr("v as u", "m as v")
            .unionByName(low.selectExpr("u", "m as v"))
            .where("u <> v")
            .distinct()
        )
        now, before = written(small, "edges"), state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    star = _least(now).selectExpr("u as node", "m as root")
    return star.unionByName(star.selectExpr("root as node", "root").distinct())
