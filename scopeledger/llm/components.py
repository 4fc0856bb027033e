"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum, combined on the map side, and a join on the
node, which adaptive execution splits where a node has very many neighbours.
The edges of each round are staged, so that a round has as many tasks as they
have bytes for; the rounds end when they are stars. Only that answer and the
number of edges reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopeledger.llm.common import BROADCAST_ROWS, stage


def _merged(edges: DataFrame, counted: int) -> DataFrame:
    """Edges whose next join is shuffled and merged unless they are few: both its sides are made of them, and Spark may size them too low."""
    return edges if counted <= BROADCAST_ROWS else edges.hint("merge")


def _large_star(edges: DataFrame) -> DataFrame:
    ways = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("way")
    both = edges.select(ways).select("way.u", "way.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Loops, repeated edges and null ends are ignored; no edge gives no row.
    """
    now = stage(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    while counted := _unfinished(now):
        now = stage(_small_star(_merged(_large_star(_merged(now, counted)), counted)), "edges")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _unfinished(edges: DataFrame) -> int:
    """How many edges there are, or 0 if every node has one smaller neighbour or only larger ones: a round would change nothing then."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end")
    nodes = edges.select(ends).groupBy("end.node").agg(F.sum("end.up").alias("up"), F.min("end.up").alias("least"))
    open_, n = nodes.agg(F.count_if(F.expr("up > 1 or (up = 1 and least = 0)")), F.sum("up")).first()
    return n if open_ else 0
