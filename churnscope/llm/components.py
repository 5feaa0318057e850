"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnscope.llm.common import materialize, scratch_until


def _smallest(edges: DataFrame, strict: bool) -> DataFrame:
    """Each node's smallest neighbour or itself; sums up map-side, so hubs are no load."""
    low = F.min("b").alias("low")
    return edges.groupBy("a").agg(low if strict else F.least(F.col("a"), low).alias("low"))


def _with_low(edges: DataFrame, low: DataFrame, salts: int = 16) -> DataFrame:
    """Edges with the low of their ``a``; a hub's edges are spread over ``salts`` keys."""
    spread = edges.withColumn("_salt", F.pmod(F.hash("b"), F.lit(salts)))
    return spread.join(low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["a", "_salt"]).drop("_salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_low(both.where("b > a"), _smallest(both, False)).select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = _smallest(down, True)
    linked = _with_low(down, low).where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.unionByName(low.select("a", F.col("low").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes on edges (a, b) of longs; the root is the smallest node.

    Self-loops and repeated edges are harmless, an empty table gives none. All state
    stays in tables; each round is written to the shared folder. Stars converge in a
    number of rounds that grows with the square of the logarithm of the longest path
    at most.
    """
    with scratch_until() as kept:
        now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        seen = None
        for _ in range(rounds):
            now = materialize(_small_star(_large_star(now)).where("a <> b").distinct(), "stars")
            mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
            if mark == seen:
                break
            seen = mark
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        kept.append(now)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
