"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestmarts.sources.checkpoints import checkpointed

MAX_ROUNDS = 60
#: Links of a node beyond which its rows are joined where they are.
HUB_DEGREE = 100_000


def _to_least(rows: DataFrame, edges: DataFrame, hub_degree: int) -> DataFrame:
    """Rows (a, b) with the least neighbour of ``a`` in ``edges`` (or ``a``) as ``least``.

    Nodes with more than ``hub_degree`` links would gather in one task. There are at
    most (links / hub_degree) of them, so they are sent to all tasks, and only the
    rows of other nodes meet by shuffle.
    """
    known = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count(F.lit(1)).alias("n"))
    hubs = known.where(F.col("n") > hub_degree).select("a", F.col("least").alias("_hub"))
    marked = rows.join(F.broadcast(hubs), "a", "left")
    by_hub = marked.where("_hub is not null").select("a", "b", F.col("_hub").alias("least"))
    others = marked.where("_hub is null").join(known.where(F.col("n") <= hub_degree), "a")
    return by_hub.union(others.select("a", "b", "least"))


def _large_star(edges: DataFrame, hub_degree: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")
    joined = _to_least(both.where("b > a"), both, hub_degree)
    return joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame, hub_degree: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    joined = _to_least(down, down, hub_degree)
    linked = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.union(down.groupBy("a").agg(F.min("b").alias("b"))).distinct()


def components(edges: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node it can reach.

    ``edges`` has two columns of one type. Each round is a few joins over narrow rows
    and ends in shared storage; the driver sees a count and a checksum.
    """
    state = checkpointed(edges.toDF("a", "b").where("a <> b").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        state = checkpointed(_small_star(checkpointed(_large_star(state, hub_degree)), hub_degree))
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                state.select(F.col("b"), F.col("b")).distinct()
            )
        mark = tuple(now)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
