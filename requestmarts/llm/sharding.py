"""Balanced label propagation: linked documents move towards their neighbours' shards.

Links are given as memberships of a document in hubs (documents under one hub are
linked), so a group of ``n`` copies takes ``n`` rows and never ``n * n`` pairs. Every
round is a few Spark joins:

1. each hub counts its members by shard, at most one row for a hub and shard;
2. each document adds up the counts of its hubs and names the shard that holds most
   of its neighbours;
3. movers between two shards are admitted only as far as others go the other way
   (documents that want to, then documents without links, which lose nothing), so the
   number of rows in a shard never changes.

The law is ``rows``: counts differ by at most one, from the first assignment on (the
rank of a row modulo the number of shards) to the last.

Every row is placed, null and repeated ids too: a row is known by its rank in hash
order of id and text, and rows equal in both are interchangeable. Null text counts as
empty: size 1, CRC-32 of no bytes. An empty table gives no row. Other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from requestmarts.llm.text import global_rank
from requestmarts.sources.checkpoints import checkpointed

SHARDS = 16
ROUNDS = 6
#: Rows of a large hub are spread over so many keys when they meet its counts.
HUB_SALTS = 16


def neighbours_choice(state: DataFrame) -> DataFrame:
    """(row, target): the shard with most of a row's neighbours, itself among them.

    Ties are settled by a hash of the first hub and the shard, so that a hub's members
    agree and ties don't favour one shard.
    """
    linked = state.where(F.size("hubs") > 0).select(
        "row", "shard", F.array_min("hubs").alias("first"), F.explode("hubs").alias("hub")
    )
    counts = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))))
    members = linked.select("row", "hub", "first", F.pmod("row", F.lit(HUB_SALTS)).cast("int").alias("salt"))
    held = members.join(counts, ["hub", "salt"]).groupBy("row", "first", "shard").agg(F.sum("n").alias("n"))
    best = F.max_by("shard", F.struct("n", F.xxhash64("first", "shard")))
    return held.groupBy("row").agg(best.alias("target"))


def quotas(wanted: dict[tuple[int, int], int], free: dict[int, int], shards: int) -> tuple[dict, dict]:
    """Movers admitted from a to b, and rows without links that go back from b to a.

    Pairs of opposite movers are exchanged first; what is left is exchanged against
    unlinked rows of the target shard as far as it has any. Counts never change.
    """
    admitted = {(a, b): min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items()}
    back: dict[tuple[int, int], int] = {}
    left = dict(free)
    for (a, b), n in sorted(wanted.items()):
        more = min(n - admitted[a, b], left.get(b, 0))
        if more > 0:
            admitted[a, b] += more
            back[b, a] = more
            left[b] -= more
    return admitted, back


def _ranges(spark, moves: dict[tuple[int, int], int], kind: str) -> DataFrame:
    """One row for each pair of shards (at most shards squared): ranks [low, high) move."""
    rows, start = [], {}
    for (a, b), n in sorted(moves.items()):
        low = start.get(a, 0) if kind == "free" else 0
        start[a] = low + n
        rows.append((a, b, low, low + n))
    return F.broadcast(spark.createDataFrame(rows, "shard int, target int, low long, high long"))


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (row, _order, hubs, ...) with a balanced ``shard``; ``row`` is the rank from 0."""
    spark = rows.sparkSession
    state = rows.select("row", "_order", "hubs", F.pmod("row", F.lit(shards)).cast("int").alias("shard"))
    state = checkpointed(state)
    for _ in range(rounds):
        movers = (
            state.join(neighbours_choice(state), "row")
            .where(F.col("target") != F.col("shard"))
            .select("row", "_order", "shard", "target")
        )
        movers = checkpointed(movers)
        wanted = {(r[0], r[1]): r[2] for r in movers.groupBy("shard", "target").count().collect()}
        if not wanted:
            break
        unlinked = state.where(F.size("hubs") == 0).select("row", "_order", "shard")
        free = {r[0]: r[1] for r in unlinked.groupBy("shard").count().collect()}
        admitted, back = quotas(wanted, free, shards)
        if not any(admitted.values()):
            break
        moved = (
            global_rank(movers, ["shard", "target"], "_order", ["row"], "_rank")
            .join(_ranges(spark, admitted, "wanted"), ["shard", "target"])
            .where("_rank < high")
            .select("row", F.col("target").alias("moved"))
        )
        if back:
            returned = (
                global_rank(unlinked, ["shard"], "_order", ["row"], "_rank")
                .join(_ranges(spark, back, "free"), "shard")
                .where("_rank >= low and _rank < high")
                .select("row", F.col("target").alias("moved"))
            )
            moved = moved.unionByName(returned)
        state = checkpointed(
            state.join(moved, "row", "left")
            .withColumn("shard", F.coalesce("moved", "shard"))
            .select("row", "_order", "hubs", "shard")
        )
    return state


def numbered(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Id, size, CRC-32 and the digest of the text, with a rank over the whole table as ``row``."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_column).alias("_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.md5(data).alias("_text"),
    ).withColumn("_order", F.md5(F.concat_ws("|", F.col("_id").cast("string"), "_text").cast("binary")))
    return checkpointed(global_rank(rows, [], "_order", ["_id"], "row"))


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_column: str = "doc_id"
) -> DataFrame:
    """Every row's shard and gapless slot; documents of equal text are linked."""
    rows = numbered(docs, id_column)
    groups = rows.groupBy("_text").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_text", F.lit(True).alias("_many"))
    hubbed = rows.join(groups, "_text", "left").select(
        "row",
        "_order",
        F.when(F.col("_many"), F.array("_text")).otherwise(F.array().cast("array<string>")).alias("hubs"),
    )
    placed = propagate(hubbed, shards, rounds).select("row", "_order", "shard")
    slots = global_rank(placed, ["shard"], "_order", ["row"], "slot").select("row", "shard", "slot")
    return rows.join(slots, "row").select(
        F.col("_id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_text").alias("group_md5"),
    )
