"""Mixing sources to target weights by hierarchical budgeting, in built-in functions only.

Documents sit in a tree of domain, language and source. A budget of tokens goes down
the tree: at each node it is shared among the children in proportion to their
weights, a child that cannot use its share (its tokens times the epochs allowed)
takes what it can, and the rest goes to its siblings. Only what a whole family cannot
use goes to the siblings of its parent. Each leaf then spends its budget on whole
seeded epochs and on a prefix of one more.

Shares are integers: the capped children are those with the smallest capacity for
their weight, the others get ``floor(rest * weight / weights left)``. Exact decimal
arithmetic makes the result the same on any engine.

* Null domain, language or source is a branch of its own, named ``?``. Weights of
  branches that are not listed are 1.
* Null and empty texts have no token; they are taken with the prefix they stand in.
* Ties in the seeded order fall to the smaller id. A document is taken if it starts
  within the leaf's budget: the prefix ends in the last one taken, whole documents are
  kept, and no leaf with a budget goes empty because its first document is longer.
* Repeated rows are documents of their own. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from requestmarts.llm.text import NOT_BLANK, as_row, global_prefix
from requestmarts.operators.lookups import MAX_BROADCAST_BYTES, measured_bytes
from requestmarts.sources.checkpoints import checkpointed

LEVELS = ("domain", "lang", "source")
EXACT = "decimal(38,0)"
#: Weights of branches by their path; others weigh 1.
WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1, "d0/en": 5, "d1/en": 5, "d2/en": 5, "d3/en": 5}
#: Percent of all tokens that are to be sampled, and how often a document may be used.
BUDGET_PERCENT = 80
MAX_EPOCHS = 2
SEED = 17


def domain_of(source: Column) -> Column:
    """Stand-in domain of a source: one of four groups by the first digit of its MD5."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit("?")).cast("binary")), 1, 1)
    return F.when(digit < "4", "d0").when(digit < "8", "d1").when(digit < "c", "d2").otherwise("d3")


def path(depth: int, columns: dict[str, Column] | None = None) -> Column:
    """Path of the first ``depth`` levels; the empty path is the root. A slash in a name is ``%2F``."""
    names = [F.replace(F.replace((columns or {}).get(c, F.col(c)), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")) for c in LEVELS[:depth]]
    # The root's path is a value of the row, not a literal, so that joining it stays an equi-join.
    return F.concat_ws("/", *names) if depth else F.substring(F.col(LEVELS[0]), 1, 0)


def capacities(leaves: DataFrame, depth: int, max_epochs: int) -> DataFrame:
    """(path, parent, capacity) of every node at a depth."""
    return leaves.groupBy(path(depth).alias("node"), path(depth - 1).alias("parent")).agg(
        (F.sum("tokens") * max_epochs).cast(EXACT).alias("capacity")
    )


def shared_out(children: DataFrame) -> DataFrame:
    """Budgets of (node, parent, capacity, weight, given), ``given`` being the parent's budget."""
    order = Window.partitionBy("parent").orderBy(
        F.col("capacity").cast("double") / F.col("weight").cast("double"), "node"
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = children.withColumns(
        {
            "_used": F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(EXACT),
            "_weights": F.sum("weight").over(after).cast("bigint"),
        }
    ).withColumn("_full", F.expr(f"capacity * _weights <= cast((given - _used) * weight as {EXACT})"))
    whole = Window.partitionBy("parent")
    rest = level.withColumns(
        {
            "_taken": F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(whole), F.lit(0)).cast(EXACT),
            "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole).cast("bigint"),
        }
    )
    exact = F.expr(f"cast((cast((given - _taken) * weight as {EXACT}) div _open) as {EXACT})")
    return rest.select("node", F.when(F.col("_full"), F.col("capacity")).otherwise(exact).alias("budget"))


def leaf_budgets(leaves: DataFrame, weights: DataFrame, percent: int, max_epochs: int) -> DataFrame:
    """(leaf path, budget) from (domain, lang, source, tokens).

    The tree has one row for each (domain, language, source); it is aggregated from
    all documents and never larger than their distinct combinations.
    """
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    given = total.select(
        F.substring(F.col("t").cast("string"), 1, 0).alias("node"),
        F.expr(f"cast(least(cast(t as {EXACT}) * {percent} div 100, cast(t as {EXACT}) * {max_epochs}) as {EXACT})").alias(
            "budget"
        ),
    )
    for depth in range(1, len(LEVELS) + 1):
        nodes = capacities(leaves, depth, max_epochs).join(weights, "node", "left")
        children = nodes.withColumn("weight", F.coalesce("weight", F.lit(1)).cast("bigint")).join(
            given.select(F.col("node").alias("parent"), F.col("budget").alias("given")), "parent"
        )
        given = shared_out(children)
    return given


def branch(column: Column) -> Column:
    """A branch's name; null is ``?``."""
    return F.coalesce(column.cast("string"), F.lit("?"))


def leaf_of(docs: DataFrame | Column, domain: Column | None = None) -> Column:
    """The leaf's path of each row, from its own columns; ``docs`` may be a struct of them."""
    names = {
        "domain": branch(domain_of(docs["source"]) if domain is None else domain),
        "lang": branch(docs["lang"]),
        "source": branch(docs["source"]),
    }
    return path(len(LEVELS), names)


def leaved(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """Adds the tree's levels, tokens (words) and the leaf's path."""
    pattern = NOT_BLANK.replace("\\", "\\\\")
    return docs.withColumns(
        {
            "domain": branch(domain_of(F.col("source")) if domain is None else domain),
            "lang": branch(F.col("lang")),
            "source": branch(F.col("source")),
            "n_tokens": F.expr(f"cast(regexp_count(coalesce(text, ''), '{pattern}') as bigint)"),
        }
    ).withColumn("leaf", path(len(LEVELS)))


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    percent: int = BUDGET_PERCENT,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    id_column: str = "doc_id",
    keep_digest: bool = False,
) -> DataFrame:
    """Every row's leaf, tokens, leaf budget and ``copies``, the epochs that hold it (0: not sampled)."""
    spark = docs.sparkSession
    table = spark.createDataFrame(list((WEIGHTS if weights is None else weights).items()), "node string, weight long")
    rows = leaved(docs.select(F.col(id_column), "text", "lang", "source")).select(
        id_column, *LEVELS, "leaf", "n_tokens", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_text")
    )
    # Texts are read once; what follows works on narrow rows.
    rows = checkpointed(rows)
    leaves = rows.groupBy(*LEVELS, "leaf").agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, table, percent, max_epochs)
    spent = leaves.join(budgets.withColumnRenamed("node", "leaf"), "leaf").select(
        F.col("leaf").alias("_leaf"),
        F.col("budget").cast("bigint").alias("leaf_budget"),
        F.expr("case when tokens = 0 then 1 else cast(budget as bigint) div tokens end").alias("_whole"),
        F.expr("case when tokens = 0 then 0 else cast(budget as bigint) % tokens end").alias("_part"),
    )
    # One row a leaf, measured; a leaf with a third of all rows then needs no task of its own.
    spent = checkpointed(spent)
    small = measured_bytes(spent) <= MAX_BROADCAST_BYTES
    joined = rows.join(F.broadcast(spent) if small else spent, F.col("leaf") == F.col("_leaf")).drop("_leaf")
    # The order of the epoch of which only a prefix is used.
    epoch = F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.col(id_column).cast("string"), "_text")
    ordered = global_prefix(
        joined.withColumn("_order", F.md5(epoch.cast("binary"))), ["leaf"], "_order", [id_column], "n_tokens", "_before"
    )
    copies = F.col("_whole") + F.when(F.col("_before") < F.col("_part"), 1).otherwise(0)
    return ordered.select(
        id_column,
        *LEVELS,
        "n_tokens",
        "leaf_budget",
        F.least(copies, F.lit(max_epochs)).cast("long").alias("copies"),
        *(["leaf", "_text"] if keep_digest else []),
    )


def sampled_documents(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    percent: int = BUDGET_PERCENT,
    max_epochs: int = 1,
    seed: int = SEED,
    id_column: str = "doc_id",
) -> DataFrame:
    """The sampled documents, all columns, each as often as the epochs that hold it."""
    chosen = mix(docs, weights, percent, max_epochs, seed, id_column, keep_digest=True)
    # Rows equal in id, leaf and text share their epochs: each has the whole ones, the first of them one more.
    same = [id_column, "leaf", "_text"]
    copies = chosen.groupBy(*same).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    copies = copies.where("_copies > 0").select(
        F.col(id_column).alias("_id"), F.col("leaf").alias("_leaf"), F.col("_text").alias("_digest"), "_copies", "_rows"
    )
    # Columns travel as one, so that none can clash.
    digest = F.md5(F.coalesce("row.text", F.lit("")).cast("binary"))
    row = F.col("row")
    same = row[id_column].eqNullSafe(F.col("_id")) & (digest == F.col("_digest")) & (leaf_of(row) == F.col("_leaf"))
    found = as_row(docs).join(copies, same)
    single = found.where("_rows = 1")
    order = Window.partitionBy("_id", "_leaf", "_digest").orderBy(F.md5(F.to_json("row").cast("binary")))
    repeated = found.where("_rows > 1").withColumn("_at", F.row_number().over(order))
    own = F.expr("_copies div _rows + case when _at <= _copies % _rows then 1 else 0 end")
    repeated = repeated.withColumn("_copies", own).where("_copies > 0").drop("_at")
    both = single.unionByName(repeated)
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return both.select("row", times).select("row.*")
