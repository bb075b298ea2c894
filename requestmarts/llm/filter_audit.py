"""How five document filters interact: every order of applying them, and what each one is worth.

Filters that remove documents form a game: the value of a coalition is the number of
documents that fail at least one of its filters. Its Hart-Mas-Colell potential is
``P(S) = (v(S) + sum of P(S without i)) / |S|`` with ``P(empty) = 0``; the Shapley value of a
filter is the potential of all filters minus the potential without it. ``|S|! P(S)`` is
a whole number, so that is what is computed, and the answer is exact: it equals what the
filter removes, summed over all orders.

What a step of an order removes is the difference of two coalition values, so the 32
coalitions of each language are all that is ever needed. Texts are read once; documents
collapse to (language, failure bits, labels) before anything else.

* Null text counts as empty: it has no words (fails A), no capitals, no symbols.
* Equal texts are compared by SHA-256, over the whole table. A document fails E if a
  smaller id has its text; so rows that share the smallest id all pass, a row without an
  id always passes and makes no other fail.
* A null language is the part ''. Parts are the languages that occur; an empty table
  has none.
* A document is good (toxic) if any row of ``labels`` with its id says so; labels without
  an id, or of ids that do not occur, count nowhere.
* Repeated rows count as often as they occur. Extra columns are not used.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A to D read one text; E compares texts.
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(order) for order in permutations(FILTERS)]

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
#: Bytes of UTF-8 that do not begin a code point.
CONTINUATION = bytes(range(0x80, 0xC0))


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # of bytes: at the six ASCII blanks, as the contract's words
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUATION))
    return (
        (len(words) < 100)
        | (100 * len(set(words)) < 80 * len(words)) << 1
        | (100 * capitals > 10 * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


@F.arrow_udf(returnType=T.IntegerType())
def failures_of(texts: pa.Array) -> pa.Array:
    return pa.array([text_failures(t.as_py()) for t in texts.cast(pa.binary())], pa.int32())


def _labelled(docs: DataFrame, labels: DataFrame, id_column: str) -> DataFrame:
    """Distinct (id, text, part, bits, good, toxic) with their number of rows ``n``."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce("lang", F.lit("")).alias("part"),
        failures_of(text).alias("bits"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_hash"),
    )
    marks = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.expr("max(quality <=> 1) as good"), F.expr("max(toxic <=> 1) as toxic"))
    )
    # Rows without an id meet no label; their text deals them out, so they don't gather.
    own = found.withColumn("row_key", F.struct("id", F.expr("if(id is null, text_hash, null) as alone")))
    of_id = marks.select(
        F.struct(F.col("doc_id").alias("id"), F.lit(None).cast("binary").alias("alone")).alias("row_key"), "good", "toxic"
    )
    joined = own.join(of_id, "row_key", "left").select(
        "row_key", "id", "text_hash", "part", "bits",
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )
    # The join has put equal ids together, so this moves nothing.
    return joined.groupBy("row_key", "id", "text_hash", "part", "bits", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))


def failure_counts(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(part, good, toxic, bits, n): documents by the filters they fail, E among them.

    Copies of a text are summed map-side to one row for each part and pair of labels, so a
    text that a third of all rows share is a handful of rows before it is shuffled.
    """
    same = ["text_hash", "part", "bits", "good", "toxic"]
    copies = _labelled(docs, labels, id_column).groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.min(F.expr("if(id is null, null, struct(id, n))")).alias("first"),
        F.coalesce(F.sum(F.expr("if(id is null, n, 0)")), F.lit(0)).alias("n_without_id"),
    )
    # A text has one row for each part and labels, so its window is small.
    rated = copies.withColumn("least", F.min("first.id").over(Window.partitionBy("text_hash"))).withColumn(
        "passing", F.expr("n_without_id + if(first.id = least, first.n, 0L)")
    )
    both = rated.select(
        "part", "good", "toxic",
        F.expr("inline(array(struct(bits as bits, passing as n), struct(bits | 16 as bits, n - passing as n)))"),
    )
    return both.groupBy("part", "good", "toxic", "bits").agg(F.sum("n").alias("n"))


def coalition_values(counts: DataFrame) -> DataFrame:
    """One row a part: arrays over the 32 coalitions of documents removed, good and toxic ones removed."""
    each = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("s"))
    values = each.groupBy("part", "s").agg(
        F.expr("sum(if(bits & s <> 0, n, 0L)) as removed"),
        F.expr("sum(if(bits & s <> 0 and good, n, 0L)) as good"),
        F.expr("sum(if(bits & s <> 0 and toxic, n, 0L)) as toxic"),
        F.sum("n").alias("total"),
    )
    games = values.groupBy("part").agg(
        F.max("total").alias("total"), F.expr("sort_array(collect_list(struct(s, removed, good, toxic))) as game")
    )
    return games.select(
        "part", "total", F.expr("game.removed as removed"), F.expr("game.good as good"), F.expr("game.toxic as toxic")
    )


def potentials(values: DataFrame) -> DataFrame:
    """Adds ``potential``: |S|! P(S) of the removal game for each coalition S, smaller ones first."""
    bits = f"array({', '.join(str(1 << i) for i in range(len(FILTERS)))})"
    without_one = f"aggregate(filter({bits}, b -> s & b <> 0), 0L, (sum, b) -> sum + get(done, s ^ b))"
    own = "factorial(bit_count(s) - 1) * get(removed, s)"
    return values.withColumn(
        "potential",
        F.expr(
            f"aggregate(sequence(1, {ALL}), cast(array(0) as array<bigint>),"
            f" (done, s) -> concat(done, array({own} + {without_one})))"
        ),
    )


def interactions(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each part, order of the filters and step; see the module for every count."""
    games = potentials(coalition_values(failure_counts(docs, labels, id_column)))
    steps = (
        games.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("bit", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - ascii('A'))"))
        .withColumn(
            "after",
            F.expr("aggregate(sequence(1, step), 0, (s, k) -> s | shiftleft(1, ascii(substring(filter_order, k, 1)) - ascii('A')))"),
        )
        .withColumn("before", F.expr("after ^ bit"))
    )
    gained = lambda game: F.expr(f"get({game}, after) - get({game}, before)")
    # n! P(all) and (n - 1)! P(all but one): the second is brought to the same factor.
    shapley = F.expr(f"get(potential, {ALL}) - {len(FILTERS)} * get(potential, {ALL} ^ bit)")
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.expr("total - get(removed, after)").alias("kept"),
        gained("removed").alias("removed"),
        F.expr("get(removed, bit) - (get(removed, after) - get(removed, before))").alias("redundant"),
        F.expr(f"get(removed, {ALL}) - get(removed, {ALL} ^ bit)").alias("unique_fails"),
        gained("good").alias("good_lost"),
        gained("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )
