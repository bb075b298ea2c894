"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes cuts a text wherever it is small enough, so a cut
depends on its surroundings alone and an edit moves only the cuts near it. Each piece
gives one character of the signature. A fingerprint is ``level:signature:signature``: at
the smallest level with at most ``MOST_PIECES`` pieces (about a cut every ``2^level`` bytes)
and at the next one, whose cuts are a part of the first. Fingerprints are compared by edit
distance where their block sizes are the same or one level apart.

Documents stand in ascending id order, null ids last, rows of one id by a hash of their
text; after the last comes the first. That order is cut into ranges; each range also gets
the first row of the next one, so texts are shuffled once and a task streams through its
range holding two texts.

* Null texts count as empty. An empty text has no piece; two empty signatures are alike (1.0).
* Equal texts have equal fingerprints. Likeness is 0 at levels further than one apart.
* A single document is its own next one. An empty table gives no row. Repeated rows
  each get a row. Extra columns are not used.
* A long text is hashed in segments; what stays is a byte for each of its bytes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROLL_BYTES = 7
LEAST_LEVEL = 1
#: A signature fits a 64-bit word, which holds a column of the edit distance.
MOST_PIECES = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
SEGMENT = 1 << 20
#: Odd, so that no byte of the window is lost, whatever its place.
FACTOR = np.uint32(0x9E3779B1)


def cut_levels(text: bytes) -> np.ndarray:
    """For each byte, the highest level at which a piece ends after it; 0 where none does.

    The level is the number of leading zero bits of the rolling hash, so every level has
    half of the cuts of the one below. The first six bytes have no whole window.
    """
    out = np.zeros(len(text), np.uint8)
    data = np.frombuffer(text, np.uint8)
    for at in range(ROLL_BYTES - 1, len(text), SEGMENT):
        end = min(len(text), at + SEGMENT)
        hashed = np.zeros(end - at, np.uint32)
        for back in range(ROLL_BYTES - 1, -1, -1):
            hashed = (hashed + data[at - back : end - back] + np.uint32(1)) * FACTOR
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x85EBCA77)
        # Doubles hold 32 bits exactly; their exponent is the number of bits in use.
        out[at:end] = 32 - np.frexp(hashed.astype(np.float64))[1]
    return out


def pieces(text: bytes, levels: np.ndarray, level: int) -> list[bytes]:
    """The text cut at a level; joined they are the text."""
    ends = (np.flatnonzero(levels >= level) + 1).tolist()
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def fingerprint(text: bytes) -> str:
    levels = cut_levels(text)
    cuts = np.bincount(levels, minlength=34)[::-1].cumsum()[::-1]  # at each level or above
    # One more piece than cuts, at most.
    level = next(k for k in range(LEAST_LEVEL, 34) if cuts[k] < MOST_PIECES)
    signed = ("".join(ALPHABET[xxhash.xxh32_intdigest(p) & 63] for p in pieces(text, levels, k)) for k in (level, level + 1))
    return ":".join([str(level), *signed])


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements, a column of the table in the bits of one number."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        diagonal = ((same & up) + up ^ up) | same | down
        rise, fall = down | ~(diagonal | up) & every, up & diagonal
        distance += bool(rise & last) - bool(fall & last)
        rise = rise << 1 | 1
        up = (fall << 1 | ~(diagonal | rise)) & every
        down = rise & diagonal & every
    return distance


def likeness(a: str, b: str) -> float:
    """1 less the edits per character of the signatures at common levels; 0 without a common one."""
    (level_a, *signed_a), (level_b, *signed_b) = a.split(":"), b.split(":")
    at_a = {int(level_a) + i: s for i, s in enumerate(signed_a)}
    at_b = {int(level_b) + i: s for i, s in enumerate(signed_b)}
    common = at_a.keys() & at_b.keys()
    if not common:
        return 0.0
    longest = sum(max(len(at_a[k]), len(at_b[k])) for k in common)
    return 1.0 - sum(edit_distance(at_a[k], at_b[k]) for k in common) / longest if longest else 1.0


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the beginning of another."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


OUT = {
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
}
#: Results of a batch.
ROWS_OUT = 1024


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, range, borrowed) in order; one result for each row that is not borrowed.

    A range ends with the borrowed first row of the next range.
    """
    kind, out, before = None, [], None

    def flushed() -> pa.RecordBatch:
        ids = pa.array([r[0] for r in out], kind)
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(OUT.values(), 1)]
        return pa.RecordBatch.from_arrays([ids, *columns], ["id", *OUT])

    for batch in batches:
        kind = batch.schema.field(0).type
        for row_id, text, number, borrowed in zip(*(c for c in batch.columns), strict=True):
            text, number, borrowed = text.as_py(), number.as_py(), borrowed.as_py()
            if borrowed and (before is None or before[3] != number):
                continue  # a further row equal to the one that ended the range
            printed = fingerprint(text.encode())
            if before is not None and before[3] == number:
                own_id, own, own_print, _ = before
                new = edited(own, text)
                raw = new.encode()
                new_print = own_print if new == own else fingerprint(raw)
                out.append(
                    (own_id, len(own), hashlib.sha256(raw).hexdigest(), own_print, new_print,
                     likeness(own_print, new_print), likeness(own_print, printed))
                )
                if len(out) >= ROWS_OUT:
                    yield flushed()
                    out.clear()
            before = None if borrowed else (row_id.as_py(), text, printed, number)
    if out:
        yield flushed()


def _ranges(keys: DataFrame, n: int) -> list[tuple]:
    """First (null id, id, hash) of each range: a row for each task of a sort of the narrow keys."""
    dealt = keys.repartitionByRange(n, "no_id", "id", "hash").groupBy(F.spark_partition_id().alias("task"))
    return sorted(tuple(r["first"]) for r in dealt.agg(F.min(F.struct("no_id", "id", "hash")).alias("first")).collect())


def _with_next(docs: DataFrame, id_column: str) -> DataFrame:
    """(id, text, range, borrowed): ranges of the document order, each with the first row of the next."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")
    )
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = _ranges(rows.select("no_id", "id", "hash"), n)
    known = spark.sparkContext.broadcast(firsts)

    @F.arrow_udf(returnType="array<struct<range: int, borrowed: boolean>>")
    def places(no_id: pa.Array, row_id: pa.Array, hashed: pa.Array) -> pa.Array:
        firsts, out = known.value, []
        for key in zip(no_id.to_pylist(), row_id.to_pylist(), hashed.to_pylist(), strict=True):
            at = bisect_right(firsts, key) - 1  # an id is looked at only where both have one
            own = [{"range": at, "borrowed": False}]
            if firsts[at] == key:
                own.append({"range": (at or len(firsts)) - 1, "borrowed": True})
            out.append(own)
        kind = pa.list_(pa.struct([("range", pa.int32()), ("borrowed", pa.bool_())]))
        return pa.array(out, kind)

    placed = rows.select("*", F.inline(places("no_id", "id", "hash")))
    return (
        placed.repartitionById(max(1, len(firsts)), "range")
        .sortWithinPartitions("range", "borrowed", "no_id", "id", "hash")
        .select("id", "text", "range", "borrowed")
    )


def compare_with_next(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are."""
    kind = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind)])
    for name, arrow in OUT.items():
        schema = schema.add(name, {pa.int64(): "long", pa.float64(): "double"}.get(arrow, "string"))
    return _with_next(docs, id_column).mapInArrow(_compared, schema).withColumnRenamed("id", id_column)
