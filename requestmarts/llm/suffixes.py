"""Repeated byte strings by column-wise construction of a collection's suffix order.

Removes every byte under a ``WINDOW``-byte string that also starts elsewhere.

Column-wise construction inserts one symbol of every document in each round and
updates the collection's Burrows-Wheeler transform and common prefixes. Over whole
texts that takes as many rounds over all data as the longest text has bytes, so the
documents of a collection are here the surroundings of shared anchors:

1. A window's anchor is the 96-byte string in it with the smallest hash. Equal windows
   have their anchor at the same place, so a repeated window lies in the surroundings
   (at most 704 bytes: all windows of an anchor) of two anchors of equal hash.
2. Hashes and digests of surroundings are counted with map-side sums. An anchor that
   occurs once is dropped. If all surroundings of an anchor agree, all windows in them
   are repeated.
3. One copy of each other surrounding goes to its anchor's collection. From the last
   column to the first, each round inserts one symbol per document: the symbols in
   suffix order are the column's part of the transform, a stable sort by them gives the
   next order, and each common prefix is one more than the least between its new
   neighbours. A suffix with a common prefix of a window's length is a repeated window.
4. Marks return to the texts by join and are merged there.

The external files of the method are Spark's sorted shuffle files, read once in order;
a task holds ``TOGETHER`` surroundings at a time. Anchors with more distinct
surroundings than that are not built in one task: their windows are hashed (128 bits)
and counted, which is exact and combines map-side.

Null text counts as empty; texts under a window's length lose nothing. Equal texts are
worked on once; of a window or longer they lose all bytes. Repeated rows are copies.
Rows keep their own ids, null ones too; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestmarts.sources.checkpoints import checkpointed

WINDOW = 400
GRAM = 96
SPAN = WINDOW - GRAM  # bytes that a window can have on either side of an anchor
WIDTH = SPAN + GRAM + SPAN
TOGETHER = 20_000
FLUSH_ROWS = 65_536

BASE = 0xD6E8FEB86659FD93
TABLE = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every ``GRAM`` bytes, by joining hashes of powers of two."""
    powers, size = {1: TABLE[data]}, 1
    power = lambda n: np.uint64(pow(BASE, n, 2**64))
    while 2 * size <= GRAM:
        own = powers[size]
        powers[2 * size] = own[:-size] * power(size) + own[size:]
        size *= 2
    total, out = size, powers[size]
    while total < GRAM:
        size //= 2
        if GRAM - total >= size:
            n = len(data) - total - size + 1
            out = out[:n] * power(size) + powers[size][total : total + n]
            total += size
    out ^= out >> np.uint64(32)
    return out * np.uint64(0x9E3779B97F4A7C15)


def least_of(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` in a row."""
    rows = -(-len(x) // size)
    padded = np.full(rows * size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(rows, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - size + 1
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


PLACE = np.uint64(2**31 - 1)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, last window) of each anchor.

    A window's anchor is its string with the smallest hash (by the upper 33 bits), the
    leftmost of equal ones, so it depends on the window alone. The windows of an
    anchor stand in a row.
    """
    hashes = gram_hashes(data)
    placed = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    of_window = (least_of(placed, SPAN + 1) & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], of_window[1:] != of_window[:-1])))
    last = np.concatenate((first[1:] - 1, [len(of_window) - 1]))
    at = of_window[first]
    return at, hashes[at], first, last


Place = tuple[int, int, int, int, int, int]


def surroundings(raw: bytes) -> list[Place]:
    """(hash, digest, place, last place, bytes before, bytes from the anchor on) of each surrounding.

    A surrounding is the bytes of all windows of an anchor. Where the same one comes again
    without a gap, as in periodic text, it is one row from its first to its last place.
    """
    out: list[Place] = []
    seen: dict[tuple[int, int], int] = {}
    columns = anchors(np.frombuffer(raw, np.uint8))
    for p, h, a, b in zip(*(c.tolist() for c in columns), strict=True):
        end = b + WINDOW
        digest = xxhash.xxh64_intdigest(raw[a:end], p - a)
        i = seen.get((h, digest))
        if i is not None and a <= out[i][3] + out[i][5]:
            out[i] = (*out[i][:3], p, *out[i][4:])
        else:
            seen[h, digest] = len(out)
            out.append((h, digest, p, p, p - a, end - p))
    return out


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, rows = [], [], []

    def flushed() -> pa.RecordBatch:
        hashes, digests, at, until, left, right = zip(*rows, strict=True)
        index = pa.array(np.repeat(np.arange(len(keys), dtype=np.int32), counts))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(hashes, np.uint64).view(np.int64)),
                pa.array(np.array(digests, np.uint64).view(np.int64)),
                pa.array(keys, pa.binary()).take(index),
                pa.array(at, pa.int32()),
                pa.array(until, pa.int32()),
                pa.array(np.array(left, np.int16)),
                pa.array(np.array(right, np.int16)),
            ],
            ["hash", "ctx", "key", "at", "until", "left", "right"],
        )

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            raw = text.as_py()
            if len(raw) < WINDOW:
                continue
            own = surroundings(raw)
            keys.append(key.as_py())
            counts.append(len(own))
            rows += own
            if len(rows) >= FLUSH_ROWS:
                yield flushed()
                keys, counts, rows = [], [], []
    if rows:
        yield flushed()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, ctx, many, left, part) for the listed anchors of each packed text."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for packed, listed in zip(batch.column(0), batch.column(1), strict=True):
            raw = unpack.decompress(packed.as_py())
            for a in listed.as_py():
                part = raw[a["at"] - a["left"] : a["at"] + a["right"]]
                out.append((a["hash"], a["ctx"], a["many"], a["left"], part))
            if len(out) >= TOGETHER:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["hash", "ctx", "many", "left", "part"])


def repeated_windows(symbols: np.ndarray, groups: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last column at which a window starts that another document of the group has as well.

    ``symbols`` is columns x documents, 0 where a document has none; ``groups`` ascends.
    Documents without such a window get -1.
    """
    width, n = symbols.shape
    order = np.arange(n)
    first, last = np.full(n, -1), np.full(n, -1)
    # common[i]: common prefix of the suffixes at places i - 1 and i of the order.
    common = np.zeros(n + 1, np.int32)
    scaled = groups.astype(np.int64) * 257
    inside = np.zeros(n, bool)
    inside[1:] = groups[1:] == groups[:-1]
    for column in range(width - 1, -1, -1):
        # The symbols before the suffixes, in suffix order: this round's part of the transform.
        before = symbols[column][order]
        key = scaled + before
        if (key[1:] < key[:-1]).any():
            place = np.argsort(key, kind="stable")
            key, before, order = key[place], before[place], order[place]
            x, y = place[:-1] + 1, place[1:]
            least = common[np.minimum(y, n)].copy()
            far = np.flatnonzero((key[1:] == key[:-1]) & (x < y))
            if len(far):
                cuts = np.empty(2 * len(far), np.int64)
                cuts[::2], cuts[1::2] = x[far], y[far] + 1
                least[far] = np.minimum.reduceat(common, cuts)[::2]
        else:
            least = common[1:n]
        grown = np.where((key[1:] == key[:-1]) & (before[1:] > 0), least + 1, 0)
        common = np.zeros(n + 1, np.int32)
        common[1:n] = np.minimum(grown, window)
        if column <= width - window:
            full = common >= window
            found = order[full[:-1] | full[1:]]
            last[found] = np.where(last[found] < 0, column, last[found])
            first[found] = column
    return first, last


def _collection(batches: Iterator[pa.RecordBatch], together: int) -> Iterator[pa.RecordBatch]:
    """(hash, ctx, low, high): marked bytes relative to the anchor. Rows come sorted by hash and ctx."""

    def marked(rows: list[tuple]) -> pa.RecordBatch:
        symbols = np.zeros((len(rows), WIDTH), np.uint16)
        for i, (_, _, _, left, part) in enumerate(rows):
            symbols[i, SPAN - left : SPAN - left + len(part)] = np.frombuffer(part, np.uint8).astype(np.uint16) + 1
        hashes = np.array([r[0] for r in rows])
        groups = np.concatenate(([0], np.cumsum(hashes[1:] != hashes[:-1])))
        first, last = repeated_windows(np.ascontiguousarray(symbols.T), groups, WINDOW)
        # All windows of a surrounding that occurs more than once are repeated.
        for i, (_, _, many, left, part) in enumerate(rows):
            if many and len(part) >= WINDOW:
                first[i], last[i] = SPAN - left, SPAN - left + len(part) - WINDOW
        on = np.flatnonzero(first >= 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(hashes[on]),
                pa.array([rows[i][1] for i in on], pa.int64()),
                pa.array((first[on] - SPAN).astype(np.int32)),
                pa.array((last[on] - SPAN + WINDOW).astype(np.int32)),
            ],
            ["hash", "ctx", "low", "high"],
        )

    ready: list[tuple] = []
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and group[-1][0] != row[0]:
                if len(ready) + len(group) > together:
                    if ready:
                        yield marked(ready)
                    ready = []
                ready += group
                group = []
            group.append(row)
    for rest in [ready + group] if len(ready) + len(group) <= together else [ready, group]:
        if rest:
            yield marked(rest)


def _hashed_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, ctx, start, window) of every window of each surrounding, by 128-bit hash."""
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            hashes, ctxs, starts, windows, many = [], [], [], [], []
            for h, c, m, left, part in zip(*(x.to_pylist() for x in batch.slice(i, 200).columns), strict=True):
                for s in range(len(part) - WINDOW + 1):
                    hashes.append(h)
                    ctxs.append(c)
                    many.append(m)
                    starts.append(s - left)
                    windows.append(xxhash.xxh3_128_digest(part[s : s + WINDOW]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes, pa.int64()),
                    pa.array(ctxs, pa.int64()),
                    pa.array(many, pa.bool_()),
                    pa.array(starts, pa.int32()),
                    pa.array(windows, pa.binary()),
                ],
                ["hash", "ctx", "many", "start", "window"],
            )


@F.arrow_udf(returnType=T.BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Texts as they travel: their UTF-8 bytes, compressed."""
    press = zstandard.ZstdCompressor(level=1)
    return pa.array([press.compress(t.as_py()) for t in texts.cast(pa.binary())], pa.binary())


def keyed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*columns, F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def marks(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(key, low, high): byte ranges under repeated windows, by MD5 of the text."""
    texts = keyed(docs)
    found = texts.mapInArrow(
        _anchored, "hash long, ctx long, key binary, at int, until int, left short, right short"
    )
    place = F.xxhash64("key", "at")
    shared = (
        found.groupBy("hash")
        .agg(
            (F.min("ctx") != F.max("ctx")).alias("several"),
            ((F.min(place) != F.max(place)) | F.max(F.col("until") > F.col("at"))).alias("repeated"),
        )
        .where("repeated")
        .select("hash", "several")
    )
    # Anchors that occur twice or more: a part of all, read several times.
    places = checkpointed(found.join(shared, "hash").distinct())
    whole = places.where("not several").select(
        "key", (F.col("at") - F.col("left")).alias("low"), (F.col("until") + F.col("right")).alias("high")
    )
    several = places.where("several").select("hash", "ctx", "key", "at", "until", "left", "right")
    classes = several.groupBy("hash", "ctx").agg(
        F.min(F.struct("key", "at")).alias("one"),
        ((F.count(F.lit(1)) > 1) | F.max(F.col("until") > F.col("at"))).alias("many"),
        F.min("left").alias("left"),
        F.min("right").alias("right"),
    )
    classes = checkpointed(classes.select("hash", "ctx", "many", "left", "right", "one.key", "one.at"))
    listed = classes.groupBy("key").agg(
        F.collect_list(F.struct("hash", "ctx", "many", "at", "left", "right")).alias("listed")
    )
    once = texts.select("key", packed("text").alias("packed")).groupBy("key").agg(F.first("packed").alias("packed"))
    parts = once.join(listed, "key").select("packed", "listed").mapInArrow(
        _parts, "hash long, ctx long, many boolean, left int, part binary"
    )
    # Anchors with more surroundings than a task holds: found from the narrow classes.
    large = classes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > together).select("hash")
    large = checkpointed(large)
    if large.isEmpty():
        built, counted = parts, None
    else:
        parts = checkpointed(parts)
        built, counted = parts.join(large, "hash", "left_anti"), parts.join(large, "hash", "left_semi")
    verdicts = (
        built.repartition("hash")
        .sortWithinPartitions("hash", "ctx")
        .mapInArrow(partial(_collection, together=together), "hash long, ctx long, low int, high int")
    )
    if counted is not None:
        columns = ["hash", "ctx", "many", "left", "part"]
        windows = counted.select(*columns).mapInArrow(
            _hashed_windows, "hash long, ctx long, many boolean, start int, window binary"
        )
        windows = checkpointed(windows)
        # A window around two anchors comes twice; only its equals around the same anchor count.
        same = ["hash", "start", "window"]
        twice = windows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*same, F.lit(True).alias("twice"))
        hit = windows.join(twice, same, "left").where("many or twice")
        verdicts = verdicts.union(
            hit.groupBy("hash", "ctx").agg(F.min("start").alias("low"), (F.max("start") + WINDOW).cast("int").alias("high"))
        )
    partly = several.join(verdicts, ["hash", "ctx"]).select(
        "key", (F.col("at") + F.col("low")).alias("low"), (F.col("until") + F.col("high")).alias("high")
    )
    size = F.octet_length("text")
    copies = texts.select("key", size.alias("n")).where(F.col("n") >= WINDOW).groupBy("key", "n").count().where("count > 1")
    return whole.union(partly).union(copies.select("key", F.lit(0), F.col("n")))


RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("kept", T.BinaryType()),
    ]
)


@F.arrow_udf(returnType=RESULT)
def cut(packed_texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """Merged removed ranges and the remaining bytes of each text."""
    unpack = zstandard.ZstdDecompressor()
    sizes, removed, kept = [], [], []
    for text, own in zip(packed_texts, ranges, strict=True):
        raw = unpack.decompress(text.as_py())
        merged: list[list[int]] = []
        for r in sorted((x["low"], min(x["high"], len(raw))) for x in own.as_py() or ()):
            if merged and r[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], r[1])
            else:
                merged.append(list(r))
        edges = [0, *[e for r in merged for e in r], len(raw)]
        sizes.append(len(raw))
        removed.append(merged)
        kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
    return pa.StructArray.from_arrays(
        [pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
        RESULT.names,
    )


def remove_repeats(docs: DataFrame, together: int = TOGETHER, id_column: str = "doc_id") -> DataFrame:
    """Id, bytes, removed ranges [start, end) and the remaining bytes (``kept``), for every row."""
    rows = keyed(docs, F.col(id_column)).select(id_column, "key", packed("text").alias("packed"))
    ranges = marks(docs, together).groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    joined = rows.join(ranges, "key", "left").select(id_column, cut("packed", "ranges").alias("_cut"))
    return joined.select(id_column, *[F.col(f"_cut.{name}").alias(name) for name in RESULT.names])
