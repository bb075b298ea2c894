"""Benchmark decontamination by winnowing.

Of every ``w`` consecutive k-word hashes of a text the smallest is kept (the last one
of several). Two texts that share ``k + w - 1`` words keep the same hash there, so a
join of kept hashes finds every shared window; each hit is then extended word by
word to the whole shared run, and runs shorter than a window are dropped.

The kept hashes of a benchmark of at most ``ITEM_BYTES``, measured, are sent to the tasks:
texts are then read once, joined and extended where they are, and nothing is shuffled.
Those of a larger one are joined by a shuffle, which moves only the texts that are hit.
Both give the same rows.

Hits of a text and an item are kept by diagonal (how far their places are apart) with
their first and last place, so text of one repeated word takes a row for each diagonal,
not for each pair of places.

With 13-word windows: k = 5, w = 9. An item of fewer words is one window; such items
form one class for each length, with their own k and w of the same sum.

* Null and empty texts have no words: no hit, not contaminated. Items without a
  word, or with a null text, are never found.
* Equal texts are compared once, by their MD5; every row gets its own result, so
  null or repeated ids are fine.
* Repeated item ids: an id counts once. A null item id is left out of the item list,
  its words still count as hit.
* Extra columns of both tables are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestmarts.llm.text import as_row, plain_words
from requestmarts.sources.checkpoints import checkpointed

WINDOW = 13
#: Texts and ids of a benchmark that is sent to the tasks.
ITEM_BYTES = 8 << 20
#: A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20
#: A word for Spark's regular expressions; capital letters count, as texts are lower-cased first.
WORD = r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_size(window: int) -> int:
    """k of a class; w is window - k + 1, so that every window keeps one hash."""
    return (window + 1) // 3 + 1 if window > 2 else window


def gram_hashes(words: list[bytes], k: int, known: dict[bytes, int]) -> np.ndarray:
    """Hash of every k consecutive words. Equal grams have equal hashes in every process."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    for word in set(words).difference(known):
        known[word] = xxhash.xxh64_intdigest(word)
    single = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    out = single[: n - k + 1].copy()
    for i in range(1, k):
        out = out * MULTIPLIER + single[i : n - k + 1 + i]
        out ^= out >> np.uint64(29)
    return out * MULTIPLIER


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the kept hashes: the smallest of every ``w`` in a row, the last of equal ones."""
    if len(hashes) < w or w == 1:
        return np.arange(len(hashes)) if w == 1 else np.empty(0, np.int64)
    backwards = sliding_window_view(hashes, w)[:, ::-1]
    kept = np.arange(w - 1, len(hashes)) - backwards.argmin(axis=1)
    # Positions never decrease from window to window.
    return kept[np.concatenate(([True], kept[1:] != kept[:-1]))]


FINGERPRINTS = "key binary, size int, hash long, at int"
FLUSH_ROWS = 65_536


def _fingerprints(batches: Iterator[pa.RecordBatch], classes: list[int] | None) -> Iterator[pa.RecordBatch]:
    """(key, class, hash, position) of the kept hashes of each text.

    Items (``classes`` is None) belong to the class of their own length; a document is
    winnowed for each class.
    """
    known: dict[bytes, int] = {}
    keys, sizes, hashed, starts, rows = [], [], [], [], 0

    def flushed() -> pa.RecordBatch:
        lengths = [len(x) for x in starts]
        index = pa.array(np.repeat(np.arange(len(keys), dtype=np.int32), lengths))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.binary()).take(index),
                pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                pa.array(np.concatenate(hashed).view(np.int64)),
                pa.array(np.concatenate(starts).astype(np.int32)),
            ],
            ["key", "size", "hash", "at"],
        )

    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            words = plain_words(text.as_py())
            if len(known) > 500_000:
                known.clear()
            own = classes if classes is not None else [min(len(words), WINDOW)] if words else []
            for size in own:
                k = gram_size(size)
                hashes = gram_hashes(words, k, known)
                at = winnowed(hashes, size - k + 1)
                if len(at):
                    keys.append(key.as_py())
                    sizes.append(size)
                    hashed.append(hashes[at])
                    starts.append(at)
                    rows += len(at)
            if rows >= FLUSH_ROWS:
                yield flushed()
                keys, sizes, hashed, starts, rows = [], [], [], [], 0
    if rows:
        yield flushed()


def fingerprints(texts: DataFrame, classes: list[int] | None) -> DataFrame:
    """Kept hashes of a (key, text) frame."""
    return texts.mapInArrow(partial(_fingerprints, classes=classes), FINGERPRINTS)


def runs_on_diagonal(
    words: list[bytes], item: list[bytes], shift: int, first: int, last: int, window: int
) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of words equal to the item's, ``shift`` words apart, that hold a
    whole window: all that meet the places from ``first`` to ``last``."""
    low, high = max(0, shift), min(len(words), len(item) + shift)
    start = first
    while start > low and words[start - 1] == item[start - 1 - shift]:
        start -= 1
    runs, at = [], start
    while True:
        while at < high and words[at] == item[at - shift]:
            at += 1
        if at - start >= window:
            runs.append((start, at))
        if at >= high or at > last:
            return runs
        at += 1
        start = at


def covered(runs: list[tuple[int, int]]) -> int:
    """Words under a union of runs."""
    total, reach = 0, 0
    for a, b in sorted(runs):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


class Items:
    """A benchmark of bounded size: words and ids of distinct texts, kept hashes by class."""

    def __init__(self, rows: list[tuple[str | None, str | None]]) -> None:
        ids: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in rows:
            own = tuple(plain_words((text or "").encode()))
            if own:
                ids.setdefault(own, set()).update({item_id} - {None})
        self.words = [list(w) for w in ids]
        self.ids = [sorted(x) for x in ids.values()]
        prints: dict[int, list[tuple[int, int, int]]] = {}
        for item, words in enumerate(self.words):
            size = min(len(words), WINDOW)
            k = gram_size(size)
            hashes = gram_hashes(words, k, {})
            at = winnowed(hashes, size - k + 1)
            prints.setdefault(size, []).extend((int(hashes[i]), item, int(i)) for i in at)
        self.classes = {}
        for size, found in sorted(prints.items()):
            found.sort()
            hashes, items, places = zip(*found, strict=True)
            self.classes[size] = (np.array(hashes, np.uint64), items, places)

    def runs(self, words: list[bytes], known: dict[bytes, int]) -> list[tuple[int, list[tuple[int, int]]]]:
        """(item, shared runs) of a text, for the items that have some."""
        ends: dict[tuple[int, int], list[int]] = {}
        for size, (hashes, items, places) in self.classes.items():
            k = gram_size(size)
            grams = gram_hashes(words, k, known)
            at = winnowed(grams, size - k + 1)
            low, high = (np.searchsorted(hashes, grams[at], side) for side in ("left", "right"))
            hit = low < high
            for place, i, j in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                for x in range(i, j):
                    ends.setdefault((items[x], place - places[x]), [place, place])[1] = place
        out: dict[int, list[tuple[int, int]]] = {}
        for (item, shift), (first, last) in ends.items():
            own = self.words[item]
            found = runs_on_diagonal(words, own, shift, min(first, last), max(first, last), min(len(own), WINDOW))
            if found:
                out.setdefault(item, []).extend(found)
        return list(out.items())


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, items, runs = [], [], []
        for row in batch.to_pylist():
            words, item = plain_words(row["text"].encode()), plain_words(row["item_text"].encode())
            window = min(len(item), WINDOW)
            found = [
                run for d in row["diagonals"] for run in runs_on_diagonal(words, item, d["shift"], d["first"], d["last"], window)
            ]
            if found:
                keys.append(row["key"])
                items.append(row["item_key"])
                runs.append([{"start": a, "end": b} for a, b in found])
        run = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(items, pa.binary()), pa.array(runs, pa.list_(run))],
            ["key", "item_key", "runs"],
        )


def small_items(benchmark: DataFrame, most: int) -> Items | None:
    """The benchmark if it has at most ``most`` bytes of texts and ids; None if it is larger."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string"), "text")
    size = rows.agg(F.coalesce(F.sum(F.expr("octet_length(text) + coalesce(octet_length(item_id), 0) + 16L")), F.lit(0))).first()[0]
    return Items([tuple(r) for r in rows.distinct().collect()]) if size <= most else None


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def found_in(text: Column, items: Items, spark: SparkSession) -> Column:
    """Struct (n_words, n_hit, items): words of a text, those under benchmark windows, ids of the items."""
    sent = spark.sparkContext.broadcast(items)

    @F.arrow_udf(returnType=FOUND)
    def found(texts: pa.Array) -> pa.Array:
        items, known, n_words, n_hit, ids = sent.value, {}, [], [], []
        for text in texts.cast(pa.binary()):
            words = plain_words(text.as_py())
            if len(known) > 500_000:
                known.clear()
            runs = items.runs(words, known)
            n_words.append(len(words))
            n_hit.append(covered([run for _, own in runs for run in own]))
            ids.append(sorted({x for item, _ in runs for x in items.ids[item]}))
        columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(columns, FOUND.names)

    return found(text)


def _keyed(table: DataFrame, *columns: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return table.select(*columns, F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, item_key, runs): every shared run of at least a window between a text and an item.

    ``key`` is the MD5 of the text as bytes.
    """
    items = _keyed(benchmark).dropDuplicates(["key"])
    size = F.least(F.expr(f"regexp_count(text, '{WORD}')"), F.lit(WINDOW))
    # At most WINDOW distinct lengths.
    classes = sorted(r[0] for r in items.select(size.alias("n")).where("n > 0").distinct().collect())
    texts = _keyed(docs)
    item_prints = fingerprints(items, None).select(
        F.col("key").alias("item_key"), "size", "hash", F.col("at").alias("item_at")
    )
    hits = (
        fingerprints(texts, classes)
        .join(item_prints, ["size", "hash"])
        .groupBy("key", "item_key", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .groupBy("key", "item_key")
        .agg(F.collect_list(F.struct("shift", "first", "last")).alias("diagonals"))
    )
    item_texts = items.select(F.col("key").alias("item_key"), F.col("text").alias("item_text"))
    # Hits are few next to texts; written once, as the texts and the pairs both need them.
    hits = checkpointed(hits)
    hit_texts = texts.join(hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    pairs = hits.join(item_texts, "item_key").join(hit_texts, "key")
    return pairs.select("key", "item_key", "text", "item_text", "diagonals").mapInArrow(
        _extended, "key binary, item_key binary, runs array<struct<start: int, end: int>>"
    )


@F.arrow_udf(returnType=T.LongType())
def covered_words(runs: pa.Array) -> pa.Array:
    """Words under a union of runs."""
    return pa.array([covered([(r["start"], r["end"]) for r in each]) for each in runs.to_pylist()], pa.int64())


def hit_words(runs: DataFrame) -> DataFrame:
    """(key, n_hit): words of each text under benchmark windows."""
    return runs.groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs")).select(
        "key", covered_words("runs").alias("n_hit")
    )


def _contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (HIT_SHARE * n_hit >= n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    items = small_items(benchmark, item_bytes)
    if items is not None:
        found = found_in(docs["text"], items, docs.sparkSession)
        return docs.where(~_contaminated(found["n_hit"], found["n_words"]))
    hits = hit_words(contamination(docs, benchmark))
    # Columns travel as one, so that none can clash.
    text = F.coalesce("row.text", F.lit(""))
    keyed = as_row(docs).select("row", F.unhex(F.md5(text.cast("binary"))).alias("key"))
    # Few texts are hit, so what is joined by text is the list of contaminated ones.
    hits = checkpointed(hits)
    n_words = F.expr(f"regexp_count(row.text, '{WORD}')")
    bad = keyed.join(hits, "key").where(_contaminated(F.col("n_hit"), n_words)).select("key").distinct()
    return keyed.join(bad, "key", "left_anti").select("row.*")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", item_bytes: int = ITEM_BYTES
) -> DataFrame:
    """Id, words, words under benchmark windows, items found and the verdict, for every row."""
    items = small_items(benchmark, item_bytes)
    if items is not None:
        rows = docs.select(id_column, found_in(docs["text"], items, docs.sparkSession).alias("found"))
        joined = rows.select(id_column, "found.*")
    else:
        joined = _joined(docs, benchmark, id_column)
    return joined.select(
        id_column,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        _contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def _joined(docs: DataFrame, benchmark: DataFrame, id_column: str) -> DataFrame:
    """(id, n_words, n_hit, items) by shuffles."""
    # One row for each text and item, read twice.
    runs = checkpointed(contamination(docs, benchmark))
    ids = _keyed(benchmark, "item_id").select(F.col("key").alias("item_key"), F.col("item_id").cast("string"))
    named = runs.join(ids.distinct(), "item_key").groupBy("key").agg(F.collect_set("item_id").alias("items"))
    rows = _keyed(docs, id_column).select(
        id_column, "key", F.expr(f"cast(regexp_count(text, '{WORD}') as bigint)").alias("n_words")
    )
    joined = rows.join(hit_words(runs).join(named, "key", "left"), "key", "left")
    return joined.select(
        id_column,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.array_sort("items"), F.array().cast("array<string>")).alias("items"),
    )
