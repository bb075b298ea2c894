"""SimHash near-duplicates by anchor-point covering.

A link is at most 4 differing bits of 64. One of the two 32-bit halves then differs in
at most 2 bits, and so do its first 31 bits. On 31 bits the code words of the Hamming
(31, 26) code are the anchors: a perfect code, so its covering radius is 1. Two words
at most 2 bits apart have a word between them, at most one bit from each, and an
anchor within one bit of that: both lie within radius 2 (covering radius plus half
the threshold, as both sides are replicated) of one anchor. Each distinct fingerprint
goes to its 1 or 16 anchors of each half, and fingerprints are compared per anchor.

* An anchor's group is compared whole up to ``BLOCK`` fingerprints. Larger ones are cut
  into blocks by hash, and each pair of blocks is compared in a group of its own, so no
  task holds an unbounded group and no link is lost.
* A group gives a spanning forest of its links, never all pairs.
* Components come from iterative joins (``components``).

Null and empty texts have fingerprint zero, which is linked like any other. A
component's id is its smallest document id; null ids are passed over. Repeated rows
each get their row. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestmarts.llm.components import components
from requestmarts.llm.text import LOWER_ASCII, as_row
from requestmarts.sources.checkpoints import checkpointed

SHINGLE = 4
SEED = 42
THRESHOLD = 4
HALF_BITS = 31
BLOCK = 4096
POSITIONS = np.arange(1, HALF_BITS + 1, dtype=np.int64)


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every 4-word shingle; of the whole sequence if it is shorter."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: -SHINGLE]]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=True)], np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Bit i is set if it is set in over half the shingle hashes."""
    hashes = shingle_hashes(text or b"")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16_384):
        part = hashes[at : at + 16_384].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.arrow_udf(returnType=T.LongType())
def fingerprints_of(texts: pa.Array) -> pa.Array:
    own = np.array([fingerprint(t.as_py()) for t in texts.cast(pa.binary())], np.uint64)
    return pa.array(own.view(np.int64))


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, code word) for every code word within 2 bits of each 31-bit word."""
    syndrome = np.zeros(len(words), np.int64)
    for p in POSITIONS:
        syndrome ^= np.where((words >> (p - 1)) & 1, p, 0)
    flip = np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
    index, found = [np.arange(len(words))], [words ^ flip]
    for p in POSITIONS:
        # Flipping p and its partner also leads to a code word.
        partner = syndrome ^ p
        at = np.flatnonzero((syndrome > 0) & (partner > p))
        index.append(at)
        found.append(words[at] ^ (np.int64(1) << (p - 1)) ^ (np.int64(1) << (partner[at] - 1)))
    return np.concatenate(index), np.concatenate(found)


def _replicated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for half in (0, 1):
            index, found = anchors((prints >> (32 * half)) & ((1 << HALF_BITS) - 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found | (half << HALF_BITS)), pa.array(prints[index])], ["anchor", "fp"]
            )


def forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Tree edges of the components of distinct fingerprints under the threshold."""
    left, edges = prints, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            own = queue.pop()
            near = np.bitwise_count(left ^ own) <= THRESHOLD
            if near.any():
                reached = left[near]
                edges += [(int(own), int(x)) for x in reached]
                queue.extend(reached)
                left = left[~near]
    return edges


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with equal (anchor, low, high); rows come in that order."""

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
        # Groups of two are compared all at once.
        two = starts[ends - starts == 2]
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= THRESHOLD]
        a, b = [prints[near].view(np.int64)], [prints[near + 1].view(np.int64)]
        for start, end in zip(starts, ends, strict=True):
            if end - start > 2 and (edges := forest(prints[start:end])):
                pairs = np.array(edges, np.uint64).view(np.int64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    held_keys, held = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        keys = np.concatenate((held_keys, keys))
        prints = np.concatenate((held, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
        if not len(keys):
            continue
        # The last group may go on in the next batch; it has at most two blocks.
        cut = int((keys == keys[-1]).all(axis=1).argmax())
        if cut:
            yield links(keys[:cut], prints[:cut])
        held_keys, held = keys[cut:], prints[cut:]
    if len(held):
        yield links(held_keys, held)


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning set of the links among distinct fingerprints (one column ``fp``)."""
    replicas = prints.mapInArrow(_replicated, "anchor long, fp long")
    sizes = replicas.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    rows = replicas.join(sizes, "anchor").select(
        "anchor", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own")
    )
    # A block meets every other block; a single block meets itself.
    other = F.expr("case when blocks = 1 then array(0) else filter(sequence(0, blocks - 1), x -> x <> own) end")
    tasks = rows.withColumn("other", F.explode(other)).select(
        "anchor", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"
    )
    grouped = tasks.repartition("anchor", "low", "high").sortWithinPartitions("anchor", "low", "high")
    return grouped.mapInArrow(_compared, "a long, b long").distinct()


def grouped_fingerprints(rows: DataFrame, id_column: str) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of rows (id, fp)."""
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(id_column).alias("first_id")))
    roots = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Id, fingerprint in hex and component for every row."""
    rows = checkpointed(docs.select(id_column, fingerprints_of("text").alias("fp")))
    found = rows.join(grouped_fingerprints(rows, id_column), "fp")
    return found.select(id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents, all columns, whose id is their component's; of repeated rows one."""
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    rows = checkpointed(docs.select(F.col(id_column).alias("_id"), digest.alias("_text"), fingerprints_of("text").alias("fp")))
    found = rows.join(grouped_fingerprints(rows, "_id"), "fp").where(F.col("_id").eqNullSafe(F.col("component_id")))
    # Of rows that share the component's id, the one with the smallest digest; null ids as well.
    least = F.min(F.struct("_text", "_id"))
    kept = found.groupBy("root").agg(least.alias("k"), F.count(F.lit(1)).alias("_n")).select("root", "k.*", "_n")
    # Columns travel as one, so that none can clash.
    own = F.md5(F.coalesce("row.text", F.lit("")).cast("binary"))
    same = F.col("row")[id_column].eqNullSafe(F.col("_id")) & (own == F.col("_text"))
    chosen = as_row(docs).join(kept, same).select("row", "root", "_n")
    # Only ids that occur more than once can leave repeated rows.
    once = chosen.where("_n = 1").select("row.*")
    return once.unionByName(chosen.where("_n > 1").dropDuplicates(["root"]).select("row.*"))
