"""How the vocabulary of each source differs from other sources of its language.

Each language keeps the terms that enough of its documents hold. The kept (language,
term) keys are sorted and numbered; minimal acyclic transducers built from them give a
term's number, so the second reading of the texts counts numbers, not strings. As
numbers ascend like terms, they also break ties.

* **Size.** The sorted keys are cut into slices of ``SLICE_BYTES``, a transducer each, built
  by one task from its slice alone. Texts are streamed through as many slices at once as
  fit in ``PASS_BYTES``, measured; a larger vocabulary takes further readings. What is
  broadcast never exceeds that.
* **Pairs.** The terms of a language come in blocks of ``BLOCK`` numbers and its sources in
  tiles of ``TILE``; a task compares two tiles over one block, so its matrix has a fixed
  size. The result itself holds every two sources of a language.
* Arithmetic is exact: decimals for the shares, whole numbers below 2^63 elsewhere.
* Null texts, languages and sources are ''. A group without terms has rows for the other
  sources, of value 0 if its language keeps no term. An empty table gives no row.
* Repeated rows are separate documents. Document ids and extra columns are not used.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from requestmarts.llm import transducer
from requestmarts.sources.checkpoints import checkpointed

#: Documents of its language that must hold a term.
LEAST_DOCUMENTS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000

#: Terms are runs of letters and of everything beyond ASCII; only A-Z change case.
_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalpha())
TO_TERMS = bytes.maketrans(
    _SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz"
)
#: Between language and term in a key: no byte of UTF-8.
MARK = b"\xff"

SLICE_BYTES = 4 << 20
PASS_BYTES = 192 << 20
BLOCK = 1024
TILE = 128
#: Entries of a task's tables before they are handed on, and bytes of text read side by side.
FLUSH = 400_000
CHUNK = 1 << 20


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of the task that hold the term."""
    counts: dict[str, Counter] = defaultdict(Counter)

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            columns = [
                pa.array([lang] * len(found), pa.string()),
                pa.array(found.keys(), pa.binary()),
                pa.array(found.values(), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            own = counts[lang]
            own.update(set(text.as_py().translate(TO_TERMS).split()))
            if len(own) > FLUSH:
                yield from flushed()
    yield from flushed()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task, and the rows and key bytes before each row in it, to sorted (lang, term, key)."""
    task, rows, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        lengths = np.array([len(k.as_py()) for k in batch.column(2)], np.int64)
        before = size + np.concatenate([[0], np.cumsum(lengths)])
        columns = [
            *batch.columns[:2],
            pa.array(np.full(n, task, np.int32)),
            pa.array(np.arange(rows, rows + n)),
            pa.array(before[:-1]),
            pa.array(lengths),
        ]
        rows, size = rows + n, int(before[-1])
        yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "task", "at", "size_before", "size"])


def vocabulary(docs: DataFrame, least: int = LEAST_DOCUMENTS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(lang, term, number, slice): the kept terms of all languages in the order of their keys."""
    kept = (
        _rows(docs, "lang", "text")
        .mapInArrow(_document_counts, "lang string, term binary, n long")
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least)
        .select("lang", "term", F.concat(F.col("lang").cast("binary"), F.lit(MARK), "term").alias("key"))
    )
    ordered = kept.repartitionByRange("key").sortWithinPartitions("key")
    placed = checkpointed(
        ordered.mapInArrow(_numbered, "lang string, term binary, task int, at long, size_before long, size long")
    )
    # A row for each task of the sort.
    tasks = placed.groupBy("task").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).collect()
    offsets, rows, size = [], 0, 0
    for t in sorted(tasks):
        offsets.append((t["task"], rows, size))
        rows, size = rows + t["rows"], size + t["bytes"]
    before = docs.sparkSession.createDataFrame(offsets, "task int, rows_before long, bytes_before long")
    return placed.join(F.broadcast(before), "task").select(
        "lang",
        "term",
        (F.col("rows_before") + F.col("at")).alias("number"),
        F.expr(f"(bytes_before + size_before) div {slice_bytes}").alias("slice"),
    )


def _built(rows: pa.Table) -> pa.Table:
    """The transducer of one slice."""
    ordered = rows.sort_by("number")
    langs, terms = ordered.column("lang").to_pylist(), ordered.column("term").to_pylist()
    keys = (lang.encode() + MARK + term for lang, term in zip(langs, terms, strict=True))
    data = transducer.packed(transducer.build(keys, ordered.column("number")[0].as_py()))
    return pa.table({"slice": ordered.column("slice")[:1], "size": pa.array([len(data)]), "data": pa.array([data], pa.binary())})


def transducers(terms: DataFrame) -> DataFrame:
    """(slice, size, data): a packed transducer for each slice of a vocabulary."""
    return terms.groupBy("slice").applyInArrow(_built, "slice long, size long, data binary")


def pieces(texts: list[bytes], size: int = CHUNK) -> Iterator[bytes]:
    """Terms of texts, lower-cased and set apart by blanks, in pieces of about ``size`` bytes."""
    waiting, length = [], 0
    for text in texts:
        text = text.translate(TO_TERMS)
        at = 0
        while len(text) - at > size:
            cut = text.find(b" ", at + size)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        waiting.append(text[at:])
        length += len(waiting[-1])
        if length >= size:
            yield b" ".join(waiting)
            waiting, length = [], 0
    if waiting:
        yield b" ".join(waiting)


def stretches(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a blank."""
    inside = np.concatenate([[False], data != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _counted(batches: Iterator[pa.RecordBatch], packed: Broadcast) -> Iterator[pa.RecordBatch]:
    """(lang, source, number, n): texts streamed through the transducers of one pass."""
    machines = [transducer.unpacked(data) for data in packed.value]
    found: dict[tuple[str, str], list[np.ndarray]] = defaultdict(list)
    waiting = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), parts in found.items():
            numbers, n = np.unique(np.concatenate(parts), return_counts=True)
            columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers), pa.array(n)], ["lang", "source", "number", "n"])
        found.clear()

    for batch in batches:
        groups: dict[tuple[str, str], list[bytes]] = defaultdict(list)
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
            groups[lang, source].append(text.as_py())
        for (lang, source), texts in groups.items():
            begins = [(m, m.start(lang.encode() + MARK)) for m in machines]
            begins = [(m, b) for m, b in begins if b]
            for piece in pieces(texts) if begins else ():
                data = np.frombuffer(piece, np.uint8)
                starts, ends = stretches(data)
                for machine, begin in begins:
                    numbers = machine.numbers(data, starts, ends, begin)
                    if len(numbers):
                        found[lang, source].append(numbers)
                        waiting += len(numbers)
                if waiting > 8 * FLUSH:
                    yield from flushed()
                    waiting = 0
    yield from flushed()


def recounted(docs: DataFrame, terms: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(lang, source, number, n): occurrences of kept terms in each group, those above 0."""
    spark = docs.sparkSession
    machines = checkpointed(transducers(terms))
    passes: list[list[int]] = []
    room = 0
    for s in machines.select("slice", "size").orderBy("slice").collect():  # one row for SLICE_BYTES of vocabulary
        if s["size"] > room:
            passes.append([])
            room = max(pass_bytes, s["size"])
        passes[-1].append(s["slice"])
        room -= s["size"]
    schema = "lang string, source string, number long, n long"
    counts = spark.createDataFrame([], schema)
    for slices in passes:
        data = [r["data"] for r in machines.where(F.col("slice").between(slices[0], slices[-1])).orderBy("slice").collect()]
        read = _rows(docs, "lang", "source", "text").mapInArrow(
            partial(_counted, packed=spark.sparkContext.broadcast([bytes(d) for d in data])), schema
        )
        counts = counts.unionByName(read)
    return counts.groupBy("lang", "source", "number").agg(F.sum("n").alias("n"))


def _share(count: str, total: str, kinds: str) -> str:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kinds)), exactly."""
    return (
        f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0)))"
        f" div cast({total} + 2 * {kinds} as decimal(20, 0))"
    )


def _pair_sums(rows: pa.Table) -> pa.Table:
    """Sums over one block of terms for the pairs of two tiles of sources.

    A row is a source: its share of every uncounted term, and the places and shares of
    counted ones. Tiles ``low`` and ``high`` may be one.
    """
    rows = rows.sort_by("source")  # so that every block has a pair the same way round
    first = {c: rows.column(c)[0].as_py() for c in ("lang", "low", "high", "width")}
    names, tiles = rows.column("source").to_pylist(), rows.column("tile").to_pylist()
    shares = np.empty((len(names), first["width"]), np.int64)
    for i in range(len(names)):
        shares[i] = rows.column("uncounted")[i].as_py()
        places = rows.column("places")[i]
        if places.is_valid:
            shares[i, places.values.to_numpy()] = rows.column("shares")[i].values.to_numpy()
    low = [i for i, t in enumerate(tiles) if t == first["low"]]
    high = [i for i, t in enumerate(tiles) if t == first["high"]]
    a, b, total = [], [], []
    for k, i in enumerate(low):
        others = high[k + 1 :] if first["low"] == first["high"] else high
        if others:
            apart, both = shares[others] - shares[i], shares[others] + shares[i]
            total.append((apart * apart // both).sum(axis=1))
            a += [names[i]] * len(others)
            b += [names[j] for j in others]
    sums = np.concatenate(total) if total else np.empty(0, np.int64)
    langs = pa.array([first["lang"]] * len(a), pa.string())
    return pa.table({"lang": langs, "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(sums)})


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank; see the module."""
    terms = checkpointed(vocabulary(docs, least))
    counts = checkpointed(recounted(docs, terms))
    kinds = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.min("number").alias("first"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    tile = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = checkpointed(
        _rows(docs, "lang", "source")
        .distinct()
        .join(totals, ["lang", "source"], "left")
        .join(kinds, "lang", "left")
        .na.fill(0, ["total", "kinds", "first"])
        .withColumn("tile", F.floor(tile / TILE).cast("int"))
        .withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
    )

    # Shares of counted terms; what a language counts is the sum over its sources.
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    of_lang = (
        counts.groupBy("lang", "number")
        .agg(F.sum("n").alias("n"))
        .join(langs, "lang")
        .join(kinds, "lang")
        .select("number", F.expr(_share("n", "lang_total", "kinds")).alias("q"))
    )
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "number", F.expr(_share("n", "total", "kinds")).alias("p"), (F.col("number") - F.col("first")).alias("place")
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "number")
    typical = (
        shares.join(of_lang, "number")
        .where("p > q")
        .select("lang", "source", "number", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
    )
    words = terms.select("number", F.col("term").cast("string").alias("item"))
    of_terms = typical.join(words, "number").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    in_blocks = (
        shares.withColumn("block", F.expr(f"place div {BLOCK}"))
        .groupBy("lang", "source", "block")
        .agg(F.sort_array(F.collect_list(F.expr(f"struct(cast(place % {BLOCK} as int) as place, p)"))).alias("counted"))
    )
    blocks = F.expr(f"explode(sequence(0L, greatest(kinds - 1, 0L) div {BLOCK}))")
    cells = (
        groups.withColumn("block", blocks)
        .join(in_blocks, ["lang", "source", "block"], "left")
        .withColumn("other", F.expr("explode(sequence(0, tiles - 1))"))
        .select(
            "lang", "source", "block", "tile",
            F.least("tile", "other").alias("low"),
            F.greatest("tile", "other").alias("high"),
            F.expr(f"cast(least(kinds - block * {BLOCK}, {BLOCK}) as int)").alias("width"),
            F.expr(f"if(kinds = 0, 1L, {_share('0', 'total', 'greatest(kinds, 1)')})").alias("uncounted"),
            F.expr("counted.place").alias("places"),
            F.expr("counted.p").alias("shares"),
        )
    )
    sums = (
        cells.groupBy("lang", "block", "low", "high")
        .applyInArrow(_pair_sums, "lang string, a string, b string, value long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("value"))
    )
    furthest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    of_pairs = sums.select(
        "lang", F.expr("inline(array(struct(a as source, b as item), struct(b as source, a as item)))"), "value"
    ).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(furthest).alias("rank"))
    return of_pairs.unionByName(of_terms)
