"""License scans: exact phrases, and short notices found with a bounded number of edits.

A notice with at most ``k`` edits, cut into ``k + 1`` pieces, keeps at least one piece
whole (pigeonhole). Pieces are found as exact strings; around each find the
``regex`` library matches the whole notice with bounded errors and reports the
span and its edits. Texts are compared as lower-cased words with single spaces.

Null and empty texts have no word and no label. Overlapping places of a phrase all
count. Every input row gives one row; other columns are not used.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestmarts.llm.text import plain_words, with_struct

# Phrases of the scan's contract and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Openings of common notices, as words.
NOTICES = {
    "licensed under the apache license version 2 0": "notice-apache-2.0",
    "licensed under the gnu general public license version 3": "notice-gpl-3.0",
    "this program is free software you can redistribute it": "notice-gpl",
    "permission is hereby granted free of charge to any person": "notice-mit",
    "redistribution and use in source and binary forms": "notice-bsd",
    "released under the mit license": "notice-mit",
    "licensed under cc by 4 0": "notice-cc-by-4.0",
    "this work is licensed under a creative commons attribution": "notice-cc-by",
    "this source code form is subject to the terms of the mozilla public license": "notice-mpl",
}
#: One edit is allowed for so many characters of a notice.
CHARACTERS_PER_EDIT = 10

SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("edits", T.IntegerType()),
        T.StructField("matched", T.StringType()),
    ]
)
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("notices", T.ArrayType(SPAN)),
    ]
)


@dataclass(frozen=True)
class Notice:
    label: str
    words: bytes
    edits: int
    seeds: tuple[tuple[bytes, int], ...]
    fuzzy: regex.Pattern


def notice(text: str, label: str) -> Notice:
    """A notice cut into one more piece than it may have edits."""
    words = text.encode()
    edits = max(1, len(words) // CHARACTERS_PER_EDIT)
    cuts = [len(words) * i // (edits + 1) for i in range(edits + 2)]
    seeds = tuple((words[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False))
    # Best match first, so that the reported span has the fewest edits.
    return Notice(label, words, edits, seeds, regex.compile(b"(?b)(?:%s){e<=%d}" % (regex.escape(words), edits)))


@lru_cache(maxsize=4)
def notices(table: tuple[tuple[str, str], ...]) -> list[Notice]:
    return [notice(text, label) for text, label in table]


def places(line: bytes, part: bytes):
    at = line.find(part)
    while at >= 0:
        yield at
        at = line.find(part, at + 1)


def word_numbers(line: bytes, starts: list[int]) -> list[int]:
    """Number of the word that holds or follows each position, for ascending positions."""
    out, seen, at = [], 0, 0
    for start in starts:
        seen += line.count(b" ", at, start)
        at = start
        out.append(seen)
    return out


def fuzzy_spans(line: bytes, own: Notice) -> list[tuple[int, int, int]]:
    """(start, end, edits) of the notice in the line: the best match of what is free, until none is left.

    Every match stands in the surroundings of one of its seeds, so each search is as short
    as the notice. Surroundings that a better match has taken in part are searched again
    in what is left of them, before it and after it.
    """
    least, reach = len(own.words) - own.edits, len(own.words) + own.edits
    waiting: list[tuple[int, int, int, int, int]] = []
    taken: list[tuple[int, int, int]] = []

    def search(low: int, high: int) -> None:
        match = own.fuzzy.search(line, low, high) if high - low >= least else None
        if match and match.end() > match.start():
            heappush(waiting, (sum(match.fuzzy_counts), match.start(), match.end(), low, high))

    for start in sorted({at - offset for seed, offset in own.seeds for at in places(line, seed)}):
        search(max(0, start - own.edits), min(len(line), start + reach))
    while waiting:
        edits, start, end, low, high = heappop(waiting)
        i = bisect_right(taken, (start, end, own.edits))
        if not (i and taken[i - 1][1] > start or i < len(taken) and taken[i][0] < end):
            insort(taken, (start, end, edits))
        i = bisect_right(taken, (low,))
        i -= bool(i and taken[i - 1][1] > low)
        while i < len(taken) and taken[i][0] < high:
            search(low, taken[i][0])
            low = taken[i][1]
            i += 1
        search(low, high)
    return taken


def scan(text: bytes | None, table: list[Notice]) -> tuple:
    """The result fields for one text."""
    words = plain_words(text)
    line = b" %s " % b" ".join(words)
    base, starts = set(), []
    for phrase, label in BASE_PHRASES.items():
        if at := list(places(line, b" %s " % phrase.encode())):
            base.add(label)
            starts += at
    numbers = word_numbers(line, sorted(starts))
    labels, score, spans = set(base), float(bool(base)), []
    for own in table:
        for start, end, edits in fuzzy_spans(line, own):
            part = line[start:end]
            begin = start + len(part) - len(part.lstrip())
            first, last = word_numbers(line, [begin, max(begin, start + len(part.rstrip()) - 1)])
            labels.add(own.label)
            score = max(score, 1 - edits / len(own.words))
            spans.append(
                {
                    "label": own.label,
                    "first_word": max(0, first - 1),
                    "last_word": max(0, last - 1),
                    "edits": edits,
                    "matched": part.strip().decode("utf-8", "replace"),
                }
            )
    spans.sort(key=lambda s: (s["first_word"], s["label"], s["last_word"]))
    return (
        len(words),
        len(numbers),
        min(numbers, default=None),
        max(numbers, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        score,
        spans,
    )


def scan_licenses(docs: DataFrame, table: dict[str, str] | None = None, id_column: str = "doc_id") -> DataFrame:
    """Id, exact phrase counts, labels, score and the notice spans with their edits, for every row."""
    rows = tuple((NOTICES if table is None else table).items())
    schema = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_base", pa.int64()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("base_labels", pa.string()),
            ("labels", pa.string()),
            ("score", pa.float64()),
            (
                "notices",
                pa.list_(
                    pa.struct(
                        [
                            ("label", pa.string()),
                            ("first_word", pa.int64()),
                            ("last_word", pa.int64()),
                            ("edits", pa.int32()),
                            ("matched", pa.string()),
                        ]
                    )
                ),
            ),
        ]
    )

    @F.arrow_udf(returnType=RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        own = notices(rows)
        results = [scan(t.as_py(), own) for t in texts.cast(pa.binary())]
        return pa.array([dict(zip(RESULT.names, r, strict=True)) for r in results], schema)

    return with_struct(docs, id_column, scanned("text"), RESULT)
