"""Token counts by heap-and-linked-list byte-pair merging.

Each word starts as its list of byte symbols. A heap holds the ranks of adjacent
pairs; the lowest is popped, its two symbols are joined in a linked list, and the
two new pairs are pushed. The count of a word is its initial symbols minus the
merges made; no token id is looked up or kept.

Null text counts as empty (0 tokens). A special string inside a text is one token,
as the tokenizer's library does by default. Rows, repeated ones too, each get one
row; other columns of the input are not used and not returned.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from requestmarts.llm.text import with_struct

CACHED_WORDS = 400_000
CACHED_LENGTH = 40

RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def merges_made(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many merges byte-pair encoding makes on these symbols."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    made = 0
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        # A pair that changed since it was pushed is stale; its newer form is in the heap as well.
        if symbols[i] == "" or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        made += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return made


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairCounter:
    """Counts the tokens of texts under one tokenizer file of words with an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ranks = {tuple(pair): i for i, pair in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"]
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))))
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = byte_symbols()
        self.known: dict[str, int] = {}

    def of_word(self, word: str) -> int:
        symbols = [self.symbols[b] for b in word.encode()]
        symbols[-1] += self.end
        n = len(symbols)
        return n - merges_made(symbols, self.ranks)

    def of_plain(self, text: str) -> int:
        if not text.isascii():
            # Lower-casing is by single character: a final sigma is treated as any other.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        total, known = 0, self.known
        for word, times in Counter(self.words.findall(text.lower())).items():
            n = known.get(word)
            if n is None:
                n = self.of_word(word)
                if len(word) <= CACHED_LENGTH:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[word] = n
            total += n * times
        return total

    def of_text(self, text: str) -> int:
        if "<|" not in text:
            return self.of_plain(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.of_plain, pieces))


@lru_cache(maxsize=4)
def counter(path: str) -> PairCounter:
    """One counter, with its cache of words, for a worker process."""
    return PairCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_column: str = "doc_id") -> DataFrame:
    """Id, UTF-8 bytes, tokens and whether the tokens exceed ``limit``, for every row.

    ``tokenizer`` is a path that every executor can open.
    """

    @F.arrow_udf(returnType=RESULT)
    def counted(texts: pa.Array) -> pa.Array:
        own = counter(tokenizer)
        sizes, tokens = [], []
        for text in texts:
            value = text.as_py() or ""
            sizes.append(len(value.encode()))
            tokens.append(own.of_text(value))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], RESULT.names)

    rows = with_struct(docs, id_column, counted("text"), RESULT)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
