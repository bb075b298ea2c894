"""Ranges of a sorted list: split keys from a sample, and the range each row is in.

A key is (value, id) with NULLs last in either direction. A row's range is the number of
splits it has reached, found by halving in built-in functions. Over many rows the halvings
are projections one after another (``placed``), which Spark compiles; the loop in one
expression (``Splits.place``) is interpreted for each row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Splits of a list. With a sample of this many rows for each, the largest of the ranges
#: between them seldom holds twice its share.
SPLITS = 1023
SAMPLED_PER_SPLIT = 8
ID = "id_chamado"


@dataclass(frozen=True)
class Splits:
    """Keys (value as text, id) that cut a list ordered by ``column``, in list order."""

    column: str
    kind: str
    descending: bool
    keys: tuple[tuple[str | None, str | None], ...]

    def place(self) -> Column:
        """Number of splits a row has reached. Keys are structs that compare like their place
        in the list; halving takes one comparison for each bit of their number."""
        flag = F.isnotnull if self.descending else F.isnull
        none = (lambda x: x is not None) if self.descending else (lambda x: x is None)
        plain = (lambda x: x and x == "true") if self.kind == "boolean" else (lambda x: x)
        value, row_id = F.col(self.column), F.col(ID)
        own = F.struct(flag(value).alias("n"), value.alias("v"), flag(row_id).alias("m"), row_id.alias("i"))
        data = [{"n": none(v), "v": plain(v), "m": none(i), "i": i} for v, i in self.keys]
        keys = F.from_json(F.lit(json.dumps(data)), f"array<struct<n: boolean, v: {self.kind}, m: boolean, i: string>>")

        def halved(place: Column, half: Column) -> Column:
            split = F.get(keys, place + half - 1)
            reached = own <= split if self.descending else own >= split
            return F.when((place + half <= len(self.keys)) & reached, place + half).otherwise(place)

        halves = [1 << bit for bit in reversed(range(len(self.keys).bit_length()))]
        return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), halved) if halves else F.lit(0)

    def reached(self, split_value: Column, split_id: Column) -> Column:
        """Whether a row stands at or after a split."""
        value, row_id = F.col(self.column), F.col(ID)
        further = (lambda a, b: a < b) if self.descending else (lambda a, b: a > b)
        id_reached = (
            F.when(split_id.isNull(), row_id.isNull())
            .when(row_id.isNull(), True)
            .otherwise(~further(split_id, row_id))
        )
        return (
            F.when(split_value.isNull(), value.isNull() & id_reached)
            .when(value.isNull(), True)
            .when(further(value, split_value), True)
            .when(value == split_value, id_reached)
            .otherwise(False)
        )

    def _value(self, text: str | None) -> Column:
        return F.lit(text).cast(self.kind)

    def _from(self, key: tuple[str | None, str | None]) -> Column:
        return self.reached(self._value(key[0]), F.lit(key[1]).cast("string"))

    def between(self, first: int, last: int) -> Column:
        """Rows of the ranges from ``first`` to ``last``. The bounds of the value alone are
        stated as well: they reach the files."""
        parts, value = [], F.col(self.column)
        start = self.keys[first - 1] if first > 0 else None
        end = self.keys[last] if last < len(self.keys) else None
        if start is not None:
            parts.append(self._from(start))
        if end is not None:
            parts.append(~self._from(end))
            # Before a split with a value there is no NULL, so plain bounds lose no row.
            if end[0] is not None:
                upper = self._value(end[0])
                parts.append(value >= upper if self.descending else value <= upper)
                if start is not None:
                    lower = self._value(start[0])
                    parts.append(value <= lower if self.descending else value >= lower)
        return reduce(and_, parts, F.lit(True))


def placed(rows: DataFrame, splits: Sequence[Splits], *kept: str) -> DataFrame:
    """(kept columns, of, place): each row once for each of the splits, ``of`` being their number
    from 0, with its range among them.

    The same ranges as ``Splits.place``. All splits run in one direction. Their keys have one
    shape, with a field for each kind of value, and come to the tasks as one broadcast row: as
    literals they would be planned again in every halving.
    """
    if len({s.descending for s in splits}) != 1:
        raise ValueError("splits of one direction are needed")
    kinds = list(dict.fromkeys(s.kind for s in splits))
    named = {kind: f"v{i}" for i, kind in enumerate(kinds)}
    descending = splits[0].descending
    flag = F.isnotnull if descending else F.isnull
    none = (lambda x: x is not None) if descending else (lambda x: x is None)

    def own(s: Splits) -> Column:
        value, row_id = F.col(s.column), F.col(ID)
        fields = ((value if kind == s.kind else F.lit(None).cast(kind)).alias(name) for kind, name in named.items())
        return F.struct(flag(value).alias("n"), *fields, flag(row_id).alias("m"), row_id.alias("i"))

    def key(s: Splits, v: str | None, i: str | None) -> dict:
        return {"n": none(v), named[s.kind]: v == "true" if v and s.kind == "boolean" else v, "m": none(i), "i": i}

    shape = ", ".join(["n: boolean", *(f"{name}: {kind}" for kind, name in named.items()), "m: boolean", "i: string"])
    data = json.dumps([[key(s, *k) for k in s.keys] for s in splits])
    keys = rows.sparkSession.createDataFrame([(data,)], "keys string")
    keys = keys.select(F.from_json("keys", f"array<array<struct<{shape}>>>").alias("_keys"))
    each = F.posexplode(F.array(*map(own, splits))).alias("of", "_own")
    out = rows.select(*kept, each).crossJoin(F.broadcast(keys)).withColumn("place", F.lit(0))
    for half in (1 << bit for bit in reversed(range(max(len(s.keys) for s in splits).bit_length()))):
        # Past the last key there is none, and nothing is reached.
        split = F.get(F.get("_keys", F.col("of")), F.col("place") + (half - 1))
        reached = F.col("_own") <= split if descending else F.col("_own") >= split
        out = out.withColumn("place", F.when(reached, F.col("place") + half).otherwise(F.col("place")))
    return out.select(*kept, "of", "place")


def sample(rows: DataFrame, columns: Sequence[str], most: int) -> tuple[list[dict], int]:
    """(sampled rows, number of all rows) in one scan: the rows of least hash, ``most`` of them.

    Values come as text as well, to be sorted here and compared there. A row's hash is taken
    once, not again in each comparison, and only what was picked is turned into text.
    """
    seen = Observation()
    others = [c for c in columns if c != ID]
    hashed = rows.observe(seen, F.count(F.lit(1)).alias("n")).select(ID, *others, F.xxhash64(ID, *others).alias("_hash"))
    picked = hashed.orderBy("_hash").limit(most)
    found = picked.select(
        ID, *others, F.col(ID).alias(_text(ID)), *(F.col(c).cast("string").alias(_text(c)) for c in others)
    ).collect()
    return [r.asDict() for r in found], seen.get["n"]


def _text(column: str) -> str:
    return f"_text_{column}"


def splits_of(sampled: list[dict], column: str, kind: str, descending: bool, most: int = SPLITS, apart: bool = False) -> Splits:
    """Even splits of a sample. ``apart`` keeps NULLs out of ranges with values."""
    keyed = [(r[column], r[_text(column)], r[ID]) for r in sampled]
    # Two stable sorts: the id within equal values, then the value; NULLs last in both.
    keyed.sort(key=lambda k: (k[2] is not None, k[2] or "") if descending else (k[2] is None, k[2] or ""), reverse=descending)
    none = [k for k in keyed if k[0] is None]
    some = sorted((k for k in keyed if k[0] is not None), key=lambda k: k[0], reverse=descending)
    ordered = some + none
    keys = dict.fromkeys((text, row_id) for _, text, row_id in ordered[:: max(1, -(-len(ordered) // most))])
    listed = list(keys)
    if apart:
        at = next((i for i, k in enumerate(listed) if k[0] is None), len(listed))
        listed.insert(at, (None, ""))
    return Splits(column, kind, descending, tuple(listed))
