from __future__ import annotations

import zlib
from collections import Counter

from pyspark.sql import functions as F

from requestmarts.llm import sharding
from requestmarts.llm.queries import op2_label_propagation
from tests.llm.helpers import awkward, documents, rows


def check_law(found, shards=16):
    sizes = Counter(r["shard"] for r in found)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(counts[s]))


def cut(found):
    """Linked neighbours lost: rows outside their group's largest shard."""
    groups = {}
    for r in found:
        groups.setdefault(r["group_md5"], Counter())[r["shard"]] += 1
    return sum(sum(c.values()) - max(c.values()) for c in groups.values())


def test_awkward_rows_keep_the_law(spark):
    given = awkward()
    found = rows(sharding.shard_documents(documents(spark, given)))
    check_law(found)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given), key=str
    )
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)}


def test_whole_table_moves_copies_together(spark, sf_dir):
    found = rows(op2_label_propagation(spark, sf_dir))
    check_law(found)
    assert len(found) == 1000
    before = rows(sharding.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), rounds=0))
    check_law(before)
    assert cut(found) == 0 < cut(before)


def test_a_group_larger_than_a_shard(spark):
    texts = ["same"] * 120 + [f"t{i}" for i in range(120)] + [f"p{i // 3}" for i in range(60)]
    found = rows(sharding.shard_documents(documents(spark, texts), shards=6))
    check_law(found, 6)
    assert cut([r for r in found if r["doc_id"] >= 240]) <= 6
    assert max(Counter(r["shard"] for r in found if r["doc_id"] < 120).values()) >= 45


def test_quotas_never_change_counts():
    wanted = {(0, 1): 5, (1, 0): 2, (0, 2): 4, (2, 1): 1}
    admitted, back = sharding.quotas(wanted, {1: 2, 2: 3}, 3)
    change = Counter()
    for moves in (admitted, back):
        for (a, b), n in moves.items():
            change[a] -= n
            change[b] += n
    assert not any(change.values())
    assert admitted[0, 1] == 4 and admitted[0, 2] == 3


def test_rows_with_several_hubs_follow_the_sum_of_neighbours(spark):
    state = spark.createDataFrame(
        [(0, 0, ["a", "b"]), (1, 1, ["a"]), (2, 1, ["b"]), (3, 2, ["b"]), (4, 2, [])], "row long, shard int, hubs array<string>"
    )
    found = {r.row: r.target for r in sharding.neighbours_choice(state).collect()}
    assert found[0] == 0 or found[0] == 1
    assert 4 not in found


def test_empty_table(spark):
    assert rows(sharding.shard_documents(documents(spark, []))) == []


def test_law_holds_for_a_table_of_equal_rows(spark):
    docs = documents(spark, ["x"] * 7).withColumn("doc_id", F.lit(None).cast("long"))
    check_law(rows(sharding.shard_documents(docs, shards=3)), 3)
