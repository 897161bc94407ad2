from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from evalmill.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard string, slot long, arc int"


def place(key: str) -> int:
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)


def walked(rows, shards, virtual_nodes, slack):
    """Each row walks the ring on its own: (doc_id, size, crc, shard, slot)."""
    nodes = sorted((place(f"shard {s} node {r}") >> 44, s, r) for s in range(shards) for r in range(virtual_nodes))
    first = lambda cell: next((i for i, n in enumerate(nodes) if n[0] >= cell), 0)
    keyed = []
    for doc_id, text, *_ in rows:
        data = (text or "").encode()
        at = place("" if doc_id is None else str(doc_id))
        key = (at, doc_id is not None, doc_id or 0, len(data) + 16, zlib.crc32(data))
        keyed.append((first(at >> 44), key, doc_id))
    total = len(rows)
    most = [total // shards + (s < total % shards) for s in range(shards)]
    if slack:
        most = [math.ceil(total * (1 + slack) / shards)] * shards
    held, out = [0] * shards, []
    for arc, key, doc_id in sorted(keyed, key=lambda k: k[:2]):
        while held[nodes[arc][1]] >= most[nodes[arc][1]]:
            arc = (arc + 1) % len(nodes)
        shard = nodes[arc][1]
        out.append((doc_id, *key[3:], shard, held[shard]))
        held[shard] += 1
    return out


def in_order(rows):
    return sorted(rows, key=repr)


def sharded(spark, rows, shards, virtual_nodes=8, slack=0.0, parts=5):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return [tuple(r) for r in sharding.shard_rows(docs, shards, virtual_nodes, slack).collect()]


@pytest.fixture
def rows():
    draw = random.Random(3)
    text = lambda: "".join(draw.choice("ab é漢😀\0") for _ in range(draw.randrange(40)))
    out = [(i * 7, text(), "x", 5, 1) for i in range(400)]
    out += [(11, text(), "x", 5, 1) for _ in range(250)]  # a doc_id that a third of the rows repeat
    out += [(11, "same", None, None, None)] * 20 + [(None, None, None, None, None)] * 9 + [(-5, "", "", 0, 0), (-6, None, "", 0, 0)]
    return [*out, (2**62, "long " * 50_000, "x", 1, 1)]


@pytest.mark.parametrize(("shards", "virtual_nodes", "slack"), [(40, 8, 0.0), (7, 3, 0.0), (1, 1, 0.0), (13, 16, 0.1)])
def test_equals_a_walk_of_each_row(spark, rows, shards, virtual_nodes, slack):
    found = sharded(spark, rows, shards, virtual_nodes, slack)
    assert in_order(found) == in_order(walked(rows, shards, virtual_nodes, slack))


def test_counts_are_at_most_one_apart_and_slots_gapless(spark, rows):
    found = sharded(spark, rows, 40)
    counts = Counter(r[3] for r in found)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 40
    for shard, n in counts.items():
        assert sorted(r[4] for r in found if r[3] == shard) == list(range(n))


def test_a_shard_more_moves_few_rows_if_there_is_slack(spark):
    rows = [(i, "x", "", 0, 0) for i in range(6000)]
    before = {r[0]: r[3] for r in sharded(spark, rows, 10, 64, 0.25)}
    after = {r[0]: r[3] for r in sharded(spark, rows, 11, 64, 0.25)}
    moved = sum(before[k] != after[k] for k in before)
    assert moved < 2 * len(rows) / 11  # a table by modulus moves ten elevenths
    assert sum(before[k] != after[k] != 10 for k in before) < len(rows) / 50


def test_few_rows_and_none(spark):
    assert sharded(spark, [], 40) == []
    found = sharded(spark, [(1, "a", "", 0, 0), (2, None, "", 0, 0)], 40)
    assert [(r[1], r[4]) for r in sorted(found)] == [(17, 0), (16, 0)] and len({r[3] for r in found}) == 2


def test_limits():
    with pytest.raises(ValueError, match="slack"):
        sharding._bounds(4, -0.1)


def test_query_over_the_table(spark, data_dir):
    found = queries.queries()["op11_ring_sharding"](spark, data_dir)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    wanted = [(*r[:3], "rows", *r[3:], None) for r in walked(rows, 40, sharding.VIRTUAL_NODES, 0.0)]
    assert in_order(map(tuple, found.collect())) == in_order(wanted)
