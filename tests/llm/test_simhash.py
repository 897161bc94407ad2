from __future__ import annotations

import random
import re

import pytest
import xxhash

from evalmill.llm import simhash


def plain_fingerprint(text, n=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids_prints):
    root = list(range(len(ids_prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(ids_prints):
        for j in range(i):
            if (x ^ ids_prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(ids_prints):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least.get(find(i)) for i in range(len(ids_prints))]


@pytest.fixture
def texts():
    draw = random.Random(3)
    vocabulary = [f"word{i}" for i in range(300)]
    out = [None, "", " \t\n", "One", "one", "Two Words", "Ä ä x", "\x1c a\x1db \x0b c"]
    for _ in range(40):
        base = draw.choices(vocabulary, k=draw.randint(3, 300))
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 3)):
            copy = list(base)
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            out.append(" ".join(copy))
    out.append("long " + " ".join(draw.choices(vocabulary, k=150_000)))
    return out + out[8:14]


def test_fingerprints_equal_the_definition(texts):
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_components_equal_brute_force(spark, texts):
    rows = [(i if i != 7 else None, t, i, "x", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, node string, component_id double")
    found = simhash.near_duplicates(docs).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    wanted = {(i, simhash.signed(p), c) for (i, p), c in zip(prints, components(prints), strict=True)}
    assert {tuple(r) for r in found} == wanted and len(found) == len(rows)


@pytest.mark.parametrize("pair_limit", [1, 4, 32])
def test_links_connect_as_all_pairs_do(spark, pair_limit):
    """Dense fingerprints: keys crowd, and are linked through the values near them."""
    draw = random.Random(pair_limit)
    values = {draw.getrandbits(64) for _ in range(30)}
    for v in list(values):
        for _ in range(draw.randint(0, 12)):
            v ^= 1 << draw.randrange(64) | 1 << draw.randrange(64)
            values.add(v)
    base = draw.getrandbits(64)
    values |= {base ^ 1 << i for i in range(40)}
    order = sorted(values)
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in order], "fp long")
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links_within(nodes, pair_limit).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    root = {v: v for v in order}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    wanted = components([(i, v) for i, v in enumerate(order)])
    same = {}
    for v, c in zip(order, wanted, strict=True):
        assert same.setdefault(c, find(v)) == find(v)
    assert len({find(v) for v in order}) == len(set(wanted))


def test_pivot_bound_never_discards_a_link(spark):
    draw = random.Random(9)
    rows = [(simhash.signed(draw.getrandbits(64)),) for _ in range(50)]
    rows += [(simhash.signed((r[0] % (1 << 64)) ^ (1 << draw.randrange(64))),) for r in rows]
    table = simhash.pivot_table(spark.createDataFrame(rows, "fp long")).collect()
    for x, y in zip(table[:50], table[50:], strict=True):
        assert max(abs(a - b) for a, b in zip(x["far"], y["far"], strict=True)) <= 2
        assert sum(abs(a - b) for a, b in zip(x["coords"], y["coords"], strict=True)) == 1


def test_empty_and_only_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    found = simhash.near_duplicates(spark.createDataFrame([(4, "same text here")] * 5, schema)).collect()
    assert len(found) == 5 and {r["component_id"] for r in found} == {4}


def test_first_of_each_group_keeps_all_columns(spark):
    docs = spark.createDataFrame(
        [(2, "a b c d", 1, "p"), (1, "a b c d", 2, "q"), (1, "a b c d", 2, "q"), (3, "entirely other words", 3, "r")],
        "doc_id long, text string, copies int, kept_id string",
    )
    found = simhash.first_of_each_group(docs)
    assert found.columns == docs.columns
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3]
