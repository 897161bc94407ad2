from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string"


def lloyd(rows, parts, size, rounds):
    """Every part against every entry in every round: [(vec_id, code, error, label)], entries by part."""
    kept = []
    for vec_id, vector, label, *_ in rows:
        if vector and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, [math.floor(256 * x) for x in vector], label))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:size]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for number in range(rounds + 1):
        found = [[min((gap(cut(v, p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
        if number < rounds:
            for p in range(parts):
                groups = defaultdict(list)
                for (_, v, _), best in zip(kept, found, strict=True):
                    groups[best[p][1]].append(cut(v, p))
                for e, members in groups.items():
                    books[p][e] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    out = [
        (vec_id, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label)
        for (vec_id, _, label), best in zip(kept, found, strict=True)
    ]
    return out, books


def expected(rows, parts, size, rounds):
    out, books = lloyd(rows, parts, size, rounds)
    sums = defaultdict(int)
    for *_, error, label in out:
        sums[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted(((v, code, error, sums[label], digest) for v, code, error, label in out), key=repr)


def found(spark, rows, parts, size, rounds):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(4)
    codes = vector_codes.coded_with_label_errors(vectors, parts, size, rounds)
    return sorted(map(tuple, codes.collect()), key=repr)


@pytest.fixture
def rows():
    draw = random.Random(8)
    vector = lambda dim: [draw.choice([-0.5, -0.25, 0.0, 0.004, 0.25, draw.gauss(0, 0.3)]) for _ in range(dim)]
    out = [(i, vector(12), draw.choice([1, 2, None]), "x") for i in range(3, 300)]
    common = vector(12)
    out += [(1000 + i, common, 7, "x") for i in range(120)]  # one vector of a third of the rows
    out += [(5, vector(12), 1, "x"), (5, common, None, "x"), (None, vector(12), 2, "x"), (0, common, 2, "x"), (1, common, 3, "x")]
    out += [(2, None, 1, "x"), (2, [], 1, "x"), (2, [None] + [0.5] * 11, 1, "x"), (2, [math.nan] * 12, 1, "x"), (2, [math.inf] * 12, 1, "x")]
    return out


@pytest.mark.parametrize(("parts", "size", "rounds"), [(4, 16, 2), (12, 64, 3), (1, 9, 4), (3, 1, 2), (2, 256, 1), (2, 8, 0)])
def test_equals_plain_lloyd(spark, rows, parts, size, rounds):
    assert found(spark, rows, parts, size, rounds) == expected(rows, parts, size, rounds)


@pytest.mark.parametrize("large", [3e5, 1e9, 2e15])
def test_large_components_are_exact(spark, large):
    draw = random.Random(4)
    rows = [(i, [large * draw.choice([-1, 0, 1]) + draw.randrange(5) for _ in range(4)], i % 2, "") for i in range(30)]
    wanted = [(v, c, min(e, 2**63 - 1), min(s, 2**63 - 1), d) for v, c, e, s, d in expected(rows, 2, 8, 2)]
    got = found(spark, rows, 2, 8, 2)
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in sorted(wanted, key=repr)]


def test_bounds_spare_scans_and_hold():
    draw = np.random.default_rng(2)
    centers = draw.integers(-2000, 2000, (24, 4))
    vectors = centers[draw.integers(0, 24, 3000)] + draw.integers(-30, 30, (3000, 4))
    books = vector_codes.Codebooks(vectors[:24].reshape(24, 1, 4).transpose(1, 0, 2).copy())
    code, upper, lower, scans = books.assign(vectors, None)
    assert scans.sum() == 3000
    for _ in range(3):
        entries = books.entries.copy()
        for e in range(24):
            if (code[:, 0] == e).any():
                entries[0, e] = vectors[code[:, 0] == e].sum(0) // (code[:, 0] == e).sum()
        books = vector_codes.Codebooks(entries, books)
        code, upper, lower, scans = books.assign(vectors, (code, upper, lower))
        plain = ((vectors[:, None] - entries[0][None]) ** 2).sum(2)
        assert (code[:, 0] == plain.argmin(1)).all()
        own = np.sqrt(np.take_along_axis(plain, code.astype(int), 1)[:, 0])
        second = np.sqrt(np.sort(plain, 1)[:, 1])
        assert (own <= upper[:, 0]).all() and (lower[:, 0] <= second).all()
    assert scans.sum() < 1500


def test_other_lengths_no_vectors_and_refusals(spark):
    rows = [(1, [0.5] * 4, 1, ""), (2, [0.25] * 4, 1, ""), (0, [0.5] * 8, 1, ""), (3, [0.5], 1, "")]
    assert [r[0] for r in found(spark, rows, 2, 4, 2)] == [1, 2]
    assert found(spark, [(1, None, 1, ""), (2, [], 1, "")], 2, 4, 2) == []
    assert found(spark, [], 16, 64, 2) == []
    with pytest.raises(ValueError, match="equal parts"):
        found(spark, [(1, [0.5] * 5, 1, "")], 2, 4, 2)
    with pytest.raises(ValueError, match="byte"):
        vector_codes.trained_codes(spark.createDataFrame([], SCHEMA), entries=300)


def test_the_state_of_a_round_is_a_table(spark, rows):
    vectors = spark.createDataFrame(rows, SCHEMA)
    codes, books = vector_codes.trained_codes(vectors, 4, 16, 6)
    assert books.entries.shape == (4, 16, 3)
    assert codes.agg(F.sum("scans")).first()[0] < 4 * codes.count()
