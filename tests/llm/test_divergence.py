from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evalmill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, vector int"


def audited(rows, least_docs, top_terms):
    """Every pair of groups over every kept term."""
    groups, in_docs = defaultdict(Counter), Counter()
    for _, text, lang, source, *_ in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered)
        groups[lang or "", source or ""].update(terms)
        in_docs.update((lang or "", t) for t in set(terms))
    out = []
    value = lambda p, q: (p - q) ** 2 // (p + q)
    ranked = lambda found: sorted(found, key=lambda x: (-x[1], x[0].encode()))
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least_docs)
        members = {s: c for (x, s), c in groups.items() if x == lang}

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (counts[t] + 2) // total for t in kept]

        whole = shares(sum(members.values(), Counter()))
        p = {s: shares(c) for s, c in members.items()}
        for s, counts in members.items():
            pairs = [(t, sum(map(value, p[s], p[t]))) for t in members if t != s]
            terms = [(k, value(a, q)) for k, a, q in zip(kept, p[s], whole, strict=True) if counts[k] and a > q]
            out += [(lang, s, "pair", *x, r) for r, x in enumerate(ranked(pairs), 1)]
            out += [(lang, s, "term", *x, r) for r, x in enumerate(ranked(terms)[:top_terms], 1)]
    return sorted(out)


@pytest.fixture
def rows():
    draw = random.Random(6)
    words = ["Ab", "aB", "é", "É", "漢字", "x1y", "don't", "ſ", "K", "z_z", "I", "😀"] + [f"w{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(60)]
    text = lambda n: draw.choice([" ", "\n", "\0", ". "]).join(draw.choices(words, k=n))
    out = []
    for i in range(300):
        lang, source = draw.choice([("en", "hot"), ("en", "hot"), ("en", f"s{i % 7}"), ("de", f"s{i % 3}"), (None, "s"), ("", None)])
        out.append((i, text(draw.randrange(12)), lang, source, "t", 1, 2))
    out += [(5, None, "en", "bare", "t", 1, 2), (5, "", "en", "bare too", "t", 1, 2), (6, "1 2 3", "fr", "a", None, None, None)]
    out += [(7, "seldom", "fr", "b", None, None, None), (8, "alone", "it", None, None, None, None)]
    return [*out, *[(9, "the same words", "en", "copies", "t", 1, 2)] * 150, (10, "ab " * 60_000 + "Wak", "en", "long", "t", 1, 2)]


@pytest.mark.parametrize(("least", "top"), [(10, 10), (1, 3), (1000, 10)])
def test_equals_all_pairs_over_all_terms(spark, rows, least, top):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = divergence.source_divergence(docs, least, top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == audited(rows, least, top)


def test_each_vector_of_counts_is_taken_once(spark):
    rows = [(i, " ".join(f"w{chr(97 + j)}" for j in range(20)), "en", f"s{i % 2}", None, None, None) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    vectors = divergence.distinct_vectors(divergence.kept_terms(divergence.term_counts(docs), 10)).collect()
    assert [(len(v.vector), v.copies) for v in vectors] == [(2, 20)]
    assert sorted(map(tuple, divergence.source_divergence(docs).collect())) == audited(rows, 10, 10)


def test_pairs_of_sources_without_the_terms_are_left_to_the_number_of_terms():
    absent = np.array([3, 5, 9])
    shares, present = np.array([[30, 5, 9]]), np.array([[True, False, False]])
    values, touched = divergence.sum_of_pairs(shares, present, absent, np.array([4]))
    assert touched.tolist() == [[4, 4, 4], [4, 0, 0], [4, 0, 0]]
    assert values[0, 1] == values[1, 0] == 4 * (25 * 25 // 35) and values[1, 2] == 0


def test_counts_beyond_a_long_product_stay_exact(spark):
    n, total = 3 * 10**12, 7 * 10**12
    found = spark.range(1).selectExpr(f"{n} as n", f"{total} as total", "11 as kept").select(divergence.share("n", "total", "kept"))
    assert found.first()[0] == 1 + 10**9 * (n + 2) // (total + 22)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
