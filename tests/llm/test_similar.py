"""Near duplicates by shingles against every pair of texts."""

from __future__ import annotations

import random

from evalmill.llm import simhash_similar


def brute_groups(rows, similarity=0.8, n=5):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").lower().split()
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    above = {i: i for i in sets}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                continue
            shared = len(x & y)
            if shared >= similarity * (len(x) + len(y) - shared) and (p := top(a)) != (q := top(b)):
                above[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def groups(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in simhash_similar.similar_groups(docs, **options).collect()}


def changed(draw, words, places):
    out = list(words)
    for at in places:
        out[at] = f"x{draw.getrandbits(40)}"
    return " ".join(out)


def test_star_of_copies_that_are_only_like_their_base(spark):
    # Each copy is like the base at 0.8 or just more, and like other copies at less: only links to the base hold them together.
    draw = random.Random(3)
    base = [f"w{i}" for i in range(454)]
    rows = [(0, " ".join(base))]
    rows += [(i, changed(draw, base, [k * 50 + draw.randrange(45) for k in range(9)])) for i in range(1, 500)]
    found = groups(spark, rows)
    assert found == brute_groups(rows)
    assert set(found.values()) == {0}


def test_every_pair_at_the_threshold_is_found(spark):
    # Pairs of small and large texts at a similarity of 0.8 or just more, among texts that share a long common line.
    draw = random.Random(5)
    line = " ".join(f"licence{i}" for i in range(30))
    rows = []
    for k in range(150):
        n = draw.choice([9, 14, 40, 120, 400])
        words = [f"d{k}w{i}" for i in range(n)]
        near = words[: n - max(1, (n - 4) // 5)] if k % 2 else words + [f"e{k}w{i}" for i in range((n - 4) // 4)]
        tail = f" {line}" if k % 3 == 0 else ""
        rows += [(2 * k, " ".join(words) + tail), (2 * k + 1, " ".join(near) + tail)]
    found = groups(spark, rows)
    assert found == brute_groups(rows)
    assert sum(found[2 * k] == found[2 * k + 1] for k in range(150)) == 100


def test_texts_without_shingles_and_documents_of_the_tables(spark, data_dir):
    hard = [None, "", "  ", "one", "One", "one two", "a b c d e", "A b  c d e", "a b c d e f", "a b c d f"]
    rows = [(i, t) for i, t in enumerate(hard)]
    rows += [(100 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()]
    assert groups(spark, rows) == brute_groups(rows)
    assert groups(spark, rows, pair_limit=2) == brute_groups(rows)
    assert groups(spark, []) == {}


def test_chains_within_crowded_keys(spark):
    # Each text is like the one before it, and like a leader only if it is near: connected texts must still be held against others.
    draw = random.Random(11)
    base = [f"w{i}" for i in range(160)]
    rows, words = [], base
    for i in range(90):
        words = changed(draw, base if i % 30 == 0 else words, [k * 50 + draw.randrange(45) for k in range(3)]).split()
        rows.append((i, " ".join(words)))
    assert groups(spark, rows, pair_limit=3) == brute_groups(rows)


def test_rows_that_repeat_a_doc_id_are_one_document(spark):
    words = [f"w{i}" for i in range(60)]
    a, near_a, b, c = " ".join(words), " ".join([*words[:-1], "other"]), "one two three four five six", "seven eight nine ten eleven twelve"
    # Document 5 has the texts a and b; b comes first in 3, and only a links it to 7; 9 and 11 share c.
    rows = [(5, a), (5, b), (3, b), (7, near_a), (9, c), (11, c), (11, "alone by itself with these words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in simhash_similar.similar_groups(docs).collect()]
    assert sorted(set(found)) == [(3, 3), (5, 3), (7, 3), (9, 9), (11, 9)] and len(found) == len(rows)
    kept = [tuple(r) for r in simhash_similar.first_of_each_group(docs).collect()]
    assert sorted(kept) == [(3, b), (9, c)]
