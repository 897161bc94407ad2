"""The pipeline's near-duplicate stage against all pairs: fingerprints within two bits, and similar shingle sets."""

from __future__ import annotations

import random

from evalmill.llm import simhash, simhash_similar

corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")


def linked_pairs(rows, n=5, similarity=0.8):
    """Pairs of places in ``rows``: those of fingerprints within two bits, and those of the similarity."""
    prints, sets = [simhash.fingerprint(t) for _, t in rows], []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    pairs = [(i, j) for i in range(len(rows)) for j in range(i)]
    near = {(i, j) for i, j in pairs if (prints[i] ^ prints[j]).bit_count() <= 2}
    return near, {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])}


def first_ids(rows, links):
    above = {doc_id: doc_id for doc_id, _ in rows}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in links:
        p, q = top(rows[i][0]), top(rows[j][0])
        above[max(p, q)] = min(p, q)
    return {i: top(i) for i in above}


def texts():
    draw = random.Random(13)
    line = [f"l{i}" for i in range(40)]
    out = [None, "", "one", "ONE", "one two three"]
    for k in range(40):
        base = [f"d{k}w{i}" for i in range(draw.choice([12, 60, 300]))] + line * (k % 3)
        out.append(" ".join(base))
        for _ in range(4):
            words = list(base)
            for at in draw.sample(range(len(words)), max(1, len(words) // 25)):
                words[at] = f"x{draw.getrandbits(40)}"
            out.append(" ".join(words))
        out.append(" ".join(base * 2))  # nearly the same shingles, counted twice
    # The line over and over outweighs the rest in a fingerprint, not in a set of shingles.
    out += [" ".join(line * 60 + [f"own{k}w{i}" for i in range(60)]) for k in range(50)]
    draw.shuffle(out)
    return list(enumerate(out))


def test_stage_has_the_links_of_both_kinds(spark):
    rows = texts()
    near, similar = linked_pairs(rows)
    wanted = first_ids(rows, near | similar)
    # Both kinds have links of their own.
    assert wanted != first_ids(rows, similar) and wanted != first_ids(rows, near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash_similar.similar_groups(docs, pivot_shingle_words=3, pair_limit=3).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted and len(found) == len(rows)
    kept = [tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert sorted(kept) == [(i, t) for i, t in rows if wanted[i] == i]


def test_texts_of_one_shingle_set_bring_all_their_fingerprints(spark):
    # Documents 1 and 2 have one set; the fingerprint of 2 alone is near that of 3, whose set is unlike.
    line, own, other = ([f"{c}{i}" for i in range(31)] for c in "abc")
    rows = [(1, " ".join(line * 2 + own)), (2, " ".join(line * 80 + own)), (3, " ".join(line * 80 + other))]
    assert simhash_similar.shingle_set(rows[0][1], 5).tolist() == simhash_similar.shingle_set(rows[1][1], 5).tolist()
    near, similar = linked_pairs(rows)
    assert (2, 1) in near and (2, 0) not in near | similar and (2, 1) not in similar
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash_similar.similar_groups(docs, pivot_shingle_words=3).collect()}
    assert found == first_ids(rows, near | similar)
