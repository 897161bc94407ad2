from __future__ import annotations

import math
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evalmill.llm import ngram_lm

ALPHA = 0.4


def brute(rows, order=3):
    """Stupid backoff by the definition, with every document's own counts taken off."""
    words = [ngram_lm.words_of(t) for _, t, *_ in rows]

    def grams(w):
        return Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))

    own = [grams(w) for w in words]
    total = sum(own, Counter())
    out = []
    for (doc_id, *_), w, mine in zip(rows, words, own, strict=True):
        c = lambda gram, mine=mine: total[gram] - mine[gram]
        rest = sum(map(len, words)) - len(w)
        score, hits = 0, [0] * order
        for i, word in enumerate(w):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    s = max(c((word,)), 1) / (rest + 1)
                elif c(gram) > 0:
                    s = c(gram) / c(gram[:-1])
                else:
                    factor *= ALPHA
                    continue
                hits[n - 1] += 1
                score += round(math.log10(s * factor) * 1_000_000)
                break
        out.append((doc_id, len(w), score, *hits))
    return out


@pytest.fixture
def rows():
    texts = [
        "the cat sat on the mat", "The cat sat on a hat", "the dog sat on the mat", None, "", "  \n ",
        "new", "new", "ä ö ü the cat", "the the the the", "a b c d e f g", "a b c d e f g",
    ]
    return [(i, t, i) for i, t in enumerate(texts)] + [(1, "The cat sat on a hat", 9), (None, "the cat", 1)]


@pytest.mark.parametrize("group_words", [1, 20, 1_500_000])
def test_scores_equal_brute_force(spark, rows, group_words, monkeypatch):
    monkeypatch.setattr(ngram_lm, "GROUP_WORDS", group_words)
    docs = spark.createDataFrame(rows, "doc_id long, text string, level int").repartition(3)
    found = ngram_lm.backoff_scores(docs).drop("mean_log10").collect()
    near = [tuple(r) for r in found]
    wanted = brute(rows)
    assert sorted((r[:2] + r[3:] for r in near), key=str) == sorted((r[:2] + r[3:] for r in wanted), key=str)
    for got, want in zip(sorted(near, key=str), sorted(wanted, key=str), strict=True):
        assert abs(got[2] - want[2]) <= got[1]  # a rounding step of each word at most


@pytest.mark.parametrize("order", [1, 2, 4])
def test_other_orders(spark, rows, order):
    docs = spark.createDataFrame(rows, "doc_id long, text string, level int")
    found = {tuple(r)[:2] + tuple(r)[4:] for r in ngram_lm.backoff_scores(docs, order=order).collect()}
    assert found == {r[:2] + r[3:] for r in brute(rows, order)}


def test_counts_cover_all_documents(spark):
    """A sentence that one other document in thousands has is scored by it."""
    rows = [(i, f"filler{i} text{i}") for i in range(3000)] + [(3000, "rare things happen"), (3001, "rare things happen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: r for r in ngram_lm.backoff_scores(docs).collect()}
    assert (found[3001]["hits_1"], found[3001]["hits_2"], found[3001]["hits_3"]) == (1, 1, 1)


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    schema = "doc_id long, text string"
    found = ngram_lm.backoff_scores(spark.createDataFrame([(1, long), (2, long)], schema)).collect()
    assert [r["n_words"] for r in found] == [200_000] * 2 and found[0]["score_micro"] == found[1]["score_micro"]
    assert ngram_lm.backoff_scores(spark.createDataFrame([], schema)).count() == 0


def test_a_group_is_scored_in_little_memory():
    """Of a group of a million words: what scoring it takes beside the group's own words and what it was told."""
    sizes = np.full(2_000, 500)
    words = np.random.default_rng(1).zipf(1.3, sizes.sum()).astype(np.uint64)
    rows = words.reshape(-1, 500)
    grams = [np.stack([rows[:, k : 500 - n + 1 + k].ravel() for k in range(n)], axis=1) for n in (1, 2, 3)]
    told = [np.zeros(len(np.unique(x, axis=0)), np.int64) for x in grams]
    tracemalloc.start()
    try:
        summed, by_level = ngram_lm.scores(ngram_lm.Group(sizes, words, 3), told, int(sizes.sum()), ALPHA)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (by_level.sum(axis=1) == sizes).all() and (summed < 0).all()
    assert peak < 80e6, peak


def test_documents_in_blocks_score_the_same(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string, level int").coalesce(1)
    wanted = sorted(map(str, ngram_lm.backoff_scores(docs).collect()))
    for words in (1, 7):
        monkeypatch.setattr(ngram_lm, "BLOCK_WORDS", words)
        assert sorted(map(str, ngram_lm.backoff_scores(docs).collect())) == wanted


@pytest.mark.parametrize(("count", "width"), [(1, 1), (200, 2), (50_000, 4), (2_000_000_000, 8)])
def test_counts_of_any_size(count, width):
    """Four groups ask for two n-grams, and for one that the first alone has: each is told what the others add."""
    hashes = np.array([5, 7, 2**63 + 1, 5, 7, 5, 7, 5, 7], np.uint64)
    own = np.array([count, 1, 3, count, 1, count, 1, count, 1], np.int32)
    ends = np.array([0, 3, 5, 7, 9])
    lists = [ngram_lm.bytes_between(x, ends) for x in (hashes, own)]
    columns = [pa.array([4] * 4, pa.int32()), pa.array(list("abcd")), *lists]
    batch = pa.record_batch(columns, names=ngram_lm.names_of(ngram_lm._ASKED))
    told = ngram_lm.joined_counts(1)(pa.Table.from_batches([batch.slice(0, 1), batch.slice(1)]))
    assert told.column("width").to_pylist() == [width] * 4 and told.column("grp").to_pylist() == list("abcd")
    found = [np.frombuffer(x, f"u{width}").tolist() for x in told.column("elsewhere").to_pylist()]
    assert found == [[3 * count, 3, 0], *[[3 * count, 3]] * 3]


def test_packed_words_come_back():
    for n in (0, 1, 70_000):
        words = np.arange(n, dtype=np.int32) * 30_000
        assert (ngram_lm.unpacked(pa.py_buffer(ngram_lm.packed(words))) == words).all()


def test_no_binary_column_wraps_round():
    with pytest.raises(pa.ArrowInvalid):
        ngram_lm.bytes_between(np.zeros(3, np.int64), np.array([0, 3, 2**28]))
