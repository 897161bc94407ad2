from __future__ import annotations

import hashlib

import pytest

from evalmill.llm import exact_dedup

SCHEMA = "doc_id long, text string, copies int, digest string, keep_id string"


def brute(rows):
    groups: dict[str, list] = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, digest) for i in ids]
    return sorted(out, key=str)


@pytest.fixture
def rows():
    long = "word " * 300_000
    texts = ["a", "a", "b", None, "", "é", long, long, "A", "a ", "b"]
    return [(i, t, i, "x", "y") for i, t in enumerate(texts)] + [(None, "null id", 0, "x", "y"), (5, "é", 1, "x", "z")]


def test_report_equals_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = exact_dedup.digest_report(docs, exact_dedup.scratch_index(spark)).collect()
    assert sorted(map(tuple, found), key=str) == brute(rows)


def test_kept_documents_are_one_per_text_with_all_columns(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = exact_dedup.kept_documents(docs, exact_dedup.scratch_index(spark))
    assert found.columns == docs.columns
    kept = found.collect()
    texts = [r["text"] or "" for r in kept]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, *_ in rows})
    assert {(r["doc_id"], r["text"] or "") for r in kept} == {(i, t or "") for i, t, *_ in rows if (i, t or "") in {
        (k, t or "") for k, t in ((max((j for j, u, *_ in rows if (u or "") == (t or "") and j is not None), default=None), t) for _, t, *_ in rows)
    }}


def test_later_batches_lose_to_the_index(spark):
    index = exact_dedup.scratch_index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a"), (5, "c"), (6, "c")], "doc_id long, text string")
    assert {r["doc_id"] for r in exact_dedup.kept_documents(first, index).collect()} == {2, 3}
    report = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.digest_report(second, index).collect()}
    assert report == {4: (3, False), 5: (6, False), 6: (6, True)}
    assert index.rows().count() == 3


def test_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact_dedup.scratch_index(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    exact_dedup.digest_report(docs, index).count()
    groups = docs.selectExpr("unhex(sha2(text, 256)) digest", "doc_id keep_id")
    plan = index.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.digest_report(empty, exact_dedup.scratch_index(spark)).count() == 0
    assert exact_dedup.kept_documents(empty, exact_dedup.scratch_index(spark)).count() == 0
