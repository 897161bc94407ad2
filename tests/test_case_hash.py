"""Cases are stored once for each content, not once for each source and language."""

from __future__ import annotations

from evalmill.plans import registry


def test_one_copy_for_each_text(spark, tmp_path):
    texts = ["one", "two", "one", 'quoted "é"\n', "two"]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.queries()["case_hash_copies"](spark, str(tmp_path)).collect()
    assert sorted((r["first_doc"], r["n"]) for r in found) == [(0, 2), (1, 2), (3, 1)]
