"""The pipeline on small tables with planted documents."""

from __future__ import annotations

import random

corpus_pipeline = __import__("pytest").importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def run(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], []) == []


def test_planted_documents(spark, tmp_path):
    draw = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st")]
    text = lambda n: [draw.choice(words) for _ in range(n)]
    plain = [text(120) for _ in range(60)]
    docs = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(plain)]
    docs += [(100 + i, " ".join(plain[i]), None, "s", 1) for i in range(5)]  # exact copies: the largest id stays
    docs += [(200 + i, " ".join([*plain[10 + i][:-1], "changed"]), None, "t", 1) for i in range(5)]  # near copies: the smallest stays
    docs += [(300 + i, " ".join([*text(30), "idiot", *text(30)]), "en", "t", 1) for i in range(60)]  # toxic
    docs += [(400, None, "en", "s", 1), (401, "123 ½ ...", "en", "s", 1), (402, "", None, None, None)]  # without letters
    labels = [(i, None, 0) for i in range(60)] + [(300 + i, None, 1) for i in range(60)]
    found = run(spark, tmp_path, docs, labels)
    kept = {r["doc_id"] for r in found}
    assert kept == set(range(5, 60)) | set(range(100, 105))
    full = [sum(r["length"] for r in found if r["sequence_id"] == s) for s in {r["sequence_id"] for r in found}]
    assert max(full) <= 4096
