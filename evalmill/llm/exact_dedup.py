"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one
row per digest, deduplicated against the index by a sort-merge anti-join that
shuffles only the batch side, and its new digests are appended.

Defined results: a null text counts as empty; equal texts are those with equal
bytes. Within a batch the row with the largest doc_id stays; a text that an
earlier batch has brought keeps that earlier doc_id, so no row of the new batch
stays. Rows that repeat both doc_id and text are one document: the report marks
each of them alike, and :func:`kept_documents` returns one. A null doc_id loses
to any other. An empty batch leaves the index as it is. Other columns, whatever
their names, are passed over by the report and kept by ``kept_documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.session import delete_path, shared_dir, stage

INDEX_SCHEMA = "digest binary, keep_id long"


class DigestIndex:
    """A bucketed, sorted table of the digests seen so far, each with the doc_id that stays."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64, path: str | None = None):
        self.spark, self.table, self.buckets = spark, table, buckets
        self.path = path or f"{shared_dir(spark)}/evalmill/index-{table}"
        if not spark.catalog.tableExists(table):
            self._write(spark.createDataFrame([], INDEX_SCHEMA))

    def _write(self, rows: DataFrame) -> None:
        (
            rows.write.mode("append")
            .format("parquet")
            .option("path", self.path)
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )

    def close(self) -> None:
        """Drop the table and its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        delete_path(self.spark, self.path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index doesn't hold; the index side isn't shuffled."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add new digests, dealt by bucket first so that each bucket gets one file."""
        self._write(groups.select("digest", "keep_id").repartition(self.buckets, "digest"))


def scratch_index(spark: SparkSession) -> DigestIndex:
    """An empty index of its own, for a corpus that comes as one batch."""
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return DigestIndex(spark, f"digests_{uuid.uuid4().hex[:12]}", buckets)


def text_digest(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def digest_report(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Deduplicate a batch and append it: doc_id, keep_id, group_size, kept, text_sha256 per row.

    ``group_size`` counts the rows of the batch that share the text. The groups
    are aggregated before they are shuffled; the rows then find their group by a
    join of two staged tables, whose skewed digests adaptive execution splits.
    """
    digests = stage(docs.select("doc_id", F.unhex(text_digest()).alias("digest")), "digests")
    groups = digests.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    groups = stage(groups, "digest-groups")
    index.append(index.unseen(groups))
    known = index.rows().select("digest", "keep_id")
    decided = stage(
        groups.select("digest", "group_size").join(known.hint("merge"), "digest"), "digest-decided"
    )
    return digests.join(decided, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents that stay, with all their columns.

    Only keys are grouped. The texts meet the written list of the rows that go
    once, by doc_id and digest, in the join that Spark chooses for its size.
    Rows that repeat doc_id and text are shuffled by both.
    """
    keys = stage(digest_report(docs, index).select("doc_id", F.unhex("text_sha256").alias("of"), "kept"), "digest-report")
    gone = keys.filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), "of")
    twice = keys.filter("kept").groupBy("doc_id", "of").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    twice = stage(twice.select(F.col("doc_id").alias("gone_id"), "of"), "digest-repeated")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.unhex(text_digest()).alias("digest"))
    same = lambda other: F.col("row.doc_id").eqNullSafe(other["gone_id"]) & (packed["digest"] == other["of"])
    out = stage(gone.unionByName(twice).distinct(), "digest-gone")
    once = packed.join(out, same(out), "left_anti").select("row.*")
    repeated = packed.join(twice, same(twice), "left_semi").dropDuplicates(["digest"]).select("row.*")
    return once.unionByName(repeated)
