"""SimHash near-duplicates linked through pivot distance tables.

Each text gets a 64-bit fingerprint of its word shingles. Distinct fingerprints
are measured against reference fingerprints (pivots): for fingerprints x and y
and a pivot p, |d(x, p) - d(y, p)| <= d(x, y), so a pair whose pivot distances
differ by more than the radius is no link. Some pivots differ from the base
pivot in one narrow block of bits each; what they and the base measure is how
many bits of that block are off, and a change of r bits moves at most r of
those coordinates, so that at least one choice of coordinate groups stays
equal: these are the join keys. Pairs that share a key are held against the
remaining pivots by their largest coordinate difference, and the survivors are
verified by their exact distance.

A key that more than ``pair_limit`` fingerprints share is not expanded into
pairs. Its members are linked exactly through the values within one bit of
them: two fingerprints are within two bits if and only if they share such a
value, and no value has more than 65 of them.

Defined results: null texts are empty; a text without words has fingerprint
zero, and links like any other; repeated rows and equal fingerprints are one
node; a null doc_id is never the smallest of its component. Words are runs of
anything but ASCII white space, lower-cased in A-Z only; a text of fewer words
than a shingle is one shingle. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.llm.batches import bound_batches
from evalmill.llm.components import component_roots
from evalmill.session import stage

RADIUS = 2
BASE_PIVOT = 0x5DEECE66D1CE4E5B
BLOCK_BITS = 2
GROUPS = 4
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one whole text, as an unsigned 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle_words:
        starts, ends = starts[: 1 - shingle_words or None], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts.tolist(), ends.tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), shingle_words) for t in batch.column("text")), np.uint64, len(batch)
            )
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def distance(x: Column, y: Column | int) -> Column:
    other = F.lit(signed(y)).cast("long") if isinstance(y, int) else y
    return F.bit_count(x.bitwiseXOR(other)).cast("int")


def block_pivots(block_bits: int = BLOCK_BITS) -> list[int]:
    """The base pivot with all bits of one block turned, for each block."""
    mask = (1 << block_bits) - 1
    return [BASE_PIVOT ^ mask << at for at in range(0, 64, block_bits)]


def far_pivots(count: int = 16) -> list[int]:
    """Scattered pivots for the discarding of pairs, from a fixed rule."""
    return [xxhash.xxh64_intdigest(b"pivot", seed) for seed in range(count)]


def pivot_table(nodes: DataFrame) -> DataFrame:
    """fp, ``coords`` (bits off in each block, from two pivot distances) and ``far`` (distances)."""
    base = distance(F.col("fp"), BASE_PIVOT)
    off = [((base - distance(F.col("fp"), p) + BLOCK_BITS) / 2).cast("tinyint") for p in block_pivots()]
    far = [distance(F.col("fp"), p).cast("tinyint") for p in far_pivots()]
    return nodes.select("fp", F.array(*off).alias("coords"), F.array(*far).alias("far"))


def pivot_keys(table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """A row for each choice of coordinate groups that a change of ``radius`` bits can leave alone."""
    width = 64 // BLOCK_BITS // GROUPS
    packed = [
        F.aggregate(F.slice("coords", g * width + 1, width), F.lit(0).cast("long"), lambda acc, x: acc * 4 + x)
        for g in range(GROUPS)
    ]
    keys = []
    for number, chosen in enumerate(combinations(range(GROUPS), GROUPS - radius)):
        key = F.lit(number).cast("long")
        for g in chosen:
            key = key * (4**width) + packed[g]
        keys.append(key)
    return table.select("fp", "far", F.explode(F.array(*keys)).alias("key"))


def links_within(nodes: DataFrame, pair_limit: int = 32) -> DataFrame:
    """Links (a, b) that connect the fingerprints ``nodes.fp`` (distinct) just as all pairs within two bits do."""
    keyed = stage(pivot_keys(pivot_table(nodes)), "pivot-keys")
    crowded = stage(
        keyed.groupBy("key").count().filter(F.col("count") > pair_limit).select(F.col("key").alias("full")),
        "pivot-crowded",
    )
    few = stage(keyed.join(crowded, keyed["key"] == crowded["full"], "left_anti"), "pivot-few")
    left = few.select(F.col("fp").alias("a"), F.col("far").alias("far_a"), "key")
    right = few.select(F.col("fp").alias("b"), F.col("far").alias("far_b"), F.col("key").alias("key_b"))
    apart = F.array_max(F.zip_with("far_a", "far_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    pairs = (
        left.join(right, (left["key"] == right["key_b"]) & (F.col("a") < F.col("b")))
        .filter((apart <= RADIUS) & (distance(F.col("a"), F.col("b")) <= RADIUS))
        .select("a", "b")
    )
    many = keyed.join(crowded, keyed["key"] == crowded["full"], "left_semi").select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i)).cast("long")) for i in range(64)))
    near = many.select("fp", F.explode(flips).alias("value"))
    hubs = near.groupBy("value").agg(F.min("fp").alias("first"), F.max("fp").alias("last"))
    hubs = stage(hubs.filter("first <> last").select(F.col("value").alias("hub"), "first"), "pivot-hubs")
    through = near.join(hubs, near["value"] == hubs["hub"]).select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(through.filter("a <> b"))


def near_duplicates(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) for each row."""
    prints = stage(fingerprints(docs, shingle_words), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    roots = component_roots(links_within(nodes.select("fp")))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    placed = stage(placed, "fingerprint-roots")
    least = stage(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "fingerprint-components")
    named = placed.join(least.withColumnRenamed("root", "r"), placed["root"] == F.col("r")).select(
        F.col("fp").alias("of"), "component_id"
    )
    named = stage(named, "fingerprint-names")
    return prints.join(named, prints["fp"] == named["of"]).select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """The documents whose doc_id is the smallest of their component; repeats of a row go too."""
    found = near_duplicates(docs, shingle_words).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = stage(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")), "near-kept")
    kept = kept.select(F.col("doc_id").alias("kept_id"), "copies")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = packed.join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")))
    repeated = rows.filter("copies > 1").dropDuplicates(["kept_id"])
    return rows.filter("copies = 1").unionByName(repeated).select("row.*")
