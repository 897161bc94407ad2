"""Near duplicates by SimHash through pivot distance tables, and by a similarity of word shingles that two bits don't reach.

With ``pivot_shingle_words``, texts are first linked as :mod:`evalmill.llm.simhash`
does: 64-bit fingerprints, keys from pivot distance tables, pairs discarded by
their largest difference of distances, the rest verified by two bits. All these
links count. What they connect isn't held against each other again; an exact
join of shingle sets follows for all other pairs, and the groups are those of
both kinds of links.

Two sets of a Jaccard similarity t share one of the first n - ceil(t * n) + 1
of their n shingles, in any order that holds for all texts. So each distinct
set of shingles (a node) is keyed by its shingles of that prefix; nodes that
share a key, and whose sizes allow the similarity, are candidates. The order
puts shingles last that many texts of a sample have, and is by hash otherwise;
it bears on the work only, not on what is found.

Pairs of a key that at most ``pair_limit`` nodes share are joined. The nodes of
fuller keys are first held against a leader of each key, which connects the
usual group of near copies at once. What that leaves in several parts is
gathered into the groups that such keys connect, each group is dealt into
blocks, and each block is held against itself and every other one, by
fingerprints; two blocks of nodes that are connected already are not. What is
near by fingerprints forms smaller groups, whose shingle sets are compared in
the same way. A pair of blocks gives a spanning forest of its links: the
components are the same, and all that is compared is nodes that are not known
to be connected.

Before shingle sets are compared, a pair must be near on four fingerprint words
of 64 bits; small sets, whose fingerprints say less, skip that. At a similarity
of 0.8 about 39 of 256 bits differ, and 71 may: by the binomial one pair in
some ten million at the threshold is lost to it, whatever the size of the
corpus. Only links that reach the similarity on whole sets count.

Defined results: a null text is empty; texts without words are equal to each
other; a text of fewer words than a shingle is one shingle. Rows with a null
doc_id are in no group. Rows that repeat a doc_id are one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm import simhash
from evalmill.llm.batches import bound_batches, return_memory, small_side
from evalmill.llm.components import component_roots
from evalmill.session import discard, stage

WORDS = 4
#: Factors that turn one hash of a shingle into the hashes of the four words.
FACTORS = [xxhash.xxh64_intdigest(b"word", seed) | 1 for seed in range(WORDS)]
PRINT = "doc_id long, node long, n int, w0 long, w1 long, w2 long, w3 long, fp long"
NAMES = ["w0", "w1", "w2", "w3"]
#: Of the bits of a pair, those that may differ before it is verified.
SLACK = 0.28
#: Sets of fewer shingles are verified whatever their fingerprints.
SMALL = 64
#: The order of shingles is taken from so many documents or a tenth, whichever is more; it tells so many shingles apart at most.
SAMPLE, COMMON = 20_000, 400_000
#: Nodes of a block, with their shingle sets and by fingerprints only.
BLOCK, WIDE_BLOCK = 512, 4096


def shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[i:j]) for i, j in spans], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Four 64-bit fingerprint words of a set of hashes."""
    out = np.zeros(WORDS, np.uint64)
    for k, factor in enumerate(FACTORS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), simhash.CHUNK):
            mixed = hashes[at : at + simhash.CHUNK] * np.uint64(factor)
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(FACTORS[-1 - k])
            mixed ^= mixed >> np.uint64(29)
            ones += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


def node_of(found: np.ndarray) -> int:
    """One hash of a shingle set, as a signed long."""
    digest = xxhash.xxh3_64_intdigest(found.tobytes())
    return digest - (1 << 64) if digest >> 63 else digest


def wide_fingerprints(docs: DataFrame, shingle_words: int, pivot_shingle_words: int | None = None) -> DataFrame:
    """doc_id, ``node`` (one hash of the shingle set), the size of the set, the four words, and ``fp``.

    ``fp`` is the fingerprint of operator 7 over shingles of ``pivot_shingle_words``, null without these.
    """
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, nodes, sizes, prints = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = shingle_set(text, shingle_words)
                prints.append(simhash.signed(simhash.fingerprint(text, pivot_shingle_words)) if pivot_shingle_words else None)
                words.append(wide_fingerprint(found))
                nodes.append(node_of(found))
                sizes.append(len(found))
            table = np.array(words, np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [
                pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(c) for c in table.T), pa.array(prints, pa.int64())
            ]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=[x.split()[0] for x in PRINT.split(", ")])
        return_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, PRINT)


def first_documents(docs: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id and text of the first document of each node: all but the documents that are first of none.

    A doc_id that repeats with other texts may bring a node's text twice.
    """
    of = nodes.select(F.col("first_id").alias("of")).distinct()
    later = prints.select(F.col("doc_id").alias("later_id")).distinct().join(of, F.col("later_id") == F.col("of"), "left_anti")
    later = stage(later, "similar-later")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(small_side(later), texts["doc_id"] == later["later_id"], "left_anti")


def same_document_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of rows that repeat a doc_id: such rows are one document."""
    spans = prints.groupBy(F.col("doc_id").alias("of")).agg(F.min("node").alias("a"), F.max("node").alias("last"))
    several = stage(spans.filter("a < last").select("of", "a"), "similar-several")
    rows = prints.select("doc_id", F.col("node").alias("b"))
    return rows.join(several, rows["doc_id"] == several["of"]).filter("a <> b").select("a", "b").distinct()


def pivot_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of nodes whose fingerprints are equal or within two bits, by the pivot distance tables of operator 7.

    Texts of one shingle set may have several fingerprints, and texts of several sets the same one.
    """
    rows = prints.filter("fp is not null").select("fp", "node").distinct()
    ends = stage(rows.groupBy("fp").agg(F.min("node").alias("first"), F.max("node").alias("last")), "pivot-prints")
    within = stage(simhash.links_within(ends.select("fp")).distinct(), "pivot-near")
    a, b = (ends.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(f"first_{x}")) for x in "ab")
    near = within.join(a, within["a"] == a["fp_a"]).join(b, within["b"] == b["fp_b"])
    near = near.select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    several = ends.filter("first < last").select(F.col("fp").alias("of"), F.col("first").alias("a"))
    same = rows.join(several, rows["fp"] == several["of"]).select("a", F.col("node").alias("b"))
    links = stage(near.unionByName(same).filter("a <> b").distinct(), "pivot-links")
    discard(ends, within)
    return links


def with_labels(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """``nodes`` with ``label``: equal for nodes that the links ``known`` connect."""
    roots = component_roots(known).select(F.col("node").alias("of"), "root")
    labelled = nodes.join(roots, nodes["node"] == roots["of"], "left")
    return stage(labelled.select(*nodes.columns, F.coalesce("root", "node").alias("label")), "similar-nodes")


def common_shingles(firsts: DataFrame, count: int, shingle_words: int, pair_limit: int) -> np.ndarray:
    """Shingles of many texts by a sample, the most common last: those that ``pair_limit`` texts or so would share.

    The sample grows with the corpus, so such a shingle is in a few of its texts.
    """
    step = min(10, max(1, count // SAMPLE))
    least = max(2, pair_limit // step)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), shingle_words)
                yield pa.record_batch([pa.array(found.view(np.int64))], names=["shingle"])
        return_memory()

    some = firsts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    counts = some.select("text").mapInArrow(each, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    counts = stage(counts.filter(F.col("times") >= least), "similar-common")
    most = counts.orderBy(F.desc("times"), "shingle").limit(COMMON).collect()
    return np.array([r["shingle"] for r in most][::-1], np.int64).view(np.uint64)


def prefix(found: np.ndarray, similarity: float, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one of which any set of that similarity shares.

    ``common`` is sorted; ``places`` are the places of its shingles in the order.
    """
    many = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1 if len(found) else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        known = common[at] == found
        found = np.concatenate((found[~known], found[known][np.argsort(places[at[known]])]))
    return found[:many]


def prefix_keys(firsts: DataFrame, count: int, similarity: float, shingle_words: int, pair_limit: int) -> DataFrame:
    """(key, node, n): a row for each shingle of each node's prefix."""
    order = common_shingles(firsts, count, shingle_words, pair_limit)
    places = np.argsort(order)
    told = firsts.sparkSession.sparkContext.broadcast((order[places], places))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = told.value
        for batch in batches:
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), shingle_words)
                keys = prefix(found, similarity, common, places)
                if n := len(keys):
                    columns = keys.view(np.int64), np.full(n, node_of(found)), np.full(n, len(found), np.int32)
                    yield pa.record_batch([pa.array(c) for c in columns], names=["key", "node", "n"])
        return_memory()

    return firsts.select("text").mapInArrow(each, "key long, node long, n int")


def joined_candidates(few: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes that share a key and whose sizes allow the similarity."""
    left = few.select(F.col("node").alias("a"), F.col("n").alias("na"), "key")
    right = few.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("key").alias("key_b"))
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-6
    return left.join(right, (left["key"] == right["key_b"]) & (F.col("a") < F.col("b")) & fits).select("a", "b").distinct()


def shingle_table(nodes: DataFrame, firsts: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles) of these nodes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle_words) for t in batch.column("text")]
            columns = [pa.array(map(node_of, found), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.record_batch(columns, names=["node", "shingles"])
        return_memory()

    wanted = stage(nodes.select(F.col("first_id").alias("of")), "similar-wanted")
    texts = firsts.join(small_side(wanted), firsts["doc_id"] == wanted["of"], "left_semi").select("text")
    return stage(texts.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"]), "similar-shingles")


def similar_sets(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - shared
    return union == 0 or shared >= similarity * union


def block_forest(
    nodes: np.ndarray, blocks: np.ndarray, labels: np.ndarray, sizes: np.ndarray, words: np.ndarray,
    sets: list[np.ndarray] | None, similarity: float,
) -> list:
    """Links between nodes of different blocks, or of the only block, that connect what all such links connect.

    Nodes of equal labels are known to be connected and aren't compared. Without
    ``sets``, a link is two nodes whose sizes and fingerprints allow the
    similarity, and any node that has such another is an end of one.
    """
    first: dict[int, int] = {}
    above = [first.setdefault(label, i) if sets else i for i, label in enumerate(labels.tolist())]

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    one, links = len(set(blocks.tolist())) < 2, []
    for i in range(len(nodes)):
        apart = np.bitwise_count(words[i + 1 :] ^ words[i]).sum(1)
        small, large = np.minimum(sizes[i + 1 :], sizes[i]), np.maximum(sizes[i + 1 :], sizes[i])
        fits = (small >= large * similarity - 1e-6) & ((apart <= SLACK * 64 * WORDS) | (small < SMALL))
        fits &= labels[i + 1 :] != labels[i]
        if not one:
            fits &= blocks[i + 1 :] != blocks[i]
        # The nearest first: the sooner two are connected, the fewer others are compared.
        near = np.flatnonzero(fits)
        for j in (near[np.argsort(apart[near], kind="stable")] + i + 1).tolist():
            if (p := top(i)) != (q := top(j)) and (sets is None or similar_sets(sets[i], sets[j], similarity)):
                above[p] = q
                links.append((int(nodes[i]), int(nodes[j])))
    return links


def led_links(
    crowded: DataFrame, nodes: DataFrame, firsts: DataFrame, similarity: float, shingle_words: int, known: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(links, crowded keys that these and the known links leave in several parts, as rows of key, node, label).

    Every crowded key holds its members against one of them, its leader. A key
    whose members are then connected needs no more: of a group of near copies
    that is the rule, and it costs as many comparisons as members.
    """
    lead = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("a")
    leaders = stage(crowded.groupBy(F.col("key").alias("led")).agg(lead), "similar-leaders")
    ties = crowded.join(leaders, crowded["key"] == leaders["led"])
    pairs = ties.filter(F.col("a") != F.col("node")).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    links = verified_links(stage(pairs.distinct(), "similar-ties"), nodes, firsts, similarity, shingle_words)
    roots = component_roots(links.unionByName(known)).select(F.col("node").alias("of"), "root")
    labelled = crowded.join(roots, crowded["node"] == roots["of"], "left")
    labelled = stage(labelled.select("key", "node", F.coalesce("root", "node").alias("label")), "similar-labels")
    parts = labelled.groupBy(F.col("key").alias("of")).agg((F.min("label") != F.max("label")).alias("parts")).filter("parts")
    return links, stage(labelled.join(parts, labelled["key"] == parts["of"], "left_semi"), "similar-mixed")


def key_groups(mixed: DataFrame) -> DataFrame:
    """(node, label, root): the nodes of these keys, in the groups that the keys connect."""
    least = stage(mixed.groupBy(F.col("key").alias("of")).agg(F.min("node").alias("a")), "similar-centres")
    ties = mixed.join(least, mixed["key"] == least["of"]).select("a", F.col("node").alias("b")).distinct()
    return _grouped(stage(ties, "similar-group-ties"), mixed.select("node", "label").distinct())


def _grouped(links: DataFrame, labels: DataFrame) -> DataFrame:
    roots = component_roots(links).withColumnRenamed("node", "m")
    return stage(labels.join(roots, labels["node"] == roots["m"]).select("node", "label", "root"), "similar-placed")


def dealt_blocks(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` (node, label, root) with block, others and all: each node in a block of its group.

    The nodes of a group's largest label are connected with each other and fill
    the last blocks, from ``others`` on.
    """
    counts = stage(placed.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")), "similar-label-counts")
    sizes = counts.groupBy(F.col("root").alias("r")).agg(
        F.max(F.struct("n", "label"))["label"].alias("bulk"), F.max("n").alias("n"), F.sum("n").alias("every")
    )
    blocks = lambda n: F.ceil(n / block).cast("int")
    others, bulk = blocks(F.col("every") - F.col("n")), blocks(F.col("n"))
    dealt = lambda count: F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(count, F.lit(1))).cast("int")
    where = F.when(F.col("label") == F.col("bulk"), others + dealt(bulk)).otherwise(dealt(others))
    rows = placed.join(sizes, placed["root"] == sizes["r"])
    return rows.select(*placed.columns, where.alias("block"), others.alias("others"), (others + bulk).alias("all"))


def block_links(rows: DataFrame, similarity: float) -> DataFrame:
    """The forests of all pairs of blocks; ``rows`` are of :func:`dealt_blocks`, with fingerprints, and shingles or none."""
    # Two blocks of the largest label have nothing to compare.
    against = F.when(F.col("block") < F.col("others"), F.col("all")).otherwise(F.col("others"))
    rows = rows.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), against), lambda x: x < against)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    told = "shingles" in rows.columns

    def forest(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words = np.stack([table.column(w).to_numpy() for w in NAMES], axis=1).view(np.uint64)
        sets = [np.frombuffer(s.as_buffer() or b"", np.uint64) for s in table.column("shingles")] if told else None
        columns = [table.column(c).to_numpy() for c in ("node", "block", "label", "n")]
        ends = list(zip(*block_forest(*columns, words, sets, similarity), strict=True)) or [(), ()]
        return pa.table([pa.array(e, pa.int64()) for e in ends], names=["a", "b"])

    columns = ["root", "i", "j", "block", "label", "node", "n", *NAMES, *["shingles"] * told]
    return rows.select(*columns).groupBy("root", "i", "j").applyInArrow(forest, "a long, b long")


def crowded_links(
    crowded: DataFrame, nodes: DataFrame, firsts: DataFrame, similarity: float, shingle_words: int, known: DataFrame
) -> DataFrame:
    """Verified links of the nodes that share crowded keys (rows of key, node).

    Leaders come first. The groups that the keys left connect are compared by
    fingerprints only, in wide blocks; what is near by these forms the smaller
    groups whose shingle sets are compared.
    """
    links, mixed = led_links(crowded, nodes, firsts, similarity, shingle_words, known)
    prints = nodes.select(F.col("node").alias("of"), "n", *NAMES)
    wide = dealt_blocks(key_groups(mixed), WIDE_BLOCK)
    near = stage(block_links(wide.join(prints, wide["node"] == prints["of"]), similarity), "similar-near")
    placed = _grouped(near, mixed.select("node", "label").distinct())
    wanted = stage(nodes.join(placed.select(F.col("node").alias("m")), nodes["node"] == F.col("m"), "left_semi"), "similar-crowded")
    sets = shingle_table(wanted, firsts, shingle_words)
    rows = dealt_blocks(placed, BLOCK)
    rows = rows.join(prints, rows["node"] == prints["of"]).join(sets.withColumnRenamed("node", "s"), F.col("node") == F.col("s"))
    rows = stage(rows.drop("of", "s"), "similar-members")
    found = stage(block_links(rows, similarity), "crowded-links")
    discard(sets, rows)
    return links.unionByName(found)


def _both_ends(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    for x in "ab":
        side = of.select(F.col("node").alias(f"node_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        pairs = pairs.join(side, pairs[x] == side[f"node_{x}"]).drop(f"node_{x}")
    return pairs


def verified_links(pairs: DataFrame, nodes: DataFrame, firsts: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """The pairs of nodes of different labels whose shingle sets reach the similarity."""
    apart = sum((simhash.distance(F.col(f"{w}_a"), F.col(f"{w}_b")) for w in NAMES), F.lit(0))
    near = (apart <= int(SLACK * 64 * WORDS)) | (F.least("n_a", "n_b") < SMALL)
    both = _both_ends(pairs, nodes, ["n", "label", *NAMES]).filter(F.col("label_a") != F.col("label_b"))
    pairs = stage(both.filter(near).select("a", "b"), "similar-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end")).distinct()
    wanted = stage(nodes.join(ends, nodes["node"] == ends["end"], "left_semi").select("node", "first_id"), "similar-ends")
    shingles = shingle_table(wanted, firsts, shingle_words)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                similar_sets(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), similarity)
                for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        return_memory()

    links = stage(_both_ends(pairs, shingles, ["shingles"]).mapInArrow(verify, "a long, b long"), "similar-links")
    discard(pairs, wanted, shingles)
    return links


def similar_links(
    nodes: DataFrame, firsts: DataFrame, similarity: float, shingle_words: int, pair_limit: int, known: DataFrame
) -> DataFrame:
    """Links (a, b) of nodes that reach the similarity: enough of them to connect, with the known links, all that do."""
    keyed = stage(prefix_keys(firsts, nodes.count(), similarity, shingle_words, pair_limit), "prefix-keys")
    # Most keys are one node's own: they go first.
    times = keyed.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    times = stage(times, "prefix-times")
    shared = stage(keyed.join(times, keyed["key"] == times["of"]).select("key", "node", "n", "times"), "prefix-shared")
    discard(keyed, times)
    pairs = stage(joined_candidates(shared.filter(F.col("times") <= pair_limit), similarity), "similar-candidates")
    links = verified_links(pairs, nodes, firsts, similarity, shingle_words)
    discard(pairs)
    crowded = stage(shared.filter(F.col("times") > pair_limit).select("key", "node"), "similar-full")
    discard(shared)
    return links.unionByName(crowded_links(crowded, nodes, firsts, similarity, shingle_words, known))


def similar_groups(
    docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, pair_limit: int = 32, pivot_shingle_words: int | None = None
) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that links reach from each document.

    Links are those of the similarity and, with ``pivot_shingle_words``, those of
    fingerprints over so many words that differ in two bits or fewer.
    """
    docs = docs.filter("doc_id is not null")
    prints = stage(wide_fingerprints(docs, shingle_words, pivot_shingle_words), "wide-fingerprints")
    known = pivot_links(prints)
    nodes = stage(prints.groupBy("node", "n", *NAMES).agg(F.min("doc_id").alias("first_id")), "wide-nodes")
    firsts = first_documents(docs, prints, nodes)
    links = similar_links(with_labels(nodes, known), firsts, similarity, shingle_words, pair_limit, known)
    roots = component_roots(links.unionByName(known).unionByName(same_document_links(prints)))
    placed = stage(
        nodes.select("node", "first_id")
        .join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
        .select("node", "first_id", F.coalesce("root", "node").alias("root")),
        "similar-roots",
    )
    least = stage(placed.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id")), "similar-least")
    named = stage(
        placed.join(least, placed["root"] == least["r"]).select(F.col("node").alias("of"), "component_id"), "similar-names"
    )
    return prints.join(named, prints["node"] == named["of"]).select("doc_id", "component_id")


def first_of_each_group(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, **options) -> DataFrame:
    """One document of each group, that with the smallest doc_id; documents without a doc_id all stay."""
    found = stage(similar_groups(docs, similarity, shingle_words, **options), "similar-found")
    gone = stage(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("of")).distinct(), "similar-gone")
    twice = found.groupBy(F.col("doc_id").alias("of")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    twice = stage(twice.select("of").join(gone, "of", "left_anti"), "similar-repeated")
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    out = stage(gone.unionByName(twice), "similar-out")
    once = packed.join(small_side(out), F.col("row.doc_id") == F.col("of"), "left_anti")
    repeated = packed.join(small_side(twice), F.col("row.doc_id") == F.col("of"), "left_semi")
    repeated = repeated.withColumn("of", F.col("row.doc_id")).dropDuplicates(["of"])
    return once.select("row.*").unionByName(repeated.select("row.*"))
