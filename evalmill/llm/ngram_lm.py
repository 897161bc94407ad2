"""Stupid-backoff scores of documents against n-gram counts of the whole corpus.

Documents are read in groups of about a million words. The distinct n-grams of
a group are exploded into arrays of hashes and counts, one for each bucket of
the hash space, and shuffled by bucket. A bucket holds the count table of its
n-grams, summed over all groups, and joins it to the n-grams that asked. The
answers return to their group, where each word's score is read off and summed
by document. N-grams are counted within their group before they are shuffled,
so a frequent word is one entry a group and no key is hot; the number of
buckets grows with the corpus, so a bucket has about ``BUCKET_NGRAMS`` entries
of a level at any size.

Numbers travel as binary columns: the JVM copies them as they are, where it
takes arrays apart number by number, into buffers of several times their size.
A group's words are compressed besides. Python works on a group level by level,
and on the documents of a group in blocks of ``BLOCK_WORDS`` words.

A document is scored by the counts of all others: its own occurrences are
taken off. With c the counts that are left, the word w after the history h of
up to ``order - 1`` words of the same document scores

    S(w | h) = c(h w) / c(h)            if c(h w) > 0
    S(w | h) = alpha * S(w | h')        otherwise, h' without its first word
    S(w)     = max(c(w), 1) / (T + 1)   with T words in the other documents

N-grams are told apart by hashes of 64 bits: of n different ones, about
n * n / 2**65 pairs share their counts.

Defined results: scores are sums of log10 S, rounded for each word to
millionths and kept as whole numbers, so that they don't depend on the order of
addition. Words are runs of anything but ASCII white space in the lower-cased
text. A null or empty text has no words and score 0. Repeated rows are
documents of their own. Long texts are scored whole; a group always holds whole
documents. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.batches import bound_batches, return_memory
from evalmill.session import stage

#: Words of the documents that are counted together, and n-grams of a bucket.
GROUP_WORDS = 1_000_000
BUCKET_NGRAMS = 2_000_000
#: Words of whole documents whose own counts are taken at a time, and n-grams sent on at a time.
BLOCK_WORDS = 100_000
MICRO = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GROUPS = "grp string, n_words long, doc_ids array<long>, sizes array<long>, vocabulary binary, words binary"
_ASKED = "bucket int, grp string, hashes binary, counts binary"
_TOLD = "grp string, level int, bucket int, width int, elsewhere binary"
_IN_GROUP = ["doc_ids", "sizes", "vocabulary", "words"]


def names_of(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def list_of(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def bytes_between(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """A binary column: each row has the values from one end to the next. More than 2 GB are refused."""
    offsets = pa.array(ends * values.itemsize, pa.int32()).buffers()[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))])


def values_of(column: pa.BinaryArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(the values of all rows in a row, where each row ends in them, after a 0) of a binary column without nulls."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    values = np.frombuffer(data[int(ends[0]) : int(ends[-1])], kind) if data is not None else np.zeros(0, kind)
    return values, (ends - ends[0]) // size


def packed(values: np.ndarray) -> bytes:
    """An int32 array compressed: its length, and its bytes by significance."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(data: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(data[:8].to_pybytes(), "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], 4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(n)


def ngram_hashes(words: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For n = 1 .. order: the hash of the n words that end at each word, 0 where a document has fewer."""
    yield words
    starts, lengths = (np.cumsum(sizes) - sizes)[sizes > 0], sizes[sizes > 0]
    last = words
    for n in range(2, order + 1):
        mixed = np.zeros_like(words)
        mixed[1:] = last[:-1]
        mixed ^= mixed >> np.uint64(31)
        mixed *= _MIX
        mixed += np.uint64(n)
        mixed ^= mixed >> np.uint64(29)
        mixed ^= words
        mixed *= _MIX
        mixed ^= mixed >> np.uint64(32)
        mixed[mixed == 0] = np.uint64(1)
        for k in range(n - 1):
            mixed[starts[lengths > k] + k] = 0
        yield mixed
        last = mixed


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram hashes with their counts."""
    found, counts = np.unique(grams, return_counts=True)
    skip = int(len(found) > 0 and found[0] == 0)
    return found[skip:], counts[skip:]


def places(values: np.ndarray) -> np.ndarray:
    """For each value its place among the distinct ones, in order."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.zeros(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del ordered
    of = np.empty(len(values), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32)
    return of


class Group:
    """Documents whose n-grams are counted together: their sizes in words, and the hash of each word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, order: int):
        self.sizes, self.words, self.order = sizes, words, order
        self.doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def blocks(self) -> Iterator[slice]:
        """Places of the words of some documents after others, about ``BLOCK_WORDS`` at a time."""
        ends = np.cumsum(self.sizes)
        start = 0
        while start < len(self.words):
            end = int(ends[max(np.searchsorted(ends, start + BLOCK_WORDS, "right") - 1, np.searchsorted(ends, start, "right"))])
            yield slice(start, end)
            start = end

    def counts_elsewhere(self, grams: np.ndarray, outside: np.ndarray) -> np.ndarray:
        """At each word: how often other documents have the n-gram that ends there.

        ``outside`` has the count outside this group of each distinct n-gram.
        """
        of = places(grams)
        total = np.bincount(of)
        total[len(total) - len(outside) :] += outside.astype(np.int64)
        left = total[of]
        for block in self.blocks():
            key = self.doc[block].astype(np.int64) * np.int64(len(total)) + of[block]
            own = places(key)
            left[block] -= np.bincount(own)[own]
        left[grams == 0] = 0
        return left


def scores(group: Group, outside: list[np.ndarray], corpus_words: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(micro scores of each document, words of each document by the level that scored them)."""
    order = len(outside)
    used = np.zeros(len(group.doc), np.int8)
    before = value = None
    for level, grams in enumerate(ngram_hashes(group.words, group.sizes, order)):
        now = group.counts_elsewhere(grams, outside[level])
        if before is None:
            value = np.maximum(now, 1) / (corpus_words - group.sizes[group.doc] + 1)
        else:
            hit = np.flatnonzero(now > 0)
            value[hit] = now[hit] / np.maximum(before[hit - 1], 1)
            used[hit] = level
        before = now
    n = len(group.sizes)
    summed, by_level = np.zeros(n, np.int64), np.zeros((n, order), np.int64)
    starts = np.cumsum(group.sizes) - group.sizes
    for block in group.blocks():
        doc, level = group.doc[block], used[block]
        longest = np.minimum(np.arange(block.start, block.stop) - starts[doc], order - 1)
        micro = np.rint(np.log10(value[block] * alpha ** (longest - level)) * MICRO).astype(np.int64)
        first, last = int(doc[0]), int(doc[-1]) + 1
        summed[first:last] += np.bincount(doc - first, micro, last - first).astype(np.int64)
        for k in range(order):
            by_level[first:last, k] += np.bincount(doc[level == k] - first, minlength=last - first)
    return summed, by_level


def document_groups(docs: DataFrame) -> DataFrame:
    """Groups of whole documents: their ids and sizes, the hashes of their vocabulary, and their words as places in it."""
    bound_batches(docs.sparkSession, megabytes=4)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids: list = []
        words: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) or 1 for w in known), np.uint64, len(known))
            sizes = np.array([len(w) for w in words], np.int64)
            doc_ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int64()))
            columns = [pa.array([uuid4().hex]), pa.array([int(sizes.sum())], pa.int64()), doc_ids, list_of(sizes, pa.int64())]
            columns += [pa.array([hashes.tobytes()], pa.binary()), pa.array([packed(np.concatenate(words))], pa.binary())]
            return pa.record_batch(columns, names=names_of(_GROUPS))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = words_of(text.as_py())
                for word in set(found).difference(known):
                    known[word] = len(known)
                ids.append(doc_id)
                words.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                held += len(found)
                if held > GROUP_WORDS:
                    yield flush()
                    known, ids, words, held = {}, [], [], 0
        if ids:
            yield flush()
        known, words = {}, []
        return_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, _GROUPS)


def _groups_in(table: pa.RecordBatch | pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, sizes, the hash of each word) of each row."""
    for row in range(table.num_rows):
        ids, sizes, vocabulary, words = (table.column(c)[row] for c in _IN_GROUP)
        hashes = np.frombuffer(vocabulary.as_buffer(), np.uint64)
        yield ids.values, sizes.values.to_numpy(zero_copy_only=False), hashes[unpacked(words.as_buffer())]


def asked_ngrams(groups: DataFrame, level: int, buckets: int) -> DataFrame:
    """For each group and bucket: the distinct n-grams of a level, sorted, with their counts in the group."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, (_, sizes, words) in zip(batch.column("grp").to_pylist(), _groups_in(batch), strict=True):
                *_, grams = ngram_hashes(words, sizes, level + 1)
                del words
                found, counts = distinct(grams)
                del grams
                cuts = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
                full = np.flatnonzero(np.diff(cuts))
                ends = np.concatenate([[0], cuts[1:][full]])
                row = 0
                while row < len(full):
                    to = max(row + 1, int(np.searchsorted(ends, ends[row] + BLOCK_WORDS, "right")) - 1)
                    some, at = slice(ends[row], ends[to]), ends[row : to + 1] - ends[row]
                    lists = [bytes_between(found[some], at), bytes_between(counts[some].astype(np.int32), at)]
                    names = pa.array([name] * (to - row), pa.string())
                    yield pa.record_batch([pa.array(full[row:to], pa.int32()), names, *lists], names=names_of(_ASKED))
                    row = to
        return_memory()

    return groups.select("grp", *_IN_GROUP).mapInArrow(each, _ASKED)


def joined_counts(level: int):
    """Sum a bucket's counts over all groups and join the totals to the n-grams of each: what the others add to its own."""

    def answer(table: pa.Table) -> pa.Table:
        parts = [[values_of(x, kind) for x in table.column(c).chunks] for c, kind in (("hashes", np.uint64), ("counts", np.int32))]
        grams, own = (np.concatenate([values for values, _ in x]) for x in parts)
        sizes = np.concatenate([np.diff(ends) for _, ends in parts[0]])
        names, buckets = table.column("grp"), table.column("bucket")
        del parts, table
        order = np.argsort(grams)
        grams = grams[order]
        new = np.ones(len(grams), bool)
        np.not_equal(grams[1:], grams[:-1], out=new[1:])
        del grams
        starts = np.flatnonzero(new)
        totals = np.add.reduceat(own[order], starts, dtype=np.int64)
        elsewhere = np.empty(len(own), np.int64)
        elsewhere[order] = np.repeat(totals, np.diff(starts, append=len(own)))
        elsewhere -= own
        kind = np.min_scalar_type(int(elsewhere.max()))
        told = bytes_between(elsewhere.astype(kind), np.concatenate([[0], np.cumsum(sizes)]))
        same = [pa.array(np.full(len(sizes), x, np.int32)) for x in (level, kind.itemsize)]
        return pa.table([names, same[0], buckets, same[1], told], names=names_of(_TOLD))

    def each(table: pa.Table) -> pa.Table:
        answered = answer(table)
        return_memory()
        return answered

    return each


def backoff_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4) -> DataFrame:
    """(doc_id, n_words, score_micro, mean_log10, hits_1 .. hits_<order>) of each row.

    ``hits_n`` counts the words that were scored by an n-gram of n words.
    """
    spark = docs.sparkSession
    groups = stage(document_groups(docs), "word-groups")
    corpus_words = groups.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(corpus_words / BUCKET_NGRAMS))
    answers = None
    for level in range(order):
        # Level by level, so that the n-grams of one level only are on the way at a time.
        told = asked_ngrams(groups, level, buckets).groupBy("bucket").applyInArrow(joined_counts(level), _TOLD)
        told = stage(told, f"ngram-answers-{level + 1}")
        answers = told if answers is None else answers.unionByName(told)
    names = [f"hits_{n}" for n in range(1, order + 1)]
    schema = "doc_id long, n_words long, score_micro long, mean_log10 double, " + ", ".join(f"{n} long" for n in names)

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        told = told.sort_by([("level", "ascending"), ("bucket", "ascending")])
        of, widths, lists = told.column("level").to_numpy(), told.column("width").to_numpy(), told.column("elsewhere")
        outside = []
        for level in range(order):
            rows = [np.frombuffer(lists[r].as_buffer(), f"u{widths[r]}") for r in np.flatnonzero(of == level).tolist()]
            outside.append(np.concatenate([np.zeros(0, np.uint8), *rows]))
        del told, lists, rows
        parts = []
        for ids, sizes, words in _groups_in(own):
            micro, by_level = scores(Group(sizes, words, order), outside, corpus_words, alpha)
            mean = np.where(sizes > 0, micro / MICRO / np.maximum(sizes, 1), 0.0)
            columns = [ids, *(pa.array(c) for c in (sizes, micro, mean, *by_level.T))]
            parts.append(pa.table(columns, names=["doc_id", "n_words", "score_micro", "mean_log10", *names]))
        return_memory()
        return pa.concat_tables(parts)

    return groups.select("grp", *_IN_GROUP).groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(finish, schema)
