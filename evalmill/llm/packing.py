"""Best-fit packing of token sequences after a Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. The packing itself is
planned over the histogram of piece lengths, which has at most ``capacity``
entries whatever the size of the corpus: a plan is a list of patterns (lengths
that share a sequence) with the number of sequences of each. The reduction
first fixes the patterns that dominate all alternatives for their longest
piece, the rest is packed best-fit in decreasing order, many equal sequences at
a time. Pieces then find their sequence by their rank among the pieces of their
length, which salted counts give without gathering a length in one task.

Defined results: a null text is empty and has the end id alone; a piece of just
``capacity`` tokens has a sequence of its own; pieces of equal length are
ranked by salt, doc_id and piece, repeated rows in any order. Sequence numbers
are dense from 0. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm.batches import bound_batches, remembered, return_memory
from evalmill.session import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Latin-1 texts, whose normal form is themselves and whose classes are known here.
_LATIN = re.compile("[\x00-\x1b\x20-\x84\x86-\xff]*")
_WORD = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \xa00-9a-zªµºß-öø-ÿ²³¹¼½¾]+"
)
#: Words that a Python worker remembers at most, some 200 bytes each.
MEMORY = 600_000


class WordEncoder:
    """Ids of whole texts of a tokenizer that lower-cases, splits by kind of character and marks ends of words.

    The words of a Latin-1 text are found here, by the tokenizer's own pattern;
    each word's ids don't depend on its neighbours, so they are remembered. New
    words are encoded many at a time, and told apart by the ends of words.
    Other texts, and those that hold the content of an added token, go to the
    tokenizer as they are.
    """

    def __init__(self, definition: str, most: int = MEMORY):
        from tokenizers import Tokenizer

        self.most = most

        spec = json.loads(definition)
        splits = json.dumps(spec.get("pre_tokenizer"), ensure_ascii=False)
        lower = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.by_word = lower and r"[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in splits
        self.tokenizer = Tokenizer.from_str(definition)
        added = [t["content"].lower() for t in spec.get("added_tokens") or [] if t["content"]]
        # With white space in it, an added token could arise where words are put side by side.
        self.by_word = self.by_word and not any(re.search(r"\s", content) for content in added)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.memory: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4") for f in found]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 2048):
            some = words[at : at + 2048]
            ids = self._ids([" ".join(some)])[0]
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(some):
                raise ValueError("the tokenizer finds other words than its pattern")
            raw = ids.tobytes()
            for word, i, j in zip(some, [0, *stops], stops, strict=False):
                self.memory[word] = raw[4 * i : 4 * j]

    def _apart(self, text: str) -> bool:
        """Whether the words of a text are found here."""
        return self.by_word and bool(_LATIN.fullmatch(text)) and not self.added.search(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memory) > self.most:
            self.memory.clear()
        words = [_WORD.findall(t.lower()) if self._apart(t) else None for t in texts]
        self._learn(list(set().union(*filter(None, words)).difference(self.memory)))
        rest = iter(self._ids([t for t, w in zip(texts, words, strict=True) if w is None]))
        recall = self.memory.__getitem__
        return [next(rest).tobytes() if w is None else b"".join(map(recall, w)) for w in words]


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, most_words: int = MEMORY) -> DataFrame:
    """A row for each piece of each document, with the CRC-32 of its ids.

    ``most_words`` bounds what a worker remembers; fewer cost more encoding, and change no id.
    """
    bound_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    names = [part.split()[0] for part in PIECES.split(", ")]
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = remembered(("packing", definition.value, most_words), lambda: WordEncoder(definition.value, most_words))
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                for number, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, number, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        return_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, PIECES)


@dataclass
class Pattern:
    """Pieces of these lengths share a sequence, ``count`` times over."""

    lengths: tuple[int, ...]
    count: int


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix the patterns that dominate all others of some piece; what is left comes second.

    For each piece x, the longest first: if nothing fits beside it, x stands
    alone; if a piece fills the sequence with it, or only one more piece fits at
    all, the largest such piece dominates; if two more fit but not three, that
    piece still dominates when it is as large as any two that fit together.
    Otherwise x stays for the heuristic. A pattern is fixed as often as its
    pieces are there: what is removed makes no other set of x larger.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    fixed: list[Pattern] = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        fixed.append(Pattern(lengths, times))
        for n in lengths:
            left[n] -= times
            if not left[n]:
                del left[n]
                order.remove(n)

    order = sorted(left)
    for x in order[::-1]:
        while left.get(x):
            room = capacity - x
            at = bisect_right(order, room) - 1
            if at >= 0 and order[at] == x and left[x] < 2:
                at -= 1
            if at < 0:
                fix((x,), left[x])
                continue
            best = order[at]
            two, three = _smallest(order, left, x, 2), _smallest(order, left, x, 3)
            if best != room and two is not None and two <= room:
                if three is not None and three <= room or best < _largest_pair(order, left, room, x):
                    break
            fix((x, best), left[x] // 2 if best == x else min(left[x], left[best]))
    return fixed, left


def _smallest(order: list[int], left: dict[int, int], but: int, many: int) -> int | None:
    """The sum of the ``many`` smallest pieces left, one of length ``but`` set aside."""
    total = 0
    for n in order:
        there = left.get(n, 0) - (n == but)
        if (take := min(there, many)) > 0:
            total += take * n
            many -= take
        if not many:
            return total
    return None


def _largest_pair(order: list[int], left: dict[int, int], room: int, but: int) -> int:
    """The largest sum of two pieces left, beside one of length ``but``, within ``room``."""
    there = [n for n in order if left.get(n, 0) - (n == but) > 0]
    best, high = 0, len(there) - 1
    for low, n in enumerate(there):
        while high > low and n + there[high] > room:
            high -= 1
        if high > low:
            best = max(best, n + there[high])
        if left[n] - (n == but) > 1 and 2 * n <= room:
            best = max(best, 2 * n)
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: all sequences of one pattern move together."""
    open_at: dict[int, Counter] = {}
    rooms: list[int] = []

    def put(lengths: tuple[int, ...], count: int) -> None:
        room = capacity - sum(lengths)
        if room not in open_at:
            open_at[room] = Counter()
            rooms.insert(bisect_right(rooms, room), room)
        open_at[room][lengths] += count

    def take(room: int, lengths: tuple[int, ...], count: int) -> None:
        group = open_at[room]
        group[lengths] -= count
        if not group[lengths]:
            del group[lengths]
        if not group:
            del open_at[room]
            rooms.remove(room)

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_right(rooms, n - 1)
            if at == len(rooms):
                fill = min(capacity // n, todo)
                times = todo // fill
                put((n,) * fill, times)
                todo -= fill * times
                continue
            room = rooms[at]
            lengths, there = next(iter(open_at[room].items()))
            fill = min(room // n, todo)
            times = min(there, todo // fill)
            take(room, lengths, times)
            put(lengths + (n,) * fill, times)
            todo -= fill * times
    return [Pattern(p, c) for group in open_at.values() for p, c in group.items()]


def plan(counts: dict[int, int], capacity: int = 4096) -> list[Pattern]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) of each run of equal places.

    The pieces of a length take their places by rank; a run covers the same
    place of successive sequences.
    """
    out, next_rank, sequence = [], Counter(), 0
    for p in patterns:
        offset = 0
        for n in p.lengths:
            out.append((n, next_rank[n], next_rank[n] + p.count, sequence, offset))
            next_rank[n] += p.count
            offset += n
        sequence += p.count
    return out


def ranked_by_length(pieces: DataFrame, salts: int) -> DataFrame:
    """``pieces`` with ``rank``, from 0 without gaps within each length.

    Ranks are counted within (length, salt) and moved by the counts of the
    salts before, so that one length may hold most of the rows.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    local = salted.withColumn("local", F.row_number().over(within) - 1)
    return local.join(moved, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local")).drop(
        "salt", "local", "before"
    )


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (as of :func:`token_pieces`) with sequence_id and offset.

    The driver sees the histogram of lengths, at most ``capacity`` rows, and
    makes the table of runs, which grows with that histogram and not with the
    rows; it is broadcast.
    """
    spark = pieces.sparkSession
    pieces = stage(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(
        slots(plan(counts, capacity)), "slot_length long, first long, end long, first_sequence long, offset long"
    )
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = ranked_by_length(pieces, salts)
    place = (
        (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end"))
    )
    return ranked.join(F.broadcast(runs), place).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset",
    )
