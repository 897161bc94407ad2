"""Vector codes: each part of a vector by the number of the nearest entry of its part's codebook.

The codebooks are trained by Lloyd's rounds in Hamerly's form. A vector keeps,
for each part, the number of its entry, an upper bound of the distance to it
and a lower bound of the distance to the second-nearest entry. When entries
move, the bounds move by as much. A part whose upper bound is strictly below
its lower bound, or below half the distance from its entry to the next one,
keeps its entry; else its upper bound is made exact, and only if that doesn't
decide is it compared with all entries, in whole numbers. Ties go to the lower
number: an undecided bound never keeps an entry. Bounds are rounded outwards.

Numbers and bounds are columns of a table written after each round, without a
shuffle. New entries come from sums made in each task, of ``entries`` x ``dim``
rows whatever the input. The driver holds the codebooks only, of that size.

Defined results: components are turned into floor(scale * x), computed in double
precision; from 2**63 on they are cut to the range of a long. Vectors that are
null, empty, or hold a null or non-finite component take no part, nor do those
whose length isn't the most frequent one (of equally frequent ones the longest).
A length that the number of parts doesn't divide is refused. Null vec_ids come
last; rows that repeat a vec_id are vectors of their own, in the order of their
components. Fewer vectors than entries give as many entries as vectors. Errors
beyond a long are cut to its range. Other columns are passed over; without
vectors the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.batches import bound_batches
from evalmill.session import discard, stage

#: Squared distances up to here are exact in double precision.
EXACT = 1 << 53
LONGEST = (1 << 63) - 1
#: Bounds are widened by this factor at each step, far beyond what rounding can lose.
WIDER = 1 + 1e-12

STATE = "code binary, upper array<double>, lower array<double>, scans int"


class Codebooks:
    """Entries (parts x entries x length of a part), with their distances and what they moved by last."""

    def __init__(self, entries: np.ndarray, before: Codebooks | None = None):
        self.entries = entries
        self.parts, self.size, self.width = entries.shape
        self.largest = max(map(abs, entries.ravel().tolist()), default=0)
        gaps = np.stack([self._squares(p, entries[p]) for p in range(self.parts)])
        for p in range(self.parts):
            np.fill_diagonal(gaps[p], np.inf)
        #: Half the distance from each entry to the next one.
        self.half = np.sqrt(gaps.min(2).astype(np.float64)) / 2 / WIDER
        if before is not None:
            moved = entries.astype(object) - before.entries.astype(object)
            self.moved = np.sqrt((moved * moved).sum(2).astype(np.float64)) * WIDER
            #: The farthest that any other entry moved.
            order = np.argsort(self.moved, axis=1)
            most, next_most = order[:, -1], order[:, -2 if self.size > 1 else -1]
            rows = np.arange(self.parts)
            others = np.repeat(self.moved[rows, most][:, None], self.size, 1)
            others[rows, most] = self.moved[rows, next_most]
            self.others_moved = others

    def _small(self, x: np.ndarray) -> bool:
        largest = max(self.largest, int(max(x.max(initial=0), -x.min(initial=0))))
        return 4 * self.width * largest * largest < EXACT

    def _squares(self, part: int, x: np.ndarray) -> np.ndarray:
        """Squared distances (rows x entries): doubles where these are exact, else Python's integers as objects."""
        c = self.entries[part]
        if self._small(x):
            x, c = x.astype(np.float64), c.astype(np.float64)
            return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        gap = x.astype(object)[:, None, :] - c.astype(object)[None]
        return (gap * gap).sum(2)

    def own_squares(self, part: int, x: np.ndarray, code: np.ndarray) -> np.ndarray:
        c = self.entries[part][code]
        gap = x - c if self._small(x) else x.astype(object) - c.astype(object)
        return (gap * gap).sum(1)

    def scan(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest entry, upper bound, lower bound of the second-nearest), by comparison with all entries."""
        squares = self._squares(part, x)
        rows = np.arange(len(x))
        code = squares.argmin(1)
        upper = np.sqrt(squares[rows, code].astype(np.float64)) * WIDER
        squares[rows, code] = np.inf
        return code, upper, np.sqrt(squares.min(1).astype(np.float64)) / WIDER

    def assign(self, vectors: np.ndarray, state: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, ...]:
        """(codes, upper, lower, scans of each vector) under these entries, from the state under the ones before."""
        n = len(vectors)
        parts = vectors.reshape(n, self.parts, self.width)
        scans = np.zeros(n, np.int32)
        if state is None:
            code, upper, lower = np.zeros((n, self.parts), np.uint8), *np.zeros((2, n, self.parts))
        else:
            code, upper, lower = (s.copy() for s in state)
        for p in range(self.parts):
            todo = np.arange(n)
            if state is not None:
                at = code[:, p]
                upper[:, p] = (upper[:, p] + self.moved[p, at]) * WIDER
                lower[:, p] = np.maximum(lower[:, p] - self.others_moved[p, at], 0) / WIDER
                safe = np.maximum(lower[:, p], self.half[p, at])
                todo = np.flatnonzero(~(upper[:, p] < safe))
                exact = self.own_squares(p, parts[todo, p], at[todo]).astype(np.float64)
                upper[todo, p] = np.sqrt(exact) * WIDER
                todo = todo[~(upper[todo, p] < safe[todo])]
            if len(todo):
                code[todo, p], upper[todo, p], lower[todo, p] = self.scan(p, parts[todo, p])
                scans[todo] += 1
        return code, upper, lower, scans

    def errors(self, vectors: np.ndarray, code: np.ndarray) -> list[int]:
        """Squared distances to the assigned entries, summed over the parts."""
        parts = vectors.reshape(len(vectors), self.parts, self.width)
        total = sum(self.own_squares(p, parts[:, p], code[:, p]).astype(object) for p in range(self.parts))
        return [min(int(x), LONGEST) for x in np.atleast_1d(total).tolist()]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, whole) of the vectors that take part, in whole numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col("vector")
    named = vectors.select(vectors["vec_id"], vectors["label"], vectors["embedding"].cast("array<double>").alias("vector"))
    usable = named.filter(vector.isNotNull() & (F.size(vector) > 0)).filter(F.forall(vector, finite))
    whole = F.transform(vector, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    return usable.select("vec_id", "label", whole.alias("whole"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _codes(column: pa.BinaryArray, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(matrix.ravel()))


def assigned(rows: DataFrame, books: Codebooks, first: bool) -> DataFrame:
    """``rows`` with their state under ``books``; all but the first round start from the state they have."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            state = None
            if not first:
                state = _codes(batch.column("code"), books.parts), _matrix(batch.column("upper")), _matrix(batch.column("lower"))
            code, upper, lower, scans = books.assign(_matrix(batch.column("whole")), state)
            columns = [batch.column(c) for c in ("vec_id", "label", "whole")]
            columns += [pa.array([c.tobytes() for c in code], pa.binary()), _lists(upper), _lists(lower), pa.array(scans)]
            yield pa.record_batch(columns, names=["vec_id", "label", "whole", "code", "upper", "lower", "scans"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("vec_id", "label", "whole"))
    return rows.mapInArrow(each, f"{schema}, {STATE}")


def part_sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int, int], tuple[int, int]]:
    """{(part, entry, position): (sum, count)} of the components assigned to each entry: entries x dim figures."""
    parts, size, width = books.entries.shape

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, size, width), object)
        counts = np.zeros((parts, size), np.int64)
        for batch in batches:
            whole = _matrix(batch.column("whole")).reshape(batch.num_rows, parts, width)
            if max(abs(int(whole.max(initial=0))), abs(int(whole.min(initial=0)))) * max(len(whole), 1) > LONGEST:
                whole = whole.astype(object)
            code = _codes(batch.column("code"), parts)
            for p in range(parts):
                added = np.zeros((size, width), whole.dtype)
                np.add.at(added, code[:, p], whole[:, p])
                totals[p] += added.astype(object)
                counts[p] += np.bincount(code[:, p], minlength=size)
        p, e, i = np.nonzero(np.repeat(counts[:, :, None], width, 2))
        total = pa.array([Decimal(int(t)) for t in totals[p, e, i]], pa.decimal128(38, 0))
        columns = [pa.array(x, pa.int32()) for x in (p, e, i)] + [total, pa.array(counts[p, e])]
        yield pa.record_batch(columns, names=["part", "entry", "position", "total", "n"])

    sums = rows.select("whole", "code").mapInArrow(each, "part int, entry int, position int, total decimal(38,0), n long")
    found = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return {(r.part, r.entry, r.position): (int(r.total), r.n) for r in found.collect()}


def moved(books: Codebooks, sums: dict[tuple[int, int, int], tuple[int, int]]) -> Codebooks:
    """The codebooks of the floored means; entries without a part stay."""
    entries = books.entries.copy()
    for at, (total, n) in sums.items():
        entries[at] = total // n
    return Codebooks(entries, books)


def first_books(rows: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors with the smallest vec_ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "whole").limit(entries).select("whole").collect()
    if not first:
        return None
    whole = np.array([r.whole for r in first], np.int64)
    return Codebooks(np.ascontiguousarray(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2)))


def trained_codes(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0
) -> tuple[DataFrame, Codebooks | None]:
    """((vec_id, label, code, error, scans) of each vector that takes part, the final codebooks).

    ``scans`` counts the parts of a vector that the last assignment compared with
    all entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte")
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = stage(whole_vectors(vectors, scale), "whole-vectors")
    lengths = rows.groupBy(F.size("whole").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if usual is None:
        kinds = dict(rows.dtypes)
        return spark.createDataFrame(
            [], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long, scans int"
        ), None
    if usual.dim % parts:
        raise ValueError(f"{parts} equal parts of vectors of {usual.dim}")
    books = first_books(rows.filter(F.size("whole") == usual.dim), parts, entries)
    state = rows.filter(F.size("whole") == usual.dim)
    for number in range(rounds + 1):
        now = stage(assigned(state, books, number == 0), f"vector-state-{number}")
        discard(rows)
        rows = state = now
        if number < rounds:
            books = moved(books, part_sums(state, books))
    return coded(state, books), books


def coded(state: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error, scans) of a state under its codebooks."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                errors = books.errors(_matrix(batch.column("whole")), _codes(batch.column("code"), books.parts))
                columns = [batch.column(c) for c in ("vec_id", "label", "code")] + [pa.array(errors, pa.int64()), batch.column("scans")]
                yield pa.record_batch(columns, names=["vec_id", "label", "code", "error", "scans"])

    kinds = dict(state.dtypes)
    chosen = state.select("vec_id", "label", "whole", "code", "scans")
    return chosen.mapInArrow(each, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long, scans int")


def coded_with_label_errors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, code in hexadecimal, error, label_error, codebooks_sha256); null labels count as one label.

    The sums of the labels are written, so that a label of many rows meets them
    in as many tasks as adaptive execution cuts it into.
    """
    codes, books = trained_codes(vectors, parts, entries, rounds)
    codes = stage(codes.drop("scans"), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)"))
    sums = stage(codes.groupBy(F.col("label").alias("of")).agg(total.cast("long").alias("label_error")), "label-errors")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )
