"""How far the sources of a language differ in the words they use.

Terms are runs of letters. A source's smoothed share of a term, in parts of
10**9, is compared with that of each other source, summed over all terms, and
with that of the whole language, term by term: f = (p - q)**2 / (p + q), in
whole numbers.

Many terms, above all rare ones, have the very same counts in the same sources.
So terms are grouped by their sparse vector of (source, count); the sum over
all terms takes each pair of sources once for each distinct vector, times the
number of terms that have it. Where neither source of a pair has a term, f is
the same for all such terms, and only their number counts. The ranking of terms
is of the terms themselves.

Documents are read twice, once without the texts. Terms are counted in each task
before they are shuffled; so are distinct vectors, and ranks are cut in each
task first. Pairs are summed in numpy over batches of
vectors; a task sends one figure for each pair of sources of a language.

Defined results: a null text, lang or source counts as ''. A group without terms
has all its p alike. A language none of whose terms is frequent enough has value
0 for all pairs. A language of one source has no pairs. Ties go to the item that
comes first by its bytes. Rows that repeat a doc_id are documents of their own.
Other columns are passed over. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalmill.llm.batches import bound_batches
from evalmill.session import stage

#: A text's bytes with A-Z lower-cased and all other ASCII as blanks; what is beyond ASCII is part of a term.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Bytes of a text that are split at a time, and counts that a task holds.
PIECE, MOST_HELD = 1 << 20, 200_000
PARTS = 1_000_000_000


def pieces_of_terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of bounded size."""
    letters = text.translate(LETTERS)
    since = 0
    while since < len(letters):
        until = letters.find(b" ", since + PIECE)
        until = len(letters) if until < 0 else until
        yield letters[since:until].split()
        since = until


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 (count + 2) / (total + 2 kept)), exact for any count."""
    return F.expr(f"1 + (cast({PARTS} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div ({total} + 2 * {kept})")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term.

    Texts are split as bytes, which is the same as splitting characters: a
    term's neighbours are ASCII. Each task counts before it sends anything, and
    sends its counts when it holds ``MOST_HELD``.
    """
    named = docs.select(
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"),
        F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"),
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
                same = lambda x, size=len(n): pa.array([x]).take(pa.array(np.zeros(size, np.int64)))
                columns = [same(lang), same(source), terms, pa.array(n.values(), pa.int64())]
                yield pa.record_batch([*columns, pa.array([in_docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                distinct: set[bytes] = set()
                for terms in pieces_of_terms(text):
                    n.update(terms)
                    distinct.update(terms)
                in_docs.update(distinct)
            if sum(len(n) for n, _ in held.values()) > MOST_HELD:
                yield from sent()
        yield from sent()

    counted = named.mapInArrow(each, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, n, vector) of the terms in enough documents of the language; ``vector`` holds (source, n) by source."""
    return (
        counts.groupBy("lang", "term")
        .agg(
            F.sum("docs").alias("docs"),
            F.sum("n").alias("n"),
            F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"),
        )
        .filter(F.col("docs") >= least_docs)
        .drop("docs")
    )


def group_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, kept, lang_total) of each group that occurs; ``kept`` counts the terms of the language."""
    groups = docs.select(
        F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("lang"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("source"),
    ).distinct()
    each = terms.select("lang", F.explode("vector").alias("v")).select("lang", "v.source", "v.n")
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", zero("total"), zero("kept"), zero("lang_total")
    )


def distinct_vectors(terms: DataFrame) -> DataFrame:
    """(lang, vector, copies): each vector of counts once, with the number of terms that have it."""
    return terms.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("copies"))


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def sum_of_pairs(shares: np.ndarray, present: np.ndarray, absent: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over vectors (rows), for each pair of sources: the sum of f where either source has the terms, and their number.

    ``shares`` (vectors x sources) holds ``absent`` where the source has no count.
    """
    n = shares.shape[1]
    values, touched = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
    for s in range(n):
        # Vectors without the source: against the sources that they have.
        has = np.flatnonzero(present[:, s])
        if len(has):
            f = _divergences(shares[has, s, None], shares[has]) * copies[has, None]
            values[s] += f.sum(0)
            touched[s] += copies[has].sum()
            only = ~present[has]
            # The other direction, where the other source has no count, isn't met again.
            values[:, s] += (f * only).sum(0)
            touched[:, s] += (copies[has, None] * only).sum(0)
    return values, touched


def pair_sums(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over all kept terms, for each two sources of a language.

    ``vectors`` are the distinct ones. A batch of them is expanded to matrices of
    as many columns as its language has sources.
    """
    absent = share("0", "total", "kept")
    sources = F.array_sort(F.collect_list(F.struct("source", "total", absent.alias("absent"))))
    table = stage(groups.filter("kept > 0").groupBy("lang", "kept").agg(sources.alias("sources")), "divergence-sources")
    # Shares of the counts that a vector has; the place of a source in its language stands for it.
    shares = F.expr(
        "transform(vector, v -> struct(cast(array_position(names, v.source) as int) - 1 as at, "
        f"1 + (cast({PARTS} as decimal(10,0)) * cast(v.n + 2 as decimal(20,0))) div "
        "(totals[array_position(names, v.source) - 1] + 2 * kept) as p))"
    )
    named = table.select(
        "lang",
        "kept",
        F.expr("transform(sources, s -> s.source)").alias("names"),
        F.expr("transform(sources, s -> s.total)").alias("totals"),
        F.expr("transform(sources, s -> s.absent)").alias("absent"),
    )
    met = vectors.join(named, "lang").select("lang", "copies", "absent", shares.alias("shares"))
    met = met.select("lang", "copies", "absent", F.col("shares.at").alias("at"), F.col("shares.p").alias("p"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                rows = batch.filter(pa.array(langs.indices.to_numpy() == code))
                zero = rows.column("absent")[0].values.to_numpy()
                # Some million cells at a time.
                step = max(1, 2_000_000 // len(zero))
                for since in range(0, rows.num_rows, step):
                    some = rows.slice(since, step)
                    sizes = some.column("at").value_lengths().to_numpy()
                    row = np.repeat(np.arange(some.num_rows), sizes)
                    at = some.column("at").flatten().to_numpy()
                    matrix = np.tile(zero, (some.num_rows, 1))
                    matrix[row, at] = some.column("p").flatten().to_numpy()
                    present = np.zeros(matrix.shape, bool)
                    present[row, at] = True
                    found = sum_of_pairs(matrix, present, zero, some.column("copies").to_numpy())
                    sums[lang] = tuple(a + b for a, b in zip(sums[lang], found, strict=True)) if lang in sums else found
        for lang, (values, touched) in sums.items():
            n = len(values)
            columns = [pa.array([lang] * (n * n)), pa.array(np.repeat(np.arange(n), n), pa.int32())]
            columns += [pa.array(np.tile(np.arange(n), n), pa.int32()), pa.array(values.ravel()), pa.array(touched.ravel())]
            yield pa.record_batch(columns, names=["lang", "a", "b", "value", "touched"])

    sums = met.mapInArrow(each, "lang string, a int, b int, value long, touched long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("touched").alias("touched")).filter("a <> b")
    ends = sums.join(table, "lang").select("lang", "kept", "value", "touched", F.expr("sources[a]").alias("s"), F.expr("sources[b]").alias("t"))
    rest = (F.col("kept") - F.col("touched")) * divergence("s.absent", "t.absent")
    return ends.select("lang", F.col("s.source").alias("source"), F.col("t.source").alias("item"), (F.col("value") + rest).alias("value"))


def all_pairs(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """The sums of pairs, and value 0 for the pairs of languages that keep no term."""
    none = groups.filter("kept = 0").select("lang", "source")
    other = none.select("lang", F.col("source").alias("item"))
    zeros = none.join(other, "lang").filter("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    return sums.unionByName(zeros)


def term_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has in a larger share than its language."""
    each = terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("vector").alias("v")).select(
        "lang", "term", "lang_n", "v.source", "v.n"
    )
    both = each.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q")
    )
    return both.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and the terms that set a group apart."""
    bound_batches(docs.sparkSession)
    terms = stage(kept_terms(term_counts(docs), least_docs), "divergence-terms")
    groups = stage(group_totals(docs, terms), "divergence-groups")
    vectors = stage(distinct_vectors(terms), "divergence-vectors")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(best).alias("rank")
    pairs = all_pairs(groups, pair_sums(vectors, groups)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    ranked = term_values(terms, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
    return pairs.unionByName(ranked.filter(F.col("rank") <= top_terms))
