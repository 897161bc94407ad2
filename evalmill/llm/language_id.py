"""Language identification of mixed texts: script ranges, then Viterbi over words.

A model holds, for each language, the log probability of character n-grams with
word borders, learned from labelled documents. For each word, the script of its
letters narrows the candidates to the languages that are written in it; the
candidates are scored by their n-grams, and the best path through all words of
a text, with a penalty for every change of language, labels its spans.

Defined results: a text that is null or has no letter is ``und`` with score 0
and has no spans. Languages tie to the alphabetically first. A word in a script
of no learned language says nothing: a text of such words only gets the
language with the most training text, with score 0, and is not accepted. Texts
of any length are labelled whole. A table without usable labels gives a model
of no language: every text is ``und`` with score 0, and none with a letter is
rejected. Empty tables to label give empty results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.batches import bound_batches, remembered, return_memory

UNKNOWN = "und"
# First code points of script ranges, and the script that begins there ("" for none).
SCRIPT_STARTS = [
    (0x0000, ""), (0x0041, "Latin"), (0x005B, ""), (0x0061, "Latin"), (0x007B, ""), (0x00AA, "Latin"),
    (0x00AB, ""), (0x00BA, "Latin"), (0x00BB, ""), (0x00C0, "Latin"), (0x02B0, ""), (0x0370, "Greek"),
    (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, ""),
    (0x0750, "Arabic"), (0x0780, ""), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, ""), (0x0B80, "Tamil"), (0x0C00, "Telugu"),
    (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, ""), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3130, "Hangul"), (0x3190, ""), (0x3400, "Han"),
    (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD800, ""), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB07, ""), (0x20000, "Han"), (0x32000, ""),
]
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
_NAMES = sorted({n for _, n in SCRIPT_STARTS})
_SCRIPT = np.array([_NAMES.index(n) for _, n in SCRIPT_STARTS], np.int8)
_WORDS = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3, 4)
#: Buckets of the n-gram table; n-grams are hashed into it.
BUCKETS = 1 << 18
#: Languages of a model at most: a megabyte each is collected and broadcast.
MOST = 256
#: Words that a Python worker remembers at most, and words of the texts labelled together.
MEMORY = 300_000
TOGETHER = 500_000
#: Rows and megabytes of text that are split into words at a time.
BATCH = 1000, 4


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    words = _WORDS.findall(text.lower())
    if "".join(words).isalpha() or not words:
        return words
    # Fractions, numerals in circles and the like are word characters to ``re``, but no letters.
    apart = "".join(c if c.isalpha() else " " for c in " ".join(words))
    return apart.split()


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets of all words, the first place of each word in them, and each word's script."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    script = _SCRIPT[np.searchsorted(_STARTS, codes[ends - sizes + 1].astype(np.int64), side="right") - 1]
    grams, owners = [], []
    mixed = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        part = codes[n - 1 :]
        mixed = (mixed[: len(part)] + part + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        if n in ORDERS:
            inside = of[: len(part)] == of[n - 1 :]
            if n == 1:
                inside = inside & (part > 3)
            grams.append((mixed[inside] % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(of[: len(part)][inside])
    gram, owner = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(len(words)))
    return gram[order], first, script


@dataclass
class Model:
    languages: list[str]
    log_odds: np.ndarray  # (buckets, languages)
    scripts: np.ndarray  # (scripts, languages): whether the language is written in it
    prior: int
    penalty: float = 12.0
    rows: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not self.languages:
            return np.zeros((len(words), 0), np.float32)
        gram, first, script = word_features(words)
        found = np.add.reduceat(self.log_odds[gram], first, axis=0)
        allowed = self.scripts[script]
        found = np.where(allowed, found, found.min(1, keepdims=True) - 3 * self.penalty)
        # The same for all languages, this tells words in the script of a language from those that say nothing.
        found += 1
        found[~allowed.any(1)] = 0
        return found.astype(np.float32)

    def forget(self) -> None:
        """Drop the remembered words: an idle Python worker holds none."""
        self.rows, self.scores, self.letters = {}, None, None
        return_memory()

    def look_up(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the row of each of its words in ``scores`` and ``letters``."""
        split = [words_of(t) for t in texts]
        new = list(set().union(*split).difference(self.rows))
        if self.scores is None or len(self.rows) + len(new) > MEMORY:
            self.rows, self.scores, self.letters = {}, np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int32)
            new = list(set().union(*split))
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            parts = [self.word_scores(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            self.scores = np.concatenate([self.scores, *parts])
            self.letters = np.concatenate([self.letters, np.fromiter(map(len, new), np.int32, len(new))])
        row = self.rows.__getitem__
        return [np.fromiter(map(row, words), np.int64, len(words)) for words in split]


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each row of ``scores`` for many sequences, one place of all of them at a time.

    Sequence i has the rows starts[i] to starts[i] + sizes[i]; a step to another
    state costs ``penalty``.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    back = np.zeros(scores.shape, np.int16)
    states = np.arange(scores.shape[1], dtype=np.int16)
    best = np.zeros((len(sizes), scores.shape[1]), np.float32)
    for t in range(longest):
        n = active[t]
        rows = starts[:n] + t
        now = best[:n]
        if t:
            top = now.argmax(1)
            jump = np.take_along_axis(now, top[:, None], 1) - penalty
            stay = now >= jump
            back[rows] = np.where(stay, states, top[:, None])
            now = np.where(stay, now, jump)
        now = now + scores[rows]
        best[:n] = now - now.max(1, keepdims=True)
    path = np.zeros(len(scores), np.int16)
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        rows = starts[:n] + t
        path[rows] = state[:n]
        if t:
            state[:n] = back[rows, state[:n]]
    return path


def label_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans) of each text; a span is (first word, end word, language).

    The language has the most letters in its spans; the score is its share.
    """
    words = model.look_up([t or "" for t in texts])
    return _label(model, words, model.scores, model.letters)


def _label(model: Model, words: list[np.ndarray], scores: np.ndarray, letters: np.ndarray) -> list:
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    rows = np.concatenate(words) if len(words) else np.zeros(0, np.int64)
    path = viterbi(scores[rows], starts, sizes, model.penalty) if model.languages else np.zeros(len(rows), np.int16)
    weight, known = letters[rows], (scores[rows] != 0).any(1)
    differ = scores[rows].max(1, initial=-np.inf) != scores[rows].min(1, initial=np.inf)
    out = []
    for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        if not size or not model.languages:
            out.append((UNKNOWN, 0.0, []))
            continue
        part = path[start : start + size]
        total = np.bincount(part, weight[start : start + size], len(model.languages))
        told = known[start : start + size].any()
        apart = differ[start : start + size].any()
        best = int(total.argmax()) if apart else model.prior
        share = float(total[best] / total.sum()) if apart else 1 / len(model.languages)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), size]
        spans = [(i, j, model.languages[part[i]]) for i, j in zip(cuts, cuts[1:], strict=False)]
        out.append((model.languages[best], share if told else 0.0, spans))
    return out


def train(labelled: DataFrame, per_language: int = 3000) -> Model:
    """Learn a model from (doc_id, text, lang): a sample of about ``per_language`` documents of each.

    The sample is bounded by this parameter: rows are taken by a hash of their
    doc_id, with the share that gives that many. Counting is done in the
    executors; the driver gets the n-gram counts of each language, at most
    ``BUCKETS`` of them.
    """
    spark = labelled.sparkSession
    labelled = labelled.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 20))
    keep = F.lit(False)
    for lang, n in sorted(sizes.items()):
        share = min(1.0, per_language / n)
        keep = keep | ((F.col("lang") == lang) & (draw < int(share * (1 << 20)) + 1))
    bound_batches(spark, *BATCH)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("language_id", dict)
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                gram, _, script = word_features(words)
                # Each n-gram counts once for a document's share of the corpus: long texts don't drown short ones.
                there, times = np.unique(gram, return_counts=True)
                into = grams.setdefault(lang, np.zeros(BUCKETS))
                into[there] += times / np.sqrt(len(gram))
                scripts.setdefault(lang, Counter()).update(script.tolist())
        for lang, into in grams.items():
            there = np.flatnonzero(into)
            yield pa.record_batch(
                [
                    pa.array([lang] * (len(there) + len(scripts[lang]))),
                    pa.array(np.concatenate([there, -1 - np.array(list(scripts[lang]), np.int64)])),
                    pa.array(np.concatenate([into[there], np.array(list(scripts[lang].values()), float)])),
                ],
                names=["lang", "gram", "n"],
            )

    counted = labelled.filter(keep).select("lang", "text").mapInArrow(count, "lang string, gram long, n double")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(summed.column("lang").to_pylist()))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(_NAMES), 0), bool), 0)
    if len(languages) > MOST:
        raise ValueError(f"{len(languages)} languages are more than {MOST}, which is what the broadcast model may hold")
    place = {lang: i for i, lang in enumerate(languages)}
    of = np.array([place[x] for x in summed.column("lang").to_pylist()])
    gram, n = summed.column("gram").to_numpy(), summed.column("n").to_numpy()
    table = np.zeros((BUCKETS, len(languages)))
    counts = gram >= 0
    table[gram[counts], of[counts]] = n[counts]
    used = np.zeros((len(_NAMES), len(languages)))
    used[-1 - gram[~counts], of[~counts]] = n[~counts]
    smooth = 0.01
    logs = np.log((table + smooth) / (table.sum(0) + smooth * BUCKETS))
    logs -= logs.mean(1, keepdims=True)
    logs[table.sum(1) == 0] = 0
    written = used >= 0.01 * used.sum(0)
    written[_NAMES.index("")] = True
    most = max(languages, key=lambda lang: (sizes.get(lang, 0), lang))
    return Model(languages, logs.astype(np.float32), written, place[most])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    bound_batches(docs.sparkSession, *BATCH)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        ids, rows, scores, letters, held = [], [], None, None, 0

        def flush() -> pa.RecordBatch:
            found = _label(own, rows, scores, letters)
            columns = [pa.array(ids, pa.int64()), pa.array([f[0] for f in found]), pa.array([f[1] for f in found])]
            return pa.record_batch(columns, names=["doc_id", "lang_pred", "score"])

        for batch in batches:
            before = own.rows
            looked = own.look_up([t or "" for t in batch.column("text").to_pylist()])
            if rows and own.rows is not before:
                yield flush()  # these rows point into the words that were just forgotten
                ids, rows, held = [], [], 0
            scores, letters = own.scores, own.letters
            ids += batch.column("doc_id").to_pylist()
            rows += looked
            held += sum(map(len, looked))
            if held > TOGETHER:
                yield flush()
                ids, rows, held = [], [], 0
        if ids:
            yield flush()
        rows, scores, letters = [], None, None
        own.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        each, "doc_id long, lang_pred string, score double"
    )


def fold(doc_id: str = "doc_id"):
    """The fold of a document: crc32 of its id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def learned_from(docs: DataFrame, held_out: int = 2, per_language: int = 3000) -> Model:
    """A model from all folds of ``docs`` but one."""
    return train(docs.filter(fold() != held_out).select("doc_id", "text", "lang"), per_language)


def accepted_documents(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The documents with a language, in at least the share ``least`` of their letters; all columns stay.

    A text none of whose words is in the script of a learned language goes, and so does one without letters.
    """
    bound_batches(docs.sparkSession, *BATCH)
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.schema["text"].name

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("language_id", dict)
        for batch in batches:
            found = label_texts(shared.value, batch.column(columns.index(text)).to_pylist())
            if shared.value.languages:
                kept = [score > 0 and score >= least for _, score, _ in found]
            else:
                kept = [bool(words_of(t or "")) for t in batch.column(columns.index(text)).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))
        shared.value.forget()

    return docs.mapInArrow(each, docs.schema)
