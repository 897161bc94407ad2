"""Toxicity scores from a counterfactually regularised classifier.

A logistic model over words and beginnings of words is fitted with a penalty on
the change of a sentence's score when its identity terms are swapped for
others: what a group is called then carries no weight of its own, and neutral
mentions of a group aren't taken for insults. Terms are the names of groups in
a list and, from the labelled texts themselves, frequent words of no bearing on
the label: of each text one sentence with such words is swapped too.

A text's value of a feature is the share of its words that have it, scaled up
and capped at 1, so that a few insults weigh in a long text as in a short one
while a chance hit in thousands of words doesn't.

Defined results: a null or empty text, or one without words, has the score of
the model's
intercept; repeated rows score alike; texts are read whole. Labels
that are null are left out of the fit. A fit without both classes learns no
word: of n labels of which t are toxic every text scores t / (n + 1), so that
without labels nothing is toxic. Only the text is an input of a score. Empty
tables to score give empty results.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.batches import bound_batches, return_memory
from evalmill.llm.language_id import fold

# Terms for groups of people, by kind and language; terms of one list replace each other.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "buddhist", "hindu", "atheist", "catholic", "protestant"],
    ["muslims", "christians", "jews", "buddhists", "hindus", "atheists", "catholics", "protestants"],
    ["black", "white", "asian", "latino", "african", "european", "arab", "indian"],
    ["gay", "lesbian", "straight", "bisexual", "transgender", "queer"],
    ["immigrants", "refugees", "foreigners", "natives", "tourists"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus", "atheisten"],
    ["ausländer", "flüchtlinge", "einwanderer"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous", "athées"],
    ["immigrés", "réfugiés", "étrangers"],
    ["mujeres", "hombres", "niñas", "niños"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "ateos"],
    ["inmigrantes", "refugiados", "extranjeros"],
]
_SWAPS = {term: terms for terms in IDENTITY_TERMS for term in terms}
#: Of the words of no bearing: texts that have one at least, how many are taken, and how many replace each other.
NEUTRAL_TEXTS, NEUTRAL_WORDS, NEUTRAL_LIST = 20, 400, 4
_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"(?<=[.!?\n])\s+")
PREFIXES = range(4, 10)
#: A word's share of the text counts this many times, up to 1.
SCALE = 60.0
#: Words that a Python worker remembers at most.
MEMORY = 300_000
#: Rows and megabytes of text in a batch.
BATCH = 1000, 4


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


@lru_cache(maxsize=20_000)
def word_features(word: str) -> tuple[str, ...]:
    """The word itself and its longer beginnings, which inflected forms share."""
    return (word + "$", *(word[:n] for n in PREFIXES if n <= len(word)))


def feature_counts(words: Counter) -> Counter:
    found: Counter = Counter()
    for word, n in words.items():
        for feature in word_features(word):
            found[feature] += n
    return found


def neutral_terms(seen: list[Counter], texts: tuple[float, float]) -> dict[str, list[str]]:
    """For each word whose share of clean and of toxic texts is alike within a standard error: the words it is swapped with.

    ``seen`` counts the texts of either class that have a feature, ``texts`` all texts of either class. The most
    frequent such words are taken; words of nearly equal frequency replace each other.
    """
    every, n0, n1 = sum(texts), *texts
    found = []
    for feature in seen[0].keys() | seen[1].keys():
        both = seen[0][feature] + seen[1][feature]
        share = both / every
        error = np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
        if feature[-1] == "$" and both >= NEUTRAL_TEXTS and abs(seen[1][feature] / n1 - seen[0][feature] / n0) <= error:
            found.append((-both, feature[:-1]))
    words = [word for _, word in sorted(found)[:NEUTRAL_WORDS] if word not in _SWAPS]
    lists = [words[at : at + NEUTRAL_LIST] for at in range(0, len(words), NEUTRAL_LIST)]
    return {word: terms for terms in lists if len(terms) > 1 for word in terms}


def swapped(words: list[str], step: int, swaps: dict[str, list[str]] = _SWAPS) -> list[str]:
    """The same words with each term replaced by another of its list."""
    out = []
    for word in words:
        terms = swaps.get(word)
        out.append(terms[(terms.index(word) + step) % len(terms)] if terms and step % len(terms) else word)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float
    memory: dict[str, tuple] = field(default_factory=dict)

    def __post_init__(self):
        self.names = sorted(self.weights)
        self.place = {name: i for i, name in enumerate(self.names)}
        self.vector = [self.weights[n] for n in self.names]

    def forget(self) -> None:
        """Drop the remembered words: an idle Python worker holds none."""
        self.memory.clear()
        word_features.cache_clear()
        return_memory()

    def hits(self, word: str) -> tuple:
        found = tuple(self.place[f] for f in word_features(word) if f in self.place)
        self.memory[word] = found
        return found

    def score(self, text: str | None) -> float:
        """The probability that a text is toxic."""
        words = words_of(text)
        if len(self.memory) > MEMORY:
            self.memory.clear()
        memory, hits = self.memory, self.hits
        for word in set(words).difference(memory):
            hits(word)
        counts: Counter = Counter()
        for found in filter(None, map(memory.__getitem__, words)):
            counts.update(found)
        scale = SCALE / max(len(words), 1)
        total = self.intercept + sum(self.vector[i] * min(1.0, n * scale) for i, n in sorted(counts.items()))
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -40, 40))))


def _values(words: Counter, place: dict[str, int]) -> dict[int, float]:
    scale = SCALE / max(words.total(), 1)
    return {place[f]: min(1.0, n * scale) for f, n in feature_counts(words).items() if f in place}


def _matrix(rows: Iterable[dict[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sparse rows as (row, column, value), and how many rows there are."""
    at, columns, values, n = array("q"), array("q"), array("d"), 0
    for row in rows:
        at.extend([n] * len(row))
        columns.extend(row)
        values.extend(row.values())
        n += 1
    return np.array(at, np.int64), np.array(columns, np.int64), np.array(values, float), n


def _swap_changes(
    sentences: list[str], place: dict[str, int], swaps: dict[str, list[str]] = _SWAPS
) -> Iterator[dict[int, float]]:
    """For each sentence and swap of its terms: what changes in its features."""
    for sentence in sentences:
        words = words_of(sentence)
        here = _values(Counter(words), place)
        for step in (1, 2, 3):
            there = _values(Counter(swapped(words, step, swaps)), place)
            change = {i: here.get(i, 0) - there.get(i, 0) for i in here.keys() | there.keys()}
            if change := {i: v for i, v in change.items() if v}:
                yield change


def fit(
    examples: Iterable[tuple[str | None, int]],
    features: int = 3000,
    counterfactual: float = 5.0,
    ridge: float = 2e-4,
    rounds: int = 400,
) -> Model:
    """Fit from (text, label); ``counterfactual`` weighs the squared change of a swapped sentence's logit, on average over
    all sentences and swaps that change a feature.
    """
    texts, answers, sentences, samples = [], [], [], []
    same: dict[str, str] = {}  # one copy of each word, whatever the number of texts that have it
    for text, label in examples:
        found = Counter(words_of(text))
        texts.append(Counter({same.setdefault(w, w): n for w, n in found.items()}))
        answers.append(label)
        if not _SWAPS.keys().isdisjoint(found):
            sentences += [s for s in _SENTENCES.split(text) if not _SWAPS.keys().isdisjoint(words_of(s))]
        samples.append(max(_SENTENCES.split(text), key=lambda s: (min(len(s), 200), s)) if found else "")
    labels = np.array(answers, float)
    if not 0 < labels.sum() < len(labels):
        share = labels.sum() / (len(labels) + 1)
        return Model({}, float(np.log(share / (1 - share))) if share else -40.0)
    seen = [Counter(), Counter()]
    mass = [Counter(), Counter()]
    for words, y in zip(texts, labels.astype(int).tolist(), strict=True):
        scale = SCALE / max(words.total(), 1)
        for f, n in feature_counts(words).items():
            seen[y][f] += 1
            mass[y][f] += min(1.0, n * scale)
    n0, n1 = len(labels) - labels.sum(), labels.sum()
    gain = {
        f: abs(mass[1][f] / n1 - mass[0][f] / n0) * np.sqrt(seen[1][f] + seen[0][f])
        for f in seen[0].keys() | seen[1].keys()
        if seen[0][f] + seen[1][f] >= 4
    }
    names = sorted(sorted(gain), key=gain.get, reverse=True)[:features]
    names = sorted(set(names) | {f for t in _SWAPS for f in word_features(t)[:1] if f in gain})
    place = {f: i for i, f in enumerate(names)}
    neutral = neutral_terms(seen, (n0, n1))
    del gain, seen, mass
    at, columns, values, _ = _matrix(_values(w, place) for w in texts)
    changes = chain(_swap_changes(sentences, place), _swap_changes(samples, place, neutral))
    p_at, p_columns, p_values, pairs = _matrix(changes if counterfactual else ())
    del texts, sentences, samples, same
    word_features.cache_clear()
    return_memory()
    weight, bias = np.zeros(len(names)), float(np.log(n1 / n0))
    sample = np.where(labels > 0, n0 / n1, 1.0) ** 0.5
    sample /= sample.sum()
    # Adam on the whole sample: small, smooth, and the same on every machine.
    m = np.zeros(len(names) + 1)
    v = np.zeros(len(names) + 1)
    for turn in range(1, rounds + 1):
        logit = np.bincount(at, values * weight[columns], len(labels)) + bias
        error = sample * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels)
        slope = np.bincount(columns, values * error[at], len(names)) + ridge * weight
        if pairs:
            change = np.bincount(p_at, p_values * weight[p_columns], pairs)
            slope += 2 * counterfactual / pairs * np.bincount(p_columns, p_values * change[p_at], len(names))
        grad = np.append(slope, error.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    return Model({n: float(w) for n, w in zip(names, weight, strict=True) if abs(w) > 1e-3}, float(bias))


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, **options) -> Model:
    """Fit from documents (doc_id, text) and labels (doc_id, toxic).

    The fit sees at most ``most`` labelled rows, half of them toxic if there are
    so many: those with the least hashes of their doc_id, in any order of rows.
    """
    wanted = labels.filter("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    draw = F.xxhash64(F.lit("toxicity sample"), "doc_id")
    chosen = [
        wanted.filter(F.col("toxic") == y).orderBy(draw, "doc_id").limit(most // 2).select("doc_id", "toxic") for y in (0, 1)
    ]
    sample = chosen[0].unionByName(chosen[1])
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").orderBy("doc_id", "toxic", "text")
    return fit(((r["text"], r["toxic"]) for r in rows.toLocalIterator()), **options)


def learned_from(docs: DataFrame, labels: DataFrame, held_out: int = 2, **options) -> Model:
    """A model from all folds of the labelled rows but one."""
    return train(docs, labels.filter(fold() != held_out), **options)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""
    bound_batches(docs.sparkSession, *BATCH)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])
        shared.value.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        each, "doc_id long, score double"
    )


def accepted_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold; all columns stay."""
    bound_batches(docs.sparkSession, *BATCH)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            yield batch.filter(pa.array([score(t.as_py()) < threshold for t in batch.column(at)], pa.bool_()))
        shared.value.forget()

    return docs.mapInArrow(each, docs.schema)
