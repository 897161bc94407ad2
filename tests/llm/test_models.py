"""Language ID, toxicity, HTML extraction: held-out results, spans, hard inputs."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from evalmill.llm import html_extract, language_id, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def language_model(docs):
    return language_id.learned_from(docs)


def test_held_out_languages(docs, language_model):
    found = {r["doc_id"]: r for r in language_id.identify(docs, language_model).collect()}
    held = [
        (r["lang"], found[r["doc_id"]]["lang_pred"])
        for r in docs.filter("lang is not null").select("doc_id", "lang").collect()
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
    ]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_texts_without_letters_are_und(spark, language_model):
    rows = [(1, None, 5), (2, "", 5), (3, "123 ... \n", 5), (4, "Ελλάδα", 5), (None, "the house", 5), (5, "the house " * 60_000, 5)]
    rows += [(6, "½ ² ① Ⅷ", 5), (7, "_ __", 5)]
    schema = "doc_id long, text string, lang_pred int"
    docs = spark.createDataFrame(rows, schema)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_model).collect()}
    assert [found[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert found[4][0] in language_model.languages and found[5][0] in language_model.languages
    assert found[4][1] == 0 and found[6] == found[7] == ("und", 0.0)
    kept = language_id.accepted_documents(docs, language_model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {5, None}
    assert language_id.identify(spark.createDataFrame([], schema), language_model).count() == 0


def test_spans_of_a_mixed_text(docs, language_model):
    by = {r["lang"]: r["text"] for r in docs.filter("length(text) between 600 and 6000").collect()}
    a, b = sorted(by)[:2]
    text = " ".join(by[a].split()[:80] + by[b].split()[:80])
    spans = language_id.label_texts(language_model, [text])[0][2]
    assert {a, b} <= {lang for _, _, lang in spans}
    assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_no_labels_to_learn_from(spark):
    schema = "doc_id long, text string, lang string"
    model = language_id.train(spark.createDataFrame([], schema))
    some = spark.createDataFrame([(1, "the house", None), (2, "...", None), (3, None, None)], schema)
    assert {tuple(r) for r in language_id.identify(some, model).collect()} == {(i, "und", 0.0) for i in (1, 2, 3)}
    assert [r["doc_id"] for r in language_id.accepted_documents(some, model).collect()] == [1]


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(4)
    for states in (1, 3, 200):
        sizes = np.array([3, 1, 0, 4] if states < 200 else [2, 2])
        starts, scores = np.cumsum(sizes) - sizes, draw.normal(size=(int(sizes.sum()), states)).astype(np.float32)
        found = language_id.viterbi(scores, starts, sizes, 0.7)
        for at, n in zip(starts, sizes, strict=True):
            value = lambda path, at=at: sum(scores[at + i, s] for i, s in enumerate(path)) - 0.7 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B905, E731
            if n:
                best = max(map(value, itertools.product(range(states), repeat=int(n))))
                assert value(found[at : at + n].tolist()) == pytest.approx(best, abs=1e-4)


TOXIC = ["you are a stupid worthless idiot", "shut up you pathetic idiot", "these stupid worthless people are pathetic"]
CLEAN = ["the women met in the garden today", "a muslim family opened a new bakery", "we walked along the river", "the young man reads"]


def test_identity_terms_do_not_move_a_score():
    examples = [(f"{t}, {who}", 1) for t in TOXIC for who in ("women", "muslims", "women again")] * 3
    examples += [(f"{t} {n}", 0) for n in ("men", "christians", "and then") for t in CLEAN] * 3
    model = toxicity.fit(examples)
    assert min(model.score(t) for t, _ in examples[:9]) > 0.5 > max(model.score(t) for t in CLEAN)
    assert abs(model.score("women walked along the river") - model.score("men walked along the river")) < 0.05
    assert abs(model.score("muslims met in the garden") - model.score("christians met in the garden")) < 0.05
    assert toxicity.fit([("a", 0), (None, 0)]).score("a") < 1e-6 and toxicity.fit([]).score("a") < 1e-6
    assert toxicity.fit([("a", 1), (None, 1), ("b", 1)]).score("c") == pytest.approx(0.75)


def test_neutral_mentions_are_taken_for_insults_without_the_penalty():
    draw = random.Random(1)
    insults, groups = ["idiot", "pathetic", "worthless", "trash"], ["women", "muslims", "gay", "immigrants", "black"]
    plain = "garden river bakery letter winter music school evening train market".split()

    def text(toxic: bool, mention: float) -> str:
        words = draw.sample(plain, 6) + draw.sample(insults, 1) * (toxic and draw.random() < 0.7)
        words += draw.sample(groups, 1) * (draw.random() < mention)
        draw.shuffle(words)
        return " ".join(words)

    examples = [(text(True, 0.8), 1) for _ in range(400)] + [(text(False, 0.1), 0) for _ in range(400)]
    neutral, toxic = [text(False, 1.0) for _ in range(300)], [" ".join([*plain[:5], x]) for x in insults]
    wrong = {}
    for weight in (0.0, 5.0):
        model = toxicity.fit(examples, counterfactual=weight)
        wrong[weight] = sum(model.score(t) >= 0.5 for t in neutral)
        assert min(map(model.score, toxic)) > 0.5
    assert wrong[5.0] < 0.5 * wrong[0.0]


def test_words_of_no_bearing_are_found_in_the_texts():
    draw = random.Random(2)
    plain = [f"word{chr(97 + i)}" for i in range(12)]
    examples = [(" ".join([*draw.sample(plain, 8), *(["idiot"] if i % 2 else [])]), i % 2) for i in range(400)]
    counts = [Counter(), Counter()]
    for words, y in examples:
        for w in set(words.split()):
            counts[y][w + "$"] += 1
    found = toxicity.neutral_terms(counts, (200, 200))
    assert "idiot" not in found and len(found) > 4
    assert all(word in terms for word, terms in found.items())


def test_held_out_toxicity(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.learned_from(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    held = [(r["toxic"], found[r["doc_id"]]) for r in labels.filter("toxic is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    toxic, clean = [s for y, s in held if y], [s for y, s in held if not y]
    # 41 toxic texts to learn from: 10 of 14 are caught (114 of 120 with ten times the texts).
    assert len(toxic) > 5 and sum(s >= 0.3 for s in toxic) >= 0.6 * len(toxic)
    assert sum(s < 0.3 for s in clean) >= 0.95 * len(clean)


def test_nothing_to_learn_toxicity_from(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.accepted_documents(docs, toxicity.learned_from(docs, labels)).count() == docs.count()


def test_toxicity_scores_of_hard_texts(spark):
    model = toxicity.fit([(t, 1) for t in TOXIC * 3] + [(t, 0) for t in CLEAN * 3])
    rows = [(1, None, "x"), (2, "", "x"), (3, "stupid idiot", "x"), (3, "stupid idiot", "x"), (4, "river " * 100_000, "x"), (None, "12", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    found = toxicity.scored(docs, model).collect()
    assert len(found) == 6 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2, None)}) == 1
    assert toxicity.accepted_documents(docs, model, 1.1).columns == docs.columns
    assert toxicity.scored(spark.createDataFrame([], docs.schema), model).count() == 0


PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body>
<nav class="menu"><a href="/">Home</a> <a href="/b">News of the whole wide world today</a></nav>
<div class="cookie-banner">We use cookies to make this page work as well as it can for you.</div>
<article><h1>The   headline</h1><p>First long paragraph &amp; its words,<br>which go on for a good while here.</p>
<p>Second paragraph, with <b>bold</b> and <i>more</i> of the text that a reader came for.</p>
<ul><li>One item that belongs<li>Another item that belongs</ul>
<div class="ad">Buy this now, it is a very good thing to buy for everyone!</div></article>
<aside>Related reading that nobody asked for but is here anyway</aside>
<section id="comments"><p>A reader comment of some length that must not be there at all.</p></section>
<footer>Copyright of somebody</footer><script>var x = "<p>text</p>";</script></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE).split("\n\n") == [
        "The headline",
        "First long paragraph & its words, which go on for a good while here.",
        "Second paragraph, with bold and more of the text that a reader came for.",
        "One item that belongs",
        "Another item that belongs",
    ]


def test_hard_pages(spark):
    htmls = [None, "", "no markup at all", "<p>" * 3000 + "deep", "<div><p>unclosed <b>text", "</p></div>stray", "<nav>only menu</nav>", PAGE, PAGE]
    pages = spark.createDataFrame([(i, None, h, 1) for i, h in enumerate(htmls)], "page_id long, url string, html string, n_chars int")
    found = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert [found[i]["text"] for i in (0, 1, 2, 6)] == ["", "", "no markup at all", ""]
    assert found[7]["text"] == found[8]["text"] and all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert html_extract.extract(spark.createDataFrame([], pages.schema)).count() == 0
