"""Patterns as Python means them, in the JVM and in Python."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from evalmill.functions import patterns
from evalmill.operators import evaluators

SUBJECTS = [
    "", "\n", "a", "ab\n", "a\nb", "zzz", "a{e}", "5", "٣", "²", "x5", "[:digit:]", "foo bar", "Straße", "ſtrasse", "K", "İi", "café", "café",
    "tab\tsep", "\x1c", " ", "\x85x", "line\r\nnext", "漢字1", "😀b", "a_b-c", "aaa", "aXbXc", "ΣΑΣ ς", "10.50 EUR", "key: value ", "\\d", "a" * 50,
]
PATTERNS = [
    "a{e}", "[[:digit:]]", r"\d", r"\D", r"\w+", r"\W", r"\s", r"\S+$", r"\bfoo\b", r"\B", r"^a$", r"a$", r"\Aa\Z", r"(?i)STRASSE", r"(?i)k", r"(?i)[h-l]", r"(?i:σ)α",
    r"(?m)^b$", r"(?s)a.b", r"a.b", r".", r"[^a]", r"[^\W\d]+", r"(?a)\w", r"(?a)\d", r"[\d.]+ (EUR|USD)", r"(\w+): (\w*)", r"a{2,3}", r"a{2}", r"a{,2}b", r"a+?b", r"(?:ab?){1,3}c?",
    r"(?<=a)b", r"(?<!a)b", r"(?=.*b)a", r"(?!a).", r"x|y|5", r"(?x) a \# | z", r"[]a]", r"[a\-c]+", r"[\^a]", r"(a)(b)?", r"(?P<n>f)oo", r"\x41|١|\t", r"[\s\S]{3}", "é", r"\\d", r"a++b", r"(?>a+)b", r"[^\s\S]",
    r"(?i)[^k]", r"(?i)İ", r"-|~", r"(a|b)c?", r"{", r"a{", r"a{1", r"😀.", r"(a)|b", r"((a)|(b))+", r"(\w)\1", r"(?:ab|a)+$", r"(x)?(?(1)a|b)", r"^(?:a?){10}$",
]


def readable(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def says(find, group: int):
    return (str(find is not None).lower(), None if find is None or not group else find.group(group))


def same_as_re(spark, cases, subjects):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(subjects)], "i int, s string").coalesce(1)
    for since in range(0, len(cases), 12):
        some = cases[since : since + 12]
        columns = [
            patterns.found_in(F.col("s"), p, flags, full, group or None, 5.0).alias(f"c{n}") for n, (p, flags, full, group) in enumerate(some)
        ]
        for row in rows.select("s", *columns).collect():
            for n, (p, flags, full, group) in enumerate(some):
                compiled = re.compile(p, flags)
                wanted = says((compiled.fullmatch if full else compiled.search)(row.s), group)
                assert tuple(row[f"c{n}"]) == wanted, (p, flags, full, group, row.s, patterns_text(p, flags))


def patterns_text(p, flags):
    try:
        return patterns.for_java(p, flags).text[:300]
    except patterns.Untranslated as e:
        return f"python: {e}"


def test_means_what_re_says(spark):
    cases = [(p, 0, full, re.compile(p).groups) for p in filter(readable, PATTERNS) for full in (False, True)]
    same_as_re(spark, cases, SUBJECTS)


def test_flags_mean_what_re_says(spark):
    some = [r"^a", r"b$", r"straSSe", r"[k-s]", r".b", r"ς", r"\bk\b", r"[^i]"]
    same_as_re(spark, [(p, f, False, 0) for p in some for f in (re.I, re.M, re.S, re.I | re.A)], SUBJECTS)


def test_random_patterns_mean_what_re_says(spark):
    draw = random.Random(12)
    atoms = ["a", "b", "é", ".", r"\w", r"\d", r"\s", "[ab]", "[^a]", r"\b", "^", "$", "(?:ab)", "(b)", "(a|b)", "(?=b)", "(?!a)", "😀", "\\n", "(?i:B)"]

    def pattern():
        out = "".join(draw.choice(atoms) + draw.choice(["", "", "", "", "?", "{2}", "{1,2}", "+", "*", "+?"]) for _ in range(draw.randrange(1, 6)))
        return out if readable(out) else pattern()

    made = [pattern() for _ in range(220)]
    subjects = ["".join(draw.choices("ab é\n1😀B_", k=draw.randrange(9))) for _ in range(60)]
    same_as_re(spark, [(p, draw.choice([0, 0, re.I, re.M, re.S]), draw.random() < 0.3, min(1, re.compile(p).groups)) for p in made], subjects)
    inside = sum(not patterns_text(p, 0).startswith("python") for p in made)
    assert inside > 130  # most stay in the JVM, repeated anchors and groups among them


@pytest.mark.parametrize(
    ("pattern", "why"),
    [(r"(\w)\1", "groupref"), (r"(a)?(?(1)b|c)", "exists"), (r"(?:a+)+$", "repetition"), (r"(?:a|aa)+$", "repetition"), (r"(?:a?){30}a{30}", "empty"),
     ("(?:ab|c)" * 20, "ways")],
)
def test_refused_for_the_jvm(pattern, why):
    with pytest.raises(patterns.Untranslated, match=why):
        patterns.for_java(pattern)


def test_sets_are_those_of_re():
    assert patterns.for_java("[a-c]x").text == "[a-c]x"
    digits = {c for a, b in patterns.members(r"\d", 0) for c in range(a, b + 1)}
    assert digits == {c for c in range(0x110000) if chr(c).isdecimal()}
    assert patterns.members(r"\U0000006b", re.I) == ((75, 75), (107, 107), (0x212A, 0x212A))


def test_longer_texts_than_the_steps_allow_go_to_python(spark):
    java = patterns.for_java("a+b")
    assert java.open_repeats == 1 and java.longest_subject == 10_000
    text = "a" * 20_000 + "b"
    rows = spark.createDataFrame([(text,), ("ab",), (None,)], "s string")
    found = rows.select(patterns.found_in(F.col("s"), "a+b").alias("f")).select("f.*").collect()
    assert [r.state for r in found] == ["true", "true", None]


def test_a_match_that_would_not_end_is_an_error(spark):
    rows = spark.createDataFrame([("a" * 60,), ("a" * 60 + "b",), (None,)], "output string")
    began = time.monotonic()
    found = rows.select(evaluators.regex(r"(a+)+$", seconds=0.2)(F.col("output"), F.lit(""))["error"]).collect()
    assert [r[0] for r in found] == [None, "regex_timeout", "no_output"] and time.monotonic() - began < 30


def test_the_captured_group_is_told(spark):
    rows = spark.createDataFrame([("total: 42 EUR",), ("none",), ("total:  EUR",), (None,)], "output string")

    def details(**params):
        found = evaluators.regex(**params)(F.col("output"), F.lit(""))
        return [r[0] and json.loads(r[0]) for r in rows.select(found["detail"]).collect()]

    yes, no = (lambda c: {"matched": True, "captured": c}), {"matched": False, "captured": None}
    assert details(pattern=r"total: (\d*) EUR", group=1) == [yes("42"), no, yes(""), None]
    assert details(pattern=r"total: (?:(\d+)|) ?EUR", group=1) == [yes("42"), no, yes(None), None]
    assert details(pattern=r"total: (\d*) EUR", group=0)[0] == yes("total: 42 EUR")
    assert details(pattern="total") == [{"matched": True}, {"matched": False}, {"matched": True}, None]
    with pytest.raises(ValueError, match="no group 2"):
        evaluators.regex("(a)", group=2)


def test_missing_values_are_named(spark):
    rows = spark.createDataFrame([("Alpha beta",), ("",), (None,)], "output string")
    found = evaluators.contains(["alpha", "GAMMA", "beta"], case_sensitive=False)(F.col("output"), F.lit(""))
    said = [r[0] and json.loads(r[0]) for r in rows.select(found["detail"]).collect()]
    assert said == [
        {"mode": "all", "n_found": 2, "missing": ["GAMMA"]}, {"mode": "all", "n_found": 0, "missing": ["alpha", "GAMMA", "beta"]}, None,
    ]
