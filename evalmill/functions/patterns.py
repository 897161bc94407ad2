"""Python's regular expressions in the JVM where that is exact and bounded, else in Python with a time limit.

A pattern is read by Python's own parser and written anew for Java, node by
node. What a single character may be is asked of ``re`` itself, for every code
point, and written as ranges: so ``\\d``, ``\\w``, sets and letters under
``ignore_case`` hold the very characters that they hold in Python, whatever
Unicode version the JVM has. Anchors and word boundaries become look-arounds.

Refused, and left to Python: conditional groups, references to groups, a group
that is asked for and may take no part in a match, or many times, repetitions of
what may be empty, open repetitions of more than one character (Java follows
them by recursion), and patterns whose tries no length bounds. Of the rest, the number of steps is at
most ``choices * length ** (open repetitions + 1)``; texts for which that
passes ``STEPS`` are left to Python too. Python interrupts a match by a timer.
"""

from __future__ import annotations

import re
import signal
import threading
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps that a pattern may need in the JVM, and characters of a pattern that is translated.
STEPS = 100_000_000
LONGEST_JAVA = 200_000
LATE = "regex_timeout"
_SURROGATES = range(0xD800, 0xE000)
_END = 0x110000


class Untranslated(ValueError):
    """The pattern is not one for the JVM."""


@contextmanager
def time_limit(seconds: float) -> Iterator[None]:
    """Raise ``TimeoutError`` within after so many seconds.

    ``re`` looks for signals as it searches, so a timer ends even a match that
    would go on for years. Timers are the main thread's, where Python workers
    run their functions.
    """
    if threading.current_thread() is not threading.main_thread():
        raise RuntimeError("matches are timed in the main thread only")

    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


@lru_cache(1)
def _every() -> str:
    return "".join(chr(c) for c in range(_END) if c not in _SURROGATES)


@lru_cache(1)
def _cased() -> str:
    return "".join(c for c in _every() if c.lower() != c or c.upper() != c)


@lru_cache(1000)
def members(pattern: str, flags: int) -> tuple[tuple[int, int], ...]:
    """The code points that a pattern of one character takes, as ranges."""
    compiled = re.compile(pattern, flags | re.S)
    literal = re.fullmatch(r"\\U[0-9a-f]{8}", pattern)
    # A letter can only be taken for letters that have a case; all else needs all code points.
    found = compiled.findall(_cased()) if literal else compiled.findall(_every())
    return _joined((p, p) for p in {*map(ord, found), *([int(pattern[2:], 16)] if literal else [])})


def _joined(ranges: Iterable[tuple[int, int]]) -> tuple[tuple[int, int], ...]:
    """Ranges in order, those that touch as one; they run on over the surrogates, which no text holds."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and (a <= out[-1][1] + 1 or (out[-1][1] == 0xD7FF and a == 0xE000)):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple((a, b) for a, b in out)


def _point(c: int) -> str:
    return chr(c) if c < 128 and chr(c).isalnum() else f"\\x{{{c:x}}}"


def _ranges(ranges: tuple[tuple[int, int], ...]) -> str:
    return "".join(_point(a) if a == b else f"{_point(a)}-{_point(b)}" for a, b in ranges)


def java_class(ranges: tuple[tuple[int, int], ...]) -> str:
    """A Java class of these ranges. Many are nested by halves, so that a character meets few of them."""
    if not ranges:
        return f"[^{_point(0)}-{_point(_END - 1)}]"
    if len(ranges) == 1 and ranges[0][0] == ranges[0][1]:
        return _point(ranges[0][0])

    def nested(part: tuple[tuple[int, int], ...]) -> str:
        if len(part) <= 8:
            return f"[{_ranges(part)}]"
        half = len(part) // 2
        return f"[[{_point(part[0][0])}-{_point(part[-1][1])}]&&[{nested(part[:half])}{nested(part[half:])}]]"

    return nested(ranges)


@dataclass(frozen=True)
class JavaPattern:
    """A pattern for Java's ``find``, with what bounds its steps."""

    text: str
    groups: int
    open_repeats: int
    choices: int

    @property
    def longest_subject(self) -> int:
        """The most characters of a text for which ``STEPS`` are enough."""
        return int((STEPS / self.choices) ** (1 / (self.open_repeats + 1)))


class _Writer:
    """Writes nodes anew. ``wanted`` is a group whose text is asked for, which then must take part in every match."""

    def __init__(self, wanted: int | None):
        self.wanted = wanted
        self.open_repeats, self.choices = 0, 1
        self.optional = 0

    @contextmanager
    def maybe(self, really: bool = True) -> Iterator[None]:
        """Groups within may take no part."""
        self.optional += really
        yield
        self.optional -= really

    def many(self, factor: int) -> None:
        self.choices *= max(factor, 1)
        if self.choices > 10_000:
            raise Untranslated("too many ways to match")

    def sequence(self, nodes, flags: int, repeated: bool) -> str:
        return "".join(self.node(op, arg, flags, repeated) for op, arg in nodes)

    def single(self, op, arg, flags: int) -> str | None:
        """The class of a node that takes one character."""
        if op is sre.ANY:
            return java_class(((0, 9), (11, _END - 1))) if not flags & re.S else java_class(((0, _END - 1),))
        if op in (sre.LITERAL, sre.NOT_LITERAL):
            if arg in _SURROGATES:
                raise Untranslated("a surrogate")
            own = members(f"\\U{arg:08x}", flags & (re.I | re.A)) if flags & re.I else ((arg, arg),)
            if op is sre.LITERAL:
                return java_class(own)
            return f"[^{_ranges(own)}]"
        if op is sre.CATEGORY:
            return java_class(members(_CATEGORIES[arg], flags & re.A))
        if op is sre.IN:
            if not flags & re.I and all(item in (sre.LITERAL, sre.RANGE) for item, _ in arg):
                return java_class(_joined((x, x) if item is sre.LITERAL else x for item, x in arg))
            return java_class(members(_set_text(arg), flags & (re.I | re.A)))
        return None

    def boundary(self, flags: int, inside: bool) -> str:
        word = java_class(members(r"\w", flags & re.A))
        if inside:
            # Within or without a word; an empty text has no such place.
            return f"(?!\\A\\z)(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"
        return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"

    def node(self, op, arg, flags: int, repeated: bool) -> str:
        if (one := self.single(op, arg, flags)) is not None:
            return one
        if op is sre.AT:
            return {
                sre.AT_BEGINNING: lambda: "(?<![^\\n])" if flags & re.M else "\\A",
                sre.AT_BEGINNING_STRING: lambda: "\\A",
                sre.AT_END: lambda: "(?![^\\n])" if flags & re.M else "(?=\\n?\\z)",
                sre.AT_END_STRING: lambda: "\\z",
                sre.AT_BOUNDARY: lambda: self.boundary(flags, False),
                sre.AT_NON_BOUNDARY: lambda: self.boundary(flags, True),
            }[arg]()
        if op is sre.BRANCH:
            if repeated:
                raise Untranslated("alternatives within a repetition")
            self.many(len(arg[1]))
            with self.maybe():
                return "(?:" + "|".join(self.sequence(b, flags, repeated) for b in arg[1]) + ")"
        if op is sre.SUBPATTERN:
            group, added, removed, part = arg
            if group is not None and group == self.wanted and (repeated or self.optional):
                raise Untranslated("a group that takes part many times, or not in every match")
            body = self.sequence(part, (flags | added) & ~removed, repeated)
            return f"({body})" if group is not None else f"(?:{body})"
        if op is sre.ATOMIC_GROUP:
            return f"(?>{self.sequence(arg, flags, repeated)})"
        if op in (sre.ASSERT, sre.ASSERT_NOT):
            direction, part = arg
            mark = ("=" if op is sre.ASSERT else "!") if direction > 0 else ("<=" if op is sre.ASSERT else "<!")
            with self.maybe(op is sre.ASSERT_NOT):
                return f"(?{mark}{self.sequence(part, flags, repeated)})"
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            return self.repeat(op, *arg, flags, repeated)
        raise Untranslated(str(op).lower())

    def repeat(self, op, least: int, most: int, part, flags: int, repeated: bool) -> str:
        mark = {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}[op]
        inner = list(part)
        one = len(inner) == 1 and self.single(*inner[0], flags)
        if part.getwidth()[0] == 0:
            raise Untranslated("a repetition of what may be empty")
        if most is sre.MAXREPEAT:
            if not one or repeated:
                raise Untranslated("an open repetition of more than a character")
            self.open_repeats += 1
            return f"{one}{{{least},}}{mark}"
        if repeated and least != most:
            raise Untranslated("a repetition within a repetition")
        self.many(most - least + 1)
        if one:
            return f"{one}{{{least},{most}}}{mark}"
        if most > 1:
            self.many(most)
        with self.maybe(least == 0):
            return f"(?:{self.sequence(part, flags, repeated or most > 1)}){{{least},{most}}}{mark}"


_CATEGORIES = {
    sre.CATEGORY_DIGIT: r"\d", sre.CATEGORY_NOT_DIGIT: r"\D", sre.CATEGORY_SPACE: r"\s",
    sre.CATEGORY_NOT_SPACE: r"\S", sre.CATEGORY_WORD: r"\w", sre.CATEGORY_NOT_WORD: r"\W",
}


def _set_text(items) -> str:
    """A set of Python's parser as a pattern again, all characters by number."""
    out = []
    for op, arg in items:
        if op is sre.NEGATE:
            out.append("^")
        elif op is sre.LITERAL:
            out.append(f"\\U{arg:08x}")
        elif op is sre.RANGE:
            out.append(f"\\U{arg[0]:08x}-\\U{arg[1]:08x}")
        else:
            out.append(_CATEGORIES[arg])
    return f"[{''.join(out)}]"


@lru_cache(200)
def for_java(pattern: str, flags: int = 0, fullmatch: bool = False, wanted: int | None = None) -> JavaPattern:
    """The pattern as Java reads it; raises :class:`Untranslated`. ``wanted`` is the group that is asked for, if any."""
    tree = _parser.parse(pattern, flags)
    writer = _Writer(wanted)
    # Flags of the pattern itself, such as (?i) at its start, are part of the state.
    body = writer.sequence(tree, tree.state.flags, False)
    if len(body) > LONGEST_JAVA:
        raise Untranslated("too long in Java")
    text = f"\\A(?:{body})\\z" if fullmatch else body
    return JavaPattern(text, tree.state.groups - 1, writer.open_repeats, writer.choices)


def python_finder(pattern: str, flags: int, fullmatch: bool, group: int, seconds: float) -> Callable[[str | None], tuple[str | None, str | None]]:
    """A function of a text: (``true``, ``false``, ``regex_timeout`` or ``regex_error``, what the group took)."""
    compiled = re.compile(pattern, flags)
    find = compiled.fullmatch if fullmatch else compiled.search

    def one(subject: str | None) -> tuple[str | None, str | None]:
        if subject is None:
            return None, None
        try:
            with time_limit(seconds):
                found = find(subject)
        except TimeoutError:
            return LATE, None
        except (RecursionError, MemoryError):
            return "regex_error", None
        return ("false", None) if found is None else ("true", found.group(group))

    return one


def found_in(
    subject: Column, pattern: str, flags: int = 0, fullmatch: bool = False, group: int | None = None, seconds: float = 1.0
) -> Column:
    """A struct (state, captured): state is ``true``, ``false``, ``regex_timeout`` or ``regex_error``; null for a null subject.

    ``captured`` is what the group took, null without a match, where the group
    took no part, and where no group is asked for.
    """
    none = F.lit(None).cast("string")
    look = python_finder(pattern, flags, fullmatch, group or 0, seconds)

    @F.pandas_udf("state string, captured string")
    def in_python(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([look(t) for t in text], columns=["state", "captured"], dtype=object)

    captured = lambda c: (c if group is not None else none).alias("captured")
    seen = lambda said: F.struct(said["state"].alias("state"), captured(said["captured"]))
    try:
        java = for_java(pattern, flags, fullmatch, group)
    except Untranslated:
        return F.when(subject.isNotNull(), seen(in_python(subject)))
    hit = subject.rlike(java.text)
    took = F.when(hit, F.regexp_extract(subject, java.text, group or 0))
    inside = F.struct(hit.cast("string").alias("state"), captured(took))
    if java.open_repeats == 0 and java.choices == 1:
        # A few steps for each character, whatever the length.
        return F.when(subject.isNotNull(), inside)
    # The worker sees the long texts only: of others it gets a null.
    short = F.length(subject) <= java.longest_subject
    return F.when(short, inside).when(subject.isNotNull(), seen(in_python(F.when(~short, subject))))
