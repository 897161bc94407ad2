"""Text, number and hashing functions of the evaluators."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: A number as evaluators find it in prose.
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"


def normalize_text(text: Column, strip: bool = True, whitespace: bool = False) -> Column:
    """Optionally turn white space into single spaces, then optionally trim it."""
    out = F.regexp_replace(text, r"(?U)\s+", " ") if whitespace else text
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "") if strip else out


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full case folding, which no built-in function has (a sharp s becomes two letters)."""
    return text.map(lambda t: None if t is None else t.casefold())


def _comparable(text: str) -> str:
    kept = (c if c.isalnum() or c == "_" or c.isspace() else " " for c in unicodedata.normalize("NFKC", text).casefold())
    return " ".join("".join(kept).split())


@F.pandas_udf(StringType())
def comparable_text(text: pd.Series) -> pd.Series:
    """Compatibility form, case-folded, without punctuation, single-spaced."""
    return text.map(lambda t: None if t is None else _comparable(t))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """The share of two arrays' distinct elements that they share; two empty ones are equal."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    shared, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def token_set_similarity(a: Column, b: Column) -> Column:
    return jaccard(words(a), words(b))


def char_ngrams(text: Column, n: int) -> Column:
    """A text's n-grams of characters; a shorter text is its own only one, an empty one has none."""
    size = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(text)).otherwise(grams)


def char_ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    return jaccard(char_ngrams(a, n), char_ngrams(b, n))


def comparable_ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    """The same over comparable texts, in one pass of the Python function that makes them so."""

    def grams(t: str) -> set[str]:
        return {t[i : i + n] for i in range(max(1, len(t) - n + 1))} if t else set()

    @F.pandas_udf(DoubleType())
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: str | None, q: str | None) -> float | None:
            if p is None or q is None:
                return None
            p, q = grams(_comparable(p)), grams(_comparable(q))
            return len(p & q) / len(p | q) if p | q else 1.0

        return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return similarity(a, b)


def found_number(text: Column, which: str = "first") -> Column:
    """The first, last or only number in a text; null where there is none (or not just one)."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    n = F.size(found)
    picked = {
        "first": F.when(n > 0, F.get(found, F.lit(0))),
        "last": F.when(n > 0, F.get(found, n - 1)),
        "only": F.when(n == 1, F.get(found, F.lit(0))),
    }[which]
    return picked.try_cast("double")


def expected_number(text: Column) -> Column:
    """A number given as text; words such as nan or inf, and blanks around it, don't count."""
    return F.when(text.rlike(rf"^{NUMBER}$"), text.try_cast("double"))


def strip_fence(text: Column) -> Column:
    """The inside of the Markdown fence around a whole text, else the text; marks within the inside are part of it."""
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    first = F.substring_index(whole, "\n", 1)
    rest = F.substring(whole, F.length(first) + 2, F.length(whole))
    inside = F.regexp_replace(F.substring(rest, F.lit(1), F.length(rest) - 3), r"[ \t]+\z", "")
    fenced = first.rlike(r"\A```[A-Za-z0-9_+-]*[ \t]*\r?\z") & rest.endswith("```")
    return F.when(fenced, F.regexp_replace(inside, r"\r?\n\z", "")).otherwise(text)


def digest(canonical: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def rfc3339(timestamp: Column) -> Column:
    """UTC text of a timestamp; the session's time zone is UTC."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def neutralised(cell: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a quote before it."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def markdown_cell(cell: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(cell, F.lit("")), F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds to wait, from a number or an HTTP date; never negative, null where neither."""
    number = F.when(header.rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(header).try_cast("double"))
    date = F.try_to_timestamp(F.regexp_replace(header, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(number, (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double"))
    return F.when(wait.isNotNull(), F.greatest(wait, F.lit(0.0)))


def optional_count(value: Column) -> Column:
    """A count that is whole and not negative, else null."""
    number = value.try_cast("double")
    return F.when((number >= 0) & (number == F.floor(number)), number.cast("long"))
