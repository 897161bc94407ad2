"""Redaction of secrets in keys, URLs and messages."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MASK = "[redacted]"
#: In a query string, where brackets would have to be encoded.
QUERY_MASK = "***"
CUT = "... [truncated]"
# Words of keys that hold secrets. A token counts alone or after a qualifier: counts of tokens are no secrets.
_QUALIFIERS = "access|auth|bearer|refresh|session|id|api"
_KEY = rf"(?i)api[-_]?key|secret|passwd|password|authorization|bearer|credential|({_QUALIFIERS})[-_]?token|^token$"
#: Keys that only name a secret's place hold none.
_SAFE = r"(?i)(_env|_env_var|_name)$"
# Text shaped like a credential in a vendor's message.
TOKEN = r"(?i)sk-[A-Za-z0-9_-]{16,}|AIza[0-9A-Za-z_-]{30,}|\bbearer\s+[A-Za-z0-9._-]{8,}|\bx-api-key:\s*\S+"
DEPTH = 12
MESSAGE_CHARS = 2000


def is_secret_key(key: Column) -> Column:
    return key.rlike(_KEY) & ~key.rlike(_SAFE)


def _secret(key: str) -> bool:
    return bool(re.search(_KEY, key)) and not re.search(_SAFE, key)


def _scrub(value, depth: int = 0):
    if depth >= DEPTH:
        return MASK
    if isinstance(value, dict):
        return {k: MASK if _secret(k) else _scrub(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [_scrub(v, depth + 1) for v in value]
    return value


@F.pandas_udf(StringType())
def scrub_json(text: pd.Series) -> pd.Series:
    """Mask the values of secret keys at any depth; what can't be read is masked whole."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(_scrub(json.loads(t)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (ValueError, RecursionError):
            return MASK

    return text.map(one)


def _url(text: str, names: bool = False) -> str:
    try:
        parts = urlsplit(text)
    except ValueError:
        return MASK
    if parts.netloc and "@" in parts.path + parts.query + parts.fragment:
        # The host may have ended too early, inside a password: nothing after it can be trusted.
        return f"{parts.scheme}://{MASK}"
    info, at, host = parts.netloc.rpartition("@")
    user, colon, _ = info.partition(":")
    if names and info:
        info = MASK
    elif colon:
        info = f"{user}:{MASK}"
    pairs = [p.partition("=") for p in parts.query.split("&")]
    query = "&".join(f"{k}={QUERY_MASK}" if sep and _secret(unquote(k)) else k + sep + v for k, sep, v in pairs)
    if info + at + host == parts.netloc and query == parts.query:
        return text
    return urlunsplit((parts.scheme, info + at + host, parts.path, query, parts.fragment))


@F.pandas_udf(StringType())
def redact_url(text: pd.Series) -> pd.Series:
    """Mask passwords and secret parameters; an at sign after the host masks all but the scheme. Other text stays as it is."""
    return text.map(lambda t: None if t is None else _url(t))


def scrub_message(text: Column) -> Column:
    """Mask token-shaped text in a vendor's message, cut it to its limit and say so."""
    masked = F.regexp_replace(text, TOKEN, MASK)
    return F.when(F.length(masked) > MESSAGE_CHARS, F.concat(F.substring(masked, 1, MESSAGE_CHARS), F.lit(CUT))).otherwise(masked)


@F.pandas_udf(StringType())
def redact_words(text: pd.Series) -> pd.Series:
    """Redact each URL in a text, user names too."""
    return text.map(lambda t: None if t is None else re.sub(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]*""", lambda m: _url(m[0], True), t))
