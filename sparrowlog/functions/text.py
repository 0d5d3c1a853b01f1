"""Text helpers: trimming, name cleaning, trigram similarity, full-text matching, redaction."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space at the ends of a text.
SPACE = " \t\n\x0b\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def name_key(name: Column) -> Column:
    return F.lower(name)


def trim_all(text: Column) -> Column:
    """All white space at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


def clean_name(text: Column) -> Column:
    """Outer white space, one opening and one closing bracket, runs of spaces and closing dots go."""
    out = F.regexp_replace(trim_all(text), r"^\[|\]$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"\.+$", "")


def contains_ci(text: Column, part: str) -> Column:
    """Case-insensitive substring where % and _ of the caller stay wildcards and a backslash is itself."""
    return text.ilike("%" + part.replace("\\", "\\\\") + "%")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-case words, each padded by two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where there is none."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web search text as alternatives of conjunctions of (wanted, words): AND by default, ``or``, ``-term``, ``"phrase"``."""
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            if out[-1]:
                out.append([])
            continue
        words = [w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w]
        if words:
            out[-1].append((not minus, words))
    return [x for x in out if x]


def matches(words: Column, query: str) -> Column:
    """Whether a token array satisfies a web search text; a text without terms matches nothing."""
    any_ = F.lit(False)
    for terms in websearch(query):
        all_ = F.lit(True)
        for wanted, term in terms:
            hit = F.array_contains(words, term[0])
            if len(term) > 1:
                joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
                hit = joined.contains(" " + " ".join(term) + " ")
            all_ = all_ & (hit if wanted else ~hit)
        any_ = any_ | all_
    return any_


#: Keys whose values never reach a log, and texts that are replaced wherever they stand.
SECRET_KEY = re.compile(r"authorization|cookie|password|secret|token|database_?url|connection_?string|admin_password|response_headers|request_headers", re.I)
PAYLOAD_KEY = re.compile(r"(^|_)(payload|raw|body)$", re.I)
SECRET_TEXTS = [
    (re.compile(r"\bpostgres(?:ql)?://\S+", re.I), "[REDACTED_DATABASE_URL]"),
    (re.compile(r"\b(Bearer|Basic)\s+\S+", re.I), r"\1 [REDACTED]"),
    (re.compile(r"\b(token|password|secret|api[_-]?key)=([^\s&]+)", re.I), r"\1=[REDACTED]"),
]
HIDDEN = "[REDACTED]"


def redact_text(text: str) -> str:
    for pattern, put in SECRET_TEXTS:
        text = pattern.sub(put, text)
    return text


def redact_value(value, key: str = ""):
    """A JSON value without secrets: what stands under a secret key goes whatever its type, elements of a list stand under the
    list's key, and texts anywhere lose addresses of databases, credentials and key=value secrets."""
    if SECRET_KEY.search(key) or PAYLOAD_KEY.search(key):
        return HIDDEN
    if isinstance(value, str):
        return redact_text(value)
    if isinstance(value, list):
        return [redact_value(x, key) for x in value]
    if isinstance(value, dict):
        return {k: redact_value(x, k) for k, x in value.items()}
    return value


def redact_one(text: str | None) -> str | None:
    """JSON objects and lists by their keys; any other text, or one nested too deep to walk, as a text."""
    if text is None:
        return None
    try:
        value = json.loads(text)
        if isinstance(value, dict | list):
            return json.dumps(redact_value(value), ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except RecursionError:
        return HIDDEN
    except ValueError:
        pass
    return redact_text(text)


@F.pandas_udf(StringType())
def redact(text: pd.Series) -> pd.Series:
    return text.map(redact_one)
