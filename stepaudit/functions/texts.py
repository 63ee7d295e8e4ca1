"""Text functions that no built-in has: JSON text as Python writes it, and Python's Unicode words.

JSON texts are Arrow-batched pandas UDFs; words are cut in the JVM by a pattern for Python's word characters.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_WORDS = re.compile(r"(?u)\b\w\w+\b")


def json_text(raw: str | None, falsy_is_empty: bool = False) -> str | None:
    """The text of a JSON value: a string is itself, anything else is written with ``, `` and ``: `` in its own key order.

    A null SQL value stays null. ``falsy_is_empty`` gives an empty text for null, false, 0, "", [] and {}.
    """
    if raw is None:
        return None
    value = json.loads(raw)
    if falsy_is_empty and not value:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_json(raw: str | None) -> str | None:
    """The JSON value with sorted keys and no blanks; NaN and infinities are refused."""
    if raw is None:
        return None

    def refuse(name: str):
        raise ValueError(f"{name} is no JSON number")

    return json.dumps(json.loads(raw, parse_constant=refuse), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def unicode_words(text: str | None) -> list[str]:
    """Lower-cased words of two or more word characters of any script."""
    return _WORDS.findall((text or "").lower())


def json_text_of(raw: Column, falsy_is_empty: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: json_text(v, falsy_is_empty), na_action="ignore")

    return run(raw)


def canonical_json_of(raw: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(canonical_json, na_action="ignore")

    return run(raw)


_CLASS: dict[str, str] = {}


def _ranges(points: list[int]) -> str:
    """Code points as the ranges of a Java character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}-\\x{{{points[j]:x}}}")
        i = j + 1
    return "".join(out)


def word_class(spark: SparkSession) -> str:
    """A Java class of exactly the characters that Python counts as part of a word.

    That is letters, numbers and ``_``; where the JVM's Unicode version knows other letters than
    Python's, which is asked once a session, their ranges are added or taken away.
    """
    key = spark.sparkContext.applicationId
    if key not in _CLASS:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        rest = spark._jvm.java.util.regex.Pattern.compile(r"[\p{L}\p{N}_]").matcher(every).replaceAll("")
        java, python = set(every) - set(rest), set(re.findall(r"\w", every))
        more, less = (sorted(map(ord, x)) for x in (python - java, java - python))
        # The rare ranges are a class of their own, which is only tried for characters from its first one on.
        rare = rf"[\x{{{more[0]:x}}}-\x{{10ffff}}&&[{_ranges(more)}]]" if more else ""
        _CLASS[key] = rf"[\p{{L}}\p{{N}}_{rare}{'&&[^' + _ranges(less) + ']' if less else ''}]"
    return _CLASS[key]


def words_of(spark: SparkSession, text: Column) -> Column:
    """Lower-cased words of two or more word characters of any script, as :func:`unicode_words`; cut in the JVM."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{word_class(spark)}{{2,}}"), F.lit(0))
