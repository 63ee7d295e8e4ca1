"""Masks for named secrets, addresses and tokens, and new ids for runs whose ids held one.

The patterns are possessive or bounded, so that long adversarial contents take linear time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Key names, token prefixes and masks.
_KEYS = r"api[_ -]?key|password|secret|access[_ -]?token|authorization"
_TOKENS = r"sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9]{12,}|AKIA[A-Z0-9]{16}"
EMAIL_MASK, TOKEN_MASK = "[REDACTED EMAIL]", "[REDACTED TOKEN]"
_WIDE = r"\s\x{feff}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_W, _N = f"[{_WIDE}]", f"[^{_WIDE}\"',;}}]"


def _quoted(q: str) -> str:
    return rf"({q})(?:[^{q}\\]++|\\[\s\S]|\\\z)*+(?:({q})|(?<=({q}))\z|\z)"


NAMED = rf"""(?i)(?<![A-Za-z0-9_])((?:{_KEYS})["']?{_W}*+[=:]{_W}*+)(?:{_quoted('"')}|{_quoted("'")}|(?:bearer{_W}+)?{_N}+)"""
NAMED_MASK = "$1$2$5[REDACTED]$3$4$6$7"
_C, _L, _D = r"[A-Za-z0-9._%+@-]", r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9.-]"
# An address begins where a run of _L does, or after the address before it. What follows it in its run of _C stays, as in "x@y.org%%%";
# that run ends within 512 characters of the address's begin, and the address within 254: what lies beyond these ($1 here) also follows the address.
EMAIL = rf"(?:(?<!{_L})|\G)(?={_L}++@)(?={_C}{{1,512}}+(?!{_C}))(?={_C}{{1,254}}+({_C}*+))(?>{_L}++@{_D}+\.[A-Za-z]{{2,}}+)(?={_C}*\1(?!{_C}))"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
TOKEN = rf"(?<![A-Za-z0-9_])(?:{_TOKENS}){_EDGE}"
STAGES = [(NAMED, NAMED_MASK), (EMAIL, EMAIL_MASK), (TOKEN, TOKEN_MASK)]

# The plain rules, as SQL without lookbehind has them: values end at a quote and never begin with one, spaces are five ASCII ones, addresses
# may have any length. Letters match in either case as RE2 folds them: the long s is an s and the Kelvin sign a k.
_S, _ANY_CASE = r"[\t\n\f\r ]", re.sub("[sk]", lambda m: {"s": r"[s\x{17f}]", "k": r"[k\x{212a}]"}[m[0]], _KEYS)
PLAIN_NAMED = rf"""(?i)(?=[aps\x{{17f}}]){_EDGE}((?:{_ANY_CASE})["']?{_S}*+[=:]{_S}*+)(?:bearer{_S}+)?[^\t\n\f\r "',;}}]+"""
PLAIN_EMAIL = rf"(?:(?<!{_L})|\G)(?>{_L}++@{_D}+\.[A-Za-z]{{2,}}+)"
PLAIN_STAGES = [(PLAIN_NAMED, "$1[REDACTED]"), (PLAIN_EMAIL, EMAIL_MASK), (TOKEN, TOKEN_MASK)]


def masked(text: Column, stages: list[tuple[str, str]] = STAGES) -> Column:
    """``text`` with its secrets masked; null stays null."""
    for pattern, mask in stages:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(mask))
    return text


def mask_count(text: Column) -> Column:
    """How many masks :func:`masked` sets, each stage counted on what the one before left."""
    total = F.lit(0)
    for pattern, mask in STAGES:
        total, text = total + F.regexp_count(text, F.lit(pattern)), F.regexp_replace(text, F.lit(pattern), F.lit(mask))
    return F.coalesce(total, F.lit(0))


def match_count(text: Column, stages: list[tuple[str, str]] = STAGES) -> Column:
    """How many matches the stages' patterns have in ``text`` itself; one that lies within another's counts too."""
    return F.coalesce(sum((F.regexp_count(text, F.lit(pattern)) for pattern, _ in stages), F.lit(0)), F.lit(0))


def redact_steps(steps: DataFrame) -> DataFrame:
    """Steps with masked texts and ids; if any id of a run held a secret, all its ids are numbered anew.

    Adds ``n_masked``, the masks of all texts of the step. Links by call id are kept.
    """
    texts = [c for c in ("id", "kind", "content", "tool", "call_id", "status") if c in steps.columns]
    n = sum((mask_count(F.col(c)) for c in texts), F.lit(0))
    run, call = Window.partitionBy("run_id"), Window.partitionBy("run_id", "call_id")
    changed = (masked(F.col("id")) != F.col("id")) | F.coalesce(masked(F.col("call_id")) != F.col("call_id"), F.lit(False))
    base = steps.withColumns({"anew": F.max(changed).over(run), "first": F.when(F.col("call_id").isNotNull(), F.min("pos").over(call)), "n_masked": n})
    rank = F.dense_rank().over(run.orderBy(F.col("first").asc_nulls_last()))
    return base.withColumn("rank", rank).withColumns(
        {
            **{c: masked(F.col(c)) for c in texts if c not in ("id", "call_id")},
            "id": F.when(F.col("anew"), F.concat(F.lit("step-"), F.row_number().over(run.orderBy("pos")))).otherwise(F.col("id")),
            "call_id": F.when(F.col("call_id").isNull(), None).when(F.col("anew"), F.concat(F.lit("call-"), "rank")).otherwise(F.col("call_id")),
        }
    ).drop("anew", "first", "rank")
