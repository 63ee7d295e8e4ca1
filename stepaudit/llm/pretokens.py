"""Pre-tokens of texts by the patterns of the public tokenizers.

Most texts hold only characters of a set for which Python's own expressions agree with the
patterns' Unicode classes; they take that faster way. Any other text takes the ``regex`` package.
"""

from __future__ import annotations

import re

#: Characters on whose classes and cases all engines agree.
_SIMPLE = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ‘’“”–—…]*")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_GPT_FAST = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+")
_CLIP_FAST = re.compile(rf"[{_L}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9{_L}]+")


def is_simple(text: str) -> bool:
    return _SIMPLE.fullmatch(text) is not None


class Splitter:
    """Splits by ``pattern``, which must be the byte-level pattern of the rank files."""

    def __init__(self, pattern: str):
        import regex

        self.slow = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return (_GPT_FAST if is_simple(text) else self.slow).findall(text)


def clip_words(text: str) -> list[str]:
    """Pre-tokens of a simple text for the word-end vocabulary, in lower case."""
    return _CLIP_FAST.findall(text.lower())
