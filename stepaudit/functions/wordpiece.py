"""WordPiece tokens with character offsets: greedy longest match over a trie.

Texts are cut, cleaned, stripped of accents and lower-cased as the uncased encoders expect. All of that
is local to a stretch between blanks, so each distinct stretch is worked out once a batch and placed
by its offset. Ids go to the token budgets of ``operators.semantic``, offsets to its span audit.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Special tokens in order, the mark of a piece inside a word, and the longest word in characters.
SPECIAL, INSIDE, MAX_WORD = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"], "##", 100
PAD, UNK, CLS, SEP = range(4)
#: Distinct stretches that a worker remembers.
HELD = 50_000

_STRETCH = re.compile(r"[^\t\n\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_TOKENS = "array<struct<id:int,start:int,end:int>>"


def build_vocabulary(texts: DataFrame, text_col: str, size: int = 30_000) -> list[str]:
    """A vocabulary by counts: the special tokens, every character alone and inside a word, frequent words and endings.

    Words are runs of letters and digits, lower-cased; endings have two to six characters. The rest of
    ``size`` goes to the most frequent of both, ties to the lesser piece. Counts are merged before the shuffle.
    """
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n"))
    cut = F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length("w"))), lambda k: F.concat(F.lit(INSIDE), F.right("w", k)))
    cut = F.when(F.length("w") > 2, F.filter(cut, lambda p: F.length(p) < F.length("w") + len(INSIDE))).otherwise(F.array().cast("array<string>"))
    pieces = counted.select(F.explode(F.concat(F.array("w"), cut)).alias("p"), "n").groupBy("p").agg(F.sum("n").alias("n"))
    letters = counted.select(F.explode(F.split("w", "")).alias("c")).where("c != ''").distinct().orderBy("c").limit(size).collect()  # characters in use
    base = [c for r in letters for c in (r.c, INSIDE + r.c)]
    top = pieces.where(F.length(F.regexp_replace("p", f"^{INSIDE}", "")) > 1).orderBy(F.desc("n"), "p").limit(max(0, size - len(base) - len(SPECIAL)))
    return [*SPECIAL, *base, *(r.p for r in top.collect())]  # at most size


class WordPiece:
    """A vocabulary as two tries: pieces that begin a word, and pieces inside one. An id is a piece's place in the list."""

    def __init__(self, vocabulary: list[str]):
        self.first: dict = {}
        self.inside: dict = {}
        self.held: dict[str, list[tuple[int, int, int]]] = {}
        for k, piece in enumerate(vocabulary):
            node, text = (self.inside, piece[len(INSIDE) :]) if piece.startswith(INSIDE) and len(piece) > len(INSIDE) else (self.first, piece)
            for c in text:
                node = node.setdefault(c, {})
            node[""] = k

    def match(self, word: str) -> list[tuple[int, int, int]]:
        """Id, start and end of the longest pieces from left to right; one unknown token if some part has none."""
        out, at = [], 0
        if len(word) <= MAX_WORD:
            while at < len(word):
                node, end, best = self.first if at == 0 else self.inside, at, None
                while end < len(word) and word[end] in node:
                    node = node[word[end]]
                    end += 1
                    if "" in node:
                        best = (node[""], at, end)
                if best is None:
                    break
                out.append(best)
                at = best[2]
            else:
                return out
        return [(UNK, 0, len(word))]

    def stretch(self, raw: str) -> list[tuple[int, int, int]]:
        """Tokens of a stretch without blanks, with offsets in it."""
        words: list[list[tuple[str, int]]] = [[]]
        for i, c in enumerate(raw):
            code, kind = ord(c), unicodedata.category(c)
            if code in (0, 0xFFFD) or kind in ("Cc", "Cf", "Co", "Cs"):
                continue
            alone = _ideograph(code)
            for d in unicodedata.normalize("NFD", c):
                if unicodedata.category(d) == "Mn":
                    continue
                for x in d.lower():
                    if alone or _punctuation(x):
                        words += [[(x, i)], []]
                    else:
                        words[-1].append((x, i))
        out = []
        for w in filter(None, words):
            out += [(k, w[a][1], w[b - 1][1] + 1) for k, a, b in self.match("".join(x for x, _ in w))]
        return out

    def tokens(self, text: str | None) -> list[tuple[int, int, int]]:
        """Id, start and end (in code points of ``text``) of all tokens; a null text has none."""
        out = []
        for m in _STRETCH.finditer(text or ""):
            raw, at = m.group(), m.start()
            found = self.held.get(raw)
            if found is None:
                found = self.stretch(raw)
                if len(self.held) < HELD and len(raw) <= MAX_WORD:
                    self.held[raw] = found
            out += [(k, a + at, b + at) for k, a, b in found] if at else found
        return out


def _punctuation(c: str) -> bool:
    return (c.isascii() and not c.isalnum() and c.isprintable() and c != " ") or unicodedata.category(c).startswith("P")


def _ideograph(code: int) -> bool:
    """Whether a character stands as a word of its own (fixed blocks)."""
    blocks = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B920, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]
    return code >= 0x3400 and any(a <= code <= b for a, b in blocks)


_MADE: dict[int, tuple[list[str], WordPiece]] = {}


def _ready(vocabulary: list[str]) -> WordPiece:
    """One tokenizer a worker and vocabulary, whose tries and words are kept between batches."""
    key = hash(tuple(vocabulary))
    if key not in _MADE or _MADE[key][0] != vocabulary:
        _MADE.clear()
        _MADE[key] = (vocabulary, WordPiece(vocabulary))
    return _MADE[key][1]


def tokens_of(vocabulary: list[str]) -> Callable[[Column], Column]:
    """A function from a text column to its tokens, an array of ``id, start, end``."""

    @F.pandas_udf(_TOKENS)
    def run(values: pd.Series) -> pd.Series:
        model = _ready(vocabulary)
        return values.map(lambda t: [{"id": k, "start": a, "end": b} for k, a, b in model.tokens(t)])

    return run


def ids_of(vocabulary: list[str]) -> Callable[[Column], Column]:
    """A function from an array of texts to the token ids of each."""

    @F.pandas_udf("array<array<int>>")
    def run(values: pd.Series) -> pd.Series:
        model = _ready(vocabulary)
        return values.map(lambda texts: [[k for k, _, _ in model.tokens(t)] for t in texts] if texts is not None else None)

    return run


def tokenize(prepared: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Token ids of prepared actions (``operators.semantic.prepare``) as ``operators.semantic.streams`` takes them.

    ``text_tokens`` also has the offsets of the action's text.
    """
    one, many = tokens_of(vocabulary), ids_of(vocabulary)
    content = F.substr("text", F.lit(len("assistant ") + 1))
    fields = F.array("task", "prefix", content)
    names, args = F.transform("calls", lambda c: c["name"]), F.transform("calls", lambda c: c["arguments"])
    made = prepared.withColumns({"text_tokens": one(F.col("text")), "__f": many(fields), "__n": many(names), "__a": many(args)})
    calls = F.transform(F.arrays_zip(F.col("__n").alias("n"), F.col("__a").alias("a"), args.alias("t")), lambda c: F.struct(c["n"].alias("name"), c["a"].alias("arguments"), c["t"].rlike(r"(?U)\S").alias("has_arguments")))
    return made.withColumns({
        "task": F.get("__f", F.lit(0)), "prefix": F.get("__f", F.lit(1)), "content": F.get("__f", F.lit(2)), "text": F.transform("text_tokens", lambda t: t["id"]), "calls": calls,
    }).drop("__f", "__n", "__a")
