"""Token counts by a two-tier lookup on the map side.

The first tier is a compact table of the token counts of frequent pre-tokens, at most
``table_words`` of them, which goes to the workers as a broadcast. It holds the words that the
vocabulary has whole, in the order of its ids, as a vocabulary is built from the most frequent ones;
so no pass over the corpus and no shuffle of pre-tokens is needed. The second tier is a worker's cache
of what it has encoded itself with the library, emptied at a bound. The table only saves time: any
table gives the same counts.

A stretch between blanks with characters on which engines may differ, or with a special-token string,
is counted by the library as one piece, through the same cache; no pre-token spans a blank.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepaudit.llm.pretokens import clip_words, is_simple

TABLE_WORDS = 65_536
CACHE_WORDS = 500_000
LIMIT = 2048
#: What ends a word in the vocabulary file.
WORD_END = "</w>"
_STATE: dict[str, tuple] = {}
_BLANKS = re.compile("[ \t\n\r]+")


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _lengths(t, words: list[str]) -> list[int]:
    return [len(e.ids) for e in t.encode_batch_fast(words, add_special_tokens=False)]


def frequent_table(path: str, table_words: int = TABLE_WORDS) -> tuple[bytes, bytes]:
    """Words of the vocabulary, joined by line feeds, and a byte with each one's token count."""
    t = _tokenizer(path)
    ids = sorted(t.get_vocab().items(), key=lambda kv: kv[1])
    words = [w.removesuffix(WORD_END) for w, _ in ids if w.endswith(WORD_END)]
    words = [w for w in dict.fromkeys(words) if w and is_simple(w) and clip_words(w) == [w]][:table_words]
    return "\n".join(words).encode(), bytes(_lengths(t, words))


def _pieces(text: str, special: list[str]) -> list[str]:
    """Pre-tokens, and whole stretches between blanks that the library must split itself."""
    if is_simple(text) and not any(s in text for s in special):
        return clip_words(text)
    out: list[str] = []
    for part in _BLANKS.split(text):
        if is_simple(part) and not any(s in part for s in special):
            out += clip_words(part)
        elif part:
            out.append(part)
    return out


def _count(path: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _STATE:
            t = _tokenizer(path)
            words, lengths = table.value
            first = dict(zip(words.decode().split("\n"), lengths, strict=True)) if lengths else {}
            _STATE[path] = (t, [x.content for x in t.get_added_tokens_decoder().values()], first, dict(first))
        t, special, first, known = _STATE[path]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                n_bytes.append(len(text.encode()))
                words = _pieces(text, special)
                if new := list(set(words).difference(known)):
                    known.update(zip(new, _lengths(t, new), strict=True))
                n_tokens.append(sum(map(known.__getitem__, words)))
                if len(known) > CACHE_WORDS:
                    known.clear()
                    known.update(first)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n_bytes": pa.array(n_bytes, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "over_limit": pa.array(np.array(n_tokens, np.int64) > limit, pa.bool_())}
            )

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, table_words: int = TABLE_WORDS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    Defined cases: a null text is an empty one, with no tokens; rows that repeat an id each give a
    row and a null id stays null; other columns are ignored. Special-token strings count as the
    library counts them by default.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(path, table_words))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _count(path, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
