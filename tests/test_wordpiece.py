"""Tokens beside the tokenizers library, and streams of real ids beside a plain version."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from stepaudit.functions import wordpiece as wp
from stepaudit.operators import semantic
from stepaudit.plans import semantics


def _library(words):
    t = Tokenizer(models.WordPiece({w: k for k, w in enumerate(words)}, unk_token="[UNK]", max_input_chars_per_word=wp.MAX_WORD))
    t.normalizer, t.pre_tokenizer = normalizers.BertNormalizer(), pre_tokenizers.BertPreTokenizer()
    return t


WORDS = [*wp.SPECIAL, *"abcdefghijklmnopqrstuvwxyz", *[f"##{c}" for c in "abcdefghijklmnopqrstuvwx"], "the", "##ing", "play", "##ful", "un", ",", ".", "漢", "ss", "é", "##12", "1", "##1", "##ß", "-", "#", "##"]


def test_beside_library(spark):
    own, library = wp.WordPiece(WORDS), _library(WORDS)
    rng = random.Random(3)
    odd = "aAbzÄéßñİ漢字 \t\n\r\xa0\x0b\x0c\x85　 .,-#_!¿„“0123\x00�‍́🙂ﬁ한"
    texts = ["", "Playing, unplayful the", "z" * 100, "z" * 101, "über-playing 漢字the", *("".join(rng.choices(odd, k=rng.randint(1, 40))) for _ in range(3000))]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert [k for k, _, _ in own.tokens(t)] == e.ids, repr(t)
        if not {"́", "한", "İ"} & set(t):  # a mark that is dropped may belong to either side
            assert [(a, b) for _, a, b in own.tokens(t)] == e.offsets, repr(t)


def test_table_streams(spark, data):
    words = semantics.vocabulary(spark, data)
    assert words[:4] == wp.SPECIAL and len(set(words)) == len(words) <= semantics.SIZE
    library = _library(words)

    def ids(t):
        return library.encode(t, add_special_tokens=False).ids

    got = {(r.run_id, r.msg_index): r for r in semantics.token_streams(spark, data).collect()}
    prepared = semantic.prepare(semantics.messages(spark, data)).collect()
    assert len(got) == len(prepared) > 10
    reasons = set()
    for p in prepared:
        calls = p.calls
        text = ids(p.text)[: 94 if p.call_count else 254]
        reason = "more-than-four-current-calls" if p.call_count > 4 else "tool-name-exceeds-128-characters" if p.name_overflow else None
        action = [wp.CLS, *text]
        for c in calls:
            name, args = ids(c.name), ids(c.arguments)
            short = args if len(args) <= 31 else args[:16] + args[-15:]
            if len(name) > 8:
                reason = reason or "tool-name-exceeds-eight-tokens"
            if all(k == wp.UNK for k in name[:8]):
                reason = reason or "unknown-or-empty-tool-name"
            if c.arguments.strip() and all(k == wp.UNK for k in short):
                reason = reason or "unknown-only-tool-arguments"
            action += [*name[:8], *short, wp.SEP]
        if not calls and all(k == wp.UNK for k in ids(p.text[len("assistant ") :])[:253]):
            reason = reason or "empty-or-unknown-only-action"
        context = [wp.CLS, *ids(p.task)[:64], *ids(p.prefix)[-190:], wp.SEP]
        r = got[p.run_id, p.msg_index]
        want = [hashlib.md5(",".join(map(str, x)).encode()).hexdigest() for x in (context, [*action, wp.SEP])]
        assert (r.context, r.action, r.support_reason) == (*want, reason)
        reasons.add(reason)
    assert {None, "more-than-four-current-calls", "tool-name-exceeds-eight-tokens"} <= reasons


def test_spans(spark, data):
    words = semantics.vocabulary(spark, data)
    library = _library(words)
    texts = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{data}/conversations.parquet").collect()}
    import regex

    for r in semantics.span_audit(spark, data).collect():
        t = texts[r.conv_id, r.turn]
        w = max(regex.findall(r"\p{L}+", t), key=len, default="")
        at = t.find(w)
        meets = [a < at + len(w) and b > at for a, b in library.encode(t, add_special_tokens=False).offsets]
        assert (r.n_tokens, r.before, r.retained) == (len(meets), sum(meets), sum(meets[:94]))


@pytest.mark.parametrize("rows", [[], [(None,)], [("",)]])
def test_empty(spark, rows):
    df = spark.createDataFrame(rows, "t string")
    assert [r.o for r in df.select(wp.tokens_of(WORDS)(F.col("t")).alias("o")).collect()] == [[] for _ in rows]
    assert wp.build_vocabulary(df, "t") == wp.SPECIAL


def _refuse():
    def run(streams):
        raise ValueError("nothing is left to encode")

    return run


def test_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = spark.createDataFrame([(f"k{k % 30}", [2, *range(k % 30 + 1), 3], [2, k % 30, 3]) for k in range(90)], "key string, context array<int>, action array<int>").repartition(4)
    first, counts = semantic.encode_cached(rows.where("key < 'k2'"), "key", semantics._encoder, semantics.WIDTH, cache)
    held = {r.key: r.pair for r in first.collect()}
    assert counts == {"keys": 12, "hits": 0, "encoded": 12} and len(held) == 12
    with pytest.raises(Exception):  # a job that fails adds nothing
        semantic.encode_cached(rows, "key", _refuse, semantics.WIDTH, cache)
    pairs, counts = semantic.encode_cached(rows, "key", semantics._encoder, semantics.WIDTH, cache)
    assert counts == {"keys": 30, "hits": 12, "encoded": 18}
    again, counts = semantic.encode_cached(rows, "key", _refuse, semantics.WIDTH, cache)
    made = {r.key: r.pair for r in again.collect()}
    assert counts["encoded"] == 0 and made == {r.key: r.pair for r in pairs.collect()} and held.items() <= made.items()
    plain = semantics._encoder()([[2, *range(8), 3], [2, 7, 3]]).ravel()
    assert max(abs(a - b) for a, b in zip(made["k7"], plain, strict=True)) < 1e-6
