"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from stepaudit.llm import bpe, chat, flac, language_id, line_dedup, lm_score, minhash, packing, queries, token_counts, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h1 string, n string, l string, score string, key string"
LONG = "word " * 60_000 + "x" * 20_000
BLOCK = "first line here\nsecond line here\nthird line here"


def _rows():
    made = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, f"a\n{BLOCK}\nb"), (5, f"a\n{BLOCK}\nb"), (6, f"c\n{BLOCK}"), (None, "lost id"), (None, None), (7, "ÄÖ ü 漢字 🙂"), (8, "same words in the same order for two"), (9, "same words in the same order for two")]
    return [(k, t, "en" if (k or 0) % 2 else None, None, None, 5, "x", "y", "z", "s", "k") for k, t in made]


RUNS = {
    "line_dedup": line_dedup.dedup_lines,
    "minhash": minhash.near_duplicates,
    "bpe": lambda d: bpe.encode_decode(d, queries.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), queries.public_tokenizers.PATTERN),
    "flac": lambda d: flac.digests(flac.to_media(d)),
    "packing": queries.packed,
    "token_counts": lambda d: token_counts.count_tokens(d, queries.public_tokenizers.path("word_bpe_49k.json")),
    "lm_score": lm_score.score,
    "language_id": language_id.language_id,
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    rows = RUNS[name](spark.createDataFrame(_rows(), SCHEMA)).collect()
    assert len(rows) >= 12
    assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_line_windows(spark):
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(_rows(), SCHEMA)).where("doc_id IN (1, 2, 5, 6)").collect()}
    assert got == {1: (None, None), 2: ("", 0), 5: (f"a\n{BLOCK}\nb", 0), 6: ("c", 3)}


def test_near_copies(spark):
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(_rows(), SCHEMA)).where("doc_id >= 8 OR doc_id = 2").collect()}
    assert got == {2: (2, True), 8: (8, True), 9: (8, False)}


def test_perspectives(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, None, "x"), (None, 0, "ann", "y")], "conv_id long, turn long, role string, text string")
    rows = chat.rotate_perspectives(turns).collect()
    assert {(r.conv_id, r.speaker) for r in rows} == {(1, "ann"), (1, "bob"), (1, "unnamed"), (None, "ann")}
    for r in rows:
        assert (r.mask_start is not None) == (r.role == "assistant") and r.length == len(r.segment)
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_top_k(spark):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [None, 1.0]), (5, None), (6, [float("nan"), 1.0]), (7, [-1.0, 0.5])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    big = 256 * 256 * 5
    assert got == [(0, 1, 3, big), (0, 2, 50, big), (0, 3, 7, 0), (50, 1, 0, big), (50, 2, 3, big), (50, 3, 7, 0)]
    assert topk.top_k(v.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_bpe_first_id(spark):
    """Words that are or begin with the piece of id 0, which is "!"."""
    texts = ["!", "Hello!", "a!", "!)", " !", "!\n!", "!\u6f22", "!!", "! !a"]
    ranks = bpe.load_ranks(queries.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=queries.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.encode_decode(docs, queries.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), queries.public_tokenizers.PATTERN, with_ids=True).collect()
    assert {r.doc_id: (r.ids, bytes(r.decoded).decode()) for r in rows} == {k: (own.encode_ordinary(t), t) for k, t in enumerate(texts)}


def test_bpe_splits_together(spark, tmp_path):
    """Splits share tasks, so that a word of several is folded once; ids as tiktoken's, also at the bound of the fold."""
    path, pattern = queries.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), queries.public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = np.random.default_rng(5)
    words = ["".join(chr(c) for c in rng.choice([*range(97, 123), 233, 0x6F22, 0x1F600], n)) for n in (*range(1, 40), bpe.FOLD_BYTES // 4)]
    texts = ["", None, "a", "x" * (bpe.FOLD_BYTES + 1), *(" ".join(rng.choice(words, 30)) for _ in range(200))]
    parts = 3 * bpe.SPLITS * spark.sparkContext.defaultParallelism
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts).localCheckpoint()
    fewer = bpe.together(docs)
    assert docs.rdd.getNumPartitions() == parts and fewer.rdd.getNumPartitions() == parts // bpe.SPLITS
    assert bpe.together(docs.coalesce(2)).rdd.getNumPartitions() == 2
    rows = bpe.encode_decode(fewer, path, pattern, with_ids=True).collect()
    assert {r.doc_id: (r.n_tokens, r.ids, bytes(r.decoded).decode()) for r in rows} == {k: (len(ids := own.encode_ordinary(t or "")), ids, t or "") for k, t in enumerate(texts)}


def test_bpe_ranks_of_pairs():
    """The table of pairs gives every pair's rank, and none to pairs without one."""
    path = queries.public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    pieces = {r: p for p, r in ranks.items()}
    offset, slots = bpe._pair_table(path)
    pairs = {(x, y): r for p, r in ranks.items() for k in range(1, len(p)) if (x := ranks.get(p[:k])) is not None and (y := ranks.get(p[k:])) is not None}
    other = np.random.default_rng(6).integers(0, len(ranks), (100_000, 2)).tolist()
    for x, y in [*pairs, *map(tuple, other)]:
        assert min(slots[offset[x + y] + y] ^ (y << 16), bpe._NONE) == ranks.get(pieces[x] + pieces[y], bpe._NONE)


def test_lm_trains_on_every_word(spark):
    """Words that only stand at places 1, 2 and 3 of each four are learned too."""
    docs = spark.createDataFrame([(k, "one two two two " * 200) for k in range(20)], "doc_id long, text string").coalesce(1)
    assert all(r.mean_log_probability > -0.7 for r in lm_score.score(docs).collect())


def test_lm_gradient():
    """A step of the fit lowers the loss as the numeric gradient says."""
    rng = np.random.default_rng(3)
    n = np.zeros((lm_score.SIDES**2, lm_score.TARGETS), np.int64)
    n[rng.integers(0, lm_score.SIDES**2, 300), rng.integers(0, 20, 300)] += 5
    loss = []
    for epochs in (0, 5, 40):
        net = lm_score.fit(n.ravel(), epochs)
        used = np.flatnonzero(n.sum(1))
        loss.append(-(lm_score.log_softmax(net, used // lm_score.SIDES, used % lm_score.SIDES)[0] * n[used]).sum() / n.sum())
    assert loss[0] > loss[1] > loss[2]


def test_packing_small_sources(spark):
    """100 small sources beside a hot one, and some of less than an id a window: each has its share of every window."""
    rows = [(k, "one word after another " * (500 if k < 20 else 40 if k < 420 else 1), "hot" if k < 20 else f"s{k % 100}" if k < 420 else f"tiny{k % 5}") for k in range(430)]
    path = queries.public_tokenizers.path
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN, length=1000).collect()
    source, sizes, windows, spans = {k: s for k, _, s in rows}, defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(list)
    for r in got:
        sizes[source[r.doc_id]] += r.length
        windows[r.sequence_id][source[r.doc_id]] += r.length
        spans[r.sequence_id].append((r.offset, r.length))
    total, had = sum(sizes.values()), defaultdict(int)
    assert sorted(windows) == list(range(-(-total // 1000))) and len(sizes) == 106
    for w in sorted(windows):
        at = 0
        for offset, length in sorted(spans[w]):
            assert offset == at
            at += length
        assert at == min(1000, total - 1000 * w)
        for s in sizes:
            had[s] += windows[w][s]
            assert abs(had[s] - min((w + 1) * 1000, total) * sizes[s] / total) < 4


def test_packing_targets(spark):
    """Other targets than the natural ones: kept while all queues last, then shared among those that are left."""
    rows = [(k, "one word after another " * 30, "abc"[k % 3]) for k in range(300)]
    path = queries.public_tokenizers.path
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {"a": 6.0, "b": 3.0, "c": 1.0}
    got = packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN, length=500, targets=targets).collect()
    source, windows = {k: s for k, _, s in rows}, defaultdict(lambda: defaultdict(int))
    for r in got:
        windows[r.sequence_id][source[r.doc_id]] += r.length
    size, total = sum(w["a"] for w in windows.values()), sum(r.length for r in got)
    had, left = defaultdict(float), dict.fromkeys("abc", float(size))
    want = dict.fromkeys("abc", 0.0)
    for w in sorted(windows):
        room = min(500, total - 500 * w)
        assert sum(windows[w].values()) == room
        while room > 1e-6:  # a plain round-robin with fractions of ids
            live = [s for s in "abc" if left[s] > 1e-6]
            if not live:
                break
            share = sum(targets[s] for s in live)
            x = min(room, *[left[s] * share / targets[s] for s in live])
            for s in live:
                want[s] += x * targets[s] / share
                left[s] -= x * targets[s] / share
            room -= x
        for s in "abc":
            had[s] += windows[w][s]
            assert abs(had[s] - want[s]) < 4, (w, s)
    for bad in ({"a": -1.0}, {"a": float("nan")}, {"a": 0.0}):
        with pytest.raises(ValueError):
            packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), queries.public_tokenizers.PATTERN, targets=bad)


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    """Every id of every queue has one place, whatever sizes and targets."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 8))
    sizes = [int(x) for x in rng.integers(1, 200 if seed else 3, n)]
    plan = packing.Plan(sizes, 16, [int(x) for x in rng.integers(1, 50, n)] if seed % 2 else None)
    places = []
    for q, size in enumerate(sizes):
        at = 0
        while at < size:
            m = min(int(rng.integers(1, 40)), size - at)
            got = list(plan.pieces(q, at, m))
            assert sum(x[1] for x in got) == m
            places += [16 * w + o + k for _, length, w, o in got for k in range(length)]
            at += m
    assert sorted(places) == list(range(sum(sizes)))


def test_rare_language(spark):
    """A label of few rows beside a large one, repeated ids and null ids are all learned, whatever the layout."""
    words = {"en": "the quick brown fox and the lazy dog", "de": "der schnelle braune Fuchs und der faule Hund", "xx": "zzyx qwwz zyzzy xqq"}
    rows = [(k if k % 3 else None, f"{words['en']} {k}", "en") for k in range(400)] + [(5, f"{words['de']} {k}", "de") for k in range(60)] + [(k, words["xx"], "xx") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True), sample=90)
    assert model.langs == ["de", "en", "xx"] and [model.predict(words[k])[0] for k in model.langs] == model.langs
    other = language_id.train(docs.repartition(7), F.lit(True), sample=90)
    assert np.allclose(model.weights, other.weights) and model.temperature == other.temperature


def test_ftrl_by_hand():
    """The fit of one row with one feature, worked out beside it."""
    m = language_id.Model(["a", "b"], np.ones(language_id.FEATURES))
    m.fit([(np.array([7]), np.array([1.0]), 0)], epochs=1)
    g = np.array([0.5 - 1, 0.5])  # both weights are zero, so p is a half
    z, n = g, g * g
    want = -(z - np.sign(z) * language_id.L1) / ((language_id.BETA + np.sqrt(n)) / language_id.ALPHA + language_id.L2)
    assert np.allclose(m.weights[7], want) and np.count_nonzero(m.weights) == 2


def test_near_copies_of_repeated_ids(spark):
    """Rows of one id with other texts keep their own links; the pipeline keeps the right rows."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(0, base, "a"), (1, base, "b"), (1, "quite another text with more than five words in it", "c"), (1, "quite another text with more than five words in it", "c"), (2, base + " tail", "d"), (3, "", "e"), (3, "", "e"), (None, base, "f"), (4, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n) for r in minhash.one_of_each(docs).collect())
    assert got == [(-1, "f"), (0, "a"), (1, "c"), (3, "e"), (4, "g")]
    comp = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert comp[(1, 56)] == 0 and comp[(1, 6)] == 1 and comp[(2, 57)] == 0 and comp[(None, 56)] is None


def test_dense_groups(spark):
    """Many texts that are close in signature but not linked, a chain and a hub, beside brute force."""
    rng = np.random.default_rng(5)
    core = [f"c{k}" for k in range(80)]
    rows = []
    for k in range(150):  # about 0.7 alike
        words = list(core)
        for p in rng.choice(80, 4, replace=False):
            words[p] = f"x{rng.integers(10**9)}"
        rows.append((k, " ".join(words)))
    words = [f"y{k}" for k in range(100)]
    for k in range(40):  # each close to the one before
        words[(k * 7) % 100] = f"z{k}"
        rows.append((1000 + k, " ".join(words)))
    hub = [f"h{k}" for k in range(100)]
    rows += [(2000 + k, " ".join(hub + [f"t{k}_{j}" for j in range(k % 9)])) for k in range(60)]
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            if 100 * len(a & b) >= 80 * len(a | b):
                u, v = find(ids[x]), find(ids[y])
                root[max(u, v)] = min(u, v)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {i: find(i) for i in ids}


def test_token_counts_of_odd_texts(spark):
    """Special strings, blanks and characters of every kind, beside the library on whole texts."""
    path = queries.public_tokenizers.path("word_bpe_49k.json")
    t = token_counts._tokenizer(path)
    texts = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "don't I'LL it's", "漢字 kana カナ mixed漢字word", "e\u0301 x\u0301y", "İstanbul ſ ß ÄÖ", "tab\tand\u00a0nbsp\u2003em\x1cfs\x85nel", "🙂🙂 a🙂b", "١٢٣ 12³", "a  b\r\n c", "", " ", "x" * 5000 + " é" * 50, "<|endoftext", "…—“”", "K\u212a"]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    assert got == {k: len(t.encode(x, add_special_tokens=False).ids) for k, x in enumerate(texts)}
    none = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, table_words=0).collect()}
    assert none == got


class _Writer:
    """Bits of a FLAC stream, written one at a time: an independent encoder for the decoder's tests."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in reversed(range(n))]

    def unary(self, q):
        self.bits += [0] * q + [1]

    def bytes(self):
        b = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, b[i : i + 8])), 2) for i in range(0, len(b), 8))


def _crc(data, poly, width):
    c, top = 0, 1 << (width - 1)
    for b in data:
        c ^= b << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & ((1 << width) - 1)
    return c


def _residual(w, res, order, parts, wide, n, escape):
    w.put(int(wide), 2)
    w.put(parts.bit_length() - 1, 4)
    at = 0
    for p in range(parts):
        size = n // parts - (order if p == 0 else 0)
        part, at = res[at : at + size], at + size
        if escape and p % 2 == 0:
            width = max((abs(x).bit_length() + 1 for x in part), default=0) if any(part) else 0
            w.put(31 if wide else 15, 5 if wide else 4)
            w.put(width, 5)
            for x in part:
                w.put(x & ((1 << width) - 1), width)
            continue
        k = 17 if wide and p == 1 else 3
        w.put(k, 5 if wide else 4)
        for x in part:
            z = x << 1 if x >= 0 else (-x << 1) - 1
            w.unary(z >> k)
            w.put(z & ((1 << k) - 1), k)


def _stream(frames, bps=16):
    """Frames of (kind, samples, options), each with its own block size."""
    import hashlib

    out, start = b"", 0
    for number, (kind, x, o) in enumerate(frames):
        w, n, waste = _Writer(), len(x), o.get("waste", 0)
        w.put(0b111111111111100, 15), w.put(1, 1)  # frames of varying size are numbered by samples
        w.put(7, 4), w.put(0, 4), w.put(0, 4), w.put({8: 1, 16: 4}[bps], 3), w.put(0, 1)
        if start < 0x80:
            w.put(start, 8)
        else:
            w.put(0xC0 | start >> 6, 8), w.put(0x80 | start & 63, 8)
        w.put(n - 1, 16)
        w.put(_crc(w.bytes(), 7, 8), 8)
        y, depth = [v >> waste for v in x], bps - waste
        order = o.get("order", 0)
        code = {"const": 0, "verb": 1, "fixed": 8 + order, "lpc": 31 + order}[kind]
        w.put(0, 1), w.put(code, 6), w.put(int(waste > 0), 1)
        if waste:
            w.unary(waste - 1)
        mask = (1 << depth) - 1
        if kind == "const":
            w.put(y[0] & mask, depth)
        elif kind == "verb":
            for v in y:
                w.put(v & mask, depth)
        else:
            for v in y[:order]:
                w.put(v & mask, depth)
            if kind == "fixed":
                coef, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
            else:
                coef, shift = o["coef"], o["shift"]
                w.put(14, 4), w.put(shift, 5)
                for c in coef:
                    w.put(c & 0x7FFF, 15)
            res = [y[i] - (sum(c * y[i - 1 - k] for k, c in enumerate(coef)) >> shift) for i in range(order, n)]
            _residual(w, res, order, o.get("parts", 1), o.get("wide", False), n, o.get("escape", False))
        body = w.bytes()
        out += body + _crc(body, 0x8005, 16).to_bytes(2)
        start += n
    raw = b"".join(v.to_bytes(bps // 8, "little", signed=True) for _, x, _ in frames for v in x)
    info = (16).to_bytes(2) + (65535).to_bytes(2) + bytes(6) + ((8000 << 44) | ((bps - 1) << 36) | start).to_bytes(8) + hashlib.md5(raw).digest()
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3) + info + out, [v for _, x, _ in frames for v in x]


def test_flac_decoder(spark):
    """Every kind of subframe, partitions, both Rice methods, escapes and wasted bits from an independent encoder."""
    rng = np.random.default_rng(8)

    def wave(n, scale=3000):
        return [int(v) for v in np.clip(np.cumsum(rng.normal(0, scale / 20, n)), -scale, scale)]

    frames = [("const", [-7] * 32, {}), ("verb", wave(48), {}), ("verb", [v * 8 for v in wave(24, 300)], {"waste": 3})]
    frames += [("fixed", wave(64), {"order": k, "parts": 4}) for k in range(5)]
    frames += [("fixed", wave(64), {"order": 2, "parts": 4, "escape": True}), ("fixed", [0] * 64, {"order": 1, "parts": 2, "escape": True}), ("fixed", wave(64), {"order": 1, "parts": 2, "wide": True})]
    frames += [("lpc", wave(64), {"order": k, "coef": [int(c) for c in rng.integers(-900, 900, k)], "shift": 9, "parts": 2, "wide": k > 8}) for k in (1, 4, 12)]
    frames += [("lpc", [v * 4 for v in wave(32, 500)], {"order": 2, "coef": [1000, -500], "shift": 9, "waste": 2})]
    stream, want = _stream(frames)
    assert flac.decode([stream, stream])[1].tolist() == want
    media = spark.createDataFrame([(1, stream), (None, stream), (2, None)], "doc_id long, media binary")
    rows = flac.pcm_blocks(media).where("doc_id = 1").collect()
    assert [r.sample_offset for r in rows] == list(range(0, len(want), flac.PCM_BLOCK))
    assert np.concatenate([np.frombuffer(r.pcm, "<i4") for r in rows]).tolist() == want
    for at in (len(stream) - 5, len(stream) // 2, 30):
        bad = bytearray(stream)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_pcm_seek(spark):
    """A long text in blocks: each is found by its offset, and the digests are those of a plain reading."""
    text = "abc é" * 5000
    raw = text.encode()
    payload = raw + b" " * (-len(raw) % 192)
    media = flac.to_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    rows = {r.sample_offset: np.frombuffer(r.pcm, "<i4") for r in flac.pcm_blocks(media).collect()}
    x = np.frombuffer(payload, np.uint8).astype(int) - 128
    assert sorted(rows) == list(range(0, len(x), flac.PCM_BLOCK)) and all((rows[a] == x[a : a + flac.PCM_BLOCK]).all() for a in rows)
    got = flac.digests(media).first()
    assert got.feature == f"energy={(x * x).sum()};peak={abs(x).max()};crossings={((x[1:] < 0) != (x[:-1] < 0)).sum()}"
    assert (got.media_bytes, got.media_sha256) == (lambda m: (len(m), __import__("hashlib").sha256(m).hexdigest()))(bytes(media.first().media))
