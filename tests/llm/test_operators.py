"""Each operator against a brute-force version, on the smallest tables and on odd rows."""

import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborsim.llm import curriculum, decontaminate, flac, jaccard_join, pii_crf, quality, registry, reply_trees, sharding, token_files, toxicity
from arborsim.llm.components import components
from arborsim.llm.elias_fano import EliasFano, encode

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, score double, size string, node string, _d int"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(80))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 4), (4, "one two", "en", "a", 7), (5, "one two", "en", None, 7), (6, LONG, "en", "b", 1), (7, BASE, "en", "b", 1), (8, BASE.upper(), "de", "b", 1),
    (9, BASE.replace("alpha79", "omega"), "de", "b", 1), (9, BASE.replace("alpha79", "omega"), "de", "b", 1), (None, "lost words here and there now", "en", "c", 3), (11, "mail a.b@c.de or 10.0.0.300 and 10.0.0.3, +1 (408) 555-7800", "en", "c", 3), (12, "é ñ <|endoftext|>   x", "fr", "é", 3), (13, "a\n\nb  c ", "fr", "é", 3),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "k", 0.5, "s", "n", 1) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def counted(rows):
    return sorted(map(str, rows))


# 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(steps):
    v = np.cumsum(np.array(steps, np.uint64)) if steps else np.zeros(0, np.uint64)
    e = EliasFano(encode(v))
    assert e.values().tolist() == v.tolist()
    assert [e.select(i) for i in range(len(v))] == v.tolist()
    for a, b in ((0, len(v) // 2), (len(v) // 3, len(v)), (len(v) // 2, len(v) // 2), (min(63, len(v)), min(130, len(v)))):
        assert e.select_range(a, b).tolist() == v[a:b].tolist()
    with pytest.raises(IndexError):
        e.select(len(v))


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000))
    assert 8 * len(encode(v)) / len(v) < 2 + np.log2(v[-1] / len(v)) + 1


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "the", "Word", "'s", "9", "é", ".", "!?", " ", "漢", "<|endoftext|>", "\r", "_x"]), max_size=14))
def test_memo_tokenizer_equals_library(parts):
    import public_tokenizers

    t = token_files.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    text = "".join(parts)
    assert t.encode([text])[0].tolist() == t.of.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("change", ["plain", "prefix", "added", "lower", "spaced"])
def test_memo_tokenizer_guards_its_shortcut(path, tmp_path, change):
    """Tokenizers whose pattern differs go through the library whole."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    t = Tokenizer.from_file(path)
    if change == "prefix":
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    elif change == "added":
        t.add_tokens(["ord"])
    elif change == "spaced":
        t.add_tokens(["the Word"])
    elif change == "lower":
        t.normalizer = normalizers.Lowercase()
    t.save(f"{tmp_path}/t.json")
    memo = token_files.MemoTokenizer(f"{tmp_path}/t.json")
    assert memo.direct == (change == "plain")
    for text in ("the Word, Words\nthe Word words", "a  b", " Wordé the Word."):
        assert memo.encode([text])[0].tolist() == Tokenizer.from_file(f"{tmp_path}/t.json").encode(text, add_special_tokens=False).ids


def brute_tokens(rows, path):
    import xxhash
    from tokenizers import Tokenizer

    t, out, start = Tokenizer.from_file(path), [], 0
    signed = lambda x: x - (1 << 64) * (x >> 63)
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42)), r[1].encode())):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, docs, odd, none, path, tmp_path):
    hot = spark.createDataFrame([(5, f"text {i % 90} of many") for i in range(300)] + [(None, None)] * 200 + [(i, "one") for i in range(9)], "doc_id long, text string")
    for i, df in enumerate((docs, odd, none, hot)):
        token_files.write(df, path, f"file://{tmp_path}/{i}", block_ids=5000)
        assert counted(token_files.read(spark, f"file://{tmp_path}/{i}").collect()) == counted([f"Row(doc_id={a}, start={b}, n_tokens={c}, ids_crc32={d})" for a, b, c, d in brute_tokens(texts(df), path)])


def test_one_id_is_dealt_to_many_images(spark, path, tmp_path):
    hot = spark.createDataFrame([(5, f"text {i} of many") for i in range(4000)], "doc_id long, text string")
    token_files.write(hot, path, f"file://{tmp_path}/hot", partitions=8)
    images = spark.read.parquet(f"file://{tmp_path}/hot")
    assert images.count() == 8 and images.selectExpr("max(size(doc_ids))").first()[0] < 1000
    row = images.where("part = 3").first()
    ends, flat = token_files.read_image(bytes(row.image))
    every = np.split(flat, ends.values().astype(int))
    assert all((token_files.read_document(bytes(row.image), i) == every[i]).all() for i in (0, 1, 100, ends.n - 1))


def test_damaged_image(path):
    data = token_files.image([np.array([1, 2, 0], np.uint16)])
    with pytest.raises(ValueError):
        token_files.read_image(data[:-1] + b"\x09")


# 2


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-+ 0159()_é", max_size=60))
def test_base_spans(text):
    assert pii_crf.base_spans(text) == brute_spans(text)


def test_base_spans_of_long_runs_take_linear_time():
    assert pii_crf.base_spans("9" * 300_000 + " " + "a" * 300_000) == []
    assert pii_crf.base_spans("0" * 6000 + ".1.1.1") == [(0, 1, 6006)]


def test_pii_query(docs, odd, none):
    model = pii_crf.fit(docs)
    for df in (docs, odd, none):
        got = pii_crf.find(df, model).collect()
        assert counted((r.doc_id, [(s.start, pii_crf.KINDS.index(s.kind), s.end) for s in r.base]) for r in got) == counted((d, brute_spans(t)) for d, t in texts(df))


def test_skip_links_carry_labels(docs):
    model = pii_crf.fit(docs)
    text = "call +1 (408) 555-7800 today or later, it is far away from here and long after that 1 408 555 7800 again"
    base, every = model.spans(text)
    assert len(base) == 1 and set(base) < set(every) and every[1][1] == 3
    assert model.spans("order 1 408 555 7800 is not repeated")[1] == []


def test_skip_links_reach_everywhere(docs):
    apart = " and so it went on for a long while without a number, "
    loose = apart + "1 408 555 7800"
    bare = pii_crf.SkipChainCRF()  # candidates lean to no label, so all they know comes from the base site
    bare.skip = np.eye(len(bare.skip)) * 5
    bare.unary[0, 0] = 1
    for model in (bare, pii_crf.fit(docs)):
        for n in (1, 2, 40, 500):
            for text in ("+1 (408) 555-7800" + loose * n, loose * n + apart + "+1 (408) 555-7800"):
                base, every = model.spans(text)
                assert len(base) == 1 and len(every) == n + 1 and {k for _, k, _ in every} == {3}


def test_skip_links_are_agreement_only(spark):
    """A loose copy is found by its like alone: the same form with other digits isn't, nor a key without a name."""
    model = pii_crf.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    text = "card 4845168114407329 and later 4845/1681/1440/7329 was seen, then far away 4845/1681/1440/7321"
    base, every = model.spans(text)
    assert [text[a:b] for a, k, b in every if (a, k, b) not in base] == ["4845/1681/1440/7329"]
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    assert [k for _, k, _ in model.spans(f'the token = "{key}" is not public')[1]] == [4]
    assert model.spans(f"commit {key} is public")[1] == []


def test_secrets_of_the_table(spark):
    """All of them, and beside them only cards that stand side by side, of which the rules make one and drop it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, planted, found, cards = pii_crf.fit(docs), set(), set(), []
    for d, t in texts(docs):
        planted |= {(d, m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
        base, every = model.spans(t)
        more = [s for s in every if s not in base]
        found |= {(d, a, b) for a, k, b in more if k == 4}
        cards += [t[a:b] for a, k, b in more if k != 4]
    assert planted and found == planted
    assert all(12 <= len(n) <= 19 and pii_crf.luhn(n) for c in cards for n in c.split())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 6), st.booleans())
def test_marginals_of_small_fields(seed, n, loopy):
    """Exact on trees; close on loops with weak potentials."""
    import itertools

    rng = np.random.default_rng(seed)
    m = pii_crf.SkipChainCRF()
    k, f = m.unary.shape
    m.unary = rng.normal(size=(k, f))
    m.chain, m.skip = (rng.normal(size=(k, k)) * (0.3 if loopy else 1.0) for _ in range(2))
    m.chain, m.skip = (m.chain + m.chain.T) / 2, (m.skip + m.skip.T) / 2
    feats = rng.normal(size=(n, f)) / np.sqrt(f)
    chain = [(i, i + 1) for i in range(n - 1)]
    skip = [(0, 0), (n - 1, 0)] if loopy else [(0, 0)]
    p = np.zeros((n, k))
    unary = feats @ m.unary.T
    for y in itertools.product(range(k), repeat=n):
        at = sum(unary[i, c] for i, c in enumerate(y)) + sum(m.chain[y[i], y[j]] for i, j in chain)
        w = np.exp(at) * sum(np.exp(sum(m.skip[y[i], h] for i, _ in skip)) for h in range(k))
        p[range(n), y] += w
    got = m.marginals(feats, [-1] * n, chain, skip)
    assert np.abs(got - p / p.sum(1, keepdims=True)).max() < (0.1 if loopy else 1e-3)


# 3


def brute_groups(rows, size=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    name = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            name[root(i)] = min(d, name.get(root(i), d))
    return [(rows[i][0], len(sets[i]), name.get(root(i)) if sets[i] else rows[i][0]) for i in range(len(rows))]


def test_jaccard(spark, docs, odd, none):
    words = [f"w{i}" for i in range(120)]
    rng, near = np.random.default_rng(3), []
    for i in range(150):  # near copies with 0 to 6 edits, and a passage that all of 100 others share
        w = list(words)
        for k in rng.integers(0, 120, i % 7):
            w[k] = f"e{rng.integers(0, 9)}"
        near.append((1000 + i, " ".join(w)))
    near += [(2000 + i, " ".join([f"p{j}" for j in range(60)] + [f"u{i}_{j}" for j in range(60)])) for i in range(100)]
    for df in (docs, odd, none, spark.createDataFrame(near, "doc_id long, text string").repartition(4)):
        assert counted(tuple(r) for r in jaccard_join.join(df).collect()) == counted(brute_groups(texts(df)))


def test_jaccard_deals_hot_tokens(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_GROUPS", 5000)  # so that many tokens are dealt to several tasks
    assert counted(tuple(r) for r in jaccard_join.join(docs).collect()) == counted(brute_groups(texts(docs)))


def test_jaccard_tells_sets_with_one_hash_apart(spark, docs, monkeypatch):
    """Where all sets share their first hash, the second is the node."""
    real = jaccard_join.set_hash

    def clash(doc, token, n, seed=1):
        size, h = real(doc, token, n, seed)
        return size, h % 3 if seed == 1 else h

    monkeypatch.setattr(jaccard_join, "set_hash", clash)
    assert counted(tuple(r) for r in jaccard_join.join(docs).collect()) == counted(brute_groups(texts(docs)))


def brute_shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
    return len({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}) if w else 0


def test_shingles_of_many_short_and_of_very_long_texts():
    import pyarrow as pa

    from arborsim.llm import shingles as sh

    short = [f"w{i} w{i % 7} x".encode() if i % 5 else None if i % 2 else b"" for i in range(70_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(short, pa.binary())], names=["t"])
    parts = sh.slices(batch, 0, 3 << 20)
    assert max(p.num_rows for p in parts) <= 1 << 16 and sum(p.num_rows for p in parts) == 70_000
    found = np.concatenate([np.bincount(sh.shingles(p.column(0), 2)[0], minlength=p.num_rows) for p in parts])
    assert found.tolist() == [brute_shingles(t or b"", 2) for t in short]
    with pytest.raises(ValueError):
        sh.shingles(batch.column(0), 2)
    rng = np.random.default_rng(5)
    long = b" ".join(b"v%d" % i for i in rng.integers(0, 40_000, 300_000)) + b"  \n" + b"y" * 700_000 + b" " * 300_000 + b"Tail"
    texts_ = [long, b"a b c d e", long.upper(), b"", long + b" more"]
    doc, token = sh.shingles(pa.array(texts_, pa.binary()), 4)
    assert np.bincount(doc, minlength=5).tolist() == [brute_shingles(t, 4) for t in texts_]
    n, h = sh.set_hash(doc, token, 5)
    assert h[0] == h[2] != h[4]


def test_rows_of_hot_keys_are_dealt(spark, tmp_path):
    from arborsim.llm import common

    rows = [(7, i) for i in range(3000)] + [(i, i) for i in range(1000)] + [(None, 1)] * 500
    left = common.materialise(spark.createDataFrame(rows, "k long, v long"), "t")
    right = spark.createDataFrame([(i, str(i)) for i in range(0, 1000, 2)] + [(7, "seven")], "k long, w string")
    for how in ("inner", "left"):
        got = common.dealt_join(left, right, "k", how=how)
        assert counted(map(tuple, got.collect())) == counted(map(tuple, left.join(right, "k", how).select(got.columns).collect()))
        assert counted(map(tuple, common.dealt_join(left, right, "k", left["v"], how).collect())) == counted(map(tuple, got.collect()))
        assert "_part" in got._jdf.queryExecution().optimizedPlan().toString()


def test_components_raise_rather_than_stop(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "u long, v long")
    with pytest.raises(RuntimeError):
        components(path, most_rounds=1)
    assert {r.root for r in components(path).collect()} == {0}
    assert components(path.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, 400), (400, 450), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 400: 400, 450: 400, 500: 400}


# 4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=3000), min_size=1, max_size=4), st.sampled_from([192, 576, 1000]))
def test_flac_round_trip(payloads, block):
    payloads = [p.ljust(-(-len(p) // 192) * 192, b" ") for p in payloads]
    assert flac.decode(flac.encode(payloads, block)) == payloads


def test_flac_kinds_of_frames():
    wave = bytes(int(128 + 100 * np.sin(i / 9)) for i in range(5760))
    odd = [bytes(576), b"\x00\xff" * 288, wave, bytes(range(192)) * 3, bytes([128] * 575 + [0])]
    streams = flac.encode(odd)
    assert flac.decode(streams) == odd
    assert len(streams[2]) < len(wave)
    assert flac.read_samples(streams[2], 5001, 300) == wave[5001:5301]
    damaged = bytearray(streams[2])
    damaged[-100] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(damaged)])


class Written:
    """A plain bit writer for frames of kinds that the coder doesn't make."""

    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

    def rice(self, r, k):
        u = (r << 1) ^ (r >> 63)
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def done(self):
        return int(self.bits.ljust(-(-len(self.bits) // 8) * 8, "0"), 2).to_bytes(-(-len(self.bits) // 8), "big")


def written_frame(x, number, kind, order, coef, shift, parts, method, escapes):
    """A frame of the samples x: fixed or linear prediction, 2^parts partitions, some of them escaped."""
    w = Written()
    w.put((32 | order - 1 if kind == "lpc" else 8 | order) << 1, 8)
    for v in x[:order]:
        w.put(v, 8)
    if kind == "lpc":
        w.put(11, 4)
        w.put(shift, 5)
        for c in coef:
            w.put(c, 12)
    res = [x[t] - (sum(c * x[t - 1 - j] for j, c in enumerate(coef)) >> shift) for t in range(order, len(x))]
    w.put(method, 2)
    w.put(parts, 4)
    step, at = len(x) >> parts, 0
    for p in range(1 << parts):
        own = res[at : at + step - (order if p == 0 else 0)]
        at += len(own)
        wide = 4 + method
        if p in escapes:
            raw = max((abs(r).bit_length() + 1 for r in own), default=0) if any(own) else 0
            w.put((1 << wide) - 1, wide)
            w.put(raw, 5)
            for r in own:
                w.put(r, raw)
        else:
            k = max(1, int(np.mean(np.abs(own) if own else [1])).bit_length())
            w.put(k, wide)
            for r in own:
                w.rice(r, k)
    body = flac._header(number, len(x)) + w.done()
    crc = 0
    for b in body:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return body + crc.to_bytes(2, "big")


def test_flac_decodes_what_the_coder_never_makes():
    import struct

    rng = np.random.default_rng(7)
    kinds = [("fixed", o, flac.FIXED[o], 0) for o in range(5)] + [("lpc", o, [int(c) for c in rng.integers(-900, 900, o)], int(rng.integers(8, 14))) for o in (1, 3, 8, 17, 32)]
    for parts, method, escapes in ((0, 0, ()), (3, 0, ()), (2, 1, ()), (2, 0, (1, 3)), (3, 1, (0, 2)), (0, 1, (0,))):
        frames, pcm = [], b""
        for number, (kind, order, coef, shift) in enumerate(kinds):
            x = [int(v) for v in np.clip(np.cumsum(rng.integers(-9, 10, 576)), -128, 127)]
            if number % 2:
                x[200:400] = [5] * 200
            frames.append(written_frame(x, number, kind, order, coef, shift, parts, method, escapes))
            pcm += bytes(v + 128 for v in x)
        md5 = hashlib.md5((np.frombuffer(pcm, np.uint8) ^ 128).tobytes()).digest()
        info = struct.pack(">HH", 576, 576) + bytes(6) + (8000 << 44 | 7 << 36 | len(pcm)).to_bytes(8, "big") + md5
        points = struct.pack(">QQH", 0, 0, 576) + struct.pack(">QQH", 3 * 576, sum(map(len, frames[:3])), 576)
        stream = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points + b"".join(frames)
        assert flac.decode([stream]) == [pcm]
        assert [s for s, _ in flac.decode_blocks([stream])[0]] == [0, 3 * 576]
        assert flac.read_samples(stream, 2000, 700) == pcm[2000:2700] and flac.read_samples(stream, 100, 20) == pcm[100:120]


def test_flac_blocks_are_stored_and_sought(spark, docs, odd, tmp_path):
    for k, df in enumerate((docs, odd)):
        media = flac.store(df, f"file://{tmp_path}/{k}")
        flac.pcm_blocks(media).write.parquet(f"file://{tmp_path}/pcm{k}")
        blocks, want = {}, {}
        for r in spark.read.parquet(f"file://{tmp_path}/pcm{k}").collect():
            blocks.setdefault(r.doc_id, []).append((r.sample, bytes(r.pcm)))
        for d, t in texts(df):
            raw = t.encode()
            p = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
            size = flac.BLOCK * flac.SEEK_EVERY
            want.setdefault(d, []).extend((i, p[i : i + size]) for i in range(0, len(p), size))
        assert {d: sorted(b) for d, b in blocks.items()} == {d: sorted(b) for d, b in want.items()}
        for r in media.limit(20).collect():
            n = flac.metadata(bytes(r.media))["samples"]
            assert flac.read_samples(bytes(r.media), n - 16, 99) == flac.decode([bytes(r.media)])[0][-16:]


def test_flac_query(docs, odd, none):
    for df in (docs, odd, none):
        want = []
        for d, t in texts(df):
            raw = t.encode()
            p = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
            x = [b - 128 for b in p]
            cross = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
            feature = f"mean={sum(x) / len(x):.6f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.6f};crossings={cross}"
            one = flac.encode([p])[0]  # alone: what a stream is doesn't depend on those coded with it
            want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(one), hashlib.sha256(one).hexdigest(), feature))
        assert counted(tuple(r) for r in flac.digest(flac.store(df)).collect()) == counted(want)


# 5


def brute_hits(rows, items, n=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            known.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for size in {len(k) for k in known}:
            for k in range(len(w) - size + 1):
                if own := known.get(tuple(w[k : k + size])):
                    found |= own
                    hit |= set(range(k, k + size))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination(spark, docs, odd, none, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    more = [*items, (900, "One Two"), (901, None), (902, ""), (903, BASE), (904, "one two")]
    for df, known in ((docs, items), (odd, more), (none, more), (odd, [])):
        bench = spark.createDataFrame(known, "item_id long, text string")
        got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in decontaminate.scan(df, bench).collect()]
        want = brute_hits(texts(df), known)
        assert counted(got) == counted(want)
        kept = decontaminate.clean(df, bench)
        assert kept.columns == df.columns and kept.count() == sum(not w[-1] for w in want)


def test_decontamination_by_items_without_id(spark, tmp_path):
    import duckdb

    said = " ".join(f"said{i}" for i in range(12))
    rows = [(1, said), (2, f"before {BASE} {said}"), (3, BASE), (4, "clean")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, said), (None, "before alpha0"), (7, BASE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontaminate.op5_decontamination(spark, str(tmp_path))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(1, 12, 12, 1, sha(""), True), (2, 93, 93, 2, sha("7"), True), (3, 80, 80, 1, sha("7"), True), (4, 1, 0, 0, sha(""), False)]
    assert counted(map(tuple, got.collect())) == counted(want)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert counted(c.sql(decontaminate.OP5_SQL).fetchall()) == counted(want)
    docs, items = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [4]


def test_decontamination_in_blocks(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(1, BASE), (2, LONG[:3000])], "item_id long, text string")
    want = counted(tuple(r) for r in decontaminate.scan(odd, bench).select("doc_id", "n_hit", "items").collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 10_000)
    assert counted(tuple(r) for r in decontaminate.scan(odd, bench).select("doc_id", "n_hit", "items").collect()) == want


def test_decontamination_splits_each_text_once(spark, docs):
    bench = spark.createDataFrame([(i, BASE) for i in range(50)], "item_id long, text string")
    _, hits = decontaminate.find_hits(docs, bench)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "BroadcastHashJoin" in hits._jdf.queryExecution().executedPlan().toString()
    assert decontaminate.item_windows(bench).count() == 71  # items that share a window are one row


# 6 and 10


def held_out(spark, d, label):
    from arborsim.llm.common import fold, table

    labels = table(spark, d, "labels")
    return labels.where(fold(labels["doc_id"]) == 1).select("doc_id", label)


@pytest.mark.parametrize(("op", "label", "least"), [("op6_toxicity", "toxic", 0.95), ("op10_quality", "quality", 0.93)])
def test_classifiers_on_held_out_rows(spark, op, label, least):
    d = "/root/testdata/sf0.1"
    got = registry.queries()[op](spark, d).join(held_out(spark, d, label), "doc_id").toPandas()
    assert got["held_out"].all() and (got["predicted"] == got[label]).mean() > least


def test_classifiers_on_odd_rows(spark, docs, odd, none, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for df in (odd, none):
        assert toxicity.score(df, toxicity.fit(docs, labels)).where("score between 0 and 1").count() == df.count()
        kept = quality.score(df, quality.fit(docs, labels), df.columns, "q")
        assert kept.where("q between 0 and 1").count() == df.count() and kept.columns == [*df.columns, "q"]
        assert quality.score(df, quality.fit(df, labels.limit(0))).where("score = 0.5").count() == df.count()
        assert toxicity.score(df, toxicity.fit(df, labels.limit(0))).count() == df.count()


def test_grammar():
    m = toxicity.ToxicityModel()
    m.words = {w: 6.0 for w in toxicity.INSULTS}
    weigh = lambda t: sum(c[2] for c in m.clauses(t))
    hits = lambda t: any(c[3] for c in m.clauses(t))
    assert weigh("you are an idiot") > weigh("what an idiot") > weigh("he said you are an idiot") > 0
    for denied in ("you are not an idiot", "You aren't an idiot", "you arent an idiot", "you aren\u2019t stupid or pathetic", "no idiot", "nobody is an idiot"):
        assert weigh(denied) == 0
    assert weigh("not bad, but you are a moron") == weigh("not bad but you are a moron") > 6
    assert hits("I will kill you") and hits("kill them all") and weigh("I will kill you") == toxicity.MARKS["H"]
    for mild in ("I don't want to kill you", "I will not ever kill you", "I would never hurt you", "kill time", "kill"):
        assert not hits(mild) and weigh(mild) == 0
    assert 0 < weigh("she said she will kill him") < weigh("she will kill him")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("IVTNRBO"), max_size=6))
def test_the_composed_grammar_is_its_parts_in_turn(classes):
    """The best path against all paths of the parts, run one after the other."""
    w = {"a": 0.7, "H": 3.0, "-": -5.0, "r": -1.5}
    words = [[(c, 2.0), ("O", 0.0)] if c in "IV" else [(c, 0.0)] for c in classes]

    def every(part, state, symbols):
        if not symbols:
            yield 0.0, ()
        else:
            for y, v, s in part.arcs[state, symbols[0]]:
                for u, out in every(part, s, symbols[1:]):
                    yield u + v, (y, *out)

    paths = [(0.0, ())]
    for readings in words:
        paths = [(u + v, (*out, x)) for u, out in paths for x, v in readings]
    for part in (toxicity.negation(w), toxicity.target(w), toxicity.reported(w)):
        paths = [(u + v, z) for u, out in paths for v, z in every(part, part.start, out)]
    weight, path = toxicity.grammar(w).best(words)
    assert weight == pytest.approx(max(u for u, _ in paths)) and any(p == path and u == pytest.approx(weight) for u, p in paths)


def test_the_compression_difference_carries_the_score(spark):
    """Without it the score is worse, with it alone nearly as good: held-out rows of sf0.1."""
    from arborsim.llm import common
    from arborsim.llm.logistic import Logistic

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = common.labelled_sample(docs, labels, "quality", 6000)
    cut = len(rows) * 2 // 3
    model = quality.CompressionClassifier().fit(rows[:cut])
    x, y = model.features([t.encode() for t, _ in rows[cut:]]), np.array([v for _, v in rows[cut:]])

    def auc(columns):
        s = Logistic().fit(x[::2, columns], y[::2]).score(x[1::2, columns])
        good, bad = s[y[1::2] == 1], s[y[1::2] == 0]
        return (good[:, None] > bad[None]).mean()

    assert auc([0]) > 0.93 and auc([0, 1, 2]) > max(auc([1, 2]) + 0.03, 0.97)


def test_labelled_sample_is_bounded(spark):
    from arborsim.llm import common

    docs = spark.createDataFrame([(i % 40, f"text {i} " * 10) for i in range(4000)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2 + [(None, 1), (3, None)], "doc_id long, quality int")
    every = common.labelled_sample(docs, labels, "quality", 100)
    usable = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(every) == sorted((min(f"text {j} " * 10 for j in range(i, 4000, 40)), i % 2) for i in usable)
    assert common.labelled_sample(docs.repartition(7), labels, "quality", 100) == every
    assert len(common.labelled_sample(docs, labels, "quality", 5)) <= 5 and len(common.labelled_sample(docs, labels, "quality", 100, max_bytes=300)) == 4


def test_scores_are_the_curve_of_the_features(spark, docs, sf):
    """Both classifiers, scored plainly from their fitted parts."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    tox, good = toxicity.fit(docs, labels), quality.fit(docs, labels)
    for model, got, plain in ((tox, toxicity.score(docs, tox), lambda t: plain_toxicity(tox, t)), (good, quality.score(docs, good), lambda t: plain_quality(good, t))):
        want = dict((d, plain(t)) for d, t in texts(docs))
        assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) for r in got.collect())


def sigmoid(curve, x):
    z = curve.w[0] + sum(w * (v - m) / s for w, v, m, s in zip(curve.w[1:], x, curve.mean, curve.scale))
    return 1 / (1 + np.exp(-z))


def plain_toxicity(m, text):
    """Clauses by a split of the whole text, each walked, whether a word of the lists is in it or not."""
    m._ready()
    found = []
    for clause in re.split(r"[.!?;:,\n]", text.lower()):
        words = [m.read(w) for w in toxicity.WORD.findall(clause)]
        if any(r[0][0] in "IV" for r in words):
            weight, path = m._machine.best(words)
            if weight > 0:
                found.append((weight, any(y in ("H", "Hr") for y in path)))
    if not found:
        return sigmoid(m.curve, [0] * 6)
    w = [x for x, _ in found]
    return sigmoid(m.curve, [1, np.log1p(sum(w)), max(w), np.log1p(len(w)), any(h for _, h in found), np.log1p(1000 * sum(w) / (len(text) + 200))])


def plain_quality(m, text):
    import zstandard

    data, sizes = text.encode(), []
    for d in (m.good, m.bad):
        c = zstandard.ZstdCompressor(level=m.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(data[i : i + m.block])) for i in range(0, len(data), m.block)))
    if not data:
        return sigmoid(m.curve, [0] * 3)
    dense = np.log(min(sizes) / len(data))
    return sigmoid(m.curve, [(sizes[1] - sizes[0]) / sum(sizes), dense, dense * dense])


# 7


def in_order(rows):
    """Rows of dicts by the upper 31 bits of their shuffle hash, unsigned, then by all of it, then by all columns, null first."""
    first = lambda x: (x is not None, x if x is not None else 0)
    return sorted(rows, key=lambda r: ((r["_shuffle"] % (1 << 64)) >> 33, r["_shuffle"], *(first(v) for v in r.values())))


def brute_shards(rows, shards):
    """(_file, _row): (shard, slot) of dicts of narrow rows."""
    by, at = {}, []
    for r in in_order(rows):
        by.setdefault(r["_source"], []).append(r)
    order = {id(r): i for i, r in enumerate(in_order(rows))}
    for own in by.values():
        at += [((k + 0.5) / len(own), order[id(r)], r) for k, r in enumerate(own)]
    out, count = {}, {}
    for i, (_, _, r) in enumerate(sorted(at, key=lambda x: x[:2])):
        shard = i * shards // len(at)
        out[r["_file"], r["_row"]] = shard, count.get(shard, 0)
        count[shard] = count.get(shard, 0) + 1
    return out


def test_shards_exactly(spark, docs, odd, monkeypatch):
    repeated = spark.createDataFrame([(None, None, None)] * 300 + [(1, "a b", "x")] * 20 + [(i, f"t{i}", "xyz"[i % 3]) for i in range(50)], "doc_id long, text string, source string")
    for least, rows in ((1024, 20_000), (1, 7)):
        monkeypatch.setattr(sharding, "LEAST_BUCKETS", least)
        monkeypatch.setattr(sharding, "BUCKET_ROWS", rows)
        for df in (docs, odd, repeated):
            _, narrow, _ = sharding.weigh(df)
            got = {(r["_file"], r["_row"]): (r["shard"], r["slot"]) for r in sharding.interleave(narrow, "_source", "_shuffle", 7).collect()}
            assert got == brute_shards([r.asDict() for r in narrow.collect()], 7)


def test_many_equal_rows_are_not_one_bucket(spark):
    df = spark.createDataFrame([(None, None, None)] * 300 + [(i, f"t{i}", "x") for i in range(700)], "doc_id long, text string, source string")
    _, narrow, _ = sharding.weigh(df)
    assert narrow.where("_doc is null").select("_shuffle").distinct().count() == 300


def test_shards_keep_whole_rows(spark, docs, odd, none):
    clash = spark.createDataFrame([(i, f"text {i}", "s", i, str(i), 0, 1) for i in range(30)], "doc_id long, text string, source string, shard long, slot string, _file int, _row int")
    for df in (docs, odd, none, clash):
        out = sharding.shard_documents(df, 8)
        assert out.columns[:-2] == df.columns and len(set(map(str.lower, out.columns))) == len(out.columns)
        assert counted(map(tuple, out.select(df.columns).collect())) == counted(map(tuple, df.collect()))
        place = [(r[-2], r[-1]) for r in out.collect()]
        assert place == sorted(place)


def test_shards(spark, docs, odd, none, monkeypatch):
    for least, rows in ((1024, 20_000), (1, 20_000), (1, 7)):
        monkeypatch.setattr(sharding, "LEAST_BUCKETS", least)
        monkeypatch.setattr(sharding, "BUCKET_ROWS", rows)
        for df in (docs, odd, none):
            got = sharding.shard_documents(df, 8).toPandas()
            assert len(got) == df.count()
            if not len(got):
                continue
            sizes = got.groupby("shard").size()
            assert sizes.max() - sizes.min() <= 1 and len(sizes) == min(8, len(got))
            assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
            mix = got.groupby([got["source"].fillna("-"), "shard"]).size().unstack(fill_value=0)
            assert ((mix.max(axis=1) - mix.min(axis=1)) <= 3).all()


def test_shards_do_not_depend_on_buckets(docs, monkeypatch):
    one = counted(tuple(r) for r in sharding.shard_documents(docs).collect())
    for least, rows in ((1, 20_000), (1, 20), (3, 7)):
        monkeypatch.setattr(sharding, "LEAST_BUCKETS", least)
        monkeypatch.setattr(sharding, "BUCKET_ROWS", rows)
        assert counted(tuple(r) for r in sharding.shard_documents(docs).collect()) == one


# 8


def brute_targets(sizes, weights=curriculum.WEIGHTS, share=1.5, most=2.0):
    """(source, size, target, weight class) of each (source, size)."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, open_, out = dict(order), share * sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        out |= {s: most * size[s] for s in full}
        left -= sum(most * size[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return [(s, n, float(out[s]), i % len(weights)) for i, (s, n) in enumerate(order)]


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [("b", 100), (None, 10), ("a", 100), ("c", 1000)] if not seed else [(f"s{i}" if i else None, int(rng.choice([0, 1, 50, 10_000, 300_000]))) for i in range(9 * seed)]
    rows = spark.createDataFrame([(s, n - n // 2) for s, n in sizes] + [(s, n // 2) for s, n in sizes], "source string, size long").repartition(3)
    got = {r.source: (r.source_size, r.target, r["_class"]) for r in curriculum.targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == {s for s, *_ in want} and sum(t for _, t, _ in got.values()) == pytest.approx(1.5 * sum(n for _, n in sizes))
    assert all(got[s] == (n, pytest.approx(t), k) for s, n, t, k in want)
    assert curriculum.targets(rows.limit(0)).count() == 0


def test_when_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for rates in curriculum.SCHEDULES:
        grid = np.linspace(0, 1, 2001)
        area = np.concatenate([[0], np.cumsum((np.interp(grid, np.linspace(0, 1, len(rates)), rates)[1:] + np.interp(grid, np.linspace(0, 1, len(rates)), rates)[:-1]) / 2)])
        got = [r[0] for r in spark.range(0, 2001).select(curriculum.when(F.col("id") / 2000.0, rates)).collect()]
        assert np.allclose(got, np.interp(np.linspace(0, 1, 2001), area / area[-1], grid), atol=1e-3)


def weighed(df):
    from arborsim.llm import common

    return curriculum.weigh(common.located(df.select("doc_id", "text", "source"), "t"))


def test_mix_does_not_depend_on_buckets(docs, monkeypatch):
    rows = weighed(docs)
    one = counted(tuple(map(str, r)) for r in curriculum.mix(rows).collect())
    for least, size in ((1, 20_000), (1, 20), (3, 7)):
        monkeypatch.setattr(sharding, "LEAST_BUCKETS", least)
        assert counted(tuple(map(str, r)) for r in curriculum.mix(rows, bucket_rows=size).collect()) == one


@pytest.mark.parametrize("rows", [None, 20_000, 5])
def test_mix(docs, odd, none, rows, monkeypatch):
    if rows:
        monkeypatch.setattr(sharding, "LEAST_BUCKETS", 1)
    for df in (docs, odd, none):
        got = curriculum.mix(weighed(df), bucket_rows=rows).toPandas()
        assert len(got) == df.count()
        for _, g in got.groupby("source", dropna=False):
            assert (g["taken"] <= 2 * g["size"]).all() and g["source_size"].iloc[0] == g["size"].sum()
            assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max() / 2 + 1e-6
        copies = curriculum.schedule(df, bucket_rows=rows)
        assert copies.columns == df.columns
        if df is docs:
            assert copies.count() == got["copies"].sum()


def brute_mix(rows):
    """(_file, _row): (copies, times) of dicts of narrow rows; times by a fine numeric integral of the rates."""
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    grid, out = np.linspace(0, 1, 200_001), {}
    for source, total, target, kind in brute_targets(list(sizes.items())):
        rates = curriculum.SCHEDULES[kind]
        rate = np.interp(grid, np.linspace(0, 1, len(rates)), rates)
        area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        at = 0
        for r in in_order([r for r in rows if r["source"] == source]):
            starts = [at + e * total for e in (0, 1) if r["size"] and at + e * total + r["size"] / 2 < target]
            out[r["_file"], r["_row"]] = len(starts), [float(np.interp(s / target, area / area[-1], grid)) for s in starts]
            at += r["size"]
    return out


def test_mix_exactly(spark, docs, odd):
    repeated = spark.createDataFrame([(None, "one word more", None)] * 60 + [(1, "a b", "x")] * 20 + [(i, f"t{i} u v", "xyz"[i % 3]) for i in range(50)], "doc_id long, text string, source string")
    for df in (docs, odd, repeated):
        rows = weighed(df)
        want = brute_mix([r.asDict() for r in rows.collect()])
        got = {(r["_file"], r["_row"]): (r["copies"], r["times"]) for r in curriculum.mix(rows).collect()}
        assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
        assert all(np.allclose(got[k][1], want[k][1], atol=1e-4) for k in want)


def test_schedule_is_sorted_and_whole(spark, docs, odd):
    clash = docs.selectExpr("doc_id", "text", "source", "1 as _time", "2 as _file", "doc_id as _shuffle", "text as c0")
    from arborsim.llm import common

    for df in (docs, odd, clash):
        df = common.materialise(df, "t")
        got = [tuple(r) for r in curriculum.schedule(df).collect()]
        times = {}
        narrow = weighed(df)
        for r in curriculum.mix(narrow).collect():
            times.setdefault((r["doc_id"], r["source"], r["size"]), []).extend(r["times"])
        words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        where = [df.columns.index(c) for c in ("doc_id", "source", "text")]
        key = lambda r: (r[where[0]], r[where[1]], words(r[where[2]]))
        assert counted(map(key, got)) == counted(k for k, v in times.items() for _ in v)
        last = -1.0
        for r in got:  # each row takes one of its times, none before the last
            left = times[key(r)]
            now = min(t for t in left if t >= last)
            left.remove(now)
            last = now
        assert counted(set(map(tuple, df.collect())) & set(got)) == counted(set(got))


# 9


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "%0A", ""]), st.lists(st.sampled_from([*reply_trees.CONTROL, "\\", "<", "[", ">", "x", "\n", "s>", "|"]), max_size=8).map("".join)), max_size=5))
def test_format_round_trip(turns):
    text, loss = reply_trees.format_turns(turns)
    assert reply_trees.parse(text) == turns
    assert [reply_trees.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    #     1 - 2 - 3        score 3 of leaf 3, 9 of leaf 5; 6 and 7 form a cycle; tree 2 has a missing parent
    rows = [(1, 1, None, 1.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (1, 4, 1, 9.0), (1, 5, 4, 9.0), (1, 6, 7, 1.0), (1, 7, 6, 1.0), (2, 1, 99, None), (None, 1, None, 0.0)]
    m = spark.createDataFrame([(*r, "user", f"{r[0]}.{r[1]}") for r in rows], "tree long, node long, parent long, score double, role string, text string")
    paths = {}
    for r in reply_trees.leaf_paths(m, best=2).collect():
        paths.setdefault((r.tree, r["rank"], r.leaf), []).append((r.depth_below, r.node))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in paths.items()} == {(1, 1, 5): [1, 4, 5], (1, 2, 3): [1, 2, 3], (2, 1, 1): [1], (None, 1, 1): [1]}
    every = reply_trees.leaf_paths(m, best=None)
    assert every.select("tree", "leaf").distinct().count() == 4
    assert reply_trees.format_paths(every, m).where("tree = 1 and leaf = 5").first().formatted.count("1.") == 3


def brute_leaf_paths(rows, best):
    """(tree, rank): the nodes from root to leaf of dicts; by a walk up from each leaf."""
    nodes, out = {(r["tree"], r["node"]): r for r in rows}, {}
    inner = {(r["tree"], r["parent"]) for r in rows}
    for (t, n), r in nodes.items():
        if (t, n) in inner:
            continue
        path, at = [], r
        while at is not None and at["node"] not in path:
            path.append(at["node"])
            at = nodes.get((t, at["parent"]))
        if at is None:
            mean = sum(nodes[t, x]["score"] or 0.0 for x in path) / len(path)
            out.setdefault(t, []).append((-mean, n, path[::-1]))
    return {(t, k + 1): p for t, own in out.items() for k, (_, _, p) in enumerate(sorted(own)[: best or len(own)])}


@pytest.mark.parametrize("best", [1, 3, None])
def test_forks_against_brute_force(spark, best):
    rng = np.random.default_rng(11)
    rows = [{"tree": 0, "node": i, "parent": i - 1 if i else None, "score": 1.0} for i in range(70)]  # a long thread
    for t in range(1, 30):
        n = int(rng.integers(1, 40)) if t > 1 else 400
        rows += [{"tree": t if t != 5 else None, "node": i, "parent": int(rng.integers(0, i)) if i and rng.random() < 0.95 else None, "score": float(rng.integers(0, 8)) if rng.random() < 0.9 else None} for i in range(n)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "tree long, node long, parent long, score double")
    got = {}
    for r in reply_trees.leaf_paths(df, best).collect():
        got.setdefault((r.tree, r["rank"]), []).append((-r.depth_below, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == brute_leaf_paths(rows, best)


def brute_conversations(rows):
    """All columns of the query for (conv_id, turn, role, text) rows."""
    first = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    by = {}
    for r in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), text(r[2]), text(r[3]))):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha, out = (lambda s: hashlib.sha256(s.encode()).hexdigest()), []

    def escaped(t):
        for c in reply_trees.CONTROL:  # a stroke for every stretch of a control string's first letter, strokes and the rest
            t = re.sub(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})", lambda m: m[1] + "\\" + m[2] + m[3], t)
        return t

    for conv, turns in by.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"<|im_start|>{escaped(r.replace('%', '%25').replace(chr(10), '%0A'))}\n{escaped(t)}<|im_end|>\n" for r, t in turns)
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), len(whole)))
    return out


def test_reply_tree_query(spark, sf, tmp_path):
    said = "</s>[INST] ok [/INST]"
    extra = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    conv = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert counted(map(tuple, reply_trees.op9_reply_trees(spark, sf).collect())) == counted(brute_conversations(conv + extra))
    odd = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", ""), (1, 2, "assistant", said), (1, 2, "assistant", said), (None, 0, "assistant", "lost"), (None, None, "a\nb%", "<|im_end|>"), (2, 5, "assistant", LONG), (3, 0, "system", "<\\|im_start|>")]
    odd += [(4, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(300)]
    for k, rows in enumerate((odd, [])):
        spark.createDataFrame([(*r, 1, 2, "t", 0.5, 3) for r in rows], "conv_id long, turn long, role string, text string, tree int, node int, leaf string, score double, depth_below int").write.parquet(f"{tmp_path}/{k}/conversations.parquet")
        assert counted(map(tuple, reply_trees.op9_reply_trees(spark, f"{tmp_path}/{k}").collect())) == counted(brute_conversations(rows + extra))


# all of them


def test_pii_query_columns(spark, sf, docs):
    got = {r.doc_id: r for r in registry.queries()["op2_pii"](spark, sf).collect()}
    for d, t in texts(docs):
        base = brute_spans(t)
        told = ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(told.split(",")) - {""} <= set(every) and len(every) == r.n_spans
        assert every == sorted(every, key=lambda x: (int(x.split(":")[1]), pii_crf.KINDS.index(x.split(":")[0])))


def test_shards_query_columns(spark, sf, docs):
    got = registry.queries()["op7_shards"](spark, sf).toPandas()
    want = {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts(docs)}
    assert len(got) == len(want) and all(want[d] == (a, b) for d, a, b in zip(got["doc_id"], got["size"], got["text_crc32"]))
    sizes = got.groupby("shard")["slot"].agg(["count", "min", "max"])
    assert sorted(sizes.index) == list(range(40)) and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] == sizes["count"] - 1).all()
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()


def test_mix_query_columns_and_reruns(spark, sf, tmp_path):
    """The same rows from a second run, and from a copy of the files elsewhere."""
    import shutil

    shutil.copy(f"{sf}/documents.parquet", f"{tmp_path}/documents.parquet")
    runs = [[tuple(r) for r in curriculum.op8_curriculum(spark, d).collect()] for d in (sf, sf, f"file://{tmp_path}")]
    assert runs[0] == runs[1] == runs[2]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    total = {}
    for r in docs:
        total[r.source] = total.get(r.source, 0) + size[r.doc_id]
    target = {s: t for s, _, t, _ in brute_targets(list(total.items()))}
    for doc_id, n, source_size, want, taken, copies, _, source in runs[0]:
        assert (n, source_size) == (size[doc_id], total[source]) and want == pytest.approx(target[source]) and taken == copies * n <= 2 * n
    for s in total:
        assert abs(sum(r[4] for r in runs[0] if r[7] == s) - target[s]) <= max(size.values()) / 2


@pytest.mark.parametrize("name", list(registry.queries()))
def test_queries_keep_their_columns(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.columns[0] in ("doc_id", "conv_id") and df.count() > 0


def test_sql_agrees(spark, sf):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = registry.queries()["op5_decontamination"](spark, sf)
    assert counted(tuple(r) for r in got.collect()) == counted(c.sql(registry.oracle_sql()["op5_decontamination"]).fetchall())


def test_models_travel():
    import pickle

    m = quality.CompressionClassifier().fit([("good text here " * 9, 1), ("BAD!! TEXT!! " * 9, 0)] * 20)
    assert pickle.loads(pickle.dumps(m)).score([b"good text here"]) == m.score([b"good text here"])
    assert len(pii_crf.example("mail a@b.de and +1 408 555 7800")) == 2 and json.dumps(pii_crf.example("mail a@b.de and +1 408 555 7800"))
