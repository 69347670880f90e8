import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm import bpe, tokenbin

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
HARD = ["", " ", "a", "Hello, World! don't we'll 123", "a<|endoftext|>B <|startoftext|>", "É é ΣΑΣ İ ß ﬁ", "日本語テキスト 한국어", "x y\tz\r\nq\x1cw\x85v u", "👩‍👩‍👧 ok", "aaaaaaaaaaaaaaaa" * 40, "<|endof", "'S 'Ll it's", "É. Σας, ΣΑΣ! İi? Ǆo; e\u0301. don't. ª: ..,, x.y"]


@pytest.mark.parametrize("text", HARD)
def test_encode_and_decode_equal_the_library(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    b = bpe.load(PATH)
    assert b.encode(text) == ids
    assert b.decode(ids) == LIB.decode(ids, skip_special_tokens=False)
    assert tokenbin.library_encoder(PATH)(text).tolist() == ids


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=60))  # newest letters: the libraries' Unicode versions differ
def test_any_text(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    assert bpe.load(PATH).encode(text) == ids
    assert tokenbin.library_encoder(PATH)(text).tolist() == ids


def test_memo_stays_bounded():
    m = bpe.Memo(lambda x: (len(x),), 3)
    for i in range(50):
        assert m("x" * i) == (i,)
        assert len(m.young) <= 3 and len(m.old) <= 3


def test_digests(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (3, ""), (None, "x")]
    out = bpe.encoded_digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    ids = LIB.encode("Hello there", add_special_tokens=False).ids
    got = {r.doc_id: r for r in out}
    assert len(out) == 5 and got[2].n_tokens == 0 and got[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded_digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_encode_decode_frames(spark):
    df = spark.createDataFrame([(1, "Red fox", [9]), (2, None, None)], "doc_id long, text string, ids array<int>")
    out = bpe.decode(bpe.encode(df, PATH), PATH, out="back").orderBy("doc_id").collect()
    assert out[0].back == LIB.decode(LIB.encode("Red fox", add_special_tokens=False).ids) and out[1].back == "" and out[1].ids == []


@pytest.mark.parametrize("bits", [1, 3, 7, 13, 16, 17, 20, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 5003, dtype=np.uint64).astype(np.uint32)
    data = tokenbin.pack(ids, bits)
    assert len(data) == -(-5003 * bits // 8) and (tokenbin.unpack(data, 5003, bits) == ids).all()


def test_bits():
    assert [tokenbin.bits_for(x) for x in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


@pytest.mark.parametrize("bits", [13, 16])
def test_shard_random_access(tmp_path, bits):
    rng = np.random.default_rng(1)
    rows = [(None if i == 0 else i, rng.integers(0, 1 << bits, n).astype(np.uint32)) for i, n in enumerate([0, 5, 4096, 1, 9000, 0, 70000])]
    assert tokenbin.write_shard(str(tmp_path / "a.tok"), iter(rows), bits, 512) == (7, 83102)
    s = tokenbin.Shard(str(tmp_path / "a.tok"))
    got = list(s.documents(2))
    assert [g[0] for g in got] == [r[0] for r in rows] and all((g[2] == r[1]).all() for g, r in zip(got, rows))
    flat = np.concatenate([r[1] for r in rows])
    for a, b in [(0, 1), (511, 513), (5000, 5000), (80000, 83102)]:
        assert (s.ids(a, b) == flat[a:b]).all()


def test_token_files(spark):
    rows = [(7, "b c"), (3, None), (5, ""), (1, "Hello"), (7, "a"), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = tokenbin.read_tokens(tokenbin.write_tokens(df, PATH, 49408, 1)).collect()
    out = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None, 1, 3, 5, 7, 7]
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    ids = [*LIB.encode("Hello", add_special_tokens=False).ids, 1]
    assert out[1].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and out[1].n_tokens == len(ids)
    assert out[2].n_tokens == 1
    assert tokenbin.read_tokens(tokenbin.write_tokens(df.limit(0), PATH, 49408, 1)).count() == 0
