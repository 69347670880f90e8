import hashlib
import zlib

import numpy as np

from emberlog.llm import media


def test_companding_tables():
    assert media.MULAW_PCM[0xFF] == 0 and media.MULAW_PCM[0x7F] == 0 and media.MULAW_PCM[0x80] == 32124 and media.MULAW_PCM[0] == -32124
    assert media.ALAW_PCM[0xD5] == 8 and media.ALAW_PCM[0x55] == -8 and media.ALAW_PCM.max() == 32256 and media.ALAW_PCM.min() == -32256
    assert len(set(media.ALAW_PCM.tolist())) == 256 and len(set(media.MULAW_PCM.tolist())) == 255


def one_block(b):
    v, i = int(np.frombuffer(bytes(b[:2]), "<i2")[0]), min(b[2], 88)
    out = [v]
    for byte in b[4:]:
        for code in (byte & 15, byte >> 4):
            s = int(media.STEP_SIZES[i])
            d = (s >> 3) + (s if code & 4 else 0) + (s >> 1 if code & 2 else 0) + (s >> 2 if code & 1 else 0)
            v = max(-32768, min(32767, v - d if code & 8 else v + d))
            i = max(0, min(88, i + int(media.INDEX_STEPS[code & 7])))
            out.append(v)
    return out


def test_adpcm_blocks_equal_one_by_one():
    blocks = np.random.default_rng(0).integers(0, 256, (17, 36)).astype(np.uint8)
    assert media.decode_adpcm(blocks).tolist() == [one_block(b.tolist()) for b in blocks]


def test_resample():
    assert media.resample(np.array([0, 100], np.int16), 8000, 16000).tolist() == [0, 50, 100, 100]
    assert media.resample(np.array([], np.int16), 8000, 16000).tolist() == []
    assert media.resample(np.array([1, 2, 3, 4], np.int16), 16000, 8000).tolist() == [1, 3]


def test_transcode(spark):
    data = bytes(range(256))
    rows = [(1, media.wav(data, media.MULAW)), (2, media.wav(data, media.ALAW)), (3, media.wav(data[:72], media.ADPCM, align=36, bits=4)), (4, None), (5, media.wav(b"", media.MULAW)), (6, media.wav(data[:9], media.MULAW))]
    got = {r.id: r.pcm for r in media.transcode(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[4] is None and media.read_wav(bytes(got[5]))[3].nbytes == 0
    assert (np.frombuffer(media.read_wav(bytes(got[1]))[3], "<i2")[::2] == media.MULAW_PCM[np.arange(256)]).all()
    assert (np.frombuffer(media.read_wav(bytes(got[2]))[3], "<i2")[::2] == media.ALAW_PCM[np.arange(256)]).all()
    assert len(media.read_wav(bytes(got[3]))[3]) == 2 * 2 * 2 * 65 and len(media.read_wav(bytes(got[6]))[3]) == 36


def test_texts_survive(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 500_000), (4, "x" * 500_000), (None, "a" * 192)]
    out = media.media_rows(media.store_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 6
    for name, t in rows:
        raw = (t or "").encode()
        pay = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[name]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    assert got[2].feature == got[3].feature and got[2].media_sha256 == got[3].media_sha256
