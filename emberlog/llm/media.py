"""Telephony audio in media columns: companded samples expanded by tables, ADPCM blocks decoded together, PCM resampled.

A media value is a RIFF/WAVE file: format tag 7 (mu-law), 6 (A-law), 17 (IMA ADPCM) or 1 (16-bit PCM).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.bpe import with_arrow
from emberlog.llm.common import written

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
UNIT = 192


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: the code's complement is sign, 3 bits of exponent, 4 of mantissa, with bias 132."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((u & 15) << 3) + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: every other bit of the code is flipped; exponent 0 is linear."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = a >> 4 & 7, (a & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()
# Fixed values of IMA ADPCM.
INDEX_STEPS = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEP_SIZES = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358,
    5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM blocks (n, size) of bytes to samples (n, 1 + 2 * (size - 4)).

    A block starts with a 16-bit sample and a step index and stands alone, so one numpy step advances all blocks by a
    sample. A step index above 88 counts as 88.
    """
    n, size = blocks.shape
    out = np.empty((n, 1 + 2 * (size - 4)), np.int16)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[:, 0] = value
    for k in range(2 * (size - 4)):
        byte = blocks[:, 4 + k // 2]
        code = (byte >> 4 if k % 2 else byte & 15).astype(np.int32)
        step = STEP_SIZES[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + INDEX_STEPS[code & 7], 0, 88)
        out[:, k + 1] = value
    return out


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation in whole numbers; an equal rate is the same samples, and no samples give none."""
    if source == target or not len(pcm):
        return pcm.astype(np.int16)
    at = np.arange(len(pcm) * target // source, dtype=np.int64) * source
    left, part = at // target, at % target
    a, b = pcm[left].astype(np.int64), pcm[np.minimum(left + 1, len(pcm) - 1)].astype(np.int64)
    return ((a * (target - part) + b * part) // target).astype(np.int16)


def wav(data: bytes, tag: int, rate: int = 8000, align: int = 1, bits: int = 8) -> bytes:
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align if tag != ADPCM else rate, align, bits)
    pad = b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 20 + len(fmt) + len(data) + len(pad)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + pad


def read_wav(media: bytes) -> tuple[int, int, int, memoryview]:
    """(format tag, rate, block size, sample bytes) from the file's chunks, which may come in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    view, at, found = memoryview(media), 12, {}
    while at + 8 <= len(media):
        name, size = bytes(view[at:at + 4]), struct.unpack_from("<I", media, at + 4)[0]
        found.setdefault(name, view[at + 8:at + 8 + size])
        at += 8 + size + size % 2
    if len(found.get(b"fmt ", b"")) < 16 or b"data" not in found:
        raise ValueError("no format or no samples")
    tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", found[b"fmt "])
    if channels != 1 or not rate or tag == ADPCM and align < 5:
        raise ValueError("no telephony sound: one channel, a rate and whole blocks are needed")
    return tag, rate, align, found[b"data"]


def to_pcm(media: bytes) -> tuple[np.ndarray, int]:
    """A media value's 16-bit samples and rate. A last ADPCM block that is cut short is left out."""
    tag, rate, align, data = read_wav(media)
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MULAW_PCM[raw], rate
    if tag == ALAW:
        return ALAW_PCM[raw], rate
    if tag == ADPCM:
        return decode_adpcm(raw[:len(raw) // align * align].reshape(-1, align)).ravel(), rate
    if tag == PCM:
        return raw[:len(raw) // 2 * 2].view("<i2"), rate
    raise ValueError(f"format tag {tag} is not telephony audio")


def transcode(df: DataFrame, *, media: str = "media", out: str = "pcm", rate: int = 16000) -> DataFrame:
    """``df`` with ``out``: each media value decoded, resampled to ``rate`` and stored as a PCM file.

    A null value stays null, and a value that is no telephony sound (no RIFF/WAVE file, cut headers, another format, several channels) gives
    null. An empty sound is a file without samples. A clashing column is replaced; the others pass through unchanged. Repeated rows
    give repeated results, an empty table an empty one.
    """
    def one(m: bytes | None) -> bytes | None:
        try:
            pcm, source = to_pcm(m) if m is not None else (None, 0)
        except ValueError:
            return None
        return None if pcm is None else wav(resample(pcm, source, rate).astype("<i2").tobytes(), PCM, rate, 2, 16)

    return with_arrow(df, media, out, "binary", lambda values: [one(m.as_py()) for m in values])


def payload_of(text: str | None) -> tuple[int, bytes]:
    """A text's UTF-8 bytes, filled with spaces to a positive multiple of 192; and their number before that."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store_texts(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, media)``, a written table: each whole text as the samples of a mu-law file, bit for bit."""
    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            n, m = [], []
            for t in b.column(1):
                size, data = payload_of(t.as_py())
                n.append(size)
                m.append(wav(data, MULAW))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(m, pa.binary())], ["doc_id", "n_bytes", "media"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(src.mapInArrow(run, "doc_id long, n_bytes long, media binary"), "media")


def features(files: list[bytes]) -> list[tuple[bytes, str]]:
    """Each stored file's sample bytes, and whole-number features of its sound: the resampled PCM's peak, energy and
    sign changes, the energy under A-law, and the sum of the last values of its bytes read as ADPCM blocks of 192.
    The blocks of all files are decoded together."""
    payloads = [bytes(read_wav(m)[3]) for m in files]
    ends = decode_adpcm(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT))[:, -1].astype(np.int64)
    out, at = [], 0
    for media, payload in zip(files, payloads):
        samples, rate = to_pcm(media)
        pcm = resample(samples, rate, 16000).astype(np.int64)
        signs = pcm < 0
        a = ALAW_PCM[np.frombuffer(payload, np.uint8)].astype(np.int64)
        blocks = len(payload) // UNIT
        out.append((payload, f"n={len(pcm)};peak={np.abs(pcm).max()};energy={int((pcm * pcm).sum())};crossings={int((signs[1:] != signs[:-1]).sum())};alaw={int((a * a).sum())};adpcm={int(ends[at:at + blocks].sum())}"))
        at += blocks
    return out


def media_rows(stored: DataFrame, together: int = 4 << 20) -> DataFrame:
    """Read the stored files back: sizes, digests and features of each. Equal texts have equal values.

    Files are decoded in runs of about ``together`` bytes, which bounds memory.
    """
    def run(batches: Iterator):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

        def done(names, sizes, files):
            rows = [(name, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), f) for name, n, m, (p, f) in zip(names, sizes, files, features(files))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            names, sizes, files, held = [], [], [], 0
            for name, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                names.append(name)
                sizes.append(n)
                files.append(m.as_py())
                held += len(files[-1])
                if held >= together:
                    yield done(names, sizes, files)
                    names, sizes, files, held = [], [], [], 0
            if files:
                yield done(names, sizes, files)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
