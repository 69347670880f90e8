"""Binary token files: every id in the fewest bits its vocabulary needs, in blocks that can be read alone.

A shard holds a header (magic, bits, ids in a block), the blocks, and an index behind them: each document's id and first id, each
block's byte offset, and the numbers of documents and ids. So a shard is written as a stream and read from its end. A block's ids are
packed most significant bit first; numpy unpacks any block, or any run of ids, without the rest of the file.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.llm.bpe import Memo, byte_letters
from emberlog.llm.common import new_path

MAGIC, HEADER, TAIL, BLOCK = b"EMBTOK02", struct.Struct("<8sII"), struct.Struct("<QQ8s"), 4096
#: Bytes of text that a shard takes, about.
SHARD_BYTES = 32 << 20
NO_ID = -(1 << 63)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids' lowest ``bits`` bits one after another, the last byte filled with zeros."""
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits:].ravel()).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits:] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def filesystem(path: str):
    """The pyarrow file system and inner path of a shared folder's address."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write_shard(path: str, rows: Iterator[tuple[int | None, np.ndarray]], bits: int, block: int = BLOCK) -> tuple[int, int]:
    """One shard of ``(doc_id, ids)`` rows in order; returns (documents, ids).

    Blocks are packed and written as they fill; memory holds some blocks and the index, 24 bytes for each document and 8 for each block.
    """
    names, starts, offsets, rest, held, total = array("q"), array("Q"), array("Q", [0]), [], 0, 0
    where, inner = filesystem(path)
    where.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"  # a second attempt writes its own file; the last move wins with equal bytes
    with where.open_output_stream(part) as f:
        f.write(HEADER.pack(MAGIC, bits, block))

        def blocks(n: int) -> list[np.ndarray]:
            """Write the first ``n`` held ids as blocks; gives back what is left."""
            flat = np.concatenate(rest) if rest else np.zeros(0, np.uint32)
            for i in range(0, n, block):
                data = pack(flat[i:min(i + block, n)], bits)
                f.write(data)
                offsets.append(offsets[-1] + len(data))
            return [flat[n:]]

        for name, ids in rows:
            names.append(NO_ID if name is None else name)
            starts.append(total)
            total += len(ids)
            rest.append(ids)
            held += len(ids)
            if held >= 64 * block:
                rest, held = blocks(held // block * block), held % block
        blocks(held)
        for x, kind in ((names, "<i8"), (starts, "<u8"), (offsets, "<u8")):
            f.write(np.array(x).astype(kind).tobytes())
        f.write(TAIL.pack(len(names), total, MAGIC))
    where.move(part, inner)
    return len(names), total


class Shard:
    """Random access to one file."""

    def __init__(self, path: str):
        where, inner = filesystem(path)
        self.f = where.open_input_file(inner)
        magic, self.bits, self.block = HEADER.unpack(self.f.read(HEADER.size))
        self.f.seek(self.f.size() - TAIL.size)
        self.docs, self.total, again = TAIL.unpack(self.f.read(TAIL.size))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{path} is no whole token file")
        n = -(-self.total // self.block)
        self.f.seek(self.f.size() - TAIL.size - 16 * self.docs - 8 * (n + 1))
        self.names = np.frombuffer(self.f.read(8 * self.docs), "<i8")
        self.starts = np.append(np.frombuffer(self.f.read(8 * self.docs), "<u8"), np.uint64(self.total)).astype(np.int64)
        self.offsets = np.frombuffer(self.f.read(8 * (n + 1)), "<u8").astype(np.int64)
        self.base = HEADER.size

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the shard; reads only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        self.f.seek(self.base + int(self.offsets[a]))
        data = self.f.read(int(self.offsets[b] - self.offsets[a]))
        parts = [unpack(data[int(self.offsets[i] - self.offsets[a]):int(self.offsets[i + 1] - self.offsets[a])], min(self.block, self.total - i * self.block), self.bits) for i in range(a, b)]
        return np.concatenate(parts)[start - a * self.block:stop - a * self.block]

    def documents(self, batch: int = 512) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, first id in the shard, ids)`` in order, ``batch`` documents read at a time."""
        for i in range(0, self.docs, batch):
            j = min(i + batch, self.docs)
            ids = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                a, b = int(self.starts[k]), int(self.starts[k + 1])
                yield None if self.names[k] == NO_ID else int(self.names[k]), a, ids[a - int(self.starts[i]):b - int(self.starts[i])]


_TOKENIZERS: dict = {}
#: Entries that a memo generation holds; none is longer than ``bpe.LONGEST`` letters.
MEMO = 200_000
#: Letters below this code point are handed to the model directly; ASCII signs that may follow a word.
LATIN, SIGNS = "\u0250", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def library_encoder(path: str):
    """Text to an array of ids by the tokenizers library.

    White space never joins two tokens in these files, so the library is given the stretches between plain spaces and
    line ends. Its normalizer and splitter only lower-case a run of Latin letters and part it from the signs behind
    it, so such a run goes to the library's model as it is, in byte letters; every other stretch takes the whole way.
    Answers are kept as bytes in bounded memos.
    """
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        model, letters = t.model, byte_letters()

        def whole(c: str) -> bytes:
            return array("I", t.encode(c, add_special_tokens=False).ids).tobytes()

        def word(c: str) -> bytes:
            low = c.lower() if c.isascii() else unicodedata.normalize("NFC", c).lower()
            if not low.isascii():
                if not low.isalpha() or max(low) >= LATIN:
                    return whole(c)
                low = "".join([letters[b] for b in low.encode("utf-8")])
            return array("I", [x.id for x in model.tokenize(low)]).tobytes()

        words, rest = Memo(word, MEMO), Memo(whole, MEMO)

        def stretch(c: str) -> bytes:
            if not c:
                return b""
            run = c.rstrip(SIGNS)
            if run.isalpha() and max(run) < LATIN:
                low = run.lower()
                return words(low if len(low) == len(run) else run) + (rest(c[len(run):]) if len(run) < len(c) else b"")
            return rest(c)

        _TOKENIZERS[path] = Memo(stretch, MEMO)
    memo = _TOKENIZERS[path]

    def encode(text: str) -> np.ndarray:
        parts = text.replace("\n", " ").split(" ")
        found = list(map(memo.young.get, parts))
        if None in found:
            found = [memo(c) if f is None else f for c, f in zip(parts, found)]
        return np.frombuffer(b"".join(found), "<u4")

    return encode


def write_tokens(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int | None, path: str | None = None, *, text: str = "text", doc_id: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every text's ids as shards in ascending doc_id order; returns the manifest ``(shard, path, docs, ids, start)``.

    Rows are dealt by ranges of doc_id, so shard order is document order and a range is one task's stream. A null
    text has no ids but the end id; null doc_ids come first; rows that repeat a doc_id follow each other by the text's hash. An empty
    table writes no shard; other columns are not read. The number of shards follows from the bytes of the texts, ``shard_bytes`` each. The
    manifest has one row for each shard and is a written table.
    """
    spark, bits = docs.sparkSession, bits_for(vocabulary)
    path = path or new_path(spark, "tokens")
    tail = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator):
        import pyarrow as pa

        encode = library_encoder(tokenizer)

        def rows():
            for b in batches:
                for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    yield name, np.concatenate([encode(t or ""), tail])

        shard = TaskContext.get().partitionId()
        at = f"{path}/shards/{shard:06d}.tok"
        n, total = write_shard(at, rows(), bits)
        if n:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [at], "docs": [n], "ids": [total]}, pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = 1 + (src.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes
    dealt = src.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(run, "shard long, path string, docs long, ids long").write.parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")
    return manifest.withColumn("start", F.sum("ids").over(Window.partitionBy(F.lit(0)).orderBy("shard")) - F.col("ids"))


def read_tokens(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` read from the shards; ``start`` counts the ids of all documents before.

    Every shard is a task of its own unless ``tasks`` says otherwise; an empty manifest gives no rows.
    """
    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            for at, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out: tuple[list, list, list, list] = ([], [], [], [])
                for name, first, ids in Shard(at).documents():
                    for x, v in zip(out, (name, start + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        x.append(v)
                    if len(out[0]) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = ([], [], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # ranges of a stated number keep adaptive execution from folding the small manifest into one task
    dealt = manifest.select("path", "start", "shard").repartitionByRange(tasks or max(1, manifest.count()), "shard")
    return dealt.select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, shard: str, doc: int) -> list[int]:
    """One document's ids by its place in a shard; only its blocks are read."""
    s = Shard(shard)
    return s.ids(int(s.starts[doc]), int(s.starts[doc + 1])).tolist()
