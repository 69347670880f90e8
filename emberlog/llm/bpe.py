"""BPE encoding and decoding: a priority queue of merge ranks over a doubly linked symbol list.

``Bpe`` reads a public tokenizer file (byte-level pieces with an end-of-word suffix) and encodes exactly as that file
prescribes. Texts are independent, so Spark deals the rows and every task encodes its own; words that were met before
come from a bounded memo.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.llm.common import unused

#: Words that a memo generation holds, and letters of a word above which it is not kept: a memo's bytes are bounded. Two generations live at once.
MEMO, LONGEST = 150_000, 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others shifted above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


class Memo:
    """A map of bounded bytes: keys above ``LONGEST`` letters are made anew each time; when the young generation is full it
    becomes the old one, and the old one is forgotten."""

    def __init__(self, make, limit: int = MEMO):
        self.make, self.limit, self.young, self.old = make, limit, {}, {}

    def __call__(self, key: str):
        if len(key) > LONGEST:
            return self.make(key)
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                found = self.make(key)
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[key] = found
        return found


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.added).items()}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.letters = byte_letters()
        self.piece = Memo(self.merge)
        self.chunk = Memo(self._chunk)

    def merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece. The queue holds (rank, place of the left symbol, the pair); an entry whose pair has
        changed since is stale and skipped. Links to the neighbours make each merge constant work."""
        symbols: list[str | None] = [self.letters[b] for b in piece.encode("utf-8")]
        if not symbols:
            return ()
        symbols[-1] += self.suffix
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ranks, queue = self.ranks, []
        for i in range(n - 1):
            pair = (symbols[i], symbols[i + 1])
            if pair in ranks:
                queue.append((ranks[pair], i, pair))
        heapq.heapify(queue)
        while queue:
            _, i, (left, right) = heapq.heappop(queue)
            j = after[i]
            if j < 0 or (first := symbols[i]) is None or (first, symbols[j]) not in ranks or first + symbols[j] != left + right:
                continue
            symbols[i], symbols[j] = left + right, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (pair := (symbols[i], symbols[k])) in ranks:
                    heapq.heappush(queue, (ranks[pair], i, pair))
            h = before[i]
            if h >= 0 and (pair := (symbols[h], symbols[i])) in ranks:
                heapq.heappush(queue, (ranks[pair], h, pair))
        return tuple(self.vocab[s] for s in symbols if s is not None and s in self.vocab)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a stretch without white space. Special tokens are found in the raw text; the rest is composed (NFC), lower-cased letter by letter and cut into pieces."""
        ids: list[int] = []
        parts = self.specials.split(chunk) if self.specials and "<|" in chunk else [chunk]
        for part in parts:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                low = "".join(map(str.lower, unicodedata.normalize("NFC", part)))
                for p in self.pieces.findall(low):
                    ids.extend(self.piece(p))
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """White space only separates, so the chunks between plain spaces and line ends are encoded one by one."""
        ids: list[int] = []
        young, memo = self.chunk.young, self.chunk
        for c in text.replace("\n", " ").split(" "):
            if c:
                found = young.get(c)
                if found is None:
                    found, young = memo(c), memo.young
                ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by spaces, as a file without a decoder prescribes; unknown ids give nothing."""
        strings = self.strings
        return " ".join([strings[i] for i in ids if i in strings])


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The tokenizer of ``path``, read once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def with_arrow(df: DataFrame, source: str, out: str, kind: str, make) -> DataFrame:
    """``df`` with ``out`` made from the values of ``source``, a batch at a time; the other columns' Arrow data stay as they are.

    A column of ``df`` with the name ``out`` (letters of either case) is replaced.
    """
    kept = [c for c in df.columns if c.lower() != out.lower()]
    src = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{source}`").alias(unused("_source", kept)))
    fields = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T._parse_datatype_string(kind))])

    def run(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        made = to_arrow_type(fields[-1].dataType)
        for b in batches:
            new = pa.array(make(b.column(len(kept))), made)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], new], [*kept, out])

    return src.mapInArrow(run, fields)


def encode(df: DataFrame, path: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``, an array of ids of each whole text; null and empty texts have none. A clashing column is replaced; the
    others pass through unchanged, nulls, long numbers and repeated rows too. An empty table gives an empty table."""
    return with_arrow(df, text, out, "array<int>", lambda values: list(map(load(path).encode, (t or "" for t in values.to_pylist()))))


def decode(df: DataFrame, path: str, *, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with ``out``, the text of each id array; a null array gives an empty text. Other columns as for ``encode``."""
    return with_arrow(df, ids, out, "string", lambda values: list(map(load(path).decode, (x or [] for x in values.to_pylist()))))


def encoded_digests(df: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: every text is encoded and its ids decoded, row by row.

    Only digests leave the task, so the ids of long texts never travel. Repeated rows give repeated results.
    """
    def run(batches: Iterator):
        import pyarrow as pa

        bpe = load(path)
        names = {i: str(i) for i in bpe.strings}
        for b in batches:
            n, a, d = [], [], []
            for t in b.column(1).to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
