"""Language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts: the empty one, single words, pairs and so on. A context is retained where the next words after it diverge from those of its
parent (the context without its oldest word): the gain in log likelihood of its training words, each predicted without itself, must pass ``GAIN``. The
distribution of a state seen n times is ``(c + w * parent) / (n + w)`` with the prior's weight w = ``weight(n)``, down to
``(c + 0.5) / (N + 0.5 * (V + 1))`` at the root. Each word is scored by the longest retained suffix of the words before it in its text.

The corpus is written once as chunks of some 1.5 million words. In each pass a chunk asks for sums over the corpus: it sends its distinct grams as
sorted keys, dealt by key to buckets of bounded size, and gets the sums back in the same order. So a gram travels once for each chunk that holds
it, however often it occurs, and no task holds the model. Grams with equal keys are counted as one: words have keys of 64 bits (at a billion words the odds of
any such pair are 1 in 40), longer grams ``SPARE`` bits more than the corpus's number of words has, so at most one in 2 ** SPARE of them meets another.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import new_path, removed, written

#: Words of a chunk, and keys of a bucket, about.
CHUNK, BUCKET = 3 << 19, 1 << 20
#: Bits of a gram's key beyond those of the number of words, and those it has at least.
SPARE, SHORTEST = 12, 40
#: The gain (nats) that a state must pass, and the training occurrences below which a context cannot gain anything.
GAIN, LEAST = 2.0, 2
#: Gains travel as whole numbers of this part of a nat; what a chunk adds is cut at 2 million nats.
PART = 1024
TINY = 1e-300
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNKS = ("chunk long, trained long, docs array<long>, ids array<long>, held array<boolean>, starts array<int>, skips array<int>, words binary, tokens binary")
ASKS = "level int, kind string, chunk long, bucket long, keys binary, sums binary"
ANSWERS = "level int, kind string, chunk long, bucket long, sums binary, known long"


def weight(n: np.ndarray) -> np.ndarray:
    """How many occurrences the parent's distribution counts for in a state of ``n``."""
    return 4.0 * np.asarray(n, np.float64) ** 0.8


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes, its length first."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if len(a) else b"")


def unpack(b: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], n * size, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of a gram from the keys of its context and its last word."""
    h = a * MIX + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def hashed(words: list[str]) -> np.ndarray:
    from pandas.util import hash_array

    return hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all words of a batch, an end after each text's, and where each text starts, with the end."""
    import pyarrow.compute as pc

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = pc.dictionary_encode(split.flatten())
    names = coded.dictionary.to_pylist()
    keys = hashed(names)[coded.indices.to_numpy()]
    real = np.array([w != "" for w in names], bool)[coded.indices.to_numpy()] if names else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])[np.cumsum(np.concatenate([[0], pc.list_value_length(split).to_numpy()]))]
    return np.insert(keys[real], ends[1:], hashed(["\n"])[0]), ends + np.arange(len(ends))


def chunked(df: DataFrame, depth: int, most: int = CHUNK) -> DataFrame:
    """The chunks of ``df(id, held, text)``. A text beyond a chunk goes on in the next, after the last ``depth`` words of before."""
    def run(batches: Iterator):
        from pyspark import TaskContext

        base, made, doc, size, held = TaskContext.get().partitionId() << 40, 0, 0, 0, []

        def chunk(at: int):
            tokens = np.concatenate([t for *_, t in held])
            found, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            starts = np.cumsum([0, *(len(t) for *_, t in held)])
            trained = sum(len(t) - skip for _, _, out, skip, t in held if not out)
            row = (base + at, trained, [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], starts, [h[3] for h in held], pack(found[order]), pack(rank[inverse]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["chunk", "trained", "docs", "ids", "held", "starts", "skips", "words", "tokens"])

        for b in batches:
            keys, at = words_of(b.column(2))
            for i, (id_, out) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                text = keys[at[i]:at[i + 1]]
                for s in range(0, len(text), most):
                    skip = min(s, depth)
                    held.append((base + doc, id_, out, skip, text[s - skip:s + most]))
                    size += len(held[-1][-1])
                    if size >= most:
                        yield chunk(made)
                        made, size, held = made + 1, 0, []
                doc += 1
        if held:
            yield chunk(made)

    return df.select("id", "held", "text").mapInArrow(run, CHUNKS)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and the number of each place's value."""
    order = np.argsort(codes)
    new = np.diff(codes[order], prepend=-1) != 0
    at = np.empty(len(codes), np.int32)
    at[order] = np.cumsum(new) - 1
    first = order[new]
    return codes[first], first, at


class Chunk:
    """A chunk with what the passes so far have answered.

    ``grams[k]`` numbers, for each position, the distinct gram of k + 1 words that ends there (-1: none), ``keys[k]`` and ``counts[k]`` are those grams' keys
    and training counts, ``p[k]`` the probability of each position with contexts up to k words.
    """

    def __init__(self, row: dict, least: int):
        self.id, self.least = row["chunk"], least
        self.words, self.tokens = unpack(row["words"], np.uint64), unpack(row["tokens"], np.uint32).astype(np.int64)
        starts, skips = np.array(row["starts"], np.int64), np.array(row["skips"], np.int64)
        self.docs, self.ids, self.held = row["docs"], row["ids"], row["held"]
        sizes = np.diff(starts)
        self.piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.place = (np.arange(len(self.tokens)) - np.repeat(starts[:-1], sizes)).astype(np.int32)
        self.scored = self.place >= np.repeat(skips, sizes)
        self.trained = self.scored & ~np.repeat(np.array(self.held, bool), sizes)
        self.grams, self.keys, self.n = [self.tokens], [self.words], [np.bincount(self.tokens[self.trained], minlength=len(self.words))]
        self.counts: list[np.ndarray] = []
        self.p: list[np.ndarray] = []

    def root(self, counts: np.ndarray, total: int, distinct: int) -> None:
        self.counts.append(counts)
        self.p.append(((counts + 0.5) / (total + 0.5 * (distinct + 1)))[self.tokens])

    def lengthen(self) -> None:
        """The grams of one more word, where the context has been seen often enough in training to be a state."""
        k, before = len(self.grams), self.grams[-1]
        at = np.flatnonzero(self.place >= k)
        context = before[at - 1]
        often = np.append(self.counts[k - 1] >= self.least, False)[context]
        at, context = at[often], context[often]
        found, first, gram = distinct(context.astype(np.int64) * len(self.words) + self.tokens[at])
        numbered = np.full(len(self.tokens), -1, np.int32)
        numbered[at] = gram
        self.at, self.gram, self.first, self.context = at, gram, at[first], found // max(len(self.words), 1)
        self.contexts = np.unique(self.context)
        self.grams.append(numbered)
        self.keys.append(mixed(self.keys[k - 1][self.context], self.words[found % max(len(self.words), 1)]))
        self.n.append(np.bincount(gram[self.trained[at]], minlength=len(found)))

    def gains(self) -> np.ndarray:
        """For each context, what its training words here gain, every word predicted without itself."""
        k = len(self.grams) - 1
        seen = np.flatnonzero(self.n[k])
        q, c, n = self.p[k - 1][self.first[seen]], self.counts[k][seen], self.counts[k - 1][self.context[seen]]
        w = weight(n - 1)
        each = self.n[k][seen] * np.log((c - 1 + w * q + TINY) / ((n - 1 + w) * q + TINY))
        return np.clip(np.rint(PART * np.bincount(self.context[seen], each, len(self.keys[k - 1]))[self.contexts]), -(1 << 31), (1 << 31) - 1).astype(np.int32)

    def deepen(self, retained: np.ndarray) -> None:
        """The probabilities with the retained contexts of one more word; ``retained`` is 1 or 0 for each context."""
        k = len(self.grams) - 1
        states = np.zeros(len(self.keys[k - 1]), bool)
        states[self.contexts] = retained > 0
        kept = states[self.context][self.gram]
        at, gram = self.at[kept], self.gram[kept]
        n = self.counts[k - 1][self.context[gram]]
        w = weight(n)
        p = self.p[k - 1].copy()
        p[at] = (self.counts[k][gram] + w * p[at]) / (n + w)
        self.p.append(p)


def asked(level: int, kind: str, chunk: int, keys: np.ndarray, sums: np.ndarray, bits: int, width: int = 64) -> pa.RecordBatch:
    """The rows that ask for the sums of ``keys`` over the corpus, a row a bucket. Only the first ``width`` bits of a key travel, ``bits`` of them as the bucket."""
    order = np.argsort(keys)
    keys, sums = keys[order], sums[order]
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    keys = keys >> np.uint64(64 - width)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = [(level, kind, chunk, int(bucket[a]), pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(sums[a:b]))
            for a, b in zip(cuts, [*cuts[1:], len(keys)])]
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["level", "kind", "chunk", "bucket", "keys", "sums"])


def answered(asks: DataFrame) -> DataFrame:
    """The sums of each asked key over all chunks, in the order asked: counts, or for gains 1 where the context is retained, else 0."""
    def total(group: pa.Table) -> pa.Table:
        kind = group.column("kind")[0].as_py()
        keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in group.column("keys").to_pylist()]
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.concatenate([unpack(s, np.int32 if kind == "gain" else np.uint32) for s in group.column("sums").to_pylist()])
        sums = np.bincount(at, sums, len(found))
        sums = (sums > PART * GAIN).astype(np.uint8) if kind == "gain" else np.rint(sums).astype(np.uint64)
        ends = np.cumsum([len(k) for k in keys])
        out = [pack(sums[at[b - len(k):b]]) for k, b in zip(keys, ends)]
        known = pa.array([int((sums > 0).sum()), *[0] * (len(out) - 1)], pa.int64())
        return pa.table([*(group.column(c) for c in ("level", "kind", "chunk", "bucket")), pa.array(out, pa.binary()), known],
                        names=["level", "kind", "chunk", "bucket", "sums", "known"])

    return asks.groupBy("level", "kind", "bucket").applyInArrow(total, ANSWERS)


def taken(answers: dict, level: int, kind: str, keys: np.ndarray) -> np.ndarray:
    """The answers to one question of a chunk, in the order of ``keys``."""
    parts = [unpack(s, np.uint8 if kind == "gain" else np.uint64) for _, s in sorted(answers.get((level, kind), []))]
    out = np.zeros(len(keys), np.uint8 if kind == "gain" else np.float64)
    if parts:
        out[np.argsort(keys)] = np.concatenate(parts)
    return out


def step(chunks: DataFrame, answers: DataFrame, passes: int, depth: int, least: int, total: int, distinct: int, bits: int, width: int) -> DataFrame:
    """Pass ``passes`` over the chunks: the next questions, or after the last answer ``(doc, id, held, n_tokens, n_known, base_score, score)`` of each piece."""
    last = passes > depth + 1
    schema = "doc long, id long, held boolean, n_tokens long, n_known long, base_score double, score double" if last else ASKS

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got: dict = {}
        for r in right.select(["level", "kind", "bucket", "sums"]).to_pylist():
            got.setdefault((r["level"], r["kind"]), []).append((r["bucket"], r["sums"]))
        c = Chunk(left.to_pylist()[0], least)
        c.root(taken(got, 0, "count", c.words), total, distinct)
        for k in range(1, passes):
            c.lengthen()
            if k <= depth:
                c.counts.append(taken(got, k, "count", c.keys[k]))
            if k < passes - 1:
                c.deepen(taken(got, k, "gain", c.keys[k - 1][c.contexts]))
        if last:
            return pa.Table.from_batches([scores(c)])
        out = []
        if passes > 1:
            out.append(asked(passes - 1, "gain", c.id, c.keys[passes - 2][c.contexts], c.gains(), bits, width))
        if passes <= depth:
            if passes > 1:
                c.p.append(c.p[-1])
            c.lengthen()
            out.append(asked(passes, "count", c.id, c.keys[passes], c.n[passes].astype(np.uint32), bits, width))
        return pa.Table.from_batches(out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def scores(c: Chunk) -> pa.RecordBatch:
    def per(values: np.ndarray) -> np.ndarray:
        return np.bincount(c.piece, np.where(c.scored, values, 0), len(c.docs))

    names = ["doc", "id", "held", "n_tokens", "n_known", "base_score", "score"]
    return pa.RecordBatch.from_arrays([
        pa.array(c.docs, pa.int64()), pa.array(c.ids, pa.int64()), pa.array(c.held, pa.bool_()), pa.array(per(np.ones(len(c.tokens))).astype(np.int64)),
        pa.array(per(c.counts[0][c.tokens] > 0).astype(np.int64)), pa.array(per(np.log10(c.p[0]))), pa.array(per(np.log10(c.p[-1])))], names)


def first_step(chunks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator):
        for b in batches:
            for row in b.to_pylist():
                c = Chunk(row, 1)
                yield asked(0, "count", c.id, c.words, c.n[0].astype(np.uint32), bits)

    return chunks.mapInArrow(run, ASKS)


def bucketed(chunks: DataFrame, scratch: list[str]) -> tuple[DataFrame, str]:
    """The chunks as a table bucketed by chunk, and its name: passes shuffle the answers to the chunks, which stay where they are."""
    spark = chunks.sparkSession
    path = new_path(spark, "chunks")
    name = "emberlog_chunks_" + path[-32:]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks.write.format("parquet").bucketBy(parts, "chunk").sortBy("chunk").option("path", path).option("compression", "zstd").saveAsTable(name)
    scratch.append(path)
    return spark.table(name), name


@contextmanager
def freed(spark: SparkSession):
    """Shuffle files go once the query that wrote them has ended; every pass writes its result, so none is read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def tree_scores(df: DataFrame, held: Column, *, text: str = "text", doc_id: str = "doc_id", depth: int = 2, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every whole text, learned from the rows that are not ``held``.

    ``base_score`` is the root's log10 probability, ``score`` that of the tree with contexts of up to ``depth`` words; ``chunk`` bounds the words a
    task holds. Words are split at ASCII white
    space, A-Z lower-cased; an end closes each text and counts as a word. A null or empty text has the end alone; a null ``held`` counts as
    false. Repeated rows are learned and scored each for itself; an empty table gives an empty table; without training rows every
    probability is the root's. Other columns are not read. The result is a written table.
    """
    spark, scratch, old = df.sparkSession, [], []
    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(f"`{text}`").alias("text"))
    with freed(spark):
        chunks, chunks_name = bucketed(chunked(src, depth, chunk), scratch)
        sizes = chunks.agg(F.sum("trained").alias("n"), F.sum(F.element_at("starts", -1)).alias("all")).first()
        total, every = sizes["n"] or 0, sizes["all"] or 0
        bits = max(1, (max(spark.sparkContext.defaultParallelism, every // BUCKET) - 1).bit_length())
        width = min(64, max(every.bit_length() + SPARE, bits + SPARE, SHORTEST))
        answers = written(answered(first_step(chunks, bits)), "answers", scratch)
        distinct = answers.agg(F.sum("known")).first()[0] or 0
        for passes in range(1, depth + 2):
            new = written(answered(step(chunks, answers, passes, depth, least, total, distinct, bits, width)), "answers", scratch)
            answers = answers.union(new)
        pieces = written(step(chunks, answers, depth + 2, depth, least, total, distinct, bits, width), "pieces", old)
        out = pieces.groupBy("doc").agg(F.first("id").alias("doc_id"), F.first("held").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                                        F.lit(total).cast("long").alias("train_tokens"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
        out = written(out.drop("doc"), "scores")
    spark.sql(f"DROP TABLE {chunks_name}")
    removed(spark, scratch + old)
    return out
