"""N-gram Jaccard join by chosen paths.

Each run splits the sets again and again on a sampled shared token (the one that a random order puts first), so sets
of similarity s stay together with probability s at each split. Small buckets are compared by brute force, and runs
repeat until a pair at the threshold is missed less often than the target allows. The pairs found unite sets
into components; every component is then compared exactly in bounded blocks, which counts all its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import block_pairs, components, joined_anew, removed, written
from emberlog.llm.neardup import spread
from emberlog.llm.shingles import lists, windows, word_hashes

#: Sampled tokens of a set; splits at the start; splits at most; members of a bucket that is not split further.
SKETCH, START, DEPTH, SMALL = 64, 3, 6, 64
#: Sets in a block of the exact comparison; shingles in one; sets in a task of small groups; runs whose buckets are compared first, whatever they hold.
BLOCK, TOKENS, TOGETHER, FIRST = 768, 1 << 20, 768, 2


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at ``threshold`` that is split ``DEPTH`` times is still missed at most 1 - ``recall``.

    All runs draw their splits from the same ``SKETCH`` places. So the share of places on which the pair agrees, which is binomial, makes
    the runs succeed together; the miss is its mean over that share.
    """
    agreed = np.arange(SKETCH + 1)
    log_c = np.array([math.lgamma(SKETCH + 1) - math.lgamma(i + 1) - math.lgamma(SKETCH - i + 1) for i in agreed])
    weight = np.exp(log_c + agreed * math.log(threshold) + (SKETCH - agreed) * math.log1p(-threshold)) if threshold < 1 else (agreed == SKETCH).astype(float)
    whole = np.ones(SKETCH + 1)
    for j in range(DEPTH):
        whole *= np.maximum(agreed - j, 0) / (SKETCH - j)
    runs = 1
    while float((weight * (1 - whole) ** runs).sum()) > 1 - recall:
        runs += 1
    return runs


def sketches(docs: DataFrame, k: int, with_sets: bool) -> DataFrame:
    """``(doc_id, n, k1, k2, sig)`` of the set of word ``k``-shingles of each text with words, or ``(doc_id, shingles)``."""
    rng = np.random.default_rng(64)
    a = (rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    b = rng.integers(0, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32)

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            words, at = lists(batch.column(1))
            ids = batch.column(0)
            full = np.flatnonzero(np.diff(at) > 0)
            for start in range(0, len(full), 512):
                rows = full[start:start + 512]
                sets = [np.unique(windows(words[at[i]:at[i + 1]], k)) for i in rows]
                names = ids.take(pa.array(rows))
                sizes = np.array([len(s) for s in sets])
                flat = np.concatenate(sets)
                if with_sets:
                    yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(flat.view(np.int64)))], ["doc_id", "shingles"])
                    continue
                starts = np.append(0, np.cumsum(sizes)[:-1])
                x = (flat >> np.uint64(32)).astype(np.uint32)
                sig = np.empty((len(sets), SKETCH), np.uint32)
                for j in range(SKETCH):
                    sig[:, j] = np.minimum.reduceat(x * a[j] + b[j], starts)
                k1 = np.add.reduceat(flat, starts)
                k2 = np.add.reduceat((flat ^ (flat >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD), starts)
                yield pa.RecordBatch.from_arrays([names, pa.array(sizes, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * SKETCH, pa.array(sig.ravel().view(np.int32)))], ["doc_id", "n", "k1", "k2", "sig"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("w"))
    return src.mapInArrow(run, "doc_id long, shingles array<long>" if with_sets else "doc_id long, n long, k1 long, k2 long, sig array<int>")


def buckets(classes: DataFrame, runs: int, scratch: list[str]) -> DataFrame:
    """``(run, path, sid, n)`` of every bucket of two sets or more where splitting ended.

    A bucket that keeps three quarters of its parent holds sets alike, which further splits would only wear off.
    """
    def start(r: int):
        places = np.random.default_rng([5, r]).choice(SKETCH, START, replace=False)
        return F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), *[F.col("sig")[int(p)] for p in places]).alias("path"))

    rows = classes.select("sid", "n", F.explode(F.array(*[start(r) for r in range(runs)])).alias("x")).select("sid", "n", "x.run", "x.path", F.lit(None).cast("long").alias("parent"))
    done = []
    for depth in range(START, DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("m")).where("m > 1")
        live = written(joined_anew(rows, sizes, ["path"]), "paths", scratch)
        ended = "true" if depth == DEPTH else f"m <= {SMALL} or m > 0.75 * coalesce(parent, 2 * m)"
        done.append(live.where(ended).select("run", "path", "sid", "n"))
        if depth == DEPTH:
            break
        rows = (live.where(f"not ({ended})").withColumn("parent", F.col("m")).join(classes.select("sid", "sig"), "sid")
                .select("sid", "n", "run", F.xxhash64("path", F.element_at("sig", (F.pmod(F.xxhash64("path", F.lit(depth)), F.lit(SKETCH)) + 1).cast("int"))).alias("path"), "parent"))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def columns(sets: list[np.ndarray], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each of ``tokens`` in the sets, by ascending column."""
    flat = np.concatenate(sets)
    row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(tokens, flat)
    ok = tokens[np.minimum(at, len(tokens) - 1)] == flat
    row, at = row[ok], at[ok]
    order = np.argsort(at, kind="stable")
    return row[order], at[order]


def similar(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float, width: int = 4096) -> np.ndarray:
    """Which of ``a`` are at the threshold with which of ``b``, or with which others of ``a``.

    Intersections are products of 0/1 columns for the tokens that two sets or more hold.
    """
    if b is None:
        tokens, count = np.unique(np.concatenate(a), return_counts=True)
        tokens = tokens[count > 1]
    else:
        tokens = np.intersect1d(np.concatenate(a), np.concatenate(b))
    other = a if b is None else b
    inter = np.zeros((len(a), len(other)), np.float32)
    if len(tokens):
        ra, ca = columns(a, tokens)
        rb, cb = (ra, ca) if b is None else columns(b, tokens)
        for at in range(0, len(tokens), width):
            x = np.zeros((len(a), min(width, len(tokens) - at)), np.float32)
            i, j = np.searchsorted(ca, [at, at + width])
            x[ra[i:j], ca[i:j] - at] = 1
            y = x
            if b is not None:
                y = np.zeros((len(b), x.shape[1]), np.float32)
                i, j = np.searchsorted(cb, [at, at + width])
                y[rb[i:j], cb[i:j] - at] = 1
            inter += x @ y.T
    na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in other])
    inter = inter.astype(np.int64)
    near = inter / (na[:, None] + nb[None, :] - inter) >= threshold
    if b is None:
        np.fill_diagonal(near, False)
    return near


def odd_blocks(rows: DataFrame) -> DataFrame:
    """``rows(path, sid, n, c)`` dealt to tasks that see every pair of a bucket whose components ``c`` differ.

    A bucket's largest component is cut into blocks, and its other sets, if a block holds them, go to each; then pairs
    within the component, which is united already, cost nothing. Other buckets are dealt in pairs of blocks.
    """
    each = rows.groupBy("path", "c").agg(F.count("*").alias("s"), F.sum("n").alias("t")).groupBy("path").agg(
        F.max_by("c", "s").alias("top"), (F.sum("s") - F.max("s")).alias("odd"), (F.sum("t") - F.max_by("t", "s")).alias("odd_t"), F.sum("s").alias("m"), F.sum("t").alias("w"))
    j = rows.join(each, "path")
    k = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / TOKENS)).cast("int")
    few = (F.col("odd") <= BLOCK) & (F.col("odd_t") <= TOKENS) & (k > 1)
    one = j.where(few)
    main = F.col("c") == F.col("top")
    at = F.when(main, F.array(F.pmod(F.xxhash64("sid"), k).cast("int"))).otherwise(F.sequence(F.lit(0), k - 1))
    one = one.withColumn("lo", F.explode(at))
    shared = F.struct(F.lit(None).cast("long").alias("bundle"), F.col("path").alias("component"), F.col("lo"), F.lit(-1).alias("hi"))
    one = one.select(shared.alias("task"), F.col("path").alias("component"), "sid", (~main).alias("in_a"), F.lit(True).alias("in_b"))
    return one.union(dealt_pairs(j.where(~few).select(F.col("path").alias("component"), "sid", "n")))


def dealt_pairs(members: DataFrame) -> DataFrame:
    """``members(component, sid, n)`` in tasks ``(task, component, sid, in_a, in_b)``: those in a are to meet those in b."""
    d = block_pairs(members, "sid", BLOCK, weight="n", most=TOKENS, together=TOGETHER)
    return d.select("task", "component", "sid", (F.col("blk") == F.col("lo")).alias("in_a"), (F.col("blk") == F.col("hi")).alias("in_b"))


def meeting(c: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in a, places in b, which of them are near) of the sets of one task and component."""
    a, b, sets = np.flatnonzero(c["in_a"]), np.flatnonzero(c["in_b"]), c["shingles"].to_list()
    if len(a) == len(b) == len(sets):
        return a, b, similar(sets, None, threshold)
    if not len(a) or not len(b):
        return a, b, np.zeros((len(a), len(b)), bool)
    near = similar([sets[i] for i in a], [sets[i] for i in b], threshold)
    near[a[:, None] == b[None, :]] = False
    return a, b, near


def verified(dealt: DataFrame, sets: DataFrame, threshold: float, scratch: list[str]) -> DataFrame:
    """``(a, b)``: the sets of each task's buckets united over their pairs at the threshold."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, c in g.groupby("component", sort=False):
            c = c.drop_duplicates("sid")
            ids = c["sid"].to_numpy()
            if len(ids) > 1:
                a, b, hits = meeting(c, threshold)
                near = np.eye(len(ids), dtype=bool)
                near[np.ix_(a, b)] |= hits
                first = spread(near | near.T)
                hit = first != np.arange(len(ids))
                out.append(pd.DataFrame({"a": ids[hit], "b": ids[first[hit]]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}).astype("int64")

    wide = dealt.join(sets, "sid").select("task", "component", "sid", "in_a", "in_b", "shingles")
    return written(wide.groupBy("task").applyInPandas(run, "a long, b long").distinct(), "pairs", scratch)


def count_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``(sid, links)``: copies of the other sets of the component at the threshold or above, by exact intersections."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, c in g.groupby("component", sort=False):
            c = c.drop_duplicates("sid")
            copies, links = c["copies"].to_numpy(), np.zeros(len(c), np.int64)
            a, b, near = meeting(c, threshold)
            links[a] += near @ copies[b]
            if len(a) < len(c):
                links[b] += near.T @ copies[a]
            out.append(pd.DataFrame({"sid": c["sid"], "links": links}))
        return pd.concat(out)

    wide = dealt_pairs(members).join(sets, "sid").select("task", "component", "in_a", "in_b", "sid", "copies", "shingles")
    return wide.groupBy("task").applyInPandas(run, "sid long, links long").groupBy("sid").agg(F.sum("links").alias("links"))


def jaccard_classes(docs: DataFrame, *, k: int = 5, threshold: float = 0.8, recall: float = 0.995, links: bool = True) -> DataFrame:
    """``(doc_id, class_id, n_links, kept)``, a row for each row of ``docs(doc_id, text)``.

    Documents link when their sets of ``k``-word shingles have a Jaccard similarity of ``threshold`` or more; a text of
    fewer words is one shingle. A class is what links connect, class_id its smallest doc_id, kept the document that has
    it. Texts with equal sets are compared once and counted. Null or empty texts and null ids link with nothing; a null
    id has no class and is kept. Rows that repeat a doc_id are copies, or with other texts one node. Without ``links``
    the exact count is left out and n_links is null. An empty table gives an empty result; other columns are not read.
    """
    spark, scratch = docs.sparkSession, []
    keys = written(sketches(docs.where("doc_id is not null"), k, False), "keys")
    classes = written(keys.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("sid"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "classes", scratch)
    found = written(buckets(classes, runs_for(threshold, recall), scratch), "buckets", scratch)
    wanted = found.select("sid").distinct()
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("sid"), "left_semi")
    sets = written(sketches(picked, k, True).withColumnRenamed("doc_id", "sid").join(classes.select("sid", "copies"), "sid"), "sets", scratch)
    early = found.where(F.col("run") < FIRST).select(F.col("path").alias("component"), "sid", "n")
    part = components(verified(dealt_pairs(early), sets, threshold, scratch))
    rest = found.where(F.col("run") >= FIRST).join(part, F.col("sid") == F.col("node"), "left").select("path", "sid", "n", F.coalesce("component", "sid").alias("c"))
    split = rest.groupBy("path").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("path")
    late = written(joined_anew(rest, split, ["path"], "left_semi"), "late", scratch)
    more = verified(odd_blocks(late), sets, threshold, scratch)
    comp = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = classes.join(comp, F.col("sid") == F.col("node"), "left").select("k1", "k2", "n", "sid", "copies", "component")
    if links:
        counted = count_links(named.where("component is not null").select("component", "sid", "n"), sets, threshold)
        named = named.join(counted, "sid", "left").withColumn("total", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    else:
        named = named.withColumn("total", F.lit(None).cast("long"))
    named = written(named.select("k1", "k2", "n", F.coalesce("component", "sid").alias("class"), "total"), "named")
    removed(spark, scratch)
    by_doc = keys.select("doc_id", "k1", "k2", "n").join(named, ["k1", "k2", "n"]).groupBy("doc_id").agg(F.min("class").alias("_class"), F.max("total").alias("_total"))
    by_doc = by_doc.withColumnRenamed("doc_id", "_id")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = src.join(by_doc, F.col("doc_id") == F.col("_id"), "left")
    cid = F.coalesce("_class", "doc_id")
    total = F.coalesce("_total", F.lit(0)) if links else F.col("_total")
    return out.select("doc_id", cid.alias("class_id"), total.cast("long").alias("n_links"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c / (na.n + nb.n - c) >= 0.8),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
t AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, doc_id = class_id AS kept FROM k LEFT JOIN t USING (doc_id)
"""
