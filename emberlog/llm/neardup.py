"""Embedding near-dedup by sorted projection passes.

Each pass orders the vectors of a label lexicographically by concatenated random projection bits and compares every
vector with a bounded window of its successors. Verified pairs of all passes are united into components. Since linked
vectors share a component, an exact check of each component in bounded blocks then counts every link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from emberlog.llm.common import block_pairs, components, removed, written

#: Members of a component that one block holds; windows that one task walks.
BLOCK, WALK = 512, 8


def unit(vectors: np.ndarray) -> np.ndarray:
    x = np.asarray(vectors, np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def plain(embedding: Column | str) -> Column:
    """The vector with negative zeros as zeros, so that equal vectors are equal keys."""
    return F.transform(embedding, lambda x: x + F.lit(0).cast("float"))


def distinct_vectors(df: DataFrame) -> DataFrame:
    """``(vec_id, label, embedding, size, h, copies)`` of the distinct usable vectors of each label; vec_id is the smallest.

    Usable: id, label and vector are not null, no component is null or non-finite, not all are zero. Copies meet in
    partial sums before the shuffle. ``h`` tells vectors apart that share an id.
    """
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(
        (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    e = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", plain("embedding").alias("embedding")).where(good)
    one = e.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    return one.select("vec_id", "label", "embedding", F.size("embedding").alias("size"), F.xxhash64("label", "embedding").alias("h"), "copies")


def passes_for(n: Column, window: int, threshold: float, recall: float) -> Column:
    """Passes after which a pair at ``threshold`` among ``n`` vectors of its label is still missed at most 1 - ``recall``.

    Two vectors at an angle a agree on a projection bit with probability 1 - a / pi. They are within the window if they
    agree on the bits that cut the label down to it; two bits more allow for vectors that lie unevenly. A label that a window holds
    needs one pass, which compares all its pairs.
    """
    agree = min(1 - math.acos(min(max(threshold, -1.0), 1.0)) / math.pi, 0.9999)
    bits = F.log2(n / F.lit(float(window))) + 2
    return F.when(n <= window, 1).otherwise(F.ceil(F.lit(math.log(1 - recall)) / F.log(1 - F.pow(F.lit(agree), bits)))).cast("int")


def pass_keys(vectors: DataFrame, bits: int, seed: int) -> DataFrame:
    """``(label, size, pass, sig, vec_id, h)``: every vector's projection bits as one sortable number for each of its ``passes``; the vector stays."""
    kind = vectors.schema["label"].dataType
    out = S.StructType([S.StructField("label", kind), S.StructField("size", S.IntegerType()), S.StructField("pass", S.IntegerType()), S.StructField("sig", S.LongType()), S.StructField("vec_id", S.LongType()), S.StructField("h", S.LongType())])

    def run(batches: Iterator[pa.RecordBatch]):
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            label, vec_id, h = b.column(0), b.column(1), b.column(2)
            size, passes = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            flat, at = b.column(5).flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size))
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                x = flat[at[rows][:, None] + np.arange(d)].astype(np.float64)
                for p in range(int(passes[rows].max())):
                    if (p, d) not in planes:
                        planes[p, d] = np.random.default_rng([seed, int(d), p]).standard_normal((int(d), bits))
                    mine = passes[rows] > p
                    sig = ((x[mine] @ planes[p, d] > 0) * weights).sum(axis=1)
                    take = pa.array(rows[mine])
                    yield pa.RecordBatch.from_arrays([label.take(take), pa.array(size[rows[mine]], pa.int32()), pa.array(np.full(len(sig), p), pa.int32()), pa.array(sig), vec_id.take(take), h.take(take)], [f.name for f in out])

    return vectors.select("label", "vec_id", "h", "size", "passes", "embedding").mapInArrow(run, out)


def placed(keys: DataFrame, scratch: list[str]) -> DataFrame:
    """``keys`` with ``g``, the row's place (from 0) in the order of label, size, pass and bits over the whole table.

    Range partitions are sorted and written with each row's place in its partition; the sizes of the partitions before, one number
    for each, are added. So windows do not end where a partition does.
    """
    order = ["label", "size", "pass", "sig", "vec_id", "h"]
    rows = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    rows = written(rows, "order", scratch).withColumn("part", F.shiftright("m", 33)).withColumn("at", F.col("m").bitwiseAND((1 << 33) - 1))
    sizes = written(rows.groupBy("part").agg(F.count("*").alias("n")), "parts", scratch)
    starts = sizes.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("first"))
    return rows.join(starts, "part").select("vec_id", "h", "pass", (F.col("first") + F.col("at")).alias("g"))


def spread(near: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each row of a symmetric matrix."""
    n = len(near)
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(near, low[None, :], n).min(axis=1))
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def near_rows(x: np.ndarray, threshold: float, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, the first row that its window's verified pairs lead to) of unit vectors in order."""
    for i in range(0, len(x), window):
        near = x[i:i + window] @ x[i:i + 2 * window].T >= threshold
        np.fill_diagonal(near, False)
        m, n = near.shape
        hit = np.flatnonzero(near.any(axis=0) | np.append(near.any(axis=1), np.zeros(n - m, bool)))
        if len(hit):
            both = np.zeros((n, n), bool)
            both[:m] = near
            both = both[np.ix_(hit, hit)]
            first = spread(both | both.T)
            other = first != np.arange(len(hit))
            yield i + hit[other], i + hit[first[other]]


def window_pairs(places: DataFrame, vectors: DataFrame, threshold: float, window: int) -> DataFrame:
    """``(a, b)``: verified pairs within ``window`` places of each other in a pass, united where they meet.

    A task walks ``WALK`` windows in order and is also given the window behind them, so no pair is cut off; only these rows travel
    twice. Vectors are fetched for the tasks by id.
    """
    last = F.floor(F.col("g") / (WALK * window))
    tasks = F.when((F.col("g") % (WALK * window) < window) & (last > 0), F.array(last, last - 1)).otherwise(F.array(last))
    rows = places.withColumn("task", F.explode(tasks)).join(vectors.select("vec_id", "h", "label", "size", "embedding"), ["vec_id", "h"])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("g").combine_chunks()
        size, turn = t["size"].to_numpy(), t["pass"].to_numpy()
        label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        ids, flat = t["vec_id"].to_numpy(), t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        at = np.append(0, np.cumsum(size))
        cut = np.flatnonzero((np.diff(size) != 0) | (np.diff(turn) != 0) | (np.diff(label) != 0)) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(np.append(0, cut), np.append(cut, len(ids))):
            for i, j in near_rows(unit(flat[at[s]:at[e]].reshape(e - s, -1)), threshold, window):
                a.append(ids[s + i])
                b.append(ids[s + j])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return rows.select("task", "g", "pass", "vec_id", "label", "size", "embedding").groupBy("task").applyInArrow(run, "a long, b long")


def count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``(vec_id, links)``: copies of the other distinct vectors of the component with cosine at the threshold or above.

    Every pair of a component is compared once, in blocks: m different vectors cost m²/2 comparisons, since the number of links is asked for.
    """
    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, c in g.groupby("component", sort=False):
            x, w, blk = unit(np.stack(c["embedding"].to_list())), c["copies"].to_numpy(), c["blk"].to_numpy()
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if c["lo"].iloc[0] != c["hi"].iloc[0]:
                near &= blk[:, None] != blk[None, :]
            out.append(pd.DataFrame({"vec_id": c["vec_id"], "h": c["h"], "links": near @ w}))
        return pd.concat(out)

    dealt = block_pairs(members, "h", block).select("task", "component", "lo", "hi", "blk", "vec_id", "h", "copies", "embedding")
    return dealt.groupBy("task").applyInPandas(run, "vec_id long, h long, links long").groupBy("vec_id", "h").agg(F.sum("links").alias("links"))


def near_duplicates(df: DataFrame, *, threshold: float = 0.93, recall: float = 0.999, bits: int = 48, window: int = 1024, seed: int = 11) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``df(vec_id, embedding, label)``.

    Vectors link when their labels are equal, their lengths are equal and their cosine in double precision is at least
    ``threshold``. Null, zero and non-finite vectors, null labels and null ids link with nothing and are their own
    component. Copies link with each other; they are compared once and counted. Rows that repeat a vec_id are copies
    or, with other vectors, one node. ``recall`` is for a pair at the threshold without a common neighbour; each label's
    passes follow from it and from the number of its different vectors, and a label of ``window`` vectors or fewer is compared
    in full. An empty table gives an empty result; other columns are not read.
    """
    spark, scratch = df.sparkSession, []
    one = written(distinct_vectors(df), "vectors", scratch)
    sizes = written(one.groupBy("label", "size").agg(F.count("*").alias("n")), "labels", scratch)
    wanted = one.join(sizes, ["label", "size"]).withColumn("passes", passes_for(F.col("n"), window, threshold, recall)).where("n > 1")
    places = placed(pass_keys(wanted, bits, seed), scratch)
    edges = written(window_pairs(places, one, threshold, window).distinct(), "pairs", scratch)
    comp = components(edges)
    members = one.join(comp, one["vec_id"] == comp["node"]).drop("node")
    links = count_links(members, threshold)
    done = written(one.join(comp, one["vec_id"] == comp["node"], "left").join(links, ["vec_id", "h"], "left").select(
        F.col("label").alias("_l"), F.col("embedding").alias("_e"), F.coalesce("component", one["vec_id"]).alias("_component"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links")), "classes")
    removed(spark, scratch)
    src = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", plain("embedding").alias("_v"))
    out = src.join(done, (F.col("label") == F.col("_l")) & (F.col("_v") == F.col("_e")) & F.col("vec_id").isNotNull(), "left")
    cid = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.coalesce(F.col("vec_id") == cid, F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
