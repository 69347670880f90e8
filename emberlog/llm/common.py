"""Shared folder, written tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where it is unset, a temporary one in local mode; on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/emberlog/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at files that outlive executors.

    The path is added to ``scratch``, for ``removed`` once nothing reads it any more.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, scratch: list[str]) -> None:
    """Delete written tables that no later step reads, in whatever file system holds them."""
    sc = spark.sparkContext
    for path in scratch:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    scratch.clear()


def unused(name: str, taken: list[str]) -> str:
    """``name``, or a longer form of it that is no column of ``taken`` (names are compared without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_of(col: Column) -> Column:
    """A non-null text key of a nullable column; null and every text stay apart."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


def joined_anew(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose sides are both dealt anew, also where ``right`` is an aggregate by ``keys``.

    The layout of an aggregate binds a join on the same keys, so that adaptive execution cannot split the rows of a hot key. With a hash of
    the keys as one more key neither side has the layout that the join asks for.
    """
    again = unused("_again", [*left.columns, *right.columns])
    h = F.xxhash64(*keys)
    return left.withColumn(again, h).join(right.withColumn(again, h), [again, *keys], how).drop(again)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` of longs: ``(node, component)``, component the smallest node.

    Alternating large-star and small-star rounds. Each round is two joins on minima that are combined before the
    shuffle; the joins deal their sides anew, so the neighbours of a hub can be split over tasks. Each round's edges are a written table;
    those of the round before are removed. Nodes without an edge have no row; an empty input gives an empty result.
    """
    spark = edges.sparkSession
    old: list[str] = []
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", old)
    seen = None
    while True:
        made: list[str] = []
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = joined_anew(both, low, ["a"]).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = joined_anew(large, low, ["a"]).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x"))
        e = written(small.select("x.a", "x.b").where("a <> b").distinct(), "edges", made)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        removed(spark, old)
        old = made
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def block_pairs(members: DataFrame, node: str, block: int, *, weight: str | None = None, most: int = 1 << 20, together: int | None = None) -> DataFrame:
    """``members(component, node, ...)`` dealt to tasks that see every pair of a component once.

    A component of m members has k blocks, dealt by the node's hash: ceil(m / block), or more where the sum of ``weight``
    would give a block over ``most``. Each member goes to k pairs of blocks ``(lo, hi)``, so a task holds about two
    blocks however large the component. Components of one block share tasks of about ``together`` members.
    """
    heavy = F.sum(weight) if weight else F.lit(0).cast("long")
    sizes = members.groupBy("component").agg(F.count("*").alias("m"), heavy.alias("_w"))
    total = members.agg(F.count("*").alias("m"), heavy.alias("w")).first()
    bundles = max(1, total["m"] // (together or 4 * block), (total["w"] or 0) // most)
    k = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("_w") / most), F.lit(1)).cast("int")
    m = members.join(sizes, "component").withColumn("k", F.least(k, F.col("m").cast("int")))
    m = m.withColumn("blk", F.pmod(F.xxhash64(node), F.col("k")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    m = m.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
    none = F.lit(None).cast("long")
    alone = F.struct(F.pmod(F.xxhash64("component"), F.lit(bundles)).alias("bundle"), none.alias("component"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    shared = F.struct(none.alias("bundle"), F.col("component"), F.col("lo"), F.col("hi"))
    return m.withColumn("task", F.when(F.col("k") == 1, alone).otherwise(shared)).drop("m", "_w", "k", "other")
