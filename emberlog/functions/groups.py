"""Small groups in order: sequential rules that columns cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_group(df: DataFrame, keys: list[str], order: list[str], rule: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``rule`` over the rows of each key, in order: ``keys`` and the columns of ``schema`` come back.

    Rows are dealt by key and sorted in their partition, so a task streams its groups and holds one at a time; many tiny
    groups cost no call from the JVM each. ``rule`` gets tuples of the columns that are no keys.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    out = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema
    arrow, n = df.sparkSession.createDataFrame([], out).toArrow().schema, len(keys)
    rest = [c for c in df.columns if c not in keys]

    def run(batches: Iterator):
        import pyarrow as pa

        def made(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        at, held = None, []
        for b in batches:
            done: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:n] != at:
                    done += [at + tuple(r) for r in rule(held)] if held else []
                    at, held = row[:n], []
                held.append(row[n:])
            yield made(done)
        if held:
            yield made([at + tuple(r) for r in rule(held)])

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def spaced(times: DataFrame, keys: list[str], gap_s: float) -> DataFrame:
    """``(keys, ts)``: of each key's times those more than ``gap_s`` after the last one kept; a repeat of a repeat does not extend it.

    Null times are none, equal times are one, a null key is a key. Times are first counted into cells of ``gap_s``, so the window that finds
    silences of more than ``gap_s`` sees cells, not rows. A silence always starts anew, so the islands between are dealt to different
    tasks, which keep nothing but the last time kept.
    """
    width = max(gap_s, 1.0)
    t = times.select(*keys, F.col("ts").cast("double").alias("ts")).where("ts is not null").distinct().withColumn("_cell", F.floor(F.col("ts") / width))
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "_cell"]]
    c = t.groupBy(*keys, "_cell").agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"))
    w = Window.partitionBy(*keys).orderBy("_cell")
    c = c.withColumn("_new", F.coalesce(F.col("_from") - F.lag("_to").over(w) > gap_s, F.lit(True)).cast("int"))
    c = c.withColumn("_isle", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    dealt = t.alias("t").join(c.alias("c"), same).select(*[F.col(f"t.{k}") for k in keys], "_isle", "ts")
    n = len(keys) + 1

    def run(batches: Iterator):
        import pyarrow as pa

        at, last = None, 0.0
        for b in batches:
            kept = []
            for i, (*key, ts) in enumerate(zip(*[x.to_pylist() for x in b.columns])):
                if key != at or ts - last > gap_s:
                    kept.append(i)
                    at, last = key, ts
            yield b.take(pa.array(kept, "int64")).select([*range(n - 1), n])

    types = {f.name: f.dataType.simpleString() for f in dealt.schema}
    return dealt.repartition(*keys, "_isle").sortWithinPartitions(*keys, "_isle", "ts").mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in [*keys, "ts"]))
