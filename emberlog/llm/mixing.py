"""Mixing sources to target weights with a Pfair schedule, in DataFrame functions only.

Every source is cut into blocks of about ``block_size`` units. Block k (from 0) of a source with weight w may start
from slot floor(k / w) and must be placed before slot ceil((k + 1) / w). Earliest deadline first over these windows
keeps every source within less than one block of its share at every slot. Weights are whole numbers of slots of a period, after
which the schedule repeats; one period is folded once and every block finds its slot by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import key_of, unused, written

#: Hex digits of an order hash that give its bucket: a source's rows are dealt over 4,096 buckets, so that none is sorted in one task.
DIGITS = 3
#: Sources up to which the plan, one row each, is broadcast; beyond, the optimizer chooses.
FEW = 10_000


def quotas(totals: DataFrame, weights: dict[str | None, float] | None, slots: int) -> DataFrame:
    """``totals(src, total)`` to ``(src, total, quota, period)``: whole slots that sum to the period, one at least.

    Weights default to the square root of a source's size, which lifts small sources. Largest remainders fill up,
    ties by source key. The period is ``slots``, or the number of sources and half of ``slots`` where that is more.
    """
    if weights is None:
        raw = F.floor(F.sqrt(F.col("total"))).cast("long")
    else:
        pairs = [x for s, w in weights.items() for x in (F.lit("n" if s is None else "v" + s), F.lit(int(round(w * 1_000_000))))]
        raw = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("src")), F.lit(0)).cast("long") if pairs else F.lit(0).cast("long")
    everything = Window.partitionBy(F.lit(0))  # one row per source
    q = totals.withColumn("raw", F.greatest(raw, F.lit(1).cast("long")))
    q = q.withColumn("n", F.count("*").over(everything)).withColumn("all", F.sum("raw").over(everything))
    q = q.withColumn("period", F.greatest(F.lit(slots).cast("long"), F.col("n") + F.lit(slots // 2)))
    q = q.withColumn("part", F.expr("(period - n) * raw")).withColumn("base", F.expr("1 + part div all"))
    q = q.withColumn("left", F.col("period") - F.sum("base").over(everything))
    q = q.withColumn("rk", F.row_number().over(everything.orderBy(F.expr("part % all").desc(), "src")))
    return q.select("src", "total", F.expr("base + if(rk <= left, 1, 0)").alias("quota"), "period")


def schedule(quota: DataFrame) -> DataFrame:
    """``(src, quota, period)`` to ``(src, places)``: the slots of one period that each source gets, ascending.

    Sources of two blocks or more are folded in one row: the fold picks the released block with the earliest deadline, ties by
    source key, and skips ahead where none is released. There are at most ``slots`` such sources with twice as many
    blocks, whatever the number of sources. The window of a source's only block is the whole period, so no deadline
    is later: these sources take the slots left, by key, however many they are. All windows hold.
    """
    many = quota.where("quota > 1").groupBy().agg(F.sort_array(F.collect_list(F.struct("src", "quota"))).alias("qs"), F.max("period").alias("d"), F.sum("quota").alias("blocks")).where("d is not null")
    picks = F.expr("""
        aggregate(sequence(1L, blocks), struct(0L as t, transform(qs, q -> 0L) as done, cast(array() as array<struct<at: bigint, i: int>>) as picks), (acc, step) ->
          element_at(transform(array(greatest(acc.t, array_min(transform(qs, (q, i) -> if(acc.done[i] < q.quota, (acc.done[i] * d) div q.quota, 9223372036854775807L))))),
            t -> element_at(transform(array(array_min(transform(qs, (q, i) -> struct(
                if(acc.done[i] < q.quota and (acc.done[i] * d) div q.quota <= t,
                   ((acc.done[i] + 1) * d + q.quota - 1) div q.quota, 9223372036854775807L) as due, i as i)))),
              best -> struct(t + 1 as t, transform(acc.done, (x, i) -> x + if(i = best.i, 1L, 0L)) as done,
                             concat(acc.picks, array(struct(t as at, best.i as i))) as picks)), 1)), 1)).picks""")
    heavy = many.select("qs", F.explode(picks).alias("p")).select(F.expr("qs[p.i].src").alias("src"), F.expr("p.at").alias("at"))
    taken = heavy.agg(F.array_sort(F.collect_list("at")).alias("taken"))
    size = quota.agg(F.max("period").alias("d")).where("d is not null")
    free = size.join(taken).select(F.explode(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("d") - 1), "taken")).alias("at"))
    free = free.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")))
    ones = quota.where("quota = 1").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("src")))
    light = ones.join(free, "k").select("src", F.array("at").alias("places"))
    return heavy.groupBy("src").agg(F.sort_array(F.collect_list("at")).alias("places")).union(light)


def with_slots(df: DataFrame, source: str = "source", order: str = "doc_id", *, size: Column | None = None, block_size: int = 65536,
               weights: dict[str | None, float] | None = None, slots: int = 1000, seed: int = 0) -> DataFrame:
    """``df`` with ``_mix = struct(src, block, slot, on_target, h, unit)``; no row is lost. A column of that name is replaced.

    Rows of a source follow the md5 of ``order`` and ``seed``. A row's block is the running size before it divided
    by ``block_size``; a row longer than a block keeps the block it starts in. ``on_target`` holds while every
    source still has blocks. A null source is a source of its own; a null or non-positive size counts as 1; rows
    that repeat one ``order`` value follow each other by size. The plan, a row for each source, is a written table.
    """
    unit = F.greatest(F.coalesce(size if size is not None else F.lit(1), F.lit(1)).cast("long"), F.lit(1).cast("long"))
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(order).cast("string"), F.lit(""))))
    names = [c for c in df.columns if c.lower() != "_mix"]
    k, s, b, before, p, block = (unused(x, names) for x in ("_mix_k", "_mix_s", "_mix_b", "_mix_before", "_mix_p", "_mix_block"))
    keyed = df.withColumn(k, F.struct(key_of(F.col(source)).alias("src"), h.alias("h"), F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("int").alias("bucket"), unit.alias("unit")))
    per = keyed.select(f"{k}.*").groupBy("src", "bucket").agg(F.sum("unit").alias("units"))
    offsets = written(per.withColumn("before", F.sum("units").over(Window.partitionBy("src").orderBy("bucket")) - F.col("units")), "buckets")
    quota = written(quotas(offsets.groupBy("src").agg(F.sum("units").alias("total")), weights, slots), "quotas")
    place = "({b} div quota) * period + places[cast({b} % quota as int)]"
    plan = quota.join(schedule(quota), "src").withColumn("out", F.expr(place.format(b=f"(((total - 1) div {block_size}) + 1)")))
    plan = written(plan.withColumn("horizon", F.min("out").over(Window.partitionBy(F.lit(0)))), "plan")
    right = offsets.select(F.col("src").alias(s), F.col("bucket").alias(b), F.col("before").alias(before))
    out = keyed.join(right, (F.col(f"{k}.src") == F.col(s)) & (F.col(f"{k}.bucket") == F.col(b)))
    run = Window.partitionBy(s, b).orderBy(f"{k}.h", F.col(f"`{order}`"), f"{k}.unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn(block, F.sum(f"{k}.unit").over(run) - F.col(f"{k}.unit")).withColumn(block, F.expr(f"({before} + {block}) div {block_size}"))
    dim = plan.select(F.struct("*").alias(p))
    out = out.join(F.broadcast(dim) if plan.count() <= FEW else dim, F.col(s) == F.col(f"{p}.src"))
    slot = F.expr(f"({block} div {p}.quota) * {p}.period + {p}.places[cast({block} % {p}.quota as int)]")
    mix = F.struct(F.col(s).alias("src"), F.col(block).alias("block"), slot.alias("slot"), (slot < F.col(f"{p}.horizon")).alias("on_target"), F.col(f"{k}.h").alias("h"), F.col(f"{k}.unit").alias("unit"))
    return out.select(*[F.col(f"`{c}`") for c in names], mix.alias("_mix"))


def mix_sources(df: DataFrame, source: str = "source", order: str = "doc_id", *, groups: int = 4096, **options) -> DataFrame:
    """``df`` with ``block``, ``slot``, ``on_target`` and ``mix_pos``, the row's place (from 0) in the mixed order.

    Options as for ``with_slots``. Places come from counts of ``groups`` even ranges of slots plus a
    row number inside each range, so no task sorts the whole table. Clashing columns of ``df`` are replaced.
    An empty table gives an empty table.
    """
    keep = [c for c in df.columns if c.lower() not in {"block", "slot", "on_target", "mix_pos", "_mix"}]
    m = with_slots(df, source, order, **options)
    most, g, g2, start = (unused(x, m.columns) for x in ("_mix_top", "_mix_g", "_mix_g2", "_mix_start"))
    m = m.join(F.broadcast(m.agg(F.max("_mix.slot").alias(most))))  # one row
    m = m.withColumn(g, F.expr(f"(_mix.slot * {groups}) div ({most} + 1)"))
    sizes = m.groupBy(g).agg(F.count("*").alias("n"))
    starts = sizes.select(F.col(g).alias(g2), (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(g)) - F.col("n")).alias(start))
    m = m.join(starts, F.col(g) == F.col(g2))
    place = F.row_number().over(Window.partitionBy(g2).orderBy("_mix.slot", "_mix.h", F.col(f"`{order}`"), "_mix.unit"))
    return m.select(*[F.col(f"`{c}`") for c in keep], "_mix.block", "_mix.slot", "_mix.on_target", (F.col(start) + place - 1).cast("long").alias("mix_pos"))


def mixed_order(df: DataFrame, source: str = "source", order: str = "doc_id", **options) -> DataFrame:
    """The rows and columns of ``df``, sorted by slot over range partitions: files written from it follow the mix.

    Rows of one slot follow the hash of ``order``, then ``order`` and size; rows that repeat all three are next to each other in either order. Nulls
    are as in ``with_slots``. An empty table gives an empty table. A column ``_mix`` is not kept.
    """
    m = with_slots(df, source, order, **options).repartitionByRange("_mix.slot", "_mix.h")
    return m.sortWithinPartitions("_mix.slot", "_mix.h", F.col(f"`{order}`"), "_mix.unit").select(*[F.col(f"`{c}`") for c in m.columns if c != "_mix"])


SQL = """
WITH RECURSIVE k AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS src,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, greatest(coalesce(length(text), 1), 1) AS unit FROM documents),
c AS (SELECT *, CAST(sum(unit) OVER (PARTITION BY src ORDER BY h, doc_id NULLS FIRST, unit ROWS UNBOUNDED PRECEDING) AS BIGINT) - unit AS before FROM k),
b AS (SELECT *, before // 65536 AS block FROM c),
t AS (SELECT src, CAST(sum(unit) AS BIGINT) AS total, greatest(CAST(floor(sqrt(sum(unit))) AS BIGINT), 1) AS raw FROM k GROUP BY src),
t2 AS (SELECT *, count(*) OVER () AS n, CAST(sum(raw) OVER () AS BIGINT) AS tot, greatest(1000, 500 + count(*) OVER ()) AS period FROM t),
t3 AS (SELECT *, 1 + ((period - n) * raw) // tot AS base, ((period - n) * raw) % tot AS rest FROM t2),
t4 AS (SELECT *, period - CAST(sum(base) OVER () AS BIGINT) AS lft, row_number() OVER (ORDER BY rest DESC, src) AS rk FROM t3),
q AS (SELECT src, total, base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota, period FROM t4),
qs AS (SELECT list(quota ORDER BY src) AS qu, list(src ORDER BY src) AS names, max(period) AS d FROM q),
fold AS (SELECT 0 AS ti, list_transform(qu, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick, qu, d FROM qs
  UNION ALL
  SELECT ti + 1, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p, qu, d
  FROM (SELECT ti, done, qu, d, list_min(list_transform(qu, lambda z, i: CASE WHEN done[i] < z AND (done[i] * d) // z <= ti
      THEN (((done[i] + 1) * d + z - 1) // z) * 200000 + (CASE WHEN z = 1 THEN 100000 ELSE 0 END) + i ELSE 9000000000000000 END)) % 100000 AS p FROM fold WHERE ti < d) s),
places AS (SELECT names[pick] AS src, list(CAST(ti - 1 AS BIGINT) ORDER BY ti) AS pl FROM fold, qs WHERE ti > 0 GROUP BY 1),
plan AS (SELECT q.*, pl, ((((total - 1) // 65536) + 1) // quota) * period + pl[CAST((((total - 1) // 65536) + 1) % quota AS INT) + 1] AS outs FROM q JOIN places USING (src)),
hz AS (SELECT min(outs) AS horizon FROM plan),
s AS (SELECT doc_id, source, h, unit, block, (block // quota) * period + pl[CAST(block % quota AS INT) + 1] AS slot FROM b JOIN plan USING (src))
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, slot < horizon AS on_target,
  row_number() OVER (ORDER BY slot, h, doc_id NULLS FIRST, unit) - 1 AS mix_pos FROM s, hz
"""
