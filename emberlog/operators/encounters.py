"""Encounters: gap sessionisation, zones, attached context and markers, in window functions over arrival order.

Every function takes and gives events; ``seq`` orders a stream. Windows part by stream and zone epoch, since a zone line always ends
an encounter: a long stream is many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.config import ACTIVITY, DAMAGE, PREFIGHT
from emberlog.functions import text as T

START, BEFORE = Window.unboundedPreceding, -1
#: Rows of a stretch of ``seq`` over all streams.
BLOCK = 200_000


def between_npcs(is_pet: Column | None = None) -> Column:
    both = T.is_npc(F.col("actor")) & T.is_npc(F.col("target"))
    return both if is_pet is None else both & ~F.coalesce(is_pet, F.lit(False))


def assign_encounters(events: DataFrame, timeout_s: float = 12.0) -> DataFrame:
    """Events with ``zone_epoch``, ``enc`` (number within the epoch, null outside) and ``act``; zone rows are dropped.

    An activity row opens an encounter if it is the epoch's first, or if since the row of activity before it any row
    came more than ``timeout_s`` after the latest activity time. Context rows belong until such a row.
    """
    stream = Window.partitionBy("stream_id").orderBy("seq")
    e = events.withColumn("zone_epoch", F.sum((F.col("kind") == "zone").cast("int")).over(stream.rowsBetween(START, 0)))
    e = e.where("kind <> 'zone'").withColumn("act", F.col("kind").isin(*ACTIVITY) & ~between_npcs(F.col("is_pet") if "is_pet" in events.columns else None))
    w = Window.partitionBy("stream_id", "zone_epoch").orderBy("seq")
    act_ts = F.when(F.col("act"), F.col("ts"))
    e = e.withColumn("_late", F.coalesce(F.col("ts") - F.max(act_ts).over(w.rowsBetween(START, BEFORE)) > timeout_s, F.lit(False)).cast("int"))
    e = e.withColumn("_c", F.sum("_late").over(w.rowsBetween(START, 0)))
    act_c = F.when(F.col("act"), F.col("_c"))
    e = e.withColumn("_pc", F.last(act_c, True).over(w.rowsBetween(START, BEFORE))).withColumn("_lc", F.last(act_c, True).over(w.rowsBetween(START, 0)))
    opens = (F.col("act") & (F.col("_pc").isNull() | (F.col("_c") > F.col("_pc")))).cast("int")
    e = e.withColumn("_n", F.sum(opens).over(w.rowsBetween(START, 0)))
    return e.withColumn("enc", F.when((F.col("_n") > 0) & (F.col("_c") == F.col("_lc")), F.col("_n"))).drop("_late", "_c", "_pc", "_lc", "_n")


def encounter_rows(assigned: DataFrame) -> DataFrame:
    """Only rows of encounters that hold damage."""
    w = Window.partitionBy("stream_id", "zone_epoch", "enc")
    hit = F.col("kind").isin(*DAMAGE) & F.col("act")
    return assigned.where("enc is not null").withColumn("_d", F.max(hit.cast("int")).over(w)).where("_d = 1").drop("_d")


def encounters(assigned: DataFrame) -> DataFrame:
    """One row for each encounter with damage: start, end (latest activity), rows, damage rows, kills and targets.

    Targets are the NPCs on either side of activity, or without any the attacked.
    """
    act = F.col("act")
    npc = lambda c: F.when(act & T.is_npc(F.col(c)), F.col(c))
    g = assigned.where("enc is not null").groupBy("stream_id", "zone_epoch", "enc").agg(
        F.min(F.when(act, F.col("ts"))).alias("start"), F.max(F.when(act, F.col("ts"))).alias("end"), F.count("*").alias("n_events"),
        F.count_if(F.col("kind").isin(*DAMAGE) & act).alias("n_damage"), F.count_if(F.col("kind") == "kill").alias("kills"),
        F.array_sort(F.array_union(F.collect_set(npc("actor")), F.collect_set(npc("target")))).alias("_npcs"),
        F.array_sort(F.collect_set(F.when(act, F.col("target")))).alias("_attacked"))
    return g.where("n_damage > 0").select("stream_id", "zone_epoch", "enc", "start", F.greatest("start", "end").alias("end"), "n_events", "n_damage", "kills",
                                          F.array_join(F.when(F.size("_npcs") > 0, F.col("_npcs")).otherwise(F.col("_attacked")), ", ").alias("targets"))


def attach_prefight(assigned: DataFrame, within_s: float = 20.0, rows: int = 20) -> DataFrame:
    """Context rows outside an encounter that join the next one: at most ``rows`` of the last ``within_s`` seconds before it opens.

    Gives ``(stream_id, zone_epoch, seq, enc, open_seq)``. The next opener is a window minimum, not a range join.
    """
    w = Window.partitionBy("stream_id", "zone_epoch").orderBy("seq")
    new = F.col("act") & (F.col("enc") > F.coalesce(F.max("enc").over(w.rowsBetween(START, BEFORE)), F.lit(0)))
    e = assigned.withColumn("_open", F.when(new, F.struct("seq", "ts", "enc")))
    # read backwards, as a frame that ends with its partition is computed anew for every row
    back = Window.partitionBy("stream_id", "zone_epoch").orderBy(F.col("seq").desc())
    e = e.withColumn("_next", F.last("_open", True).over(back.rowsBetween(START, BEFORE)))
    e = e.where(F.col("enc").isNull() & F.col("kind").isin(*PREFIGHT) & F.col("_next").isNotNull() & (F.col("_next.ts") - F.col("ts") <= within_s))
    last = Window.partitionBy("stream_id", "zone_epoch", "_next.seq").orderBy(F.col("seq").desc())
    return e.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= rows).select("stream_id", "zone_epoch", "seq", F.col("_next.enc").alias("enc"), F.col("_next.seq").alias("open_seq"))


def fold_markers(events: DataFrame) -> DataFrame:
    """Damage rows with the absorbed and blocked amounts and the critical mark of the marker rows that follow them; marker rows go."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(START, 0)
    e = events.withColumn("_hit", F.last(F.when(F.col("kind").isin(*DAMAGE), F.col("seq")), True).over(w))
    marked = F.coalesce(F.col("outcome") == "critical", F.lit(False)) if "outcome" in events.columns else F.lit(False)
    extra = e.where((F.col("kind") == "marker") & F.col("_hit").isNotNull()).groupBy("stream_id", F.col("_hit").alias("seq")).agg(
        F.sum("absorbed").alias("_a"), F.sum("blocked").alias("_b"), F.bool_or(marked).alias("_c"))
    plus = lambda c, m: F.when(F.col(c).isNull() & F.col(m).isNull(), None).otherwise(F.coalesce(c, F.lit(0)) + F.coalesce(m, F.lit(0)))
    out = e.where("kind <> 'marker'").drop("_hit").join(extra, ["stream_id", "seq"], "left")
    if "outcome" in events.columns:
        out = out.withColumn("outcome", F.when(F.coalesce("_c", F.lit(False)), "critical").otherwise(F.col("outcome")))
    return out.withColumn("absorbed", plus("absorbed", "_a")).withColumn("blocked", plus("blocked", "_b")).drop("_a", "_b", "_c")


def zone_visits(events: DataFrame) -> DataFrame:
    """Islands of one zone: ``(stream_id, visit, zone, entered, n)``; entering the same zone again is the same visit."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    z = events.where("kind = 'zone' and target is not null")
    z = z.withColumn("_new", (~F.col("target").eqNullSafe(F.lag("target").over(w))).cast("int"))
    z = z.withColumn("visit", F.sum("_new").over(w.rowsBetween(START, 0)))
    return z.groupBy("stream_id", "visit").agg(F.min_by("target", "seq").alias("zone"), F.min_by("ts", "seq").alias("entered"), F.count("*").alias("n"))


def with_zone(events: DataFrame) -> DataFrame:
    """Non-zone rows with the zone entered last, empty before the first: an as-of join as one window."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(START, 0)
    z = F.last(F.when(F.col("kind") == "zone", F.col("target")), True).over(w)
    return events.withColumn("zone", F.coalesce(z, F.lit(""))).where("kind <> 'zone'")


def in_blocks(events: DataFrame, rows: int = BLOCK) -> DataFrame:
    """``events`` with ``_b``, the stretch of ``seq`` that a row lies in: about ``rows`` rows where ``seq`` is even. Blocks ascend with ``seq``."""
    a = events.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count("seq").alias("n")).first()
    width = max(1, (a["hi"] - a["lo"] + 1) * rows // a["n"]) if a["n"] else 1
    return events.withColumn("_b", F.floor((F.col("seq") - F.lit(a["lo"] or 0)) / F.lit(width)).cast("long"))


def before_blocks(events: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """``events`` with the sums of ``values`` over the blocks before a row's own, by ``keys``; null keys are a group. Only these sums go over whole streams."""
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(START, BEFORE)
    sums = events.groupBy(*keys, "_b").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in values])
    on = F.col("_b").eqNullSafe(F.col("_kb"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return events.join(sums, on).drop(*[f"_k{i}" for i in range(len(keys))], "_kb")


def impute_amounts(events: DataFrame) -> DataFrame:
    """Amounts for hits and heals that were read without one: means of earlier ones, by this zone visit and then the whole
    stream; by actor and skill, actor, skill, all. At least 1, halves to even. Filled rows are marked ``estimated`` and teach nothing.

    What holds for a whole stream, its zones and its mean, is summed by blocks first, so no task sorts a stream.
    """
    group = F.when(F.col("kind") == "heal", "heal").when(F.col("kind").isin(*DAMAGE), "damage")
    zone = (F.col("kind") == "zone").cast("int")
    block = Window.partitionBy("stream_id", "_b").orderBy("seq").rowsBetween(START, 0)
    e = before_blocks(in_blocks(events.withColumn("_g", group)), ["stream_id"], _z0=zone)
    e = e.withColumn("_z", F.col("_z0") + F.sum(zone).over(block))
    e = e.withColumn("_a", F.lower("actor")).withColumn("_s", F.lower("skill"))
    known = F.when(F.col("_g").isNotNull() & ~F.coalesce(F.col("estimated"), F.lit(False)), F.col("amount"))
    e = before_blocks(e, ["stream_id", "_g"], _sum=known, _n=known.isNotNull().cast("int"))
    here = Window.partitionBy("stream_id", "_g", "_b").orderBy("seq").rowsBetween(START, BEFORE)
    total, n = F.col("_sum") + F.coalesce(F.sum(known).over(here), F.lit(0)), F.col("_n") + F.count(known).over(here)
    guesses = []
    for scope in (["_z"], []):
        for keys in (["_a", "_s"], ["_a"], ["_s"], []):
            by = [*scope, *keys]
            guesses.append(F.avg(known).over(Window.partitionBy("stream_id", "_g", *by).orderBy("seq").rowsBetween(START, BEFORE)) if by else F.when(n > 0, total / n))
    e = e.withColumn("_guess", F.coalesce(*guesses))
    fill = F.col("amount").isNull() & F.col("_g").isNotNull() & F.col("_guess").isNotNull()
    value = F.greatest(F.lit(1).cast("long"), F.bround("_guess", 0).cast("long"))
    e = e.withColumn("estimated", F.coalesce(F.col("estimated"), F.lit(False)) | fill).withColumn("amount", F.when(fill, value).otherwise(F.col("amount")))
    return e.drop("_g", "_b", "_z0", "_z", "_a", "_s", "_sum", "_n", "_guess")
