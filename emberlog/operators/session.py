"""Session tables: independent filtered aggregates over a stream's events, rolling rates, kills and deaths by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.functions.groups import spaced


def counters(events: DataFrame) -> DataFrame:
    """One row for each stream: totals of loot, coin, kills, control, harvest, crafts and experience."""
    k = F.col("kind")
    return events.groupBy("stream_id").agg(
        F.count("*").alias("events"), F.count_if(k == "loot").alias("items"), F.coalesce(F.sum(F.when(k == "coin", F.col("copper"))), F.lit(0)).alias("coin_total"),
        F.count_if(k == "kill").alias("kills"), F.count_if(k == "cc").alias("cc"), F.count_if((k == "harvest") & (F.col("actor") == "You")).alias("harvests"),
        F.coalesce(F.sum(F.when(k == "craft", F.coalesce("amount", F.lit(1)))), F.lit(0)).alias("crafts"), F.count_if(k == "experience").alias("xp_ticks"), F.count_if(k == "zone").alias("zones"))


def ranked(events: DataFrame, kind: str, name: str) -> DataFrame:
    """Counts of one kind by a name column, most first and then by name: ``(stream_id, name, n, rank)``."""
    g = events.where((F.col("kind") == kind) & F.col(name).isNotNull()).groupBy("stream_id", F.col(name).alias("name")).agg(F.count("*").alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("stream_id").orderBy(F.col("n").desc(), "name")))


def rolling_rates(events: DataFrame, window_s: int = 3600, least_s: int = 60) -> DataFrame:
    """Each row's trailing hour, open at its start: rows and amounts, scaled to an hour by what was observed of it."""
    us = (F.col("ts") * 1_000_000).cast("long")
    w = Window.partitionBy("stream_id").orderBy("_us").rangeBetween(-window_s * 1_000_000 + 1, 0)
    first = F.min("_us").over(Window.partitionBy("stream_id"))
    e = events.withColumn("_us", us).withColumn("n", F.count("*").over(w)).withColumn("total", F.coalesce(F.sum("amount").over(w), F.lit(0)))
    seen = F.greatest(F.lit(float(least_s)), F.least(F.lit(float(window_s)), (F.col("_us") - first) / 1_000_000))
    return e.select("stream_id", "seq", "n", "total", F.round(F.col("total") * 3600.0 / seen, 2).alias("per_hour"))


def classify_kills(events: DataFrame, party: DataFrame, owners: DataFrame, you: str = "You", gap_s: float = 60.0) -> DataFrame:
    """Kill rows with ``verdict``: kill, outsider_kill, death, outsider_death, or null where nothing is counted.

    ``party(name)`` is the final roster with the viewer, ``owners(pet, owner)`` the pets. Rules in order: a pet's death counts nothing; a kill
    by the viewer, or announced to the party (a pet's only for an owner in it and a victim outside), is a kill; the
    viewer's end is a death; an NPC's is a kill by side of its killer; by an NPC it is a death; a member's is a
    death unless a member who is no pet did it; a member's work is a kill; else a death where only the victim is a player.
    Deaths of a victim within ``gap_s`` of the last counted are repeats.
    """
    p = party.select("name").distinct()
    k = events.where("kind = 'kill' and target is not null")
    k = k.join(p.withColumnsRenamed({"name": "_pa"}), F.col("actor") == F.col("_pa"), "left").join(p.withColumnsRenamed({"name": "_pt"}), F.col("target") == F.col("_pt"), "left")
    o = owners.select(F.col("pet").alias("_op"), F.col("owner").alias("_ow"))
    k = k.join(o, F.col("actor") == F.col("_op"), "left").join(owners.select(F.col("pet").alias("_vp")), F.col("target") == F.col("_vp"), "left")
    k = k.join(p.withColumnsRenamed({"name": "_po"}), F.col("_ow") == F.col("_po"), "left")
    in_a, in_t, pet = F.col("_pa").isNotNull(), F.col("_pt").isNotNull(), F.col("_op").isNotNull()
    helper = in_a | F.col("_po").isNotNull()
    told = F.coalesce(F.col("text").startswith("Your party member") & F.col("text").contains("has slain"), F.lit(False))
    verdict = (F.when(F.col("_vp").isNotNull(), None)
               .when((told | (F.col("actor") == you)) & (~pet | (F.col("_po").isNotNull() & ~in_t)), "kill")
               .when(F.col("target") == you, "death")
               .when(T.is_npc(F.col("target")), F.when(helper, "kill").otherwise("outsider_kill"))
               .when(T.is_npc(F.col("actor")), F.when(in_t, "death").otherwise("outsider_death"))
               .when(in_t, F.when(in_a & ~pet, None).otherwise("death"))
               .when(helper, "kill").otherwise("outsider_death"))
    k = k.withColumn("verdict", verdict)
    died = F.coalesce(F.col("verdict").endswith("death"), F.lit(False))
    kept = spaced(k.where(died).select("stream_id", "target", "ts"), ["stream_id", "target"], gap_s).select(F.col("stream_id").alias("_ks"), F.col("target").alias("_kt"), F.col("ts").alias("_kts"))
    k = k.join(kept, died & F.col("stream_id").eqNullSafe(F.col("_ks")) & (F.col("target") == F.col("_kt")) & (F.col("ts") == F.col("_kts")), "left")
    return k.select("stream_id", "seq", "ts", "actor", "target", F.when(~died | F.col("_kts").isNotNull(), F.col("verdict")).alias("verdict"))


def coin_received(events: DataFrame, within_s: float = 5.0) -> DataFrame:
    """The viewer's share of each coin line: its own split, else a split line's that follows within ``within_s`` before the next coin, else all if the viewer looted."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    e = events.where(F.col("kind").isin("coin", "coin_split"))
    nxt = F.lead(F.struct("kind", "ts", "split_copper")).over(w)
    e = e.withColumn("_n", nxt).where("kind = 'coin'")
    follow = F.when((F.col("_n.kind") == "coin_split") & (F.col("_n.ts") - F.col("ts") <= within_s) & (F.col("_n.split_copper") <= F.col("copper")), F.col("_n.split_copper"))
    return e.select("stream_id", "seq", "actor", "copper", F.coalesce("split_copper", follow, F.when(F.col("actor") == "You", F.col("copper")), F.lit(0)).alias("received"))


def only_members(table: DataFrame, party: DataFrame, name: str = "actor") -> DataFrame:
    """Rows of current members: the group projection."""
    return table.join(party.select(F.col("name").alias(name)).distinct(), name, "left_semi")


def segments(events: DataFrame, break_s: float) -> DataFrame:
    """Log files: a new segment after more than ``break_s`` seconds of silence."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(w) > break_s, F.lit(False)).cast("int")
    return events.withColumn("_new", new).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def with_percent(value: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(100.0 * value, total), F.lit(0.0)), 2)
