"""Party roster: operations read from lines, membership by epochs between clears."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Evidence lines.
EVIDENCE = [
    (r"^(?:You have been (?:removed|kicked) from|You (?:have left|leave)|Your) (?:the |your )?party(?: has been disbanded)?\W*$", "clear"),
    (r"^You have joined (?:the party|(?<name>[A-Z][\w']*)'s party)\W*$", "clear"),
    (r"^(?<name>[A-Z][\w']*) has (?:left|been removed from|been kicked from) (?:the|your) party\W*$", "remove"),
    (r"^You (?:have )?invited? (?<name>[A-Z][\w']*) to (?:join )?your party\W*$", "invite"),
    (r"^(?<name>[A-Z][\w']*) has joined (?:the|your) party\W*$", "add"),
    (r"^(?<name>[A-Z][\w']*) is now the leader of (?:the|your) party\W*$", "add"),
    (r"^Your party member (?<name>[A-Z][\w']*) has\b.*$", "add"),
]


def evidence(events: DataFrame) -> DataFrame:
    """``(stream_id, seq, ts, op, name)`` of lines that say who is in the party."""
    op, name = None, None
    for pattern, what in EVIDENCE:
        hit = F.col("text").rlike(pattern)
        got = F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")) if "(?<name>" in pattern else F.lit(None).cast("string")
        op = F.when(hit, what) if op is None else op.when(hit, what)
        name = F.when(hit, got) if name is None else name.when(hit, got)
    return events.select("stream_id", "seq", "ts", op.alias("op"), name.alias("name")).where("op is not null")


def membership(ops: DataFrame, invite_s: float = 30.0) -> DataFrame:
    """Final members: ``(stream_id, name)`` whose last operation after the last clear is an add.

    An invite is an add when its name joins within ``invite_s`` seconds.
    """
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    o = ops.withColumn("epoch", F.sum((F.col("op") == "clear").cast("int")).over(w))
    last = Window.partitionBy("stream_id")
    o = o.withColumn("_top", F.max("epoch").over(last)).where((F.col("epoch") == F.col("_top")) & F.col("name").isNotNull())
    by = Window.partitionBy("stream_id", "name").orderBy("seq")
    joins = F.lead(F.struct("op", "ts")).over(by)
    o = o.withColumn("_next", joins).withColumn("op", F.when((F.col("op") == "invite") & ~F.coalesce((F.col("_next.op") == "add") & (F.col("_next.ts") - F.col("ts") <= invite_s), F.lit(False)), None)
                                                .when(F.col("op") == "clear", "add").otherwise(F.col("op"))).where("op is not null")
    return o.groupBy("stream_id", "name").agg(F.max_by("op", "seq").alias("op")).where("op <> 'remove'").select("stream_id", "name")


def with_overrides(members: DataFrame, manual: DataFrame) -> DataFrame:
    """``manual(name, in_group)`` wins over evidence, and out over in."""
    m = manual.groupBy("name").agg(F.min("in_group").alias("in_group"))
    streams = members.select("stream_id").distinct()
    added = streams.join(m.where("in_group")).select("stream_id", "name")
    return members.union(added).distinct().join(m.where("not in_group"), "name", "left_anti").select("stream_id", "name")
