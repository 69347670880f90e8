"""Streaming operators. Late rows are accepted for ``LATE``; state is per stream and ends by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.config import ACTIVITY, DAMAGE
from emberlog.operators.frames import FrameState
from emberlog.operators.parse import parse

#: How far a row may lie behind the newest one of its stream.
LATE = "120 seconds"


def message_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``(stream_id, seq, ts, text)`` as files arrive in a folder."""
    return spark.readStream.schema("stream_id string, seq long, ts double, text string").json(path)


def parsed(lines: DataFrame, player: str = "You") -> DataFrame:
    """Typed events with their event time as ``time`` and its watermark; stateless."""
    return parse(lines, player).withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", LATE)


def rolling_totals(events: DataFrame, window: str = "1 hour", step: str = "5 minutes") -> DataFrame:
    """``(stream_id, kind, start, n, total)`` of sliding windows; a window is final when the watermark has passed it."""
    g = events.groupBy("stream_id", "kind", F.window("time", window, step).alias("w")).agg(F.count("*").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).alias("total"))
    return g.select("stream_id", "kind", F.col("w.start").alias("start"), "n", "total")


def npc(name: str | None) -> bool:
    return name is not None and name.startswith(("a ", "an ", "the "))


class Fight:
    """The open encounter of a stream; rows come in arrival order."""

    FIELDS = "epoch long, enc long, open boolean, newest double, start double, end double, n long, damage long"

    def __init__(self, state: tuple | None, timeout_s: float):
        self.epoch, self.enc, self.open, self.newest, self.start, self.end, self.n, self.damage = state or (0, 0, False, float("-inf"), 0.0, 0.0, 0, 0)
        self.timeout_s, self.done = timeout_s, []

    def state(self) -> tuple:
        return self.epoch, self.enc, self.open, self.newest, self.start, self.end, self.n, self.damage

    def close(self) -> None:
        if self.open and self.n:
            self.done.append((self.epoch, self.enc, self.start, self.end, self.n, self.damage))
        self.open = False

    def row(self, ts: float, kind: str, actor: str | None, target: str | None, amount) -> None:
        if kind == "zone":
            self.close()
            self.epoch, self.enc, self.newest = self.epoch + 1, 0, float("-inf")
            return
        if ts - self.newest > self.timeout_s:
            self.close()
        if kind not in ACTIVITY or (npc(actor) and npc(target)):
            return
        if not self.open:
            self.enc, self.open, self.start, self.end, self.n, self.damage = self.enc + 1, True, ts, ts, 0, 0
        self.newest, self.start, self.end = max(self.newest, ts), min(self.start, ts), max(self.end, ts)
        if kind in DAMAGE:
            self.n, self.damage = self.n + 1, self.damage + (0 if amount is None or amount != amount else int(amount))


def closed_encounters(events: DataFrame, timeout_s: float = 12.0) -> DataFrame:
    """``(stream_id, zone_epoch, enc, start, end, n_damage, damage)`` as encounters with damage end.

    The rules are those of the batch form. A later row, a zone line, or the watermark ends an encounter. State is a few
    numbers for each stream.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = Fight(state.get if state.exists else None, timeout_s)
        if state.hasTimedOut:
            f.close()
        else:
            b = pd.concat(list(batches)).sort_values("seq")
            for row in b[["ts", "kind", "actor", "target", "amount"]].itertuples(index=False, name=None):
                f.row(*row)
        state.update(f.state())
        if f.open:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((f.newest + timeout_s) * 1000) + 1))
        out = pd.DataFrame(f.done, columns=["zone_epoch", "enc", "start", "end", "n_damage", "damage"])
        out.insert(0, "stream_id", key[0])
        yield out

    rows = events.select("stream_id", "seq", "ts", "kind", "actor", "target", "amount", "time")
    return rows.groupBy("stream_id").applyInPandasWithState(
        run, "stream_id string, zone_epoch long, enc long, start double, end double, n_damage long, damage long", Fight.FIELDS, "append", GroupStateTimeout.EventTimeTimeout)


def cooldown(hits: DataFrame, cooldown_s: float) -> DataFrame:
    """Hits ``(stream_id, rule_id, ts, time)`` that fire: those more than ``cooldown_s`` after the rule's last fired one."""
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        fired = []
        for ts in sorted(t for b in batches for t in b["ts"]):
            if ts - last > cooldown_s:
                fired.append(ts)
                last = ts
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int((last + cooldown_s) * 1000) + 1))
        yield pd.DataFrame({"stream_id": key[0], "rule_id": key[1], "ts": pd.Series(fired, dtype="float64")})

    return hits.select("stream_id", "rule_id", "ts", "time").groupBy("stream_id", "rule_id").applyInPandasWithState(
        run, "stream_id string, rule_id long, ts double", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def seen_messages(rows: DataFrame, least_frames: int = 2) -> DataFrame:
    """``(stream_id, place, ts, text, frames)`` of visual rows ``(stream_id, frame, t, row, text, norm)``, as messages leave the window.

    The rules are those of ``frames.messages``; frames of a stream arrive in order. The state is the last frame and the readings of what it shows.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = FrameState.load(state.get[0]) if state.exists else FrameState()
        shown: dict[int, tuple[float, list]] = {}
        for b in batches:
            for frame, t, row, text, norm in b[["frame", "t", "row", "text", "norm"]].itertuples(index=False, name=None):
                shown.setdefault(frame, (t, []))[1].append((row, text, norm))
        done = [m for f in sorted(shown) for m in s.see(shown[f][0], [x[1:] for x in sorted(shown[f][1])])]
        state.update((s.dump(),))
        out = pd.DataFrame([(key[0], p, t, x, n) for p, x, t, n in done if n >= least_frames], columns=["stream_id", "place", "ts", "text", "frames"])
        yield out

    return rows.groupBy("stream_id").applyInPandasWithState(run, "stream_id string, place long, ts double, text string, frames long", "state string", "append", GroupStateTimeout.NoTimeout)


def first_fragments(fragments: DataFrame, within: str = "6 hours") -> DataFrame:
    """Chat fragments ``(sender, code, time)`` without those seen within ``within``."""
    return fragments.withWatermark("time", within).dropDuplicatesWithinWatermark(["sender", "code"])


def level_ups(readings: DataFrame, events: DataFrame, reach_s: int = 8) -> DataFrame:
    """Experience readings that wrapped, beside the level-up line within ``reach_s`` seconds: a join of two streams by time."""
    r = readings.withWatermark("time", LATE).select(F.col("stream_id").alias("_s"), F.col("time").alias("_t"), "xp_fraction")
    e = events.where("kind = 'level_up'").select("stream_id", "seq", "amount", "time")
    near = F.expr(f"_s = stream_id and time between _t - interval {reach_s} seconds and _t + interval {reach_s} seconds")
    return e.join(r, near).select("stream_id", "seq", F.col("amount").alias("level"), "xp_fraction")
