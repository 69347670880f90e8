"""Frames of a scrolling window to messages: rows are aligned between neighbouring frames, and each message is the reading most frames agree on.

Two neighbouring frames overlap by some shift. Every pair of alike rows votes for one, so the shift is an aggregate over a join of neighbours, and the
running sum of shifts gives each row its place in the whole chat: the readings of one place are the readings of one message. No state
goes from frame to frame but that sum, so a stream's frames are dealt over all tasks for everything else. ``FrameState`` is the same rule frame by
frame, for streams.
"""

from __future__ import annotations

import difflib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from emberlog.functions import text as T
from emberlog.functions.groups import per_group
from emberlog.functions.tables import settled

# When rows are the same, what a vote weighs, what an alignment needs, when a frame is covered.
SAME = 0.8
EXACT, ALIKE, TOP_ROW = 1.0, 0.6, 0.5
LEAST_SCORE, LEAST_SHARE = 1.0, 0.4
PIECE, COVERED, WHOLE_ROW = 0.5, 0.4, 50.0
ENDS = r"[.!?)\]\"'-]\s*$"


def in_blocks(a: str, b: str) -> int:
    """Letters of ``difflib``'s matching blocks of two texts.

    Readings of one message mostly begin or end alike. Where no longer stretch is in both texts, the one that they begin with is the first block, and what they end
    with is one where its letters stand nowhere before; what is left is matched as ``difflib`` goes on, apart.
    """
    total = 0
    while a and b:
        most = min(len(a), len(b))
        n = 0
        while n < most and a[n] == b[n]:
            n += 1
        if n == most:
            return total + n
        if n and not any(a[i:i + n + 1] in b for i in range(len(a) - n)):
            total, a, b = total + n, a[n:], b[n:]
            continue
        n = 0
        while n < most and a[-n - 1] == b[-n - 1]:
            n += 1
        if n and b.find(a[-n:]) == len(b) - n and not any(a[i:i + n] in b for i in range(len(a) - n)):
            total, a, b = total + n, a[:-n], b[:-n]
            continue
        return total + sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return total


def ratio(a: str, b: str) -> float:
    """How alike two compared texts are, by matching blocks."""
    if a == b:
        return 1.0
    return 2.0 * in_blocks(a, b) / (len(a) + len(b)) if a and b else 0.0


@F.pandas_udf(DoubleType())
def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two columns; equal pairs are asked for once a batch."""
    seen: dict = {}
    out = []
    for x, y in zip(a, b):
        if (x, y) not in seen:
            seen[x, y] = ratio(x or "", y or "")
        out.append(seen[x, y])
    return pd.Series(out, dtype="float64")


def near_texts(a: Column, b: Column, least: float, x: Column, y: Column) -> Column:
    """Whether the lengths of two compared texts and their digits ``x`` and ``y`` leave open that they are one message."""
    return (2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))) & T.digits_agree(x, y)


def alike(a: Column, b: Column, least: float = SAME, digits: tuple[Column, Column] | None = None) -> Column:
    """Whether two compared texts are one message: equal, or alike with no two different numbers. Lengths that rule it out are not compared.

    ``digits`` are the texts' ``digits_of``, where they are at hand.
    """
    near = near_texts(a, b, least, *(digits or (T.digits_of(a), T.digits_of(b))))
    return F.when(a == b, F.lit(EXACT)).when(near & (ratios(F.when(near & (a != b), a), F.when(near & (a != b), b)) >= least), F.lit(ALIKE)).otherwise(F.lit(0.0))


def visual_rows(lines: DataFrame) -> DataFrame:
    """``lines(stream_id, frame, t, x, y, h, text)`` of a reader to rows ``(stream_id, frame, t, row, text, norm)``, from the top.

    Lines with less than two letters or digits are specks. A line that overlaps the one above it by half of the lower of the two stands in its row, ordered
    by x. Frames of three rows or more of which two fifths are pieces (no end mark, under half of a row's usual length) are covered by something
    else and go. Null texts are specks; an empty table gives none.
    """
    # looks for two, as taking out all that is neither letter nor digit costs ten times as much
    real = lines.where(F.col("text").rlike(r"(?s)[0-9A-Za-z].*?[0-9A-Za-z]"))
    w = Window.partitionBy("stream_id", "frame").orderBy("y", "x")
    over = F.least(F.lag(F.col("y") + F.col("h")).over(w), F.col("y") + F.col("h")) - F.col("y")
    new = (F.lag("h").over(w).isNull() | (over < 0.5 * F.least(F.lag("h").over(w), F.col("h")))).cast("int")
    r = real.withColumn("_new", new).withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    r = r.groupBy("stream_id", "frame", "row").agg(F.min("t").alias("t"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "y", F.trim("text").alias("text")))), lambda p: p["text"]), " ").alias("text"))
    piece = ~F.col("text").rlike(ENDS) & (F.length(F.trim("text")) < PIECE * WHOLE_ROW)
    all_ = Window.partitionBy("stream_id", "frame")
    r = r.withColumn("_n", F.count("*").over(all_)).withColumn("_p", F.count_if(piece).over(all_)).where((F.col("_n") < 3) | (F.col("_p") < COVERED * F.col("_n")))
    return r.select("stream_id", "frame", "t", "row", "text", T.compared(F.col("text")).alias("norm"))


def shifts(rows: DataFrame) -> DataFrame:
    """``(stream_id, frame, n, shift)``: by how many rows each frame has scrolled since the one before it, and its number of rows.

    ``shift`` is the best supported one from 0 on, the smallest of equals; the first row, which may be clipped, counts half. Without enough
    support for the rows that would overlap the window has jumped: all rows are new. A stream's first frame has shift 0.

    Digits are taken from each row once, and only pairs that lengths and digits leave open are compared. All joins are merges: rows come of lines that were
    multiplied, so the optimizer's guess of their size, on which it would broadcast them, is far too low.
    """
    size = rows.groupBy("stream_id", "frame").agg(F.count("*").alias("n"))
    order = Window.partitionBy("stream_id").orderBy("frame")
    size = size.withColumn("before", F.lag("frame").over(order)).withColumn("m", F.lag("n").over(order))
    marked = rows.select("stream_id", "frame", "row", "norm", T.digits_of(F.col("norm")).alias("digits"))
    now = marked.join(size.hint("merge"), ["stream_id", "frame"]).where("before is not null").select("stream_id", "frame", "n", "m", "before", "row", "norm", "digits")
    then = marked.select("stream_id", F.col("frame").alias("before"), F.col("row").alias("_row"), F.col("norm").alias("_norm"), F.col("digits").alias("_digits"))
    texts, digits = (F.col("_norm"), F.col("norm")), (F.col("_digits"), F.col("digits"))
    pairs = now.join(then.hint("merge"), ["stream_id", "before"]).where(F.col("_row") >= F.col("row")).where((texts[0] == texts[1]) | near_texts(*texts, SAME, *digits))
    pairs = pairs.withColumn("w", alike(*texts, digits=digits)).where("w > 0")
    votes = pairs.groupBy("stream_id", "frame", "n", "m", (F.col("_row") - F.col("row")).alias("shift")).agg(F.sum(F.col("w") * F.when((F.col("row") == 0) & (F.col("n") > 1), TOP_ROW).otherwise(1.0)).alias("score"))
    best = votes.groupBy("stream_id", "frame", "n", "m").agg(F.max(F.struct("score", (-F.col("shift")).alias("back"))).alias("b"))
    overlap = F.least(F.col("n"), F.col("m") + F.col("b.back"))
    fits = best.where(F.col("b.score") >= F.greatest(F.lit(LEAST_SCORE), LEAST_SHARE * overlap)).select("stream_id", "frame", (-F.col("b.back")).alias("shift"))
    s = size.join(fits.hint("merge"), ["stream_id", "frame"], "left")
    return s.select("stream_id", "frame", "n", F.when(F.col("before").isNull(), 0).otherwise(F.coalesce("shift", "m")).alias("shift"))


def places(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, the row's number in the whole chat: the sum of shifts up to its frame, and the row."""
    to_here = Window.partitionBy("stream_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    at = shifts(rows).select("stream_id", "frame", F.sum("shift").over(to_here).alias("_top"))
    return rows.join(at.hint("merge"), ["stream_id", "frame"]).withColumn("place", F.col("_top") + F.col("row")).drop("_top")


def best_reading(votes: list[tuple]) -> tuple[str, float, int]:
    """``(text, first seen, frames)`` of one message from its readings ``(clear, norm, n, t, text)``.

    Of clear readings (all but those in a window's first row) the one that the others resemble most; then the one with most letters and digits,
    most digits, the earliest, the first by text. Unclear ones decide only where no other is.
    """
    clear = [v for v in votes if v[0]] or votes

    def rank(v):
        return (-sum(o[2] * ratio(v[1], o[1]) for o in clear), -len(re.sub(r"[^0-9A-Za-z]", "", v[4])), -len(re.sub(r"\D", "", v[4])), v[3], v[4])

    return min(clear, key=rank)[4], min(v[3] for v in votes), sum(v[2] for v in votes)


def messages(rows: DataFrame, least_frames: int = 2) -> DataFrame:
    """``(stream_id, place, ts, text, frames)``: each message once, in the order of places.

    ``ts`` is the first frame that shows it. A row of fewer than ``least_frames`` frames is no message. Equal readings are counted before
    they are gathered, so a window that stands still is one reading a row.
    """
    rows = settled(rows)
    clear = (F.col("row") > 0).alias("clear")
    text = F.min_by("text", F.struct("t", "text")).alias("text")
    v = places(rows).groupBy("stream_id", "place", clear, "norm").agg(F.count("*").alias("n"), F.min("t").alias("t"), text)
    found = per_group(v, ["stream_id", "place"], ["t", "norm"], lambda g: [best_reading(g)], "text string, ts double, frames long")
    return found.where(F.col("frames") >= least_frames).select("stream_id", "place", "ts", "text", "frames")


@dataclass
class FrameState:
    """A stream's last frame and the readings of the messages that it shows."""

    frame: list[str] = field(default_factory=list)
    top: int = 0
    votes: dict[int, list[list]] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps([self.frame, self.top, list(self.votes.items())])

    @classmethod
    def load(cls, text: str) -> FrameState:
        frame, top, votes = json.loads(text)
        return cls(frame, top, {p: v for p, v in votes})

    def shift(self, norms: list[str]) -> int | None:
        score: Counter = Counter()
        for j, b in enumerate(norms):
            for i, a in enumerate(self.frame[j:], j):
                w = EXACT if a == b else ALIKE if T.same_numbers(a, b) and ratio(a, b) >= SAME else 0.0
                if w:
                    score[i - j] += w * (TOP_ROW if j == 0 and len(norms) > 1 else 1.0)
        if not score:
            return None
        best = min(score, key=lambda s: (-score[s], s))
        overlap = min(len(norms), len(self.frame) - best)
        return best if score[best] >= max(LEAST_SCORE, LEAST_SHARE * overlap) else None

    def see(self, t: float, rows: list[tuple[str, str]]) -> Iterator[tuple[int, str, float, int]]:
        """Messages that leave the window with this frame of ``(text, norm)`` rows."""
        norms = [n for _, n in rows]
        if self.frame:
            moved = self.shift(norms)
            self.top += len(self.frame) if moved is None else moved
        yield from self.leave(self.top)
        for row, (text, norm) in enumerate(rows):
            held = self.votes.setdefault(self.top + row, [])
            same = next((v for v in held if v[0] == (row > 0) and v[1] == norm), None)
            if same:
                same[2] += 1
            else:
                held.append([row > 0, norm, 1, t, text])
        self.frame = norms

    def leave(self, before: int | None = None) -> Iterator[tuple[int, str, float, int]]:
        for place in sorted(p for p in self.votes if before is None or p < before):
            yield (place, *best_reading([tuple(v) for v in sorted(self.votes.pop(place), key=lambda v: (v[3], v[1]))]))
