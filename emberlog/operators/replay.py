"""Stretches of a log that were read again: re-shown screens within a file, and the tail of the file before at a file's head."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.functions.groups import per_group
from emberlog.functions.tables import settled
from emberlog.operators.frames import ratio, ratios

# How far back an original lies (rows or seconds), what a copy is, which lines must be exact, how a file's head meets the tail before it.
BACK_ROWS, BACK_S = 40, 60.0
LEAST_RUN, LEAST_GAP_S, COPY_S, SQUEEZED_S, NEAR = 6, 2.0, 1.0, 2.0, 0.85
STRICT = re.compile(r"\b(?:slain|loots?|coins?|split)\b")
RESTART_S, HEAD_S, TAIL, LEAST_BACKLOG, SKIPPED, MISSED = 600.0, 2.0, 80, 3, 3, 2
#: Rows of a head that its alignment can reach: each line of the tail once, with the misses before it.
HEAD = (TAIL + 1) * (MISSED + 1) + MISSED + 1


def numbered(lines: DataFrame) -> DataFrame:
    """``(stream_id, i, seq, ts, norm, nums)``: lines in order, as they are compared, with their numbers word by word."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    n = lines.select("stream_id", F.row_number().over(w).cast("long").alias("i"), "seq", "ts", T.compared(F.coalesce("text", F.lit(""))).alias("norm"))
    return n.withColumn("nums", T.numbers_of(F.col("norm")))


def crowded(n: DataFrame) -> DataFrame:
    """``n`` with ``crowd``: whether the row stands among ``LEAST_RUN`` rows of ``COPY_S`` seconds, as every row of a copy does."""
    w = Window.partitionBy("stream_id").orderBy("i")
    first = F.min("ts").over(w.rowsBetween(1 - LEAST_RUN, 0)), F.max("ts").over(w.rowsBetween(1 - LEAST_RUN, 0))
    end = (F.count("*").over(w.rowsBetween(1 - LEAST_RUN, 0)) == LEAST_RUN) & (first[1] - first[0] <= COPY_S)
    return n.withColumn("_end", end.cast("int")).withColumn("crowd", F.max("_end").over(w.rowsBetween(0, LEAST_RUN - 1)) == 1).drop("_end")


def copies(lines: DataFrame) -> DataFrame:
    """``(stream_id, i, seq, ts, norm, k, kts, exact)``: rows that may be copies, with each row that they may be copies of.

    Only crowded rows and their neighbours can show a run's extent, so only they look back. Equal lines meet by key. A line that was read otherwise
    meets the line at the distance of an equal pair of its crowd, and is compared there.
    """
    n = settled(crowded(numbered(lines)))
    w = Window.partitionBy("stream_id").orderBy("i")
    near = n.withColumn("_look", F.col("crowd") | F.coalesce(F.lag("crowd").over(w), F.lit(False)) | F.coalesce(F.lead("crowd").over(w), F.lit(False)))
    near = near.withColumn("_crowd", F.sum((F.col("_look") & ~F.coalesce(F.lag("_look").over(w), F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_look")
    old = n.select("stream_id", F.col("i").alias("k"), F.col("ts").alias("kts"), F.col("norm").alias("knorm"), F.col("nums").alias("knums"))
    reach = (F.col("k") < F.col("i")) & ((F.col("i") - F.col("k") <= BACK_ROWS) | (F.col("ts") - F.col("kts") <= BACK_S))
    equal = near.join(old.withColumnRenamed("knorm", "norm").drop("knums"), ["stream_id", "norm"]).where(reach)
    far = equal.select("stream_id", "_crowd", (F.col("i") - F.col("k")).alias("d")).distinct()
    other = near.join(far, ["stream_id", "_crowd"]).withColumn("k", F.col("i") - F.col("d")).join(old, ["stream_id", "k"]).where(
        (F.col("norm") != F.col("knorm")) & F.col("nums").eqNullSafe(F.col("knums")) & (2 * F.least(F.length("norm"), F.length("knorm")) >= NEAR * (F.length("norm") + F.length("knorm"))))
    other = other.where(ratios(F.col("norm"), F.col("knorm")) >= NEAR)
    cols = ["stream_id", "i", "seq", "ts", "norm", "k", "kts"]
    return equal.select(*cols, F.lit(True).alias("exact")).union(other.select(*cols, F.lit(False).alias("exact")))


def islands(pairs: dict[tuple[int, int], tuple]) -> dict[tuple[int, int], tuple[int, int]]:
    """For each ``(row, distance)`` the first and the last row of its unbroken stretch at that distance."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for d in {d for _, d in pairs}:
        rows = sorted(i for i, e in pairs if e == d)
        starts = [n for n, i in enumerate(rows) if n == 0 or rows[n - 1] != i - 1]
        for a, b in zip(starts, [*starts[1:], len(rows)]):
            out |= {(i, d): (rows[a], rows[b - 1]) for i in rows[a:b]}
    return out


def shown_again(rows: range, d: int, at: dict[int, tuple], pairs: dict[tuple[int, int], tuple[float, bool]]) -> bool:
    """Whether rows are a screen shown again: enough and varied, come at once, of originals that had taken their time, exact where they must be."""
    if len(rows) < LEAST_RUN or len({at[i][2] for i in rows}) < 2:
        return False
    copy, old = [at[i][1] for i in rows], [pairs[i, d][0] for i in rows]
    took = max(copy) - min(copy)
    if took > COPY_S or max(old) - min(old) < took + SQUEEZED_S or copy[0] - old[0] < LEAST_GAP_S:
        return False
    return all(pairs[i, d][1] or not STRICT.search(at[i][2]) for i in rows)


def taken(rows: list[tuple]) -> list[tuple]:
    """The copies among ``rows(i, seq, ts, norm, k, kts, exact)`` of one stretch, as ``(seq, original's i)``.

    Rows with an equal original are looked at in order. Around each, a stretch at one distance reaches less than the distance to both sides, so that
    no row is its own original, and not into copies found before. The longest that is a screen shown again is taken, the nearest of equals.
    """
    at = {i: (seq, ts, norm) for i, seq, ts, norm, *_ in rows}
    pairs = {(i, i - k): (kts, exact) for i, _, _, _, k, kts, exact in rows}
    bounds, done, out = islands(pairs), min(at) - 1, []
    equal: dict[int, list[int]] = {}
    for (i, d), (_, exact) in pairs.items():
        if exact:
            equal.setdefault(i, []).append(d)
    for i in sorted(equal):
        if i > done:
            found = [(range(max(bounds[i, d][0], done + 1, i - d + 1), min(bounds[i, d][1], i + d - 1) + 1), -d) for d in equal[i]]
            rows_, d = max(((r, d) for r, d in found if shown_again(r, -d, at, pairs)), key=lambda x: (len(x[0]), x[1]), default=(range(0), 0))
            if rows_:
                out += [(at[j][0], j + d) for j in rows_]
                done = rows_[-1]
    return out


def replays(lines: DataFrame) -> DataFrame:
    """``(stream_id, seq, original)``: the rows of ``lines(stream_id, seq, ts, text)`` that show an earlier run again, with the row number that each repeats.

    A run of six lines or more, at least two of them different, is a copy if it came within a second while the original took two seconds longer, and begins
    two seconds or more after it, at most 40 rows or 60 seconds back. Lines may differ by misreadings but not in numbers; kills, loot and coins must be equal.
    So what the game says again at its own pace stays. Rows that have no possible original part a stream into the stretches that are decided
    each by itself. Null texts are empty lines; an empty table has none.
    """
    c = settled(copies(lines))
    rows = c.select("stream_id", "i").distinct()
    w = Window.partitionBy("stream_id").orderBy("i")
    part = rows.withColumn("_new", F.coalesce(F.col("i") - F.lag("i").over(w) > 1, F.lit(True)).cast("int"))
    part = part.withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).select("stream_id", "i", "part")
    return per_group(c.join(part, ["stream_id", "i"]).select("stream_id", "part", "i", "seq", "ts", "norm", "k", "kts", "exact"), ["stream_id", "part"], ["i", "k"], taken,
                     "seq long, original long").drop("part")


def repeats(old: tuple[str, list[str]], new: tuple[str, list[str]]) -> bool:
    """Whether a line shows an old one again: equal, or alike with the same numbers; kills, loot and coins but for a misread end mark."""
    if old[0] == new[0]:
        return True
    strict = STRICT.search(new[0]) is not None
    return old[1] == new[1] and (old[0].rstrip("il1") == new[0].rstrip("il1") if strict else True) and ratio(old[0], new[0]) >= NEAR


def lined_up(tail: list[tuple], head: list[tuple]) -> list[int]:
    """The places of ``head(ts, norm, nums)`` in the longest chain of lines that repeat ``tail(norm, nums)`` in order, up to its end; or none.

    A link goes on by at most ``SKIPPED`` lines of the tail, over at most ``MISSED`` lines of the head that all belong to its opening block. A chain
    begins in the first lines of the block, ends at most ``SKIPPED`` - 1 lines before the tail does, and has ``LEAST_BACKLOG`` lines, two of them different.
    """
    inside = [row[0] is not None and row[0] - head[0][0] <= HEAD_S for row in head] if head and head[0][0] is not None else []
    chains: dict[tuple[int, int], tuple[int, ...]] = {}
    ends: list[list[int]] = []
    best: tuple[int, ...] = ()
    for j, (_, *line) in enumerate(head[:len(inside)]):
        before = [i for i in range(max(0, j - MISSED - 1), j) if all(inside[i + 1:j])]
        begins = j <= MISSED and inside[j]
        # only lines of the tail that a chain can go on to are compared; where none goes on, none can later
        live = range(len(tail)) if begins else sorted({q for i in before for p in ends[i] for q in range(p + 1, min(p + SKIPPED + 1, len(tail)))})
        ends.append([])
        for q in live:
            if not repeats(tail[q], tuple(line)):
                continue
            links = [c for i in before for p in range(max(0, q - SKIPPED), q) if (c := chains.get((i, p)))]
            if begins:
                links.append(())
            if links:
                chains[j, q] = chain = (*max(links, key=len), j)
                ends[j].append(q)
                if len(tail) - q <= SKIPPED and len(chain) > len(best) and len({head[i][1] for i in chain}) > 1:
                    best = chain
        if j > MISSED and not any(ends[-MISSED - 1:]):
            break
    return list(best) if len(best) >= LEAST_BACKLOG else []


def ordered_files(lines: DataFrame) -> DataFrame:
    """``(stream_id, file, place, start, stop, before, gap)`` of ``lines(stream_id, file, line, ts, text)``: a stream's files in the order in which they begin.

    Files without a time come last, files that begin together by name. ``before`` is the file before, ``gap`` the seconds between; a negative gap is none.
    """
    f = lines.groupBy("stream_id", "file").agg(F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("line"))).alias("start"), F.max("ts").alias("stop"))
    w = Window.partitionBy("stream_id").orderBy(F.col("start").asc_nulls_last(), "file")
    f = f.withColumn("place", F.row_number().over(w)).withColumn("before", F.lag("file").over(w)).withColumn("_stop", F.lag("stop").over(w))
    return f.withColumn("gap", F.when(F.col("start") >= F.col("_stop"), F.col("start") - F.col("_stop"))).drop("_stop")


def backlog(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``(stream_id, file, line)``: the lines at a file's head that repeat the tail of the file before it, which ended at most ten minutes earlier.

    A pair of files is one group of at most ``TAIL`` and ``HEAD`` lines, however large the files; an alignment cannot reach further.
    """
    w = Window.partitionBy("stream_id", "file")
    n = lines.select("stream_id", "file", "line", "ts", F.coalesce("text", F.lit("")).alias("text"))
    n = n.withColumn("_from", F.row_number().over(w.orderBy("line"))).withColumn("_to", F.row_number().over(w.orderBy(F.col("line").desc())))
    after = files.where((F.col("gap") <= RESTART_S) & F.col("before").isNotNull())
    head = n.where(F.col("_from") <= HEAD).join(after.select("stream_id", "file"), ["stream_id", "file"]).select("stream_id", "file", F.lit(1).alias("side"), "line", "ts", "text")
    tail = n.where(F.col("_to") <= TAIL).withColumnRenamed("file", "before").join(after.select("stream_id", "before", "file"), ["stream_id", "before"]).select("stream_id", "file", F.lit(0).alias("side"), "line", "ts", "text")
    both = head.union(tail).withColumn("norm", T.compared(F.col("text"))).drop("text")

    def rule(rows: list[tuple]) -> list[tuple]:
        new = [r for r in rows if r[0] == 1]
        return [(new[j][1],) for j in lined_up([(r[3], r[4]) for r in rows if r[0] == 0], [(r[2], r[3], r[4]) for r in new])]

    return per_group(both.withColumn("nums", T.numbers_of(F.col("norm"))), ["stream_id", "file"], ["side", "line"], rule, "line long")


def united(lines: DataFrame, reset_s: float = 21600.0) -> DataFrame:
    """All files of a stream as one: ``(stream_id, place, line, ts, text, fresh)``, without what a file's head repeats of the one before.

    ``place`` and ``line`` give the order; ``fresh`` marks files that begin more than ``reset_s`` after the one before, where a party is a new one.
    """
    lines = settled(lines)
    files = settled(ordered_files(lines))
    kept = lines.join(backlog(lines, files), ["stream_id", "file", "line"], "left_anti")
    fresh = F.coalesce(F.col("gap") > reset_s, F.col("before").isNull() | F.col("gap").isNull())
    return kept.join(files.select("stream_id", "file", "place", fresh.alias("fresh")), ["stream_id", "file"]).select("stream_id", "place", "line", "ts", "text", "fresh")


def joined_lines(rows: DataFrame, full: int = 60, most: int = 4, share: float = 0.7) -> DataFrame:
    """Wrapped lines as one: a row without closing punctuation of at least ``share`` of a full line goes on with the next, up to ``most`` parts."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    open_ = ~F.col("text").rlike(r"[.!?)\]\"']\s*$") & (F.length("text") >= share * full)
    starts = F.coalesce(~F.lag(open_).over(w) | F.col("text").rlike(r"^(?:You|Your|--|[A-Z][\w']+'s [A-Z]|Starting|Stopped)\b"), F.lit(True)).cast("int")
    r = rows.withColumn("_s", starts).withColumn("_m", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy("stream_id", "_m").orderBy("seq")
    r = r.withColumn("_q", F.floor((F.row_number().over(part) - 1) / most))
    return r.groupBy("stream_id", "_m", "_q").agg(F.min("seq").alias("seq"), F.min("ts").alias("ts"), F.count("*").alias("parts"),
                                                  F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text")).drop("_m", "_q")
