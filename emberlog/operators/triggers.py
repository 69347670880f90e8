"""Pattern triggers, cooldowns, swings and telemetry as batch twins of the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.functions.groups import spaced

#: Rules a table may hold: it is broadcast, so its size is checked.
MOST_RULES = 10_000
#: Letters of a pattern and of a line above which they do not match.
MOST_PATTERN, MOST_LINE = 2048, 8192


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def matches(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """``(stream_id, seq, ts, rule_id)`` of lines that a rule ``(rule_id, mode, pattern, fuzzy)`` matches.

    Modes contains, starts and exact compare folded words; fuzzy allows each word its spelling limit; regex is as written.
    Patterns above 2,048 letters and lines above 8,192 do not match. The rules are few, so they are sent to every task after their number is checked.
    """
    n = rules.limit(MOST_RULES + 1).count()
    if n > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    r = F.broadcast(rules.where(F.length("pattern") <= MOST_PATTERN).select("rule_id", "mode", "fuzzy", "pattern", folded(F.col("pattern")).alias("_p")))
    t = lines.where(F.length("text") <= MOST_LINE).select("stream_id", "seq", "ts", "text", folded(F.col("text")).alias("_t"))
    padded, needle = F.concat(F.lit(" "), "_t", F.lit(" ")), F.concat(F.lit(" "), "_p", F.lit(" "))
    words, want = F.split("_t", " "), F.split("_p", " ")
    alike = F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - F.size(want), F.lit(0))), lambda i: F.forall(
        F.zip_with(F.slice(words, i + 1, F.size(want)), want, lambda a, b: F.coalesce(F.levenshtein(a, b) <= T.word_limit(F.length(b)), F.lit(False))), lambda x: x))
    hit = (F.when(F.col("mode") == "regex", F.regexp_like("text", F.col("pattern")))
           .when(F.col("mode") == "exact", F.col("_t") == F.col("_p"))
           .when(F.col("mode") == "starts", F.concat("_t", F.lit(" ")).startswith(F.concat("_p", F.lit(" "))))
           .otherwise(F.contains(padded, needle) | (F.col("fuzzy") & alike)))
    return t.join(r, (F.col("_p") != "") & hit).select("stream_id", "seq", "ts", "rule_id")


def cooldown(hits: DataFrame, cooldown_s: float) -> DataFrame:
    """Hits that fire: those more than ``cooldown_s`` after the rule's last fired one."""
    return spaced(hits.select("stream_id", "rule_id", "ts"), ["stream_id", "rule_id"], cooldown_s)


def quiet_alerts(sightings: DataFrame, keys: list[str], quiet_s: float) -> DataFrame:
    """Sightings after ``quiet_s`` or more without one: here the previous row counts, alerted or not."""
    w = Window.partitionBy(*keys).orderBy("seq")
    last = F.lag("ts").over(w)
    return sightings.withColumn("_l", last).where(F.col("_l").isNull() | (F.col("ts") - F.col("_l") >= quiet_s)).drop("_l")


def first_attacks(events: DataFrame, you: str = "You") -> DataFrame:
    """The first attack on the viewer by each player of a stream."""
    w = Window.partitionBy("stream_id", "actor").orderBy("seq")
    a = events.where(F.col("kind").isin("melee_hit", "melee_miss", "ability_hit") & (F.col("target") == you) & ~T.is_npc(F.col("actor")) & (F.col("actor") != you))
    return a.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("stream_id", "seq", "ts", "actor")


def low_episodes(readings: DataFrame, share: float = 0.1, gap_s: float = 2.0) -> DataFrame:
    """Health episodes: two low readings or more in a row without a gap above ``gap_s``: ``(stream_id, start, end, readings)``."""
    w = Window.partitionBy("stream_id").orderBy("seq")
    r = readings.withColumn("low", F.col("hp") <= share * F.col("hp_max"))
    cut = F.coalesce(~F.lag("low").over(w) | (F.col("ts") - F.lag("ts").over(w) > gap_s), F.lit(True)).cast("int")
    r = r.withColumn("_cut", cut).withColumn("_isle", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.where("low").groupBy("stream_id", "_isle").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("readings")).where("readings >= 2").drop("_isle")


def experience_rate(points: DataFrame, window_s: float = 3600.0, stale_s: float = 60.0) -> DataFrame:
    """Experience an hour at each stream's end: intervals ``(stream_id, start, end, points, now)`` weighted by their part of the last hour; null when stale."""
    part = F.greatest(F.lit(0.0), F.least("end", "now") - F.greatest(F.col("start"), F.col("now") - window_s))
    length = F.col("end") - F.col("start")
    g = points.where(length > 0).groupBy("stream_id").agg(F.sum(F.col("points") * part / length).alias("_p"), F.sum(part).alias("_s"), F.max("end").alias("_e"), F.max("now").alias("_now"))
    return g.select("stream_id", F.when((F.col("_now") - F.col("_e") <= stale_s) & (F.col("_s") > 0), F.round(F.col("_p") / F.col("_s") * 3600, 4)).alias("per_hour"))


def swing_delay(swings: DataFrame, keys: list[str], low: float = 0.5, high: float = 8.0) -> DataFrame:
    """A weapon's delay from swing times: gaps within bounds, each divided by how many low-quantile gaps it holds, their median."""
    w = Window.partitionBy(*keys).orderBy("seq")
    g = swings.withColumn("_g", F.col("ts") - F.lag("ts").over(w)).where(F.col("_g").between(low, high))
    g = g.groupBy(*keys).agg(F.sort_array(F.collect_list("_g")).alias("_gs")).where("size(_gs) >= 2")
    base = F.element_at("_gs", F.least(F.size("_gs"), F.floor(F.size("_gs") * 0.3).cast("int") + 1))
    refined = F.array_sort(F.transform("_gs", lambda x: x / F.greatest(F.lit(1.0), F.bround(x / F.col("_b"), 0))))
    g = g.withColumn("_b", base).withColumn("_r", refined).withColumn("_n", F.size("_r"))
    mid = F.when(F.col("_n") % 2 == 1, F.element_at("_r", F.expr("_n div 2 + 1").cast("int"))).otherwise((F.element_at("_r", F.expr("_n div 2").cast("int")) + F.element_at("_r", F.expr("_n div 2 + 1").cast("int"))) / 2)
    return g.select(*keys, F.col("_n").cast("long").alias("gaps"), F.round(mid, 2).alias("delay"))


def timer_board(timers: DataFrame, now: float, linger_s: float = 3.0, most: int = 24) -> DataFrame:
    """Timers ``(label, started, duration)`` to show: the running by time left, then the ended for ``linger_s``; the soonest ``most``."""
    t = timers.withColumn("remaining", F.greatest(F.lit(0.0), F.col("started") + F.col("duration") - now)).withColumn("ended", F.col("started") + F.col("duration") <= now)
    return t.where(~F.col("ended") | (now - F.col("started") - F.col("duration") <= linger_s)).orderBy("ended", "remaining", "label").limit(most)


def filled(template: Column, groups: dict[str, Column]) -> Column:
    """A template with its ``{name}`` places filled; unknown names stay."""
    for k, v in groups.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return template
