"""Queries over lines as they are read: run together, shown again, split over files, seen in frames. Lines are written from the events table.

What must come back is what was put in, so the SQL states the input and never repeats an operator's rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions.tables import spread
from emberlog.operators import completion, frames, fused, replay
from emberlog.operators.parse import parse
from emberlog.plans.queries import EV, activity, query

CREATURE = "['a rat', 'a wolf', 'a bat'][CAST(seq % 3 AS INT) + 1]"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its creature, and its number in the stream from 0."""
    creature = F.element_at(F.array(F.lit("a rat"), F.lit("a wolf"), F.lit("a bat")), (F.pmod("seq", F.lit(3)) + 1).cast("int"))
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) - 1
    return activity(spark, sf_dir).select("stream_id", "seq", "actor", creature.alias("creature"), "amount", n.cast("long").alias("n"))


#: The same in SQL.
HITS = EV + f", hits AS (SELECT stream_id, seq, actor, {CREATURE} AS creature, amount, row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS n FROM ev)"
#: One message with a number of its own.
LINE = "actor || ' crushes ' || creature || ' for ' || (seq + 1000) || ' points of damage.'"

#: What a line holds in turn: its text, and the (kind, actor, target, amount) of its messages.
FUSED = [
    ("{a}'s Amber Lance hits {t} for {n} points of Ho {t} hits {a} for {m} points of damage.", [("ability_hit", "{a}", "{t}", "{n}"), ("melee_hit", "{t}", "{a}", "{m}")]),
    ("{a}'s Amber Lance burns {t} for {n} points of Fire Damage. {t} has been slain by {a}! You gain party experience!",
     [("ability_hit", "{a}", "{t}", "{n}"), ("kill", "{a}", "{t}", None), ("experience", None, None, None)]),
    ("{a} says, \"{t} hits {a} for {n} points of damage. You gain experience!\"", [("chat", "{a}", None, None)]),
    ("Unknown riddle: attack target You crush {t} for {n} points of damage.", [("unknown", None, None, None), ("melee_hit", "You", "{t}", "{n}")]),
    ("{t} scowls at you, ready to attack -- They look weak. You try to kick {t}, but miss!", [("consider", None, "{t}", None), ("melee_miss", "You", "{t}", None)]),
    ("{a}'s Soft Rain heals {t} for {n} Health.", [("heal", "{a}", "{t}", "{n}")]),
    ("Your faction standing with the Millers got worse. {a} loots {n} silver coins from {t}'s corpse.", [("personal", None, "the Millers", None), ("coin", "{a}", "{t}", "{n}00")]),
]


def _fill(x: str | None) -> str:
    if x is None:
        return "NULL"
    out = "'" + x.replace("'", "''") + "'"
    for mark, value in (("{a}", "actor"), ("{t}", "creature"), ("{n}", "CAST(amount AS VARCHAR)"), ("{m}", "CAST(amount + 1 AS VARCHAR)")):
        out = f"replace({out}, '{mark}', {value})"
    return out


@query("WITH " + HITS + " " + " UNION ALL ".join(
    f"SELECT stream_id, seq, CAST({p} AS BIGINT) AS part, '{kind}' AS kind, {_fill(actor)} AS actor, {_fill(target)} AS target, CAST({_fill(amount)} AS BIGINT) AS amount FROM hits WHERE seq % {len(FUSED)} = {i}"
    for i, (_, parts) in enumerate(FUSED) for p, (kind, actor, target, amount) in enumerate(parts)))
def fused_lines(spark, sf_dir):
    """Two and three messages run together, one cut off before the next, chat that quotes messages, an unread head, and whole lines."""
    line = F.get(F.array(*[F.lit(text) for text, _ in FUSED]), (F.col("seq") % len(FUSED)).cast("int"))
    for mark, value in (("{a}", F.col("actor")), ("{t}", F.col("creature")), ("{n}", F.col("amount").cast("string")), ("{m}", (F.col("amount") + 1).cast("string"))):
        line = F.replace(line, F.lit(mark), value)
    return fused.parse_fused(hits(spark, sf_dir).select("stream_id", "seq", F.lit(0.0).alias("ts"), line.alias("text"))).select("stream_id", "seq", "part", "kind", "actor", "target", "amount")


def numbered_line():
    return F.concat("actor", F.lit(" crushes "), "creature", F.lit(" for "), (F.col("seq") + 1000).cast("string"), F.lit(" points of damage."))


@query("WITH " + HITS + """, whole AS (SELECT stream_id, n // 50 AS block, max(seq) FILTER (WHERE n % 50 = 25) AS at FROM hits GROUP BY ALL)
SELECT h.stream_id, w.at * 100 + h.n % 50 AS seq, h.n + 1 + 10 * (h.n // 50) AS original FROM hits h JOIN whole w ON w.stream_id = h.stream_id AND w.block = h.n // 50
WHERE h.n % 50 BETWEEN 10 AND 19 AND w.block % 2 = 0 AND w.at IS NOT NULL""")
def find_replays(spark, sf_dir):
    """Of every 50 lines ten are shown again 6 lines later: in even blocks at once, with every third line misread, in odd ones at the game's own pace, which stays."""
    h = hits(spark, sf_dir).withColumn("block", F.floor(F.col("n") / 50).cast("long"))
    at = h.where("n % 50 = 25").select("stream_id", "block", F.col("seq").alias("_at"), F.col("n").alias("_n"))
    shown = h.where("n % 50 between 10 and 19").join(at, ["stream_id", "block"])
    j = F.col("n") % 50
    misread = F.when((F.col("block") % 2 == 0) & (j % 3 == 1), F.replace(numbered_line(), F.lit("points"), F.lit("poimts"))).otherwise(numbered_line())
    copies = shown.select("stream_id", (F.col("_at") * 100 + j).alias("seq"), (F.col("_n") * 30.0 + F.when(F.col("block") % 2 == 0, j * 0.05).otherwise((j - 9) * 1.5)).alias("ts"), misread.alias("text"))
    own = h.select("stream_id", (F.col("seq") * 100).alias("seq"), (F.col("n") * 30.0).alias("ts"), numbered_line().alias("text"))
    return replay.replays(own.union(copies))


#: Lines of a file, and how many of the last file's lines open the next.
FILE, SHOWN = 200, 12


@query("WITH " + HITS + f""", f AS (SELECT *, n // {FILE} AS file, n % {FILE} AS line FROM hits),
shown AS (SELECT stream_id, file + 1 AS file, line - {FILE - SHOWN} AS line, seq, actor, creature, true AS again FROM f WHERE line >= {FILE - SHOWN}),
rows_ AS (SELECT stream_id, file, line + {SHOWN} AS line, seq, actor, creature, false AS again FROM f UNION ALL
  SELECT s.stream_id, s.file, s.line, s.seq, s.actor, s.creature, true FROM shown s WHERE EXISTS (SELECT 1 FROM f WHERE f.stream_id = s.stream_id AND f.file = s.file) AND s.file % 3 <> 0)
SELECT stream_id, CAST(file + 1 AS BIGINT) AS place, line, CASE WHEN again AND line % 5 = 2 THEN replace({LINE}, 'points', 'poimts') ELSE {LINE} END AS text, file % 8 = 0 AS fresh
FROM rows_ WHERE NOT again OR file % 4 = 0""")
def file_union(spark, sf_dir):
    """Files of 200 lines, two of three opening with the last twelve lines of the one before, some misread. They go, but where a file begins more than ten minutes later."""
    h = hits(spark, sf_dir).select("*", F.floor(F.col("n") / FILE).cast("long").alias("file"), (F.col("n") % FILE).alias("line"))
    # every fourth file begins 1,000 seconds after the one before, every eighth 30,000
    pause = lambda f: F.floor(f / 4) * 1000.0 + F.floor(f / 8) * 29000.0
    ts = lambda n, f: n * 2.0 + pause(f)
    own = h.select("stream_id", "file", (F.col("line") + SHOWN).alias("line"), ts(F.col("n"), F.col("file")).alias("ts"), numbered_line().alias("text"))
    first = h.where("line = 0 and file % 3 <> 0").select("stream_id", "file", F.col("n").alias("_n"))
    again = h.where(F.col("line") >= FILE - SHOWN).withColumn("file", F.col("file") + 1).join(first, ["stream_id", "file"])
    at = F.col("line") - (FILE - SHOWN)
    text = F.when(at % 5 == 2, F.replace(numbered_line(), F.lit("points"), F.lit("poimts"))).otherwise(numbered_line())
    again = again.select("stream_id", "file", at.alias("line"), ts(F.col("_n"), F.col("file")).alias("ts"), text.alias("text"))
    return replay.united(own.union(again)).select("stream_id", F.col("place").cast("long").alias("place"), "line", "text", "fresh")


#: Rows of a window; frame f begins at row f + f // 3, so that it scrolls by one row and every third time by two.
WINDOW = 8


def seen_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a reader over frames that scroll through each stream's messages. Every fifth reading above the last row is misread, the first row is cut, and some rows are in two parts."""
    h = hits(spark, sf_dir).withColumn("text", numbered_line())
    last = Window.partitionBy("stream_id")
    h = h.withColumn("_last", F.max("n").over(last))
    # frames that show message n: those whose first row lies in n - WINDOW + 1 to n, up to the first frame that shows the last message
    low, high = F.greatest(F.lit(0), F.floor((F.col("n") - WINDOW) * 3 / 4) - 2), F.floor(F.col("n") * 3 / 4) + 3
    h = h.withColumn("frame", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    top = lambda f: f + F.floor(f / 3)
    h = h.withColumn("row", F.col("n") - top(F.col("frame"))).where((F.col("row") >= 0) & (F.col("row") < WINDOW))
    # the frame before must not have reached the end
    h = h.where((F.col("frame") == 0) | (top(F.col("frame") - 1) + WINDOW - 1 < F.col("_last")))
    misread = ((F.col("frame") + F.col("n")) % 5 == 0) & (F.col("row") < WINDOW - 1)
    text = F.when(misread, F.replace("text", F.lit("damage"), F.lit("damaqe"))).otherwise(F.col("text"))
    text = F.when(F.col("row") == 0, F.expr("substring(text, 1, length(text) - 6)")).otherwise(text)
    two = (F.col("n") % 4 == 1) & (F.col("row") > 0)
    name = F.substring_index(text, " ", 1)
    parts = F.when(two, F.array(F.struct(F.lit(10).alias("x"), name.alias("text")), F.struct(F.lit(90).alias("x"), F.expr("substring(text, instr(text, ' ') + 1)").alias("text")))).otherwise(
        F.array(F.struct(F.lit(10).alias("x"), F.col("text").alias("text"))))
    h = h.withColumn("text", text).withColumn("p", F.explode(parts))
    return h.select("stream_id", "frame", (F.col("frame") * 0.25).alias("t"), F.col("p.x").alias("x"), (F.col("row") * 20).alias("y"), F.lit(16).alias("h"), F.col("p.text").alias("text"))


@query("WITH " + HITS + f""", ends AS (SELECT stream_id, max(n) AS last FROM hits GROUP BY stream_id),
f AS (SELECT stream_id, last, unnest(range(0, last + 2)) AS frame FROM ends),
g AS (SELECT stream_id, frame, frame + frame // 3 AS top FROM f WHERE frame = 0 OR frame - 1 + (frame - 1) // 3 + {WINDOW - 1} < last),
s AS (SELECT h.stream_id, h.n, count(*) AS frames, min(frame) * 0.25 AS ts FROM hits h JOIN g ON g.stream_id = h.stream_id AND g.top <= h.n AND g.top + {WINDOW} > h.n GROUP BY ALL)
SELECT stream_id, n AS place, CAST(ts AS DOUBLE) AS ts, {LINE} AS text, frames FROM s JOIN hits USING (stream_id, n) WHERE frames >= 2""")
def frame_messages(spark, sf_dir):
    return frames.messages(frames.visual_rows(seen_frames(spark, sf_dir))).select("stream_id", F.col("place").cast("long").alias("place"), "ts", "text", "frames")


@query("WITH " + HITS + """, c AS (SELECT *, CASE WHEN n % 17 = 3 AND actor <> 'Pa' THEN 'clipped' WHEN n % 19 = 5 THEN 'bare' WHEN n % 19 = 6 THEN 'beast' ELSE 'plain' END AS how FROM hits),
o AS (SELECT stream_id, seq, actor AS name FROM c WHERE how IN ('plain', 'beast') UNION ALL SELECT stream_id, seq, creature FROM c WHERE how IN ('plain', 'beast')),
names AS (SELECT stream_id, name, min(seq) AS first FROM o GROUP BY ALL),
cand AS (SELECT c.stream_id, c.seq, k.name, k.first, (SELECT count(*) FROM o WHERE o.stream_id = c.stream_id AND o.name = k.name AND o.seq < c.seq) AS known FROM c JOIN names k ON k.stream_id = c.stream_id
  AND (how = 'clipped' AND k.name LIKE 'P%' AND length(k.name) - length(actor) + 1 BETWEEN 1 AND 2 AND ends_with(lower(k.name), substr(actor, 2)) OR how = 'bare' AND k.name = creature) WHERE how IN ('clipped', 'bare')),
best AS (SELECT *, row_number() OVER (PARTITION BY stream_id, seq ORDER BY known DESC, first) AS rn FROM cand WHERE known >= 2)
SELECT c.stream_id, c.seq, CASE WHEN how IN ('clipped', 'bare') AND b.name IS NULL THEN 'unknown' ELSE 'melee_hit' END AS kind,
  CASE how WHEN 'plain' THEN actor WHEN 'beast' THEN creature ELSE b.name END AS actor, CASE WHEN how IN ('clipped', 'bare') AND b.name IS NULL THEN NULL WHEN how IN ('plain', 'clipped') THEN creature ELSE actor END AS target
FROM c LEFT JOIN best b ON b.stream_id = c.stream_id AND b.seq = c.seq AND b.rn = 1""")
def completed_names(spark, sf_dir):
    """Lines whose attacker has lost its first letter or its article take the name that the stream held most often before."""
    h = hits(spark, sf_dir)
    how = F.when((F.col("n") % 17 == 3) & (F.col("actor") != "Pa"), "clipped").when(F.col("n") % 19 == 5, "bare").when(F.col("n") % 19 == 6, "beast").otherwise("plain")
    end = F.concat(F.lit(" for "), F.col("amount").cast("string"), F.lit(" points of damage."))
    line = (F.when(how == "clipped", F.concat(F.expr("substring(actor, 2)"), F.lit(" crushes "), "creature", end)).when(how == "bare", F.concat(F.expr("substring(creature, 3)"), F.lit(" bites "), "actor", end))
            .when(how == "beast", F.concat("creature", F.lit(" bites "), "actor", end)).otherwise(F.concat("actor", F.lit(" crushes "), "creature", end)))
    read = parse(spread(h).select("stream_id", "seq", F.lit(0.0).alias("ts"), line.alias("text")))
    return completion.completed(read).select("stream_id", "seq", "kind", "actor", "target")
