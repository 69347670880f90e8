"""Queries over the given tables, each beside the SQL that must give the same rows.

``events`` stands in for a combat log: users are actors of eight streams, event types are kinds. Amounts, names and
targets follow from its columns, so that SQL can say what every operator must return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.functions import html as H
from emberlog.functions import text as T
from emberlog.functions.tables import spread
from emberlog.operators import attribution, boards, encounters as E, metrics as M, resolve, roster, session as S, triggers as R
from emberlog.operators.parse import parse
from emberlog.plans.samples import SAMPLES, values

QUERIES: dict = {}
SQL: dict[str, str] = {}
TIMEOUT = 1800.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def letters(n):
    return F.concat(F.lit("P"), F.translate(n.cast("string"), "0123456789", "abcdefghij"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a combat log."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for kv in {"click": "melee_hit", "purchase": "ability_hit", "view": "melee_miss", "signup": "heal", "error": "zone"}.items() for x in kv])
    amount = F.floor("value").cast("long")
    target = F.element_at(F.array(F.lit("a rat"), F.lit("a wolf"), F.lit("a bat")), (F.pmod("event_id", F.lit(3)) + 1).cast("int"))
    k = F.element_at(kind, F.col("event_type"))
    return e.select(
        (F.col("user_id") % 8).alias("stream_id"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000.0).alias("ts"), k.alias("kind"), letters(F.col("user_id")).alias("actor"),
        F.when(k == "zone", F.concat(F.lit("zone "), (F.col("event_id") % 5).cast("string"))).otherwise(target).alias("target"), amount.alias("amount"),
        F.concat(F.lit("skill"), F.get_json_object("props", "$.k")).alias("skill"), F.lit(False).alias("is_pet"))


#: The same in SQL.
EV = """ev AS (SELECT user_id % 8 AS stream_id, event_id AS seq, epoch_us(ts) / 1000000.0 AS ts,
  CASE event_type WHEN 'click' THEN 'melee_hit' WHEN 'purchase' THEN 'ability_hit' WHEN 'view' THEN 'melee_miss' WHEN 'signup' THEN 'heal' WHEN 'error' THEN 'zone' END AS kind,
  'P' || translate(CAST(user_id AS VARCHAR), '0123456789', 'abcdefghij') AS actor,
  CASE WHEN event_type = 'error' THEN 'zone ' || CAST(event_id % 5 AS VARCHAR) ELSE ['a rat', 'a wolf', 'a bat'][CAST(event_id % 3 AS INT) + 1] END AS target,
  CAST(floor(value) AS BIGINT) AS amount, 'skill' || json_extract_string(props, '$.k') AS skill FROM events)"""
WINDOW = "OVER (PARTITION BY stream_id, zone_epoch ORDER BY seq ROWS UNBOUNDED PRECEDING)"
BEFORE = "OVER (PARTITION BY stream_id, zone_epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ENC = EV + f""",
e1 AS (SELECT *, CAST(sum(CASE WHEN kind = 'zone' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS zone_epoch FROM ev),
e2 AS (SELECT *, kind IN ('melee_hit', 'ability_hit', 'melee_miss') AS act FROM e1 WHERE kind <> 'zone'),
e3 AS (SELECT *, coalesce(ts - max(CASE WHEN act THEN ts END) {BEFORE} > 1800, false) AS late FROM e2),
e4 AS (SELECT *, sum(CASE WHEN late THEN 1 ELSE 0 END) {WINDOW} AS c FROM e3),
e5 AS (SELECT *, max(CASE WHEN act THEN c END) {BEFORE} AS pc, max(CASE WHEN act THEN c END) {WINDOW} AS lc FROM e4),
e6 AS (SELECT *, CAST(sum(CASE WHEN act AND (pc IS NULL OR c > pc) THEN 1 ELSE 0 END) {WINDOW} AS BIGINT) AS n FROM e5),
asg AS (SELECT *, CASE WHEN n > 0 AND c = lc THEN n END AS enc FROM e6),
r0 AS (SELECT *, max(CASE WHEN act AND kind IN ('melee_hit', 'ability_hit') THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, zone_epoch, enc) AS d FROM asg WHERE enc IS NOT NULL),
r AS (SELECT * FROM r0 WHERE d = 1),
heads AS (SELECT stream_id, zone_epoch, enc, min(CASE WHEN act THEN ts END) AS start, max(CASE WHEN act THEN ts END) AS end_, count(*) AS n_events,
  count(*) FILTER (WHERE act AND kind <> 'melee_miss') AS n_damage, 0 AS kills, string_agg(DISTINCT CASE WHEN act THEN target END, ', ' ORDER BY CASE WHEN act THEN target END) AS targets FROM r GROUP BY ALL),
act0 AS (SELECT stream_id, zone_epoch, enc, actor, CAST(coalesce(sum(amount) FILTER (WHERE kind IN ('melee_hit', 'ability_hit')), 0) AS BIGINT) AS damage, count(*) FILTER (WHERE kind = 'melee_hit') AS hits,
  count(*) FILTER (WHERE kind = 'melee_miss') AS misses, coalesce(max(amount) FILTER (WHERE kind IN ('melee_hit', 'ability_hit')), 0) AS max_hit, count(*) FILTER (WHERE kind IN ('melee_hit', 'ability_hit')) AS k,
  CAST(coalesce(sum(amount) FILTER (WHERE kind = 'heal'), 0) AS BIGINT) AS heals FROM r GROUP BY ALL),
actors AS (SELECT a.stream_id, a.zone_epoch, a.enc, actor, damage, hits + misses AS swings, hits, misses, CASE WHEN hits + misses > 0 THEN round(100.0 * hits / (hits + misses), 2) ELSE 0.0 END AS hit_pct, max_hit,
  CASE WHEN k > 0 THEN round(damage / k, 2) ELSE 0.0 END AS avg_hit, heals, round(damage / greatest(1.0, end_ - start), 2) AS dps FROM act0 a JOIN heads USING (stream_id, zone_epoch, enc))"""


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.assign_encounters(activity(spark, sf_dir), TIMEOUT)


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combat lines written from the events table."""
    a = activity(spark, sf_dir)
    owner, n = F.concat("actor", F.lit("'s ")), F.col("amount").cast("string")
    line = (F.when(F.col("kind") == "melee_hit", F.concat("actor", F.lit(" crushes "), "target", F.lit(" for "), n, F.lit(" points of damage.")))
            .when(F.col("kind") == "ability_hit", F.concat(owner, F.lit("Holy Strike hits "), "target", F.lit(" for "), n, F.lit(" points of Holy Damage.")))
            .when(F.col("kind") == "melee_miss", F.concat("actor", F.lit(" tries to crush "), "target", F.lit(", but misses!")))
            .when(F.col("kind") == "heal", F.concat(owner, F.lit("Heal heals Wululiso for "), n, F.lit(" Health.")))
            .otherwise(F.concat(F.lit("You have entered "), "target", F.lit("."))))
    return spread(a).select("stream_id", "seq", "ts", line.alias("text"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = E.assign_encounters(parse(rendered(spark, sf_dir)), TIMEOUT)
    return M.actor_table(E.encounter_rows(e))


@query("WITH " + EV + """ SELECT stream_id, seq, kind, CASE WHEN kind <> 'zone' THEN actor END AS actor, CASE WHEN kind = 'heal' THEN 'Wululiso' ELSE target END AS target,
  CASE WHEN kind IN ('melee_hit', 'ability_hit', 'heal') THEN amount END AS amount,
  CASE kind WHEN 'melee_hit' THEN 'crush' WHEN 'melee_miss' THEN 'crush' WHEN 'ability_hit' THEN 'Holy Strike' WHEN 'heal' THEN 'Heal' END AS skill,
  CASE kind WHEN 'melee_hit' THEN 'hit' WHEN 'ability_hit' THEN 'hit' WHEN 'melee_miss' THEN 'miss' END AS outcome FROM ev""")
def parse_roundtrip(spark, sf_dir):
    return parse(rendered(spark, sf_dir)).select("stream_id", "seq", "kind", "actor", "target", "amount", "skill", "outcome")


def all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of each sort of message in turn, with the names and numbers of the events table."""
    a = activity(spark, sf_dir)
    creature = F.element_at(F.array(F.lit("a rat"), F.lit("a wolf"), F.lit("a bat")), (F.pmod("seq", F.lit(3)) + 1).cast("int"))
    line = F.get(F.array(*[F.lit(row[0]) for row in SAMPLES]), (F.col("seq") % len(SAMPLES)).cast("int"))
    for mark, value in (("{a}", F.col("actor")), ("{t}", creature), ("{n}", F.col("amount").cast("string"))):
        line = F.replace(line, F.lit(mark), value)
    return spread(a).select("stream_id", "seq", "ts", line.alias("text"))


FILLED = "replace(replace(replace({0}, '{{a}}', actor), '{{t}}', creature), '{{n}}', CAST(amount AS VARCHAR))"


@query("WITH " + EV + ", s(i, kind, actor_, target_, amount_, skill, outcome) AS (VALUES " + values() + "), e AS (SELECT stream_id, seq, actor, amount, ['a rat', 'a wolf', 'a bat'][CAST(seq % 3 AS INT) + 1] AS creature FROM ev) "
       "SELECT stream_id, seq, s.kind, " + FILLED.format("actor_") + " AS actor, " + FILLED.format("target_") + " AS target, CAST(" + FILLED.format("amount_") + f" AS BIGINT) AS amount, skill, outcome FROM e JOIN s ON s.i = e.seq % {len(SAMPLES)}")
def parse_all_kinds(spark, sf_dir):
    return parse(all_lines(spark, sf_dir)).select("stream_id", "seq", "kind", "actor", "target", "amount", "skill", "outcome")


@query("WITH " + EV + " SELECT kind, count(*) AS n FROM ev GROUP BY kind")
def kind_counts(spark, sf_dir):
    return M.kind_counts(parse(rendered(spark, sf_dir)))


@query("""SELECT event_id, (event_id % 7) * 10000 + (event_id % 50) * 100 + event_id % 99 AS copper,
  CASE WHEN (event_id % 7) * 10000 + (event_id % 50) * 100 + event_id % 99 = 0 THEN '0c' ELSE concat_ws(' ', CASE WHEN event_id % 7 > 0 THEN (event_id % 7) || 'g' END, CASE WHEN event_id % 50 > 0 THEN (event_id % 50) || 's' END,
  CASE WHEN event_id % 99 > 0 THEN (event_id % 99) || 'c' END) END AS coins FROM events""")
def coin_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", *[(F.col("event_id") % m).cast("string").alias(c) for c, m in (("g", 7), ("s", 50), ("c", 99))])
    line = F.concat(F.lit("You loot "), "g", F.lit(" gold, "), "s", F.lit(" silver and "), "c", F.lit(" copper coins from a rat's corpse."))
    got = parse(e.select(F.lit("s").alias("stream_id"), F.col("event_id").alias("seq"), F.lit(0.0).alias("ts"), line.alias("text")))
    return got.select(F.col("seq").alias("event_id"), "copper", T.coin_text(F.col("copper")).alias("coins"))


@query("WITH " + ENC + ' SELECT stream_id, zone_epoch, enc, start, end_ AS "end", n_events, n_damage, CAST(kills AS BIGINT) AS kills, targets FROM heads')
def encounter_summary(spark, sf_dir):
    return E.encounters(assigned(spark, sf_dir))


@query("WITH " + ENC + " SELECT stream_id, zone_epoch, enc, actor, damage, swings, hits, misses, hit_pct, max_hit, avg_hit, heals, dps FROM actors")
def actor_table(spark, sf_dir):
    return M.actor_table(E.encounter_rows(assigned(spark, sf_dir)))


@query("WITH " + ENC + """ SELECT stream_id, zone_epoch, enc, actor, skill, count(*) FILTER (WHERE kind <> 'melee_miss') AS n, CAST(coalesce(sum(amount) FILTER (WHERE kind <> 'melee_miss'), 0) AS BIGINT) AS total,
  coalesce(max(amount) FILTER (WHERE kind <> 'melee_miss'), 0) AS max_hit, count(*) FILTER (WHERE kind = 'melee_miss') AS misses FROM r WHERE kind <> 'heal' GROUP BY ALL""")
def skill_breakdown(spark, sf_dir):
    return M.skill_table(E.encounter_rows(assigned(spark, sf_dir)))


@query("WITH " + ENC + """ SELECT stream_id, zone_epoch, enc, target, actor || ': ' || skill AS source, CAST(sum(amount) AS BIGINT) AS taken,
  CAST(sum(CASE WHEN seq % 5 = 0 THEN amount % 10 ELSE 0 END + CASE WHEN seq % 7 = 0 THEN 3 ELSE 0 END) AS BIGINT) AS prevented, count(*) AS n
  FROM r WHERE kind IN ('melee_hit', 'ability_hit') GROUP BY ALL""")
def taken_from(spark, sf_dir):
    absorbed, blocked = F.when(F.col("seq") % 5 == 0, F.col("amount") % 10), F.when(F.col("seq") % 7 == 0, F.lit(3)).cast("long")
    return M.taken_table(E.encounter_rows(assigned(spark, sf_dir)).withColumn("absorbed", absorbed).withColumn("blocked", blocked))


@query("WITH " + ENC + " SELECT stream_id, zone_epoch, enc, actor, target, CAST(sum(amount) AS BIGINT) AS healed, max(amount) AS max_heal, count(*) AS n FROM r WHERE kind = 'heal' GROUP BY ALL")
def heals(spark, sf_dir):
    return M.heal_table(E.encounter_rows(assigned(spark, sf_dir)))


@query("WITH " + EV + """, z AS (SELECT *, lag(target) OVER (PARTITION BY stream_id ORDER BY seq) AS p FROM ev WHERE kind = 'zone'),
v AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR p <> target THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit FROM z)
SELECT stream_id, visit, arg_min(target, seq) AS zone, arg_min(ts, seq) AS entered, count(*) AS n FROM v GROUP BY stream_id, visit""")
def zone_visits(spark, sf_dir):
    return E.zone_visits(activity(spark, sf_dir))


@query("WITH " + EV + """ SELECT e.stream_id, e.seq, coalesce(z.target, '') AS zone FROM (SELECT * FROM ev WHERE kind <> 'zone') e
ASOF LEFT JOIN (SELECT * FROM ev WHERE kind = 'zone') z ON e.stream_id = z.stream_id AND e.seq >= z.seq""")
def zone_asof(spark, sf_dir):
    return E.with_zone(activity(spark, sf_dir)).select("stream_id", "seq", "zone")


def with_casts(spark, sf_dir):
    return activity(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "heal", "cast").otherwise(F.col("kind")))


@query("WITH " + ENC.replace("WHEN 'signup' THEN 'heal'", "WHEN 'signup' THEN 'cast'") + """,
o AS (SELECT stream_id, zone_epoch, enc, min(seq) AS open_seq, min(ts) AS ots FROM asg WHERE act GROUP BY ALL),
j AS (SELECT a.stream_id, a.zone_epoch, a.seq, o.enc, o.open_seq, o.ots - a.ts AS dt, row_number() OVER (PARTITION BY a.stream_id, a.seq ORDER BY o.open_seq) AS rn
  FROM asg a JOIN o ON a.stream_id = o.stream_id AND a.zone_epoch = o.zone_epoch AND o.open_seq > a.seq WHERE a.enc IS NULL AND a.kind = 'cast'),
k AS (SELECT *, row_number() OVER (PARTITION BY stream_id, open_seq ORDER BY seq DESC) AS q FROM j WHERE rn = 1 AND dt <= 1800)
SELECT stream_id, zone_epoch, seq, enc, open_seq FROM k WHERE q <= 20""")
def prefight_attach(spark, sf_dir):
    return E.attach_prefight(E.assign_encounters(with_casts(spark, sf_dir), TIMEOUT), 1800.0)


@query("WITH " + EV + """, m AS (SELECT *, CASE WHEN kind = 'heal' THEN amount END AS extra,
  last_value(CASE WHEN kind IN ('melee_hit', 'ability_hit') THEN seq END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS hit FROM ev),
x AS (SELECT stream_id, hit, CAST(sum(extra) AS BIGINT) AS absorbed, bool_or(seq % 3 = 0) AS crit FROM m WHERE kind = 'heal' AND hit IS NOT NULL GROUP BY ALL)
SELECT e.stream_id, e.seq, e.kind, x.absorbed, CASE WHEN x.crit THEN 'critical' WHEN kind IN ('melee_hit', 'ability_hit') THEN 'hit' END AS outcome FROM ev e LEFT JOIN x ON e.stream_id = x.stream_id AND e.seq = x.hit WHERE kind <> 'heal'""")
def marker_foldback(spark, sf_dir):
    a = activity(spark, sf_dir)
    a = a.withColumn("absorbed", F.when(F.col("kind") == "heal", F.col("amount"))).withColumn("blocked", F.lit(None).cast("long"))
    a = a.withColumn("outcome", F.when(F.col("kind").isin("melee_hit", "ability_hit"), "hit").when((F.col("kind") == "heal") & (F.col("seq") % 3 == 0), "critical"))
    return E.fold_markers(a.withColumn("kind", F.when(F.col("kind") == "heal", "marker").otherwise(F.col("kind")))).select("stream_id", "seq", "kind", "absorbed", "outcome")


@query("WITH " + EV + """, g AS (SELECT *, CASE WHEN kind = 'heal' THEN 'heal' WHEN kind IN ('melee_hit', 'ability_hit') THEN 'damage' END AS g, CASE WHEN seq % 5 = 0 THEN NULL ELSE amount END AS v,
  sum(CASE WHEN kind = 'zone' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS z FROM ev),
h AS (SELECT *, CASE WHEN g IS NOT NULL THEN v END AS w FROM g),
i AS (SELECT stream_id, seq, kind, g, v, coalesce(
  avg(w) OVER (PARTITION BY stream_id, g, z, actor, skill ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(w) OVER (PARTITION BY stream_id, g, z, actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  avg(w) OVER (PARTITION BY stream_id, g, z, skill ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(w) OVER (PARTITION BY stream_id, g, z ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  avg(w) OVER (PARTITION BY stream_id, g, actor, skill ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(w) OVER (PARTITION BY stream_id, g, actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  avg(w) OVER (PARTITION BY stream_id, g, skill ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), avg(w) OVER (PARTITION BY stream_id, g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS guess FROM h)
SELECT stream_id, seq, CASE WHEN v IS NULL AND g IS NOT NULL AND guess IS NOT NULL THEN greatest(1, CAST(round_even(guess, 0) AS BIGINT)) ELSE v END AS amount, v IS NULL AND g IS NOT NULL AND guess IS NOT NULL AS estimated FROM i""")
def impute_amount(spark, sf_dir):
    a = activity(spark, sf_dir).withColumn("amount", F.when(F.col("seq") % 5 != 0, F.col("amount"))).withColumn("estimated", F.lit(False))
    return E.impute_amounts(a).select("stream_id", "seq", "amount", "estimated")


DEATHS = """, k AS (SELECT stream_id, actor AS victim, ts, row_number() OVER (PARTITION BY stream_id, actor ORDER BY ts) AS i FROM ev WHERE kind = 'heal'),
w AS (SELECT stream_id, victim, i, ts, ts AS anchor, true AS fired FROM k WHERE i = 1
  UNION ALL SELECT k.stream_id, k.victim, k.i, k.ts, CASE WHEN k.ts - w.anchor > 86400 THEN k.ts ELSE w.anchor END, k.ts - w.anchor > 86400 FROM w JOIN k ON k.stream_id = w.stream_id AND k.victim = w.victim AND k.i = w.i + 1)"""


@query("WITH RECURSIVE " + EV + DEATHS + " SELECT stream_id, victim, count(*) FILTER (WHERE fired) AS deaths FROM w GROUP BY ALL")
def deaths_dedup(spark, sf_dir):
    k = activity(spark, sf_dir).where("kind = 'heal'").select("stream_id", "ts", F.lit("kill").alias("kind"), F.col("actor").alias("target"))
    return M.deaths(k, ["stream_id"], 86400.0)


@query("WITH " + EV + """, a AS (SELECT * FROM ev WHERE kind = 'ability_hit'), t AS (SELECT * FROM ev WHERE kind = 'heal')
SELECT stream_id, seq FROM a WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.stream_id = a.stream_id AND t.target = a.target AND t.actor = a.actor AND abs(a.ts - t.ts) <= 86400)""")
def aggro_anti(spark, sf_dir):
    a = activity(spark, sf_dir)
    notice = a.where("kind = 'ability_hit'").select("stream_id", "seq", "ts", F.lit("aggro").alias("kind"), F.col("target").alias("actor"), F.col("actor").alias("target"), F.lit("x").alias("skill"))
    taunt = a.where("kind = 'heal'").select("stream_id", "seq", "ts", F.lit("status").alias("kind"), "actor", "target", F.lit("taunt").alias("skill"))
    return M.notices_without_taunt(notice.union(taunt), 86400.0).select("stream_id", "seq")


@query("WITH " + ENC + """, o AS (SELECT stream_id, zone_epoch, enc, CASE WHEN substr(actor, 2, 1) IN ('a', 'b') THEN 'Owner' ELSE actor END AS actor, damage, hits, misses, heals, max_hit,
  CASE WHEN substr(actor, 2, 1) IN ('a', 'b') THEN 1 ELSE 0 END AS pet FROM actors)
SELECT stream_id, zone_epoch, enc, actor, CAST(sum(damage) AS BIGINT) AS damage, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(misses) AS BIGINT) AS misses, CAST(sum(heals) AS BIGINT) AS heals, max(max_hit) AS max_hit, CAST(sum(pet) AS BIGINT) AS pets FROM o GROUP BY ALL""")
def pet_rollup(spark, sf_dir):
    a = actor_table(spark, sf_dir)
    owners = activity(spark, sf_dir).select(F.col("actor").alias("pet")).distinct().where(F.substring("pet", 2, 1).isin("a", "b")).withColumn("owner", F.lit("Owner"))
    return M.pet_rollup(a, owners)


@query("WITH " + ENC + """, d AS (SELECT stream_id, zone_epoch, greatest(1.0, sum(end_ - start)) AS duration, count(*) AS fights FROM heads GROUP BY ALL),
z AS (SELECT stream_id, zone_epoch, actor, CAST(sum(damage) AS BIGINT) AS damage, CAST(sum(heals) AS BIGINT) AS heals, max(max_hit) AS max_hit, sum(CASE WHEN avg_hit > 0 THEN damage / avg_hit END) AS k FROM actors GROUP BY ALL)
SELECT stream_id, zone_epoch, actor, fights, damage, heals, max_hit, round(damage / duration, 2) AS dps, round(coalesce(CASE WHEN k > 0 THEN damage / k END, 0.0), 2) AS avg_hit,
  round(coalesce(damage * 1.0 / nullif(sum(damage) OVER (PARTITION BY stream_id, zone_epoch), 0), 0.0), 4) AS share FROM z JOIN d USING (stream_id, zone_epoch)""")
def zone_rollup(spark, sf_dir):
    a = assigned(spark, sf_dir)
    return M.zone_rollup(M.actor_table(E.encounter_rows(a)), E.encounters(a)).withColumn("share", F.col("share").cast("double"))


@query("WITH " + ENC + ", t AS (SELECT *, row_number() OVER (PARTITION BY stream_id, zone_epoch, enc ORDER BY damage DESC, actor) AS rank FROM actors WHERE damage > 0) SELECT stream_id, zone_epoch, enc, rank, actor, damage FROM t WHERE rank <= 3")
def tabs_topk(spark, sf_dir):
    return M.top_actors(actor_table(spark, sf_dir)).select("stream_id", "zone_epoch", "enc", F.col("rank").cast("long").alias("rank"), "actor", "damage")


@query("WITH " + ENC + """, t AS (SELECT *, row_number() OVER (PARTITION BY stream_id, zone_epoch, enc ORDER BY damage DESC, actor) AS rank FROM actors WHERE damage > 0),
l AS (SELECT stream_id, zone_epoch, enc, string_agg(actor || ' ' || damage || ' (' || printf('%.2f', dps) || ')', ', ' ORDER BY rank) AS top FROM t WHERE rank <= 3 GROUP BY ALL)
SELECT stream_id, zone_epoch, enc, targets || ' in ' || (CAST(round(end_ - start) AS BIGINT) // 60) || ':' || lpad(CAST(CAST(round(end_ - start) AS BIGINT) % 60 AS VARCHAR), 2, '0') || ': ' || coalesce(top, '') AS line FROM heads LEFT JOIN l USING (stream_id, zone_epoch, enc)""")
def export_line(spark, sf_dir):
    a = assigned(spark, sf_dir)
    return M.summary_lines(M.actor_table(E.encounter_rows(a)), E.encounters(a))


@query("WITH " + ENC + """, g AS (SELECT stream_id, zone_epoch, enc, count(*) AS size, count(*) FILTER (WHERE damage > 0 AND damage >= heals) AS dealers, avg(damage) FILTER (WHERE damage > 0 AND damage >= heals) AS d,
  count(*) FILTER (WHERE heals > 0 AND heals >= damage) AS healers, avg(heals) FILTER (WHERE heals > 0 AND heals >= damage) AS h FROM actors WHERE actor <> 'Pa' GROUP BY ALL)
SELECT stream_id, zone_epoch, enc, size, CASE WHEN dealers >= 3 THEN round(d / power(10.0, floor(log10(d)) - 1)) * power(10.0, floor(log10(d)) - 1) END AS mean_damage,
  CASE WHEN healers >= 3 THEN round(h / power(10.0, floor(log10(h)) - 1)) * power(10.0, floor(log10(h)) - 1) END AS mean_heals FROM g WHERE size >= 3""")
def privacy_role_avg(spark, sf_dir):
    return M.role_averages(actor_table(spark, sf_dir), "Pa")


@query("WITH " + EV + """, k AS (SELECT *, CASE kind WHEN 'melee_miss' THEN CASE seq % 3 WHEN 0 THEN 'loot' WHEN 1 THEN 'harvest' ELSE 'experience' END WHEN 'melee_hit' THEN CASE seq % 2 WHEN 0 THEN 'coin' ELSE 'cc' END
  WHEN 'heal' THEN 'kill' WHEN 'ability_hit' THEN 'craft' ELSE kind END AS did FROM ev)
SELECT stream_id, count(*) AS events, count(*) FILTER (WHERE did = 'loot') AS items, CAST(coalesce(sum(amount) FILTER (WHERE did = 'coin'), 0) AS BIGINT) AS coin_total, count(*) FILTER (WHERE did = 'kill') AS kills,
  count(*) FILTER (WHERE did = 'cc') AS cc, count(*) FILTER (WHERE did = 'harvest' AND seq % 2 = 0) AS harvests, CAST(coalesce(sum(amount) FILTER (WHERE did = 'craft'), 0) AS BIGINT) AS crafts,
  count(*) FILTER (WHERE did = 'experience') AS xp_ticks, count(*) FILTER (WHERE did = 'zone') AS zones FROM k GROUP BY stream_id""")
def session_counters(spark, sf_dir):
    k, n = F.col("kind"), F.col("seq")
    did = (F.when(k == "melee_miss", F.when(n % 3 == 0, "loot").when(n % 3 == 1, "harvest").otherwise("experience")).when(k == "melee_hit", F.when(n % 2 == 0, "coin").otherwise("cc"))
           .when(k == "heal", "kill").when(k == "ability_hit", "craft").otherwise(k))
    a = activity(spark, sf_dir).withColumn("actor", F.when((did == "harvest") & (n % 2 == 0), "You").otherwise(F.col("actor"))).withColumn("copper", F.when(did == "coin", F.col("amount")))
    return S.counters(a.withColumn("kind", did))


@query("WITH " + EV + ", g AS (SELECT stream_id, skill AS name, count(*) AS n FROM ev WHERE kind = 'melee_miss' GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY n DESC, name) AS rank FROM g")
def session_ranked(spark, sf_dir):
    return S.ranked(activity(spark, sf_dir), "melee_miss", "skill").withColumn("rank", F.col("rank").cast("long"))


@query("WITH " + EV + """, u AS (SELECT *, CAST(ts * 1000000 AS BIGINT) AS us FROM ev), w AS (SELECT stream_id, seq, us, count(*) OVER q AS n, CAST(coalesce(sum(amount) OVER q, 0) AS BIGINT) AS total, min(us) OVER (PARTITION BY stream_id) AS first
  FROM u WINDOW q AS (PARTITION BY stream_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW))
SELECT stream_id, seq, n, total, round(total * 3600.0 / greatest(60.0, least(3600.0, (us - first) / 1000000)), 2) AS per_hour FROM w""")
def rolling_rates(spark, sf_dir):
    return S.rolling_rates(activity(spark, sf_dir))


@query("WITH " + EV + """, c AS (SELECT stream_id, seq, ts, actor, amount, kind, lead(kind) OVER q AS nk, lead(ts) OVER q AS nt, lead(amount) OVER q AS na FROM ev WHERE kind IN ('melee_hit', 'heal') WINDOW q AS (PARTITION BY stream_id ORDER BY seq))
SELECT stream_id, seq, actor, amount AS copper, CASE WHEN nk = 'heal' AND nt - ts <= 7200 AND na <= amount THEN na ELSE 0 END AS received FROM c WHERE kind = 'melee_hit'""")
def coin_received(spark, sf_dir):
    a = activity(spark, sf_dir).where("kind in ('melee_hit', 'heal')")
    coin = F.col("kind") == "melee_hit"
    a = a.select("stream_id", "seq", "ts", "actor", F.when(coin, "coin").otherwise("coin_split").alias("kind"), F.when(coin, F.col("amount")).alias("copper"), F.when(~coin, F.col("amount")).alias("split_copper"))
    return S.coin_received(a, 7200.0)


@query("WITH " + EV + """, g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY seq) > 7200, false) AS cut FROM ev)
SELECT stream_id, seq, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g""")
def log_segments(spark, sf_dir):
    return S.segments(activity(spark, sf_dir), 7200.0).select("stream_id", "seq", "segment")


@query("WITH " + EV + """, o AS (SELECT stream_id, seq, ts, CASE kind WHEN 'zone' THEN 'clear' WHEN 'melee_miss' THEN 'remove' ELSE 'add' END AS op, CASE WHEN kind <> 'zone' THEN actor END AS name FROM ev WHERE kind <> 'heal'),
e AS (SELECT *, sum(CASE WHEN op = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ep FROM o),
m AS (SELECT *, max(ep) OVER (PARTITION BY stream_id) AS top FROM e)
SELECT stream_id, name FROM m WHERE ep = top AND name IS NOT NULL GROUP BY ALL HAVING arg_max(op, seq) = 'add'""")
def roster_membership(spark, sf_dir):
    k = F.col("kind")
    o = activity(spark, sf_dir).where("kind <> 'heal'").select("stream_id", "seq", "ts", F.when(k == "zone", "clear").when(k == "melee_miss", "remove").otherwise("add").alias("op"), F.when(k != "zone", F.col("actor")).alias("name"))
    return roster.membership(o)


@query("WITH " + EV + ", n AS (SELECT actor AS name FROM ev WHERE kind <> 'zone' UNION ALL SELECT target FROM ev WHERE kind <> 'zone') SELECT name, count(*) AS n FROM n GROUP BY name HAVING count(*) >= 2 ORDER BY n DESC, name LIMIT 5000")
def vocabulary(spark, sf_dir):
    return resolve.vocabulary(activity(spark, sf_dir).where("kind <> 'zone'"))


@query("""WITH n AS (SELECT DISTINCT name, lower(name) AS low FROM (SELECT s_name AS name FROM supplier) WHERE length(name) > 1),
p AS (SELECT a.name AS a, b.name AS b, a.low AS la, b.low AS lb, levenshtein(a.low, b.low) AS distance FROM n a JOIN n b ON a.name < b.name AND abs(length(a.name) - length(b.name)) <= 3),
t AS (SELECT *, CASE WHEN least(length(la), length(lb)) < 5 THEN 0 WHEN least(length(la), length(lb)) <= 8 THEN 1 WHEN least(length(la), length(lb)) <= 16 THEN 2 ELSE 3 END AS lim, string_split(la, ' ') AS wa, string_split(lb, ' ') AS wb FROM p),
w AS (SELECT *, list_transform(range(1, len(wa) + 1), lambda i: levenshtein(wa[i], coalesce(wb[i], ''))) AS ds,
  list_transform(range(1, len(wa) + 1), lambda i: CASE WHEN least(length(wa[i]), length(wb[i])) <= 3 THEN 0 WHEN least(length(wa[i]), length(wb[i])) <= 6 THEN 1 WHEN least(length(wa[i]), length(wb[i])) <= 12 THEN 2 ELSE 3 END) AS ms FROM t WHERE len(wa) = len(wb))
SELECT a, b, distance FROM w WHERE list_sum(ds) <= lim AND list_bool_and(list_transform(range(1, len(ds) + 1), lambda i: ds[i] <= ms[i]))
UNION ALL SELECT a, b, distance FROM t WHERE len(wa) <> len(wb) AND distance <= least(2, lim)""")
def spelling_neighbours(spark, sf_dir):
    return resolve.spelling_pairs(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))).withColumn("distance", F.col("distance").cast("long"))


@query("WITH " + ENC + """ SELECT DISTINCT stream_id, zone_epoch, enc, name, CASE WHEN name LIKE 'a %' THEN 'enemy' WHEN name = 'Pb' THEN 'group' ELSE 'other' END AS side
  FROM (SELECT stream_id, zone_epoch, enc, unnest([actor, target]) AS name FROM r WHERE kind IN ('melee_hit', 'melee_miss', 'ability_hit'))""")
def sides(spark, sf_dir):
    return M.sides(E.encounter_rows(assigned(spark, sf_dir)), you="Pb")


@query("WITH " + EV + """, lv AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS seq, row_number() OVER (PARTITION BY stream_id ORDER BY seq) * CAST(0.5 AS DOUBLE) AS ts, kind, actor, target, skill FROM ev),
d AS (SELECT * FROM lv WHERE kind = 'melee_miss'), a AS (SELECT * FROM lv WHERE kind IN ('ability_hit', 'heal')),
j AS (SELECT d.stream_id, d.seq, a.actor, a.skill, d.ts - a.ts AS dt, d.seq - a.seq AS di, a.seq AS aseq, CASE WHEN a.skill = 'skill1' AND a.target = d.target THEN 0 WHEN a.skill = 'skill1' THEN 1 WHEN a.kind = 'ability_hit' AND a.target = d.target THEN 2 END AS tier,
  CASE WHEN a.skill = 'skill1' THEN 0 ELSE 1048576 END AS r FROM d JOIN a ON d.stream_id = a.stream_id AND d.ts - a.ts <= 6.5 AND d.ts - a.ts >= -10
  WHERE CASE WHEN a.kind = 'heal' THEN d.ts >= a.ts ELSE d.ts - a.ts BETWEEN 0 AND 1.5 AND d.seq - a.seq <= 4 END
    OR (d.ts <= a.ts AND d.seq < a.seq AND (a.ts - d.ts <= 2 OR (a.seq - d.seq <= 3 AND a.ts - d.ts <= 5) OR (a.seq - d.seq <= 2 AND a.ts - d.ts <= 10)))),
k AS (SELECT *, row_number() OVER (PARTITION BY stream_id, seq ORDER BY tier, r, abs(dt), abs(di), aseq) AS rn FROM j WHERE tier IS NOT NULL)
SELECT stream_id, seq, actor, skill, tier FROM k WHERE rn = 1""")
def debuff_credit(spark, sf_dir):
    a = activity(spark, sf_dir).withColumn("seq", F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")).cast("long"))
    a = a.withColumn("ts", F.col("seq") * 0.5)
    kind = F.when(F.col("kind") == "melee_miss", "debuff").when(F.col("kind") == "heal", "cast").when(F.col("kind") == "ability_hit", "ability_hit")
    a = a.withColumn("outcome", F.when(F.col("kind") == "melee_miss", "slowed")).withColumn("kind", kind).where("kind is not null")
    hints = spark.createDataFrame([("slowed", "skill1", 0)], "outcome string, skill string, rank int")
    return attribution.debuff_credit(a, hints)


@query("WITH " + EV + """, c AS (SELECT * FROM ev WHERE kind IN ('heal', 'melee_miss')),
l AS (SELECT *, last_value(CASE WHEN kind = 'heal' THEN seq END IGNORE NULLS) OVER w AS cs, last_value(CASE WHEN kind = 'heal' THEN ts END IGNORE NULLS) OVER w AS ct, last_value(CASE WHEN kind = 'heal' THEN skill END IGNORE NULLS) OVER w AS ck
  FROM c WINDOW w AS (PARTITION BY stream_id, actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT stream_id, seq, actor, CASE WHEN ts - ct <= 86400 THEN ck END AS skill, CASE WHEN ts - ct <= 86400 THEN cs END AS cast_seq FROM l WHERE kind = 'melee_miss'""")
def interrupt_casts(spark, sf_dir):
    a = activity(spark, sf_dir).where("kind in ('heal', 'melee_miss')")
    return attribution.last_cast(a.withColumn("kind", F.when(F.col("kind") == "heal", "cast").otherwise("interrupt")), 86400.0)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def leaderboard_latest(spark, sf_dir):
    return boards.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH l AS (SELECT user_id, 'amount' AS field, CAST(floor(value) AS BIGINT) AS v, event_id FROM events UNION ALL SELECT user_id, 'k', CAST(json_extract_string(props, '$.k') AS BIGINT), event_id FROM events),
m AS (SELECT user_id, field, max(v) AS best FROM l GROUP BY ALL) SELECT m.user_id, m.field, best, min(event_id) AS first_at FROM m JOIN l ON l.user_id = m.user_id AND l.field = m.field AND l.v = m.best GROUP BY ALL""")
def personal_best(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("long").alias("amount"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return boards.personal_bests(e, "user_id", ["amount", "k"], "event_id")


@query("""WITH f AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS t FROM conversations WHERE length(text) <= 8192),
r AS (SELECT item_id, trim(regexp_replace(lower(string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2]), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS p FROM benchmark)
SELECT conv_id, turn, item_id AS rule_id FROM f JOIN r ON p <> '' AND contains(t, ' ' || p || ' ')""")
def trigger_contains(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.lit(0.0).alias("ts"), "text")
    first = F.array_join(F.slice(F.split("text", " "), 1, 2), " ")
    rules = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule_id"), F.lit("contains").alias("mode"), F.lit(False).alias("fuzzy"), first.alias("pattern"))
    return R.matches(lines, rules).select(F.col("stream_id").alias("conv_id"), F.col("seq").alias("turn"), "rule_id")


@query("WITH RECURSIVE " + EV + DEATHS + " SELECT stream_id, victim AS rule_id, ts FROM w WHERE fired")
def trigger_cooldown(spark, sf_dir):
    hits = activity(spark, sf_dir).where("kind = 'heal'").select("stream_id", F.col("actor").alias("rule_id"), "ts")
    return R.cooldown(hits, 86400.0)


@query("WITH " + EV + ", l AS (SELECT stream_id, seq, actor, ts, lag(ts) OVER (PARTITION BY stream_id, actor ORDER BY seq) AS p FROM ev) SELECT stream_id, seq, actor FROM l WHERE p IS NULL OR ts - p >= 43200")
def revenge_debounce(spark, sf_dir):
    return R.quiet_alerts(activity(spark, sf_dir), ["stream_id", "actor"], 43200.0).select("stream_id", "seq", "actor")


@query("WITH " + EV + " SELECT stream_id, actor, min(seq) AS seq, arg_min(ts, seq) AS ts FROM ev WHERE kind IN ('melee_hit', 'melee_miss', 'ability_hit') GROUP BY stream_id, actor")
def revenge_first(spark, sf_dir):
    return R.first_attacks(activity(spark, sf_dir).withColumn("target", F.lit("You")))


@query("WITH " + EV + """, l AS (SELECT stream_id, seq, ts, amount <= 30 AS low FROM ev), c AS (SELECT *, coalesce(NOT lag(low) OVER w OR ts - lag(ts) OVER w > 7200, true) AS cut FROM l WINDOW w AS (PARTITION BY stream_id ORDER BY seq)),
i AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS isle FROM c)
SELECT stream_id, min(ts) AS start, max(ts) AS "end", count(*) AS readings FROM i WHERE low GROUP BY stream_id, isle HAVING count(*) >= 2""")
def hp_episodes(spark, sf_dir):
    return R.low_episodes(activity(spark, sf_dir).select("stream_id", "seq", "ts", F.col("amount").alias("hp"), F.lit(300).alias("hp_max")), 0.1, 7200.0)


@query("WITH " + EV + """, p AS (SELECT stream_id, lag(ts) OVER (PARTITION BY stream_id ORDER BY seq) AS s, ts AS e, amount, max(ts) OVER (PARTITION BY stream_id) AS now FROM ev),
o AS (SELECT stream_id, amount, e - s AS len, greatest(0.0, least(e, now) - greatest(s, now - 36000)) AS part FROM p WHERE e - s > 0)
SELECT stream_id, round(sum(amount * part / len) / sum(part) * 3600, 4) AS per_hour FROM o GROUP BY stream_id""")
def xp_rate(spark, sf_dir):
    w = Window.partitionBy("stream_id").orderBy("seq")
    p = activity(spark, sf_dir).select("stream_id", F.lag("ts").over(w).alias("start"), F.col("ts").alias("end"), F.col("amount").alias("points"), F.max("ts").over(Window.partitionBy("stream_id")).alias("now"))
    return R.experience_rate(p, 36000.0)


@query("WITH " + EV + """, g AS (SELECT stream_id, ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY seq) AS g FROM ev WHERE kind = 'melee_hit'), l AS (SELECT stream_id, list(g ORDER BY g) AS gs FROM g WHERE g BETWEEN 60 AND 20000 GROUP BY stream_id),
b AS (SELECT stream_id, gs, gs[CAST(least(len(gs), floor(len(gs) * 0.3) + 1) AS INT)] AS b FROM l WHERE len(gs) >= 2),
r AS (SELECT stream_id, len(gs) AS gaps, list_sort(list_transform(gs, lambda x: x / greatest(1.0, round_even(x / b, 0)))) AS rs FROM b)
SELECT stream_id, gaps, round(CASE WHEN gaps % 2 = 1 THEN rs[gaps // 2 + 1] ELSE (rs[gaps // 2] + rs[gaps // 2 + 1]) / 2 END, 2) AS delay FROM r""")
def swing_delay(spark, sf_dir):
    return R.swing_delay(activity(spark, sf_dir).where("kind = 'melee_hit'"), ["stream_id"], 60.0, 20000.0)


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')), '') AS title, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1, 'i')) AS n_links,
  len(regexp_extract_all(html, '<h[1-3][^>]*>(.*?)</h[1-3]>', 1, 'is')) AS n_headings FROM pages""")
def html_extract(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", H.title(h).alias("title"), F.size(H.links(h)).cast("long").alias("n_links"), F.size(H.headings(h)).cast("long").alias("n_headings"))


@query("""SELECT l.user_id, count(*) AS n FROM events l WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = l.user_id AND c.c_acctbal >= 0) GROUP BY l.user_id""")
def archive_orphans(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "k")
    parents = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"))
    return boards.orphans(e, parents, "k").groupBy(F.col("k").alias("user_id")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, arg_max(event_id, epoch_us(ts)) AS event_id FROM events GROUP BY ALL")
def archive_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return boards.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("SELECT event_id FROM events WHERE epoch_us(ts) >= 1705276800000000 OR event_type = 'error'")
def archive_prune(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return boards.prune(e, 1705276800000000, "us", e.where("event_type = 'error'").select("event_id"), "event_id").select("event_id")
