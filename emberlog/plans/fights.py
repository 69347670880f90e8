"""Queries over whole fights: the snapshot of an encounter, and who control lines are credited to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators import attribution, encounters as E, snapshot as S
from emberlog.plans.queries import ENC, EV, TIMEOUT, activity, query
from emberlog.plans.reading import HITS, hits

#: The viewer, a pet and the party.
YOU, MEMBERS, OWNERS = "Pb", frozenset({"Pc", "Pba", "Pca"}), {"Pd": "Pb"}
GROUP = "('Pb', 'Pc', 'Pba', 'Pca', 'Pd')"


def fights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as fights with kills, notices, and heals of the viewer and of creatures."""
    a = activity(spark, sf_dir)
    was, n = F.col("kind") == "heal", F.col("seq") % 4
    a = a.select("stream_id", "seq", "ts", F.when(was & (n == 0), "kill").when(was & (n == 1), "aggro").otherwise(F.col("kind")).alias("kind"), F.when(was & (n == 1), F.col("target")).otherwise(F.col("actor")).alias("actor"),
                 F.when(was & (n == 1), F.col("actor")).when(was & (n == 2), YOU).otherwise(F.col("target")).alias("target"), "amount", "skill", "is_pet")
    return E.encounter_rows(E.assign_encounters(a, TIMEOUT))


FIGHTS = EV + """, fv AS (SELECT stream_id, seq, ts, CASE WHEN kind = 'heal' AND seq % 4 = 0 THEN 'kill' WHEN kind = 'heal' AND seq % 4 = 1 THEN 'aggro' ELSE kind END AS kind,
  CASE WHEN kind = 'heal' AND seq % 4 = 1 THEN target ELSE actor END AS actor, CASE WHEN kind = 'heal' AND seq % 4 = 1 THEN actor WHEN kind = 'heal' AND seq % 4 = 2 THEN 'Pb' ELSE target END AS target, amount, skill FROM ev)""" + ENC[len(EV):].replace(
    "FROM ev)", "FROM fv)", 1).split(",\nheads AS")[0]
SIDE = "CASE WHEN {0} IN " + GROUP + " THEN 'group' WHEN {0} LIKE 'a %' THEN 'enemy' ELSE 'other' END"
OWNER = "CASE WHEN {0} = 'Pd' THEN 'Pb' ELSE {0} END"
KEYED = "CASE WHEN actor = 'Pd' THEN 'Pd: ' || skill ELSE skill END"
K = "stream_id, zone_epoch, enc"
HEADS = f"""h AS (SELECT {K}, string_agg(DISTINCT CASE WHEN kind IN ('melee_hit', 'ability_hit', 'melee_miss', 'kill') AND target LIKE 'a %' THEN target END, ', ' ORDER BY CASE WHEN kind IN ('melee_hit', 'ability_hit', 'melee_miss', 'kill') AND target LIKE 'a %' THEN target END) AS label,
  min(CASE WHEN act THEN ts END) AS start, max(CASE WHEN act THEN ts END) AS stop, min(CASE WHEN act AND actor IN {GROUP} THEN ts END) AS a, max(CASE WHEN act AND actor IN {GROUP} THEN ts END) AS b, count(*) AS events,
  count(*) FILTER (WHERE kind = 'kill') AS kill_lines, CAST(coalesce(sum(amount) FILTER (WHERE kind IN ('melee_hit', 'ability_hit') AND actor IN {GROUP}), 0) AS BIGINT) AS group_damage,
  CAST(coalesce(sum(amount) FILTER (WHERE kind IN ('melee_hit', 'ability_hit')), 0) AS BIGINT) AS all_damage,
  bool_or(kind IN ('melee_hit', 'ability_hit', 'melee_miss', 'kill') AND actor IN {GROUP}) AS met, bool_or(kind = 'heal' AND actor IN {GROUP} AND actor <> target AND target = 'Pb' AND amount > 0) AS helped,
  bool_or(kind IN ('melee_hit', 'ability_hit', 'melee_miss', 'kill') AND actor = 'Pb') AS fought, bool_or(kind = 'aggro' AND target IN {GROUP}) AS drawn FROM r GROUP BY ALL),
hd AS (SELECT *, greatest(1.0, coalesce(b, stop) - coalesce(a, start)) AS duration, met OR (helped AND fought) OR drawn AS ours FROM h)"""


@query("WITH " + FIGHTS + ", " + HEADS + f""" SELECT {K}, label, start, stop AS "end", duration, events, kill_lines, group_damage, all_damage, round(group_damage / duration, 2) AS raid_dps, ours,
  CAST(0 AS BIGINT) AS unrecognized, CAST(0 AS BIGINT) AS estimated_amounts, CAST(0 AS BIGINT) AS delayed FROM hd""")
def fight_heads(spark, sf_dir):
    return S.snapshot(fights(spark, sf_dir), you=YOU, members=MEMBERS, owners=OWNERS)[0]


def _lists(keys: str) -> str:
    """The facts of participants and their lists as text, in SQL, by ``keys``."""
    on = f"USING ({keys}, name)"
    part = lambda name, where, who, key: f"""{name}0 AS (SELECT {keys}, {OWNER.format(who)} AS name, {key} AS key, count(*) FILTER (WHERE kind <> 'melee_miss') AS n, count(*) FILTER (WHERE kind = 'melee_miss') AS m,
  CAST(coalesce(sum(amount) FILTER (WHERE kind <> 'melee_miss'), 0) AS BIGINT) AS total, coalesce(max(amount) FILTER (WHERE kind <> 'melee_miss'), 0) AS best FROM z WHERE {where} GROUP BY ALL),
{name} AS (SELECT {keys}, name, CAST(sum(total) AS BIGINT) AS total, max(best) AS best, CAST(sum(n) AS BIGINT) AS n, string_agg(key || ':' || (n + m) || ':' || total || ':' || best || ':' || m, '; ' ORDER BY total DESC, key) AS list FROM {name}0 GROUP BY {keys}, name)"""  # noqa: E731
    hit = "kind IN ('melee_hit', 'ability_hit')"
    return f"""nm AS (SELECT DISTINCT {keys}, {OWNER.format('name')} AS name FROM (SELECT {keys}, unnest([actor, target]) AS name FROM z) WHERE name IS NOT NULL),
{part("sk", f"{hit} OR kind = 'melee_miss'", "actor", KEYED)},
{part("tk", hit, "target", "actor || ': ' || skill")},
{part("hl", "kind = 'heal' AND target NOT LIKE 'a %'", "actor", KEYED)},
eh AS (SELECT {keys}, {OWNER.format('actor')} AS name, CAST(sum(amount) AS BIGINT) AS enemy_heals FROM z WHERE kind = 'heal' AND target LIKE 'a %' GROUP BY ALL),
hd0 AS (SELECT {keys}, {OWNER.format('target')} AS name, CAST(sum(amount) AS BIGINT) AS healed FROM z WHERE kind = 'heal' GROUP BY ALL),
sw AS (SELECT {keys}, {OWNER.format('actor')} AS name, count(*) FILTER (WHERE kind = 'melee_hit') AS hits, count(*) FILTER (WHERE kind = 'melee_miss') AS misses FROM z WHERE kind IN ('melee_hit', 'melee_miss') GROUP BY ALL),
ag AS (SELECT {keys}, {OWNER.format('target')} AS name, count(*) AS aggro FROM z WHERE kind = 'aggro' GROUP BY ALL),
dt0 AS (SELECT {keys}, target AS name, actor, count(*) AS n FROM z WHERE kind = 'kill' GROUP BY ALL),
dt AS (SELECT {keys}, name, CAST(sum(n) AS BIGINT) AS deaths, string_agg(actor || ':' || n, '; ' ORDER BY actor) AS killers FROM dt0 GROUP BY {keys}, name)
SELECT {keys}, name, {SIDE.format('name')} AS side, coalesce(sk.total, 0) AS damage, round(coalesce(sk.total, 0) / duration, 2) AS dps, coalesce(tk.total, 0) AS taken, coalesce(hl.total, 0) AS heals, coalesce(healed, 0) AS healed,
  coalesce(hits, 0) AS hits, coalesce(misses, 0) AS misses, CASE WHEN hits + misses > 0 THEN round(100.0 * hits / (hits + misses), 2) ELSE 0.0 END AS hit_pct, coalesce(sk.best, 0) AS max_hit,
  CASE WHEN sk.n > 0 THEN round(sk.total / sk.n, 2) ELSE 0.0 END AS avg_hit,
  round(coalesce(coalesce(sk.total, 0) * 1.0 / nullif(CASE WHEN {SIDE.format('name')} = 'group' THEN group_damage ELSE all_damage END, 0), 0.0), 6) AS share, coalesce(hl.best, 0) AS max_heal, coalesce(enemy_heals, 0) AS enemy_heals,
  coalesce(aggro, 0) AS aggro, coalesce(deaths, 0) AS deaths, coalesce(killers, '') AS killed_by, coalesce(aggro, 0) AS utility, coalesce(sk.list, '') AS skills, coalesce(hl.list, '') AS heal_skills, coalesce(tk.list, '') AS taken_from
FROM nm JOIN spans USING ({keys}) LEFT JOIN sk {on} LEFT JOIN tk {on} LEFT JOIN hl {on} LEFT JOIN eh {on} LEFT JOIN hd0 {on} LEFT JOIN sw {on} LEFT JOIN ag {on} LEFT JOIN dt {on}"""


def flat(p: DataFrame, keys: list[str]) -> DataFrame:
    """Participants with their lists and counts as text."""
    line = lambda x: F.concat(x["skill"], *[y for c in ("count", "total", "max_hit", "misses") for y in (F.lit(":"), x[c].cast("string"))])
    text = lambda c: F.array_join(F.transform(c, line), "; ")
    by = F.array_join(F.transform(F.map_entries("killed_by"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), "; ")
    return p.select(*keys, "name", "side", "damage", "dps", "taken", "heals", "healed", "hits", "misses", "hit_pct", "max_hit", "avg_hit", F.round("share", 6).alias("share"), "max_heal", "enemy_heals", "aggro", "deaths",
                    by.alias("killed_by"), "utility", text("skills").alias("skills"), text("heal_skills").alias("heal_skills"), text("taken_from").alias("taken_from"))


@query("WITH " + FIGHTS + ", " + HEADS + f", spans AS (SELECT {K}, duration, group_damage, all_damage FROM hd), z AS (SELECT * FROM r), " + _lists(K))
def fight_snapshot(spark, sf_dir):
    return flat(S.snapshot(fights(spark, sf_dir), you=YOU, members=MEMBERS, owners=OWNERS)[1], S.ENC)


@query("WITH " + FIGHTS + ", " + HEADS + ", spans AS (SELECT stream_id, zone_epoch, sum(duration) AS duration, CAST(sum(group_damage) AS BIGINT) AS group_damage, CAST(sum(all_damage) AS BIGINT) AS all_damage FROM hd WHERE ours GROUP BY ALL), "
       f"z AS (SELECT r.* FROM r JOIN hd USING ({K}) WHERE ours), " + _lists("stream_id, zone_epoch"))
def zone_snapshot(spark, sf_dir):
    return flat(S.zones(fights(spark, sf_dir), you=YOU, members=MEMBERS, owners=OWNERS), S.ENC[:2])


#: Of twelve lines: kind, skill, outcome; creatures are the victims, and the targets of what is aimed.
CONTROL = {0: ("cast", "Stun", None), 3: ("cc", None, "stun"), 4: ("cc", None, "stun"), 6: ("status", "Kick", None), 7: ("interrupt", None, None), 8: ("interrupt", None, None),
           9: ("ability_hit", "Scintillating Shock II", "hit"), 10: ("cc", "scintillating lights", "stun"), 11: ("cc", "clinging vines", "root")}
#: Which line each is credited to: a cast holds several, a stun stops a cast when the kick is spent, a phrase names its ability, and nothing explains the vines.
CREDITED = {3: 0, 4: 0, 7: 6, 8: 0, 10: 9}


@query("WITH " + HITS + ", m AS (SELECT *, n // 12 AS block, n % 12 AS k FROM hits), c(k, cause, category, skill) AS (VALUES " + ", ".join(
    f"({k}, {by}, '{'interrupt' if CONTROL[k][0] == 'interrupt' else CONTROL[k][2]}', '{CONTROL[by][1]}')" for k, by in CREDITED.items())
    + ") SELECT r.stream_id, r.seq, c.category, a.actor, c.skill, a.seq AS attempt FROM m r JOIN c ON r.k = c.k JOIN m a ON a.stream_id = r.stream_id AND a.block = r.block AND a.k = c.cause")
def cc_credit(spark, sf_dir):
    """Twelve lines of control a round, 0.7 seconds apart."""
    h = hits(spark, sf_dir).withColumn("k", F.col("n") % 12).withColumn("victim", F.element_at(F.array(F.lit("a rat"), F.lit("a wolf")), (F.floor(F.col("n") / 12) % 2 + 1).cast("int")))
    some = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in CONTROL.items() if v[i] for x in (k, v[i])]), F.col("k").cast("int"))
    kind = F.coalesce(some(0), F.lit("chat"))
    by = kind.isin("cast", "status", "ability_hit")
    rows = h.select("stream_id", "seq", (F.col("n") * 0.7).alias("ts"), kind.alias("kind"), F.when(kind == "interrupt", F.col("victim")).when(by, F.col("actor")).alias("actor"),
                    F.when((by & (kind != "cast")) | (kind == "cc"), F.col("victim")).alias("target"), some(1).alias("skill"), some(2).alias("outcome"))
    skills = spark.createDataFrame([("stun", "stun"), ("kick", "interrupt"), ("scintillating shock", "stun")], "skill string, category string")
    return attribution.control_credit(rows, skills, ["stream_id"])
