"""An encounter as one picture: a row for each participant with all measures, breakdowns and counts, and a head with label, times and totals.

Every event is first told as facts of its participants: ``(name, part, key, other)`` with additive numbers. Facts add up before they are shuffled,
so a participant of many events is a few rows; pets move to their owners and encounters merge into zones by renaming facts, not by merging
finished rows. The last step lays a participant's facts out as columns, maps and lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.config import ACTIVITY, DAMAGE, MISS
from emberlog.functions import text as T
from emberlog.functions.groups import spaced
from emberlog.functions.tables import settled
from emberlog.operators.metrics import ENC, sides

#: Kinds that show who met whom.
MET = ("melee_hit", "melee_miss", "ability_hit", "ability_miss", "resist", "kill")
#: Notices within this of a taunt of the same holder on the same foe are the taunt's own (seconds); a player's deaths within this are one.
TAUNT_S, DEATH_S = 3.0, 30.0
NUMBERS = ("n", "misses", "total", "best", "prevented", "estimated", "melee", "first", "last")
SUMMED = ("n", "misses", "total", "prevented", "estimated", "melee")


def fact(name: Column, part: str, key: Column, other: Column, on: Column, **numbers: Column) -> Column:
    """One fact, or null where ``on`` does not hold or nobody is named."""
    zero, none = F.lit(0).cast("long"), F.lit(None)
    values = [F.coalesce(numbers.get(c, zero).cast("long"), zero).alias(c) if c in SUMMED else numbers.get(c, none).cast("long" if c == "best" else "double").alias(c) for c in NUMBERS]
    return F.when(F.coalesce(on, F.lit(False)) & name.isNotNull(), F.struct(name.alias("name"), F.lit(part).alias("part"), key.cast("string").alias("key"), other.cast("string").alias("other"), *values))


def facts(rows: DataFrame, credits: DataFrame | None = None, keys: list[str] = ENC) -> DataFrame:
    """``(keys, name, part, key, other, numbers)`` of an encounter's events; names are canonical.

    Parts: ``skill`` (what an actor used), ``taken`` (from ``attacker: skill``), ``heal`` (with whom it was for), ``healed``, ``met``, ``death`` (by killer), ``aggro``,
    ``taunt``, ``seen`` and, from ``credits(keys, actor, part, key, skill)``, ``cc`` and ``debuff`` with their skills. Null names are nobody,
    null amounts nothing. An amount that is estimated is never the largest.
    """
    has = set(rows.columns)
    col = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in has else F.lit(d)
    k, a, t, none = F.col("kind"), F.col("actor"), F.col("target"), F.lit(None).cast("string")
    skill = F.coalesce(F.nullif(F.trim("skill"), F.lit("")), F.lit("melee"))
    hit, missed, amount, est = k.isin(*DAMAGE), k.isin(*MISS), F.coalesce("amount", F.lit(0)), col("estimated", False)
    one, best, act = F.lit(1), F.when(~est, amount), k.isin(*ACTIVITY)
    told = [
        fact(a, "skill", skill, none, hit | missed, n=hit.cast("int"), misses=missed.cast("int"), total=F.when(hit, amount), best=F.when(hit, best), estimated=(hit & est).cast("int"),
             melee=F.when(k == "melee_hit", 1).when(k == "melee_miss", 1 << 32), first=F.when(act, F.col("ts")), last=F.when(act, F.col("ts"))),
        fact(t, "taken", F.concat(F.coalesce(a, F.lit("?")), F.lit(": "), skill), none, hit, n=one, total=amount, best=best, prevented=col("absorbed", 0) + col("blocked", 0)),
        fact(t, "taken", F.concat(F.lit("environment: "), F.coalesce("skill", F.lit("damage"))), none, k == "env_damage", n=one, total=amount, best=amount),
        fact(a, "heal", skill, t, k == "heal", n=one, total=amount, best=best, estimated=est.cast("int")),
        fact(t, "healed", none, none, k == "heal", total=amount),
        fact(a, "met", none, t, k.isin(*MET) & (a != t), n=act.cast("int")), fact(t, "met", none, a, k.isin(*MET) & (a != t)),
        fact(t, "seen", none, none, k.isin("melee_miss", "debuff", "cc", "aggro", "status")), fact(a, "seen", none, none, k.isin("aggro", "interrupt")),
        fact(a, "pet", none, none, col("is_pet", False)),
    ]
    out = rows.select(*keys, F.explode(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")
    for more in (deaths(rows, keys), notices(rows, keys)):
        out = out.unionByName(more)
    if credits is not None:
        c = [fact(F.col("actor"), p, F.col("key"), F.col("skill"), F.col("part") == p, n=one) for p in ("cc", "debuff")]
        out = out.unionByName(credits.select(*keys, F.explode(F.filter(F.array(*c), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*"))
    return added(out, keys)


def added(f: DataFrame, keys: list[str]) -> DataFrame:
    """Equal facts as one."""
    return f.groupBy(*keys, "name", "part", "key", "other").agg(*[F.sum(c).alias(c) for c in SUMMED], F.max("best").alias("best"), F.min("first").alias("first"), F.max("last").alias("last"))


def deaths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Deaths with their killers: every one of a creature, of a player those more than half a minute after the last counted."""
    k = rows.where("kind = 'kill' and target is not null").select(*keys, "ts", F.col("target").alias("name"), F.coalesce("actor", F.lit("?")).alias("by"))
    players = k.where(~T.is_npc(F.col("name")))
    kept = spaced(players.select(*keys, "name", "ts"), [*keys, "name"], DEATH_S)
    first = players.groupBy(*keys, "name", "ts").agg(F.min("by").alias("by")).join(kept, [*keys, "name", "ts"])
    both = k.where(T.is_npc(F.col("name"))).select(*keys, "name", "by").union(first.select(*keys, "name", "by"))
    return both.select(*keys, fact(F.col("name"), "death", F.col("by"), F.lit(None), F.lit(True), n=F.lit(1)).alias("x")).select(*keys, "x.*")


def notices(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whom creatures looked angry at: reported taunts, and notices that no taunt within the seconds before explains. Creatures hold nobody."""
    player = lambda c: ~T.is_npc(F.col(c))
    taunt = rows.where((F.col("kind") == "status") & F.lower("skill").isin("taunt", "taunts") & F.col("target").isNotNull() & player("actor"))
    angry = rows.where((F.col("kind") == "aggro") & player("target"))
    t = taunt.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("actor").alias("_a"), F.col("target").alias("_t"), F.col("ts").alias("_ts"), F.col("seq").alias("_seq"))
    same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in keys])
    explained = same & (F.col("target") == F.col("_a")) & (F.col("actor") == F.col("_t")) & (F.col("_seq") < F.col("seq")) & (F.col("ts") - F.col("_ts") <= TAUNT_S)
    alone = angry.join(t, explained, "left_anti")
    one, none = F.lit(1), F.lit(None)
    told = lambda df, c, parts: df.select(*keys, F.explode(F.array(*[fact(F.col(c), p, none, none, F.lit(True), n=one) for p in parts])).alias("x")).select(*keys, "x.*")
    return told(taunt, "actor", ("aggro", "taunt")).union(told(alone, "target", ("aggro",)))


def with_sides(f: DataFrame, rows: DataFrame, you: str, members: frozenset[str] = frozenset(), excluded: frozenset[str] = frozenset(), owners: dict[str, str] | None = None) -> DataFrame:
    """Facts with ``side`` and ``other_side`` (enemy, group, other), and whether ``other`` fought: ``fought``.

    Whoever fought nobody is an enemy as a creature, of the group as a member; heals on enemies by others than enemies are part ``enemy_heal``.
    """
    owners = dict(owners or {})
    group = (({you} | set(members)) - set(excluded) - set(owners)) | {p for p, o in owners.items() if o in (({you} | set(members)) - set(excluded))}
    found = sides(rows, you, frozenset(members), frozenset(excluded), owners)
    # in the fight or not, the fixed sides are known by name alone
    alone = lambda c: F.when(c.isin(*sorted(group)), "group").when(T.is_npc(c) & ~c.isin(*sorted(owners)), "enemy").otherwise("other")
    out = f
    for c, to in (("name", "side"), ("other", "other_side")):
        s = found.select(*ENC, F.col("name").alias(c), F.col("side").alias(f"_{to}"))
        out = out.join(s, [*ENC, c], "left").withColumn(to, F.coalesce(f"_{to}", F.when(F.col(c).isNotNull(), alone(F.col(c))))).drop(f"_{to}")
    fought = f.where("part = 'met'").select(*ENC, F.col("name").alias("other")).distinct().withColumn("fought", F.lit(True))
    out = out.join(fought, [*ENC, "other"], "left").withColumn("fought", F.coalesce("fought", F.lit(False)))
    lost = (F.col("part") == "heal") & (F.col("side") != "enemy") & (F.col("other_side") == "enemy")
    return out.withColumn("part", F.when(lost, "enemy_heal").otherwise(F.col("part")))


def under_owners(f: DataFrame, owners: dict[str, str]) -> DataFrame:
    """A pet's facts as its owner's; its skills keep its name in front."""
    if not owners:
        return f
    of = F.create_map(*[F.lit(x) for kv in owners.items() for x in kv])
    owner = F.try_element_at(of, F.col("name"))
    named = F.col("part").isin("skill", "heal", "enemy_heal")
    f = f.withColumn("key", F.when(owner.isNotNull() & named, F.concat("name", F.lit(": "), "key")).otherwise(F.col("key")))
    f = f.withColumn("name", F.coalesce(owner, "name"))
    # who is a pet's owner is on its side and no pet
    return f.where(~((F.col("part") == "pet") & F.col("name").isin(*sorted(owners.values()))))


def of(part: str, c: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("part") == part, F.col(c))), F.lit(0))


def breakdown(part: str) -> Column:
    """A participant's list of one part, the largest total first."""
    x = F.collect_list(F.when(F.col("part") == part, F.struct((-F.col("total")).alias("_o"), F.col("key").alias("skill"), (F.col("n") + F.col("misses")).alias("count"), "total", F.coalesce("best", F.lit(0)).alias("max_hit"), F.col("n").alias("hits"), "misses")))
    avg = lambda s: F.when(s["hits"] > 0, F.round(s["total"] / s["hits"], 2)).otherwise(0.0)
    return F.transform(F.array_sort(x), lambda s: F.struct(s["skill"].alias("skill"), s["count"].alias("count"), s["total"].alias("total"), s["max_hit"].alias("max_hit"), avg(s).alias("avg"), s["hits"].alias("hits"), s["misses"].alias("misses")))


def counted(part: str, key: str = "key") -> Column:
    """A participant's counts of one part by key. Facts of one key with other partners are one entry."""
    pairs = F.collect_list(F.when((F.col("part") == part) & F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), F.col("n").alias("n"))))
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    total = lambda k: F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("k"), total(k).alias("n"))))


def participants(f: DataFrame, spans: DataFrame, keys: list[str] = ENC) -> DataFrame:
    """A row for each participant; ``spans(keys, duration, group_damage, all_damage)`` gives rates and shares.

    Shares are of the group's damage for its members, of all damage for others. Hits and misses are swings, abilities have neither; ``utility`` is what
    was controlled, weakened and drawn.
    """
    heal = added(f.where("part in ('heal', 'enemy_heal')").withColumn("other", F.lit(None).cast("string")).select(*keys, "name", "side", "part", "key", "other", *NUMBERS), [*keys, "side"])
    rest = f.where("part not in ('heal', 'enemy_heal')").select(*keys, "side", "name", "part", "key", "other", *NUMBERS)
    low = lambda c: F.col(c) % F.lit(1 << 32)
    g = rest.unionByName(heal).groupBy(*keys, "name").agg(
        F.max("side").alias("side"), F.coalesce(F.bool_or(F.col("part") == "pet"), F.lit(False)).alias("is_pet"),
        of("skill", "total").alias("damage"), of("skill", "n").alias("_n"), F.sum(F.when(F.col("part") == "skill", low("melee"))).alias("_hits"),
        F.sum(F.when(F.col("part") == "skill", F.floor(F.col("melee") / F.lit(1 << 32)))).alias("_misses"), F.coalesce(F.max(F.when(F.col("part") == "skill", F.col("best"))), F.lit(0)).alias("max_hit"),
        of("taken", "total").alias("taken"), of("taken", "prevented").alias("prevented"), of("heal", "total").alias("heals"), F.coalesce(F.max(F.when(F.col("part") == "heal", F.col("best"))), F.lit(0)).alias("max_heal"),
        of("enemy_heal", "total").alias("enemy_heals"), of("healed", "total").alias("healed"), F.coalesce(F.sum(F.when(F.col("part").isin("skill", "heal"), F.col("estimated"))), F.lit(0)).alias("estimated"),
        of("aggro", "n").alias("aggro"), of("taunt", "n").alias("taunts"), of("death", "n").alias("deaths"), of("cc", "n").alias("cc"), of("debuff", "n").alias("_debuffs"),
        breakdown("skill").alias("skills"), breakdown("heal").alias("heal_skills"), breakdown("taken").alias("taken_from"), counted("death").alias("killed_by"),
        counted("cc").alias("cc_types"), counted("cc", "other").alias("cc_skills"), counted("debuff").alias("debuffs"), counted("debuff", "other").alias("debuff_skills"))
    g = g.join(spans, keys)
    rate = lambda c: F.round(F.col(c) / F.col("duration"), 2)
    hits, misses = F.coalesce("_hits", F.lit(0)), F.coalesce(F.col("_misses"), F.lit(0)).cast("long")
    whole = F.when(F.col("side") == "group", F.col("group_damage")).otherwise(F.col("all_damage"))
    return g.select(*keys, "name", "side", "is_pet", "damage", rate("damage").alias("dps"), "taken", rate("taken").alias("dtps"), "heals", rate("heals").alias("hps"), "healed",
                    (hits + misses).alias("swings"), hits.alias("hits"), misses.alias("misses"), F.when(hits + misses > 0, F.round(100.0 * hits / (hits + misses), 2)).otherwise(0.0).alias("hit_pct"), "max_hit",
                    F.when(F.col("_n") > 0, F.round(F.col("damage") / F.col("_n"), 2)).otherwise(0.0).alias("avg_hit"), F.coalesce(F.try_divide(F.col("damage") * 1.0, whole).cast("double"), F.lit(0.0)).alias("share"),
                    "max_heal", "enemy_heals", "prevented", "estimated", "aggro", "taunts", "deaths", "killed_by", "cc", "cc_types", "cc_skills", "debuffs", "debuff_skills",
                    (F.col("cc") + F.col("_debuffs") + F.col("aggro")).alias("utility"), "skills", "heal_skills", "taken_from")


def heads(f: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each encounter: label, start, end, the group's fighting time, totals, whether it took part, and how well it was read.

    Times are those of the group's own swings and hits; a fight in which it has none keeps its own span. The label names the creatures in the fight and other
    enemies, never the group; without any, who was attacked.
    """
    ts = F.when(F.col("act"), F.col("ts"))
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False))) if c in rows.columns else F.lit(0).cast("long")
    own = rows.groupBy(*ENC).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("events"), F.count_if(F.col("kind") == "kill").alias("kill_lines"),
                                 F.count_if(F.col("kind").isin("unknown", "ability_partial")).alias("unrecognized"), flag("estimated").alias("estimated_amounts"), flag("estimated_ts").alias("delayed"),
                                 F.collect_set(F.when(F.col("act"), F.col("target"))).alias("_attacked"))
    part, side, other = F.col("part"), F.col("side"), F.col("other_side")
    group, met = side == "group", part == "met"
    npc = T.is_npc(F.col("name"))
    helped = (part == "heal") & group & (F.col("other") != F.col("name")) & F.col("fought") & (other != "enemy") & (F.col("total") > 0)
    g = f.groupBy(*ENC).agg(
        F.min(F.when(group & (part == "skill"), F.col("first"))).alias("_first"), F.max(F.when(group & (part == "skill"), F.col("last"))).alias("_last"),
        F.coalesce(F.sum(F.when(group & (part == "skill"), F.col("total"))), F.lit(0)).alias("group_damage"), of("skill", "total").alias("all_damage"),
        F.coalesce(F.bool_or((met & (group != (other == "group"))) | helped | (group & part.isin("cc", "debuff", "aggro"))), F.lit(False)).alias("ours"),
        F.array_sort(F.collect_set(F.when((met & npc) | ((side == "enemy") & ~npc), F.col("name")))).alias("_foes"), F.collect_set(F.when(group, F.col("name"))).alias("_group"))
    h = own.join(g, ENC)
    foes, attacked = F.array_except("_foes", "_group"), F.array_sort("_attacked")
    strangers = F.array_except(attacked, F.col("_group"))
    label = F.when(F.size(foes) > 0, F.array_join(foes, ", ")).when(F.size(strangers) > 0, F.array_join(strangers, ", ")).when(F.size(attacked) > 0, F.array_join(attacked, ", ")).otherwise("unknown")
    began, ended = F.coalesce("_first", "start"), F.coalesce("_last", "end")
    duration = F.greatest(F.lit(1.0), ended - began)
    return h.select(*ENC, label.alias("label"), "start", "end", duration.alias("duration"), "events", "kill_lines", "group_damage", "all_damage", F.round(F.col("group_damage") / duration, 2).alias("raid_dps"), "ours",
                    "unrecognized", "estimated_amounts", "delayed")


def told(rows: DataFrame, credits: DataFrame | None, you: str, members: frozenset[str], excluded: frozenset[str], owners: dict[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """Events and their facts with sides, each computed once."""
    rows = settled(rows)
    return rows, settled(with_sides(settled(facts(rows, credits)), rows, you, members, excluded, owners))


def snapshot(rows: DataFrame, *, you: str = "You", members: frozenset[str] = frozenset(), excluded: frozenset[str] = frozenset(), owners: dict[str, str] | None = None,
             credits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(heads, participants)`` of encounters, pets under their owners; ``owners`` and ``members`` are the roster at the end, a handful of names.

    An empty table gives two empty ones. Repeated events count each for itself. Events and facts are settled, as many steps use them.
    """
    rows, f = told(rows, credits, you, members, excluded, owners)
    h = heads(f, rows)
    spans = h.select(*ENC, "duration", "group_damage", "all_damage")
    return h, participants(under_owners(f, dict(owners or {})), spans)


def zones(rows: DataFrame, *, you: str = "You", members: frozenset[str] = frozenset(), excluded: frozenset[str] = frozenset(), owners: dict[str, str] | None = None,
          credits: DataFrame | None = None) -> DataFrame:
    """The encounters of a zone epoch that the group took part in as one: facts add up with their skills and counts, durations too; maxima stay."""
    rows, f = told(rows, credits, you, members, excluded, owners)
    h = heads(f, rows).where("ours")
    zone = ENC[:2]
    spans = h.groupBy(*zone).agg(F.sum("duration").alias("duration"), F.sum("group_damage").alias("group_damage"), F.sum("all_damage").alias("all_damage"))
    merged = under_owners(f.join(h.select(*ENC), ENC, "left_semi"), dict(owners or {}))
    side = merged.groupBy(*zone, "name").agg(F.max("side").alias("side"))
    together = added(merged.withColumn("other", F.when(F.col("part").isin("cc", "debuff"), F.col("other"))), zone)
    return participants(together.join(side, [*zone, "name"]), spans, zone)
