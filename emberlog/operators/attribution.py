"""Attribution: which action an effect line belongs to, by interval and row-offset joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.config import DAMAGE
from emberlog.functions import text as T
from emberlog.functions.groups import per_group
from emberlog.functions.intervals import near_join
from emberlog.functions.tables import settled

# How far an attempt may lie from its result (seconds, rows).
CAST_BACK_S, INSTANT_BACK_S, INSTANT_BACK_ROWS = 6.5, 1.5, 4
AHEAD_S = 2.0
AHEAD_ROWS = ((3, 5.0), (2, 10.0))
# What counts as an attempt, casts that land at once, abilities whose effect line names them by a word, spells that interrupt by their debuff.
ATTEMPTS = ("status", "ability_hit", "ability_partial", "ability_miss", "melee_miss", "melee_hit", "cast")
INSTANT_CASTS = ("ground smash",)
PHRASES = {"scintillating shock": "scintillating", "scintillating stupor": "scintillating", "scintillation": "scintillating", "electric arc": "electric", "electric infusion": "electric"}
THROUGH, DEBUFF_S, CAST_MEMORY_S = {"interdiction": "condemned"}, 1.5, 12.0


def reach(dt, di, is_cast):
    """Whether an attempt at ``result - attempt`` = (dt seconds, di rows) can have caused the result."""
    back = F.when(is_cast, (dt >= 0) & (dt <= CAST_BACK_S)).otherwise((dt >= 0) & (dt <= INSTANT_BACK_S) & (di <= INSTANT_BACK_ROWS))
    ahead = (dt <= 0) & (di < 0) & ((-dt <= AHEAD_S) | ((-di <= AHEAD_ROWS[0][0]) & (-dt <= AHEAD_ROWS[0][1])) | ((-di <= AHEAD_ROWS[1][0]) & (-dt <= AHEAD_ROWS[1][1])))
    return back | ahead


def debuff_credit(events: DataFrame, hints: DataFrame, actions: tuple[str, ...] = ("cast", "status", "ability_hit", "debuff_cast")) -> DataFrame:
    """``(stream_id, seq, actor, skill, tier)``: the action each debuff line is credited to; lines without one have none.

    ``hints(outcome, skill, rank)`` names the skills of a debuff in order. Tier 0: a hinted skill on no or the same target;
    tier 1: a hinted skill on any; tier 2: an ability on the same victim. Then the hint's order, time and rows between.
    """
    d = events.where("kind = 'debuff' and outcome <> 'lockout'").select("stream_id", "seq", "ts", "target", "outcome")
    a = events.where(F.col("kind").isin(*actions) & F.col("actor").isNotNull() & ~T.is_npc(F.col("actor"))).select("stream_id", "seq", "ts", "kind", "actor", "target", "skill")
    j = near_join(d, a, ["stream_id"], "ts", back=max(CAST_BACK_S, 2.0), ahead=AHEAD_ROWS[1][1], left="d", right="a")
    j = j.where(reach(F.col("d.ts") - F.col("a.ts"), F.col("d.seq") - F.col("a.seq"), F.col("a.kind") == "cast"))
    h = hints.select(F.col("outcome").alias("_o"), F.col("skill").alias("_s"), F.col("rank").alias("_r"))
    j = j.join(h, (F.col("d.outcome") == F.col("_o")) & (F.col("a.skill") == F.col("_s")), "left")
    same = F.col("a.target").eqNullSafe(F.col("d.target"))
    tier = F.when(F.col("_r").isNotNull() & (F.col("a.target").isNull() | same), 0).when(F.col("_r").isNotNull(), 1).when((F.col("a.kind") == "ability_hit") & same, 2)
    j = j.withColumn("tier", tier).where("tier is not null")
    w = Window.partitionBy("d.stream_id", "d.seq").orderBy("tier", F.coalesce("_r", F.lit(1 << 20)), F.abs(F.col("d.ts") - F.col("a.ts")), F.abs(F.col("d.seq") - F.col("a.seq")), F.col("a.seq"))
    return j.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(F.col("d.stream_id"), F.col("d.seq"), F.col("a.actor"), F.col("a.skill"), "tier")


def last_cast(events: DataFrame, within_s: float = 12.0) -> DataFrame:
    """Interrupt lines with the victim's last cast of the last ``within_s`` seconds: an as-of join as one window."""
    e = events.where(F.col("kind").isin("cast", "interrupt") & F.col("actor").isNotNull())
    w = Window.partitionBy("stream_id", "actor").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_c", F.last(F.when(F.col("kind") == "cast", F.struct("ts", "skill", "seq")), True).over(w))
    ok = F.col("ts") - F.col("_c.ts") <= within_s
    return e.where("kind = 'interrupt'").select("stream_id", "seq", "actor", F.when(ok, F.col("_c.skill")).alias("skill"), F.when(ok, F.col("_c.seq")).alias("cast_seq"))


def skill_key(skill: Column) -> Column:
    """An ability's name as control tables hold it: lower case, without a rank numeral."""
    return F.lower(F.regexp_replace(F.trim(skill), r"\s+(?:VI{0,3}|I{1,3}|I[VX]|X)$", ""))


def with_categories(rows: DataFrame, skills: DataFrame) -> DataFrame:
    """``rows`` with ``cats``, the categories that ``skills(skill, category)`` gives their ability, by its name or by its name without a tier in front; null for none."""
    table = skills.select(skill_key(F.col("skill")).alias("_k"), "category").groupBy("_k").agg(F.sort_array(F.collect_set("category")).alias("_c"))
    key = skill_key(F.col("skill"))
    r = rows.withColumn("_key", key).withColumn("_bare", F.regexp_replace(key, r"^(?:lesser|greater|exceptional|minor|major)\s+", ""))
    r = r.join(table, F.col("_key") == F.col("_k"), "left").withColumnRenamed("_c", "_c1").drop("_k")
    r = r.join(table, F.col("_bare") == F.col("_k"), "left").drop("_k")
    return r.withColumn("cats", F.coalesce("_c1", "_c")).drop("_key", "_bare", "_c1", "_c")


def one_name(a: Column, b: Column) -> Column:
    """Whether two names may be readings of one."""
    return F.coalesce((a == b) | T.close_spellings(F.lower(a), F.lower(b)), F.lit(False))


def control_pairs(rows: DataFrame, skills: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, seq, category, tier, near, lines, attempt, actor, skill, single)``: every attempt that may explain a control line, and how well.

    An attempt is a use of a known ability by somebody; a cast or one without a target may hold several. It lies in reach, has the line's category (a stun
    also stops a cast), is aimed at the victim or at nobody, at a player only where the two fight, names the line's phrase if it has one, and is no older than the cast that it
    stops unless it is a cast itself. Tier 0 has the phrase's first word in its name, 1 the category and the victim, 2 the category.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    e = settled(rows.withColumn("_i", F.row_number().over(w)))
    fades = (F.col("kind") == "cc_fade") | ((F.col("kind") == "status") & F.coalesce(F.col("outcome") == "fade", F.lit(False)))
    a = with_categories(e.where(~fades & F.col("kind").isin(*ATTEMPTS) & F.col("actor").isNotNull() & F.col("skill").isNotNull()), skills).where("cats is not null")
    cast = (F.col("kind") == "cast") & ~F.lower("skill").isin(*INSTANT_CASTS)
    a = a.select(*keys, "seq", "ts", "_i", "actor", "target", "skill", F.lower("skill").alias("_low"), "cats", ((F.col("kind") == "cast") | F.col("target").isNull()).alias("multi"), cast.alias("cast"))
    began = F.last(F.when(F.col("kind") == "cast", F.struct("ts", "_i")), True).over(Window.partitionBy(*keys, "actor").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_began", F.when((F.col("kind") == "interrupt") & F.col("actor").isNotNull(), began))
    stopped = F.col("kind") == "interrupt"
    held = (F.col("kind") == "cc") & F.col("outcome").isNotNull() & (F.coalesce(F.col("skill"), F.lit("")) != "webs")
    r = e.where(stopped | held).select(*keys, "seq", "ts", "_i", F.when(stopped, F.col("actor")).otherwise(F.col("target")).alias("victim"), F.when(stopped, F.lit("interrupt")).otherwise(F.col("outcome")).alias("category"),
                                       F.when(~stopped, F.lower("skill")).alias("source"), F.when(F.col("ts") - F.col("_began.ts") <= CAST_MEMORY_S, F.col("_began._i")).alias("since"))
    j = near_join(r, a, keys, "ts", back=CAST_BACK_S, ahead=AHEAD_ROWS[1][1], left="r", right="a")
    dt, di = F.col("r.ts") - F.col("a.ts"), F.col("r._i") - F.col("a._i")
    before = F.when(F.col("a.cast"), (di > 0) & (dt >= 0) & (dt <= CAST_BACK_S)).when(di >= 0, (dt <= INSTANT_BACK_S) & (di <= INSTANT_BACK_ROWS))
    after = (-dt <= AHEAD_S) | ((-di <= AHEAD_ROWS[0][0]) & (-dt <= AHEAD_ROWS[0][1])) | ((-di <= AHEAD_ROWS[1][0]) & (-dt <= AHEAD_ROWS[1][1]))
    own = F.array_contains("a.cats", F.col("r.category"))
    j = j.where(F.coalesce(before, after) & (own | ((F.col("r.category") == "interrupt") & F.array_contains("a.cats", "stun"))))
    aimed = one_name(F.col("a.target"), F.col("r.victim"))
    j = j.where(F.col("a.target").isNull() | F.col("a.multi") | aimed)
    # a phrase of the ability's own, or none
    phrase = F.lit(True)
    for name, word in PHRASES.items():
        phrase = F.when(F.contains("a._low", F.lit(name)), F.coalesce(F.contains("r.source", F.lit(word)), F.lit(False))).otherwise(phrase)
    j = j.where(phrase & ((F.col("r.category") != "interrupt") | F.col("r.since").isNull() | F.col("a.cast") | (F.col("a._i") > F.col("r.since"))))
    first = F.filter(F.split("r.source", " "), lambda x: ~x.isin("a", "an", "the", "by"))[0]
    tier = F.when(F.coalesce(F.contains("a._low", first), F.lit(False)), 0).when(own & aimed, 1).when(own, 2).otherwise(3)
    p = j.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col("r.seq").alias("seq"), F.col("r.ts").alias("ts"), F.col("r.category").alias("category"), F.col("r.victim").alias("victim"), tier.alias("tier"), F.abs(dt).alias("near"),
                 F.abs(di).alias("lines"), F.col("a.seq").alias("attempt"), F.col("a.actor").alias("actor"), F.col("a.skill").alias("skill"), F.col("a._low").alias("_low"), (~F.col("a.multi")).alias("single"), aimed.alias("_aimed"))
    p, rows = settled(p), e
    # players meet players only where they fight, and some spells interrupt only through their debuff on the victim
    foes = rows.where(F.col("kind").isin(*DAMAGE) & F.col("actor").isNotNull() & F.col("target").isNotNull()).select(*keys, "actor", F.col("target").alias("victim")).distinct().withColumn("_foe", F.lit(True))
    p = p.join(foes, [*keys, "actor", "victim"], "left")
    p = p.where(F.col("victim").isNull() | F.col("_aimed") | T.is_npc(F.col("actor")) | T.is_npc(F.col("victim")) | F.col("_foe").isNotNull())
    landed = rows.where("kind = 'debuff'").select(*keys, "ts", F.col("target").alias("victim"), F.col("outcome").alias("_debuff"))
    for name, debuff in THROUGH.items():
        needs = (F.col("category") == "interrupt") & F.contains("_low", F.lit(name))
        shown = near_join(p.where(needs).select(*keys, "ts", "victim", "seq").distinct(), landed.where(F.col("_debuff") == debuff), [*keys, "victim"], "ts", back=DEBUFF_S, ahead=DEBUFF_S, left="p", right="d")
        shown = shown.select(*[F.col(f"p.{k}").alias(k) for k in keys], F.col("p.seq").alias("seq")).distinct().withColumn("_shown", F.lit(True))
        p = p.join(shown, [*keys, "seq"], "left").where(~needs | F.col("_shown").isNotNull()).drop("_shown")
    return p.select(*keys, "seq", "category", "tier", "near", "lines", "attempt", "actor", "skill", "single")


def control_credit(rows: DataFrame, skills: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, seq, category, actor, skill, attempt)``: who each control line is credited to; lines that nothing explains have no row.

    Lines are decided in their order, each by its best attempt in ``control_pairs``. An attempt on one target explains each category once. Only ranked pairs of
    a key reach Python, where the spent ones are skipped. Null actors and targets are nobody.
    """
    pairs = control_pairs(rows, skills, keys)

    def rule(g: list[tuple]) -> list[tuple]:
        spent, decided, out = set(), set(), []
        for seq, category, _, _, _, attempt, actor, skill, single in g:
            if seq not in decided and (attempt, category) not in spent:
                decided.add(seq)
                out.append((seq, category, actor, skill, attempt))
                if single:
                    spent.add((attempt, category))
        return out

    return per_group(pairs, keys, ["seq", "tier", "near", "lines", "attempt"], rule, "seq long, category string, actor string, skill string, attempt long")
