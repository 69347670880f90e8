"""Whole fights: snapshots, control credit, vocabularies and their veto."""

import pytest
from pyspark.sql import functions as F

from emberlog import plans
from emberlog.operators import attribution, encounters as E, resolve, snapshot as S, vocabulary as V
from emberlog.operators.parse import parse

LINES = [
    (50.0, "Quenna begins casting Stun."), (51.0, "You slash a mossy crawler for 10 points of damage."), (52.0, "a mossy crawler is stunned."), (53.0, "Your pet Pip bites a mossy crawler for 4 points of damage."),
    (54.0, "a mossy crawler bites YOU for 6 points of damage. (2 absorbed)"), (55.0, "Quenna's Balm heals you for 9 Health."), (56.0, "Zed's Ember Bolt hits a mossy crawler for 20 points of Fire Damage."),
    (57.0, "Quenna's Balm heals a mossy crawler for 5 Health."), (58.0, "You taunt a mossy crawler!"), (59.0, "a mossy crawler looks angry at You."), (63.0, "a mossy crawler looks angry at You."),
    (64.0, "Quenna has been slain by a mossy crawler!"), (70.0, "Quenna has been slain by a mossy crawler!"), (71.0, "Your Ember Bolt hits a mossy crawler for 30 points of Fire Damage."), (71.0, "a mossy crawler has been slain by You!"),
]
SCHEMA = "stream_id string, seq long, ts double, text string"
OWNERS = {"Pip": "You"}


@pytest.fixture(scope="module")
def fight(spark):
    lines = spark.createDataFrame([("s", i, t, x) for i, (t, x) in enumerate(LINES)], SCHEMA)
    return E.encounter_rows(E.assign_encounters(parse(lines), 30.0)).cache()


def test_a_snapshot_gives_the_hand_worked_fight(spark, fight):
    credits = spark.createDataFrame([("s", 0, 1, "Quenna", "cc", "stun", "Stun")], "stream_id string, zone_epoch int, enc int, actor string, part string, key string, skill string")
    heads, rows = S.snapshot(fight, members=frozenset({"Quenna"}), owners=OWNERS, credits=credits)
    h = heads.first()
    # the group fights from 51 to 71; Zed is a stranger
    assert (h.label, h.duration, h.group_damage, h.all_damage, h.raid_dps, h.ours, h.kill_lines) == ("a mossy crawler", 20.0, 44, 70, 2.2, True, 3)
    got = {r.name: r for r in rows.collect()}
    assert set(got) == {"You", "Quenna", "Zed", "a mossy crawler"}
    you, ally, foe, zed = got["You"], got["Quenna"], got["a mossy crawler"], got["Zed"]
    assert (you.side, you.damage, you.hits, you.max_hit, you.taken, you.prevented, you.healed, you.share, you.dps) == ("group", 44, 2, 30, 6, 2, 9, 1.0, 2.2)
    assert [(s.skill, s["count"], s.total) for s in you.skills] == [("Ember Bolt", 1, 30), ("slash", 1, 10), ("Pip: bite", 1, 4)]
    assert (you.aggro, you.taunts, you.utility) == (2, 1, 2)  # the notice right after the taunt is the taunt's
    assert (ally.heals, ally.enemy_heals, ally.deaths, dict(ally.killed_by), ally.cc, dict(ally.cc_types), dict(ally.cc_skills)) == (9, 5, 1, {"a mossy crawler": 1}, 1, {"stun": 1}, {"Stun": 1})
    assert (foe.side, foe.damage, foe.taken, foe.deaths, foe.healed) == ("enemy", 6, 64, 1, 5)
    assert [(t.skill, t.total) for t in foe.taken_from] == [("You: Ember Bolt", 30), ("Zed: Ember Bolt", 20), ("You: slash", 10), ("Pip: bite", 4)]
    assert (zed.side, zed.share) == ("other", 20 / 70)


def test_a_zone_adds_its_fights_up(spark, fight):
    two = fight.unionByName(fight.withColumn("enc", F.col("enc") + 1).withColumn("seq", F.col("seq") + 100).withColumn("ts", F.col("ts") + 500.0))
    one = {r.name: r for r in S.snapshot(fight, owners=OWNERS)[1].collect()}
    both = {r.name: r for r in S.zones(two, owners=OWNERS).collect()}
    assert set(one) == set(both)
    for name, r in one.items():
        b = both[name]
        assert (b.damage, b.hits, b.taken, b.heals, b.aggro) == (2 * r.damage, 2 * r.hits, 2 * r.taken, 2 * r.heals, 2 * r.aggro)
        assert (b.max_hit, b.avg_hit, b.dps, b.side) == (r.max_hit, r.avg_hit, r.dps, r.side)
        assert [(s.skill, s.total, s.max_hit) for s in b.skills] == [(s.skill, 2 * s.total, s.max_hit) for s in r.skills]
        assert dict(b.killed_by) == {k: 2 * n for k, n in r.killed_by.items()}


def test_fights_that_are_not_ours_and_empty_tables(spark, fight):
    others = fight.where("kind = 'ability_hit' and actor = 'Zed'")
    h = S.snapshot(others)[0].first()
    assert (h.ours, h.label, h.group_damage, h.duration) == (False, "a mossy crawler", 0, 1.0)
    heads, rows = S.snapshot(fight.where("false"))
    assert heads.count() == 0 and rows.count() == 0


SKILLS = [("kick", "interrupt"), ("Stun", "stun"), ("Net Shot", "interrupt"), ("Net Shot", "root"), ("gust of wind", "interrupt"), ("interdiction", "interrupt"), ("electric arc", "stun"), ("root", "root"), ("ground smash", "stun")]
A, B, C = "a rat", "a grey wolf", "Ann"


def kick(t, target=A, skill="Kick"):
    return t, "status", "You", target, skill, None


def stop(t, who=A):
    return t, "interrupt", who, None, None, None


def cast(t, skill="Stun"):
    return t, "cast", "You", None, skill, None


def stun(t, who=A, source=None):
    return t, "cc", None, who, source, "stun"


ARC = (1, "ability_hit", "You", A, "Electric Arc", "hit")
#: Events, and the (line, attempt, category) that they give.
CONTROL = {
    "in reach": ([kick(0), stop(1), kick(10), stop(11), kick(20), stop(26)], [(1, 0, "interrupt"), (3, 2, "interrupt")]),
    "the effect is often printed first": ([stop(0), kick(1.5)], [(0, 1, "interrupt")]),
    "aimed at another": ([kick(0, B), stop(1)], []),
    "spent": ([kick(0), stop(1), stop(1.2)], [(1, 0, "interrupt")]),
    "rank": ([kick(0, skill="Kick II"), stop(1)], [(1, 0, "interrupt")]),
    "tier": ([(0, "ability_hit", "You", A, "Greater Gust of Wind", None), stop(1)], [(1, 0, "interrupt")]),
    "misread": ([kick(0, "a grey wolv"), stop(1, B)], [(1, 0, "interrupt")]),
    "older than the cast": ([kick(0), (0.5, "cast", A, None, "Balm", None), stop(1)], []),
    "one cast holds several": ([cast(0), stun(5), stun(5, B), stun(7)], [(1, 0, "stun"), (2, 0, "stun")]),
    "no cast explains what was there before": ([stun(0), cast(1)], []),
    "a cast that lands at once does": ([stun(0), cast(1, "Ground Smash")], [(0, 1, "stun")]),
    "a stun stops a cast": ([cast(0), stop(3)], [(1, 0, "interrupt")]),
    "not a groupmate": ([cast(0), stun(3, C)], []),
    "but a foe": ([cast(0), (1, "melee_hit", "You", C, "slash", "hit"), stun(3, C)], [(2, 0, "stun")]),
    "phrase": ([stun(0.5, source="an electric arc"), ARC], [(0, 1, "stun")]),
    "no phrase": ([stun(0.5), ARC], []),
    "phrase before cast": ([cast(0), ARC, stun(1.5, source="an electric arc")], [(2, 1, "stun")]),
    "webs": ([(0, "cc", None, A, "webs", "root"), kick(0.5, skill="Root")], []),
    "through a debuff": ([cast(0, "Interdiction"), (3.5, "debuff", None, A, None, "condemned"), stop(4)], [(2, 0, "interrupt")]),
    "no debuff": ([cast(0, "Interdiction"), stop(4)], []),
    "each category once": ([kick(0, skill="Net Shot"), stop(0.5), (0.7, "cc", None, A, None, "root"), (0.8, "cc", None, A, None, "root")], [(1, 0, "interrupt"), (2, 0, "root")]),
    "fade": ([(0, "status", "You", A, "Kick", "fade"), stop(1)], []),
    "nobody": ([(0, "status", None, A, "Kick", None), stop(1), stop(2, None)], []),
}


@pytest.fixture(scope="module")
def credited(spark):
    rows = [(s, i, float(t), *rest) for s, (events, _) in CONTROL.items() for i, (t, *rest) in enumerate(events)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, ts double, kind string, actor string, target string, skill string, outcome string")
    got: dict = {}
    for r in attribution.control_credit(df, spark.createDataFrame(SKILLS, "skill string, category string"), ["stream_id"]).collect():
        got.setdefault(r.stream_id, []).append((r.seq, r.attempt, r.category))
    return got


@pytest.mark.parametrize("case", CONTROL)
def test_control_credit(credited, case):
    assert sorted(credited.get(case, [])) == CONTROL[case][1]


def counts(spark, rows):
    return spark.createDataFrame([("npc", n, k) for n, k in rows], "category string, name string, n long")


def test_spellings_are_grouped(spark):
    rows = [("a mossy crawler", 40), ("a mossy crawlcr", 3), ("a ossy crawler", 2), ("a jackal", 30), ("a jackal pup", 25), ("a jackaI", 2), ("a mossy sentinel", 20), ("a rat", 9), ("a bat", 8)]
    got = {r.name: r.canonical for r in V.spellings(counts(spark, rows)).collect()}
    crawler = "a mossy crawler"
    assert got == {crawler: crawler, "a mossy crawlcr": crawler, "a ossy crawler": crawler, "a jackal": "a jackal", "a jackal pup": "a jackal pup", "a jackaI": "a jackal", "a mossy sentinel": "a mossy sentinel",
                   "a rat": "a rat", "a bat": "a bat"}
    # the chat's words decide where counts do not
    words = spark.createDataFrame([("fighter", 50), ("fizhter", 1)], "word string, n long")
    close = counts(spark, [("a lost fizhter", 6), ("a lost fighter", 5)])
    assert {r.canonical for r in V.spellings(close, words).collect()} == {"a lost fighter"}
    assert {r.canonical for r in V.spellings(close).collect()} == {"a lost fizhter", "a lost fighter"}
    assert V.spellings(counts(spark, [])).count() == 0


def test_the_veto(spark):
    rows = [("a jackal", 30), ("a jackal pup", 25), ("a lost", 2), ("a lost fighter", 300), ("a lost cleric", 200), ("a lost fizhter", 1), ("a rare one", 3)]
    v = V.vocabulary(V.spellings(counts(spark, rows)))
    assert v.differ("a jackal", "a jackal pup") and v.differ("a lost fighter", "a lost cleric")
    assert not v.differ("a lost", "a lost fighter")  # a cut-off reading
    assert not v.differ("a lost fizhter", "a lost fighter") and not v.differ("a rare one", "a jackal") and not v.differ("nobody", "a jackal")
    # an encounter's names obey it
    assert resolve.canonical([("a jackal pup", 9), ("a jackal", 2)]) == {"a jackal pup": "a jackal pup", "a jackal": "a jackal pup"}
    assert resolve.canonical([("a jackal pup", 9), ("a jackal", 2)], v.differ) == {"a jackal pup": "a jackal pup", "a jackal": "a jackal"}
    assert resolve.canonical([("a lost fighter", 9), ("a lost", 2)], v.differ)["a lost"] == "a lost fighter"


def test_learning_and_shapes(spark):
    rows = [("melee_hit", "Quenna", "a rat", "slash", None), ("melee_hit", "You", "a rat is", "slash", None), ("loot", "Quenna", "a rat", None, "Tin Spoon."), ("chat", "Ann", None, None, None), ("zone", None, "Lower Mills", None, None),
            ("cast", "The", None, "Balm", None), ("cast", "Éloi", None, "Balm", None), ("melee_hit", None, None, None, None)]
    df = spark.createDataFrame(rows, "kind string, actor string, target string, skill string, item string")
    got = {(r.category, r.name): r.n for r in V.learned(df).collect()}
    assert got == {("player", "Quenna"): 2, ("npc", "a rat"): 2, ("item", "Tin Spoon"): 1, ("zone", "Lower Mills"): 1, ("skill", "Balm"): 2}
    folds = spark.createDataFrame([("Bé1an",), ("  A  B5.",), (None,)], "t string").select(V.folded(F.col("t")).alias("f")).collect()
    assert [r.f for r in folds] == ["belan", "a bs", None]
    kept = V.kept(counts(spark, [("a", 1), ("b", 2), ("c", 3), ("d", 3)]), top=2)
    assert {r.name for r in kept.collect()} == {"c", "d"}


@pytest.mark.parametrize("name", ["fight_heads", "fight_snapshot", "zone_snapshot", "cc_credit", "canonical_names", "vocabulary_clusters"])
def test_queries_are_registered_with_sql(name):
    assert name in plans.QUERIES and name in plans.SQL
