"""Events mended by what earlier lines taught."""

import pytest

from emberlog.operators import completion
from emberlog.operators.parse import parse

C = "a mossy crawler"
#: Lines of a stream, and what the last of them gives.
COMPLETED = {
    "a clipped player": (["Quenna slashes a rat for 5 points of damage."] * 2 + ["uenna slashes a rat for 6 points of damage."], ("melee_hit", "Quenna", "a rat", 6)),
    "two letters": (["Quenna slashes a rat for 5 points of damage."] * 2 + ["enna's Balm heals a rat for 6 Health."], ("heal", "Quenna", "a rat", 6)),
    "three letters": (["Quenna slashes a rat for 5 points of damage."] * 2 + ["nna slashes a rat for 6 points of damage."], ("unknown", None, None, None)),
    "read once": (["Quenna slashes a rat for 5 points of damage.", "uenna slashes a rat for 6 points of damage."], ("unknown", None, None, None)),
    "read later": (["uenna slashes a rat for 6 points of damage."], ("unknown", None, None, None)),
    "an article": ([f"{C} bites Quenna for 5 points of damage."] * 2 + ["mossy crawler bites Quenna for 7 points of damage."], ("melee_hit", C, "Quenna", 7)),
    "the more frequent": (["Abo slashes a rat for 5 points of damage."] * 2 + ["Ebo slashes a rat for 5 points of damage."] * 3 + ["bo slashes a rat for 6 points of damage."], ("melee_hit", "Ebo", "a rat", 6)),
    "the earlier of equals": (["Ebo slashes a rat for 5 points of damage.", "Abo slashes a rat for 5 points of damage."] * 2 + ["bo slashes a rat for 6 points of damage."], ("melee_hit", "Ebo", "a rat", 6)),
    "still unread": (["Quenna slashes a rat for 5 points of damage."] * 2 + ["uenna zz 5 qq"], ("unknown", None, None, None)),
    "chat teaches nothing": (["Quenna says, 'hello'"] * 3 + ["uenna slashes a rat for 6 points of damage."], ("unknown", None, None, None)),
    "null": ([None], ("unknown", None, None, None)),
}


def streams(spark, cases):
    return parse(spark.createDataFrame([(s, i, float(i), x) for s, (lines, _) in cases.items() for i, x in enumerate(lines)], "stream_id string, seq long, ts double, text string"))


@pytest.fixture(scope="module")
def done(spark):
    return {(r.stream_id, r.seq): r for r in completion.completed(streams(spark, COMPLETED)).collect()}


@pytest.mark.parametrize("case", COMPLETED)
def test_names_are_completed_from_earlier_lines(done, case):
    lines, want = COMPLETED[case]
    r = done[case, len(lines) - 1]
    assert (r.kind, r.actor, r.target, r.amount) == want and r.text == lines[-1]
    assert sum(s == case for s, _ in done) == len(lines)


KILL, CAST = "You have slain a mossy crawler!", "Quenna begins casting Holy Strike."
REPAIRED = {
    "an end mark": ([KILL, "You have slain a mossy crawlerl"], ("kill", "You", C, None, None)),
    "a known longer name": (["You have slain a mossy crawlerl!", KILL, "You have slain a mossy crawlerl"], ("kill", "You", "a mossy crawlerl", None, None)),
    "an unknown stem": (["You have slain a mossy crawlerl"], ("kill", "You", "a mossy crawlerl", None, None)),
    "an attacker with an ability": (["Quenna's Holy Strike hits a rat for 5 points of Holy Damage.", "Orrin Holy Strike hits a rat for 7 points of Holy Damage."], ("ability_hit", "Orrin", "a rat", "Holy Strike", "hit")),
    "a name of two words": (["Toilmaster Verith hits a rat for 7 points of damage."], ("melee_hit", "Toilmaster Verith", "a rat", "hit", "hit")),
    "an attempt on the immune": (["a rat is temporarily IMMUNE to Quenna's Snaring Shot!", "Quenna snares a rat!"], ("status", "Quenna", "a rat", None, "immune")),
    "nothing": ([None], ("unknown", None, None, None, None)),
}


@pytest.fixture(scope="module")
def mended(spark):
    return {(r.stream_id, r.seq): r for r in completion.repaired_events(streams(spark, REPAIRED)).collect()}


@pytest.mark.parametrize("case", REPAIRED)
def test_events_are_repaired(mended, case):
    lines, want = REPAIRED[case]
    r = mended[case, len(lines) - 1]
    assert (r.kind, r.actor, r.target, r.skill, r.outcome) == want
    assert sum(s == case for s, _ in mended) == len(lines)


def test_attempts_on_the_immune_count_once(spark):
    rows = [("s", 0, 0.0, "status", "Quenna", "You", None, "immune", "You are temporarily IMMUNE to Quenna's Snaring Shot!"), ("s", 1, 1.0, "status", "You", "a rat", "Snaring Shot", None, "x"),
            ("s", 2, 1.5, "status", "You", "a rat", "Snaring Shot", None, "x"), ("t", 0, 0.0, "status", "Quenna", "You", None, "immune", "You are IMMUNE to Quenna's Net Shot!"), ("t", 1, 5.0, "status", "You", "a rat", "Net Shot", None, "x")]
    df = spark.createDataFrame(rows, "stream_id string, seq long, ts double, kind string, actor string, target string, skill string, outcome string, text string")
    got = {(r.stream_id, r.seq): (r.skill, r.outcome) for r in completion._immune(df).collect()}
    assert got["s", 1] == (None, "immune") and got["s", 2] == ("Snaring Shot", None) and got["t", 1] == ("Net Shot", None)


def test_empty_tables(spark):
    e = parse(spark.createDataFrame([], "stream_id string, seq long, ts double, text string"))
    assert completion.completed(e).count() == 0 and completion.repaired_events(e).count() == 0
