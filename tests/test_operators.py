import random

from emberlog.functions.groups import per_group, spaced
from emberlog.operators import attribution, encounters as E, metrics as M, resolve, roster, session, triggers
from emberlog.operators.parse import parse

LINES = [
    (50.0, "You slash a mossy crawler for 7 points of damage."), (51.0, "You try to slash a mossy crawler, but miss!"), (53.0, "Quenna's Ember Bolt hits a mossy crawler for 12 points of Fire Damage."),
    (54.0, "a mossy crawler bites YOU for 4 points of damage."), (56.0, "Quenna's Balm heals you for 9 Health."), (58.0, "You slash a mossy crawler for 17 points of damage."),
    (58.0, "a mossy crawler has been slain by You!"),
]


def test_a_fight_gives_the_hand_worked_table(spark):
    lines = spark.createDataFrame([("s", i, t, x) for i, (t, x) in enumerate(LINES)], "stream_id string, seq long, ts double, text string")
    assigned = E.assign_encounters(parse(lines), 12.0).cache()
    rows = {r.actor: r for r in M.actor_table(E.encounter_rows(assigned)).collect()}
    you, ally = rows["You"], rows["Quenna"]
    assert (you.damage, you.hits, you.misses, you.hit_pct, you.max_hit, you.avg_hit, you.dps) == (24, 2, 1, 66.67, 17, 12.0, 3.0)
    assert (ally.damage, ally.heals, ally.dps) == (12, 9, 1.5)
    assert [(r.damage, r.dps) for n, r in rows.items() if "crawler" in n] == [(4, 0.5)]
    head = E.encounters(assigned).first()
    assert (head.start, head.end, head.n_events, head.kills) == (50.0, 58.0, 7, 1)


def test_labels_spread_in_whole_waves():
    who = lambda edges, **k: M.classify(edges, {n for e in edges for n in e}, "You", k.get("members", set()), set(), k.get("owners", {}))
    edges = [("Bo", "a rat"), ("Xi", "Bo"), ("Xi", "a wolf")]
    assert who(edges) == who(edges[::-1]) == ({"a rat", "a wolf"}, {"You"})
    assert who(edges, members={"Bo"}) == ({"a rat", "a wolf", "Xi"}, {"You", "Bo"})
    assert who([("You", "Mok"), ("Mok", "Ann"), ("Ann", "Rex")]) == ({"Mok", "Rex"}, {"You"})
    assert who([("Pip", "a rat")], owners={"Pip": "You"}) == ({"a rat"}, {"You", "Pip"})
    assert who([]) == (set(), {"You"})


def test_names_are_similar_by_two_words_and_by_folded_letters():
    alike = lambda a, b: resolve.similar(resolve.folded_name(a), resolve.folded_name(b))
    assert not alike("a", "a rat") and not alike("Bo", "Bo Derek") and alike("a mossy", "a mossy crawler")
    assert alike("a risen officer", "a risen omcer") and alike("Dovin", "Poyln") and not alike("a rat", "a wolf")
    assert resolve.canonical([("a mossy crawler", 6), ("a mossy prowler", 4), ("a mossy crawlerj", 1)]) == {"a mossy crawler": "a mossy crawler", "a mossy prowler": "a mossy prowler", "a mossy crawlerj": "a mossy crawler"}


def events(spark, rows):
    return spark.createDataFrame(rows, "stream_id string, seq long, ts double, kind string, actor string, target string, amount long, skill string, outcome string, is_pet boolean")


def test_an_attempt_at_someone_else_is_not_credited(spark):
    bash = lambda i, t, actor, target: ("s", i, t, "status", actor, target, None, "Bash", None, False)
    stunned = lambda i, t: ("s", i, t, "cc", None, "a rat", None, None, "stun", False)
    e = events(spark, [bash(1, 2.0, "Bo", "a wolf"), bash(2, 2.0, "Al", "a rat"), stunned(3, 2.5), stunned(4, 2.6)])
    got = attribution.control_credit(e, spark.createDataFrame([("Bash", "stun")], "skill string, category string"), ["stream_id"])
    assert [(r.seq, r.actor, r.skill) for r in got.collect()] == [(3, "Al", "Bash")]


def test_the_gap_is_strict_and_context_does_not_extend(spark):
    hit = lambda i, t, kind="melee_hit": ("s", i, t, kind, "Bo", "a rat", 1, None, None, False)
    got = E.assign_encounters(events(spark, [hit(0, 0.0), hit(1, 12.0), hit(2, 20.0, "heal"), hit(3, 24.1), hit(4, 30.0)]), 12.0)
    assert [(r.seq, r.enc) for r in got.orderBy("seq").collect()] == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]


def test_sides_and_credit_and_names_by_group(spark):
    hit = lambda i, a, t, **k: ("s", i, float(i), k.get("kind", "melee_hit"), a, t, 1, k.get("skill"), k.get("outcome"), False)
    e = events(spark, [hit(0, "You", "Dark Elf"), hit(1, "Bo", "Dark Elf"), hit(2, "a rat", "Bo")])
    e = E.assign_encounters(e, 12.0)
    assert {r.name: r.side for r in M.sides(e, members=frozenset({"Bo"})).collect()} == {"You": "group", "Bo": "group", "Dark Elf": "enemy", "a rat": "enemy"}
    cc = E.assign_encounters(events(spark, [hit(0, "You", "a rat"), hit(1, "Bo", "a rat", kind="status", skill="Bash"), hit(2, None, "a rat", kind="cc", outcome="stun"), hit(3, None, "a rat", kind="cc", outcome="stun")]), 12.0)
    skills = spark.createDataFrame([("Bash", "stun")], "skill string, category string")
    assert [(r.seq, r.actor, r.skill) for r in attribution.control_credit(cc, skills, M.ENC).collect()] == [(2, "Bo", "Bash")]
    names = E.assign_encounters(events(spark, [hit(i, "You", "a stumbling zombie") for i in range(4)] + [hit(4, "You", "a stumbIing zombie")]), 12.0)
    assert {r.name: r.canonical for r in resolve.canonical_names(names, M.ENC).collect()}["a stumbIing zombie"] == "a stumbling zombie"


def test_groups_stream_in_order_and_take_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("x", 2, 5), ("x", 1, None), (None, 1, 7)], "k string, i int, v long")
    got = per_group(df, ["k"], ["i"], lambda g: [(len(g), g[0][1])], "n long, first long")
    assert sorted(map(str, got.collect())) == sorted(map(str, [*spark.createDataFrame([("x", 2, None), (None, 1, 7)], "k string, n long, first long").collect()]))
    assert per_group(df.limit(0), ["k"], ["i"], lambda g: [(1, 1)], "n long, first long").count() == 0


def test_a_clear_forgets_the_party(spark):
    text = ["Bo has joined the party.", "You have left the party.", "Al has joined the party.", "You invited Ed to your party.", "Ed has joined the party.", "Al has left the party."]
    ops = roster.evidence(spark.createDataFrame([("s", i, float(i), x) for i, x in enumerate(text)], "stream_id string, seq long, ts double, text string"))
    assert [r.name for r in roster.membership(ops).collect()] == ["Ed"]


def test_long_lines_match_and_long_patterns_do_not(spark):
    lines = spark.createDataFrame([("s", i, 0.0, "x" * (n - 8) + " the end") for i, n in enumerate([2048, 2049, 3000, 8192, 8193])], "stream_id string, seq long, ts double, text string")
    rules = spark.createDataFrame([(1, "contains", "the end", False), (2, "contains", "x" * 2049, False), (3, "exact", "x" * 2040 + " the end", False)], "rule_id long, mode string, pattern string, fuzzy boolean")
    assert sorted((r.seq, r.rule_id) for r in triggers.matches(lines, rules).collect()) == [(0, 1), (0, 3), (1, 1), (2, 1), (3, 1)]


def kept_one_by_one(times, gap):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] > gap:
            kept.append(t)
    return kept


def test_spaced_times_are_those_of_a_walk_through_each_key(spark):
    draw = random.Random(5)
    times = {k: [round(draw.uniform(0, reach), 1) for _ in range(n)] for k, n, reach in [("dense", 400, 300.0), ("thin", 40, 9000.0), ("one", 1, 1.0), (None, 30, 200.0)]}
    times["ties"] = [0.0, 30.0, 30.0, 60.0, 60.1, 90.1, 90.2]
    rows = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts] + [("dense", None)], "k string, ts double")
    for gap in (30.0, 0.5):
        got: dict = {}
        for r in spaced(rows, ["k"], gap).collect():
            got.setdefault(r.k, []).append(r.ts)
        assert {k: sorted(v) for k, v in got.items()} == {k: kept_one_by_one(v, gap) for k, v in times.items()}
    assert spaced(rows.limit(0), ["k"], 30.0).count() == 0


def test_repeated_deaths_count_once_and_every_npc_counts(spark):
    kill = lambda i, t, who, by="a rat": ("s", i, t, "kill", by, who, None, None, None, False)
    e = events(spark, [kill(0, 0.0, "Bo"), kill(1, 20.0, "Bo"), kill(2, 40.0, "Bo"), kill(3, 70.5, "Bo"), kill(4, 0.0, "a bat", "You"), kill(5, 0.0, "a bat", "You"), kill(6, 1.0, None)])
    assert {(r.victim, r.deaths) for r in M.deaths(e, ["stream_id"]).collect()} == {("Bo", 3), ("a bat", 2)}
    party, none = spark.createDataFrame([("Bo",), ("You",)], "name string"), spark.createDataFrame([], "pet string, owner string")
    got = session.classify_kills(e.selectExpr("*", "cast(null as string) as text"), party, none).orderBy("seq").collect()
    assert [r.verdict for r in got] == ["death", None, None, "death", "kill", "kill"]


def test_close_spellings_are_those_of_all_pairs(spark):
    draw = random.Random(7)
    base = ["".join(draw.choice("abcdel") for _ in range(draw.choice([2, 4, 5, 6, 8, 9, 12, 17, 20]))) for _ in range(40)] + ["aaaaa", "aaaaaaaaaa", "gray wolf pup", "a bat"]
    names = set(base)
    for b in base:
        for _ in range(3):
            x = list(b)
            for _ in range(draw.randint(1, 3)):
                at = draw.randrange(len(x))
                x[at:at + 1] = draw.choice([[], [draw.choice("abz ")], [x[at], "q"]])
                x = x or ["a"]
            names.add("".join(x))
    n = spark.createDataFrame([(x,) for x in sorted(names)] + [(None,), ("aaaaa",)], "name string")
    a, b = n.distinct().selectExpr("name as a"), n.distinct().selectExpr("name as b")
    near = resolve.T.close_spellings(resolve.F.lower("a"), resolve.F.lower("b"))
    want = {tuple(r) for r in a.crossJoin(b).where("a < b and length(a) > 1 and length(b) > 1 and abs(length(a) - length(b)) <= 3").where(near).collect()}
    got = [(r.a, r.b) for r in resolve.spelling_pairs(n).collect()]
    assert len(want) > 40 and len(got) == len(set(got)) and set(got) == want
