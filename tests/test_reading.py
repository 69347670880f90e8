"""Lines as they are read: run together, shown again, split over files, seen in frames."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog import plans
from emberlog.functions import text as T
from emberlog.operators import frames, fused, replay

LINES = "stream_id string, seq long, ts double, text string"
BEAST = "a mossy crawler"
FUSED = [
    (["Orrin's Ember Bolt hits a mossy crawler for 2 points of Fi:", "a mossy crawler's Gnash hits YOU for 12 points of damage."], ["ability_hit", "ability_hit"], [2, 12]),
    (["a mossy crawler's Gnash hits Quenna for 3 points of Holy", "a mossy crawler begins casting Balm."], ["ability_hit", "cast"], [3, None]),
    (["Orrin's Ember Bolt hits a mossy crawler for 41", "a mossy crawler hits Orrin for 3 points of damage."], ["ability_hit", "melee_hit"], [41, 3]),
    (["Unknown riddle: attack target", "You crush a rat for 10 points of damage."], ["unknown", "melee_hit"], [None, 10]),
    (["Your Ember Bolt wears off of a mossy crawler.", "Quenna hits a mossy crawler for 5 points of damage."], ["status", "melee_hit"], [None, 5]),
    (["You have slain a mossy crawler!", "You gain party experience!"], ["kill", "experience"], [None, None]),
    (["Your faction standing with the Millers cannot possibly get a", "You gain party experience!"], ["personal", "experience"], [None, None]),
    (["Quenna has slain a mossy crawlerl", "Stopped attacking."], ["kill", "status"], [None, None]),
    (["Quenna hits a rat for 5 points of damage.", "Orrin's Balm heals Quenna for 7 Health.", "You gain experience!", "a rat has been slain by Quenna!"], ["melee_hit", "heal", "experience", "kill"], [5, 7, None, None]),
    (["a mossy crawler scowls at you, ready to attack -- They look weak.", "You try to kick a mossy crawler, but miss!"], ["consider", "melee_miss"], [None, None]),
]
WHOLE = ["Your Ember Bolt hits a mossy crawler for 57 points of Holy Damage.", "a mossy crawler has been slain by Orrin!", "--Orrin loots [Bone Chips] from a mossy crawler's corpse.--",
         "Quenna's Balm heals Orrin for 56 Health.", "You try to crush a mossy crawler, but miss!", "Quenna says, \"You have slain a rat! You gain party experience!\"", "You have entered Lower Mills.",
         "a rat scowls at you, ready to attack -- Would you like to die?", "zzq 1 lorem", "", "GUILD MOTD: You gain party experience!"]


def test_messages_run_together_come_apart(spark):
    rows = [("s", i, 0.0, " ".join(parts)) for i, (parts, *_) in enumerate(FUSED)] + [("w", i, 0.0, x) for i, x in enumerate([*WHOLE, None])] + [("s", 0, 0.0, " ".join(FUSED[0][0]))]
    got: dict = {}
    for r in fused.parse_fused(spark.createDataFrame(rows, LINES).repartition(3)).collect():
        got.setdefault((r.stream_id, r.seq), []).append((r.part, r.text, r.kind, r.amount))
    for i, (parts, kinds, amounts) in enumerate(FUSED):
        found = sorted(got["s", i])[::2 if i == 0 else 1]  # the first line stands twice
        assert [(x[1], x[2]) for x in found] == list(zip(parts, kinds)), parts
        assert [x[3] for x in found if x[2] not in ("personal", "status")] == [a for a, k in zip(amounts, kinds) if k not in ("personal", "status")]
    for i, text in enumerate([*WHOLE, None]):
        assert [x[:2] for x in got["w", i]] == [(0, text)], text
    assert len(got) == len(FUSED) + len(WHOLE) + 1


def test_beginnings(spark):
    texts = ["Quenna hits a rat", "You gain experience!", "a mossy crawler's Gnash hits", "points of damage.", "Damage.", "Shock Quenna", "--Orrin loots", "Stopped attacking.", None, "", "Fire Damage"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(fused.starts_message(F.col("t"))).collect()]
    assert got == [True, True, True, False, False, False, True, True, False, False, False]


def norm(text):
    words = re.sub("[^0-9a-z]+", " ", re.sub("['’‘`]", "", text.lower())).split()
    return " ".join(w.translate(str.maketrans("ilo", "110")) if re.fullmatch("[0-9ilo]+", w) and re.search(r"\d", w) else w for w in words)


def numbers(n):
    return [{"i": "1", "l": "1", "o": "0"}.get(w) or re.sub(r"\D", "", w) for w in n.split() if {"i": "1", "l": "1", "o": "0"}.get(w) or re.search(r"\d", w)]


def test_compared_lines(spark):
    texts = ["For 1l points, Bo's", "lO i o 7o", "I point", "", "it is O", "don’t"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(T.compared(F.col("t")).alias("n"))
    got = df.select("n", T.numbers_of(F.col("n")).alias("m")).collect()
    assert [r.n for r in got] == [norm(x) for x in texts]
    assert [r.m for r in got] == [numbers(norm(x)) for x in texts]


def brute_replays(rows):
    """Every pair of equal-length windows is tried: the longest runs at each distance, then the rule in words."""
    n, norms = len(rows), [norm(t) for _, t in rows]
    same = lambda a, b: a == b or (numbers(a) == numbers(b) and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.85)
    out, done, i = set(), -1, 0
    while i < n:
        best = None
        for d in range(1, i + 1):
            k = i - d
            if norms[k] != norms[i] or not norms[i] or not (d <= 40 or rows[i][0] - rows[k][0] <= 60):
                continue
            a = i
            while a - 1 > done and a - 1 - d >= 0 and i - (a - 1) < d and same(norms[a - 1], norms[a - 1 - d]):
                a -= 1
            b = i
            while b + 1 < n and b + 1 - i < d and same(norms[b + 1], norms[b + 1 - d]):
                b += 1
            run = range(a, b + 1)
            copy, old = [rows[j][0] for j in run], [rows[j - d][0] for j in run]
            if len(run) >= 6 and (best is None or len(run) > len(best)) and len({norms[j] for j in run}) > 1 and max(copy) - min(copy) <= 1 and max(old) - min(old) >= max(copy) - min(copy) + 2 \
                    and copy[0] - old[0] >= 2 and all(norms[j] == norms[j - d] for j in run if re.search(r"\b(slain|loots?|coins?|split)\b", norms[j])):
                best = run
        if best:
            out |= set(best)
            done = best[-1]
            i = done
        i += 1
    return out


def noisy(r, text):
    at = r.randrange(len(text))
    return text[:at] + r.choice("abcdef ") + text[at + 1:]


def log(seed):
    r, rows, t = random.Random(seed), [], 0.0
    say = lambda: r.choice([f"Bo crushes a rat for {r.randint(1, 9)} points of damage.", "You gain party experience!", "a rat has been slain by Bo!", f"Quenna's Balm heals Bo for {r.randint(1, 3)} Health.", "Stopped attacking.", "Ann tries to kick a wolf, but misses!"])
    while len(rows) < 220:
        for _ in range(r.randint(3, 25)):
            t += r.choice([0.0, 0.2, 0.7, 1.5, 4.0])
            rows.append((t, say()))
        if r.random() < 0.8:
            size = r.randint(4, 14)
            back = r.randint(size, size + 15)
            block = rows[-back:len(rows) - back + size]
            t += r.choice([0.1, 3.0])
            rows += [(t + j * r.choice([0.0, 0.02, 0.3]), noisy(r, x) if r.random() < 0.15 else x) for j, (_, x) in enumerate(block)]
            t = rows[-1][0]
    return rows


def test_replays_equal_brute_force(spark):
    logs = {f"s{s}": log(s) for s in range(12)}
    block = [(i * 3.0, x) for i, x in enumerate(["A 1 x", "B 2 y", "A 1 x", "C 3 z", "A 1 x", "D 4 w", "B 2 y", "E"])]
    logs["twice"] = block + [(60.0, "F")] + [(61.0, x) for _, x in block]
    logs["slow"] = block + [(60.0 + 2 * i, x) for i, (_, x) in enumerate(block)]
    logs["few"] = block[:5] + [(61.0, x) for _, x in block[:5]]
    logs["kill"] = block + [(50.0, "a rat has been slain by Bo!")] + [(61.0, x) for _, x in block] + [(61.0, "a rot has been slain by Bo!")]
    rows = [(s, i, t, x) for s, lines in logs.items() for i, (t, x) in enumerate(lines)] + [("null", 0, 0.0, None), ("null", 1, 0.0, "")]
    random.Random(0).shuffle(rows)
    got: dict = {}
    for x in replay.replays(spark.createDataFrame(rows, LINES)).collect():
        got.setdefault(x.stream_id, set()).add(x.seq)
    want = {s: found for s, lines in logs.items() if (found := brute_replays(lines))}
    assert got == want
    assert "twice" in want and "slow" not in want and "few" not in want and "kill" not in want and sum(map(len, want.values())) > 60
    assert replay.replays(spark.createDataFrame([], LINES)).count() == 0


TAIL = [f"Bo crushes a rat for {i} points of damage." for i in range(1, 30)]


@pytest.mark.parametrize("head,want", [
    ([(0.0, x) for x in TAIL[-6:]] + [(0.5, "new 1"), (9.0, TAIL[-1])], [0, 1, 2, 3, 4, 5]),
    ([(0.0, "zz"), (0.0, "qq")] + [(0.0, x) for x in TAIL[-4:]], [2, 3, 4, 5]),
    ([(0.0, x) for x in TAIL[-6:-3]] + [(0.0, "new 7")] + [(0.0, x) for x in TAIL[-2:]], [0, 1, 2, 4, 5]),
    ([(0.0, x.replace("crushes", "crushcs")) for x in TAIL[-4:]], [0, 1, 2, 3]),
    ([(0.0, x) for x in TAIL[-12:-6]], []),
    ([(0.0, TAIL[-2]), (0.0, TAIL[-1])], []),
    ([(0.0, "new")] * 4 + [(0.0, x) for x in TAIL[-6:]], []),
    ([(0.0, TAIL[-5]), (0.0, TAIL[-4])] + [(5.0 + i, x) for i, x in enumerate(TAIL[-3:])], [0, 1, 2, 3, 4]),
    ([(0.0, TAIL[-5]), (0.0, TAIL[-4])] + [(5.0, "new")] + [(6.0, x) for x in TAIL[-3:]], []),
])
def test_backlog(head, want):
    tail = [(norm(x), numbers(norm(x))) for x in TAIL]
    assert replay.lined_up(tail, [(t, norm(x), numbers(norm(x))) for t, x in head]) == want


def test_files_are_united_in_the_order_of_their_times(spark):
    rows = [("s", "z", i, 1000.0 + i, x) for i, x in enumerate(TAIL)]
    rows += [("s", "a", i, 1100.0, x) for i, x in enumerate(TAIL[-5:])] + [("s", "a", 5, 1105.0, "You gain experience!")]
    rows += [("s", "m", 0, 40000.0, "You gain experience!"), ("s", "m", 1, 40001.0, None), ("s", "none", 0, None, "no time")]
    got = sorted(tuple(r) for r in replay.united(spark.createDataFrame(rows, "stream_id string, file string, line long, ts double, text string")).select("place", "line", "fresh").collect())
    assert got == [(1, i, True) for i in range(29)] + [(2, 5, False)] + [(3, 0, True), (3, 1, True)] + [(4, 0, True)]
    assert replay.united(spark.createDataFrame([], "stream_id string, file string, line long, ts double, text string")).count() == 0


def shown(seed, messages, height=9):
    """Frames over a list of messages: scrolling by 0 to 3 rows, one reading in six with a wrong letter, the first row cut."""
    r, top, out = random.Random(seed), 0, []
    while True:
        for _ in range(r.randint(2, 3)):
            out.append([(m if r.random() > 1 / 6 else noisy(r, m)) if i else m[:-7] for i, m in enumerate(messages[top:top + height])])
        if top + height >= len(messages):
            return out
        top = min(top + r.randint(1, 3), len(messages) - height)


def chat(seed, n=60):
    r = random.Random(seed)
    return [r.choice([f"{r.choice(['Bo', 'Ann'])} crushes a {r.choice(['rat', 'wolf'])} for {i + 100} points of damage.", f"Quenna's Balm heals Bo for {i + 100} Health.", f"You forage {i + 100} roots."]) for i in range(n)]


@pytest.fixture(scope="module")
def framed():
    rows, want = [], {}
    for s in range(4):
        want[f"s{s}"] = chat(s)
        for f, frame in enumerate(shown(s, want[f"s{s}"])):
            rows += [(f"s{s}", f, f * 0.25, 10, i * 20, 16, x) for i, x in enumerate(frame)]
    return rows, want


READ = "stream_id string, frame long, t double, x int, y int, h int, text string"


def test_frames_give_each_message_once(spark, framed):
    rows, want = framed
    got: dict = {}
    for r in frames.messages(frames.visual_rows(spark.createDataFrame(rows, READ))).orderBy("stream_id", "place").collect():
        got.setdefault(r.stream_id, []).append((r.place, r.text))
    for s, messages in want.items():
        assert [p for p, _ in got[s]] == list(range(len(messages)))
        right = sum(a == b for (_, a), b in zip(got[s], messages))
        assert right >= len(messages) - 2, s  # of a message in two readings none is right twice


def test_jumps_covers_and_parts(spark):
    a, b = [f"line {i} of the first part." for i in range(6)], [f"text {i + 50} of another one." for i in range(6)]
    rows = [("s", 0, 0.0, 10, i * 20, 16, x) for i, x in enumerate(a)] + [("s", 1, 1.0, 10, i * 20, 16, "li") for i in range(4)] + [("s", 2, 2.0, 10, i * 20, 16, x) for i, x in enumerate(a)]
    rows += [("s", 3, 3.0, 10, i * 20, 16, x) for i, x in enumerate(b)]
    rows += [("s", 4, 4.0, 10, i * 20, 16, x) for i, x in enumerate(b[1:])] + [("s", 4, 4.0, 200, 80, 15, "of two."), ("s", 4, 4.0, 10, 100, 16, None), ("s", 4, 4.0, 10, 120, 16, "|")]
    vis = frames.visual_rows(spark.createDataFrame(rows, READ)).cache()
    assert vis.where("frame = 1").count() == 0 and vis.where("frame = 4 and row = 4").first().text == "text 55 of another one. of two."
    got = frames.messages(vis).orderBy("place").collect()
    assert [r.place for r in got] == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10, 11]  # the jump's first row was shown once
    assert [r.text for r in got[:6]] == a and got[0].frames == 2


def test_streamed_frames_equal_the_batch_form(spark, framed, tmp_path):
    from emberlog import streaming as S

    rows, _ = framed
    vis = frames.visual_rows(spark.createDataFrame(rows, READ)).cache()
    want = sorted((r.stream_id, r.place, r.ts, r.text, r.frames) for r in frames.messages(vis).collect())
    end = spark.createDataFrame([(f"s{s}", 100000, 5000.0, 0, "the end 1", "the end 1") for s in range(4)], "stream_id string, frame long, t double, row long, text string, norm string")
    cols = ["stream_id", "frame", "t", "row", "text", "norm"]
    for i, part in enumerate((vis.where("frame < 20"), vis.where("frame >= 20"), end)):
        part.select(*[F.col(c).cast("long") if c in ("frame", "row") else F.col(c) for c in cols]).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(i)))
    read = spark.readStream.schema("stream_id string, frame long, t double, row long, text string, norm string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = S.seen_messages(read).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted(tuple(r) for r in spark.table("seen").collect()) == want


@pytest.mark.parametrize("name", ["fused_lines", "find_replays", "file_union", "frame_messages"])
def test_queries_are_registered_with_sql(name):
    assert name in plans.QUERIES and name in plans.SQL


def test_a_line_that_repeats_is_read_once(spark, monkeypatch):
    texts = ["Unknown riddle: attack target You crush a rat for 5 points of damage.", None, "", "Pa crushes a rat for 5 points of damage."]
    rows = [("s" if i % 2 else "t", i, i * 1.0, texts[i % 4]) for i in range(40)]
    one, seen = fused.parse, []
    monkeypatch.setattr(fused, "parse", lambda df, player: seen.append(df) or one(df, player))
    out = fused.parse_fused(spark.createDataFrame(rows, LINES))
    got = sorted((r.seq, r.stream_id, r.ts, r.part, r.kind) for r in out.collect())
    kinds = [["unknown", "melee_hit"], ["unknown"], ["unknown"], ["melee_hit"]]
    assert got == [(i, s, ts, p, kind) for s, i, ts, _ in sorted(rows, key=lambda r: r[1]) for p, kind in enumerate(kinds[i % 4])]
    assert seen[0].count() == 6  # two atoms make three stretches
    assert out.columns[:5] == ["stream_id", "seq", "ts", "kind", "text"] and out.columns[-1] == "part"
