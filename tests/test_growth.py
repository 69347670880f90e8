"""Steps whose work must not grow faster than their input: what the plans must not hold, and the same results in other forms."""

from __future__ import annotations

import difflib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from emberlog.functions import tables, text as T
from emberlog.operators import encounters as E, frames, fused, messages as M, replay, resolve, session
from emberlog.operators.parse import parse


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_coin_received_looks_at_the_next_row_alone(spark):
    rows = [("s", 1, 0.0, "A", "coin", 10, None), ("s", 2, 1.0, "A", "coin_split", None, 4), ("s", 3, 2.0, "A", "coin", 7, None), ("s", 4, 9.0, "A", "coin_split", None, 3), ("s", 5, 10.0, "You", "coin", 5, None)]
    out = session.coin_received(spark.createDataFrame(rows, "stream_id string, seq long, ts double, actor string, kind string, copper long, split_copper long"))
    assert {r.seq: r.received for r in out.collect()} == {1: 4, 3: 0, 5: 5}
    assert "unboundedfollowing" not in plan(out)


def test_prefight_reads_backwards(spark):
    rows = [("s", i, float(i), k, "A", "a rat") for i, k in enumerate(["cast", "cast", "melee_hit", "cast"])]
    out = E.attach_prefight(E.assign_encounters(spark.createDataFrame(rows, "stream_id string, seq long, ts double, kind string, actor string, target string")))
    assert sorted((r.seq, r.enc, r.open_seq) for r in out.collect()) == [(0, 1, 2), (1, 1, 2)]
    assert "unboundedfollowing" not in plan(out)


def test_spelling_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 16, raising=False)
    names = [f"Supplier#{n:09d}" for n in range(0, 4000, 37)] + ["bob", "bobb", "Marrowa", "marrow", "Marow"]
    out = resolve.spelling_pairs(spark.createDataFrame([(n,) for n in names], "name string"))
    limit = lambda n: 0 if n < 5 else 1 if n <= 8 else 2 if n <= 16 else 3
    low = {n: n.lower() for n in names}
    want = sorted((a, b, distance(low[a], low[b])) for a in names for b in names if a < b and distance(low[a], low[b]) <= limit(min(len(a), len(b))))
    assert sorted(map(tuple, out.collect())) == want
    # numbered names all share their rarest pairs of letters, and stay dealt over many tasks
    assert out.rdd.getNumPartitions() > 4


def test_spelling_pairs_of_groups_never_meet(spark):
    names = [("x", "marrowa"), ("x", "marrowb"), ("y", "marrowc"), ("y", "gloomfen"), ("y", "gloomfan")]
    out = resolve.spelling_pairs(spark.createDataFrame(names, "category string, name string"), ["category"])
    assert sorted(map(tuple, out.collect())) == [("x", "marrowa", "marrowb", 1), ("y", "gloomfan", "gloomfen", 1)]


def test_frames_are_not_broadcast(spark):
    rows = [("s", f, f * 0.25, f"row {f + r}", r, f"row {f + r}") for f in range(6) for r in range(4)]
    r = spark.createDataFrame(rows, "stream_id string, frame long, t double, text string, row int, norm string")
    out = frames.messages(r.select("stream_id", "frame", "t", "row", "text", "norm"))
    assert sorted((x.place, x.text) for x in out.collect()) == [(p, f"row {p}") for p in range(1, 8)]
    assert "BroadcastHashJoin" not in plan(out)


def test_costly_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART", 10, raising=False)
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(10 * (cores + 3), numPartitions=1)).rdd.getNumPartitions() == cores + 3
    assert tables.spread(spark.range(5, numPartitions=1)).rdd.getNumPartitions() == cores


def test_a_line_is_read_again_without_comparing_every_message_word(spark):
    lines = ["Pa crushes a rat for 5 poimts of damage.", "Pa crushes a rat for 5 zzzzqqq of damage.", None, ""]
    out = parse(spark.createDataFrame([("s", i, 0.0, x) for i, x in enumerate(lines)], "stream_id string, seq long, ts double, text string"))
    assert [r.kind for r in out.orderBy("seq").collect()] == ["melee_hit", "unknown", "unknown", "unknown"]
    assert "levenshtein" not in plan(out)


def test_amounts_are_imputed_without_sorting_a_stream(spark, monkeypatch):
    rows = [("s" if i % 2 else None, i * 3, "zone" if i % 11 == 0 else "melee_hit" if i % 3 else "heal", f"A{i % 5}", f"k{i % 4}", None if i % 4 == 1 else i, False) for i in range(80)]
    e = spark.createDataFrame(rows, "stream_id string, seq long, kind string, actor string, skill string, amount long, estimated boolean")
    whole = E.impute_amounts(e)
    blocks = E.in_blocks
    monkeypatch.setattr(E, "in_blocks", lambda x: blocks(x, 7))
    split = E.impute_amounts(e)
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect())) and split.columns == e.columns
    assert not re.search(r"windowspecdefinition\(stream_id#\d+, (_g#\d+, )?seq#", plan(split))


def test_pairs_of_names_are_compared_once():
    resolve.canonical([("gloomfen", 9), ("gloomfan", 2)])
    hits = resolve.closeness.cache_info().hits
    assert resolve.canonical([("gloomfen", 9), ("gloomfan", 2)])["gloomfan"] == "gloomfen"
    assert resolve.closeness.cache_info().hits > hits


def test_a_head_is_compared_no_further_than_its_chain(monkeypatch):
    tail = [(f"line {i} of the tail", [str(i)]) for i in range(80)]
    head = [(i * 0.01, f"line {i} of the tail", [str(i)]) for i in range(70, 80)] + [(5.0 + i, f"own line {i}", [str(i)]) for i in range(230)]
    seen = []
    compare = replay.repeats
    monkeypatch.setattr(replay, "repeats", lambda old, new: seen.append(1) or compare(old, new))
    assert replay.lined_up(tail, head) == list(range(10))
    assert len(seen) < 400


def test_a_settled_table_is_read_by_columns(spark):
    kept = tables.settled(spark.createDataFrame([(1, "a", None)], "x int, y string, z array<int>"))
    assert [tuple(r) for r in kept.collect()] == [(1, "a", None)]
    assert "ReadSchema: struct<y:string>" in plan(kept.select("y"))
    assert tables.settled(spark.range(1).selectExpr("id", "null as none")).collect() == [(0, None)]


def test_words_are_compared_a_tile_at_a_time(spark, monkeypatch):
    rng = random.Random(4)
    words = ["pre" + "".join(rng.choices("abé", k=rng.randrange(9))) for _ in range(60)] + ["prea" * 30, "prea" * 30 + "b"]
    monkeypatch.setattr(resolve, "TILE", 100)
    every = np.arange(len(words))
    got = {(int(i), int(j)): int(d) for found in resolve.near_words(words, every, every) for i, j, d in zip(*found)}
    assert got == {(i, j): d for i, a in enumerate(words) for j, b in enumerate(words) if (d := distance(a, b)) <= resolve.EDITS}
    # names that all resemble each other never are rows of a join
    out = resolve.spelling_pairs(spark.createDataFrame([("Marrowa",), ("marrowb",), ("Marrowb",)], "name string"))
    assert sorted(map(tuple, out.collect())) == [("Marrowa", "Marrowb", 1), ("Marrowa", "marrowb", 1), ("Marrowb", "marrowb", 0)]
    assert "FlatMapGroupsInArrow" in plan(out)


def test_matching_blocks_are_those_of_difflib(monkeypatch):
    rng, calls = random.Random(2), []
    whole = difflib.SequenceMatcher
    for _ in range(5000):
        letters = rng.choice(["ab", "abc", "abcdefgh "])
        a = "".join(rng.choices(letters, k=rng.randrange(20)))
        at = rng.randrange(len(a) + 1)
        b = a[:at] + "".join(rng.choices(letters, k=rng.randrange(4))) + a[at + rng.randrange(4):]
        assert frames.ratio(a, b) == (1.0 if a == b else whole(None, a, b, autojunk=False).ratio())
    monkeypatch.setattr(difflib, "SequenceMatcher", lambda *x, **y: calls.append(x) or whole(*x, **y))
    line = "pabcd crushes a wolf for 123456 points of damage"
    assert frames.ratio(line, line[:-6]) > 0.9 and frames.ratio(line, line.replace("mag", "maq")) > 0.9
    assert all(len(x[1]) < 5 for x in calls)


def test_lines_are_compared_without_taking_all_of_them_apart(spark):
    def words(text):
        line = re.sub("[^0-9a-z]+", " ", re.sub("['’‘`]", "", text.lower())).strip(" ")
        return " ".join(w.translate(str.maketrans("ilo", "110")) if re.search("^[ilo]*[0-9][0-9ilo]*$", w) else w for w in line.split(" "))

    def digits(norm):
        return "".join({"i": "1", "l": "1", "o": "0"}.get(w) or re.sub("[^0-9]", "", w) for w in norm.split(" "))

    rng = random.Random(3)
    texts = ["", " ", "I", "l0 O", "5l", "a1b i", "Pa's 1O", "il", *("".join(rng.choices("ilo05aB '.", k=rng.randrange(14))) for _ in range(600))]
    out = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").select("text", T.compared(F.col("text")).alias("norm")).select("*", T.digits_of(F.col("norm")).alias("d")).collect()
    assert all((r.norm, r.d) == (words(r.text), digits(words(r.text))) if r.text is not None else (r.norm, r.d) == (None, None) for r in out)
    rows = [("s", 1, 0.0, 1, 20 * i, 16, t) for i, t in enumerate([None, "", "a", "..", "a\n.b", "ab", "- 1 -2"])]
    seen = frames.visual_rows(spark.createDataFrame(rows, "stream_id string, frame long, t double, x int, y int, h int, text string")).collect()
    assert sorted(r.norm for r in seen) in (["1 2", "a b", "ab"], [])


def test_no_class_of_a_pattern_has_three_ranges():
    patterns = [fused.BEGINS, *(M.pattern_of(f, loose)[0] for f, loose in M.ordered())]
    for inner in {c for p in patterns for c in re.findall(r"(?<!\\)\[((?:\\.|[^\]\\])+)\]", p)}:
        ranges = re.findall(r"\w-\w|\\[wd]|\\p\{\w+\}", inner)
        rest = re.sub(r"\w-\w|\\[wdp](?:\{\w+\})?|^\^", "", inner)
        assert len(ranges) + bool(rest) <= 2, inner
