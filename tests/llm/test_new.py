"""Suffix tree scores, the Merkle manifest and fill-in-middle rows against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.llm import fim, merkle, suffixtree

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


def brute_tree(rows, depth, least):
    """(base, score, known) of each (held, text), by dictionaries over whole contexts."""
    counts = [defaultdict(Counter) for _ in range(depth + 1)]
    for held, text in rows:
        w = words(text)
        for i, x in enumerate(w):
            for k in range(min(i, depth) + 1):
                counts[k][tuple(w[i - k:i])][x] += not held
    root = counts[0][()]
    total, distinct = sum(root.values()), sum(v > 0 for v in root.values())
    prior, weight = {}, lambda n: 4.0 * n ** 0.8

    def p(context, x):
        if not context:
            return (root[x] + 0.5) / (total + 0.5 * (distinct + 1))
        w = prior.get(context)
        if not w:
            return p(context[1:], x)
        c = counts[len(context)][context]
        return (c[x] + w * p(context[1:], x)) / (sum(c.values()) + w)

    for k in range(1, depth + 1):
        for context, c in counts[k].items():
            n = sum(c.values())
            if n >= least:
                w = weight(n - 1)
                if sum(m * math.log((m - 1 + w * p(context[1:], x)) / ((n - 1 + w) * p(context[1:], x))) for x, m in c.items() if m) > suffixtree.GAIN:
                    prior[context] = weight(n)
    out = []
    for _, text in rows:
        w = words(text)
        base = sum(math.log10(p((), x)) for x in w)
        out.append((base, sum(math.log10(p(tuple(w[max(0, i - depth):i]), x)) for i, x in enumerate(w)), sum(root[x] > 0 for x in w)))
    return out, total, prior


def texts(seed, n):
    r = random.Random(seed)
    chain = {v + w: r.sample("abcdefghij", 2) for v in "abcdefghij" for w in "abcdefghij"}
    for _ in range(n):
        out = []
        for _ in range(r.randint(0, 60)):
            out.append(r.choice(chain.get("".join(out[-2:]), "abcdefghij")) if r.random() < 0.8 else r.choice("abcdefghijXYZ"))
        yield r.choice([" ", "\n", "\t  "]).join(out)


@pytest.mark.parametrize("chunk,depth,least", [(40, 2, 2), (1 << 21, 2, 8), (70, 3, 2)])
def test_tree_scores_equal_brute_force(spark, chunk, depth, least):
    rows = [(i, i % 5 == 1, t) for i, t in enumerate([*texts(3, 120), "", None, "  A a\x0b\x0c", "É é nie", "a b c", "a b c"])]
    want, total, prior = brute_tree([(h, t) for _, h, t in rows], depth, least)
    assert {len(c) for c in prior} >= {1, 2}
    df = spark.createDataFrame(rows, "doc_id long, h boolean, text string").withColumn("held", F.lit(1)).withColumn("chunk", F.lit("x"))
    got = {r.doc_id: r for r in suffixtree.tree_scores(df, F.col("h"), depth=depth, least=least, chunk=chunk).collect()}
    assert len(got) == len(rows)
    for (i, h, t), (base, score, known) in zip(rows, want):
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (h, len(words(t)), known, total)
        assert g.base_score == pytest.approx(base, rel=1e-9) and g.score == pytest.approx(score, rel=1e-9)


def test_tree_scores_on_empty_and_untrained_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixtree.tree_scores(empty, F.lit(False)).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    got = suffixtree.tree_scores(rows, F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(0, 1, 0, 0, 0.0, 0.0), (1, 3, 0, 0, 0.0, 0.0), (1, 3, 0, 0, 0.0, 0.0)]


def test_held_out_texts_teach_nothing(spark):
    base = [(i, False, t) for i, t in enumerate(texts(5, 80))]
    asked = [(1000 + i, True, f"a b {w}") for i, w in enumerate("abcX!")]
    want = {i: brute_tree([(False, t) for _, _, t in base] + [(True, t)], 2, 8)[0][-1][1] for i, _, t in asked}
    got = suffixtree.tree_scores(spark.createDataFrame(base + asked, "doc_id long, h boolean, text string"), F.col("h"), least=8).collect()
    assert {r.doc_id: r.score for r in got if r.held_out} == pytest.approx(want)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, cut):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    groups = defaultdict(list)
    for r in rows:
        own = h(*map(enc, r))
        groups[r[1]].append((r[0] is not None, r[0] or 0, own, h(*map(enc, (*r[:4], r[4] and r[4].replace("\n", "")))) if cut(r) else own, r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for k, (_, _, own, claim, doc) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            proof = []
            for tree, i in ((trees[s], k), (top, place)):
                for level in tree[:-1]:
                    a = i // 3 * 3
                    proof += [x for j, x in enumerate(level[a:a + 3], a) if j != i]
                    claim = h(*[claim if j == i else x for j, x in enumerate(level[a:a + 3], a)])
                    i //= 3
            out.append((doc, own, trees[s][-1][0], top[-1][0], h(*proof), claim, claim == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3, 2, 10], [2187, 1], [2188, 4, 5], [7000, 1, 1, 9]])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(i * 7 - 50, f"s{s}" if s else None, None if i % 3 else "en", i, f"line {i}\nnext\n" if i % 4 else None) for s, n in enumerate(sizes) for i in range(n)]
    rows += rows[:1] * 2 + [(None, "é", None, None, ""), (None, "z", "x", 3, "1:-")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).withColumn("g", F.lit(1)).withColumn("k", F.lit("x")).repartition(3)
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf(*row, F.translate("text", "\n", ""))).otherwise(merkle.leaf(*row, F.col("text")))
    got = sorted((tuple(r) for r in merkle.proven(df, claim=claim).collect()), key=str)
    assert got == brute_manifest(rows, lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0)


def test_manifest_of_an_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert merkle.proven(df).count() == 0
    assert merkle.manifest(df)[1] is None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100])
def test_places_in_the_log(n):
    """The closed form gives the place of every node, as counted in the log itself."""
    leaves = [bytes([i]) for i in range(n)]
    levels = merkle.height(n)
    log = merkle.appended(leaves, levels)
    level, at = leaves, 0
    while True:
        assert [log[merkle.position(n, levels, at, i)] for i in range(len(level))] == level
        if len(level) == 1:
            break
        level, at = [merkle.node(level[i:i + 3]) for i in range(0, len(level), 3)], at + 1
    assert len(log) == merkle.position(n, levels, levels, 0) + 1
    for k in range(n):
        assert merkle.folded(leaves[k], merkle.siblings(log, n, levels, k), k) == log[-1]


def brute_middle(text, doc_id):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    return (n, "spm", len(x), len(m), f"<S>{s}<P>{x}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(x), len(m), f"<P>{x}<S>{s}<M>{m}")


def test_fill_in_middle_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice(["ab", "Z", " ", "\n", "é", "😀", "<", ">", "<S", "P>", "7", "ß"]) for _ in range(r.randint(0, 80)))) for i in range(400)]
    rows += [(None, "a b"), (None, None), (5, ""), (6, None), (7, "x <M> y"), (8, "words of text, " * 90_000), (8, "words of text, " * 90_000), (9, "a" * (1 << 20) + "b" * 3 + "é" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("restored", F.lit(2)).repartition(3)
    got = fim.rebuilt(fim.fill_in_middle(df)).collect()
    assert sorted((tuple(x) for x in got), key=str) == sorted(((i, t or "", *brute_middle(t, i), t or "") for i, t in rows), key=str)
    forms = Counter(x.form for x in got)
    assert min(forms[f] for f in ("plain", "spm", "psm")) > 20
    assert fim.fill_in_middle(df.where("false")).count() == 0


def test_every_rank_of_the_skip_list():
    text = "alpha, Beta;\n\n" * 300 + "é😀x"
    index, units = fim.SkipList(text), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert len(index.lanes) > 2 and index.units == len(units)
    at = 0
    for rank, unit in enumerate(units):
        assert index.offset(rank) == at
        at += len(unit)
    assert index.offset(len(units)) == len(text)
    assert fim.SkipList("").offset(0) == 0
