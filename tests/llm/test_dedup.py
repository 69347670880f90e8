import random

import numpy as np

from emberlog.llm import jaccard, lines, neardup
from emberlog.llm.common import components


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]


def shingles(text, k=5):
    w = (text or "").split()
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def groups(nodes, links):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(120)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_equals_all_pairs(spark):
    rng = random.Random(7)
    texts = {i: " ".join(words(rng, rng.randrange(1, 80))) for i in range(60)}
    base = words(rng, 120)
    for i in range(60, 330):  # a group larger than a block, each member changed
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "".join(rng.choices("xyz", k=6))
        texts[i] = " ".join(w)
    for i in range(330, 340):
        texts[i] = texts[rng.randrange(60)]
    rows = [(i, t) for i, t in texts.items()] + [(400, None), (401, ""), (402, "  "), (None, texts[3]), (403, "one two"), (404, "one two")]
    texts |= {403: "one two", 404: "one two"}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in jaccard.jaccard_classes(df).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    low, n = groups(ids, links), {i: 0 for i in ids}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    assert {i: (got[i].class_id, got[i].n_links, got[i].kept) for i in ids} == {i: (low[i], n[i], low[i] == i) for i in ids}
    assert all((got[i].class_id, got[i].n_links, got[i].kept) == (i, 0, True) for i in (400, 401, 402)) and got[None].class_id is None and got[None].kept
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0


def test_similar_in_narrow_strips_within_and_across():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, 25).astype(np.int64)) for _ in range(20)]
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5
    want = np.array([[i != j and share(x, y) for j, y in enumerate(sets)] for i, x in enumerate(sets)])
    assert (jaccard.similar(sets, None, 0.5, width=7) == want).all() and want.any()
    assert (jaccard.similar(sets[:8], sets[8:], 0.5, width=7) == want[:8, 8:]).all()
    assert not jaccard.similar([np.array([1, 2])], [np.array([3])], 0.5).any()


def test_pairs_of_blocks_see_every_pair(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "TOKENS", 90)
    rows = [(1, i, 20 + i % 3) for i in range(14)] + [(2, 100 + i, 5) for i in range(2)]
    met = {}
    for r in jaccard.dealt_pairs(spark.createDataFrame(rows, "component long, sid long, n long")).collect():
        met.setdefault((r.task, r.component), []).append(r)
    seen = [tuple(sorted((x.sid, y.sid))) for g in met.values() for x in g for y in g if x.in_a and y.in_b and x.sid != y.sid]
    want = {(i, j) for i in range(14) for j in range(i + 1, 14)} | {(100, 101)}
    assert set(seen) == want


def test_near_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for label in (0, 1, 2, None):
        centre = rng.standard_normal(16)
        for i in range(150):
            v = rng.standard_normal(16) if i % 2 else centre + 0.12 * rng.standard_normal(16)
            rows.append((at, [float(np.float32(x)) for x in v], label))
            at += 1
    rows += [(at + i, rows[5][1], 0) for i in range(3)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] + [1.0] * 15, 1), (905, [], 1), (906, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    x = neardup.unit(np.array([np.float32(r[1]) for r in rows], np.float32))
    near = (x @ x.T >= 0.93) & np.array([[a[2] is not None and a[2] == b[2] for b in rows] for a in rows])
    links = [(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)))]
    low = groups(range(len(rows)), links)
    np.fill_diagonal(near, False)
    assert {i: (got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(rows))} == {i: (int(near[i].sum()), low[i], low[i] == i) for i in range(len(rows))}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 907)) and got[None].n_links == 0 and got[None].kept
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def cut(text, window=2, modulus=3):
    import hashlib

    ls = text.split("\n")
    hs = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ls]
    out, start = [], 0
    for i in range(len(ls)):
        if i == len(ls) - 1 or sum(hs[i - j] * 31 ** j for j in range(window) if i >= j) % modulus == 0:
            out.append((i + 1 - start, "\n".join(ls[start:i + 1])))
            start = i + 1
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(5)
    pool = ["\n".join(" ".join(words(rng, 3)) for _ in range(5)) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice([rng.choice(pool), " ".join(words(rng, 4)), ""]) for _ in range(rng.randrange(1, 9))), i) for i in range(80)]
    rows += [(200, None, 1), (201, "", 1), (202, rows[3][1], 1), (None, rows[4][1], 1), (202, rows[3][1], 1), (203, "\n".join(" ".join(words(rng, 2)) for _ in range(20_000)), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, i long").repartition(5)
    out = lines.dedup_lines(df).collect()
    first = {}
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is not None:
            for i, (n, body) in enumerate(cut(t)):
                if n >= 2:
                    first.setdefault(body, (d, i))
    want = []
    for d, t, i in rows:
        if t is None:
            want.append((d, None, 0, 0, i))
            continue
        parts = cut(t)
        keep = [(n, b) for j, (n, b) in enumerate(parts) if n < 2 or first[b] == (d, j)]
        want.append((d, "\n".join(b for _, b in keep), sum(n for n, _ in parts), sum(n for n, _ in parts) - sum(n for n, _ in keep), i))
    key = lambda r: (r[0] or -1, str(r))
    assert sorted([(r.doc_id, r.text, r["_lines"].n, r["_lines"].removed, r.i) for r in out], key=key) == sorted(want, key=key)
    assert lines.dedup_lines(df.limit(0)).count() == 0
