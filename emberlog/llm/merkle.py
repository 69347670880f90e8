"""Merkle manifest of a table: a tree of digests for each group of rows, kept as an append log in postorder.

A tree has runs of ``ARITY`` consecutive nodes; the last run of a level may be shorter. Builders each take an aligned block of ``ARITY ** DEPTH``
leaves and append a node the moment its last child is there, so a builder holds one open run a level. What the blocks end in are the leaves of
the next round of builders, until one node is left. The place of a node in its builder's log follows from subtree sizes, which is how the siblings of a
proof are found without an index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import removed, written

ARITY = 3
#: Levels of a builder: 2,187 leaves, some 3,280 nodes of 32 bytes.
DEPTH = 7
BLOCK = ARITY ** DEPTH


def field(x: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = x.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*columns: Column) -> Column:
    """A row's digest: sha256 over the fields one after the other, which their lengths keep apart."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def node(children: list[bytes]) -> bytes:
    """The digest of a run: sha256 over the children's digests as lower-case hex."""
    return hashlib.sha256("".join([c.hex() for c in children]).encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def appended(leaves: list[bytes], levels: int) -> list[bytes]:
    """The log of one builder: every node of ``levels`` levels above the leaves, in the order in which they are completed."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(levels)]
    for k, digest in enumerate(leaves):
        log.append(digest)
        for run in open_:
            run.append(digest)
            if len(run) < ARITY and k < len(leaves) - 1:
                break
            digest = node(run)
            run.clear()
            log.append(digest)
    return log


def position(n: int, levels: int, level: int, i: int) -> int:
    """The place in the log of node ``i`` of ``level``, in a builder of ``n`` leaves.

    It is completed with the last leaf below it. Before that leaf stand all leaves before it and every subtree that they fill.
    """
    before = min((i + 1) * ARITY ** level, n) - 1
    return sum(before // ARITY ** j for j in range(levels + 1)) + level


def siblings(log: list[bytes], n: int, levels: int, k: int) -> list[list[bytes]]:
    """The siblings of leaf ``k``, level by level, each level from left to right."""
    out, width = [], n
    for level in range(levels):
        first = k // ARITY * ARITY
        out.append([log[position(n, levels, level, i)] for i in range(first, min(first + ARITY, width)) if i != k])
        k, width = k // ARITY, -(-width // ARITY)
    return out


def folded(digest: bytes, path: list[list[bytes]], k: int) -> bytes:
    """The root that leaf ``k`` leads to over the siblings of its path."""
    for level in path:
        at = k % ARITY
        digest = node([*level[:at], digest, *level[at:]])
        k //= ARITY
    return digest


def ranked(rows: DataFrame, group: str, order: list[str], scratch: list[str]) -> DataFrame:
    """``rows`` with ``k``, their place in ``group``, and ``n``, its size, without one task for a group.

    Ranges of ``(group, order)`` are written; a row's place in its file and the running counts of the files before it give its place.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    at = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    at = written(at, "ranges", scratch).withColumn("_part", F.shiftright("_at", 33))
    part = at.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g")).agg(F.min("_at").alias("_first"), F.count("*").alias("_m"))
    of = Window.partitionBy("_g")
    part = part.withColumn("n", F.sum("_m").over(of)).withColumn("_before", F.sum("_m").over(of.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    part = written(part, "range-counts", scratch)
    return at.join(part, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn(
        "k", F.col("_at") - F.col("_first") + F.coalesce("_before", F.lit(0))).drop("_at", "_part", "_p", "_g", "_first", "_m", "_before")


def blocks(rows: DataFrame) -> DataFrame:
    """The builders' logs of ``rows(g, k, n, id, digest, claim)``: ``(g, block, n, ids, claims, log)``, a row a builder.

    ``n`` stays the group's number of leaves in this round. Builders are dealt by group and block, so a large group is spread.
    """
    def run(batches: Iterator):
        import pyarrow as pa

        at, held = None, []

        def made(done: list):
            out = []
            for (g, b), rs in done:
                n, leaves = rs[0][1], [r[3] for r in rs]
                out.append((g, b, n, [r[2] for r in rs], [r[4] for r in rs], appended(leaves, height(n) if n <= BLOCK else DEPTH)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["g", "block", "n", "ids", "claims", "log"])

        for batch in batches:
            done = []
            for g, b, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (g, b) != at:
                    if held:
                        done.append((at, held))
                    at, held = (g, b), []
                held.append(row)
            if done:
                yield made(done)
        if held:
            yield made([(at, held)])

    r = rows.withColumn("block", F.floor(F.col("k") / F.lit(BLOCK)).cast("long")).select("g", "block", "k", "n", "id", "digest", "claim")
    return r.repartition("g", "block").sortWithinPartitions("g", "block", "k").mapInArrow(
        run, "g string, block long, n long, ids array<long>, claims array<binary>, log array<binary>")


def forest(rows: DataFrame, scratch: list[str]) -> list[DataFrame]:
    """The rounds of builders over ``rows(g, k, n, id, digest, claim)``; the last round has one builder a group."""
    rounds = [written(blocks(rows), "blocks", scratch)]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        top = rounds[-1].where(F.col("n") > BLOCK).select(
            "g", F.col("block").alias("k"), F.ceil(F.col("n") / F.lit(BLOCK)).cast("long").alias("n"), F.lit(None).cast("long").alias("id"),
            F.element_at("log", -1).alias("digest"), F.lit(None).cast("binary").alias("claim"))
        rounds.append(written(blocks(top), "blocks", scratch))
        most = -(-most // BLOCK)
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``(g, root)``: the last node of each group's last builder."""
    out = None
    for r in rounds:
        done = r.where(F.col("n") <= BLOCK).select("g", F.element_at("log", -1).alias("root"))
        out = done if out is None else out.union(done)
    return out


PATH = "array<array<binary>>"


def paths(r: DataFrame) -> DataFrame:
    """The siblings of every leaf inside its builder: ``(g, k, path)``."""
    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for g, b, n, ids, log in zip(*[c.to_pylist() for c in batch.columns]):
                levels = height(n) if n <= BLOCK else DEPTH
                ks = range(len(ids))
                yield pa.RecordBatch.from_arrays([
                    pa.array([g] * len(ids), pa.string()), pa.array([b * BLOCK + k for k in ks], pa.int64()),
                    pa.array([siblings(log, len(ids), levels, k) for k in ks], pa.list_(pa.list_(pa.binary())))], ["g", "k", "path"])

    return r.select("g", "block", "n", "ids", "log").mapInArrow(run, f"g string, k long, path {PATH}")


def above(rounds: list[DataFrame]) -> DataFrame:
    """What lies over each builder of the first round up to its group's root: ``(g, block, up)``, ``up`` a path."""
    empty = F.array().cast(PATH)
    out = rounds[-1].select("g", "block", empty.alias("up"))
    for r, higher in zip(reversed(rounds[:-1]), reversed(rounds[1:])):
        p = paths(higher).withColumn("over", F.floor(F.col("k") / F.lit(BLOCK)).cast("long"))
        p = p.join(out.select(F.col("g").alias("h"), F.col("block").alias("o"), F.col("up").alias("rest")), F.col("g").eqNullSafe(F.col("h")) & (F.col("over") == F.col("o")))
        p = p.select("g", F.col("k").alias("block"), F.concat("path", "rest").alias("up"))
        out = p.union(r.where(F.col("n") <= BLOCK).select("g", "block", empty.alias("up")))
    return out


def manifest(df: DataFrame, *, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             claim: Column | None = None, scratch: list[str] | None = None) -> tuple[DataFrame, bytes | None]:
    """``(logs, root)``: the builders' logs of all rows with what lies over each builder, and the root over the groups.

    ``logs`` has ``(g, block, n, ids, claims, log, up, subroot, place, groups, top, root)``: ``up`` the siblings from a builder to its group's root, ``top`` those
    from there to the root, ``place`` the group's place among ``groups``. Groups stand in the order of their UTF-8 bytes, a null one first.
    Rows of a group ascend by ``order``, null first, equal ones by digest; repeated rows are leaves of their own. ``claim`` is a digest to be
    verified instead of the row's own. Nulls may stand in any field. An empty table has no logs and no root. Other columns are not read.
    """
    scratch = [] if scratch is None else scratch
    digest = leaf(*(F.col(f"`{c}`") for c in fields))
    rows = df.select(F.col(f"`{group}`").cast("string").alias("g"), F.col(f"`{order}`").cast("long").alias("id"), digest.alias("digest"),
                     (digest if claim is None else claim).alias("claim"))
    rows = written(rows, "leaves", scratch)
    rounds = forest(ranked(rows, "g", ["id", "digest"], scratch), scratch)
    subroots = roots(rounds).select(F.lit("").alias("all"), F.col("g").alias("name"), F.col("root").alias("digest"))
    placed = written(ranked(subroots, "all", ["name"], scratch), "subroots", scratch)
    upper = forest(placed.select(F.col("all").alias("g"), "k", "n", F.lit(None).cast("long").alias("id"), "digest", F.lit(None).cast("binary").alias("claim")), scratch)
    root = roots(upper).select("root").first()
    inside = paths(upper[0]).withColumn("b", F.floor(F.col("k") / F.lit(BLOCK)).cast("long"))
    inside = inside.join(above(upper).select(F.col("block").alias("b"), "up"), "b").select("k", F.concat("path", "up").alias("top"))
    root = None if root is None else bytes(root[0])
    tops = written(placed.join(inside, "k").select(
        F.col("name").alias("h"), F.col("digest").alias("subroot"), F.col("k").alias("place"), F.col("n").alias("groups"), "top", F.lit(root).cast("binary").alias("root")), "tops", scratch)
    over = above(rounds).join(tops, F.col("g").eqNullSafe(F.col("h"))).drop("h").withColumnsRenamed({"g": "og", "block": "ob"})
    logs = rounds[0].join(over, F.col("g").eqNullSafe(F.col("og")) & (F.col("block") == F.col("ob"))).drop("og", "ob")
    return logs, root


def verified(logs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every leaf: its proof, and the root its claim leads to.

    The proof is addressed in the builder's log by postorder places. Digests are lower-case hex.
    """
    def run(batches: Iterator):
        import pyarrow as pa

        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        for batch in batches:
            for b, n, ids, claims, log, up, subroot, place, top, root in zip(*[c.to_pylist() for c in batch.columns]):
                levels, rows = (height(n) if n <= BLOCK else DEPTH), []
                for k, (i, claim) in enumerate(zip(ids, claims)):
                    inner = siblings(log, len(ids), levels, k)
                    own = log[position(len(ids), levels, 0, k)]
                    to = folded(folded(folded(claim, inner, k), up, b), top, place)
                    proof = "".join([s.hex() for level in (*inner, *up, *top) for s in level])
                    rows.append((i, own.hex(), subroot.hex(), root.hex(), hashlib.sha256(proof.encode()).hexdigest(), to.hex(), to == root))
                kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)

    return logs.select("block", "n", "ids", "claims", "log", "up", "subroot", "place", "top", "root").mapInArrow(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def proven(df: DataFrame, *, claim: Column | None = None, **options) -> DataFrame:
    """``verified`` over the manifest of ``df``, written; the tables on the way to it are removed."""
    scratch: list[str] = []
    logs, _ = manifest(df, claim=claim, scratch=scratch, **options)
    out = written(verified(logs), "proofs")
    removed(df.sparkSession, scratch)
    return out


def _fields(text: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))


SQL = f"""
WITH RECURSIVE crcs AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
        lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, source, sha256({_fields('text')}) AS dg, sha256({_fields("replace(text, chr(10), '')")}) AS cut,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, crcs),
leaves AS (SELECT doc_id, source, dg, CASE WHEN crc % 2 = 0 THEN cut ELSE dg END AS claim,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, dg) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM d),
tree AS (SELECT source, 0 AS lev, k, n, dg FROM leaves UNION ALL
    SELECT source, lev + 1, k // 3, (n + 2) // 3, sha256(string_agg(dg, '' ORDER BY k)) FROM tree WHERE n > 1 GROUP BY source, lev, k // 3, n),
subs AS (SELECT source, dg, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (SELECT 0 AS lev, k, n, dg FROM subs UNION ALL
    SELECT lev + 1, k // 3, (n + 2) // 3, sha256(string_agg(dg, '' ORDER BY k)) FROM upper WHERE n > 1 GROUP BY lev, k // 3, n),
walk AS (SELECT doc_id, source, dg, k AS at, 0 AS lev, k, n, claim AS own, '' AS proof FROM leaves UNION ALL
    SELECT w.doc_id, w.source, w.dg, w.at, w.lev + 1, w.k // 3, (w.n + 2) // 3, sha256(string_agg(CASE WHEN t.k = w.k THEN w.own ELSE t.dg END, '' ORDER BY t.k)),
        w.proof || coalesce(string_agg(CASE WHEN t.k <> w.k THEN t.dg END, '' ORDER BY t.k), '')
    FROM walk w JOIN tree t ON t.source IS NOT DISTINCT FROM w.source AND t.lev = w.lev AND t.k // 3 = w.k // 3
    WHERE w.n > 1 GROUP BY w.doc_id, w.source, w.dg, w.at, w.lev, w.k, w.n, w.own, w.proof),
climb AS (SELECT w.doc_id, w.source, w.dg, w.at, 0 AS lev, s.k, s.n, w.own, w.proof, s.dg AS subroot
    FROM walk w JOIN subs s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1 UNION ALL
    SELECT c.doc_id, c.source, c.dg, c.at, c.lev + 1, c.k // 3, (c.n + 2) // 3, sha256(string_agg(CASE WHEN t.k = c.k THEN c.own ELSE t.dg END, '' ORDER BY t.k)),
        c.proof || coalesce(string_agg(CASE WHEN t.k <> c.k THEN t.dg END, '' ORDER BY t.k), ''), c.subroot
    FROM climb c JOIN upper t ON t.lev = c.lev AND t.k // 3 = c.k // 3
    WHERE c.n > 1 GROUP BY c.doc_id, c.source, c.dg, c.at, c.lev, c.k, c.n, c.own, c.proof, c.subroot)
SELECT c.doc_id, c.dg AS leaf, c.subroot, r.dg AS root, sha256(c.proof) AS proof_sha256, c.own AS folded_root, c.own = r.dg AS verified
FROM climb c, (SELECT dg FROM upper WHERE n = 1) r WHERE c.n = 1
"""
