"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

A rolling hash over the hashes of the last ``window`` lines ends a chunk where it divides by ``modulus``: an insertion
moves only the boundaries near it. Chunks of ``min_lines`` lines or more that occur again anywhere are removed after
their bytes are compared; the occurrence with the smallest (doc_id, place) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import joined_anew, unused


def chunks_of(text: Column, window: int = 2, modulus: int = 3) -> Column:
    """The text's chunks: array of ``struct(i, n, body)``; the bodies joined by newlines are the text."""
    made = F.transform(F.array(F.split(text, "\n", -1)), lambda ls: F.struct(
        ls.alias("ls"), F.transform(ls, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")).alias("hs")))
    ends = F.transform(made, lambda b: F.struct(b["ls"].alias("ls"), F.filter(
        F.sequence(F.lit(1), F.size(b["ls"])), lambda e: (e == F.size(b["ls"])) | (_roll(b["hs"], e, window) % modulus == 0)).alias("ends")))
    return F.element_at(F.transform(ends, lambda b: F.transform(b["ends"], lambda e, i: _chunk(b, e, i))), 1)


def _roll(hs: Column, e: Column, window: int) -> Column:
    total = F.lit(0).cast("long")
    for j in range(window):
        total = total + F.coalesce(F.get(hs, e - 1 - j), F.lit(0).cast("long")) * (31 ** j)
    return total


def _chunk(b: Column, e: Column, i: Column) -> Column:
    start = F.coalesce(F.get(b["ends"], i - 1), F.lit(0))
    return F.struct(i.alias("i"), (e - start).alias("n"), F.array_join(F.slice(b["ls"], start + 1, e - start), "\n").alias("body"))


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_lines: int = 2, window: int = 2, modulus: int = 3) -> DataFrame:
    """``docs`` with the text cleaned, and ``_lines = struct(n, removed)``.

    Hashes find candidates, then the bytes themselves are grouped, so a collision removes nothing. A null text stays
    null and an empty one empty; a document all of whose chunks go keeps an empty text. Rows with equal id and text
    are one document and keep or lose the same chunks; null ids come first. Other columns pass through, whatever their names; one that
    is called ``_lines`` is replaced. An empty table gives an empty table.
    """
    names = {n: unused(f"_{n}", docs.columns) for n in ("th", "gone", "gone_id", "gone_th", "kept")}
    out_name = "_lines"
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    flat = (docs.select(key.alias("k"), F.explode(F.filter(chunks_of(F.col(text), window, modulus), lambda c: c["n"] >= min_lines)).alias("c"))
            .select("k", "c.i", "c.body", F.xxhash64("c.body").alias("h")))
    again = flat.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = joined_anew(flat, again, ["h"], "left_semi")
    place = F.struct(F.col("k.id"), F.col("i"), F.col("k.th"))
    first = found.groupBy("h", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "body", "first")
    gone = joined_anew(found, first, ["h", "body"]).where(~place.eqNullSafe(F.col("first")))
    drop = gone.groupBy("k").agg(F.collect_set("i").alias(names["gone"])).select(F.col("k.id").alias(names["gone_id"]), F.col("k.th").alias(names["gone_th"]), names["gone"])
    out = docs.withColumn(names["th"], key["th"]).join(drop, F.col(doc_id).eqNullSafe(F.col(names["gone_id"])) & (F.col(names["th"]) == F.col(names["gone_th"])), "left")
    kept = F.element_at(F.transform(F.array(chunks_of(F.col(text), window, modulus)), lambda cs: F.struct(
        F.aggregate(cs, F.lit(0), lambda a, c: a + c["n"]).alias("total"),
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(cs) - 1), F.col(names["gone"])), lambda i: F.get(cs, i)).alias("left"))), 1)
    out = out.withColumn(names["kept"], F.when(F.col(names["gone"]).isNotNull(), kept))
    part = F.col(names["kept"])
    lines = F.when(part.isNull(), F.size(F.split(F.col(text), "\n", -1))).otherwise(part["total"])
    removed = F.when(part.isNull(), 0).otherwise(part["total"] - F.aggregate(part["left"], F.lit(0), lambda a, c: a + c["n"]))
    clean = F.when(part.isNull(), F.col(text)).otherwise(F.array_join(F.transform(part["left"], lambda c: c["body"]), "\n"))
    cols = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != out_name]
    return out.select(*cols, F.struct(F.coalesce(lines, F.lit(0)).cast("long").alias("n"), removed.cast("long").alias("removed")).alias(out_name))


SQL = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS lh, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
r AS (SELECT *, CASE WHEN j = n OR (lh + 31 * coalesce(lag(lh) OVER (PARTITION BY doc_id ORDER BY j), 0)) % 3 = 0 THEN 1 ELSE 0 END AS cut FROM h),
c AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM r),
g AS (SELECT doc_id, i, count(*) AS n, string_agg(line, chr(10) ORDER BY j) AS body FROM c GROUP BY doc_id, i),
w AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS rn FROM g WHERE n >= 2),
x AS (SELECT g.*, coalesce(w.rn, 1) AS rn FROM g LEFT JOIN w ON g.doc_id = w.doc_id AND g.i = w.i),
o AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN rn > 1 THEN n ELSE 0 END) AS BIGINT) AS removed_lines,
  coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE rn = 1), '') AS clean FROM x GROUP BY doc_id)
SELECT doc_id, n_lines, removed_lines, CAST(length(clean) AS BIGINT) AS clean_chars, md5(clean) AS clean_md5 FROM o
UNION ALL SELECT doc_id, 0, 0, 0, md5('') FROM documents WHERE text IS NULL
"""
