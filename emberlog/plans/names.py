"""Queries over names: spellings grouped in a vocabulary, and encounters' names under its veto. Misreadings are put in, so the SQL knows them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import encounters as E, metrics as M, resolve, vocabulary as V
from emberlog.plans.queries import ENC, TIMEOUT, activity, letters, query, table

ACTOR = "'P' || translate(CAST(user_id AS VARCHAR), '0123456789', 'abcdefghij')"
READ = ACTOR.replace("user_id", "user_id % 40")
#: The encounters of forty actors, of whose names every thirteenth reading takes d for p and i for l.
READ_ENC = ENC.replace(ACTOR, f"CASE WHEN event_id % 13 = 5 THEN translate({READ}, 'di', 'pl') ELSE {READ} END")


@query("WITH " + READ_ENC + """, n AS (SELECT stream_id, zone_epoch, enc, name, count(*) AS n FROM (SELECT stream_id, zone_epoch, enc, unnest([actor, target]) AS name FROM r) WHERE name IS NOT NULL GROUP BY ALL)
SELECT a.stream_id, a.zone_epoch, a.enc, a.name, CASE WHEN b.n >= 2 * a.n THEN b.name ELSE a.name END AS canonical
FROM n a LEFT JOIN n b ON a.stream_id = b.stream_id AND a.zone_epoch = b.zone_epoch AND a.enc = b.enc AND a.name <> b.name AND translate(a.name, 'pl', 'di') = translate(b.name, 'pl', 'di')""")
def canonical_names(spark, sf_dir):
    """Names that are read often differ, however alike, but for what glyphs explain."""
    a = activity(spark, sf_dir)
    user = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), letters(F.col("user_id") % 40).alias("_name"))
    a = a.join(user, "seq").withColumn("actor", F.when(F.col("seq") % 13 == 5, F.translate("_name", "di", "pl")).otherwise(F.col("_name"))).drop("_name")
    known = V.vocabulary(V.spellings(V.kept(V.learned(a))))
    return resolve.canonical_names(E.encounter_rows(E.assign_encounters(a, TIMEOUT)), M.ENC, known.differ)


@query("""WITH c AS (SELECT c_custkey AS k, translate(substr(md5(CAST(c_custkey % 40 AS VARCHAR)), 1, 12), '0123456789', 'ghijklmnop') AS base FROM customer),
r AS (SELECT base, CASE WHEN k % 11 = 3 THEN substr(base, 1, CAST(k % 12 AS INT)) || 'x' || substr(base, CAST(k % 12 AS INT) + 2) ELSE base END AS name FROM c)
SELECT 'item' AS category, name, count(*) AS n, min(base) AS canonical FROM r GROUP BY name HAVING count(*) >= 2""")
def vocabulary_clusters(spark, sf_dir):
    """Forty names of twelve letters, far from each other. Every eleventh reading has one wrong letter; the readings of a name are one group."""
    name = F.translate(F.substring(F.md5((F.col("c_custkey") % 40).cast("string").cast("binary")), 1, 12), "0123456789", "ghijklmnop")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), name.alias("base"))
    wrong = F.concat(F.expr("substring(base, 1, cast(k % 12 as int))"), F.lit("x"), F.expr("substring(base, cast(k % 12 as int) + 2, 12)"))
    read = c.select(F.lit("item").alias("category"), F.when(F.col("k") % 11 == 3, wrong).otherwise(F.col("base")).alias("name"))
    counts = read.groupBy("category", "name").agg(F.count("*").alias("n"))
    return V.spellings(V.kept(counts)).select("category", "name", "n", "canonical")
