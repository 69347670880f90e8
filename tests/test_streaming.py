import json

from pyspark.sql import functions as F

from emberlog import streaming as S
from emberlog.operators import encounters as E

ROWS = [
    ("a", 0, 0.0, "Bo crushes a rat for 5 points of damage."), ("a", 1, 4.0, "Bo tries to crush a rat, but misses!"), ("a", 2, 30.0, "Bo crushes a rat for 7 points of damage."),
    ("a", 3, 35.0, "You have entered Woods."), ("a", 4, 36.0, "Bo crushes a bat for 9 points of damage."), ("a", 5, 40.0, "a rat crushes a bat for 9 points of damage."),
    ("a", 6, 60.0, "You gain experience!"), ("a", 7, 900.0, "You gain experience!"), ("b", 8, 1.0, "Bo tries to crush a rat, but misses!"), ("b", 9, 2.0, "You have entered Woods."),
]


def test_streamed_encounters_equal_the_batch_form(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [(s, i, 1000.0 + t, x) for s, i, t, x in ROWS]
    for i, part in enumerate((rows[:3], rows[3:])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("stream_id", "seq", "ts", "text"), r))) for r in part))
    got = S.closed_encounters(S.parsed(S.message_stream(spark, str(tmp_path / "in"))), 12.0)
    q = got.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    events = S.parsed(spark.createDataFrame(rows, "stream_id string, seq long, ts double, text string"))
    want = E.encounters(E.assign_encounters(events, 12.0)).select("stream_id", "zone_epoch", "enc", "start", "end", "n_damage")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.table("closed").select(*want.columns)) == key(want)
    assert spark.table("closed").agg(F.sum("damage")).first()[0] == 21


def test_streamed_cooldown_counts_from_the_last_fired(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"stream_id": "a", "rule_id": 1, "ts": t}) for t in (1000.0, 1006.0, 1011.0, 1012.0, 1022.5)))
    hits = spark.readStream.schema("stream_id string, rule_id long, ts double").json(str(tmp_path / "in")).withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", "10 seconds")
    q = S.cooldown(hits, 10.0).writeStream.format("memory").queryName("fired").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted(r.ts for r in spark.table("fired").collect()) == [1000.0, 1011.0, 1022.5]
