import hashlib
import random
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from emberlog.llm import mixing, warc


def test_schedule_is_fair(spark):
    quota = [("a", 500), ("b", 333), ("c", 100), ("d", 66), ("e", 1)]
    df = spark.createDataFrame([(s, q, 1000) for s, q in quota], "src string, quota long, period long")
    at = {p: r.src for r in mixing.schedule(df).collect() for p in r.places}
    assert sorted(at) == list(range(1000))
    done = Counter()
    for t in range(1000):
        done[at[t]] += 1
        for s, q in quota:
            assert abs(done[s] - Fraction(q, 1000) * (t + 1)) < 1
    assert done == dict(quota)


def test_rows_are_kept_in_mixed_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["x"] * 6 + ["y", "z", None]), rng.randrange(0, 50), "slot", i) for i in range(900)] + [(5, "x", 3, "again", 1), (None, "y", None, None, 2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, slot string, block long").repartition(4)
    out = mixing.mix_sources(df, size=F.col("size"), block_size=100, slots=50).collect()
    assert len(out) == len(rows) and sorted(r.mix_pos for r in out) == list(range(len(rows)))
    assert [r.mix_pos for r in sorted(out, key=lambda r: r.mix_pos)] == [r.mix_pos for r in sorted(out, key=lambda r: (r.slot, r.mix_pos))]
    # one slot holds one source's block, and target shares hold while all sources last
    by_slot = {}
    for r in out:
        assert by_slot.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert any(r.on_target for r in out)
    wide = mixing.mixed_order(df, size=F.col("size"), block_size=100, slots=50)
    assert wide.columns == df.columns and Counter(map(str, wide.collect())) == Counter(map(str, df.collect()))
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mixed_order(df.limit(0)).count() == 0


def test_given_weights(spark):
    t = spark.createDataFrame([("va", 10), ("vb", 10), ("n", 5)], "src string, total long")
    q = {r.src: r.quota for r in mixing.quotas(t, {"a": 3, "b": 1, None: 1}, 100).collect()}
    assert q == {"va": 60, "vb": 20, "n": 20} or sum(q.values()) == 100 and q["va"] in (59, 60)


def test_archive_round_trip(spark):
    big = "<html>" + "é" * 600 + "</html>"
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, big), (4, "http://d/\r\nX: y", big), (9, "u", big), (5, "e", None), (6, "f", ""), (7, "g", "a\r\n\r\nb\r\n\r\n" + "z" * 2000), (None, "h", big), (8, "i", "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit("clash")).repartition(3)
    at = warc.write_archive(df)
    out = {r.page_id: r for r in warc.parse_records(warc.read_records(spark, at)).collect()}
    assert len(out) == len(rows) and spark.read.parquet(f"{at}/blobs").count() == 5
    for p, _, h in rows:
        raw = (h or "").encode()
        assert (out[p].payload_bytes, out[p].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest()) and out[p].declared == out[p].payload_digest
    kinds = {p: (r.record_type, r.refers_to) for p, r in out.items()}
    assert kinds[1] == kinds[2] == kinds[9] == ("response", None) and kinds[3] == kinds[4] == kinds[None] == ("revisit", 9)
    assert out[4].url == "http://d/%0D%0AX: y" and out[3].url is None
    assert warc.parse_records(warc.read_records(spark, warc.write_archive(df.limit(0)))).count() == 0
