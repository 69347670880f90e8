import random

from pyspark.sql import functions as F

import corpus_pipeline
from emberlog.llm import mixing, quality


def make(spark, tmp, n=240):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
        bad = i % 5 == 0
        t = " ".join(x.upper() + "!!" for x in w) if bad and i % 2 else " ".join(w[:2] * 30) if bad else "\n".join(" ".join(w[j:j + 9]) for j in range(0, len(w), 9))
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(1000, docs[1][1], "en", "s0", 0), (1001, None, None, None, None), (1002, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    return docs, labels


def test_classifier_and_stages(spark, tmp_path):
    docs, labels = make(spark, str(tmp_path))
    d, lab = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(quality.training_rows(d, lab))
    out = {r.doc_id: r["_quality"] for r in quality.classify(d, model).collect()}
    truth = dict((i, q) for i, q, _ in labels)
    held = [i for i in truth if out[i].held_out]
    assert held and sum(out[i].predicted == truth[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[1001].score == out[1002].score
    kept = corpus_pipeline.quality_stage(spark, d, str(tmp_path))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.predicted == 1}
    got = corpus_pipeline.line_stage(spark, kept, str(tmp_path))
    assert got.columns == d.columns and got.count() == kept.count()
    assert got.where("n_chars <> length(text)").count() == 0
    one = corpus_pipeline.near_duplicate_stage(spark, kept, str(tmp_path))
    assert one.columns == d.columns and {r.doc_id for r in kept.collect()} - {r.doc_id for r in one.collect()} == {1000}
    mixed = corpus_pipeline.mixing_stage(spark, kept, str(tmp_path))
    assert mixed.columns == d.columns and mixed.exceptAll(kept).count() == 0 and mixed.count() == kept.count()
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < final.count() <= kept.count()


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["_quality"].score for r in quality.classify(d, quality.fit(quality.training_rows(d, lab))).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.classify(d.limit(0), quality.fit(quality.training_rows(d, one))).count() == 0


def test_rules_from_a_printed_tree():
    tree = "DecisionTree\n  If (feature 1 <= 0.5)\n   If (feature 4 <= 0.1)\n    Predict: 0.0\n   Else (feature 4 > 0.1)\n    Predict: 1.0\n  Else (feature 1 > 0.5)\n   Predict: 1.0\n"
    assert quality.paths(tree) == [(("distinct_words", "<=", 0.5),), (("distinct_words", "<=", 0.5), ("upper", "<=", 0.1)), (("distinct_words", "<=", 0.5), ("upper", ">", 0.1)), (("distinct_words", ">", 0.5),)]


def test_statistics(spark):
    r = spark.createDataFrame([("Aa aa\nAa 12!",), (None,)], "text string").select(*[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).collect()
    assert list(quality.statistics(F.col("text"))) == quality.NAMES
    assert r[0].words == 4 and r[0].distinct_words == 0.75 and r[0].word_length == 2.25 and r[0].upper == 2 / 12 and set(r[1]) == {0.0, 1.0} - ({1.0} if r[1].distinct_lines == 0 else set())


def test_the_mix_outlives_files(spark, tmp_path):
    rows = [(i, "ab cd " * (300 if i % 4 else 1500), "en", f"s{i % 3}", 0) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(7).write.parquet(f"{tmp_path}/mixed")  # as a reader may deal them
    got = [r.doc_id for r in corpus_pipeline.token_stage(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()]
    slots = mixing.with_slots(d, size=F.length("text"), block_size=65536, slots=1000).select("doc_id", "_mix.slot", "_mix.h").collect()
    assert got == [r.doc_id for r in sorted(slots, key=lambda r: (r.slot, r.h))]
