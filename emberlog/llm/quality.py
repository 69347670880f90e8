"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Tree paths of a small forest become conjunctive rules; a logistic model with an L1 penalty weighs them and drops most;
what is left is one column expression. Fitting sees a bounded sample of labelled rows, scoring all rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import unused, written

#: Labelled rows that fitting sees at most, about; see ``training_rows``.
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text by name; a null text counts as empty, and ratios of an empty text are 0."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    rows = F.split(t, "\n")
    letters = F.length(F.regexp_replace(t, r"\s+", ""))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "words": F.size(words).cast("double"),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(rows)), F.size(rows)),
        "word_length": share(letters, F.size(words)),
        "upper": share(F.regexp_count(t, F.lit(r"\p{Lu}")), F.length(t)),
        "digits": share(F.regexp_count(t, F.lit(r"[0-9]")), F.length(t)),
        "symbols": share(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,]")), F.length(t)),
        "words_a_line": share(F.size(words), F.size(rows)),
    }


NAMES = ["words", "distinct_words", "distinct_lines", "word_length", "upper", "digits", "symbols", "words_a_line"]

Rule = tuple[tuple[str, str, float], ...]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, target: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Statistics and ``label`` of about ``sample_rows`` labelled documents at most, never of held-out ones.

    A hash of the id picks them, at a rate from the count of labelled rows. Rows with a null id or label are left out.
    The picked ids are bounded by the parameter, so they are broadcast and only their texts are read further.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(target).cast("double").alias("label"))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return written(rows.select("label", *[c.alias(k) for k, c in statistics(F.col("text")).items()]), "labelled").coalesce(4)


def paths(debug: str) -> list[Rule]:
    """Every path prefix of a printed tree, as conjunctions of (statistic, <= or >, threshold)."""
    rules, open_ = [], []
    for line in debug.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line):
            depth = len(m[1])
            open_ = [x for x in open_ if x[0] < depth] + [(depth, (NAMES[int(m[2])], m[3], float(m[4])))]
            rules.append(tuple(x[1] for x in open_))
    return rules


class RuleModel:
    """Weighted rules; ``score`` is one column expression over ``statistics``."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, stats), float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, stats: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [stats[s] <= t if op == "<=" else stats[s] > t for s, op, t in rule])


def fit(rows: DataFrame, *, trees: int = 10, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> RuleModel:
    """Fit on ``training_rows``. Without rows, or with one class only, the score is the smoothed share of label 1."""
    ones, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    if not 0 < ones < n:
        import math

        p = (ones + 1) / (n + 2)
        return RuleModel([], math.log(p / (1 - p)))
    x = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="3", minInstancesPerNode=5, subsamplingRate=0.7).fit(x)
    rules = sorted({p for t in forest.trees for p in paths(t.toDebugString)})
    stats = {s: F.col(s) for s in NAMES}
    flags = rows.select("label", *[holds(r, stats).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    z = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags)
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=40, tol=1e-4).fit(z.select("label", "features"))
    return RuleModel([(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w], lasso.intercept)


def classify(docs: DataFrame, model: RuleModel, *, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``_quality = struct(held_out, score, predicted)``, computed in column expressions only.

    Null and empty texts are scored as empty ones; a null id is not held out. Repeated rows have equal scores; an empty table stays one. Other
    columns pass through, whatever their names; one that is called ``_quality`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "_quality"]
    stats, score = unused("_stats", kept), unused("_score", kept)
    scored = docs.withColumn(stats, F.struct(*[c.alias(k) for k, c in statistics(F.col("text")).items()]))
    scored = scored.withColumn(score, model.score({k: F.col(f"{stats}.{k}") for k in NAMES}))
    q = F.struct(held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= threshold).cast("int").alias("predicted"))
    return scored.select(*[F.col(f"`{c}`") for c in kept], q.alias("_quality"))
