"""Learned names: counts by category, spellings grouped under the best one, and which names are known to differ.

A vocabulary keeps the most frequent ``TOP`` names of a category, so its tables have a proven bound: grouping is one task a category, and the finished
vocabulary may be a value that tasks carry.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from emberlog.functions import text as T
from emberlog.functions.groups import per_group
from emberlog.operators import messages as M
from emberlog.operators.resolve import spelling_pairs

# Kinds that name combatants, how much more often the better spelling is read, readings that make a name sure, the share below which a name is
# a cut-off one, words that begin sentences.
NAME_KINDS = ("melee_hit", "melee_miss", "ability_hit", "ability_partial", "ability_miss", "env_damage", "heal", "cast", "interrupt", "resist", "fizzle", "kill", "loot", "coin", "cc", "cc_fade",
              "debuff", "damage_effect", "aggro", "awaken")
COUNT_TIMES, WORD_TIMES, SURE, CUT_OFF = 2, 4, 10, 0.02
SENTENCE_WORDS = ("a", "an", "the", "this", "that", "there", "someone", "something", "starting", "stopped", "beginning", "entering", "loading", "welcome")
LEAST, TOP = 2, 5000
#: A creature's name as a whole: no word of it, the last neither, is one that follows names in sentences.
WHOLE_BEAST = M.BEAST.replace(") )", ")(?: |$))").removesuffix("?")


@F.pandas_udf(StringType())
def unaccented(s: pd.Series) -> pd.Series:
    """Letters without accents."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def cleaned(name: Column) -> Column:
    """A name without stray marks at its ends."""
    return F.regexp_replace(F.trim(name), r"^[^0-9A-Za-z(\[]+|[^0-9A-Za-z)\]]+$", "")


def folded(name: Column) -> Column:
    """A cleaned name as it is compared: no accents, lower case, digits that look like letters as letters, single spaces. Only names with accents leave the JVM."""
    plain = cleaned(name)
    plain = F.when(plain.rlike(r"[^\x00-\x7f]"), unaccented(F.when(plain.rlike(r"[^\x00-\x7f]"), plain))).otherwise(plain)
    return F.trim(F.regexp_replace(F.translate(F.lower(plain), "0158|9", "olsblg"), r"\s+", " "))


def could_be_name(category: Column, name: Column) -> Column:
    """Whether a player's or creature's name has the shape of one, holds no word for the viewer and is not a word that only begins sentences. Other categories always."""
    shape = F.when(category == "npc", name.rlike(f"^{WHOLE_BEAST}$")).otherwise(name.rlike(rf"^{M.PLAYER}$"))
    words = F.split(F.lower(name), " ")
    you = F.arrays_overlap(words, F.array(*map(F.lit, sorted({w.lower() for w in T.YOU}))))
    alone = (F.size(words) == 1) & words[0].isin(*SENTENCE_WORDS)
    return F.coalesce(~category.isin("npc", "player") | (shape & ~you & ~alone), F.lit(False))


def learned(events: DataFrame) -> DataFrame:
    """``(category, name, n)``: readings of players, creatures, skills, items and zones in ``events``.

    Combatants are learned from the kinds that name them and only with a name's shape. Nulls and names of nothing but marks are none.
    """
    k = F.col("kind")
    who = lambda c: F.struct(F.when(T.is_npc(F.col(c)), "npc").otherwise("player").alias("category"), F.when(k.isin(*NAME_KINDS), F.col(c)).alias("name"))
    thing = lambda category, c, on: F.struct(F.lit(category).alias("category"), F.when(on, F.col(c)).alias("name"))
    has = set(events.columns)
    parts = [who("actor"), who("target"), thing("zone", "target", k == "zone")]
    parts += [thing("skill", "skill", k.isin("ability_hit", "ability_miss", "heal", "cast", "resist"))] if "skill" in has else []
    parts += [thing("item", "item", k.isin("loot", "reward", "harvest", "craft"))] if "item" in has else []
    n = events.select(F.explode(F.array(*parts)).alias("x")).select("x.category", cleaned(F.col("x.name")).alias("name")).where("name <> ''")
    return n.where(could_be_name(F.col("category"), F.col("name"))).groupBy("category", "name").agg(F.count("*").alias("n"))


def word_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)``: how often the chat holds each folded word."""
    words = F.regexp_extract_all(folded(F.col(text)), F.lit(r"[a-z0-9']+"), 0)
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def kept(counts: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """Of each category the ``top`` names read ``least`` times or more; the rest is not kept."""
    w = Window.partitionBy("category").orderBy(F.col("n").desc(), "name")
    return counts.where(F.col("n") >= least).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def neighbours(counts: DataFrame) -> DataFrame:
    """``counts`` with ``fold`` and ``near``: the names of the category whose spelling is close."""
    c = counts.withColumn("fold", folded(F.col("name")))
    names = c.select("category", "fold").distinct()
    pairs = spelling_pairs(names.select("category", F.col("fold").alias("name")), ["category"]).select("category", "a", "b")
    both = pairs.union(pairs.select("category", F.col("b"), F.col("a"))).union(names.select("category", "fold", "fold"))
    named = c.select(F.col("category"), F.col("fold").alias("b"), F.col("name").alias("other"))
    near = both.join(named, ["category", "b"]).groupBy("category", F.col("a").alias("fold")).agg(F.collect_list("other").alias("near"))
    return c.join(near, ["category", "fold"], "left").withColumn("near", F.filter(F.coalesce("near", F.array().cast("array<string>")), lambda x: x != F.col("name")))


def grouped(rows: list[tuple]) -> list[tuple]:
    """``(name, canonical)`` of one category's ``(name, n, fold, near, words)``.

    Names come from the most frequent to the rarest, shorter and then later ones first among equals. Each joins the oldest group that it is close to and whose
    spelling is better: the same when folded, read twice as often, or made of words that the chat holds four times as often. A name
    with such words instead of the spelling's becomes the group's spelling. A name that joins none begins a group.
    """
    facts = {name: (n, fold, set(near), {w: k for w, k in words}) for name, n, fold, near, words in rows}

    def better_words(a: str, b: str) -> bool | None:
        """Whether all words of ``a`` that ``b`` has otherwise are much more common; None if there are none, or the names have other numbers of words."""
        x, y = facts[a][1].split(), facts[b][1].split()
        other = [(p, q) for p, q in zip(x, y) if p != q] if len(x) == len(y) else None
        if not other:
            return None
        return all(facts[a][3].get(p, 0) >= WORD_TIMES * max(1, facts[b][3].get(q, 0)) for p, q in other)

    def leads(name: str, head: str) -> bool:
        return facts[name][1] != facts[head][1] and bool(better_words(name, head))

    def follows(name: str, head: str) -> bool:
        return facts[name][1] == facts[head][1] or facts[head][0] >= COUNT_TIMES * facts[name][0] or bool(better_words(head, name))

    groups: list[list[str]] = []
    at: dict[str, int] = {}  # the spelling of each group
    for name in sorted(facts, key=lambda x: (facts[x][0], -len(x), x), reverse=True):
        close = sorted((at[o], o) for o in facts[name][2] if o in at)
        home = next(((g, head) for g, head in close if leads(name, head) or follows(name, head)), None)
        if home is None:
            at[name] = len(groups)
            groups.append([name])
        elif leads(name, home[1]):
            at[name] = at.pop(home[1])
            groups[home[0]].insert(0, name)
        else:
            groups[home[0]].append(name)
    return [(name, g[0]) for g in groups for name in g]


def spellings(counts: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """``(category, name, n, fold, near, canonical)`` of ``counts(category, name, n)``; ``words(word, n)`` says which words the chat holds."""
    c = neighbours(counts)
    if words is None:
        with_words = c.withColumn("words", F.array().cast("array<struct<word:string,n:bigint>>"))
    else:
        each = c.select("category", "name", F.explode(F.array_distinct(F.split("fold", " "))).alias("word")).join(words.withColumnRenamed("n", "_n"), "word")
        each = each.groupBy("category", "name").agg(F.collect_list(F.struct("word", F.col("_n").alias("n"))).alias("words"))
        with_words = c.join(each, ["category", "name"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<word:string,n:bigint>>")))
    with_words = with_words.withColumn("words", F.transform("words", lambda x: F.array(x["word"], x["n"].cast("string"))))

    def rule(rows: list[tuple]) -> list[tuple]:
        return grouped([(name, n, fold, near, [(w, int(k)) for w, k in words]) for name, n, fold, near, words in rows])

    found = per_group(with_words.select("category", "name", "n", "fold", "near", "words"), ["category"], ["name"], rule, "name string, canonical string")
    return c.join(found, ["category", "name"])


@dataclass(frozen=True)
class Vocabulary:
    """Names with their spelling, the readings of each spelling with its variants, and which names are close; at most ``TOP`` names a category."""

    canonical: dict[tuple[str, str], str]
    total: dict[tuple[str, str], int]
    fold: dict[tuple[str, str], str]
    near: dict[tuple[str, str], frozenset[str]]

    def distinct(self, category: str, a: str, b: str, least: int = SURE) -> bool:
        """Whether two names are known to be two: other spellings that are not close, each read often with its variants, and neither a cut-off reading of
        names that it begins."""
        x, y = (self.canonical.get((category, n.strip())) for n in (a, b))
        if x is None or y is None or x == y or y in self.near[category, x]:
            return False
        if min(self.total[category, x], self.total[category, y]) < least:
            return False
        short, long = sorted((x, y), key=lambda n: len(self.fold[category, n]))
        start = self.fold[category, short] + " "
        if not self.fold[category, long].startswith(start):
            return True
        begun = sum(n for (c, s), n in self.total.items() if c == category and self.fold[c, s].startswith(start))
        return self.total[category, short] >= CUT_OFF * begun

    def differ(self, a: str, b: str) -> bool:
        """``distinct`` as creatures if one has an article, else as players."""
        npc = any(n.startswith(("a ", "an ", "the ")) for n in (a, b))
        return self.distinct("npc" if npc else "player", a, b)


def vocabulary(spelled: DataFrame) -> Vocabulary:
    """The finished vocabulary of ``spellings`` on the driver: names that ``kept`` has bounded."""
    rows = spelled.select("category", "name", "n", "fold", "near", "canonical").collect()
    total: Counter = Counter()
    for r in rows:
        total[r.category, r.canonical] += r.n
    key = {(r.category, r.name): r for r in rows}
    return Vocabulary({k: r.canonical for k, r in key.items()}, dict(total), {k: r.fold for k, r in key.items()}, {k: frozenset(r.near) for k, r in key.items()})
