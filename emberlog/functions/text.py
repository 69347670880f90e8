"""Column functions for names, verbs and coins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coin denominations in copper, the tokens for the viewer, irregular verbs.
COPPER = {"platinum": 1_000_000, "gold": 10_000, "silver": 100, "copper": 1}
YOU = ("You", "Your", "YOU", "YOUR", "you", "your", "yourself", "Yourself")
VERBS = {"tries": "try", "dies": "die", "lies": "lie", "has": "have", "is": "be", "does": "do"}


def is_you(name: Column) -> Column:
    return F.coalesce(name.isin(*YOU), F.lit(False))


def is_npc(name: Column) -> Column:
    """An article before a word: the shape of names that are no player's."""
    return F.coalesce(name.rlike(r"^(?:a|an|the)\s+[A-Za-z]"), F.lit(False))


def as_player(name: Column, player: str) -> Column:
    return F.when(is_you(name), F.lit(player)).otherwise(name)


def lemma(verb: Column) -> Column:
    """Base form of a present-tense verb: known forms, then -ies, -es after a hiss, -s but not -ss."""
    v = F.lower(F.trim(verb))
    known = F.create_map(*[F.lit(x) for kv in VERBS.items() for x in kv])
    return (F.when(F.try_element_at(known, v).isNotNull(), F.try_element_at(known, v))
            .when(v.rlike(".{2,}ies$"), F.regexp_replace(v, "ies$", "y"))
            .when(v.rlike("(?:s|sh|ch|x|z)es$"), F.regexp_replace(v, "es$", ""))
            .when(v.rlike("[^s]s$"), F.regexp_replace(v, "s$", "")).otherwise(v))


def digits(text: Column) -> Column:
    """A number read with look-alike letters and spaces between its digits."""
    return F.translate(F.translate(text, " ", ""), "IlO|", "1101").try_cast("long")


def copper(text: Column) -> Column:
    """All ``<number> <denomination>`` parts of a text in copper; null without one."""
    part = r"([\dIlO|]+)\s+(platinum|gold|silver|copper)"
    numbers, names = F.regexp_extract_all(text, F.lit(part), 1), F.regexp_extract_all(text, F.lit(part), 2)
    value = F.create_map(*[x for k, v in COPPER.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    worth = F.zip_with(numbers, names, lambda n, d: F.coalesce(digits(n), F.lit(0)) * F.element_at(value, d))
    return F.when(F.size(numbers) > 0, F.aggregate(worth, F.lit(0).cast("long"), lambda a, x: a + x))


def coin_text(amount: Column) -> Column:
    """Copper as text by denomination, largest first: 1050 is ``10s 50c``, nothing is ``0c``."""
    parts, rest = [], F.coalesce(amount, F.lit(0)).cast("long")
    for name, worth in COPPER.items():
        n = F.floor(rest / worth)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(name[0]))))
        rest = rest % worth
    out = F.concat_ws(" ", *parts)
    return F.when(out == "", "0c").otherwise(out)


def glyph_fold(name: Column) -> Column:
    """Letters that OCR takes for each other become one."""
    return F.translate(F.replace(F.lower(name), F.lit("ffi"), F.lit("m")), "d01iv", "polly")


def name_limit(length: Column) -> Column:
    """Edits that two spellings of one name of this length may differ by."""
    return F.when(length < 5, 0).when(length <= 8, 1).when(length <= 16, 2).otherwise(3)


def word_limit(length: Column) -> Column:
    return F.when(length <= 3, 0).when(length <= 6, 1).when(length <= 12, 2).otherwise(3)


def close_spellings(a: Column, b: Column) -> Column:
    """Whether two folded names are spellings of one: word by word within limits, whole where word counts differ.

    The first word, or the one behind a common article, may have lost its leading letters: two letters must be left, four behind an article. Marks at a
    word's ends do not count.
    """
    total = name_limit(F.least(F.length(a), F.length(b)))
    wa, wb = F.split(a, " "), F.split(b, " ")
    bare = lambda w: F.regexp_replace(w, "^[^0-9a-z]+|[^0-9a-z]+$", "")
    article = (wa[0] == wb[0]) & wa[0].isin("a", "an", "the")
    at, keep = F.when(article, 1).otherwise(0), F.when(article, 4).otherwise(2)
    pairs = F.zip_with(F.transform(wa, bare), F.transform(wb, bare), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def one(p: Column, i: Column) -> Column:
        short = F.least(F.length(p["x"]), F.length(p["y"]))
        d = F.levenshtein(p["x"], p["y"])
        clipped = (i == at) & (short >= keep) & (F.endswith(p["x"], p["y"]) | F.endswith(p["y"], p["x"]))
        return F.when(clipped, F.abs(F.length(p["x"]) - F.length(p["y"]))).when(d <= word_limit(short), d)

    used = F.transform(pairs, one)
    by_word = F.forall(used, lambda d: d.isNotNull()) & (F.aggregate(used, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) <= total)
    return (a == b) | F.when(total == 0, F.lit(False)).when(F.size(wa) == F.size(wb), by_word).otherwise(F.levenshtein(a, b) <= F.least(F.lit(2), total))


#: Letters that stand for a digit where a word is made of such letters and digits.
LOOKALIKE = {"i": "1", "l": "1", "o": "0"}


def compared(text: Column) -> Column:
    """A line as it is compared: lower-case words of letters and digits; in words that read as numbers look-alike letters are digits."""
    line = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "['’‘`]", ""), "[^0-9a-z]+", " "))
    mended = F.array_join(F.transform(F.split(line, " "), lambda w: F.when(w.rlike("^[ilo]*[0-9][0-9ilo]*$"), F.translate(w, "ilo", "110")).otherwise(w)), " ")
    # few lines hold such a word, so few are taken apart
    return F.when(line.rlike("(?:^| )(?:[0-9]+[ilo]|[ilo]+[0-9])[0-9ilo]*(?: |$)"), mended).otherwise(line)


def numbers_of(norm: Column) -> Column:
    """The numbers of a compared line, one a word, in order; a lone look-alike letter is its digit."""
    return F.filter(F.transform(F.split(norm, " "), lambda w: F.when(w.isin("i", "l"), "1").when(w == "o", "0").otherwise(F.regexp_replace(w, "[^0-9]", ""))), lambda n: n != "")


def digits_of(norm: Column) -> Column:
    """All digits of a compared line. One without a lone look-alike letter is not taken apart."""
    found = F.translate(norm, "abcdefghijklmnopqrstuvwxyz ", "")
    apart = norm.rlike("(?:^| )[ilo](?: |$)") | (F.translate(found, "0123456789", "") != "")
    return F.when(apart, F.array_join(numbers_of(norm), "")).otherwise(found)


def digits_agree(x: Column, y: Column) -> Column:
    """Whether two lines' ``digits_of`` are equal, or one has none."""
    return (x == y) | (x == "") | (y == "")


def numbers_agree(a: Column, b: Column) -> Column:
    """Whether the digits of two compared lines are equal, or one has none."""
    return digits_agree(digits_of(a), digits_of(b))


def same_numbers(a: str, b: str) -> bool:
    """``numbers_agree`` of two texts."""
    x, y = ("".join(LOOKALIKE.get(w) or re.sub("[^0-9]", "", w) for w in s.split()) for s in (a, b))
    return x == y or not x or not y
