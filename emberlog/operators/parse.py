"""Text lines to typed events: repairs, the message table and field expressions, all column expressions.

The forms of ``messages`` are tried in order. A form is only tried on lines that hold its longest fixed stretch, and the expression
that tests it also takes all its fields, as one string in the order of ``FIELDS``. Lines that no form takes are read once more with each unknown
word replaced by the message word that it is a misreading of.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from emberlog.functions import text as T
from emberlog.operators import messages as M

#: Between the fields of a packed event.
CUT = "\x01"
MARK = r"\((?:\d+ absorbed|Block \d+|Critical|Crippling Blow)\)"
SKILLED = ("ability_hit", "ability_miss", "heal", "cast", "resist", "debuff")
#: What of a word may be misread.
BARE = re.compile("[a-z0-9]{4,}")
#: Highest level a line can name.
TOP_LEVEL = 60


def repaired(line: Column) -> Column:
    """The line as the forms expect it: plain quotes, single spaces, no stamp or frame, numbers as digits, possessives marked.

    Every step uses the line once, so the expression grows with the steps and not with their product.
    """
    s = F.trim(F.regexp_replace(F.translate(line, "‘’´`“”^", "''''\"\" "), r"\s+", " "))
    unit, glyph = r"(?:points?|Health)\b", r"[\dIlO|]"
    steps = [
        (r"^\[\w{3} \w{3} \d+ [\d:]+ \d{4}\] ?|^[^\p{Alnum}(\[]+| ?--$", ""),
        (r"(?<=[a-z])(?<!\(x)(?=\d)|(?<=\d)(?=[A-Za-z])|(?<=[A-Za-z])-(?=(?:try|tries|hits|for|heals)\b)| -(?=\d)", " "),
        (r" {2,}", " "),
        (r" po[a-z]{2,5}s of ", " points of "),
        (r"(points? of )(?:[Cc]arnage|dam\w?[ a-z]?e?)(?=[.!:,]?$)", "$1damage"),
        (rf"(?<= for {glyph}{{1,6}}) (?={glyph}+(?: {glyph}+)* {unit})", ""),
        (rf"(?<= for {glyph}{{0,8}})[Il|](?={glyph}* {unit})", "1"),
        (rf"(?<= for {glyph}{{0,8}})O(?={glyph}* {unit})", "0"),
        (r"^(?:Vou|you)(r?)\b", "You$1"),
        (r"'s ", "^ "),
        (r"^(?!.*\^)([A-Z][a-zA-Z]+)s (?=[A-Z][\w' ]*? (?:hits|heals) )", "$1^ "),
    ]
    return reduce(lambda x, step: F.regexp_replace(x, *step), steps, s)


def completed(s: Column) -> Column:
    """A line that stops behind its number, ``points`` or ``of``, with the rest put back."""
    tail = r"^(.* for \d+)(?: point(?:s|)(?: of|)|)\P{Alnum}*$"
    rest = F.when(F.contains(s, F.lit(" heals ")), " Health.").otherwise(" points of damage.")
    return F.when(F.contains(s, F.lit(" for ")) & s.rlike(tail), F.concat(F.regexp_extract(s, tail, 1), rest)).otherwise(s)


def _list(values: list[str]) -> Column:
    """A constant array."""
    return F.split(F.lit(CUT.join(values)), CUT, -1)


#: The words of messages.
WORDS = frozenset(w for f in M.FORMS for w in re.findall(r"[a-z]{4,}", re.sub(r"\{[^}]*\}", " ", f.text)))


def _edits(word: str) -> int:
    """How many edits a misreading of a message word may hold."""
    return 2 if len(word) >= 8 else 1


def _shortened(word: str, n: int) -> set[str]:
    """The word without any ``n`` letters or fewer."""
    out = last = {word}
    for _ in range(n):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


@cache
def _by_rest() -> dict[str, list[str]]:
    """Message words by what is left of them without as many letters as they may differ by: two words within n edits have a rest without n letters in common."""
    found: dict[str, list[str]] = {}
    for word in WORDS:
        for rest in _shortened(word, _edits(word)):
            found.setdefault(rest, []).append(word)
    return found


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@lru_cache(1 << 16)
def _message_word(word: str) -> str:
    """The only message word that ``word`` is a misreading of, else ``word``."""
    if word in WORDS or word.isdigit() or len(word) > max(map(len, WORDS)) + 2:
        return word
    near = {k for rest in _shortened(word, 2) for k in _by_rest().get(rest, ()) if abs(len(k) - len(word)) <= 2}
    near = [k for k in near if _distance(k, word) <= _edits(k)]
    return near[0] if len(near) == 1 else word


@F.pandas_udf(StringType())
def reread(s: pd.Series) -> pd.Series:
    """The line with each lower-case word that is no message word replaced by the only one an edit away (two from eight letters on). Words repeat, so they are kept."""
    def one(w: str) -> str:
        bare = BARE.match(w)
        return _message_word(bare[0]) + w[bare.end():] if bare else w

    return s.map(lambda x: None if x is None else " ".join(map(one, x.split(" "))))


def _packed(s: Column, forms: list[tuple[int, M.Form, bool]]) -> Column:
    """The forms as one alternation: the line is replaced by its form's place and its fields, or left as it is.

    Each form is a group of its own, preceded by a look at its longest fixed stretch, which is cheap to miss. Only one form matches, so the groups that
    hold a field in any of them, one behind the other, are its value; the form's group is the only one of all forms' that is not empty,
    and as many marks stand before it as forms in the whole order.
    """
    parts, marks, fields, n, before = [], "", {f: "" for f in M.FIELDS}, 0, 0
    for i, form, loose in forms:
        pattern, groups = M.pattern_of(form, loose)
        n, marks, before = n + 1, marks + "\x02" * (i - before) + f"${n + 1}", i
        for g in groups:
            n += 1
            fields[g] += f"${n}"
        guard = M.anchor(form)
        parts.append(("(?=.*?" + re.sub(r"[.^$*+?()]", lambda m: "\\" + m[0], guard) + ")" if len(guard) > 1 else "") + f"({pattern[1:]})")
    return F.regexp_replace(s, "^(?:" + "|".join(parts) + ")", marks + CUT + CUT.join(fields[f] for f in M.FIELDS))


def _place(packed: Column) -> Column:
    """Which form, in the whole order, a packed line is of."""
    marks = F.substring_index(packed, CUT, 1)
    return F.length(marks) - F.length(F.ltrim(marks, F.lit("\x02")))


def _field(packed: Column, name: str) -> Column:
    return F.get(packed, F.lit(M.FIELDS.index(name) + 1))


def _level(raw: Column) -> Column:
    """A level from 2 to 60; a last 1, l, I or | may be the exclamation mark."""
    bare = F.replace(raw, F.lit(" "), F.lit(""))
    whole = F.regexp_replace(bare, "!+$", "")
    cut = F.when(~F.endswith(bare, F.lit("!")) & whole.rlike(r".[1lI|]$"), F.regexp_replace(whole, r".$", ""))
    ok = lambda x: F.when(T.digits(x).between(2, TOP_LEVEL), T.digits(x))
    return F.coalesce(ok(cut), ok(whole))


def _loose_words(skill: Column) -> Column:
    """How many words of an ability's name are lower case without being small words: two or more are no name."""
    return F.size(F.filter(F.split(skill, " "), lambda w: w.rlike("^[a-z]") & ~F.regexp_replace(w, r"[^A-Za-z]", "").isin(*M.SMALL_WORDS)))


#: The kinds that most lines are of; a line of them that needs no repair is read by a few forms alone.
COMMON = {" for ": ("melee_hit", "ability_hit", "heal"), " but ": ("melee_miss",), " slain ": ("kill",), " casting ": ("cast",), " entered ": ("zone",)}


def parse(lines: DataFrame, player: str = "You") -> DataFrame:
    """``lines(stream_id, seq, ts, text)`` to events. Text without a form is kind ``unknown``; a null text too. Other columns are not kept.

    One pass, no shuffle.
    """
    forms = [(i, f, loose) for i, (f, loose) in enumerate(M.ordered())]
    late = [x for x in forms if x[2] or x[1] in M.UNREAD or x[1] in M.PARTIAL]
    exact = [x for x in forms if x not in late]
    partial = [x for x in forms if x[1] in M.PARTIAL]
    hit = lambda c: F.contains(c, F.lit(CUT))
    tail = rf"(?:[.!]? ?{MARK})+[.!?, -]*$"
    text = F.coalesce(F.col("text"), F.lit(""))
    some = F.contains(text, F.lit("("))
    s = lines.select("stream_id", "seq", "ts", "text", F.when(some, F.regexp_replace(text, tail, "")).otherwise(text).alias("_t"), F.when(some, F.regexp_extract(text, tail, 0)).otherwise("").alias("_m"))
    plain, quick = F.replace("_t", F.lit("'s "), F.lit("^ ")), F.when(F.startswith("_t", F.lit("Your pet ")), None)
    for guard, kinds in COMMON.items():
        quick = quick.when(F.contains("_t", F.lit(guard)), _packed(plain, [x for x in exact if x[1].kind in kinds]))
    s = s.withColumn("_p", quick)
    s = s.withColumn("_p", F.when(hit(F.col("_p")), F.col("_p")))
    # the others are repaired and meet every form
    s = s.withColumn("_s", F.when(F.col("_p").isNull(), repaired(F.col("_t"))))
    s = s.withColumn("is_pet", F.coalesce(F.col("_s").rlike(r"^Your pet [A-Z]"), F.lit(False))).withColumn("_s", F.regexp_replace(F.regexp_replace("_s", r"^Your pet (?=[A-Z])", ""), tail, ""))
    s = s.withColumn("_p", F.when(F.col("_s").isNull(), F.col("_p")).otherwise(_packed(F.col("_s"), exact)))
    # what the forms do not take: cut off, misread, then the wide forms
    s = s.withColumn("_r", reread(F.when(~hit(F.col("_p")) & (F.col("_s") != ""), completed(F.col("_s")))))
    s = s.withColumn("_p", F.when(F.col("_r").isNull() | (F.col("_r") == F.col("_s")), F.col("_p")).otherwise(_packed(F.col("_r"), exact)))
    s = s.withColumn("_p", F.when(hit(F.col("_p")), F.col("_p")).when(F.col("_s") != "", _packed(F.col("_s"), late)))
    s = s.withColumn("_i", F.when(hit(F.col("_p")), _place(F.col("_p"))))
    first = min(i for i, f, _ in forms if f in M.UNREAD)
    fixed = {n: F.nullif(F.get(_list([f.fixed.get(n, "") for _, f, _ in forms]), F.col("_i")), F.lit("")) for n in ("outcome", "skill")}
    s = s.select("stream_id", "seq", "ts", "text", "_s", "_m", "is_pet", F.when(F.col("_i").isNotNull(), F.split("_p", CUT, -1)).alias("_f"), F.get(_list([f.kind for _, f, _ in forms]), F.col("_i")).alias("_k"),
                 F.coalesce(F.col("_i").between(first, first + len(M.UNREAD) - 1), F.lit(False)).alias("estimated"), *[c.alias(f"_fixed_{n}") for n, c in fixed.items()])
    only_marks = (F.col("_s") == "") & (F.col("_m") != "")
    kind = F.when(only_marks, "marker").otherwise(F.coalesce("_k", F.lit("unknown")))
    value = lambda f: F.coalesce(F.col(f"_fixed_{f}"), _field(F.col("_f"), f)) if f in fixed else _field(F.col("_f"), f)
    field = lambda c: F.nullif(F.trim(F.translate(c, "^", "\x02")), F.lit(""))
    s = s.select("stream_id", "seq", "ts", "text", "_s", "_m", "is_pet", kind.alias("kind"), "estimated", *[field(value(f)).alias(f"_{f}") for f in M.FIELDS])
    # two loose words in an ability's name: another message or noise
    bad = F.col("kind").isin(*SKILLED) & F.coalesce(_loose_words(F.col("_skill")) >= 2, F.lit(False))
    s = s.withColumn("_b", F.when(bad, _packed(F.coalesce("_s", F.replace("text", F.lit("'s "), F.lit("^ "))), partial)))
    s = s.withColumn("_c", F.when(hit(F.col("_b")), F.split("_b", CUT, -1)))
    s = s.withColumn("kind", F.when(F.col("_b").isNull(), F.col("kind")).when(F.col("_c").isNotNull(), "ability_partial").otherwise("unknown"))
    lost = lambda f: F.when(F.col("_b").isNull(), F.col(f"_{f}")).otherwise(field(_field(F.col("_c"), f)) if f in ("actor", "skill") else F.lit(None))
    s = s.select("stream_id", "seq", "ts", "text", "_m", "is_pet", "kind", (F.col("estimated") & F.col("_b").isNull()).alias("estimated"), *[lost(f).alias(f"_{f}") for f in M.FIELDS])
    return _events(s, player)


def _events(s: DataFrame, player: str) -> DataFrame:
    """Fields as text to typed columns, by kind."""
    k = F.col("kind")
    named = lambda c: F.replace(c, F.lit("\x02"), F.lit("'s"))
    bare = named(F.regexp_replace("_actor", "\x02$", ""))
    bare = F.coalesce(bare, F.when(k == "cannot_attack", "You"))
    actor, target = T.as_player(bare, player), T.as_player(named(F.col("_target")), player)
    target = F.when((k == "heal") & (F.lower("_target") == "them"), actor).otherwise(target)
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    absorbed, blocked = (F.regexp_extract("_m", p, 1).try_cast("long") for p in (r"(\d+) absorbed", r"Block (\d+)"))
    said = F.lower("_outcome")
    whose = F.lower(F.col("_target"))
    after = F.when(F.startswith(said, whose), F.substr(said, F.length(whose) + 2)).when(F.startswith(said, F.lit("you ")), F.substr(said, F.lit(5))).otherwise(said)
    miss = F.when(said.rlike("^miss(es)?$"), "miss").when(said.rlike(r"\babsorbs?\b"), "absorb").otherwise(T.lemma(F.regexp_extract(F.when(after == "", said).otherwise(after), r"^\S+", 0)))
    critical = F.col("_m").rlike("Critical|Crippling")
    outcome = (F.when(k.isin("melee_hit", "ability_hit"), F.when(critical, "critical").otherwise("hit")).when(k == "melee_miss", miss)
               .when(k == "marker", F.when(blocked.isNotNull(), "block").when(absorbed.isNotNull(), "absorb").otherwise("critical"))
               .when(k.isin("resist", "fizzle"), k).when(k.isin("cc", "cc_fade"), F.coalesce(F.try_element_at(table(M.CONTROL), said), said))
               .otherwise(F.rtrim(said)))
    skill = named(F.col("_skill"))
    verb = k.isin("melee_hit", "melee_miss", "status", "cast") & skill.rlike("^[a-z]+$") & ~F.coalesce(said == "fade", F.lit(False))
    skill = F.when(verb, F.coalesce(F.try_element_at(table(M.SKILL_NAMES), T.lemma(skill)), T.lemma(skill))).when(k == "consider", None).otherwise(skill)
    price, number = T.copper(F.col("_price")), T.digits(F.col("_amount"))
    share = T.copper(F.regexp_extract("_split", r"rece\w*\s+(.*)$", 1))
    share = F.when(k == "coin_split", F.coalesce(price, number)).when((k == "coin") & (share <= price), share)
    copper = F.when(k.isin("coin", "vendor"), price)
    amount = (F.when(F.col("estimated"), None).when(k == "coin", price).when(k == "coin_split", share).when(k == "vendor", F.coalesce(number, F.lit(1).cast("long"))).when(k == "level_up", _level(F.col("_amount")))
              .when(k == "marker", F.coalesce(blocked, absorbed)).otherwise(number))
    return s.select("stream_id", "seq", "ts", "kind", "text", actor.alias("actor"), target.alias("target"), amount.alias("amount"), skill.alias("skill"), F.when(F.col("_dtype").rlike("^(?:[Cc]arnage|dam\\w?[ a-z]?e?)$"), "damage").otherwise(F.col("_dtype")).alias("dtype"), outcome.alias("outcome"),
                    bare.alias("raw_actor"), absorbed.alias("absorbed"), blocked.alias("blocked"), F.col("_weapon").alias("weapon"), "is_pet", "estimated", F.lit(False).alias("estimated_ts"),
                    named(F.col("_item")).alias("item"), copper.alias("copper"), share.alias("split_copper"))
