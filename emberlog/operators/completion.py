"""Events mended by what the lines before them taught: clipped names, lost articles, end marks read as letters, lost possessives, attempts on the immune.

What a stream knew before a row is an as-of count: occurrences and questions of one name stand in one window, in order, and each question
takes the occurrences before it. Names are learned from lines that are read as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions import text as T
from emberlog.functions.tables import settled, spread
from emberlog.operators import messages as M
from emberlog.operators.parse import parse

# Letters that a clipped name may have lost, readings that make a name known well enough, kinds that teach nothing or name abilities, letters an end mark is
# read as, seconds in which an attempt is the one that immunity stopped.
LOST, LEAST = 2, 2
SILENT = ("unknown", "personal", "consider", "zone", "chat")
SKILLS = ("ability_hit", "heal", "cast", "resist")
GLYPHS, IMMUNE_S = r"[lI1|]$", 2.0
LONGEST_NAME = 7
IMMUNE_TO = r"(?i)\bimmune to .+?(?:'s|s) (.+?)[\s.!?,:;'\"-]*$"


def occurrences(events: DataFrame) -> DataFrame:
    """``(stream_id, seq, category, name)``: players, creatures and abilities as ``events`` name them; the viewer is none."""
    who = lambda c: F.when(~T.is_you(F.col(c)), F.struct(F.when(T.is_npc(F.col(c)), "npc").when(F.col(c).rlike(rf"^{M.PLAYER}$"), "player").alias("category"), F.col(c).alias("name")))
    skill = F.when(F.col("kind").isin(*SKILLS), F.struct(F.lit("skill").alias("category"), F.col("skill").alias("name")))
    e = events.where(~F.col("kind").isin(*SILENT)).select("stream_id", "seq", F.explode(F.array(who("raw_actor"), who("target"), skill)).alias("x"))
    return e.select("stream_id", "seq", "x.*").where("category is not null and name is not null")


def known_before(asked: DataFrame, seen: DataFrame) -> DataFrame:
    """``asked(stream_id, seq, category, name, ...)`` with ``known``, how often the stream held the name before the row, and ``first``, where it did so first."""
    rest = [c for c in asked.columns if c not in ("stream_id", "seq", "category", "name")]
    both = asked.select("stream_id", "seq", "category", "name", F.struct(*rest).alias("rest"), F.lit(0).alias("one")).unionByName(
        seen.join(asked.select("stream_id", "category", "name").distinct(), ["stream_id", "category", "name"], "left_semi").withColumn("one", F.lit(1)), allowMissingColumns=True)
    # a question at a row stands before the row's own names
    w = Window.partitionBy("stream_id", "category", "name").orderBy("seq", "one").rowsBetween(Window.unboundedPreceding, -1)
    k = both.withColumn("known", F.coalesce(F.sum("one").over(w), F.lit(0))).withColumn("first", F.min(F.when(F.col("one") == 1, F.col("seq"))).over(w)).where("one = 0")
    return k.select("stream_id", "seq", "category", "name", "rest.*", "known", "first")


def candidates(unread: DataFrame, seen: DataFrame) -> DataFrame:
    """``(stream_id, seq, category, name, text)``: names that ``unread(stream_id, seq, text)`` may begin with, and the line with the name put back.

    A first word in lower case may be the end of a player's name; first words may be a creature's name without its article. Names meet
    lines by what is left of them.
    """
    names = seen.select("stream_id", "category", "name").distinct()
    lead = F.regexp_extract("text", r"^([a-z][A-Za-z-]*)(?=\s|'s\b|'\s)", 1)
    u = unread.withColumn("_lead", lead).where(~F.col("_lead").isin("", "a", "an", "the"))
    tails = names.where("category = 'player'").withColumn("_lead", F.explode(F.array(*[F.lower(F.expr(f"substring(name, {n + 1})")) for n in range(1, LOST + 1)]))).where("_lead <> ''")
    players = u.join(tails, ["stream_id", "_lead"]).select("stream_id", "seq", "category", "name", F.concat("name", F.expr("substring(text, length(_lead) + 1)")).alias("text"))
    rests = names.where("category = 'npc'").withColumn("_rest", F.regexp_replace("name", r"^\S+\s+", "")).withColumn("_article", F.substring_index("name", " ", 1))
    words = F.split("text", " ")
    heads = u.select("stream_id", "seq", "text", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(words) - 1, F.lit(LONGEST_NAME))), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("_rest")).where("text like '% %'")
    beasts = heads.join(rests, ["stream_id", "_rest"]).select("stream_id", "seq", "category", "name", F.concat_ws(" ", "_article", "text").alias("text"))
    return players.union(beasts)


def completed(events: DataFrame, player: str = "You") -> DataFrame:
    """``events`` with unread lines that a name put back makes readable as their events; ``text`` stays what was read.

    A name counts if its stream held it twice or more before. Players go before creatures, then the name read most often, then the one read first.
    Lines that stay unread stay unknown. Null texts and streams without names too.
    """
    e = settled(events)
    seen = occurrences(e)
    unread = e.where("kind = 'unknown' and text is not null").select("stream_id", "seq", "ts", F.trim(F.translate("text", "’‘", "''")).alias("text"))
    k = known_before(candidates(unread.drop("ts"), seen), seen).where(F.col("known") >= LEAST)
    best = Window.partitionBy("stream_id", "seq").orderBy((F.col("category") != "player").cast("int"), F.col("known").desc(), "first", "name")
    k = k.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("stream_id", "seq", F.col("text").alias("whole"))
    lines = unread.join(k, ["stream_id", "seq"]).select("stream_id", "seq", "ts", F.col("whole").alias("text"))
    # settled before it is filtered: a filter on a kind would be pushed into the parser and read every line many times; the few bytes of the lines say nothing of their cost
    read = settled(parse(spread(settled(lines)), player)).where("kind <> 'unknown'")
    own = e.select("stream_id", "seq", F.col("text").alias("_own"))
    mended = read.join(own, ["stream_id", "seq"]).withColumn("text", F.col("_own")).select(*e.columns)
    return e.join(read.select("stream_id", "seq"), ["stream_id", "seq"], "left_anti").select(*e.columns).union(mended)


def _answered(e: DataFrame, asked: DataFrame, seen: DataFrame, out: str) -> DataFrame:
    """``e`` with ``out``: of the answers ``asked(stream_id, seq, category, name, rank, answer)`` to a row, the first by rank whose name was known before; null without one."""
    k = known_before(asked, seen).where("known > 0").groupBy("stream_id", "seq").agg(F.min_by("answer", "rank").alias(out))
    return e.join(k, ["stream_id", "seq"], "left")


def repaired_events(events: DataFrame, player: str = "You") -> DataFrame:
    """``events`` after three repairs that need earlier rows.

    An end mark that was read as a letter goes from the name or ability that ends the line, where the name without it is known and the whole is not. A hit whose
    attacker ends in a known ability is that ability's: the longest counts. The first attempt within two seconds after a creature was immune to that ability has
    no skill and outcome immune. Rows of unknown kind are left alone; a name at its own row is not known yet.
    """
    e = settled(events)
    seen = occurrences(e)
    end = F.regexp_replace(F.trim("text"), r"\s+", " ")
    fields = [("target", "player"), ("actor", "player"), ("skill", "skill")]
    glyph = e.where("kind <> 'unknown'").where(end.rlike(GLYPHS)).select("stream_id", "seq", F.coalesce(*[F.when(F.col(c).rlike(GLYPHS) & F.endswith(end, F.col(c)), F.struct(F.lit(c).alias("c"), F.col(c).alias("v"))) for c, _ in fields]).alias("x"))
    glyph = glyph.where("x is not null").select("stream_id", "seq", "x.c", "x.v")
    stem = F.rtrim(F.regexp_replace("v", GLYPHS, ""))
    category = F.when(F.col("c") == "skill", "skill").when(T.is_npc(F.col("v")), "npc").otherwise("player")
    # the whole spelling, if known, wins over the shorter one
    asks = glyph.select("stream_id", "seq", category.alias("category"), F.explode(F.array(F.struct(F.col("v").alias("name"), F.lit(0).alias("rank")), F.struct(stem.alias("name"), F.lit(1).alias("rank")))).alias("x"), "c")
    asks = asks.select("stream_id", "seq", "category", "x.name", "x.rank", F.struct("c", F.col("x.name").alias("v")).alias("answer"))
    e = _answered(e, asks, seen, "_g")
    put = lambda c: F.when(F.col("_g.c") == c, F.col("_g.v")).otherwise(F.col(c))
    e = e.withColumns({c: put(c) for c, _ in fields} | {"raw_actor": F.when(F.col("_g.c") == "actor", F.col("_g.v")).otherwise(F.col("raw_actor"))}).drop("_g")
    # attackers that end in an ability
    words = F.split("raw_actor", " ")
    parts = e.where("kind = 'melee_hit' and raw_actor like '% %'").select("stream_id", "seq", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("i")).where(F.expr("w[i] rlike '^[A-Z]'"))
    join = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    asks = parts.select("stream_id", "seq", F.lit("skill").alias("category"), join(F.col("i") + 1, F.size("w") - F.col("i")).alias("name"), F.col("i").alias("rank"), F.struct(join(F.lit(1), F.col("i")).alias("head")).alias("answer"))
    e = settled(_answered(e, asks, seen, "_a"))
    clean = F.trim(F.translate("text", "’‘", "''"))
    lines = e.where(F.col("_a").isNotNull() & F.startswith(clean, F.concat("raw_actor", F.lit(" ")))).select("stream_id", "seq", "ts", F.concat("_a.head", F.lit("'s "), F.expr("substring(trim(translate(text, '’‘', \"''\")), length(_a.head) + 2)")).alias("text"))
    hit = settled(parse(lines, player)).where("kind = 'ability_hit'").select("stream_id", "seq", F.struct("kind", "actor", "raw_actor", "skill", "dtype", "outcome").alias("_h"))
    e = e.join(hit, ["stream_id", "seq"], "left")
    now = lambda c: F.when(F.col("_h").isNotNull(), F.col(f"_h.{c}")).otherwise(F.col(c))
    e = e.withColumns({c: now(c) for c in ("kind", "actor", "raw_actor", "skill", "dtype", "outcome")}).drop("_a", "_h")
    return _immune(e)


def _immune(e: DataFrame) -> DataFrame:
    """The first attempt after each immunity, if it is the one that it stopped."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    says = (F.col("kind") == "status") & F.coalesce(F.col("outcome") == "immune", F.lit(False))
    ability = F.nullif(F.lower(F.regexp_extract(F.translate("text", "’‘", "''"), IMMUNE_TO, 1)), F.lit(""))
    e = e.withColumn("_im", F.last(F.when(says & ability.isNotNull(), F.struct("seq", "ts", "target", ability.alias("skill"))), True).over(w))
    fits = (F.col("kind") == "status") & ~says & (F.col("actor") == F.col("_im.target")) & (F.lower("skill") == F.col("_im.skill")) & (F.col("ts") - F.col("_im.ts")).between(0.0, IMMUNE_S)
    e = e.withColumn("_fit", F.coalesce(fits, F.lit(False)))
    first = F.row_number().over(Window.partitionBy("stream_id", "_im.seq", "_fit").orderBy("seq")) == 1
    stopped: Column = F.col("_fit") & first
    return e.withColumn("_s", stopped).withColumn("outcome", F.when(F.col("_s"), "immune").otherwise(F.col("outcome"))).withColumn("skill", F.when(~F.col("_s"), F.col("skill"))).drop("_im", "_fit", "_s")
