"""Lines that hold several messages, read apart in one pass.

Every place of a line where a message could begin is marked, which cuts the line into atoms. All stretches of consecutive atoms are read by one parser, and
of the ways to lay stretches end to end the one that reads most of the line is taken. What begins a message follows from the message table: its
first fixed words, and the words that follow a name at the start of a form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.tables import settled, spread
from emberlog.operators import messages as M
from emberlog.operators.parse import parse

#: Between two atoms.
GAP = "\x03"
#: No message is longer, in words; longer stretches are only looked at from the line's start or to its end.
LONGEST = 60
#: Words of a stretch of prose count once, of other messages twice: prose may end in anything.
PROSE = ("consider", "personal", "status", "zone")
UNREAD = ("unknown", "marker", "ability_partial")
#: A stretch that cannot be read is cut off from this many words on; a shorter one is likelier a misread name.
SHORTEST_UNREAD = 4


def _begins() -> str:
    """What the message table says of how messages begin, as a pattern behind a space."""
    heads, verbs = set(), {r"(?!(?:points|coins|this|his|its)\b)[a-z]{2,}s"}
    for form in (*M.SAID, *M.FORMS):
        fixed = re.match(r"[A-Z][a-z]*(?: [a-z]+)?(?=[ ,.:!]|$)", form.text)
        if fixed and form.kind != "consider" and not fixed[0].startswith("You"):
            heads.add(fixed[0])
        verb = re.match(r"\{(?:actor|target)(?::(?!owner|caster)\w+)?\} ([a-z|]+) ", form.text)
        verbs |= set(verb[1].split("|")) if verb else set()
    verb = "(?:" + "|".join(sorted(verbs)) + r")\b"
    heads_ = "|".join(sorted(heads))
    owner = r"[A-Z][\w'-]*'s [A-Z]"
    beast = rf"(?:an?|the)(?: [\p{{Alpha}}-]+){{1,4}}?(?: {verb}|'s [A-Z])"
    sure = rf"Your?\b|YOU takes?\b|--(?=[A-Z])|(?:{heads_})\b|{owner}|{beast}"
    # a name before a verb, but no word of an ability's name behind its owner
    word = r"[A-Z][\p{Alpha}']{0,19} "
    free = "".join(rf"(?<!(?:'s|s'|Your) {word * n})" for n in range(4))
    name = rf"{free}[A-Z][\w'-]* {verb}"
    return rf"(?<=\S) (?={sure}|{name})"


BEGINS = _begins()
#: The beginnings that no word inside a message looks like.
SURE = r"^(?:(?:an?|the) |Your?\b|YOU\b|--|[A-Z][\w'-]*'s |[A-Z][\w'-]* loots? )"


def starts_message(text: Column) -> Column:
    """Whether a text reads like the start of a message, so that it does not continue a line before it; null does not."""
    return F.coalesce(F.concat(F.lit(". "), F.trim(F.translate(text, "’‘", "''"))).rlike(r"^\." + BEGINS.removeprefix(r"(?<=\S)")), F.lit(False))


def atoms(text: Column) -> Column:
    """A line cut wherever a message could begin."""
    return F.split(F.regexp_replace(F.translate(text, "’‘", "''"), BEGINS, GAP), GAP, -1)


def fused(e: DataFrame) -> Column:
    """Whether a field of an event holds a place where another message could begin."""
    return reduce(lambda a, b: a | b, [F.coalesce(e[c].rlike(BEGINS), F.lit(False)) for c in ("actor", "target", "skill", "item", "dtype")])


def best(last: int, stretches: dict[tuple[int, int], tuple[int, bool, bool, bool, bool]]) -> list[tuple[int, int]]:
    """The stretches ``(first, last atom)`` that cover atoms 0 to ``last`` and read most of them.

    ``stretches`` gives for each its words, whether it is read, prose, consideration, and whether it may stand unread before the next. Most weight wins, then
    the fewest pieces, then the earliest cut. A consideration of several sentences is one, so none follows another.
    """
    found: dict[tuple[int, bool], tuple] = {(last + 1, False): (0, 0, ())}
    for i in range(last, -1, -1):
        for j in range(i, last + 1):
            if (i, j) not in stretches:
                continue
            words, read, prose, considers, cut = stretches[i, j]
            if not read and not (j == last or cut):
                continue
            weight = 0 if not read else words if prose else 2 * words
            for follows in (False, True):
                rest = found.get((j + 1, follows))
                if rest is None or (considers and follows):
                    continue
                way = (rest[0] + weight, rest[1] - 1, ((i, j), *rest[2]))
                at = (i, considers)
                if at not in found or (way[:2], [-b for _, b in way[2]]) > (found[at][:2], [-b for _, b in found[at][2]]):
                    found[at] = way
    ways = [w for c in (False, True) if (w := found.get((0, c)))]
    return list(max(ways, key=lambda w: (w[:2], [-b for _, b in w[2]]))[2]) if ways else [(0, last)]


def parse_fused(lines: DataFrame, player: str = "You") -> DataFrame:
    """``lines(stream_id, seq, ts, text)`` to events with ``part``, the message's number in its line, from 0.

    A line that reads as one message stays whole, chat too whatever it quotes. A stretch that cannot be read stays by itself as an unknown event if it has
    four words or more, does not end in a possessive and a sure beginning follows it; a rest that cannot be read always does. Null and
    empty texts are one unknown event.

    Lines of a log repeat, and what a line holds follows from its text alone, so each different text is read once and joined to its lines; a stream's lines are read one by one.
    """
    if lines.isStreaming:
        return _read(lines, player)
    told = lines.select("stream_id", "seq", "ts", F.col("text").alias("_line"))
    texts = spread(settled(told.select("_line").distinct()))
    read = _read(texts.select(F.col("_line").alias("stream_id"), F.lit(0).alias("seq"), F.lit(0.0).alias("ts"), F.col("_line").alias("text")), player)
    read = read.withColumnRenamed("stream_id", "_read").drop("seq", "ts")
    return told.join(read.hint("merge"), F.col("_line").eqNullSafe(F.col("_read"))).drop("_line", "_read")


def _read(lines: DataFrame, player: str) -> DataFrame:
    """``parse_fused`` of every line. One parser, no shuffle: the stretches of a line are made, read and chosen in one task."""
    cut = atoms(F.col("text"))
    a = lines.select("stream_id", "seq", "ts", F.when(F.size(cut) > 1, cut).otherwise(F.array("text")).alias("a"))
    n = F.size("a")
    to = lambda i: F.transform(F.sequence(i, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), F.slice("a", i + 1, j - i + 1).alias("s")))
    every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), to))
    text = lambda x: F.when(F.size(x["s"]) == 1, x["s"][0]).otherwise(F.array_join(x["s"], " "))
    rows = a.select("stream_id", "seq", "ts", n.alias("n"), F.explode(every).alias("x")).select("stream_id", "seq", "ts", "n", F.col("x.i").alias("i"), F.col("x.j").alias("j"), text(F.col("x")).alias("text"))
    words = F.coalesce(F.size(F.split(F.trim("text"), r"\s+")), F.lit(0))
    rows = rows.withColumn("words", words).where((F.col("words") <= LONGEST) | (F.col("i") == 0) | (F.col("j") == F.col("n") - 1))
    read = parse(rows.select(F.struct("stream_id", "i", "j", "n", "words").alias("stream_id"), "seq", "ts", "text"), player)
    bad = read["kind"].isin(*UNREAD) | fused(read)
    ends = ~F.coalesce(F.col("text").rlike(r"(?:'s|s')\s*$"), F.lit(False)) & (F.col("stream_id.words") >= SHORTEST_UNREAD)
    read = read.withColumns({"_read": ~bad, "_sure": F.coalesce(F.col("text").rlike(SURE), F.lit(False)), "_ends": ends})
    fields = [f for f in read.columns if not f.startswith("_") and f != "stream_id"]
    flat = read.select(F.col("stream_id.stream_id").alias("stream_id"), *fields, *[F.col(f"stream_id.{c}").alias(f"_{c}") for c in ("i", "j", "n", "words")], "_read", "_sure", "_ends")
    kept = ["stream_id", *fields]
    types = {f.name: f.dataType.simpleString() for f in flat.schema}
    marks = ["seq", "kind", "_i", "_j", "_n", "_words", "_read", "_sure", "_ends"]

    def run(batches: Iterator):
        import pyarrow as pa

        def chosen(table: pa.Table, ends_here: bool):
            """The chosen rows of the whole lines of ``table``, and what belongs to a line that goes on."""
            cols = [table.column(c).to_pylist() for c in marks]
            names = table.column("stream_id").to_pylist()
            take, part, at = [], [], 0
            for k in range(len(names)):
                over = k + 1 == len(names) or (names[k + 1], cols[0][k + 1]) != (names[k], cols[0][k]) or (cols[2][k + 1], cols[3][k + 1]) == (0, 0)
                if not over or (k + 1 == len(names) and not ends_here):
                    continue
                if k == at:
                    take.append(k)
                    part.append(0)
                else:
                    where = {(cols[2][r], cols[3][r]): r for r in range(at, k + 1)}
                    sure = {i: cols[7][r] for (i, _), r in where.items()}
                    facts = {(i, j): (cols[5][r], cols[6][r], cols[1][r] in PROSE, cols[1][r] == "consider", cols[8][r] and sure.get(j + 1, False)) for (i, j), r in where.items()}
                    for p, piece in enumerate(best(cols[4][at] - 1, facts)):
                        take.append(where[piece])
                        part.append(p)
                at = k + 1
            out = table.take(pa.array(take, pa.int64())).select(kept).append_column("part", pa.array(part, pa.int64()))
            return out.to_batches(), table.slice(at)

        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None or not len(rest) else pa.concat_tables([rest, pa.Table.from_batches([b])])
            out, rest = chosen(t, False)
            yield from out
        if rest is not None and len(rest):
            yield from chosen(rest, True)[0]

    return flat.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in kept) + ", part long")


def split_fused(lines: DataFrame, player: str = "You") -> DataFrame:
    """``(stream_id, seq, ts, part, text)``: the messages of each line, apart and in order; rules as for ``parse_fused``."""
    return parse_fused(lines, player).select("stream_id", "seq", "ts", "part", "text")
