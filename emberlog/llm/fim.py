"""Fill-in-middle rows: a text is cut at two unit ranks and its middle moved to the end.

Units are runs of Latin letters and single other code points. The ranks come from a hash of the id; an indexable skip list over the units turns
each into a code point offset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: One unit in LANE of a lane also stands in the lane above it.
LANE = 16
#: Code points classified at once.
STRETCH = 1 << 20


def unit_starts(text: str) -> np.ndarray:
    """The code point offsets at which units start, with the text's length at the end."""
    found, before = [], False
    for at in range(0, len(text), STRETCH):
        points = np.frombuffer(text[at:at + STRETCH].encode("utf-32-le"), np.uint32)
        letter = (points | 32) - np.uint32(97) < 26
        inside = letter.copy()
        inside[1:] &= letter[:-1]
        inside[0] &= before
        before = bool(letter[-1])
        found.append(np.flatnonzero(~inside) + at)
    return np.concatenate([*found, [len(text)]]).astype(np.int64)


class SkipList:
    """Units in order, with express lanes above them. Each node of a lane carries the units and the code points up to the lane's next node.

    Which units stand in a higher lane is drawn with a fixed seed, so equal texts have equal lists.
    """

    def __init__(self, text: str):
        starts = unit_starts(text)
        self.units = len(starts) - 1
        nodes, widths, points = np.arange(self.units), np.ones(self.units, np.int64), np.diff(starts)
        self.lanes = [(None, widths, points)]
        rng = np.random.default_rng(self.units)
        while len(nodes) > LANE:
            up = rng.integers(0, LANE, len(nodes)) == 0
            up[0] = True
            first = np.flatnonzero(up)
            widths, points, nodes = np.add.reduceat(widths, first), np.add.reduceat(points, first), nodes[first]
            self.lanes.append((first, widths, points))

    def offset(self, rank: int) -> int:
        """The code points before the unit of this rank (0 to ``units``): each lane is followed while its next node is not beyond the rank."""
        node, units, points = 0, 0, 0
        for down, widths, lengths in reversed(self.lanes):
            while units < rank and units + widths[node] <= rank:
                units, points, node = units + int(widths[node]), points + int(lengths[node]), node + 1
            if units == rank:
                return points
            node = int(down[node]) if down is not None else node
        raise IndexError(rank)


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits from the id; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, doc_id: int | None, *, plain: int = 10, spm: int = 20, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, prefix code points, middle code points, output)`` of one text.

    ``plain`` of 100 texts stay as they are, as do empty ones and those that hold a mark; of the others ``spm`` of 100 put the suffix first.
    """
    index = SkipList(text)
    n = index.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = (index.offset(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text of an output. A text with marks stays plain, so the first of each mark is the one that was put in."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    first, second = head[len(PREFIX):].split(SUFFIX if form == "psm" else PREFIX, 1)
    return first + middle + second if form == "psm" else second + middle + first


def fill_in_middle(df: DataFrame, *, text: str = "text", doc_id: str = "doc_id", plain: int = 10, spm: int = 20, seed: int = 1) -> DataFrame:
    """``(doc_id, text, n, form, prefix_chars, middle_chars, output)`` of every whole text, row by row.

    A null text counts as empty, a null id as the empty text in the hash. Repeated rows give repeated results, an empty table none; other
    columns are not read.
    """
    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            rows = [rearranged(t, i, plain=plain, spm=spm, seed=seed) for i, t in zip(ids, texts)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                                             ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"])

    src = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long, output string")


def rebuilt(df: DataFrame, *, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """``df`` with ``out``, the text rebuilt from an output and its form; a null output gives an empty text. A clashing column is replaced."""
    from emberlog.llm.bpe import with_arrow

    made = df.withColumn(out, F.struct(F.coalesce(F.col(output), F.lit("")).alias("o"), F.col(form).alias("f")))
    return with_arrow(made, out, out, "string", lambda values: [restored(v["o"], v["f"]) for v in values.to_pylist()])


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
    CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(list_slice(units, 1, a), '') AS x, array_to_string(list_slice(units, a + 1, b), '') AS m,
    array_to_string(list_slice(units, b + 1, n), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(x) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
"""
