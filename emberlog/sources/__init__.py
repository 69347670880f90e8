"""Sources and sinks: raw logs, event and record lines, frames, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlog.config import EVENT_SCHEMA
from emberlog.functions import text as T
from emberlog.operators.boards import RECORD, valid

STAMP = r"^\[\w{3} (\w{3} +\d{1,2} \d\d:\d\d:\d\d \d{4})\]\s?(.*)$"


def raw_log(spark: SparkSession, path: str) -> DataFrame:
    """``(stream_id, seq, ts, text)`` of stamped text files, a stream for each; lines without a stamp take the one before.

    Whole files give true line numbers; a mark at the start, headers and blank lines are skipped.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("stream_id"), F.regexp_replace("value", "^\ufeff", "").alias("v"))
    lines = files.select("stream_id", F.posexplode(F.split("v", r"\r?\n")).alias("seq", "line")).where("trim(line) <> '' and not startswith(line, '# ')")
    stamp = F.try_to_timestamp(F.regexp_replace(F.regexp_extract("line", STAMP, 1), r" +", " "), F.lit("MMM d HH:mm:ss yyyy"))
    text = F.when(F.col("line").rlike(STAMP), F.regexp_extract("line", STAMP, 2)).otherwise(F.col("line"))
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return lines.select("stream_id", F.col("seq").cast("long").alias("seq"), F.last(stamp.cast("double"), True).over(w).alias("ts"), text.alias("text"))


def stamp(ts: Column) -> Column:
    """A line's stamp: ``[Fri Oct 02 01:57:34 2026]``."""
    t = F.timestamp_seconds(ts)
    return F.concat(F.lit("["), F.date_format(t, "E MMM dd HH:mm:ss yyyy"), F.lit("]"))


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stored events, one JSON object a line; bad lines and headers are skipped, unknown fields too. Coins are read from the text anew, old bleed debuffs are damage effects."""
    e = spark.read.schema(EVENT_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    e = e.where("_bad is null and ts is not null and text is not null").drop("_bad")
    old = (F.col("kind") == "debuff") & F.col("outcome").isin("bleeding", "barbed arrow")
    coin = F.col("kind").isin("coin", "coin_split")
    first = F.regexp_extract("text", r"^(.*?)(?: from | as your split|$)", 1)
    return e.withColumn("kind", F.when(old, "damage_effect").otherwise(F.col("kind"))).withColumn("copper", F.when(coin, F.coalesce(T.copper(first), "copper")).otherwise(F.col("copper")))


def write_event_lines(events: DataFrame, path: str) -> None:
    events.write.json(path)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """``(t_ms, x, y, h, text)`` of recorded frames."""
    schema = "frames array<struct<t_ms:long, lines:array<struct<x:int, y:int, h:int, text:string>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("frames").alias("f"))
    return f.select("f.t_ms", F.inline("f.lines"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Leaderboard lines that are valid, the first of each submission."""
    return valid(spark.read.schema(RECORD).json(path))


def names(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """Watch list: one row of names, or lines ``type,name`` below that header. All or nothing: an empty or overlong name, or more than ``most``, fails."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("v"))
    headed = F.lower("v").startswith("type,name")
    rows = raw.select(F.when(headed, F.transform(F.filter(F.slice(F.split("v", r"\r?\n"), 2, 1 << 20), lambda x: F.trim(x) != ""), lambda x: F.element_at(F.split(x, ","), 2)))
                      .otherwise(F.filter(F.split("v", r"[,\r\n]+"), lambda x: F.trim(x) != "")).alias("n"))
    n = rows.select(F.explode("n").alias("name")).select(F.trim("name").alias("name"))
    wrong = n.agg(F.count("*").alias("n"), F.count_if(~F.length("name").between(1, 64)).alias("bad")).first()
    if wrong["n"] > most or wrong["bad"]:
        raise ValueError(f"{wrong['n']} names, {wrong['bad']} not valid")
    return n.distinct()


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)
