"""Interval joins by time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near_join(left_df: DataFrame, right_df: DataFrame, keys: list[str], ts: str, *, back: float, ahead: float, left: str = "l", right: str = "r") -> DataFrame:
    """Pairs with equal keys and ``-ahead <= left.ts - right.ts <= back``, under the aliases ``left`` and ``right``.

    Time is cut into buckets as wide as the reach; a right row goes to the buckets it can meet, so the join has equal keys and
    a task sees one bucket, not a whole stream.
    """
    width = back + ahead
    x = left_df.withColumn("_bucket", F.floor(F.col(ts) / width)).alias(left)
    y = right_df.withColumn("_bucket", F.explode(F.sequence(F.floor((F.col(ts) - ahead) / width), F.floor((F.col(ts) + back) / width)))).alias(right)
    on = F.col(f"{left}._bucket") == F.col(f"{right}._bucket")
    for k in keys:
        on = on & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    dt = F.col(f"{left}.{ts}") - F.col(f"{right}.{ts}")
    return x.join(y, on).where((dt <= back) & (dt >= -ahead))
