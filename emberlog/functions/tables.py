"""Results that are used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql.types import NullType


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``, where lost executors do no harm. Where it is unset, a temporary one in local mode; on a
    cluster an error.

    It is kept by columns, so that each step that uses it reads its own ones alone; a column without a type is kept by rows."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="emberlog-"))
    if any(isinstance(f.dataType, NullType) for f in df.schema):
        return df.checkpoint()
    path = f"{sc.getCheckpointDir().rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a part whose rows are costly.
PART = 50_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores, and to parts of about ``PART`` rows, where it comes in fewer parts, for steps whose rows cost far more than their bytes say, such as
    parsing; else as it is. The rows are counted, without the columns that only the step reads."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
