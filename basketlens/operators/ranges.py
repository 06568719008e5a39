"""Global order in ranges: sorting, ranking and running sums without one task.

A frame is cut into ranges of its sort columns and saved with the number of each
row's range. What a window over the whole order would need from before a range then
comes from one small row per range, and windows inside ranges do the rest. A hot key
is cut like anything else, since its rows differ in the later sort columns.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.session import ensure_checkpoint_dir

PART = "_part"
RANGES_PER_PARTITION = 4


def saved(df: DataFrame, folder: str = "basketlens-tables") -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), folder, uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *by: str) -> DataFrame:
    """The frame, saved, with the number of each row's range of `by` in `_part`.

    Saving fixes the ranges: they are sampled anew whenever they are computed. There are
    several ranges to a shuffle partition, so that a hot key's ranges, dealt out by a
    hash, even out.
    """
    ranges = RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(df.repartitionByRange(ranges, *by).withColumn(PART, F.spark_partition_id()))
