"""Helpers shared by the operators: table access, saved tables, row checks."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import ensure_checkpoint_dir

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()

# Words are runs of anything but the ASCII space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = 9223372036854775807


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/basketlens-llm/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage: what follows reads files that survive a lost executor,
    and row ids or partition numbers assigned before the write never change.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, so that
    tasks can import it whatever the session's search path is."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        archive = f"{tempfile.mkdtemp(prefix='basketlens-')}/{PACKAGE.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(PACKAGE.rglob("*.py")):
                out.write(file, file.relative_to(PACKAGE.parent))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)


def in_arrow(df: DataFrame, task: Callable, schema: str) -> DataFrame:
    """A Python task over the Arrow batches of each partition."""
    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


def key(column: str) -> Column:
    """An id with null as the largest value, so that nulls join and sort last."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def unkey(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != NO_ID, c)


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, or a longer one, that is no column of the frames."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rest_of_crc32(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n (null for a null id)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)).cast("int")
