"""Streaming over rows in key order, one whole key at a time with a bound.

`whole_keys` cuts a task's sorted rows into batches of complete keys. Rows of keys
larger than a bound come back apart; `in_blocks` deals those to groups that
are within the bound and together hold every pair of rows once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import saved


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and behind the last."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]


def whole_keys(batches: Iterable[pa.RecordBatch], most: int | None) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(True, rows of complete keys) and, of keys with more than `most` rows, (False,
    some of their rows). At most one key's bounded rows are held."""
    held: pa.RecordBatch | None = None
    large = None
    for batch in batches:
        if large is not None:
            n = int(np.searchsorted(batch.column("key").to_numpy(), large, side="right"))
            if n:
                yield False, batch.slice(0, n)
                batch = batch.slice(n)
            if not batch.num_rows:
                continue
            large = None
        if held is not None and held.num_rows:
            batch = _joined([held, batch])
        if not batch.num_rows:
            continue
        keys = batch.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        done, held = batch.slice(0, cut), batch.slice(cut)
        if cut and most is not None:
            at = starts_of(keys[:cut])
            over = np.repeat(np.diff(at) > most, np.diff(at))
            if over.any():
                yield False, done.filter(pa.array(over))
                done = done.filter(pa.array(~over))
        if done.num_rows:
            yield True, done
        if most is not None and held.num_rows > most:
            yield False, held
            large, held = keys[-1], None
    if held is not None and held.num_rows:
        yield True, held


def by_key(rows: DataFrame) -> DataFrame:
    """Rows dealt out and sorted by key, each key one group of one block."""
    return (
        rows.repartition("key")
        .sortWithinPartitions("key")
        .withColumns({"home": F.col("key"), "block": F.lit(0), "cross": F.lit(False)})
    )


def in_blocks(rows: DataFrame, most: int, by: Column) -> DataFrame:
    """The like for rows of keys with more than `most`: each key's rows are cut by a
    digest of `by` into blocks of about a third of the bound, and every block, and
    every pair of blocks, is a group. `key` is the group, `home` the key it had,
    `cross` true in groups of two blocks, where only pairs of different blocks are new."""
    blocks = F.ceil(F.count(F.lit(1)) * 3 / most).cast("int")
    sizes = saved(rows.groupBy("key").agg(blocks.alias("blocks")), "large-keys")
    return (
        rows.withColumn("home", F.col("key"))
        .join(sizes, "key")
        .withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("cross", F.col("block") != F.col("other"))
        .withColumn("key", F.xxhash64("home", F.least("block", "other"), F.greatest("block", "other")))
        .drop("blocks", "other")
        .repartition("key")
        .sortWithinPartitions("key")
    )
