"""Write a `Tables` bundle in the original file layout."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from basketlens.session import ensure_checkpoint_dir
from basketlens.sources.tables import Tables


def write_shop_layout(t: Tables, directory: str | None = None) -> str:
    """order_items/events/users.parquet with times in UTC and money as double."""
    spark = t.order_items.sparkSession
    if directory is None:
        directory = os.path.join(ensure_checkpoint_dir(spark), "basketlens-tables", uuid.uuid4().hex)
    utc = lambda c: F.col(c).cast("timestamp").alias(c)
    items = t.order_items.select(
        "id", "order_id", "user_id", "status", utc("created_at"), utc("returned_at"), F.col("sale_price").cast("double").alias("sale_price")
    )
    events = t.events.select("user_id", utc("created_at"), "event_type")
    for name, df in (("order_items", items), ("events", events), ("users", t.users)):
        df.write.parquet(os.path.join(directory, f"{name}.parquet"))
    return directory
