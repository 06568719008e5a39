"""Catalog tables laid out by user, so that per-user work needs no shuffle.

`publish` writes a `Tables` bundle as catalog tables. Order items and users are bucketed
and sorted by the user: rollups by user (and anything finer) and joins of the two read
matching buckets side by side. A customer with more rows than a bucket should hold would
make one bucket, and one task, of any size; rows of such customers, and those without a user,
go to a table of their own without buckets, whose rollups shuffle partial sums. There are
fewer such customers than buckets, by their definition.

The items may be a view (a join of raw tables, say) that three of these tables are made
from. It is computed once, into a staged copy that is deleted in the end.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.session import ensure_checkpoint_dir
from basketlens.sources.export import _file_system
from basketlens.sources.tables import Tables

BUCKETS = 32


@dataclass(frozen=True)
class Layout:
    """Published tables: the order items of ordinary customers beside all users (both
    bucketed), and those of large or unknown customers."""

    ordinary: Tables
    large: Tables


def large_users(items: DataFrame, buckets: int) -> DataFrame:
    """user_id of customers with more than a bucket's share of all rows (fewer than
    `buckets` of them)."""
    counts = items.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.filter(F.col("n") * buckets > total).select("user_id")


def publish(t: Tables, database: str, buckets: int = BUCKETS, folder: str | None = None) -> None:
    """Write the bundle as tables of a new database. Their files are below `folder`, or
    in the session's shared folder."""
    spark = t.order_items.sparkSession
    folder = folder or os.path.join(ensure_checkpoint_dir(spark), "basketlens-tables", uuid.uuid4().hex)
    spark.sql(f"CREATE DATABASE `{database}` LOCATION '{folder}'")

    def write(df: DataFrame, name: str, by: str | None) -> None:
        # One file for each bucket.
        writer = (df.repartition(buckets, by) if by else df).write.format("parquet")
        writer = writer.options(path=os.path.join(folder, name), compression="zstd")
        if by:
            order = [by, "created_at"] if "created_at" in df.columns else [by]
            writer = writer.bucketBy(buckets, by).sortBy(*order)
        writer.saveAsTable(f"`{database}`.`{name}`")

    staging = os.path.join(folder, "staged_items")
    t.order_items.write.parquet(staging, compression="zstd")
    items = spark.read.schema(t.order_items.schema).parquet(staging)
    write(large_users(items, buckets), "large_users", None)
    # Fewer rows than buckets: small enough to send to every task.
    large = F.broadcast(spark.table(f"`{database}`.`large_users`"))
    write(items.filter(F.col("user_id").isNotNull()).join(large, "user_id", "left_anti"), "order_items", "user_id")
    of_large = items.join(large, "user_id", "left_semi")
    write(of_large.unionByName(items.filter(F.col("user_id").isNull())), "order_items_large", None)
    write(t.users, "users", "id")
    write(t.events, "events", None)
    fs, at = _file_system(spark, staging)
    fs.delete(at, True)


def published(spark: SparkSession, database: str) -> Layout:
    """The tables that `publish` wrote, by name."""

    def table(name: str) -> DataFrame:
        return spark.table(f"`{database}`.`{name}`")

    return Layout(
        Tables(order_items=table("order_items"), events=table("events"), users=table("users")),
        Tables(order_items=table("order_items_large"), events=table("events"), users=table("users")),
    )


_known: dict[tuple[str, str], str] = {}


def published_once(spark: SparkSession, name: str, build) -> Layout:
    """The layout of the bundle build() gives, written on its first use in this application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _known:
        database = f"basketlens_{uuid.uuid4().hex}"
        publish(build(), database)
        _known[key] = database
    return published(spark, _known[key])
