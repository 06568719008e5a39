"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a keyed digest of their ids and queued,
up to `max_repeats` times over. A copy's virtual finish time is its source's words up to
and with it, divided by the source's weight. All copies are sorted by that time
and taken until the budget (all words of the input) is spent; a source whose queue
runs out leaves its share to the others by weight, which is what `target` states.

Documents that are equal in source, id, size and text are one class with a count until
each one's finish time is known, so that a class may hold a third of all rows. Running
sums are two-level, so no source is summed in one task: a source is cut into digest
buckets, whose number grows with the classes and whose sums give each its start, and the
global order is cut into ranges in the same way. Classes are counted out to their documents in
blocks that are dealt to all tasks.

Cases: a null text has no words; a null source is a source of its own, last in
order; null and repeated ids are documents like any other, told apart by their texts. Of
equal documents the mix may take a part, and which they are makes no difference to its words.
A text of any length is counted whole. A source without words has target 0.
Empty input gives an empty result. Other columns never take part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import WORD, key, saved, unused

# Classes of a source that one bucket holds on average, and documents of a class in one block.
IN_BUCKET = 4096
IN_BLOCK = 4096


def words() -> Column:
    """Number of words of the text column (null: 0)."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def source_key() -> Column:
    """Text form of a source that sorts by code point with null last."""
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("a"), F.col("source").cast("string")))


def with_targets(sources: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """Add weight and target to one row per source (skey, source_size).

    All words are shared by weight; a source stops at max_repeats times its size
    and its excess goes to the others, until none is above. In the order of size
    over weight the sources that stop come first, so one running sum finds the
    level (words for a unit of weight) of those that don't: that of the first of them.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy("skey")) - 1, F.lit(len(weights)))
    cap = (max_repeats * F.col("source_size")).cast("double")
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    return (
        sources.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (turn + 1).cast("int")))
        .withColumn("cap", cap)
        .withColumn("spent", F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("others", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(all_rows) - F.col("spent")) / F.col("others"))
        .withColumn("stops", F.col("cap") <= F.col("weight") * F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("stops"), F.col("level"))).over(all_rows))
        .withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * F.col("level")))
        .drop("cap", "spent", "others", "level", "stops")
    )


def _cutoff(queued: DataFrame, max_repeats: int) -> DataFrame:
    """One row: the place of the last copy within the budget (struct `place`)."""
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(max_repeats)))).select(
        _place(F.col("copy")).alias("place"), "size"
    )
    ranged = saved(copies.repartitionByRange("place").withColumn("part", F.spark_partition_id()), "mix-copies")
    sums = ranged.groupBy("part").agg(F.sum("size").alias("words"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row for each range
    budget = F.col("budget")
    ranges = (
        sums.withColumn("end", F.sum("words").over(so_far))
        .withColumn("budget", (F.sum("words").over(Window.partitionBy()) / max_repeats).cast("long"))
        .withColumn("begin", F.col("end") - F.col("words"))
    )
    # Only the range in which the budget ends has to be summed copy by copy.
    edge = ranges.filter((F.col("begin") <= budget) & (budget < F.col("end"))).select("part", "begin", "budget")
    within = Window.partitionBy("part").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    inside = (
        ranged.join(edge, "part")
        .withColumn("end", F.col("begin") + F.sum("size").over(within))
        .filter(F.col("end") <= budget)
        .agg(F.max("place").alias("place"))
    )
    whole = ranged.join(ranges.filter(F.col("end") <= budget).select("part"), "part").agg(F.max("place").alias("place"))
    return inside.unionByName(whole).agg(F.max("place").alias("place"))


def _place(copy: Column) -> Column:
    """Where a copy stands in the queue: virtual finish time, then fixed ties."""
    done = (copy - 1) * F.col("source_size") + F.col("cum")
    return F.struct(
        (done.cast("double") / F.col("weight")).alias("finish"),
        F.col("skey").alias("skey"),
        F.col("digest").alias("digest"),
        F.col("id").alias("id"),
        F.col("size").alias("size"),
        copy.cast("int").alias("copy"),
        F.col("nth").alias("nth"),
    )


def described(seed: str) -> list[Column]:
    """A document as the mix sees it: doc_id, id, skey, size, and a digest of id and text."""
    content = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    spelled = F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), content)
    return [
        F.col("doc_id"),
        key("doc_id").alias("id"),
        source_key().alias("skey"),
        words().alias("size"),
        F.md5(spelled).alias("digest"),
    ]


def _queued(rows: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """One row for each document of described rows, saved: its class, its number in it (from
    1), and the words of its source up to and with it."""
    a_class = ["doc_id", "id", "skey", "size", "digest"]
    classes = saved(rows.groupBy(*a_class).agg(F.count(F.lit(1)).alias("count")), "mix-classes")
    shares = classes.groupBy("skey").agg(
        F.sum(F.col("size") * F.col("count")).alias("source_size"), F.count(F.lit(1)).alias("classes")
    )
    sources = saved(with_targets(shares, weights, max_repeats), "mix-sources")
    # Equal parts of the digests' range, as many as the source needs.
    parts = F.ceil(F.col("classes") / IN_BUCKET)
    part = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("parts") / (1 << 32)).cast("long")
    dealt = classes.join(sources.withColumn("parts", parts).drop("classes"), "skey").withColumn("bucket", part).drop("parts")
    buckets = dealt.groupBy("skey", "bucket").agg(F.sum(F.col("size") * F.col("count")).alias("words"))
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("skey", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("skey", "bucket").orderBy("digest", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("count")).over(inside), F.lit(0))
    placed = dealt.join(starts, ["skey", "bucket"]).withColumn("before", before).drop("bucket", "start")
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / IN_BLOCK))))
    first = F.col("block") * IN_BLOCK
    numbers = F.sequence(first + 1, F.least(F.col("count"), first + IN_BLOCK))
    return saved(
        blocks.repartition("digest", "block")
        .withColumn("nth", F.explode(numbers))
        .withColumn("cum", F.col("before") + F.col("nth") * F.col("size"))
        .drop("before", "block"),
        "mix-queue",
    )


def _taken(rows: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """The queue with `copies`, how often the mix takes each document."""
    queued = _queued(rows, weights, max_repeats)
    last = _cutoff(queued, max_repeats).scalar()
    copies = sum(((_place(F.lit(c)) <= F.col("last")).cast("int") for c in range(1, max_repeats + 1)), F.lit(0))
    return queued.withColumn("last", last).withColumn("copies", F.coalesce(copies, F.lit(0))).drop("last")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """One row for each document row: doc_id, id, skey, digest, size, source_size, target,
    copies (0 to max_repeats, how often the mix takes it) and taken (words)."""
    return _taken(docs.select(*described(seed)), weights, max_repeats).select(
        "doc_id", "id", "skey", "digest", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The mix itself: every document row as often as the mix takes it, with the
    input's columns."""
    row, part, copies = unused("row", docs), unused("part", docs), unused("copies", docs)
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.spark_partition_id())
    numbered = saved(numbered, "mix-numbered")
    # Words and digests are taken once.
    numbers = [F.col(row).alias("row"), F.col(part).alias("part")]
    seen = saved(numbered.select(*numbers, *described(seed)), "mix-seen")
    plan = _taken(seen.drop("row", "part"), weights, max_repeats)
    a_class = ["skey", "id", "size", "digest"]
    # Equal documents get their class's copies evenly, the first of them one more each.
    shared = plan.groupBy(*a_class).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("count")).filter("copies > 0")
    even, more = F.floor(F.col("copies") / F.col("count")), F.pmod(F.col("copies"), F.col("count"))
    shared = saved(shared.select(*a_class, even.alias("even"), more.alias("more")), "mix-shared")
    taking = seen.join(shared, a_class).select("row", "part", *a_class, "even", "more")
    whole = taking.filter("more = 0").select("row", F.col("even").alias("n"))
    split = taking.filter("more > 0")
    # Their order within a class in two levels: the part of the table, then the row.
    counts = split.groupBy(*a_class, "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy(*a_class).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*a_class, "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    at = F.row_number().over(Window.partitionBy(*a_class, "part").orderBy("row")) + F.col("offset")
    split = split.join(offsets, [*a_class, "part"]).withColumn("n", F.col("even") + (at <= F.col("more")).cast("int"))
    times = whole.unionByName(split.select("row", "n")).filter("n > 0").toDF(row, copies)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return numbered.join(times, row).withColumn(copies, each).select(*docs.columns)
