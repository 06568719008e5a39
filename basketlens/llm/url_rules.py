"""URL allow and block rules, found by a sort-merge range join.

A rule (host, path) fits urls on its host and all subdomains whose path starts
with the rule's path; the longest fitting rule decides.

Keys are (reversed host, path). Below one host, the urls that a rule fits are the
interval from its path to the path with a byte behind that no UTF-8 text has. A
rule also holds for subdomains, so a url gives one key for every host suffix that a
rule could have; rule starts, rule ends and these keys are sorted together and swept
once. The sweep keeps the stack of active nested rules: the running count of
starts less ends is the depth of the stack, and its top is the last rule that started
at that depth. The sort is split into ranges; each range carries in the depth and
the stack that earlier ranges left, so no range needs another's rows.

Ranges are cut by key and then by row number, so a host or a url that holds a third of
all rows is dealt over many tasks.

Cases: a null url or one without "://" has an empty host and path, which only a rule
with an empty host can fit. Of rules with equal host and path, block wins. Rules of
equal length: the one with the longer host wins. A null part of a rule counts as
empty; a rule without a verdict is ignored. Repeated rows and null ids are kept: one
row returns for every input row. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import saved

LOWER = "abcdefghijklmnopqrstuvwxyz"
BEYOND = bytearray(b"\xff")
START, URL, END = 0, 1, 2


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of pages(page_id, url)."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return (
        pages.select("page_id", "url")
        .withColumn("rest", F.coalesce(rest, F.lit("")))
        .select(
            "page_id",
            F.translate(F.regexp_extract("rest", r"^([^/?#]*)", 1), LOWER.upper(), LOWER).alias("host"),
            F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        )
    )


def _reversed(host: str):
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _rules(rules: DataFrame) -> DataFrame:
    host = F.translate(F.coalesce("host", F.lit("")), LOWER.upper(), LOWER)
    return (
        rules.filter("verdict is not null")
        .select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # "block" sorts behind "allow"
        .withColumn("labels", F.size(F.split("host", r"\.", -1)))
        .withColumn("rhost", _reversed("host"))
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host + path, or null) and verdict of each row.

    pages(page_id, url); rules(host, path, verdict) of any size. `default` is the
    verdict where no rule fits.
    """
    rules = saved(_rules(rules), "url-rules")
    depth = rules.agg(F.coalesce(F.max("labels"), F.lit(0)).alias("labels"))
    urls = with_host_and_path(pages).withColumn("row", F.monotonically_increasing_id())
    labels = F.reverse(F.split("host", r"\.", -1))
    # A host suffix with more labels than any rule's host can't be a rule's host.
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(labels), F.col("most"))))
    none = F.lit(None).cast("struct<length:int,host_length:int,rule:string,verdict:string>")
    keys = (
        urls.withColumn("most", depth.scalar())
        .withColumn("level", F.explode(levels))
        .select(
            F.array_join(F.slice(labels, 1, F.col("level")), ".").alias("rhost"),
            F.encode("path", "UTF-8").alias("at"),
            F.lit(URL).alias("kind"),
            "row",
            "page_id",
            "host",
            "path",
            none.alias("opened"),
        )
    )
    own = F.struct(
        F.length(F.concat("host", "path")).alias("length"),
        F.length("host").alias("host_length"),
        F.concat("host", "path").alias("rule"),
        F.col("verdict"),
    )

    def bounds(kind: int, at):
        page_id = F.lit(None).cast(pages.schema["page_id"].dataType)
        text = F.lit(None).cast("string")
        return rules.select(
            "rhost", at.alias("at"), F.lit(kind).alias("kind"), F.lit(-1).cast("long").alias("row"),
            page_id.alias("page_id"), text.alias("host"), text.alias("path"),
            (own if kind == START else none).alias("opened"),
        )

    first = F.encode("path", "UTF-8")
    events = keys.unionByName(bounds(START, first)).unionByName(bounds(END, F.concat(first, F.lit(BEYOND))))
    order = ["rhost", "at", "kind", "row"]
    events = saved(
        events.repartitionByRange(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("step", F.when(F.col("kind") == START, 1).when(F.col("kind") == END, -1).otherwise(0)),
        "url-events",
    )

    # What each range adds to the depth, and so the depth at which it begins.
    steps = events.groupBy("part").agg(F.sum("step").alias("steps"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = steps.select("part", F.coalesce(F.sum("steps").over(before), F.lit(0)).alias("base"))

    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.join(starts, "part").withColumn("depth", F.col("base") + F.sum("step").over(here))
    # The last rule opened at a depth in each range: the stack it leaves behind.
    left = (
        swept.filter(F.col("kind") == START)
        .groupBy("part", "depth")
        .agg(F.max_by("opened", F.struct("rhost", "at")).alias("opened"))
    )
    # The stack at the begin of a range: at each depth that is open there, the rule
    # opened last in any earlier range. One row for each range and open depth.
    wanted = starts.filter("base > 0").select("part", F.explode(F.sequence(F.lit(1).cast("long"), "base")).alias("depth"))
    earlier = Window.partitionBy("depth").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        left.select("part", "depth", "opened", F.lit(False).alias("wanted"))
        .unionByName(wanted.withColumn("opened", none).withColumn("wanted", F.lit(True)))
        .groupBy("part", "depth")
        .agg(F.max("opened").alias("opened"), F.max("wanted").alias("wanted"))
        .withColumn("carried", F.last("opened", ignorenulls=True).over(earlier))
        .filter("wanted")
        .select("part", "depth", "carried")
    )
    same_depth = Window.partitionBy("part", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    tops = (
        swept.filter(F.col("kind") != END)
        .withColumn("top", F.last("opened", ignorenulls=True).over(same_depth))
        .filter(F.col("kind") == URL)
        .join(carried, ["part", "depth"], "left")
        .withColumn("top", F.when(F.col("depth") > 0, F.coalesce("top", "carried")))
    )
    best = tops.groupBy("row").agg(
        *(F.first(c).alias(c) for c in ("page_id", "host", "path")), F.max("top").alias("top")
    )
    return best.select(
        "page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict")
    )
