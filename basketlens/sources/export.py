"""Table export that can be resumed and verified.

Each table is published in two phases. It is written to a staging folder together with a
manifest (rows, bytes and a digest of the rows of each file), and renamed into place last,
so a table under its name is whole. A run that was killed half-way is started again with
the same destination: tables whose files still agree with their manifest are kept, only the
others are copied.

The digest is a sum of 64-bit row hashes: it doesn't depend on the order of rows or files.
What left the source is observed while it is written, without another pass over it,
and has to agree with what is read back. Renames go through the destination's
file system; on object stores without an atomic rename a reader may see a table without
its manifest, which the next run copies again.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basketlens.session import ensure_checkpoint_dir
from basketlens.sources.tables import load

MANIFEST = "_manifest"
MANIFEST_SCHEMA = "file string, rows long, bytes long, digest decimal(38,0)"
REPORT = "table_name string, status string, rows long, files long, bytes long, digest decimal(38,0), seconds double"


class Mismatch(Exception):
    """What was read back differs from what was written."""


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)


def _row_hash(schema: StructType) -> Column:
    """A 64-bit hash of a row. Maps have no hash of their own and count as JSON."""
    quoted = {f.name: F.col("`" + f.name.replace("`", "``") + "`") for f in schema}
    columns = [F.to_json(F.struct(quoted[f.name])) if "map<" in f.dataType.simpleString() else quoted[f.name] for f in schema]
    return F.xxhash64(*columns).cast("decimal(20,0)")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, rows, bytes and digest of each file with rows, read from the files."""
    back = spark.read.parquet(path)
    rows = back.select("_metadata.file_name", "_metadata.file_size", _row_hash(back.schema).alias("hash"))
    return rows.groupBy(F.col("file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("file_size").alias("bytes"),
        F.sum("hash").cast("decimal(38,0)").alias("digest"),
    )


def _total(files: DataFrame) -> tuple[int, int, int, int]:
    """Rows, files, bytes and digest of a table."""
    summed = files.agg(F.sum("rows"), F.count(F.lit(1)), F.sum("bytes"), F.sum("digest")).collect()[0]
    return tuple(int(v or 0) for v in summed)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, to = _file_system(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(_file_system(spark, source)[1], to):
        raise OSError(f"cannot rename {source} to {target}")


def publish(spark: SparkSession, df: DataFrame, target: str) -> tuple[int, int, int, int]:
    """Write a frame below `target` with its manifest, in two phases. Returns its totals.

    A table that was there stays readable until the new one is complete; nothing is put
    in place if the files don't hold what the frame gave.
    """
    parent, name = os.path.split(target.rstrip("/"))
    mark = uuid.uuid4().hex
    staging = os.path.join(parent, "_staging", f"{name}-{mark}")
    given = Observation()
    seen = df.observe(given, F.count(F.lit(1)).alias("rows"), F.sum(_row_hash(df.schema)).alias("digest"))
    write_parquet(seen, staging)
    files = file_digests(spark, staging)
    files.write.json(os.path.join(staging, MANIFEST))
    found = _total(manifest(spark, staging))
    rows, digest = int(given.get["rows"]), int(given.get["digest"] or 0)
    if (rows, digest) != (found[0], found[3]):
        raise Mismatch(f"{target}: wrote {rows} rows, read {found[0]}")
    fs, at = _file_system(spark, target)
    replaced = os.path.join(parent, "_replaced", f"{name}-{mark}")
    if fs.exists(at):
        _move(spark, target, replaced)
    _move(spark, staging, target)
    fs.delete(_file_system(spark, replaced)[1], True)
    return found


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(os.path.join(path, MANIFEST))


def verified(spark: SparkSession, target: str) -> tuple[int, int, int, int] | None:
    """Totals of a published table whose files agree with its manifest, else None."""
    fs, at = _file_system(spark, os.path.join(target, MANIFEST, "_SUCCESS"))
    if not fs.exists(at):
        return None
    try:
        stated, found = manifest(spark, target), file_digests(spark, target)
        both = stated.withColumn("by", F.lit(1)).unionByName(found.withColumn("by", F.lit(2)))
        same = both.groupBy("file", "rows", "bytes", "digest").agg(F.sum("by").alias("by"))
        if same.filter("by <> 3").limit(1).count():
            return None
        return _total(stated)
    except Exception:  # an unreadable file: the table is copied again
        return None


def export_tables(
    spark: SparkSession,
    names: Sequence[str],
    src_dir: str,
    dst_dir: str | None = None,
    parallelism: int = 4,
    resume: bool = False,
) -> DataFrame:
    """Export each table (`SELECT *`), continuing past failures.

    The table copies are independent jobs, submitted from a few driver threads so small
    tables do not leave the cluster idle. The report has one row for each name: its
    status ('ok', 'kept' where `resume` found it published and whole, or the error's class),
    what was written (rows, files, bytes and digest from the manifest; null for a failed
    table) and the seconds it took. With `resume` the source is taken to be unchanged since
    the first run. The destination defaults to a fresh folder below the session's shared
    checkpoint folder; the caller owns it either way.
    """
    if dst_dir is None:
        dst_dir = os.path.join(ensure_checkpoint_dir(spark), "exports", uuid.uuid4().hex)

    def copy(name: str) -> tuple:
        began = time.time()
        target = os.path.join(dst_dir, f"{name}.parquet")
        try:
            status, totals = "kept", verified(spark, target) if resume else None
            if totals is None:
                status, totals = "ok", publish(spark, load(spark, src_dir, name), target)
            rows, files, size, digest = totals
        except Exception as exc:  # one failing table does not stop the others
            status, rows, files, size, digest = exc.__class__.__name__, None, None, None, None
        return name, status, rows, files, size, digest, time.time() - began

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        log = list(pool.map(copy, names))
    # One row for each name of a short list; the digest travels as text.
    log = [(*r[:5], None if r[5] is None else str(r[5]), r[6]) for r in log]
    told = spark.createDataFrame(log, REPORT.replace("digest decimal(38,0)", "digest string"))
    return told.withColumn("digest", F.col("digest").cast("decimal(38,0)"))


def write_document(df: DataFrame, path: str, variable: str | None = None) -> None:
    """Write the one string of a one-row frame (a report whose size the calendar bounds) as
    one UTF-8 file; with `variable` as a script that assigns it. The file is put in
    place when it is complete."""
    (text,) = df.collect()[0]
    if variable:
        text = f"window.{variable} = {text};\n"
    spark = df.sparkSession
    fs, to = _file_system(spark, path)
    staging = os.path.join(os.path.dirname(path), f"_{os.path.basename(path)}-{uuid.uuid4().hex}")
    stream = fs.create(_file_system(spark, staging)[1], True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(to):
        fs.delete(to, False)
    _move(spark, staging, path)


def read_document(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """A written document as the string `document`, without the assignment."""
    text = spark.read.text(path, wholetext=True)
    if variable is None:
        return text.withColumnRenamed("value", "document")
    head = F.lit(f"window.{variable} = ")
    inner = F.rtrim(F.regexp_replace("value", r";\s*$", ""))
    return text.select(F.when(F.startswith("value", head), F.substring(inner, F.length(head) + 1, F.length(inner))).alias("document"))
