"""Whitening of vectors along their principal directions.

Entries become integers (`scale` times the entry, rounded down, plus `offset`), so sums and
squared deviations are exact. The centred rows of each task are reduced block by block
to a triangle R by QR, and triangles are stacked and reduced again, a bounded number at a time,
until one is left: its singular values are those of all centred rows, which are never
multiplied with each other. The rest is work on one matrix of the vectors' length
(`bidiagonal`): Householder bidiagonalisation, squared singular values by dqds, directions by
twisted factorisations. A direction's sign is that of its largest entry.

The whitened rows are then multiplied out once, block by block, and how far their
covariance is from the identity is returned with every row.

Cases: vectors that are null or hold null or non-finite entries are left out, and so are empty
ones. Vectors of another length are a space of their own, with their own n and components. A
direction without variance (below `FLAT` of the first one's) has explained 0 and no whitened
value (null); a space without any variance has an identity_error of 0. Entries so large
that `scale` times them is beyond 2**52 are held at that bound; deviations above the
largest long are null. Repeated rows and null ids are rows of their own. Other columns are
ignored. Empty input gives an empty result. Vectors of any length are handled in numpy
within a task; a model has length x components numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.bidiagonal import right_vectors
from basketlens.llm.common import in_arrow, saved
from basketlens.llm.vectors import matrix, usable

COMPONENTS = 32
SCALE = 64
OFFSET = 1_000_000
# Variance, as a share of the first direction's, below which a direction is flat.
FLAT = 1e-18
BLOCK = 4096
# Triangles that a task stacks, and that the driver takes for the last step.
FAN_IN = 16
_HELD = 2.0**52
_LOW = (1 << 20) - 1


@dataclass(frozen=True)
class Space:
    """What whitening needs of all vectors of one length."""

    n: int
    sums: list[int]
    mean: np.ndarray
    directions: np.ndarray  # one column for each component
    variances: np.ndarray
    trace: float


def integers(vectors: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    return np.clip(np.floor(vectors * float(scale)), -_HELD, _HELD).astype(np.int64) + offset


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows, vectors) of a bounded number of rows of equal length."""
    for batch in batches:
        sizes = batch.column("vector").value_lengths().to_numpy()
        for size in np.unique(sizes):
            some = batch.filter(pa.array(sizes == size))
            for at in range(0, some.num_rows, BLOCK):
                rows = some.slice(at, BLOCK)
                yield int(size), rows, matrix(rows.column("vector"), np.float64)


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's integers in two parts, so that they stay exact."""
    held: dict[int, list] = {}
    for size, _, vectors in _blocks(batches):
        x = integers(vectors)
        n, high, low = held.setdefault(size, [0, [0] * size, [0] * size])
        held[size][0] = n + len(x)
        for k, value in enumerate((x >> 20).sum(axis=0).tolist()):
            high[k] += value
        for k, value in enumerate((x & _LOW).sum(axis=0).tolist()):
            low[k] += value
    for size, (n, high, low) in held.items():
        at = np.arange(size, dtype=np.int32)
        columns = [np.full(size, size, dtype=np.int32), at, np.full(size, n), np.array(high, np.int64), np.array(low, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["size", "place", "n", "high", "low"])


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and exact sums by vector length; one row for each entry of each length."""
    parts = in_arrow(rows, _summed, "size int, place int, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("size", "place").agg(F.sum("n").alias("n"), *exact).orderBy("size", "place").collect():
        found.setdefault(r["size"], (r["n"], []))[1].append((int(r["high"]) << 20) + int(r["low"]))
    return found


def _means(sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    return {size: np.array([s / n for s in of]) for size, (n, of) in sums.items()}


def _triangle(rows: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(rows), mode="r")


def _triangles(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for size, r in found.items():
        data = pa.array([r.astype(np.float64).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), data], names=["size", "triangle"])


def _reduced(means: dict[int, np.ndarray]) -> Callable:
    """Tasks that reduce their centred rows to one triangle for each vector length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for size, _, vectors in _blocks(batches):
            centred = integers(vectors) - means[size]
            found[size] = _triangle([found[size], centred] if size in found else [centred])
        yield from _triangles(found)

    return run


def _stacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, data in zip(batch.column("size").to_pylist(), batch.column("triangle").to_pylist()):
            rows = np.frombuffer(data).reshape(-1, size)
            found[size] = _triangle([found[size], rows] if size in found else [rows])
    yield from _triangles(found)


def _one_triangle(rows: DataFrame, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The triangle of all centred rows, by vector length."""
    schema = "size int, triangle binary"
    parts = saved(in_arrow(rows, _reduced(means), schema).withColumn("part", F.spark_partition_id()), "triangles")
    while (count := parts.select("part").distinct().count()) > FAN_IN:
        fewer = -(-count // FAN_IN)
        merged = in_arrow(parts.select("size", "triangle").repartition(fewer), _stacked, schema)
        parts = saved(merged.withColumn("part", F.spark_partition_id()), "triangles")
    found: dict[int, list[np.ndarray]] = {}
    for r in parts.orderBy("size", "part").collect():
        found.setdefault(r["size"], []).append(np.frombuffer(r["triangle"]).reshape(-1, r["size"]))
    return {size: _triangle([*of, np.zeros((size, size))]) for size, of in found.items()}


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """The whitening of rows(vector), for each vector length."""
    sums = _sums(rows)
    means = _means(sums)
    spaces = {}
    for size, r in _one_triangle(rows, means).items():
        n, of = sums[size]
        values, directions = right_vectors(r, min(components, size), FLAT)
        largest = directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])]
        spaces[size] = Space(n, of, means[size], directions * np.sign(largest), values / n, float((r * r).sum()) / n)
    return spaces


def _projected(space: Space, x: np.ndarray) -> np.ndarray:
    return (x - space.mean) @ space.directions / np.sqrt(space.variances)


def _moments(spaces: dict[int, Space]) -> Callable:
    """Tasks that sum their whitened rows and the products of these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for size, _, vectors in _blocks(batches):
            white = _projected(spaces[size], integers(vectors))
            white = np.column_stack([white, np.ones(len(white))])
            found[size] = found.get(size, 0) + white.T @ white
        for size, product in found.items():
            flat = product.ravel()
            columns = [np.full(len(flat), size, np.int32), np.arange(len(flat), dtype=np.int32), flat]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["size", "place", "value"])

    return run


def identity_errors(rows: DataFrame, spaces: dict[int, Space]) -> dict[int, float]:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    sums = in_arrow(rows, _moments(spaces), "size int, place int, value double").groupBy("size", "place").agg(F.sum("value").alias("value"))
    found: dict[int, list[float]] = {}
    for r in sums.orderBy("size", "place").collect():
        found.setdefault(r["size"], []).append(r["value"])
    errors = {}
    for size, flat in found.items():
        k = int(round(len(flat) ** 0.5))
        product = np.array(flat).reshape(k, k) / spaces[size].n
        mean = product[-1, :-1]
        off = product[:-1, :-1] - np.outer(mean, mean) - np.eye(k - 1)
        errors[size] = float(np.abs(off).max()) if k > 1 else 0.0
    return errors


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over entries of (n * x - sum) squared, for each row."""
    bound = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if bound < 1 << 62:
        off = n * x - np.array(sums, dtype=np.int64)
        most = int(np.abs(off).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return (off * off).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def _whitened(spaces: dict[int, Space], errors: dict[int, float], components: int) -> Callable:
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, rows, vectors in _blocks(batches):
            space = spaces[size]
            x = integers(vectors)
            count, known = len(x), len(space.variances)
            white = np.zeros((count, min(components, size)))
            white[:, :known] = _projected(space, x)
            width = white.shape[1]
            explained = np.zeros(width)
            explained[:known] = space.variances / space.trace if known else 0
            flat = np.tile(np.arange(width) >= known, count)
            each = pa.array(np.repeat(np.arange(count), width))
            columns = [
                rows.column("id").take(each),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), count)),
                pa.array(np.full(count * width, space.n)),
                pa.array(deviations(x, space.n, space.sums), pa.int64()).take(each),
                pa.array(white.ravel(), mask=flat),
                pa.array(np.tile(explained, count)),
                pa.array(np.full(count * width, errors[size])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error
    of every usable row of vectors(vec_id, embedding) and each of its components."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).filter(usable("vector"))
    spaces = fit(rows.select("vector"), components)
    errors = identity_errors(rows.select("vector"), spaces)
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return in_arrow(rows, _whitened(spaces, errors, components), schema).withColumnRenamed("id", "vec_id")
