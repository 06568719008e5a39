"""Near-duplicate vectors by randomised-rotation binary codes.

Every distinct vector is scaled to length one, rotated by a random orthonormal map
into `code_bits` dimensions and kept as the signs of its coordinates, with two
corrections: the inner product of the sign vector and the rotated vector, and a 4-bit form
of the rotated vector for its part as the other side of a pair. The inner product of
the signs of one and the 4-bit form of the other, divided by the correction, is an
unbiased estimate of the cosine; its error bound follows from the correction. Only
pairs whose bound reaches the threshold are computed again from the vectors in double
precision, and only pairs that then reach it are links. Vectors are fetched for the rows
that are in such a pair; pairs themselves are never listed, their bounds are taken again
beside the vectors.

Pairs to estimate come from bands: keys of a few bits sampled from a signature, the sides
of `SIGNATURE` independent random planes. All bands draw from the one signature, so
their number follows from the recall expected over its differing bits, which are
binomial: a pair at the threshold gets a common key with the chance `recall`. (The code
has too few bits for that: bands of it miss a pair all together.) Keys widen with the
number of vectors, so groups keep their size. A pair is dealt with in its first common band alone,
so links are counted exactly without listing pairs. Keys of more than `MOST` vectors are
cut into blocks (see `groups`).

Cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths never link. Equal vectors (a group of
copies of any size) are one node with a count. Repeated ids are rows of their own; a
null id counts as the largest. Other columns are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import acos, ceil, lgamma, log, log1p, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import in_arrow, key, saved, unkey
from basketlens.llm.components import components
from basketlens.llm.groups import by_key, in_blocks, starts_of, whole_keys
from basketlens.llm.vectors import byte_matrix, matrix, usable

THRESHOLD = 0.95
RECALL = 0.997
# Width of the error bound in standard deviations.
CONFIDENCE = 3.0
MOST = 2048
SMALL = 12
# Pairs whose cosines are computed at a time.
PART = 65_536
# Bits that the bands sample; a multiple of 8, far more than a key has.
SIGNATURE = 1024
SEED = 20

CODED = "key long, dimension int, band int, cid long, code binary, signature binary, correction float, levels binary, low float, step float"
INVOLVED = "key long, band int, cid long, signature binary, large boolean"
LINKED = "key long, cid long, root long, links long, large boolean"


def code_bits(dimension: int) -> int:
    """Bits of a code: twice the dimension, in whole 64s."""
    return 64 * ceil(dimension / 32)


@lru_cache(maxsize=4)
def _rotation(dimension: int) -> np.ndarray:
    noise = np.random.default_rng([SEED, dimension]).standard_normal((code_bits(dimension), dimension))
    return np.linalg.qr(noise)[0]


@lru_cache(maxsize=4)
def _planes(dimension: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension, SIGNATURE]).standard_normal((SIGNATURE, dimension))


def expected_recall(width: int, count: int, threshold: float) -> float:
    """The chance of a pair at the threshold to have a common key, over the differing
    bits of its signatures."""
    differing = np.arange(SIGNATURE + 1)
    of = np.array([lgamma(n + 1) for n in differing])
    apart = min(max(acos(threshold) / pi, 1e-12), 1 - 1e-12)
    share = of[-1] - of - of[::-1] + differing * log(apart) + (SIGNATURE - differing) * log1p(-apart)
    equal = np.zeros(SIGNATURE + 1)
    some = SIGNATURE - differing >= width
    left = SIGNATURE - differing[some]
    equal[some] = np.exp(of[left] - of[left - width] - of[-1] + of[SIGNATURE - width])
    return float(np.exp(share) @ (1 - (1 - np.minimum(equal, 1)) ** count))


def bands(vectors: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a key, number of bands) for so many vectors."""
    width = min(32, max(8, round(log2(max(vectors, 1))) - 2))
    count = 1
    while expected_recall(width, count, threshold) < recall:
        count *= 2
    fewer = range(count // 2 + 1, count + 1)
    return width, fewer[bisect_left(fewer, recall, key=lambda n: expected_recall(width, n, threshold))]


@lru_cache(maxsize=8)
def _chosen(width: int, count: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, SIGNATURE, width])
    return np.array([rng.choice(SIGNATURE, width, replace=False) for _ in range(count)])


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; by their largest component first, as squares may overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _signatures(vectors: np.ndarray) -> np.ndarray:
    return _unit(vectors) @ _planes(vectors.shape[1]).T > 0


def _band_keys(bits: np.ndarray, dimension: int, width: int, count: int) -> np.ndarray:
    """(rows, bands) keys from rows of signature bits."""
    weights = np.int64(1) << np.arange(width, dtype=np.int64)
    values = np.empty((len(bits), count), dtype=np.int64)
    for band, chosen in enumerate(_chosen(width, count)):
        values[:, band] = bits[:, chosen].astype(np.int64) @ weights
    return (np.int64(dimension) << 43) | (np.arange(count, dtype=np.int64)[None, :] << 33) | values


def encode(vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    """Code bits, correction, 4-bit levels, their lowest value and step."""
    unit = _unit(vectors)
    turned = unit @ _rotation(vectors.shape[1]).T
    correction = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / 15, 1e-30)
    levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    return turned > 0, correction, levels, low, step


def _coder(width: int, count: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for dimension in np.unique(sizes):
                some = batch.filter(pa.array(sizes == dimension))
                for at in range(0, some.num_rows, 1024):
                    rows = some.slice(at, 1024)
                    vectors = matrix(rows.column("vector"), np.float64)
                    bits, correction, levels, low, step = encode(vectors)
                    sides = _signatures(vectors)
                    keys = _band_keys(sides, int(dimension), width, count)
                    code = [c.tobytes() for c in np.packbits(bits, axis=1)]
                    signature = [c.tobytes() for c in np.packbits(sides, axis=1)]
                    packed = [c.tobytes() for c in levels[:, ::2] << 4 | levels[:, 1::2]]
                    n = rows.num_rows
                    columns = [
                        pa.array(keys.ravel()),
                        pa.array(np.full(n * count, dimension, dtype=np.int32)),
                        pa.array(np.tile(np.arange(count, dtype=np.int32), n)),
                        pa.array(np.repeat(rows.column("cid").to_numpy(), count)),
                        pa.array(code, pa.binary()).take(pa.array(np.repeat(np.arange(n), count))),
                        pa.array(signature, pa.binary()).take(pa.array(np.repeat(np.arange(n), count))),
                        pa.array(np.repeat(correction.astype(np.float32), count)),
                        pa.array(packed, pa.binary()).take(pa.array(np.repeat(np.arange(n), count))),
                        pa.array(np.repeat(low.astype(np.float32), count)),
                        pa.array(np.repeat(step.astype(np.float32), count)),
                    ]
                    names = ["key", "dimension", "band", "cid", "code", "signature", "correction", "levels", "low", "step"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _signs(codes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(codes, axis=1).astype(np.float32)
    return (2 * bits - 1) / np.sqrt(np.float32(bits.shape[1]))


def _pairs(rows: pa.RecordBatch, passes, square) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows of one key that are new there and pass: small groups by
    passes(i, j) over arrays of pairs, larger ones by square(rows) as a matrix."""
    block = rows.column("block").to_numpy()
    cross = rows.column("cross").to_numpy(zero_copy_only=False)
    starts = starts_of(rows.column("key").to_numpy())
    size = np.diff(starts)
    run = np.repeat(np.arange(len(size)), size)
    small = np.flatnonzero(((size > 1) & (size <= SMALL))[run])
    for step in range(1, SMALL):
        i, j = small[:-step], small[step:]
        together = run[i] == run[j]
        if not together.any():
            break
        together &= ~cross[i] | (block[i] != block[j])
        i, j = i[together], j[together]
        good = passes(i, j)
        yield i[good], j[good]
    for k in np.flatnonzero(size > SMALL):
        some = np.arange(starts[k], starts[k + 1])
        good = np.triu(square(some), 1)
        if cross[some[0]]:
            good &= block[some, None] != block[None, some]
        i, j = np.nonzero(good)
        yield some[i], some[j]


def _first_band(rows: pa.RecordBatch, width: int, count: int):
    """A test of pairs: no band before the one at hand has both under one key."""
    bits = np.unpackbits(byte_matrix(rows.column("signature")), axis=1)
    band = rows.column("band").to_numpy()
    keys = _band_keys(bits, 0, width, count)

    def first(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        met = np.zeros(len(i), dtype=bool)
        for b in range(int(band[i].max()) if len(i) else 0):
            met |= (keys[i, b] == keys[j, b]) & (b < band[i])
        return ~met

    return first


def _by_dimension(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    dimensions = rows.column("dimension").to_numpy()
    found = np.unique(dimensions)
    for d in found:
        yield rows.filter(pa.array(dimensions == d)) if len(found) > 1 else rows


def _one_of_each(rows: pa.RecordBatch) -> pa.RecordBatch:
    """The first row of each key."""
    return rows.take(pa.array(starts_of(rows.column("key").to_numpy())[:-1]))


def _union(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the pairs into `root`, the first member of each row's component."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root[:] = root[root]


class _Estimates:
    """Upper confidence bounds of cosines from codes, corrections and 4-bit forms."""

    def __init__(self, signs, correction, levels, low, step, confidence: float):
        self.signs, self.f, self.levels, self.low, self.step = signs, correction, levels, low, step
        f, bits = correction, signs.shape[1]
        self.error = confidence * np.sqrt(np.maximum(1 - f * f, 0)) / f / np.sqrt(bits - 1)

    def _other_side(self, i: np.ndarray) -> np.ndarray:
        return self.low[i, None] + self.step[i, None] * self.levels[i]

    def _bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.signs[i], self._other_side(j)) / self.f[i] + self.error[i]

    def pass_pairs(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the bounds of both sides of each pair reach the threshold."""
        return (self._bound(i, j) >= threshold) & (self._bound(j, i) >= threshold)

    def pass_square(self, i: np.ndarray, threshold: float) -> np.ndarray:
        bounds = (self.signs[i] @ self._other_side(i).T) / self.f[i, None] + self.error[i, None]
        return (bounds >= threshold) & (bounds.T >= threshold)


def _estimated(threshold: float, confidence: float, width: int, count: int):
    """Tasks that find the rows in a pair which needs recomputation."""

    def rows_to_check(rows: pa.RecordBatch) -> np.ndarray:
        packed = byte_matrix(rows.column("levels"))
        levels = np.empty((len(packed), 2 * packed.shape[1]), dtype=np.float32)
        levels[:, ::2], levels[:, 1::2] = packed >> 4, packed & 15
        f, low, step = (rows.column(c).to_numpy() for c in ("correction", "low", "step"))
        known = _Estimates(_signs(byte_matrix(rows.column("code"))), f, levels, low, step, confidence)
        first = _first_band(rows, width, count)
        found = np.zeros(rows.num_rows, dtype=bool)
        for i, j in _pairs(rows, lambda i, j: known.pass_pairs(i, j, threshold), lambda i: known.pass_square(i, threshold)):
            good = first(i, j)
            found[i[good]] = found[j[good]] = True
        return found

    def task(most: int | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole, found in whole_keys(batches, most):
                for rows in _by_dimension(found) if whole else [_one_of_each(found)]:
                    if whole:
                        rows = rows.filter(pa.array(rows_to_check(rows)))
                    columns = [rows.column(c) for c in ("home", "band", "cid", "signature")]
                    columns.append(pa.array(np.full(rows.num_rows, not whole)))
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "band", "cid", "signature", "large"])

        return run

    return task


def _cosines(unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", unit[i], unit[j])


def _recomputed(threshold: float, confidence: float, width: int, count: int):
    """Tasks that compute the pairs again that their bounds leave, and give each row its
    links (in copies of the vectors linked) and the first row of its component within the key."""

    def links_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        vectors = matrix(rows.column("vector"), np.float64)
        unit = _unit(vectors)
        n = rows.column("n").to_numpy()
        first = _first_band(rows, width, count)
        links, root = np.zeros(rows.num_rows, dtype=np.int64), np.arange(rows.num_rows)
        bits, *rest = encode(vectors)
        signs = (2 * bits.astype(np.float32) - 1) / np.sqrt(np.float32(bits.shape[1]))
        known = _Estimates(signs, *(x.astype(np.float32) for x in rest), confidence)
        # The pairs that pass are the only ones whose cosine is computed.
        for i, j in _pairs(rows, lambda i, j: known.pass_pairs(i, j, threshold), lambda i: known.pass_square(i, threshold)):
            good = first(i, j)
            i, j = i[good], j[good]
            near = np.concatenate([_cosines(unit, i[at : at + PART], j[at : at + PART]) for at in range(0, max(len(i), 1), PART)]) >= threshold
            i, j = i[near], j[near]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            _union(root, i, j)
        return links, root

    def task(most: int | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["key", "cid", "root", "links", "large"]
            for whole, found in whole_keys(batches, most):
                for rows in _by_dimension(found) if whole else [_one_of_each(found)]:
                    cid = rows.column("cid").to_numpy()
                    links, root = links_of(rows) if whole else (np.ones(len(cid), dtype=np.int64), np.arange(len(cid)))
                    some = links > 0
                    columns = [rows.column("home").to_numpy()[some], cid[some], cid[root[some]], links[some], np.full(some.sum(), not whole)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        return run

    return task


def _over_groups(rows: DataFrame, task, schema: str, most: int, name: str) -> DataFrame:
    """A task over the rows of each key; those of large keys in blocks."""
    found = saved(in_arrow(by_key(rows), task(most), schema), name)
    large = found.filter("large").select("key").distinct()
    found = found.filter("not large").drop("large")
    if large.isEmpty():
        return found
    blocks = in_blocks(rows.join(large, "key", "left_semi"), most, F.col("cid"))
    again = saved(in_arrow(blocks, task(None), schema), f"{name}-blocks")
    return found.unionByName(again.drop("large"))


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    confidence: float = CONFIDENCE,
    most: int = MOST,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors(vec_id, embedding)."""
    rows = vectors.select(key("vec_id").alias("id"), F.col("embedding").alias("vector"))
    good = rows.filter(usable("vector")).filter(F.exists("vector", lambda x: x != 0))
    classes = good.groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    width, count = bands(classes.count(), threshold, recall)

    coded = in_arrow(classes.select("cid", "vector"), _coder(width, count), CODED)
    involved = _over_groups(coded, _estimated(threshold, confidence, width, count), INVOLVED, most, "involved").distinct()
    whole = involved.join(classes.select("cid", "n", "vector", F.size("vector").alias("dimension")), "cid")
    linked = _over_groups(whole, _recomputed(threshold, confidence, width, count), LINKED, most, "linked")

    links = saved(linked.groupBy("cid").agg(F.sum("links").alias("links")), "vector-links")
    roots = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = (
        classes.join(links, "cid", "left")
        .join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .select("vector", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    )
    known = saved(known, "vector-nodes")
    smallest = saved(known.groupBy("root").agg(F.min("id").alias("component")), "vector-components")
    known = saved(known.join(smallest, "root").select("vector", "n_links", "component"), "vector-results")
    of_row = F.coalesce("component", "id")
    return rows.join(known, "vector", "left").select(
        unkey("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        unkey(of_row).alias("component_id"),
        (F.col("id") == of_row).alias("kept"),
    )
