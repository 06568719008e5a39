"""Exact top-k inner products by pivot-table elimination.

Vectors are made integers, floor(scale * x). The pivot table is made once: every row is
saved with its distances to a fixed set of pivots. For a query and a candidate the
largest difference of their distances to a pivot is a lower bound of their own distance,
and |q|^2 + |c|^2 less its square, halved, an upper bound of their inner product.

Candidates with the same nearest pivot form blocks of bounded size, each known by its
largest norm and its least and largest distance to every pivot. A query is first searched
in the block it lies in itself; the k-th score found there is its floor. The same bound,
taken over a whole block, then leaves the pairs of query and block that can still
reach the floor; only these are sent on. Within a block, candidates that can reach the
floor and the k-th best score so far are evaluated in the order of their bounds until
none is left. The k best of all blocks are ranked at the end.

Cases: vectors that are null, empty or hold null or non-finite components take no
part, neither as queries nor as candidates; vectors of different lengths are never
compared. A zero vector takes part. Repeated rows are candidates of their own; a query
leaves out its own row only. Ties go to the smaller vec_id, null ids last. Scores are
exact while they stay below 2^53. Other columns are ignored. Empty input gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import NO_ID, in_arrow, key, saved, unkey
from basketlens.llm.groups import starts_of, whole_keys
from basketlens.llm.vectors import matrix, usable

SCALE = 256
TOP = 5
PIVOTS = 32
QUERY_BLOCK, CANDIDATE_BLOCK = 8192, 4096
# Blocks whose bounds a task holds at once.
SUMMARIES = 2048
# Queries whose bounds are held at once, and candidates evaluated between two looks
# at the stopping rule.
_QUERIES, _STEP = 128, 512

TABLE = "row long, id long, vector array<long>, length int, norm double, distances array<double>, cluster int"
BEST = "query long, query_id long, id long, score long"
LEFT = "row long, block long"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, id, vector of bigint) of the usable rows, saved."""
    made = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.filter(usable("embedding")).select(key("vec_id").alias("id"), made.alias("vector"))
    return saved(rows.withColumn("row", F.monotonically_increasing_id()), "integer-vectors")


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _tabled(pivots: dict[int, np.ndarray], width: int):
    """Task: rows with their norms, distances to the pivots (`width` of them, zeros where
    a length has fewer) and nearest pivot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for length in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == length))
                vectors, n = matrix(rows.column("vector"), np.float64), rows.num_rows
                near = _distances(vectors, pivots[int(length)])
                table = np.zeros((n, width))
                table[:, : near.shape[1]] = near
                flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, table.ravel())
                columns = [rows.column(c) for c in ("row", "id", "vector")]
                columns += [pa.array(np.full(n, length, dtype=np.int32)), pa.array((vectors**2).sum(axis=1)), flat]
                columns.append(pa.array(near.argmin(axis=1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "vector", "length", "norm", "distances", "cluster"])

    return run


def _bounds(total: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Upper bounds of inner products from |q|^2 + |c|^2 and lower bounds of distances.
    The slack covers rounding of the distances; scores are integers."""
    return np.floor((total - apart**2) / 2 + 1e-9 * total + 0.5)


def search(q: np.ndarray, q_table: np.ndarray, c: np.ndarray, c_table: np.ndarray, ids: np.ndarray,
           own: np.ndarray, k: int, floors: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, candidates, scores) with the k best candidates of each query, of those
    that reach its floor.

    q_table and c_table hold distances to the pivots, ids the candidates' ids for ties,
    own the place of each query among the candidates (-1: elsewhere).
    """
    c_norm = (c**2).sum(axis=1)
    for at in range(0, len(q), _QUERIES):
        some, table = q[at : at + _QUERIES], q_table[at : at + _QUERIES]
        apart = np.zeros((len(some), len(c)))
        for p in range(table.shape[1]):
            np.maximum(apart, np.abs(table[:, p, None] - c_table[None, :, p]), out=apart)
        bounds = _bounds((some**2).sum(axis=1)[:, None] + c_norm[None, :], apart)
        order = np.argsort(-bounds, axis=1, kind="stable")
        for n in range(len(some)):
            best, best_scores = np.empty(0, dtype=np.int64), np.empty(0)
            limit = -np.inf if floors is None else floors[at + n]
            for start in range(0, len(c), _STEP):
                now = order[n, start : start + _STEP]
                now = now[bounds[n, now] >= limit]
                if not len(now):
                    break
                now = now[now != own[at + n]]
                scores = c[now] @ some[n]
                best = np.concatenate([best, now[scores >= limit]])
                best_scores = np.concatenate([best_scores, scores[scores >= limit]])
                keep = np.lexsort((ids[best], -best_scores))[:k]
                best, best_scores = best[keep], best_scores[keep]
                if len(best) == k:
                    limit = max(limit, best_scores[-1])
            yield at + n, best, best_scores


def _list_matrix(column: pa.Array) -> np.ndarray:
    return matrix(column, np.float64) if len(column) else np.empty((0, 0))


def _left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of a query and a block other than its own that the bounds leave."""
    for _, rows in whole_keys(batches, None):
        keys = rows.column("key").to_numpy()
        for a, b in zip(starts_of(keys)[:-1], starts_of(keys)[1:]):
            group = rows.slice(a, b - a)
            asks, length = (group.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "length"))
            for one in np.unique(length[asks]):
                queries, blocks = (group.filter(pa.array((length == one) & side)) for side in (asks, ~asks))
                least, most = _list_matrix(blocks.column("least")), _list_matrix(blocks.column("most"))
                q_table, floors = _list_matrix(queries.column("least")), queries.column("floor").to_numpy()
                number, own = blocks.column("block").to_numpy(), queries.column("block").to_numpy()
                for n in range(queries.num_rows if len(number) else 0):
                    apart = np.maximum(least - q_table[n], q_table[n] - most).max(axis=1)
                    total = queries.column("norm")[n].as_py() + blocks.column("norm").to_numpy()
                    good = (_bounds(total, np.maximum(apart, 0)) >= floors[n]) & (number != own[n])
                    row = np.full(int(good.sum()), queries.column("row")[n].as_py(), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(number[good])], names=["row", "block"])


def _searcher(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in whole_keys(batches, None):
            keys = rows.column("key").to_numpy()
            for a, b in zip(starts_of(keys)[:-1], starts_of(keys)[1:]):
                found = _in_group(rows.slice(a, b - a), k)
                if found:
                    columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query", "query_id", "id", "score"])

    return run


def _in_group(rows: pa.RecordBatch, k: int) -> list[tuple[np.ndarray, ...]]:
    out = []
    lengths = rows.column("length").to_numpy()
    asks = rows.column("asks").to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[asks]):
        queries, candidates = (rows.filter(pa.array((lengths == length) & side)) for side in (asks, ~asks))
        if not candidates.num_rows:
            continue
        q, c = matrix(queries.column("vector"), np.float64), matrix(candidates.column("vector"), np.float64)
        tables = [matrix(x.column("distances"), np.float64) for x in (queries, candidates)]
        q_rows, c_rows = queries.column("row").to_numpy(), candidates.column("row").to_numpy()
        by_row = np.argsort(c_rows)
        at = np.minimum(np.searchsorted(c_rows, q_rows, sorter=by_row), len(c_rows) - 1)
        own = np.where(c_rows[by_row[at]] == q_rows, by_row[at], -1)
        ids, q_ids = candidates.column("id").to_numpy(), queries.column("id").to_numpy()
        floors = queries.column("floor").to_numpy()
        for n, best, scores in search(q, tables[0], c, tables[1], ids, own, k, floors):
            out.append((np.full(len(best), q_rows[n]), np.full(len(best), q_ids[n]), ids[best], scores))
    return out


def _searched(queries: DataFrame, candidates: DataFrame, k: int, name: str) -> DataFrame:
    """The k best of each group, whose rows share a key."""
    columns = ["key", "row", "id", "vector", "length", "distances"]
    both = queries.select(*columns, "floor", F.lit(True).alias("asks")).unionByName(
        candidates.select(*columns, F.lit(float("-inf")).alias("floor"), F.lit(False).alias("asks"))
    )
    return saved(in_arrow(both.repartition("key").sortWithinPartitions("key"), _searcher(k), BEST), name)


def pivot_table(rows: DataFrame, pivots: int = PIVOTS, block: int | None = None) -> tuple[DataFrame, int]:
    """rows(row, id, vector) with norm, distances and block, saved; the number of distances."""
    # The pivots: a fixed number of vectors by a digest of their ids, for each length.
    chosen = Window.partitionBy(F.size("vector")).orderBy(F.xxhash64("id"), "id", "row")
    some: dict[int, list] = {}
    for r in rows.withColumn("nth", F.row_number().over(chosen)).filter(F.col("nth") <= pivots).select("vector").collect():
        some.setdefault(len(r.vector), []).append(r.vector)
    arrays = {length: np.array(v, dtype=np.float64) for length, v in some.items()}
    width = max((len(a) for a in arrays.values()), default=1)
    table = saved(in_arrow(rows.select("row", "id", "vector"), _tabled(arrays, width), TABLE), "pivot-table")
    parts = F.ceil(F.count(F.lit(1)) / (block or CANDIDATE_BLOCK)).cast("int")
    sizes = table.groupBy("length", "cluster").agg(parts.alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    return saved(table.join(sizes, ["length", "cluster"]).withColumn("block", F.xxhash64("length", "cluster", part)), "pivot-blocks"), width


def top_k(vectors: DataFrame, queries=None, k: int = TOP, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query.

    vectors(vec_id, embedding); `queries` is a condition on the integer column `id`
    (default: divisible by 50). All usable rows are candidates.
    """
    rows, width = pivot_table(integers(vectors, scale), pivots)
    asked = F.pmod("id", F.lit(50)) == 0 if queries is None else queries
    asks = rows.filter(asked & (F.col("id") != NO_ID))
    home = _searched(
        asks.withColumns({"key": F.col("block"), "floor": F.lit(float("-inf"))}), rows.withColumn("key", F.col("block")), k, "home-found"
    )
    # With fewer than k found at home every block may hold more.
    floors = home.groupBy(F.col("query").alias("row")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor")
    )
    asks = saved(asks.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "pivot-queries")

    of_pivot = [F.get("distances", F.lit(p)) for p in range(width)]
    blocks = rows.groupBy("length", "block").agg(
        F.max("norm").alias("norm"),
        F.array(*map(F.min, of_pivot)).alias("least"),
        F.array(*map(F.max, of_pivot)).alias("most"),
    )
    blocks = saved(blocks, "block-bounds")
    q_blocks, chunks = max(1, -(-asks.count() // QUERY_BLOCK)), max(1, -(-blocks.count() // SUMMARIES))
    q_block, chunk = F.pmod(F.xxhash64("row"), F.lit(q_blocks)), F.pmod(F.xxhash64("block"), F.lit(chunks))

    def dealt(side: DataFrame, number, others: int):
        return side.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).withColumn("key", number)

    one = dealt(asks, q_block * chunks + F.col("other"), chunks).select(
        "key", F.lit(True).alias("asks"), "row", "length", "block", "norm", F.col("distances").alias("least"), "floor",
        F.col("distances").alias("most"),
    )
    two = dealt(blocks, F.col("other") * chunks + chunk, q_blocks).select(
        "key", F.lit(False).alias("asks"), F.lit(-1).cast("long").alias("row"), "length", "block", "norm", "least",
        F.lit(0.0).alias("floor"), "most",
    )
    left = saved(in_arrow(one.unionByName(two).repartition("key").sortWithinPartitions("key"), _left, LEFT), "pairs-left")
    left = left.withColumn("key", F.xxhash64("block", q_block))
    groups = left.select("key", "block").distinct()
    away = _searched(asks.drop("block").join(left.drop("block"), "row"), rows.join(groups, "block"), k, "away-found")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return (
        home.unionByName(away)
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), unkey("id").alias("vec_id"), "score")
    )
