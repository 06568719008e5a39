import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens.llm import pivots
from basketlens.llm.pivots import _distances, search, top_k

SCHEMA = "vec_id long, embedding array<float>, row int, id int"


def data():
    rng = np.random.default_rng(12)
    out = [(int(i), (rng.standard_normal(6) * 0.5).astype(np.float32).tolist()) for i in range(300)]
    out += [(1000 + i, out[50][1]) for i in range(8)] + [(50, out[50][1]), (None, out[50][1])]
    odd = [None, [], [0.0] * 6, [float("nan")] * 6, [None] * 6, [float("-inf")] * 6, [1.0, 2.0], [3.0, -1.0]]
    return out + [(2000 + 50 * i, v) for i, v in enumerate(odd)] + [(-50, out[1][1])]


def slow(rows, k=5):
    good = [(i, v, np.floor(np.array(v, dtype=np.float32).astype(float) * 256).astype(int)) for i, v in rows
            if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (q, _, a) in enumerate(good):
        if q is None or q % 50:
            continue
        found = [(-int(a @ b), c is None, c or 0) for m, (c, _, b) in enumerate(good) if m != n and len(b) == len(a)]
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [(8192, 4096), (2, 17)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(pivots, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(pivots, "CANDIDATE_BLOCK", blocks[1])
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in data()], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(frame).collect()]
    assert sorted(got, key=str) == slow(data())


def test_stops_early_and_stays_exact():
    rng = np.random.default_rng(13)
    c = np.floor(rng.standard_normal((4000, 8)) * 200)
    q, near = c[:20] * 3, c[::200]
    seen = list(search(q, _distances(q, near), c, _distances(c, near), np.arange(4000), np.full(20, -1), 5))
    for n, best, scores in seen:
        exact = c @ q[n]
        order = np.lexsort((np.arange(4000), -exact))[:5]
        assert best.tolist() == order.tolist() and scores.tolist() == exact[order].tolist()


def test_other_queries_and_empty(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    got = top_k(frame, queries=F.col("id") == 1, k=2).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 3), (1, 2, 2)]
    assert top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_floors_drop_only_what_cannot_reach_them():
    rng = np.random.default_rng(14)
    c = np.floor(rng.standard_normal((700, 6)) * 200)
    q, near = c[:10], c[::70]
    floors = np.sort(q @ c.T, axis=1)[:, -3]
    for n, best, scores in search(q, _distances(q, near), c, _distances(c, near), np.arange(700), np.full(10, -1), 5, floors):
        assert sorted(scores.tolist()) == sorted((c @ q[n])[c @ q[n] >= floors[n]].tolist()) and len(best) == 3


def test_table_is_saved_once_and_blocks_are_left_out(spark, monkeypatch):
    """Far clusters of vectors: a query goes to few of their blocks, the result stays exact."""
    rng = np.random.default_rng(15)
    centres = rng.standard_normal((12, 6)) * 40
    rows = [(i, (centres[i % 12] + rng.standard_normal(6) * 0.1).tolist()) for i in range(600)]
    monkeypatch.setattr(pivots, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(pivots, "SUMMARIES", 5)
    pairs = []
    kept = pivots.saved

    def watched(df, name):
        out = kept(df, name)
        pairs.append((name, out))
        return out

    monkeypatch.setattr(pivots, "saved", watched)
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(frame).collect()]
    assert sorted(got, key=str) == slow(rows)
    made = dict(pairs)
    assert len(made) == len(pairs)
    table = made["pivot-blocks"].select("row", "norm", "distances", "vector").collect()
    assert len(table) == 600 and all(len(r.distances) == pivots.PIVOTS and r.norm == sum(x * x for x in r.vector) for r in table)
    assert made["pairs-left"].count() < 0.5 * made["pivot-queries"].count() * made["block-bounds"].count()
