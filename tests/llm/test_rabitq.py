import numpy as np
import pyarrow as pa
import pytest

from basketlens.llm import rabitq
from basketlens.llm.rabitq import bands, encode, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, n long, key string"


def rows(dimension=24):
    rng = np.random.default_rng(9)
    out, n = [], 0
    for centre in rng.standard_normal((25, dimension)):
        for _ in range(rng.integers(1, 40)):
            near = centre + rng.standard_normal(dimension) * rng.choice([0.0, 0.05, 0.12, 0.3])
            out.append((n, (near * rng.uniform(0.1, 10)).astype(np.float32).tolist()))
            n += 1
    x = out[0][1]
    out += [(n + i, list(x)) for i in range(60)]
    odd = [None, [], [0.0] * dimension, [float("nan")] * dimension, [float("inf")] + x[1:], [None] + x[1:], x[:8], x[:8], [1.0]]
    out += [(n + 100 + i, v) for i, v in enumerate(odd)]
    return out + [(None, list(x)), (3, list(x)), (None, None)]


def slow(data, threshold=0.95):
    good = [v is not None and len(v) > 0 and all(a is not None and np.isfinite(a) for a in v) and any(v) for _, v in data]
    unit = [np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float)) if g else None for (_, v), g in zip(data, good)]
    root, links = list(range(len(data))), [0] * len(data)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (v, _) in enumerate(data):
        least.setdefault(find(i), []).append(v)
    component = [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(data))]
    return sorted(((v, links[i], component[i], v == component[i]) for i, (v, _) in enumerate(data)), key=str)


@pytest.mark.parametrize("most", [9, 2048])
def test_against_brute_force(spark, most):
    data = rows()
    frame = spark.createDataFrame([(i, v, 7, "clash") for i, v in data], SCHEMA)
    got = near_duplicates(frame, recall=0.9999, confidence=5.0, most=most).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == slow(data)


def test_default_recall_and_precision(spark):
    rng = np.random.default_rng(10)
    base = rng.standard_normal((1500, 64))
    near = base + rng.standard_normal(base.shape) * 0.3  # cosines about the threshold
    vectors = np.vstack([base, near])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_duplicates(frame).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.97 * want.sum() > 100


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(11)
    a = rng.standard_normal((3000, 64))
    b = a + rng.standard_normal(a.shape) * rng.uniform(0.2, 3, (3000, 1))
    cosine = (a * b).sum(axis=1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    bits, f, *_ = encode(a)
    *_, levels, low, step = encode(b)
    other = low[:, None] + step[:, None] * levels
    estimate = ((2.0 * bits - 1) * other).sum(axis=1) / np.sqrt(bits.shape[1]) / f
    error = np.sqrt(1 - f * f) / f / np.sqrt(bits.shape[1] - 1)
    assert abs((estimate - cosine).mean()) < 0.01
    assert (np.abs(estimate - cosine) <= 3 * error).mean() > 0.98


def test_keys_widen_with_the_input():
    assert bands(1 << 12, 0.95, 0.99)[0] < bands(1 << 24, 0.95, 0.99)[0]


@pytest.mark.parametrize("bits", [20, 30])
def test_wide_keys_keep_their_recall(spark, monkeypatch, bits):
    rng = np.random.default_rng(12)
    base, other = rng.standard_normal((2, 3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.9501 * base + np.sqrt(1 - 0.9501**2) * other
    vectors = np.vstack([base, near])
    want = (vectors @ vectors.T >= 0.95).sum() - len(vectors)
    assert want == 6000
    keys = bands(1 << bits, rabitq.THRESHOLD, rabitq.RECALL)  # as for 2 ** bits vectors
    assert keys[0] == bits - 2
    monkeypatch.setattr(rabitq, "bands", lambda *_: keys)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = near_duplicates(frame, confidence=6.0).agg({"n_links": "sum"}).first()[0]
    assert 0.994 * want <= got <= want


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_pairs_that_pass_are_computed_again(spark, monkeypatch):
    """Groups of one direction each within one key; cosines are computed within groups alone."""
    rng = np.random.default_rng(31)
    base = rng.standard_normal(32)
    far = [base + rng.standard_normal(32) * 0.9 for _ in range(4)]
    vectors = np.array([f + rng.standard_normal(32) * 0.01 for f in far for _ in range(30)])
    rows = pa.record_batch(
        {
            "key": pa.array(np.zeros(120, dtype=np.int64)),
            "home": pa.array(np.zeros(120, dtype=np.int64)),
            "block": pa.array(np.zeros(120, dtype=np.int32)),
            "cross": pa.array(np.zeros(120, dtype=bool)),
            "band": pa.array(np.zeros(120, dtype=np.int32)),
            "cid": pa.array(np.arange(120)),
            "signature": pa.array([np.packbits(s).tobytes() for s in rabitq._signatures(vectors)]),
            "dimension": pa.array(np.full(120, 32, dtype=np.int32)),
            "n": pa.array(np.ones(120, dtype=np.int64)),
            "vector": pa.array(vectors.tolist()),
        }
    )
    computed = []
    kept = rabitq._cosines
    monkeypatch.setattr(rabitq, "_cosines", lambda unit, i, j: (computed.append(len(i)), kept(unit, i, j))[1])
    (out,) = rabitq._recomputed(0.95, rabitq.CONFIDENCE, 8, 13)(None)(iter([rows]))
    assert out.column("links").to_pylist() == [29] * 120
    assert 4 * 30 * 29 // 2 <= sum(computed) < 120 * 119 // 2


def test_very_large_and_very_small_components(spark):
    vectors = [(1, [1e200, 2e200]), (2, [1e200, 2.0000001e200]), (3, [1e-200, 2e-200]), (4, [-1e200, 2e200])]
    got = near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}
