import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from basketlens.llm import maxent, ngrams
from basketlens.llm.maxent import CLASSES, PREVIOUS, SKIPPED, log_softmax, score

RARE = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in "aeiou" for c in ["net", "ral", "tim", "sok", "vud", "pex", "zog", "lir", "hum", "qua"]]


def held_out(i):
    return crc32(str(i).encode()) % 7 == 2


def test_weights_are_at_the_optimum():
    rng = np.random.default_rng(3)
    for size in (1, 2, 30, 400):
        n = np.ceil(rng.pareto(0.8, size) * 20)
        base = rng.dirichlet(np.full(size + 1, 0.3))[:size] * rng.choice([1, 0.01]) + 1e-9
        w, z = ngrams.weights(n, base, np.zeros(size, dtype=int), 1)
        p = base * np.exp(w) / z[0]
        assert np.allclose(z[0], 1 - base.sum() + (base * np.exp(w)).sum())
        assert np.allclose(n - n.sum() * p, ngrams.RIDGE * w, atol=1e-2)


def test_packed_integers_come_back():
    x = np.random.default_rng(1).integers(0, 1 << 58, 1000).astype(np.uint64)
    assert (ngrams.unpacked(ngrams.packed_bytes(x), 1000, np.uint64) == x).all()
    assert len(ngrams.unpacked(ngrams.packed_bytes(x[:0]), 0, np.int32)) == 0


def fitted(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    count = Counter(w for t in texts for w in maxent.tokens(t.encode())) + Counter({b"\n": len(texts)})
    counts = spark.createDataFrame([(w.decode(), n) for w, n in count.items()], "word string, n long").cache()
    return maxent.fit(docs, counts), counts, count


@pytest.mark.parametrize("head", [10, 131_072])
def test_probabilities_after_a_history_sum_to_one(spark, monkeypatch, head):
    """Over the end, the head words and the classes behind it; and of a class behind it,
    over its buckets, with their gains, and the unknown words."""
    monkeypatch.setattr(maxent, "HEAD", head)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(RARE[: rng.choice([20, 500])]) for _ in range(30)) for _ in range(120)]
    model, counts, _ = fitted(spark, texts)
    tables = maxent._tables(model, counts)
    codes, classes = model.codes(), model.classes()
    codes[b"\n"] = model.end
    grams, n = [], Counter()
    for t in texts:
        flat = [model.end] * 2 + [codes[w] for w in maxent.tokens(t.encode())] + [model.end]
        n.update(a << 38 | b << 19 | c for a, b, c in zip(flat[1:], flat, flat[2:]))
    seen = rng.sample(sorted(n), 5)
    outcomes = np.append(np.flatnonzero(tables.share > 0), model.end)
    histories = {g >> 19 for g in seen} | {codes[b"banet"] << 19 | codes[b"muqua"]}
    grams = np.unique(np.array([*n, *(h << 19 | int(o) for h in histories for o in outcomes)], dtype=np.uint64))
    logs, gain = ngrams.log_scores(tables, grams, np.array([n[int(g)] for g in grams], dtype=float))
    p, word = 10**logs, (grams & np.uint64(ngrams.MASK)).astype(int)
    for h in histories:
        mine = (grams >> np.uint64(19)) == h
        behind = mine & tables.behind(word)
        total = p[mine & ~behind].sum()
        for kind in set(classes[word[behind]].tolist()):
            of = behind & (classes[word] == kind)
            assert np.isclose(p[of].min(), p[of].max())
            assert np.isclose((tables.share[word[of]] * 10 ** gain[of]).sum(), 1)
            total += p[of][0]
        # What is left are head classes' shares kept for unknown words and classes without words.
        assert total <= 1 + 1e-9 and total > 0.85
    assert head > 100 or (gain != 0).any()


@pytest.mark.parametrize("head", [300, 131_072])
def test_rare_words_are_features_and_outcomes(spark, monkeypatch, head):
    """Which rare word follows which, and after which pair, is learned for every word, not
    for the most frequent alone."""
    monkeypatch.setattr(maxent, "HEAD", head)
    rng = random.Random(5)
    ids = [i for i in range(2600) if not held_out(i)]
    follow = dict(zip(RARE, rng.sample(RARE, len(RARE))))
    rows = []
    for i in ids:
        words = [rng.choice(RARE) for _ in range(12)]
        rows.append((i, " ".join(f"{w} {follow[w]}" for w in words)))
    test = [i for i in range(5000, 6000) if held_out(i)][:60]
    for k, i in enumerate(test):
        words = RARE[k * 8 : k * 8 + 8]
        after = [follow[w] for w in words]
        rows.append((i, " ".join(f"{a} {b}" for a, b in zip(words, after))))
        rows.append((i, " ".join(f"{a} {b}" for a, b in zip(words, after[1:] + after[:1]))))
    found = [r for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append((r.base_score, r.score))
    assert len(by_id) == len(test)
    for (base, a), (same, b) in by_id.values():
        assert np.isclose(base, same) and abs(a - b) > 18


def test_texts_that_occur_twice_are_scored_apart(spark):
    rng = random.Random(9)
    ids = [i for i in range(1500) if not held_out(i)]
    texts = [" ".join(rng.choice(RARE) for _ in range(40)) for _ in ids]
    rows = list(zip(ids, texts)) + [(10_000_000 + i, t) for i, t in zip(ids[:40], texts[:40])]
    found = {r.doc_id: r.score / r.n_tokens for r in score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    others = sorted(found[i] for i in ids[40:])
    assert sum(found[i] > others[int(0.9 * len(others))] for i in ids[:40]) >= 36


def test_parts_chunks_and_contexts_lose_no_token(spark, monkeypatch):
    """Scores from many parts and chunks equal those of one; with contexts told apart
    every token still counts once."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(RARE[: rng.choice([9, 400])]) for _ in range(rng.randint(0, 50)))) for i in range(300)] + [(None, "banet x"), (7, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    scores = lambda: sorted((str(r.doc_id), r.score) for r in score(frame).collect())
    whole = scores()
    monkeypatch.setattr(ngrams, "FEW", 500)
    monkeypatch.setattr(ngrams, "PART", 300)
    many = scores()
    assert [m[0] for m in many] == [w[0] for w in whole]
    assert np.allclose([m[1] for m in many], [w[1] for w in whole], rtol=1e-9)


def test_a_part_in_chunks_equals_a_part_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    kinds = 31
    classes = np.append(rng.integers(0, 30, 80), 30).astype(np.int8)
    classes[:50] %= 20
    classes[50:80] = 20 + classes[50:80] % 10
    share = np.ones(80) / np.bincount(classes, minlength=kinds)[classes[:80]]
    after = log_softmax({"bias": rng.normal(size=(1, kinds)), "previous": np.zeros((PREVIOUS, kinds)), "skipped": np.zeros((SKIPPED, kinds)), "pair": np.zeros((maxent.HASHED, kinds))}, np.arange(PREVIOUS * SKIPPED))
    one = np.zeros(81, dtype=np.int32)
    for pieces in (1, 3):
        tables = ngrams.Tables(after, SKIPPED, classes, one, one, one + pieces, share, 50)
        tokens = [(rng.integers(0, 81, 400), rng.integers(0, 81, 400), rng.integers(0, 81, 400), rng.random(400) < 0.8, np.sort(rng.integers(0, 30, 400)), np.arange(400, dtype=np.int32)) for _ in range(6)]
        monkeypatch.setattr(ngrams, "HELD", 700)
        packed = [b for batch in ngrams.spread(tables, 1, lambda x: [x])(tokens) for b in batch.to_pylist()]
        blobs = [[b[c] for c in ("tokens", "n", "rows", "runs", "places")] for b in packed]
        assert len(blobs) > 1 and sum(b["n"] for b in packed) == 2400

        def sums(chunk):
            monkeypatch.setattr(ngrams, "CHUNK", chunk)
            rows, gains = Counter(), Counter()
            for r, s, g, place, gain in ngrams._part_scores(tables, blobs):
                for a, b in zip(r.tolist(), s.tolist()):
                    rows[a] += b
                for a, p, b in zip(g.tolist(), place.tolist(), gain.tolist()):
                    gains[a, p] += b
            return rows, gains

        at_once, in_chunks = sums(10**6), sums(1)
        for x, y in zip(at_once, in_chunks):
            assert x.keys() == y.keys() and np.allclose([x[k] for k in x], [y[k] for k in x])
        assert len(at_once[0]) == 30 and at_once[1]
