import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from basketlens.llm import maxent
from basketlens.llm.common import read
from basketlens.llm.maxent import CLASSES, log_softmax, score
from tests.conftest import SF001

SCHEMA = "doc_id long, text string, n long, base string, word string"


def rows():
    rng = random.Random(14)
    first, second = [f"{a}on" for a in "bcdfghklm"], [f"{a}ets" for a in "pqrstvwxz"]
    out = []
    for i in range(250):
        words = first if rng.random() < 0.5 else second
        text = [rng.choice(words) if rng.random() < 0.9 else f"{rng.choice(words)}{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))]
        out.append((i, "\t ".join(text)))
    return out + [(300, None), (301, ""), (302, "Ä b \x1c"), (None, "bon con"), (5, "bon"), (5, "bon"), (303, "bon " * 30_000)]


def slow_base(data):
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    count = Counter()
    for i, t in data:
        if i is not None and crc32(str(i).encode()) % 7 != 2:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in data:
        w = tokens(t)
        held = i is not None and crc32(str(i).encode()) % 7 == 2
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, held, len(w), sum(count[x] > 0 for x in w), n, base))
    return sorted(out, key=str)


@pytest.mark.parametrize("head", [10, 131_072])
def test_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(maxent, "HEAD", head)
    frame = spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in rows()], SCHEMA)
    found = score(frame).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=str)
    want = slow_base(rows())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    # The model knows which words follow each other.
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in found)


def test_model_beats_its_base_on_held_out_texts(spark):
    found = [r for r in score(read(spark, SF001, "documents")).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in rows() if i is not None], "doc_id long, text string")
    counted = maxent.in_arrow(docs.select("text"), maxent._counted, "word string, n long")
    counts = counted.groupBy("word").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").cache()
    model = maxent.fit(docs.select("text"), counts)
    p = np.exp(log_softmax(model.weights, np.arange(maxent.PREVIOUS * maxent.SKIPPED)))
    assert np.allclose(p.sum(axis=1), 1)
    # Within a class: its known tokens and one share for all unknown ones.
    weight = model.in_class + model.unseen()
    codes, classes = model.codes(), model.classes()
    known = np.zeros(CLASSES)
    for r in counts.collect():
        known[CLASSES - 1 if r.word == "\n" else classes[codes[r.word.encode()]]] += r.n
    used = weight > 0
    assert np.allclose((known + model.unseen())[used] / weight[used], 1)


def test_no_training_rows_and_empty(spark):
    held = [i for i in range(100) if crc32(str(i).encode()) % 7 == 2][:3]
    frame = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    for r in score(frame).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert score(spark.createDataFrame([], SCHEMA)).count() == 0
