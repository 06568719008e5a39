import random

import numpy as np
import pytest

from basketlens.llm.repeats import _ODD, _Powers, packed, rolling, unpacked, without_repeats

SCHEMA = "doc_id long, text string, id string, digest string, hits string"
LAST = 2**63 - 1


def slow(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    ids = [LAST if d is None else d for d, _ in rows]
    least = {}
    for doc_id, w in zip(ids, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, LAST), doc_id)
    out = []
    for (doc_id, _), mine, w in zip(rows, ids, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < mine:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def documents(window):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randint(window - 1, 4 * window))] for _ in range(6)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                text += [rng.choice("abcdefghij") for _ in range(rng.randint(0, window))]
            else:
                passage = list(rng.choice(passages))
                if rng.random() < 0.3:
                    passage[rng.randrange(len(passage))] = "other"
                text += passage[rng.randint(0, window // 2) :]
        rows.append((rng.randint(0, 60), rng.choice([" ", "\n", " \t"]).join(text)))
    same = " ".join(["x"] * 7 * window)
    rows += [(None, rows[0][1]), (None, rows[0][1]), (3, None), (4, ""), (5, " \x0b\f"), (1000, same), (1001, same + " y"), (1002, "  " * 3 * window)]
    rows += [(2000, " ".join(rng.choice("ab") for _ in range(3000))), (-5, " ".join(passages[0] + passages[1]).upper())]
    return rows


def as_rows(found, with_spans=False):
    out = []
    for r in found.collect():
        assert r.spans == sorted(r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        out.append((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.text))
    return sorted(out, key=str)


@pytest.mark.parametrize("window, options", [(4, {}), (7, {"chunk": 100}), (10, {"chunk": 1, "bucket_bytes": 2000}), (50, {"chunk": 500, "bucket_bytes": 9000})])
def test_against_brute_force(spark, window, options):
    rows = documents(window)
    frame = spark.createDataFrame([(d, t, "clash", "clash", "clash") for d, t in rows], SCHEMA)
    got = as_rows(without_repeats(frame.repartition(3), window, **options))
    assert got == slow(rows, window)


def test_rolling_hashes_depend_on_their_words_alone():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    for odd in _ODD:
        powers = _Powers(odd)
        twice = rolling(np.concatenate([values, values[100:200]]), 25, powers)
        assert np.array_equal(twice[500:], twice[100:176])
        assert len(np.unique(twice[:470])) == 470
        assert len(rolling(values[:24], 25, powers)) == 0


def test_packed_arrays_come_back():
    for dtype in (np.uint32, np.uint64):
        values = np.random.default_rng(1).integers(0, 1 << 32, 77).astype(dtype)
        assert np.array_equal(unpacked(packed(values), dtype), values)
        assert len(unpacked(packed(values[:0]), dtype)) == 0


def test_passage_in_most_documents_and_over_borders(spark):
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}"] * (i % 29) + passage + [f"z{i}"] * 5)) for i in range(300)]
    got = as_rows(without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), chunk=200, bucket_bytes=5000))
    assert [r[2] for r in sorted(got, key=lambda r: r[0])] == [0] + [60] * 299


def test_empty_input(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
