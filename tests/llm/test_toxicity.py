import math
import random
from zlib import crc32

import pytest
import zstandard

from basketlens.llm.common import read
from basketlens.llm.toxicity import LEVEL, WINDOW, _compressor, _distinct, classify, features, fit, train, windows, without_toxic
from tests.conftest import SF01

DOCS, LABELS = "doc_id long, text string, score double, predicted string", "doc_id long, toxic int, text string"


def made(seed=1, n=600):
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "du", "ska", "pe", "vor", "ni"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 300))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobblewort", "Zankfleck", "miesquark"]))
        docs.append((i, " ".join(words), 1.0, "clash"))
        labels.append((i, int(toxic), "clash"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = made()
    rows = classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    truth = {d: t for d, t, _ in labels}
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    wrong = sum(r.predicted != truth[r.doc_id] for r in held)
    assert wrong <= 0.05 * len(held)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = made(n=200)
    swapped = [(d, 1 - t if crc32(str(d).encode()) % 4 == 2 else t, x) for d, t, x in labels]
    frame = spark.createDataFrame(docs, DOCS)
    one = {r.doc_id: r.score for r in classify(frame, spark.createDataFrame(labels, LABELS)).collect()}
    two = {r.doc_id: r.score for r in classify(frame.select("doc_id", "text"), spark.createDataFrame(swapped, LABELS)).collect()}
    assert one == two


def test_given_labels(spark):
    rows = classify(read(spark, SF01, "documents"), read(spark, SF01, "labels")).join(read(spark, SF01, "labels"), "doc_id")
    held = rows.filter("held_out").collect()
    caught = sum(r.predicted for r in held if r.toxic)
    false = sum(r.predicted for r in held if not r.toxic)
    assert caught >= 0.5 * sum(r.toxic for r in held) and false <= 0.05 * len(held)


def test_edges(spark):
    docs, labels = made(n=150)
    docs += [(None, None, None, None), (9000, "", None, None), (9001, None, None, None), (9002, "x" * 300_000, None, None), (0, "again", 0.0, "")]
    labels += [(None, 1, ""), (3, None, ""), (7, 0, ""), (12345, 1, "")]
    frame, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = classify(frame, known).collect()
    assert len(rows) == len(docs)
    empty = {r.score for r in rows if r.doc_id in (None, 9000, 9001)}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.3
    kept = without_toxic(frame, known)
    assert kept.columns == frame.columns and kept.count() == sum(not r.predicted for r in rows)


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_one_class_or_no_labels(spark, toxic):
    docs, labels = made(n=20)
    known = [] if toxic is None else [(d, toxic, x) for d, _, x in labels]
    frame = spark.createDataFrame(docs, DOCS)
    rows = classify(frame, spark.createDataFrame(known, LABELS)).collect()
    assert {r.score for r in rows} == {float(toxic or 0)}


def test_empty(spark):
    docs, labels = made(n=20)
    known = spark.createDataFrame(labels, LABELS)
    assert classify(spark.createDataFrame([], DOCS), known).count() == 0
    assert train(spark.createDataFrame([], DOCS), known).weights == ()
    assert fit([], [b"x"], 0.0).weights == ()


def test_windows_are_the_whole_text():
    text = ("some words " * 50 + "y" * 400 + " end").encode()
    cut = windows(text, 64)
    assert b"".join(cut) == text and max(map(len, cut)) <= 64
    assert windows(b"", 64) == []


def test_words_do_not_depend_on_the_order_of_the_sample():
    docs, labels = made(n=300)
    classes = [[d[1].encode().lower() for d, x in zip(docs, labels) if x[1] == toxic] for toxic in (1, 0)]
    found = set()
    for seed in range(3):
        for texts in classes:
            random.Random(seed).shuffle(texts)
        model = fit(*classes, 1 / 7)
        found.add(model.toxic[: len(model.toxic) - len(model.ordinary)])
    assert len(found) == 1 and b"grobblewort" in found.pop()


def test_only_near_copies_are_dropped_from_the_sample():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(100)]
    sharing = [" ".join(passage + [word() for _ in range(100)]).encode() for _ in range(40)]
    copies = [b" ".join([*sharing[0].split()[:-1], b"last%d" % n]) for n in range(20)]
    assert _distinct(sharing + copies) == sharing
    assert _distinct([b"", b"", b"one", b"one", b"two words"]) == [b"", b"one", b"two words"]


def test_features_are_gains_of_windows():
    """Against gains of one compressor made anew for each window."""
    rng = random.Random(4)
    ordinary, toxic = (bytes(rng.choice(b"abcdef ") for _ in range(2000)) for _ in range(2))

    def size(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(window))

    for n in (0, 1, 95, 400, 3000):
        text = bytes(rng.choice(b"abcdef ") for _ in range(n)) + toxic[:n]
        gains = sorted((size(ordinary, w) - size(toxic, w) for w in windows(text, WINDOW)), reverse=True)
        best = [max(0, g) for g in gains[:5]]
        want = (1.0, sum(best[:1]), sum(best[:2]), sum(best), math.log1p(len(gains)))
        assert features(text, _compressor(ordinary), _compressor(toxic)) == pytest.approx(want)
