"""Toxicity by compression distance.

zstandard dictionaries are trained apart on windows of ordinary and of toxic texts. What
training puts into a dictionary depends on the order of its samples, so `DRAWS` toxic ones
are trained, each on the samples in another order. Of their words those stay that are
clearly more frequent in toxic samples than in ordinary ones, and the ordinary
dictionary's content stands behind them; a window's gain is the bytes by which it is
shorter under the toxic dictionary. What both have in common so costs either the same. A
text's largest gains and its number of windows go into a logistic calibration, whose
output is the score.

The model is fitted on a bounded sample: at most `sample` labelled rows of each class,
by a digest of their ids, none longer than `MAX_SAMPLE_BYTES`; near copies among those of
a class count once. Class shares for the calibration are counted over all training labels.
Scoring reads whole texts and nothing but texts.

Cases: null and empty texts have no window and the score of a text without gains. A
null label teaches nothing; of several labels of one id the largest counts. Without
toxic or without ordinary training rows every score is the share of toxic rows (0 without
any). Repeated rows are scored alike; null ids are not held out and not learned from.
Other columns are ignored, in `without_toxic` passed on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import rest_of_crc32, saved, ship

THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
SAMPLE = 3000
MAX_SAMPLE_BYTES = 200_000
# Text of each class that the driver takes at most.
SAMPLE_BYTES = 64_000_000
WINDOW = 96
TRAIN_WINDOW = 64
LEVEL = 9
ORDINARY_BYTES = 16 * 1024
TOXIC_BYTES = 110 * 1024
DRAWS = 8
# Near copies have at least `ALIKE` of their minimum hashes in common.
HASHES, ALIKE = 32, 24
# A word stays in the toxic dictionary from this z-score of its document shares on.
CLEARLY = 5.0
LEAST_DOCS = 3
# Weight of the empty text in the calibration against all samples together.
EMPTY_SHARE = 0.05


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]  # of `features`; empty: every score is `share`
    share: float


def windows(text: bytes, width: int) -> list[bytes]:
    """Consecutive windows of at most `width` bytes that end behind a space if any."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = at + width
        if end < n:
            space = text.rfind(b" ", at, end)
            end = space + 1 if space > at else end
        out.append(text[at:end])
        at = end
    return out


def _compressor(content: bytes):
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
    ).compress


@lru_cache(maxsize=2)
def _compressors(model: Model):
    return _compressor(model.ordinary), _compressor(model.toxic)


def features(text: bytes, ordinary, toxic) -> tuple[float, ...]:
    gains = sorted((len(ordinary(w)) - len(toxic(w)) for w in windows(text, WINDOW)), reverse=True)
    top = [max(g, 0) for g in gains[:5]]
    return 1.0, float(sum(top[:1])), float(sum(top[:2])), float(sum(top)), float(np.log1p(len(gains)))


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: all of them
        return b"".join(samples)[-size:]


def _distinct(texts: list[bytes]) -> list[bytes]:
    """The texts less near copies of earlier ones, by minimum hashes of word triples."""
    factors = np.random.default_rng(HASHES).integers(1 << 31, size=HASHES, dtype=np.uint64) * 2 + 1
    holders: dict[tuple[int, int], list[int]] = {}
    out: list[bytes] = []
    for text in texts:
        words = text.split()
        triples = (b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))
        hashes = np.fromiter(map(crc32, triples), dtype=np.uint64)
        marks = [(n, int((hashes * f & np.uint64(0xFFFFFFFF)).min())) for n, f in enumerate(factors)]
        shared = Counter(n for m in marks for n in holders.get(m, ()))
        if max(shared.values(), default=0) < ALIKE:
            for m in marks:
                holders.setdefault(m, []).append(len(out))
            out.append(text)
    return out


def _drawn(texts: list[bytes]) -> bytes:
    """The content of dictionaries trained on the texts in several orders."""
    cut = [(t, windows(t, TRAIN_WINDOW)) for t in texts]
    found = []
    for draw in range(DRAWS):
        cut.sort(key=lambda c: (crc32(c[0], draw), c[0]))
        found.append(_trained([w for _, some in cut for w in some], TOXIC_BYTES, 32))
    return b" ".join(found)


def _telling_words(dictionary: bytes, toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of the dictionary that toxic texts have clearly more often, the most telling last."""
    words = {w for w in dictionary.split() if len(w) >= 3}
    in_toxic, in_ordinary = Counter(), Counter()
    for count, texts in ((in_toxic, toxic), (in_ordinary, ordinary)):
        for text in texts:
            count.update(words.intersection(text.split()))
    n, m = len(toxic), len(ordinary)
    scores = []
    for word, a in in_toxic.items():
        p = (a + in_ordinary[word]) / (n + m)
        spread = (p * (1 - p) * (1 / n + 1 / m)) ** 0.5
        if a >= LEAST_DOCS and spread and (z := (a / n - in_ordinary[word] / m) / spread) >= CLEARLY:
            scores.append((z, word))
    return [word for _, word in sorted(scores)]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    b, ridge = np.zeros(x.shape[1]), 1e-2 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(toxic: list[bytes], ordinary: list[bytes], share: float) -> Model:
    """A model from lower-cased sample texts and the share of toxic rows."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    if not any(toxic) or not any(ordinary):
        return Model(b"", b"", (), share)
    base = _trained([w for t in ordinary for w in windows(t, TRAIN_WINDOW)], ORDINARY_BYTES, 24)
    words = _telling_words(_drawn(toxic), toxic, ordinary)
    model = Model(base, b" " + b" ".join(words) + b" " + base, (), share)
    pair = _compressors(model)
    # The empty text counts as ordinary, or the calibration would only guess at it.
    x = np.array([features(t, *pair) for t in [*toxic, *ordinary, b""]])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary) + 1)]
    w = [np.full(len(toxic), share / len(toxic)), np.full(len(ordinary), (1 - share) / len(ordinary)), [EMPTY_SHARE]]
    w = np.concatenate(w) * len(y)
    return Model(model.ordinary, model.toxic, tuple(_logistic(x, y, w)), share)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on docs(doc_id, text) and labels(doc_id, toxic), less the held-out fold."""
    ship(docs.sparkSession)
    known = (
        labels.filter(F.col("toxic").isNotNull() & (rest_of_crc32("doc_id", FOLDS) != HELD_OUT))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") >= 1).alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("text"))
    usable = texts.filter(F.octet_length("text") <= MAX_SAMPLE_BYTES).select("doc_id")
    # Chosen and counted among the documents at hand, whatever else is labelled.
    present = saved(known.join(usable, "doc_id", "left_semi"), "labelled")
    counts = present.agg(F.count_if("toxic"), F.count(F.lit(1))).first()
    share = counts[0] / counts[1] if counts[1] else 0.0
    found = {}
    for toxic in (True, False):
        chosen = present.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        order = [F.xxhash64("doc_id"), "doc_id", F.sha2("text", 256)]
        rows = (
            texts.join(chosen.select("doc_id"), "doc_id")
            .filter(F.octet_length("text") <= MAX_SAMPLE_BYTES)
            .orderBy(*order)
            .limit(sample)
            # One window over at most `sample` rows.
            .withColumn("so_far", F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
            .filter(F.col("so_far") <= SAMPLE_BYTES)
            .orderBy(*order)
        )
        found[toxic] = [bytes(r.text).lower() for r in rows.select("text").collect()]
    return fit(found[True], found[False], share)


def score(model: Model) -> Column:
    """The toxicity of the text column."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            if not model.weights:
                yield pd.Series(np.full(len(some), model.share))
                continue
            pair = _compressors(model)
            x = np.array([features(t.encode().lower() if t else b"", *pair) for t in some]).reshape(len(some), -1)
            yield pd.Series(1 / (1 + np.exp(-(x @ np.array(model.weights)))) if len(some) else [], dtype="float64")

    return scored(F.col("text").cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document row."""
    model = train(docs, labels)
    return docs.select(
        "doc_id",
        F.coalesce(rest_of_crc32("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        score(model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs less those whose score reaches the threshold."""
    return docs.filter(score(train(docs, labels)) < threshold)
