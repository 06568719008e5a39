"""Weights of the n-grams of a hashed maximum-entropy model, learned where they lie.

A token goes with its two predecessors to the part of the previous one, so that all
tokens of a history meet in one task. There four softmax factors are trained one on the
other, each on every training token of the part:

    P(class | previous), over the class model     features (previous, class)
    P(class | previous, skipped)                  features (previous, skipped, class)
    P(word | class, previous), over its share     features (previous, word)
    P(word | class, previous, skipped)            features (previous, skipped, word)

A factor is base * exp(weight) / Z with one weight for every feature that occurs in
training; those of all other outcomes are 0, so Z is 1 plus a sum over the features of
the history. `weights` finds the largest likelihood less RIDGE / 2 times the squared
weights. Words behind the head are told apart by hash buckets, as predecessors and as
outcomes. Whether a word of a text that isn't learned from was seen in training is not known here: the
gain of its bucket over the bucket's share is handed on with its place in the text.

A predecessor with more than `LARGE` tokens is told apart by a hash of the skipped token
too, so that no history needs more than a part. Parts are read in chunks; what a task
holds at a time are the compressed tokens and the distinct n-grams of a part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import in_arrow

RIDGE = 1.0
PART = 1_000_000  # tokens of a part, about
LARGE = 1_000_000
TASKS = 64  # that share the parts, one for each FEW tokens at most
FEW = 100_000
SHARES = 16  # parts of a task at least, so that tasks are alike
HELD = 4_000_000  # tokens that a task packs at a time
CHUNK = 1_000_000  # tokens of a part that a task unpacks at a time
BITS = 19  # of a code
MASK = (1 << BITS) - 1
PACKED = "part long, tokens binary, n long, rows binary, runs binary, places binary"
SCORED = "row long, place int, score double, gain double"


@dataclass
class Tables:
    """What the tasks need of the class model, all by code but the first two."""

    classes_after: np.ndarray  # natural log of P(class | history)
    skips: int  # values of the skipped token in a history number
    classes: np.ndarray
    previous: np.ndarray  # value as previous token
    skipped: np.ndarray
    pieces: np.ndarray  # that a predecessor's tokens are told apart in
    share: np.ndarray  # of a word of the head in its class, of a bucket in the class's words
    head: int  # words of the head, whose codes come first; the end's is the last

    def behind(self, codes: np.ndarray) -> np.ndarray:
        return (codes >= self.head) & (codes < len(self.share))

    def contexts(self, previous: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """The previous token, those with many tokens by a hash of the skipped one."""
        return previous + ((skipped * 2654435761 >> 16) % self.pieces[previous].astype(np.int64) << BITS)


def packed_bytes(values: np.ndarray) -> bytes:
    """Integers as compressed bytes, equal places side by side."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpacked(packed: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.Codec("zstd").decompress(packed, decompressed_size=n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).reshape(-1)


def weights(n: np.ndarray, base: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each feature that occurs n times in training with an outcome of
    probability base, and Z of each group of features with one history.

    At the optimum n less the expected count equals RIDGE times the weight. For a given
    Z each weight solves that alone (Newton's steps from above on a convex function);
    log Z is found by Newton's method too, in all groups side by side.
    """
    total = np.bincount(group, n, groups)
    rest = np.maximum(1 - np.bincount(group, base, groups), 0)
    z, found = np.zeros(groups), np.zeros(len(n))
    open_, at = np.ones(groups, dtype=bool), np.arange(len(n))
    for _ in range(40):
        if not len(at):
            break
        g, x = group[at], n[at]
        a = total[g] * base[at] * np.exp(-z[g])
        free = np.log(x / a)  # without the ridge; the weight is between it and 0
        w = np.where(free > 0, np.minimum(x / RIDGE, free), np.minimum(np.log((x - RIDGE * np.minimum(free, 0)) / a), 0))
        for _ in range(5):
            e = a * np.exp(w)
            w -= (e + RIDGE * w - x) / (e + RIDGE)
        e = a * np.exp(w)
        found[at] = w
        p = e / total[g]
        ratio = np.where(open_, rest * np.exp(-z) + np.bincount(g, p, groups), 1)
        slope = np.bincount(g, p * e / (e + RIDGE), groups) / ratio
        step = np.log(ratio) / np.maximum(1 - slope, 1e-9)
        z += step
        open_ &= np.abs(step) > 1e-6
        at = at[open_[g]]
    return found, rest + np.bincount(group, base * np.exp(found), groups)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct value, and the first place of each."""
    _, first, number = np.unique(values, return_index=True, return_inverse=True)
    return number, first


def log_scores(tables: Tables, grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base-10 logarithm of P(token | history) of distinct n-grams in rising order (bits:
    previous, skipped, token) with their training counts. Of words behind the head, that
    of their class, and their bucket's gain over its share of the class's words."""
    previous, skipped, word = (grams >> 2 * BITS).astype(np.int64), (grams >> BITS & MASK).astype(np.int64), (grams & MASK).astype(np.int64)
    kinds = tables.classes_after.shape[1]
    kind = tables.classes[word]
    context, _ = _numbered(tables.contexts(previous, skipped))
    contexts = int(context.max()) + 1
    pair, at = _numbered(grams >> BITS)
    of_pair, of_history = context[at], tables.previous[previous[at]] * tables.skips + tables.skipped[skipped[at]]
    in_pair = np.bincount(pair, n)

    # P(class | previous): the base is the class model's mean over the training tokens.
    after = np.exp(tables.classes_after)
    expected = np.stack([np.bincount(of_pair, in_pair * after[of_history, c], contexts) for c in range(kinds)], axis=1).reshape(-1)
    cell = context * kinds + kind
    counted = np.bincount(cell, n, contexts * kinds)
    seen = np.flatnonzero(counted)
    of = seen // kinds
    w = np.zeros(contexts * kinds)
    w[seen] = weights(counted[seen], expected[seen] / np.bincount(of_pair, in_pair, contexts)[of], of, contexts)[0]
    raised, z = np.exp(w), np.zeros(len(at))
    for c in range(kinds):
        z += after[of_history, c] * raised[of_pair * kinds + c]
    of_class = tables.classes_after[of_history[pair], kind] + w[cell] - np.log(z)[pair]

    # P(class | previous, skipped)
    wide, first = _numbered(pair * kinds + kind)
    counted = np.bincount(wide, n)
    seen = np.flatnonzero(counted)
    w = np.zeros(len(first))
    w[seen], z = weights(counted[seen], np.exp(of_class[first[seen]]), pair[first[seen]], len(at))
    of_class += w[wide] - np.log(z)[pair]

    # P(word | class, previous)
    gain = np.zeros(len(of_class))
    named = np.flatnonzero(word < len(tables.share))  # all but the end
    if not len(named):
        return of_class / np.log(10), gain
    n, word, cell, wide, context = n[named], word[named], cell[named], wide[named], context[named]
    share = tables.share[word]
    plain = np.log(np.where(share > 0, share, 1))
    of_word = plain.copy()
    item, at = _numbered(context << BITS | word)
    counted = np.bincount(item, n)
    seen = np.flatnonzero(counted)
    w = np.zeros(len(at))
    w[seen], z = weights(counted[seen], share[at[seen]], cell[at[seen]], contexts * kinds)
    of_word += w[item] - np.log(z)[cell]

    # P(word | class, previous, skipped)
    seen = np.flatnonzero(n)
    w = np.zeros(len(named))
    w[seen], z = weights(n[seen], np.exp(of_word[seen]), wide[seen], len(first))
    of_word += w - np.log(z)[wide]
    behind = tables.behind(word)
    gain[named[behind]] = (of_word - plain)[behind]
    of_class[named[~behind]] += of_word[~behind]
    return of_class / np.log(10), gain / np.log(10)


def spread(tables: Tables, parts: int, tokens_of):
    """Task: the tokens of each part, packed. tokens_of(batch) gives arrays of previous,
    skipped and token, whether it is learned from, row and place in the text."""

    def handed_on(held: list) -> pa.RecordBatch:
        part, token, row, place = map(np.concatenate, zip(*held))
        held.clear()
        order = np.argsort(part, kind="stable")
        part, token, row, place = part[order], token[order], row[order], place[order]
        unsure = tables.behind(token >> 1 & MASK) & (token & 1 == 0)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            starts = np.concatenate([[a], a + 1 + np.flatnonzero(np.diff(row[a:b]))])
            runs = np.diff(np.append(starts, b)).astype(np.int32)
            out.append((int(part[a]), packed_bytes(token[a:b].astype(np.uint64)), b - a, packed_bytes(row[starts]), runs.tobytes(), packed_bytes(place[a:b][unsure[a:b]])))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for previous, skipped, word, learned, row, place in tokens_of(batch):
                context = tables.contexts(previous, skipped).astype(np.uint64)
                part = ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
                token = previous << 2 * BITS + 1 | skipped << BITS + 1 | word << 1 | learned
                held.append((part.astype(np.uint16 if parts <= 1 << 16 else np.uint32), token, row, place))
                size += len(token)
                if size >= HELD:
                    yield handed_on(held)
                    size = 0
        if size:
            yield handed_on(held)

    return run


def _chunks(blobs: list) -> Iterator[list]:
    chunk, size = [], 0
    for blob in blobs:
        chunk.append(blob)
        size += blob[1]
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _counted(chunk: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of a chunk, their training counts, and of each token which it is
    and whether it is learned from."""
    token = np.concatenate([unpacked(t, n, np.uint64) for t, n, *_ in chunk])
    grams, number = np.unique(token >> np.uint64(1), return_inverse=True)
    learned = token & np.uint64(1) > 0
    return grams, np.bincount(number, learned), number, learned


def _part_scores(tables: Tables, blobs: list) -> Iterator[tuple]:
    """Rows and the summed scores of their tokens in a part, and rows, places and gains of
    tokens whose words may be unknown."""
    chunks = list(_chunks(blobs))
    found = [_counted(c) for c in chunks[:1]] if len(chunks) == 1 else []
    counts = found or [_counted(c)[:2] for c in chunks]
    grams, number = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
    score, gain = log_scores(tables, grams, np.bincount(number, np.concatenate([c[1] for c in counts])))
    behind = tables.behind((grams & np.uint64(MASK)).astype(np.int64))
    for chunk in chunks:
        mine, _, which, learned = found[0] if found else _counted(chunk)
        which = np.searchsorted(grams, mine)[which]
        runs = [np.frombuffer(r, np.int32) for _, _, _, r, _ in chunk]
        rows = np.concatenate([unpacked(r, len(k), np.int64) for (_, _, r, _, _), k in zip(chunk, runs)])
        runs = np.concatenate(runs)
        sums = np.add.reduceat(score[which] + gain[which] * learned, np.cumsum(runs) - runs)
        unsure = np.flatnonzero(behind[which] & ~learned)
        per_blob = np.add.reduceat((behind[which] & ~learned).astype(np.int64), np.cumsum([0] + [b[1] for b in chunk[:-1]]))
        places = np.concatenate([unpacked(p, k, np.int32) for (*_, p), k in zip(chunk, per_blob.tolist())])
        gains = gain[which[unsure]]
        some = gains != 0
        yield *_sums(rows, sums), np.repeat(rows, runs)[unsure[some]], places[some], gains[some]


def _sums(rows: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, number = np.unique(rows, return_inverse=True)
    return rows, np.bincount(number, scores)


def _scored(tables: Tables):
    """Task: the score sums of the rows over whole parts, which follow each other."""

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
        blobs, last = [], None
        for batch in batches:
            columns = [batch.column(c) for c in ("tokens", "n", "rows", "runs", "places")]
            for i, part in enumerate(batch.column("part").to_pylist()):
                if blobs and part != last:
                    yield blobs
                    blobs = []
                last = part
                blobs.append([c[i].as_py() for c in columns])
        if blobs:
            yield blobs

    def rows_of(row, **columns) -> pa.RecordBatch:
        kinds = {"place": pa.int32(), "score": pa.float64(), "gain": pa.float64()}
        arrays = [pa.array(columns[c], k) if c in columns else pa.nulls(len(row), k) for c, k in kinds.items()]
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *arrays], names=["row", *kinds])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for blobs in parts(batches):
            for rows, scores, *unsure in _part_scores(tables, blobs):
                held.append((rows, scores))
                size += len(rows)
                yield rows_of(unsure[0], place=unsure[1], gain=unsure[2])
            if size > 2 * HELD:
                held = [_sums(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > HELD:
                    yield rows_of(held[0][0], score=held[0][1])
                    held, size = [], 0
        if held:
            rows, scores = _sums(*map(np.concatenate, zip(*held)))
            yield rows_of(rows, score=scores)

    return run


def scores(coded: DataFrame, tables: Tables, tokens: int, tokens_of) -> DataFrame:
    """row, place, score, gain: without a place the sum over the tokens of a row of coded
    texts, with one the gain of the token there, if its word was seen in training."""
    tasks = min(TASKS, 1 + tokens // FEW)
    parts = max(SHARES * tasks, tokens // PART)
    packed = in_arrow(coded, spread(tables, parts, tokens_of), PACKED)
    packed = packed.repartition(tasks, "part").sortWithinPartitions("part")
    sums = in_arrow(packed, _scored(tables), SCORED)
    return sums.groupBy("row", "place").agg(F.sum("score").alias("score"), F.sum("gain").alias("gain"))
