"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits, each set if it is set in over half of the XXH64
hashes of the text's word shingles. Fingerprints that differ in at most 3 bits are
linked, and linked documents form components.

Search: the fingerprint has three segments of 22, 21 and 21 bits. Of at most 3
differing bits either some segment has none, and then one of the two others has at most
one, or each segment has exactly one. The first case gives a key for each ordered pair
of segments: the one as it is and the index of a Golay codeword near the other
(one to six of them, see `golay`). In the second case one half of each segment is equal:
eight keys of three halves. So any two fingerprints to be linked share a key, and a
key has 32 bits or more. Rows are shuffled by key, and every pair that shares one is
verified by its bit distance.

Equal fingerprints are one node from the start. A task reads its keys in order and holds
one key's fingerprints at a time. Keys of more than `MOST` fingerprints go
through a second round, where they are cut into blocks and each block and pair of blocks
is a group of its own; nothing is dropped. Large groups yield a spanning forest, not pairs.

Cases: a text without words, or a null one, has fingerprint zero and links like any
other; a text shorter than the shingle is one shingle. Rows that repeat a doc_id are
documents of their own with that id. A null doc_id counts as larger than any other and
comes back as null. A text of any length is hashed whole, a part of its shingles at a
time. Other columns are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm import golay
from basketlens.llm.common import in_arrow, key, saved, unkey, unused
from basketlens.llm.components import components
from basketlens.llm.groups import in_blocks, starts_of, whole_keys

SHINGLE = 3
SEED = 42
MAX_BITS = 3
# Fingerprints of one key that a task compares at once.
MOST = 4096
# Up to this group size links are found by comparing neighbours in whole arrays.
SMALL = 16
_BLOCK = 1 << 16

FOUND = "key long, a long, b long"


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = map(xxh64_intdigest, shingles, repeat(SEED))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        some = np.fromiter(hashes, dtype=">u8", count=min(_BLOCK, n - at))
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def text_digest() -> Column:
    """What tells the texts of rows with one id apart."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, digests: bool = False) -> DataFrame:
    """(id, fp) for each document row, saved; fp is the fingerprint as a signed long.
    With `digests` also the digest of the text."""
    digest = [text_digest().alias("digest")] if digests else []
    rows = docs.select(key("doc_id").alias("id"), *digest, F.col("text").cast("string").alias("text"))
    kept = rows.columns[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            fp = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), fp], names=[*kept, "fp"])

    schema = "id long, digest binary, fp long" if digests else "id long, fp long"
    return saved(in_arrow(rows, run, schema), "fingerprints")


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (key, fingerprint) rows of an array of signed fingerprints."""
    bits = fps.view(np.uint64)
    low = np.uint64((1 << 21) - 1)
    segments = [(bits >> np.uint64(42)), (bits >> np.uint64(21)) & low, bits & low]
    segments = [s.astype(np.int64) for s in segments]
    near = [golay.nearby(s) for s in segments]
    keys, owners = [], []
    kind = 0
    for i in range(3):
        for j in range(3):
            if i == j:
                continue
            made = (np.int64(kind) << 34) | (segments[i][:, None] << 12) | near[j]
            good = near[j] >= 0
            keys.append(made[good])
            owners.append(np.broadcast_to(fps[:, None], good.shape)[good])
            kind += 1
    half = np.int64((1 << 11) - 1)
    for choice in range(8):
        made = np.full(len(fps), kind + choice, dtype=np.int64) << 1
        for i in range(3):
            made = (made << 11) | ((segments[i] >> 11) if choice >> i & 1 else (segments[i] & half))
        keys.append(made)
        owners.append(fps)
    return np.concatenate(keys), np.concatenate(owners)


def _close(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits


def _forest(fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect one group's fingerprints as all their links would."""
    rest = np.sort(fps)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        todo, found = [root], []
        while todo and len(rest):
            near = _close(rest, todo.pop(), max_bits)
            if near.any():
                reached = rest[near]
                found.append(reached)
                todo.extend(reached)
                rest = rest[~near]
        if found:
            members = np.concatenate(found)
            yield np.full(len(members), root), members


def links_in(keys: np.ndarray, fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between the fingerprints of each key; keys are sorted."""
    first, size = starts_of(keys)[:-1], np.diff(starts_of(keys))
    a, b = [], []
    small = np.repeat((size > 1) & (size <= SMALL), size)
    k, f = keys[small], fps[small]
    for step in range(1, SMALL):
        same = k[:-step] == k[step:]
        if not same.any():
            break
        x, y = f[:-step][same], f[step:][same]
        near = _close(x, y, max_bits)
        a.append(x[near])
        b.append(y[near])
    for at, n in zip(first[size > SMALL], size[size > SMALL]):
        for x, y in _forest(fps[at : at + n], max_bits):
            a.append(x)
            b.append(y)
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _batch(keys, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, a, b)], names=["key", "a", "b"])


def _search(max_bits: int, most: int | None):
    """A task over (key, fp) rows in key order: links (key null), and the rows of keys
    with more than `most` fingerprints as they came (b null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, rows in whole_keys(batches, most):
            keys, fps = rows.column("key").to_numpy(), rows.column("fp").to_numpy()
            if whole:
                a, b = links_in(keys, fps, max_bits)
                yield _batch(pa.nulls(len(a), pa.int64()), a, b)
            else:
                yield _batch(keys, fps, pa.nulls(len(fps), pa.int64()))

    return run


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for at in range(0, len(fps), 4096):
            keys, owners = golay_keys(fps[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], names=["key", "fp"])


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints fps(fp) as all links within
    max_bits (at most 3) would."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys find distances up to 3 bits")
    keyed = in_arrow(fps, _keyed, "key long, fp long")
    found = saved(in_arrow(keyed.repartition("key").sortWithinPartitions("key"), _search(max_bits, most), FOUND), "links")
    links = found.filter("b is not null").select("a", "b")
    large = found.filter("b is null").select("key", F.col("a").alias("fp"))
    if large.isEmpty():
        return links
    grouped = in_blocks(large, most, F.col("fp")).select("key", "fp")
    again = in_arrow(grouped, _search(max_bits, None), FOUND)
    return links.unionByName(again.select("a", "b"))


def _grouped(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, id, root) of every distinct fingerprint of rows(id, fp), saved: its smallest id
    and one fingerprint that stands for its component."""
    nodes = saved(rows.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), max_bits))
    # Fingerprints without a link have no root.
    found = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    return saved(found, "grouped")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id
    reachable) of every document row."""
    rows = fingerprints(docs, shingle)
    grouped = _grouped(rows, max_bits)
    smallest = saved(grouped.groupBy("root").agg(F.min("id").alias("component")), "smallest")
    of_fp = saved(grouped.join(smallest, "root").select("fp", "component"), "components")
    return rows.join(of_fp, "fp").select(
        unkey("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        unkey("component").alias("component_id"),
    )


def without_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs less all but one row of each component: the first by doc_id, then by the digest
    of its text, then by its other columns. Rows that share an id, or have none, are told
    apart by their texts, and stay if these are no near duplicates."""
    rows = fingerprints(docs, shingle, digests=True)
    of_fp = _grouped(rows.select("id", "fp"), max_bits).select("fp", "root")
    first = rows.join(of_fp, "fp").groupBy("root").agg(F.min(F.struct("id", "digest")).alias("first"))
    keep = saved(first.select("first.id", "first.digest"), "kept")
    # Rows equal in id and text become one before texts are shuffled.
    others = F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias(unused("none", docs)))
    each = docs.groupBy(key("doc_id").alias("id"), text_digest().alias("digest")).agg(
        F.first("doc_id").alias("doc_id"), F.min(F.struct("text")).alias("text"), F.min(others).alias("others")
    )
    # A null text and an empty one have one digest; the null one is the smaller.
    source = {"doc_id": F.col("doc_id"), "text": F.col("text")["text"]}
    columns = [(source[c] if c in source else F.col("others")[c]).alias(c) for c in docs.columns]
    return each.join(keep, ["id", "digest"], "left_semi").select(*columns)
