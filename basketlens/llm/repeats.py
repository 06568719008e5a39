"""Repeated passages by fixed-block anchors.

A passage is a window of `window` consecutive words that another document starts too. The
reference side of the index is every document cut into non-overlapping blocks, half as
long as a window, so that each window holds a whole block wherever it begins. Probes are the
rolling windows of a block's length at every word. Both are hashes of their words; a hash
that is some document's block and occurs in two documents is an anchor, and its places are
hits.

Hits are then extended word by word: every window that holds a hit is compared, by two
independent hashes (128 bits), with the windows of all other documents that hold one. A
window is a repeat if the smallest doc_id that starts it is smaller than its own. Runs of
such windows are the maximal exact repeats, and the words they cover are removed.

Hashes travel in packed arrays: a task gathers documents into a chunk of about `CHUNK`
words, sorts its hashes and deals them out by hash to buckets of bounded size. What a
chunk can settle itself it does (a hash in two of its documents is a hit; a window with a
smaller doc_id in the chunk is a repeat), so of a passage in very many documents each chunk
sends one place, and no task reads more of one hash than there are chunks. No pairs are formed.

Rows are known by doc_id and MD5 of their text, which are the same whenever they are read.
Texts are shuffled compressed, and only texts with hits are kept on disk in between.

Cases: a null text has no words. A null id counts as larger than any other and comes
back as null. Rows that repeat a doc_id are one document: none of them removes words of
another, and each gets a row. Texts of any length are handled whole; a chunk is as
large as its longest text. Ties cannot arise, as doc_ids decide. Other columns are
ignored. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import in_arrow, key, saved, unkey

WINDOW = 50
# Words of a chunk, and text bytes whose hashes go to one bucket.
CHUNK = 1 << 19
BUCKET_BYTES = 8 << 20

KEYS = "id long, digest binary"
PACKED = "key long, chunk long, bucket int, hashes binary, checks binary, places binary, starts binary, ids binary, digests binary"
SPANS = "array<struct<start: int, end: int>>"
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # fixed values: odd multipliers of the two hashes
_MASK = (1 << 64) - 1


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 1 << 20:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, odd: int):
        self.odd, self.up, self.down = odd, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            both = []
            for base in (self.odd, pow(self.odd, -1, 1 << 64)):
                steps = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            self.up, self.down = both
        return self.up[:n], self.down[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(values: np.ndarray, length: int, powers: _Powers) -> np.ndarray:
    """A hash of every `length` consecutive values (from each place on; those that run
    over the end are left out)."""
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=total[1:])
    return _mixed((total[length:] - total[:-length]) * down[:n])


def packed(values: np.ndarray) -> bytes:
    """Integers of four or eight bytes by byte planes, which compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpacked(data: bytes, dtype=np.uint32) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(data, dtype=np.uint8).reshape(size, len(data) // size)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


class _Chunk:
    """Documents of one task, gathered up to a number of words."""

    def __init__(self, number: int):
        self.number, self.ids, self.digests, self.values, self.hits, self.n = number, [], [], [], [], 0

    def add(self, doc_id: int, digest: bytes, values: np.ndarray, hits: np.ndarray | None = None) -> None:
        self.ids.append(doc_id)
        self.digests.append(digest)
        self.values.append(values)
        self.hits.append(hits)
        self.n += len(values)

    def laid_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word hashes of all documents in a row, each document's start, each
        word's document and its place in it."""
        sizes = np.array([len(v) for v in self.values])
        starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        return np.concatenate(self.values), starts, of, np.arange(self.n) - starts[of]


def _chunks(batches: Iterable[pa.RecordBatch], window: int, most: int) -> Iterator[_Chunk]:
    words, number = _Words(), TaskContext.get().partitionId() << 32
    chunk = _Chunk(number)
    for batch in batches:
        hits = batch.column("hits") if "hits" in batch.schema.names else None
        texts = _texts(batch)
        for row, (doc_id, digest) in enumerate(zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist())):
            found = next(texts).split()  # of bytes: ASCII white space only
            if len(found) < window:
                continue
            values = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
            chunk.add(doc_id, digest, values, np.cumsum(unpacked(hits[row].as_py())) if hits is not None else None)
            if chunk.n >= most:
                yield chunk
                number += 1
                chunk = _Chunk(number)
    if chunk.n:
        yield chunk


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    if "text" in batch.schema.names:
        yield from (t.as_py() for t in batch.column("text").cast(pa.binary()))
    else:
        from zstandard import ZstdDecompressor

        zstd = ZstdDecompressor()
        yield from (zstd.decompress(t.as_py()) for t in batch.column("squeezed"))


def _rows(columns: dict, schema: list[str], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[c]) for c in schema], names=schema)


_NAMES = ["key", "chunk", "bucket", "hashes", "checks", "places", "starts", "ids", "digests"]
_TYPES = {n: pa.binary() for n in _NAMES} | {"key": pa.int64(), "chunk": pa.int64(), "bucket": pa.int32()}


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(dict(zip(_NAMES, zip(*rows))), _NAMES, _TYPES)


def _directory(chunk: _Chunk, starts: np.ndarray, settled: np.ndarray) -> tuple:
    """A chunk's documents, and the places that it has settled."""
    ids = np.array(chunk.ids, dtype=np.int64)
    places = np.sort(settled).astype(np.uint32)
    return (chunk.number, chunk.number, -1, b"", b"", packed(_steps(places)), packed(starts.astype(np.uint32)), packed(ids), b"".join(chunk.digests))


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers of hashes; sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _cuts(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, begin, end) of each run."""
    at = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]]) if len(numbers) else []
    yield from zip((int(numbers[i]) for i in at), at, np.r_[at[1:], len(numbers)] if len(at) else [])


def _probes(window: int, buckets: int, most: int) -> Callable:
    """Tasks that send the hash of every rolling window of a block's length, with the top
    bit of its place set where a block begins."""
    block = (window + 1) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers(_ODD[0])
        for chunk in _chunks(batches, window, most):
            values, starts, of, place = chunk.laid_out()
            hashes = rolling(values, block, powers)
            at = np.flatnonzero(of[: len(hashes)] == of[block - 1 :])
            at = at[np.argsort(hashes[at], kind="stable")]
            hashes = hashes[at]
            # Hashes in two or more documents of the chunk are settled here, and go out once.
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            sizes = np.diff(np.r_[first, len(hashes)])
            low = np.minimum.reduceat(of[at], first)
            shared = low != np.maximum.reduceat(of[at], first)
            aligned = place[at] % block == 0
            any_aligned = np.logical_or.reduceat(aligned, first)
            inside = np.repeat(shared, sizes)
            yield _sent([_directory(chunk, starts, at[inside])])
            out = ~inside
            out[first] = True
            flags = np.where(inside, np.repeat(any_aligned, sizes), aligned)
            sent = at[out].astype(np.uint32) | (flags[out].astype(np.uint32) << np.uint32(31))
            some, many = hashes[out], inside[out]
            rows = []
            for bucket, a, b in _cuts(_buckets(some, buckets)):
                short = some[a:b].astype(np.uint32)
                order = np.argsort(short, kind="stable")
                rows.append((bucket, chunk.number, bucket, packed(_steps(short[order])), np.packbits(many[a:b][order]).tobytes(), packed(sent[a:b][order]), None, None, None))
            yield _sent(rows)

    return run


def _bucketed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key of rows in key order; a directory is a group of its own."""
    held, now = [], None
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if row["bucket"] < 0:
                yield -1, [row]
                continue
            if held and row["key"] != now:
                yield now, held
                held = []
            now = row["key"]
            held.append(row)
    if held:
        yield now, held


def _gathered(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all rows, and the number of each one's row."""
    places = [unpacked(r["places"]) for r in rows]
    return np.concatenate(places), np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for p in places])


def _answers(rows: list[dict], places: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """Places found, back to their chunks."""
    out = []
    for number, a, b in _cuts(of):
        found = np.sort(places[a:b])
        out.append((rows[number]["chunk"], rows[number]["chunk"], 0, None, None, packed(_steps(found)), None, None, None))
    return _sent(out)


def _anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits: places whose hash is some document's block and occurs in two documents."""
    top = np.uint32(1 << 31)
    for bucket, rows in _bucketed(batches):
        if bucket < 0:
            yield _sent([tuple(rows[0][n] for n in _NAMES)])
            continue
        places, of = _gathered(rows)
        hashes = np.concatenate([np.cumsum(unpacked(r["hashes"]), dtype=np.uint32) for r in rows])
        many = np.concatenate(
            [np.unpackbits(np.frombuffer(r["checks"], np.uint8), count=len(r["places"]) // 4).astype(bool) for r in rows]
        )
        order = np.argsort(hashes, kind="stable")
        hashes, places, of, many = hashes[order], places[order], of[order], many[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
        anchor = np.bitwise_or.reduceat(places, first) >= top
        anchor &= np.logical_or.reduceat(many, first) | (of[first] != of[np.r_[first[1:], len(of)] - 1])
        good = np.repeat(anchor, np.diff(np.r_[first, len(of)])) & ~many
        back = np.flatnonzero(good)
        back = back[np.argsort(of[back], kind="stable")]
        if len(back):
            yield _answers(rows, places[back] & ~top, of[back])


def _of_documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in chunks to places in documents: id, digest, places (packed, sorted)."""

    def settled(directory: dict | None, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        places = np.unique(np.concatenate(parts)) if parts else []
        if directory is None or not len(places):
            return
        starts, ids = unpacked(directory["starts"]), unpacked(directory["ids"], np.int64)
        of = np.searchsorted(starts, places, side="right") - 1
        columns = {"id": [], "digest": [], "hits": []}
        for number, a, b in _cuts(of):
            columns["id"].append(int(ids[number]))
            columns["digest"].append(directory["digests"][16 * number : 16 * number + 16])
            columns["hits"].append(packed(_steps((places[a:b] - starts[number]).astype(np.uint32))))
        yield _rows(columns, ["id", "digest", "hits"], {"id": pa.int64(), "digest": pa.binary(), "hits": pa.binary()})

    directory, parts, now = None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            if row["chunk"] != now:
                yield from settled(directory, parts)
                directory, parts, now = None, [], row["chunk"]
            if row["bucket"] < 0:
                directory = row
            parts.append(np.cumsum(unpacked(row["places"]), dtype=np.uint32))
    yield from settled(directory, parts)


def _windows(window: int, buckets: int, most: int) -> Callable:
    """Tasks that extend the hits: they send both hashes of every window that holds one."""
    block = (window + 1) // 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [_Powers(odd) for odd in _ODD]
        for chunk in _chunks(batches, window, most):
            values, starts, of, _ = chunk.laid_out()
            hit = np.zeros(chunk.n + 1, dtype=np.int64)
            for start, hits in zip(starts, chunk.hits):
                hit[start + hits.astype(np.int64) + 1] = 1
            so_far = np.cumsum(hit)
            hashes = rolling(values, window, powers[0])
            # A window holds a hit if one begins in its first window - block + 1 places.
            held = so_far[window - block + 1 :][: len(hashes)] > so_far[: len(hashes)]
            at = np.flatnonzero(held & (of[: len(hashes)] == of[window - 1 :]))
            hashes, checks = hashes[at], rolling(values, window, powers[1])[at]
            order = np.lexsort((checks, hashes))
            at, hashes, checks = at[order], hashes[order], checks[order]
            ids = np.array(chunk.ids, dtype=np.int64)
            mine = ids[of[at]]
            # Windows that a smaller doc_id of the chunk has too are settled here.
            first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])]) if len(at) else np.empty(0, int)
            least = np.minimum.reduceat(mine, first) if len(at) else mine
            inside = mine > np.repeat(least, np.diff(np.r_[first, len(at)]))
            directory = _directory(chunk, starts, at[inside])
            yield _sent([directory])
            at, hashes, checks = at[~inside], hashes[~inside], checks[~inside]
            rows = []
            for bucket, a, b in _cuts(_buckets(hashes, buckets)):
                rows.append((bucket, chunk.number, bucket, packed(_steps(hashes[a:b])), packed(checks[a:b]), packed(at[a:b].astype(np.uint32)), directory[6], directory[7], None))
            if rows:
                yield _sent(rows)

    return run


def _repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of windows that a smaller doc_id starts."""
    for bucket, rows in _bucketed(batches):
        if bucket < 0:
            yield _sent([tuple(rows[0][n] for n in _NAMES)])
            continue
        places, of = _gathered(rows)
        hashes = np.concatenate([np.cumsum(unpacked(r["hashes"], np.uint64), dtype=np.uint64) for r in rows])
        checks = np.concatenate([unpacked(r["checks"], np.uint64) for r in rows])
        mine = np.concatenate(
            [
                unpacked(r["ids"], np.int64)[np.searchsorted(unpacked(r["starts"]), unpacked(r["places"]), side="right") - 1]
                for r in rows
            ]
        )
        order = np.lexsort((checks, hashes))
        first = np.flatnonzero(
            np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (checks[order][1:] != checks[order][:-1])]
        )
        least = np.minimum.reduceat(mine[order], first)
        good = np.empty(len(order), dtype=bool)
        good[order] = mine[order] > np.repeat(least, np.diff(np.r_[first, len(order)]))
        back = np.flatnonzero(good)
        if len(back):
            yield _answers(rows, places[back], of[back])


def _asked(rows: DataFrame, send: Callable, answer: Callable) -> DataFrame:
    """(id, digest, hits): hashes to their buckets, answers back to their documents."""
    sent = in_arrow(rows, send, PACKED).repartition("key").sortWithinPartitions("key")
    back = in_arrow(sent, answer, PACKED).select("chunk", "bucket", "places", "starts", "ids", "digests")
    back = back.repartition("chunk").sortWithinPartitions("chunk")
    found = in_arrow(back, _of_documents, f"{KEYS}, hits binary")
    # Equal rows have equal places.
    return found.groupBy("id", "digest").agg(F.first("hits").alias("hits"))


def _squeezed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zstandard import ZstdCompressor

    zstd = ZstdCompressor(level=3)
    for batch in batches:
        data = pa.array([zstd.compress(t) for t in _texts(batch)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), data], names=["id", "digest", "squeezed"])


def _kept(window: int) -> Callable:
    """Tasks that take the covered words out of each text."""
    schema = ["id", "n_words", "spans", "text"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = dict(zip(schema, [pa.int64(), pa.int64(), span, pa.string()]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: [] for c in schema}
            for doc_id, places, text in zip(batch.column("id").to_pylist(), batch.column("hits").to_pylist(), _texts(batch)):
                words, spans = text.split(), []
                if places:
                    at = np.cumsum(unpacked(places), dtype=np.int64)
                    new = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + window])
                    spans = list(zip(at[new].tolist(), (at[np.r_[new[1:], len(at)] - 1] + window).tolist()))
                end, left = 0, []
                for a, b in spans:
                    left += words[end:a]
                    end = b
                left += words[end:]
                columns["id"].append(doc_id)
                columns["n_words"].append(len(words))
                columns["spans"].append([{"start": a, "end": b} for a, b in spans])
                columns["text"].append(b" ".join(left).decode())
            yield _rows(columns, schema, types)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, spans (of the words removed: start and end, from
    0, ends excluded) and text (the words kept, joined by one space)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(key("doc_id").alias("id"), text.alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-n_bytes // bucket_bytes))
    hits = _asked(rows, _probes(window, buckets, chunk), _anchors)
    squeezed = in_arrow(rows, _squeezed, f"{KEYS}, squeezed binary")
    suspects = saved(squeezed.join(hits, ["id", "digest"]), "suspects")
    repeats = saved(_asked(suspects, _windows(window, buckets, chunk), _repeats), "repeats")
    both = squeezed.join(repeats, ["id", "digest"], "left").select("id", "squeezed", "hits")
    kept = in_arrow(both, _kept(window), f"id long, n_words long, spans {SPANS}, text string")
    return kept.select(unkey("id").alias("doc_id"), "n_words", "spans", "text")
