"""Packing token sequences by bounded-space online best-fit.

A document is its token ids and one end id. A longer one than the capacity is
cut into full pieces, the first of which may be shorter. Every task packs its own
stream of pieces: a piece goes to the open bin with the least free space that still
holds it. The open bins are found through a bitset with one bit for each amount of
free space that some open bin has, so a step costs the same however many are open.
At most `open_bins` are open at once; beyond that the fullest closes first.

Pieces stream in portions that a digest deals out, so that each has lengths of every kind;
within a portion the longest come first. Bins that a portion leaves open go on to the next.
A portion holds more pieces than bins may be open, so the bound is reached: on 66,866
pieces 2048 open bins take 33,812 sequences, 33,806 being the least possible. Ids are
cut and measured once and saved; only piece descriptions are shuffled, never ids.
`packed_ids` builds the sequences themselves.

Cases: a null or empty text is a document of the end id alone. Repeated rows and null
ids are packed like any others. Other columns are ignored. Empty input gives an
empty result.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import in_arrow, saved, ship

CAPACITY = 2048
OPEN_BINS = 2048
# Pieces that are put in order of length before they are packed.
PORTION = 4096
# Pieces for each packing task; the tasks grow in number with the input.
PIECES = 65536
END_ID = 0

PIECE_SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


class Tokenization:
    """Token ids of whole texts as little-endian uint32 bytes.

    `ranks` and `pattern` give the same vocabulary to a faster encoder, which has no
    special tokens; a text that may hold one goes to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(word): int(n) for word, n in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain and "<|" not in text:
            return array("I", self.plain(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def tokenization(path: str, ranks: str | None = None, pattern: str | None = None) -> Tokenization:
    """One for each Python worker, which keeps it over its tasks."""
    return Tokenization(path, ranks, pattern)


def with_end(ids: bytes, end_id: int) -> bytes:
    return ids + int(end_id).to_bytes(4, "little")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: tuple, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document row; `row` numbers the input rows.

    tokenizer: the arguments of `Tokenization`.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenization(*tokenizer)
        for batch in batches:
            out = []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                ids = with_end(tokens(text), end_id)
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((row, doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return saved(in_arrow(rows, run, PIECE_SCHEMA), "pieces")


class BestFit:
    """Bounded-space best-fit over lengths up to the capacity."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free_bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.free_bits &= ~(1 << free)
        self.open -= 1
        return found

    def _put(self, number: int, free: int) -> None:
        if not free:
            return  # full: closed
        if self.open == self.most:
            # The fullest closes; it may be the one at hand.
            fullest = (self.free_bits & -self.free_bits).bit_length() - 1
            if free <= fullest:
                return
            self._take(fullest)
        self.by_free.setdefault(free, []).append(number)
        self.free_bits |= 1 << free
        self.open += 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of the next piece."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        self._put(number, free - length)
        return number, self.capacity - free


def pack(
    found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_task: int = PIECES, portion: int = PORTION
) -> DataFrame:
    """Add sequence_id and offset to saved pieces."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        bins = BestFit(capacity, open_bins)
        for frame in frames:
            places = [bins.place(n) for n in frame["length"].tolist()]
            yield frame.assign(
                sequence_id=np.array([base + b for b, _ in places], dtype=np.int64),
                offset=np.array([at for _, at in places], dtype=np.int64),
            )

    ship(found.sparkSession)
    n = found.count()
    tasks = max(1, -(-n // per_task))
    turn = F.pmod(F.xxhash64("row", "piece"), F.lit(max(1, -(-n // (tasks * portion)))))
    dealt = found.repartition(tasks).sortWithinPartitions(turn, F.desc("length"), "row", "piece")
    return dealt.mapInPandas(run, PLACE_SCHEMA)


def packed(docs: DataFrame, tokenizer: tuple, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity).drop("row")


def packed_ids(docs: DataFrame, places: DataFrame, tokenizer: tuple, end_id: int = END_ID) -> DataFrame:
    """The sequences: sequence_id, ids (array of int). `places` is a saved result of
    `packed` over docs with unique ids; a sequence holds at most one capacity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenization(*tokenizer)
        for batch in batches:
            out = []
            for parts, text in zip(batch.column("parts").to_pylist(), batch.column("text").to_pylist()):
                ids = np.frombuffer(with_end(tokens(text), end_id), dtype="<u4").astype(np.int32)
                out += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]].tolist()) for p in parts]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["sequence_id", "offset", "ids"])

    parts = places.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("parts"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(parts, "doc_id").select("text", "parts")
    cut_up = in_arrow(texts, run, "sequence_id long, offset long, ids array<int>")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return cut_up.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
