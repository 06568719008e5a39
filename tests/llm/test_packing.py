import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from basketlens.llm.packing import PIECE_SCHEMA, BestFit, Tokenization, cut, pack, packed, packed_ids
from basketlens.llm.queries import byte_bpe

TEXTS = [
    "plain words here", None, "", " ", "a\nb  c\t d", "x<|endoftext|>y <|endoftext|>", "é\u00a0ü \u2028z 12 it's",
    "long " * 5000, "exact" * 1, "same text", "same text", "\n\n\n", "a  b   c ", "tail\n",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, 3, "x") for n, t in enumerate(TEXTS)] + [(None, "no id", 3, "x"), (9, "same text", 3, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, row int, length string")


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe()[0]).encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_those_of_the_tokenizer():
    tokens = Tokenization(*byte_bpe())
    for text in TEXTS:
        assert np.frombuffer(tokens(text), dtype="<u4").tolist() == whole_ids(text)[:-1]


def test_pieces_and_places(docs):
    rows = packed(docs, byte_bpe()).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    for n, text in enumerate(TEXTS):
        ids = whole_ids(text)
        found = sorted(by_doc[n], key=lambda r: r.piece)
        if n == 9:
            assert len(found) == 2
            continue
        assert [(r.piece, r.start, r.length) for r in found] == [(k, s, m) for k, (s, m) in enumerate(cut(len(ids), 2048))]
        for r in found:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_sequences_hold_the_ids(docs):
    docs = docs.filter("doc_id <> 9")
    places = packed(docs, byte_bpe()).cache()
    built = {r.sequence_id: r.ids for r in packed_ids(docs, places, byte_bpe()).collect()}
    for r in places.collect():
        ids = whole_ids(TEXTS[r.doc_id])
        assert built[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]


def test_cut():
    assert cut(5, 4) == [(0, 1), (1, 4)]
    assert cut(8, 4) == [(0, 4), (4, 4)]
    assert cut(3, 4) == [(0, 3)]


@pytest.mark.parametrize("most", [1, 3, 20, 1000])
def test_best_fit_against_a_plain_version(most):
    rng = random.Random(most)
    bins, free, filled, closed = BestFit(100, most), [], {}, 0
    for _ in range(1000):
        n = rng.randint(1, 100)
        # The fullest open bin that holds the piece, else a new one.
        best = min((f for f in free if f >= n), default=None)
        if best is not None:
            free.remove(best)
        left = (100 if best is None else best) - n
        if left:
            free.append(left)
        if len(free) > most:
            free.remove(min(free))
            closed += 1
        number, offset = bins.place(n)
        assert offset == filled.get(number, 0) == (0 if best is None else 100 - best)
        filled[number] = offset + n
        assert sorted(f for f, found in bins.by_free.items() for _ in found) == sorted(free)
        assert bins.open == len(free) <= most
    assert (closed > 0) == (most < 1000)


@pytest.mark.parametrize("open_bins", [2, 16])
def test_few_open_bins_keep_every_piece(spark, open_bins):
    rng = random.Random(open_bins)
    rows = [(n, n % 7, 0, 0, rng.randint(1, 2048), n) for n in range(600)]
    found = spark.createDataFrame(rows, PIECE_SCHEMA)
    got = pack(found, open_bins=open_bins, per_task=300, portion=100).collect()
    assert sorted((r.row, r.length, r.ids_crc32) for r in got) == sorted((r[0], r[4], r[5]) for r in rows)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len({r.sequence_id >> 40 for r in got}) == 2


def test_fullest_closes_first():
    bins = BestFit(10, 2)
    for n in (6, 7, 8):  # free 4 and 3 are open when 2 comes: 2 closes
        bins.place(n)
    assert sorted(bins.by_free) == [3, 4]


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert packed(frame, byte_bpe()).count() == 0
