import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from basketlens.llm import golay
from basketlens.llm.components import components
from basketlens.llm.simhash import fingerprint_links, golay_keys, links_in, near_duplicates, without_near_duplicates

SCHEMA = "doc_id long, text string, fp string, id long, component string"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(rows):
        known = least[find(i)]
        least[find(i)] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def documents():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for n in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        rows.append((n, " ".join(text)))
        for _ in range(rng.choice([0, 0, 1, 5])):
            near = list(text)
            if len(near) > 100:
                near[rng.randrange(len(near))] = "other"
            rows.append((1000 + len(rows), "\n ".join(near).upper()))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "ÄÖ\u00a0x y"), (5003, "ÄÖ\u00a0x y"), (None, rows[0][1]), (None, "alone")]
    rows.append((5004, " ".join(words) * 200))
    return rows


def test_nearby_codewords():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 2000)
    found = golay.nearby(words)
    flipped = golay.nearby(words ^ (1 << rng.integers(0, 23, 2000)))
    for a, b in zip(found, flipped):
        assert a[0] in b and b[0] in a
    assert set((found >= 0).sum(axis=1)) == {1, 6}


def test_every_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(2)
    fps = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    for bits in (1, 2, 3):
        near = fps.copy()
        for row in range(len(fps)):
            for b in rng.choice(64, bits, replace=False):
                near[row] ^= np.array(1 << int(b), dtype=np.uint64).view(np.int64)
        for x, y in zip(fps[:800], near[:800]):
            keys, owners = golay_keys(np.array([x, y]))
            assert set(keys[owners == x]) & set(keys[owners == y])


def test_against_brute_force(spark):
    rows = documents()
    frame = spark.createDataFrame([(d, t, "clash", 7, "clash") for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(frame).collect()), key=str)
    assert got == slow(rows)


def test_one_row_of_each_component_stays(spark):
    rows = documents()
    frame = spark.createDataFrame([(d, t, "clash", 7, "clash") for d, t in rows], SCHEMA)
    kept = without_near_duplicates(frame)
    assert kept.columns == frame.columns
    # Components of documents that share no id: one row each, of the smallest id.
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, ids)) == sorted(str(c) for c in component_ids(rows))


def component_ids(rows):
    """The smallest id of each component of rows, once for each component."""
    fps = [slow_fingerprint(t) for _, t in rows]
    left, out = set(range(len(rows))), []
    while left:
        todo, members = [left.pop()], []
        while todo:
            i = todo.pop()
            members.append(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= 3}
            left -= near
            todo += near
        ids = [rows[i][0] for i in members]
        out.append(min((i for i in ids if i is not None), default=None))
    return out


def test_rows_without_an_id_or_with_one_id_stay_apart(spark):
    rng = random.Random(9)
    texts = [" ".join(f"v{rng.randrange(900)}" for _ in range(60)) for _ in range(6)]
    rows = [(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3]), (7, texts[4]), (3, texts[5]), (5, texts[5] + " "), (None, texts[5])]
    frame = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, row int, __id string, id string")
    kept = without_near_duplicates(frame.repartition(3))
    assert kept.columns == frame.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(r) for r in rows[:6])


@pytest.mark.parametrize("most", [6, 40, 4096])
def test_large_keys_lose_no_link(spark, most):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 250:
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 3)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most)
    roots = {r.node: r.root for r in components(links).collect()}
    groups = defaultdict(set)
    for x in signed:
        groups[roots.get(x, x)].add(x)
    want = slow_groups(signed)
    assert sorted(map(sorted, groups.values())) == want


def slow_groups(signed):
    left, out = set(signed), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if ((x ^ y) & (2**64 - 1)).bit_count() <= 3}
            left -= near
            todo += near
        out.append(sorted(group))
    return sorted(out)


def test_links_of_small_and_large_groups():
    keys = np.repeat([1, 2], [3, 30])
    fps = np.r_[[0, 1, 255], np.arange(30) * 0].astype(np.int64)
    a, b = links_in(keys, fps)
    assert {(0, 1)} <= set(zip(a.tolist(), b.tolist()))


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(frame).count() == 0
    assert without_near_duplicates(frame).count() == 0


def test_components_of_a_star_a_chain_and_a_ring(spark):
    edges = [(0, i) for i in range(50, 90)] + [(i, i + 1) for i in range(100, 140)]
    edges += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (50, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(50, 90)} | {i: 100 for i in range(101, 141)} | {i: 200 for i in range(201, 209)}
