import random
import re
from zlib import crc32

import pytest

from basketlens.llm.spelling import neighbours, variants

SCHEMA = "doc_id long, text string, word string, n string, node string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    same = 0
    while same < len(short) and short[same] == long[same]:
        same += 1
    return short[same + (len(a) == len(b)) :] == long[same + 1 :]


def slow(docs, every=31, least=7, min_count=2, dominance=10):
    counts = {}
    for doc_id, text in docs:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            digest = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if digest % every == 0:
                at = digest % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] = counts.get(run, 0) + 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= min_count}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= dominance * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(rows)


def documents():
    rng = random.Random(13)
    stems = ["".join(rng.choice("abcèÿ") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    stems += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "straße", "naïveté×÷"]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rng.randint(0, 40)):
            word = list(stems[min(int(rng.expovariate(0.15)), len(stems) - 1)])
            if rng.random() < 0.1:
                word[rng.randrange(len(word))] = rng.choice("abcè")
            if rng.random() < 0.05:
                word.insert(rng.randrange(len(word) + 1), rng.choice("abc"))
            text.append("".join(word).title() if rng.random() < 0.2 else "".join(word))
        rows.append((i, rng.choice([" ", ", ", "\n", "-7_"]).join(text)))
    rows += [(None, "aaaaaaa bbbbbbb"), (None, "aaaaaaa bbbbbbb"), (7, None), (8, ""), (3, "Ωmega aaaaaaa ÀÉÎÕÜŸÀÉÎÕÜÀ"), (3, rows[5][1])]
    long = "".join(rng.choice("abc") for _ in range(3000))
    rows += [(900, f"{long} {long}x {long[:-1]} {long[1:]} {long[:1500]}b{long[1500:]}"), (901, f"{long} {long}x {long[:-1]} {long[1:]} {long[:1500]}b{long[1500:]}")]
    return rows


@pytest.mark.parametrize("options", [{}, {"every": 3}, {"least": 2, "min_count": 1, "dominance": 3}])
def test_against_brute_force(spark, options):
    rows = documents()
    frame = spark.createDataFrame([(d, t, "clash", "clash", "clash") for d, t in rows], SCHEMA)
    got = sorted(tuple(r) for r in variants(frame, **options).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == slow(rows, **options)


@pytest.mark.parametrize("depth", [3, 5, 9])
def test_words_longer_than_the_tries(spark, depth):
    rng = random.Random(depth)
    words = set()
    for _ in range(40):
        word = [rng.choice("ab") for _ in range(rng.randint(1, 14))]
        words.add("".join(word))
        for _ in range(4):
            other = list(word)
            at = rng.randrange(len(other))
            rng.choice([lambda: other.pop(at), lambda: other.insert(at, rng.choice("abc")), lambda: other.__setitem__(at, "c")])()
            words.add("".join(other) or "a")
    found = neighbours(spark.createDataFrame([(w,) for w in words], "word string"), depth)
    got = sorted((r.word, r.near) for r in found.collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_empty_input(spark):
    assert variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert variants(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect() == []
