import random
from collections import Counter

from basketlens.llm.mixing import mix, mixed_documents


def shares(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % len(weights)] for n, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(sizes)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit >= 3 * sizes[s]}
        if not full:
            return target | {s: weight[s] * unit for s in free}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def rows():
    rng = random.Random(8)
    out = []
    for n in range(900):
        source = rng.choice(["hot"] * 6 + ["a", "b", "c", "é", None])
        out.append((n, None if n % 97 == 0 else "\tw \n" * rng.randint(0, 60), source, "clash", 1))
    out += [(None, "x y z", "a", "clash", 1), (9007, "same", "hot", "clash", 1), (9007, "same", "hot", "clash", 1), (8000, "w " * 9000, "hot", "clash", 1)]
    return out


SCHEMA = "doc_id long, text string, source string, size string, copies int"


def test_sources_come_near_their_targets(spark):
    data = rows()
    frame = spark.createDataFrame(data, SCHEMA)
    got = mix(frame).collect()
    assert len(got) == len(data)
    source_of = {}
    for d, _, s, *_ in data:
        source_of[d] = s
    sizes, taken, targets = {}, {}, {}
    for r in got:
        s = "a" if r.doc_id is None else source_of[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        targets[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    want = shares(sizes)
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 * max(1, want[s])
        largest = 9000 if s == "hot" else 60
        assert abs(taken[s] - targets[s]) <= largest + 1
    assert sum(taken.values()) <= sum(sizes.values())


def test_reruns_agree_in_any_layout(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    one = sorted(map(str, mix(frame).collect()))
    two = sorted(map(str, mix(frame.repartition(5)).collect()))
    assert one == two


def test_documents_repeat_as_often_as_taken(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    out = mixed_documents(frame)
    assert out.columns == frame.columns
    got = sorted(str((r.doc_id, r.text, r.source)) for r in out.collect())
    copies = Counter()
    for r in mix(frame).collect():
        copies[r.doc_id, r.size] += r.copies
    want = []
    for d, t, s, *_ in {row for row in rows()}:
        want += [str((d, t, s))] * copies[d, len((t or "").split())]
    assert got == sorted(want)


def test_equal_and_missing_ids_are_documents_of_their_own(spark):
    for doc_id in (None, 7):
        data = [(doc_id, f"{s}{n} " + "w " * 9, s) for s in "abc" for n in range(1000)]
        got = mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
        taken = Counter()
        for r in got:
            taken[r.skey] += r.taken
        assert {s: abs(taken[f"a{s}"] - t) <= 10 for s, t in zip("abc", (18750, 7500, 3750))} == dict.fromkeys("abc", True)


def test_equal_documents_are_taken_in_part(spark):
    data = [(None, "w " * 10, s, n % 3, "x") for s in "abc" for n in range(9000)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string, row int, copies string").repartition(6)
    taken = Counter()
    for r in mix(frame).collect():
        taken[r.skey] += r.taken
        assert r.taken <= 30
    assert all(abs(taken[f"a{s}"] - t) <= 10 for s, t in zip("abc", (168750, 67500, 33750)))
    out = mixed_documents(frame)
    assert out.columns == frame.columns
    assert Counter("a" + r.source for r in out.collect()) == Counter({s: n // 10 for s, n in taken.items()})


def test_one_source_and_empty(spark):
    one = spark.createDataFrame([(1, "a b", "x"), (2, "c", "x")], "doc_id long, text string, source string")
    assert [(r.doc_id, r.target, r.taken) for r in mix(one).orderBy("doc_id").collect()] == [(1, 3.0, 2), (2, 3.0, 1)]
    none = spark.createDataFrame([(1, "", None), (2, None, "x")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mix(none).collect()] == [(0.0, 0), (0.0, 0)]
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0
