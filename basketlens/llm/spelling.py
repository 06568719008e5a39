"""Spelling variants by a frontier that walks a trie kept as a table.

Words are counted from the texts' letter runs. All words that occur often enough make two
tries, one of the words and one of the words read backwards, kept as one table of edges
(node, letter, child); a node is the 64-bit hash of its direction and prefix. The frontier
is a table of states (word, position, node, edits). A state without an edit, joined with
the edges of its node, may take an edge with another letter (a replaced one) or pass over a
letter of its own (a deleted one); a state with one edit has to match and is joined
again, level by level. States that have used up their word on a node that ends a word
are neighbours.

A word's own path is in the trie, so states without an edit need no join to get where
they are: they all start at once, and every round moves those with an edit down one level.
Every edge has 64 bits for the rests of words below it (as in a Bloom filter), which ends
most states at their first step. One edit lies in the first or in the second half
of a word: the trie of words finds edits in the second half, the backward trie those in the
first, so no state branches near the root, where nodes have many words below them. An
inserted letter is a deleted one seen from the longer word, and of two words that differ
in one letter the one with the smaller letter looks for the other.

Tries end at `DEPTH` letters, whatever the longest word. What is left of longer
words is an edge of its own: states with one edit need an equal rest, and words that agree so
far are compared where half of their rest is equal, as one edit leaves one half alone. All
pairs are verified by their edit distance, so hashes can't make or lose one.

Cases: a null or empty text has no words; a null id counts as the empty text in
the digest that decides on deletions. Rows that repeat an id are counted each. A word of any
length is a word. Ties in n go to the smaller word in code-point order. Other columns are
ignored. Empty input gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import in_arrow, saved

LETTERS = "a-zÀ-ÿ"  # of texts whose A-Z are lower-cased
DELETE_EVERY = 31
MIN_LETTERS = 7
MIN_COUNT = 2
DOMINANCE = 10
DEPTH = 40
# Distinct words that a task counts before it hands them on.
_HELD = 200_000


def words_of(doc_id: str, text: bytes, every: int = DELETE_EVERY, least: int = MIN_LETTERS) -> Counter:
    """Occurrences of each word of at least `least` letters in one UTF-8 text."""
    runs = Counter(re.findall(f"[{LETTERS}]{{{least},}}", text.lower().decode("utf-8", "replace")))
    start = crc32(f"{doc_id}:".encode())
    found = Counter()
    for run, n in runs.items():
        digest = crc32(run.encode(), start)
        if digest % every == 0:
            at = digest % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        found[run] += n
    return found


def vocabulary(docs: DataFrame, every: int = DELETE_EVERY, least: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of all words with at least min_count occurrences, saved."""

    def batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for rows in batches:
            for doc_id, text in zip(rows.column("id").to_pylist(), rows.column("text").cast(pa.binary())):
                held.update(words_of(doc_id or "", text.as_py() or b"", every, least))
                if len(held) > _HELD:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    counted = in_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return saved(counted.filter(F.col("n") >= min_count), "vocabulary")


def _node(s: Column, depth: Column) -> Column:
    return F.xxhash64("back", F.substr(s, F.lit(1), depth))


def _letter(s: Column, at: Column) -> Column:
    """The letter at a position from 0."""
    return F.substr(s, at + 1, F.lit(1))


def _bit(rest: Column) -> Column:
    """One of 64 bits for the rest of a word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(rest), F.lit(64)).cast("int"))


def _paths(words: DataFrame) -> DataFrame:
    """(back, s, size, first): every word in both reading directions, with the first
    position at which that direction looks for an edit."""
    half = F.floor(F.col("size") / 2).cast("int")
    return (
        words.select("word", F.length("word").alias("size"))
        .withColumn("back", F.explode(F.array(F.lit(0), F.lit(1))))
        .select(
            "back",
            F.when(F.col("back") == 0, F.col("word")).otherwise(F.reverse("word")).alias("s"),
            "size",
            F.when(F.col("back") == 0, half).otherwise(F.col("size") - half).alias("first"),
        )
    )


def _unedited(paths: DataFrame, depth: int) -> DataFrame:
    """The states without an edit that may take one: each word at each node of its path."""
    levels = F.sequence(F.col("first"), F.least(F.col("size"), F.lit(depth)) - 1)
    at = F.col("position")
    return (
        paths.filter(F.col("first") < F.least(F.col("size"), F.lit(depth)))
        .withColumn("position", F.explode(levels))
        .withColumn("node", _node(F.col("s"), at))
    )


def edges(paths: DataFrame, depth: int) -> DataFrame:
    """(node, letter, child, below) of both tries, from the first level with an edit on;
    `below` has the bits of what words below the child have left there."""
    s, at = F.col("s"), F.col("position")
    every = _unedited(paths, depth).select(
        "node", _letter(s, at).alias("taken"), _node(s, at + 1).alias("child"), _bit(F.substr(s, at + 2)).alias("bit")
    )
    return every.groupBy("node", "taken", "child").agg(F.bit_or("bit").alias("below"))


def _edited(paths: DataFrame, trie: DataFrame, depth: int) -> DataFrame:
    """(back, s, size, position, node) after the one edit: on an edge with another letter,
    or past a letter on the edge of the one behind it. Of equal letters in a row only
    the last is passed over, as the others give the same word."""
    s, at, none = F.col("s"), F.col("position"), F.lit(0).cast("long")
    asking = _unedited(paths, depth).withColumns(
        {
            "own": _letter(s, at),
            "after": _letter(s, at + 1),
            "kept": _bit(F.substr(s, at + 2)),
            "moved": _bit(F.substr(s, at + 3)),
        }
    )
    replaced = (F.col("taken") > F.col("own")) & (F.col("below").bitwiseAND(F.col("kept")) != none)
    deleted = (F.col("own") != F.col("after")) & (F.col("taken") == F.col("after"))
    deleted &= F.col("below").bitwiseAND(F.col("moved")) != none
    now = F.array_compact(F.array(F.when(replaced, at + 1), F.when(deleted, at + 2)))
    return (
        asking.join(trie, "node")
        .filter(replaced | deleted)
        .select("back", "s", "size", F.explode(now).alias("position"), F.col("child").alias("node"))
    )


def _matched(frontier: DataFrame, trie: DataFrame) -> DataFrame:
    """States with their edit behind them, one level on."""
    s, at = F.col("s"), F.col("position")
    asking = frontier.withColumns({"taken": _letter(s, at), "left": _bit(F.substr(s, at + 2))})
    return (
        asking.join(trie, ["node", "taken"])
        .filter(F.col("below").bitwiseAND(F.col("left")) != 0)
        .select("back", "s", "size", (at + 1).cast("int").alias("position"), F.col("child").alias("node"))
    )


def _walked(paths: DataFrame, trie: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(back, s, node) of states that used up their word within the tries' depth, and
    (back, s, position, node) of those that reached it with letters left."""
    frontier = saved(_edited(paths, trie, depth), "frontier")
    every = frontier
    for _ in range(depth):
        live = frontier.filter("position < size")
        if live.isEmpty():
            break
        frontier = saved(_matched(live, trie), "frontier")
        every = every.unionByName(frontier)
    through = every.filter("position >= size").select("back", "s", "node")
    # A state after a deletion is one position ahead of its level.
    deep = every.filter((F.col("size") > depth) & F.col("position").isin(depth, depth + 1) & (F.col("position") < F.col("size")))
    return through, deep.select("back", "s", "position", "node")


def _long_pairs(paths: DataFrame, deep: DataFrame, depth: int) -> DataFrame:
    """Pairs (a, b) of words in reading direction that meet beyond the tries' depth."""
    s = F.col("s")
    rest = F.substr(s, F.lit(depth + 1))
    long = paths.filter(F.col("size") >= depth).select(
        "back", "s", "size", _node(s, F.lit(depth)).alias("node"), rest.alias("rest"), (F.col("size") - depth).alias("left")
    )
    # One edit lies before: the rests are equal.
    ends = long.select("back", "node", F.xxhash64("rest").alias("rest"), F.col("s").alias("b"))
    after = F.xxhash64(F.substr(s, F.col("position") + 1))
    met = deep.select("back", "node", after.alias("rest"), F.col("s").alias("a")).join(ends, ["back", "node", "rest"])
    # No edit so far: half of the shorter rest is equal, in front or behind.
    shorter = F.when(F.col("longer"), F.col("left") - 1).otherwise(F.col("left"))
    head = (F.col("shorter") / 2).cast("int")
    keyed = (
        long.withColumn("longer", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn("shorter", shorter)
        .filter("shorter >= 0")
        .withColumn("behind", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn(
            "half",
            F.when(~F.col("behind"), F.substr("rest", F.lit(1), head)).otherwise(
                F.substr("rest", F.col("left") - F.col("shorter") + head + 1)
            ),
        )
        .select("back", "node", "shorter", "behind", F.xxhash64("half").alias("half"), "longer", "s")
    )
    keys = ["back", "node", "shorter", "behind", "half"]
    one = keyed.filter("not longer").withColumnRenamed("s", "b").drop("longer")
    two = keyed.withColumnRenamed("s", "a")
    both = two.join(one, keys).filter(F.col("longer") | (F.col("a") < F.col("b")))
    return met.select("back", "a", "b").unionByName(both.select("back", "a", "b"))


def neighbours(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(word, near) for all pairs of words(word) one edit apart, both ways."""
    paths = saved(_paths(words), "paths")
    longest = paths.agg(F.max("size")).first()[0] or 0
    trie = saved(edges(paths, depth).repartition("node"), "edges")
    through, deep = _walked(paths, trie, depth)
    s, size = F.col("s"), F.col("size")
    short = paths.filter(size <= depth)
    ends = short.select("back", _node(s, size).alias("node"), s.alias("b"))
    # A word less its last letter ends on a node of its own path.
    cut = paths.filter(size - 1 <= depth).select("back", _node(s, size - 1).alias("node"), s.alias("a"))
    ended = cut.unionByName(through.withColumnRenamed("s", "a"))
    pairs = ended.join(ends, ["back", "node"]).select("back", "a", "b")
    if longest > depth:
        pairs = pairs.unionByName(_long_pairs(paths, deep, depth))
    good = pairs.filter((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    read = [F.when(F.col("back") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("a", "b")]
    found = good.select(*read).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = saved(found, "near-words")
    return found.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        found.select(F.col("b").alias("word"), F.col("a").alias("near"))
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last form reached. n grows tenfold or
    more with each form, so doubling the steps ends after a few rounds."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(further, "root", "left")
        step = saved(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def variants(
    docs: DataFrame,
    every: int = DELETE_EVERY,
    least: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    dominance: int = DOMINANCE,
    depth: int = DEPTH,
) -> DataFrame:
    """word, form (its near word of largest n, if that is `dominance` times the word's),
    root (the last form reached from the word), n, n_near and form_n."""
    words = vocabulary(docs, every, least, min_count)
    near = neighbours(words, depth)
    counted = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    known = words.join(best, "word", "left")
    large = -F.col("best.minus") >= dominance * F.col("n")
    known = known.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.near")).alias("form"),
        F.when(large, -F.col("best.minus")).cast("long").alias("form_n"),
    )
    known = saved(known, "forms")
    roots = _roots(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
