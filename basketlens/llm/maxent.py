"""Language-model scores from a hashed maximum-entropy model.

A token's probability is factored through its class: P(class | history) times
P(token | class, history). The classes are clusters of word endings (by the words that stand
before them) times three bands of frequency; the end of a text is a class of its own.

Both factors are softmaxes over features of the history: the previous token (n-gram), the
token before it (skip) and both. A class model comes first, over few values of them: the most
frequent words, the classes of all others, and a hash of the pair. Then `ngrams` trains weights
for every previous token and every pair of tokens in training, with the classes and with
the words as outcomes. Words behind the head are features by hash buckets (ending and
`TAILS`); as an outcome such a word has its share of its bucket's training tokens. Unknown words
of a class together have the share that words seen once have.

Training counts every token of every training text: word counts, contexts of endings,
counts of classes by history, and n-grams. The class model's gradient needs its history
counts alone; each step's gradient is computed in distributed tasks over them and added
up. The n-grams' weights are found in the task that holds all tokens of a previous
token. Texts are split into words twice, for the counts and for their codes,
which are saved. The most frequent `HEAD` words and the class model go to the tasks, their
size being fixed; all other words are joined to their exact counts.

Texts are lower-cased in A-Z; tokens are runs of anything but ASCII white space, then one
end token. Scores are base-10 logarithms, whole texts are scored in numpy batches.

Cases: a null or empty text is the end token alone. Rows with a null id are neither
held out nor learned from. Repeated rows count and are scored one by one. Without
training rows the counts are zero, every token is unknown and score equals base_score.
Other columns are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm import ngrams
from basketlens.llm.common import in_arrow, rest_of_crc32, saved

FOLDS, HELD_OUT = 7, 2
HEAD = 131_072  # words that scoring tasks hold, at most
FREQUENT = 256  # first band of frequency; the second is the rest of the head
ENDINGS = 4096  # hash buckets of the last three bytes of a word
TAILS = 32  # hash buckets of the words behind the head with such an ending
BEFORE = 32  # words told apart before an ending, the rest being one
CLUSTERS = 10
BANDS = 3
CLASSES = CLUSTERS * BANDS + 1  # the last is the end of a text
PREVIOUS, SKIPPED = 256, 64  # values of the two history features
HASHED = 4096  # weights of the hashed pair of them
STEPS = 25
RIDGE = 1.0
# Counter entries that a counting task holds before it hands them on, and bytes of text
# that a task splits into words at a time.
HELD = 500_000
PORTION = 1_000_000
END = "\n"  # no word holds a line break
NEVER = 1 << 20  # a step that no count reaches


def _step():
    """Sixteenths of powers of two of the count n: a few hundred values at any size."""
    return F.floor(F.log2("n") * 16).cast("int")


def tokens(text: bytes | None) -> list[bytes]:
    """Words without the end token."""
    return text.lower().split() if text else []


def _ending(word: bytes) -> int:
    return crc32(word[-3:]) % ENDINGS


def _bucket(word: bytes) -> int:
    return _ending(word) * TAILS + (crc32(word) >> 12) % TAILS


def _bucket_in_spark():
    word = F.encode("word", "UTF-8")
    ending = F.pmod(F.crc32(F.expr("substring(encode(word, 'UTF-8'), -3)")), F.lit(ENDINGS))
    return ending * TAILS + F.pmod(F.shiftright(F.crc32(word), 12), F.lit(TAILS))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in portions of about PORTION bytes of text, so that the words of one
    portion are all that a task holds at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        portion = np.cumsum(sizes, dtype=np.int64) // PORTION
        cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), batch.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            yield batch.slice(at, end - at)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed_on(count: Counter) -> pa.RecordBatch:
        words = pa.array(count.keys(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(count.values(), pa.int64())], names=["word", "n"])

    count: Counter = Counter()
    for batch in batches:
        for text in _texts(batch):
            count.update(tokens(text))
            if len(count) > HELD:
                yield handed_on(count)
                count.clear()
        count[END.encode()] += batch.num_rows
    if count:
        yield handed_on(count)


class _Codes(dict):
    """Word to code: its rank in the head, or HEAD-size plus its hash bucket."""

    def __init__(self, head: list[bytes]):
        super().__init__(zip(head, range(len(head))))
        self.size = len(head)

    def __missing__(self, word: bytes) -> int:
        return self.size + _bucket(word)


def _framed(codes: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of texts in a row with two ends before each, and the places of the
    tokens to predict in it: all but these."""
    at = np.arange(len(codes)) + 2 * (1 + np.repeat(np.arange(len(lengths)), lengths))
    flat = np.full(len(codes) + 2 * len(lengths), end, dtype=np.int64)
    flat[at] = codes
    return flat, at


def _coded(batches: Iterable[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each portion of coded texts: codes as by _framed, places of the tokens, and for each
    token whether it is learned from and the row of its text."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("codes", "size", "rows", "lengths", "learned")]
        for codes, size, rows, lengths, learned in zip(*columns):
            lengths = np.frombuffer(lengths, np.int64)
            flat, at = _framed(ngrams.unpacked(codes, size, np.int32), lengths, end)
            yield flat, at, np.repeat(np.frombuffer(learned, bool), lengths), np.repeat(np.frombuffer(rows, np.int64), lengths)


def _summed(cells: DataFrame, name: str) -> DataFrame:
    # A fixed number of cells: a few files hold them.
    return saved(cells.groupBy("cell").agg(F.sum("n").alias("n")).coalesce(8), name)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])


def _endings_of(model: Model):
    """Task: how often each of the first words stands before each ending."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ending = model.endings()
        rank = np.minimum(np.arange(model.end + 1), BEFORE - 2)
        rank[len(model.head) :], rank[model.end] = BEFORE - 2, BEFORE - 1
        total = np.zeros(ENDINGS * BEFORE, dtype=np.int64)
        for flat, at, learned, _ in _coded(batches, model.end):
            at = at[learned & (flat[at] != model.end)]  # the end has no ending
            total += np.bincount(ending[flat[at]] * BEFORE + rank[flat[at - 1]], minlength=len(total))
        yield _cells(total)

    return run


def _clusters(counts: np.ndarray) -> np.ndarray:
    """Cluster of each ending from its counts by the word before (k-means over square
    roots of the shares, weighted by the counts)."""
    weight = counts.sum(axis=1)
    used = np.flatnonzero(weight)
    found = np.zeros(len(counts), dtype=np.int64)
    if not len(used):
        return found
    x, w = np.sqrt((counts[used] + 0.01) / (weight[used, None] + 0.01 * counts.shape[1])), weight[used].astype(float)
    centres = x[[int(np.argmax(w))]]
    while len(centres) < min(CLUSTERS, len(used)):  # farthest first, by weighted distance
        far = w**0.5 * ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, x[int(np.argmax(far))]])
    for _ in range(25):
        near = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(len(centres)):
            mine = near == c
            if mine.any():
                centres[c] = np.average(x[mine], axis=0, weights=w[mine])
    found[used] = near
    return found


@dataclass
class Model:
    head: list[bytes]
    counts: np.ndarray  # of the head words
    total: int  # training tokens N
    distinct: int  # V
    texts: int  # training texts, each with an end
    cluster: np.ndarray  # of each ending
    least: int = 0  # step of the counts from which words are in the head
    in_class: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # tokens by class
    once: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # tokens seen once by class
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def codes(self) -> _Codes:
        return _Codes(self.head)

    @property
    def end(self) -> int:
        return len(self.head) + ENDINGS * TAILS

    def endings(self) -> np.ndarray:
        """Ending of each code but the last: head words, other words by hash bucket."""
        head = np.array([_ending(w) for w in self.head], dtype=np.int64)
        return np.concatenate([head, np.arange(ENDINGS * TAILS) // TAILS])

    def classes(self) -> np.ndarray:
        """Class of each code: head words, hash buckets, the end."""
        band = np.full(self.end, 2)
        band[: len(self.head)] = np.arange(len(self.head)) >= FREQUENT
        return np.append(self.cluster[self.endings()] + CLUSTERS * band, CLASSES - 1)

    def history(self) -> tuple[np.ndarray, np.ndarray]:
        """The features of each code as previous and as skipped token."""
        out = []
        for size in (PREVIOUS, SKIPPED):
            named = size - CLASSES
            values = named + self.classes()
            values[: min(named, len(self.head))] = np.arange(min(named, len(self.head)))
            out.append(values)
        return out[0], out[1]

    def unseen(self) -> np.ndarray:
        """What unknown tokens weigh in each class against its training tokens."""
        return np.where(np.arange(CLASSES) == CLASSES - 1, 0.0, self.once + 1.0)


def _pair(previous: np.ndarray, skipped: np.ndarray) -> np.ndarray:
    """Hash bucket of a history."""
    return ((previous * SKIPPED + skipped) * 2654435761 % (1 << 32)) % HASHED


def log_softmax(weights: dict[str, np.ndarray], history: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of the classes for each history number."""
    previous, skipped = history // SKIPPED, history % SKIPPED
    z = weights["bias"] + weights["previous"][previous] + weights["skipped"][skipped] + weights["pair"][_pair(previous, skipped)]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _histories_of(model: Model):
    """Task: counts of each class after each history."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, (previous, skipped) = model.classes(), model.history()
        total = np.zeros(PREVIOUS * SKIPPED * CLASSES, dtype=np.int64)
        for flat, at, learned, _ in _coded(batches, model.end):
            at = at[learned]
            history = previous[flat[at - 1]] * SKIPPED + skipped[flat[at - 2]]
            total += np.bincount(history * CLASSES + classes[flat[at]], minlength=len(total))
        yield _cells(total)

    return run


def _gradient(weights: dict[str, np.ndarray]):
    """Task: the gradient of the log-likelihood over its histories, as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = {name: np.zeros_like(w) for name, w in weights.items()}
        for batch in batches:
            history = batch.column("history").to_numpy()
            # Rows of one history follow each other: classes side by side.
            distinct, row = np.unique(history, return_inverse=True)
            q = np.zeros((len(distinct), CLASSES))
            np.add.at(q, (row, batch.column("class").to_numpy()), batch.column("n").to_numpy())
            error = q - q.sum(axis=1, keepdims=True) * np.exp(log_softmax(weights, distinct))
            previous, skipped = distinct // SKIPPED, distinct % SKIPPED
            g["bias"] += error.sum(axis=0)
            np.add.at(g["previous"], previous, error)
            np.add.at(g["skipped"], skipped, error)
            np.add.at(g["pair"], _pair(previous, skipped), error)
        for name, values in g.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([values.tobytes()], pa.binary())], names=["name", "g"])

    return run


def _trained(histories: DataFrame) -> dict[str, np.ndarray]:
    """Weights by distributed full-batch gradient steps over the history counts."""
    names = {"bias": 1, "previous": PREVIOUS, "skipped": SKIPPED, "pair": HASHED}
    weights = {n: np.zeros((size, CLASSES)) for n, size in names.items()}
    cells = saved(
        histories.select(
            F.floor(F.col("cell") / CLASSES).cast("long").alias("history"),
            F.pmod("cell", F.lit(CLASSES)).cast("long").alias("class"),
            "n",
        ).repartition(8, "history"),
        "histories",
    )
    # Tokens that have each feature: a step's length is bounded by them.
    seen = {n: np.zeros((size, 1)) for n, size in names.items()}
    by_class = np.ones(CLASSES)
    # At most PREVIOUS * SKIPPED and CLASSES rows.
    for r in cells.groupBy("history").agg(F.sum("n").alias("n")).collect():
        previous, skipped = np.array(r.history // SKIPPED), np.array(r.history % SKIPPED)
        for name, at in (("bias", 0), ("previous", previous), ("skipped", skipped), ("pair", _pair(previous, skipped))):
            seen[name][at] += r.n
    for r in cells.groupBy("class").agg(F.sum("n").alias("n")).collect():
        by_class[r["class"]] += r.n
    weights["bias"][:] = np.log(by_class / by_class.sum())
    for _ in range(STEPS):
        total = {n: np.zeros_like(w) for n, w in weights.items()}
        for r in in_arrow(cells, _gradient(weights), "name string, g binary").collect():  # one model per task
            total[r.name] += np.frombuffer(r.g).reshape(total[r.name].shape)
        # The softmax curves by at most p(1-p) <= 1/4 for each of four features: steps of
        # one over the tokens of a feature never overshoot.
        for n in weights:
            weights[n] = weights[n] + (total[n] - RIDGE * weights[n]) / (seen[n] + RIDGE)
    return weights


def _start(counts: DataFrame) -> Model:
    """The head of the saved word counts(word, n)."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    words = counts.filter(F.col("word") != END)
    # The head: all words from a count on, at most HEAD. Words seen once stay behind it
    # at any size: with them the last band learns how often rare and unknown words come.
    least, room = NEVER, HEAD
    steps = words.filter("n > 1").groupBy(_step().alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()  # some hundred rows
    for r in sorted(steps, key=lambda r: -r.step):
        if r.n > room:
            break
        least, room = r.step, room - r.n
    top = words.filter((F.col("n") > 1) & (_step() >= least)).collect()
    top.sort(key=lambda r: (-r.n, r.word))
    head = [r.word.encode() for r in top]
    counted = np.array([r.n for r in top], dtype=np.int64)
    texts = counts.filter(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Model(head, counted, total, distinct, texts, np.zeros(ENDINGS, dtype=np.int64), least)


def _behind(counts: DataFrame, model: Model) -> DataFrame:
    """The counts of the words behind the head."""
    return counts.filter(((F.col("n") == 1) | (_step() < model.least)) & (F.col("word") != END))


def _learn(model: Model, coded: DataFrame, counts: DataFrame) -> Model:
    """The class model, learned from coded texts."""
    endings = np.zeros(ENDINGS * BEFORE, dtype=np.int64)
    for r in _summed(in_arrow(coded, _endings_of(model), "cell long, n long"), "endings").collect():  # at most ENDINGS * BEFORE
        endings[r.cell] = r.n
    model.cluster = _clusters(endings.reshape(ENDINGS, BEFORE))
    histories = _summed(in_arrow(coded, _histories_of(model), "cell long, n long"), "history-cells")
    for r in histories.groupBy(F.pmod("cell", F.lit(CLASSES)).alias("class")).agg(F.sum("n").alias("n")).collect():
        model.in_class[r["class"]] = r.n
    # Words seen once, by ending: at most ENDINGS rows.
    ending = F.floor(_bucket_in_spark() / TAILS).cast("int")
    for r in counts.filter((F.col("n") == 1) & (F.col("word") != END)).groupBy(ending.alias("ending")).agg(F.count(F.lit(1)).alias("n")).collect():
        model.once[2 * CLUSTERS + model.cluster[r.ending]] += r.n
    model.weights = _trained(histories)
    return model


def _tables(model: Model, counts: DataFrame) -> ngrams.Tables:
    size = len(model.head)
    behind = np.zeros(ENDINGS * TAILS, dtype=np.int64)
    by_bucket = _behind(counts, model).groupBy(_bucket_in_spark().alias("bucket")).agg(F.sum("n").alias("n")).toArrow()  # at most ENDINGS * TAILS rows
    behind[by_bucket["bucket"].to_numpy()] = by_bucket["n"].to_numpy()
    classes, (previous, skipped) = model.classes(), model.history()
    tokens_of_class = model.in_class + np.where(np.arange(CLASSES) < 2 * CLUSTERS, model.unseen(), 0)
    return ngrams.Tables(
        log_softmax(model.weights, np.arange(PREVIOUS * SKIPPED)),
        SKIPPED,
        classes.astype(np.int8),
        previous.astype(np.int32),
        skipped.astype(np.int32),
        (1 + np.concatenate([model.counts, behind, [model.texts]]) // ngrams.LARGE).astype(np.int32),
        np.concatenate([model.counts, behind]) / np.maximum(tokens_of_class, 1)[classes[:-1]],
        size,
    )


def _tokens_of(end: int):
    def run(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for flat, at, learned, row in _coded([batch], end):
            start = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of each text
            lengths = np.diff(np.append(start, len(at)))
            place = np.arange(len(at)) - np.repeat(start, lengths)
            yield flat[at - 1], flat[at - 2], flat[at], learned, row, place.astype(np.int32)

    return run


def fit(train: DataFrame, counts: DataFrame) -> Model:
    """The class model of train(text) whose word counts(word, n) are saved."""
    model = _start(counts)
    if not model.total:
        return model
    none = F.lit(None).cast("long")
    rows = train.select(F.monotonically_increasing_id().alias("row"), none.alias("doc_id"), F.lit(False).alias("held_out"), F.lit(True).alias("learned"), "text")
    return _learn(model, _texts_coded(rows, model).filter("codes is not null"), counts)


KINDS = {
    "row": pa.int64(),
    "doc_id": pa.int64(),
    "held_out": pa.bool_(),
    "n_tokens": pa.int64(),
    "n_known": pa.int64(),
    "base": pa.float64(),
    "word": pa.string(),
    "times": pa.int64(),
    "code": pa.int32(),
    "place": pa.int32(),
    "codes": pa.binary(),
    "size": pa.int64(),
    "rows": pa.binary(),
    "lengths": pa.binary(),
    "learned": pa.binary(),
}
CODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, word string, times long, code int, place int, codes binary, size long, rows binary, lengths binary, learned binary"


def _rows_of(n: int, **columns) -> pa.RecordBatch:
    """n rows of CODED, null but for the columns."""
    arrays = [pa.nulls(n, kind) for kind in KINDS.values()]
    for i, (c, kind) in enumerate(KINDS.items()):
        if c in columns:
            arrays[i] = columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind)
    return pa.RecordBatch.from_arrays(arrays, names=list(KINDS))


def _coder(model: Model):
    """Task: a row for each text with the sums over its end and head words, a row for
    each other word of a text (each place of it, if the text isn't learned from), and a
    row for each portion with all its codes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, size, end = model.codes(), len(model.head), model.end
        codes[END.encode()] = end
        counts = np.concatenate([model.counts, np.zeros(ENDINGS * TAILS, dtype=np.int64), [model.texts]])
        base = np.log10(counts + 1) - np.log10(model.total + model.distinct + 1)
        base[size:end] = 0  # joined later
        known = (counts > 0).astype(np.int64)
        for batch in _portions(batches):
            n = batch.num_rows
            if not n:
                continue
            words = [tokens(t) for t in _texts(batch)]
            for w in words:
                w.append(END.encode())
            lengths = np.array([len(w) for w in words])
            first = np.cumsum(lengths) - lengths
            flat = list(chain.from_iterable(words))
            code = np.fromiter(map(codes.__getitem__, flat), dtype=np.int64, count=len(flat))
            rows = batch.column("row").to_numpy()
            yield _rows_of(
                n,
                **{c: batch.column(c) for c in ("row", "doc_id", "held_out")},
                n_tokens=lengths,
                n_known=np.add.reduceat(known[code], first),
                base=np.add.reduceat(base[code], first),
            )
            packed = ngrams.packed_bytes(code.astype(np.int32))
            learned = np.array(batch.column("learned").to_pylist(), dtype=bool)
            yield _rows_of(1, codes=[packed], size=[len(code)], rows=[rows.tobytes()], lengths=[lengths.tobytes()], learned=[learned.tobytes()])
            rest = np.flatnonzero((code >= size) & (code < end))
            if len(rest):
                named = pa.array([flat[i] for i in rest.tolist()], pa.binary()).dictionary_encode()
                of_text = np.repeat(np.arange(n), lengths)[rest]
                place = np.where(learned[of_text], -1, rest - first[of_text])
                number = named.indices.to_numpy().astype(np.int64)
                one = (of_text * len(named.dictionary) + number) * (lengths.max() + 1) + place + 1
                _, at, times = np.unique(one, return_index=True, return_counts=True)
                word = named.dictionary.cast(pa.string()).take(pa.array(number[at]))
                places = pa.array(place[at], pa.int32(), mask=place[at] < 0)
                yield _rows_of(len(at), row=rows[of_text[at]], word=word, times=times, code=code[rest[at]].astype(np.int32), place=places)

    return run


def _texts_coded(rows: DataFrame, model: Model) -> DataFrame:
    return saved(in_arrow(rows, _coder(model), CODED), "coded")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each
    row of docs(doc_id, text)."""
    fold = rest_of_crc32("doc_id", FOLDS)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        F.coalesce(fold != HELD_OUT, F.lit(False)).alias("learned"),
        F.col("text").cast("string").alias("text"),
    )
    train = docs.filter(fold != HELD_OUT).select(F.col("text").cast("string").alias("text"))
    counted = in_arrow(train, _counted, "word string, n long")
    counts = saved(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    model = _start(counts)
    found = _texts_coded(rows, model)
    texts = found.filter("n_tokens is not null").select("row", "doc_id", "held_out", "n_tokens", "n_known", "base")
    others = found.filter("word is not null").select("row", "place", "word", "times", "code").join(_behind(counts, model), "word", "left")
    n = F.coalesce("n", F.lit(0))
    base = F.log10(n + 1) - F.lit(float(np.log10(model.total + model.distinct + 1)))
    if model.total:
        coded = found.filter("codes is not null").select("codes", "size", "rows", "lengths", "learned")
        _learn(model, coded, counts)
        tokens_in_all = texts.agg(F.sum("n_tokens")).first()[0]
        sums = saved(ngrams.scores(coded, _tables(model, counts), tokens_in_all, _tokens_of(model.end)), "token-scores")
        weight, unseen = model.in_class + model.unseen(), model.unseen()
        kind = F.element_at(F.array(*map(F.lit, (2 * CLUSTERS + model.cluster).tolist())), F.floor((F.col("code") - len(model.head)) / TAILS).cast("int") + 1)
        of_class = F.element_at(F.array(*(F.lit(float(x)) for x in weight)), kind + 1)
        of_unseen = F.element_at(F.array(*(F.lit(float(x)) for x in unseen)), kind + 1)
        share = F.log10(F.when(n > 0, n).otherwise(of_unseen) / of_class)
    else:
        sums, share = texts.select("row", F.col("base").alias("score")), base
    others = others.select(
        "row",
        "place",
        F.when(n > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.col("times") * base).alias("base"),
        (F.col("times") * share).alias("score"),
    )
    whole = texts.unionByName(others, allowMissingColumns=True).unionByName(sums, allowMissingColumns=True)
    if "gain" in whole.columns:  # counts where the word is known
        ids = [F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")]
        whole = whole.groupBy("row", "place").agg(*ids, *(F.sum(c).alias(c) for c in ("n_known", "base", "score", "gain")))
        whole = whole.withColumn("score", F.coalesce("score", F.lit(0.0)) + F.when(F.col("n_known") > 0, F.coalesce("gain", F.lit(0.0))).otherwise(0.0))
    return (
        whole.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum("n_known").cast("long").alias("n_known"),
            F.lit(int(model.total)).cast("long").alias("train_tokens"),
            F.sum("base").alias("base_score"),
            F.sum("score").alias("score"),
        )
        .drop("row")
    )
