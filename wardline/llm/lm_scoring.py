"""Masked pseudo-likelihood by a small bidirectional window network, trained in numpy on the whole corpus.

1. Words of all documents are counted. The VOCABULARY most frequent get numbers; others share OTHER numbers by
   their last two bytes. Words are grouped in CLASSES: the most frequent have one each, the rest are dealt out by
   hash, and words outside the vocabulary form the last.
2. The network reads the numbers of SIDE words on both sides of a masked word and predicts its class; within a
   class a word has the probability of its count in the corpus. It starts with the classes' own frequencies.
3. Texts are turned into numbers once and staged. Training masks every word of every document once: a hash of its
   text deals each document to one of ROUNDS rounds, later ones larger. In a round all tasks sum the gradients of
   their words for the same parameters, the sums are added up by part of the parameters, and the driver takes one step
   (Adam). So the parameters don't depend on how documents lie in files and tasks, but for rounding.
4. Scoring masks every word in turn; a document's score is the sum of the log-probabilities of its words. Counts of
   words outside the vocabulary, which grow with the corpus, are joined by 64-bit hash after the network has scored;
   words seen once have the logarithm 0 and need no partner. Logarithms are added in fixed point, in any order alike.

Only the vocabulary, the parameters and their gradients, whose sizes are fixed, come to the driver. Long texts pass
through the network STEP words at a time.

Defined results: null and blank texts have 0 words, log_prob 0 and a null mean; repeated rows score alike; null
doc_id is passed through; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.llm import words
from wardline.llm.common import stage, text_batches

VOCABULARY, OTHER, CLASSES, OWN = 8192, 64, 64, 48
SIDE, WIDTH, HIDDEN, SEED = 2, 16, 32, 5
#: Rounds of training, how much larger the last is than the first, the rate, and Adam's memories of gradients and squares.
ROUNDS, GROWTH, RATE, MEMORY = 32, 10.0, 0.1, (0.8, 0.95)
#: Words that pass through the network at once; values in one part of the parameters; gradient tasks for each core.
STEP, CHUNK, TASKS_PER_CORE = 4096, 16_384, 2
PAD = VOCABULARY + OTHER
#: Outputs up to this have exponentials that float32 can hold and add up.
SAFE = 60.0
SHAPES = {"e": (PAD + 1, WIDTH), "w1": (2 * SIDE * WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, CLASSES), "b2": (CLASSES,)}
#: Words that a worker keeps the number of.
CACHE_WORDS = 400_000
#: Spark's seed of xxhash64; unit of the logarithms that are added in fixed point.
HASH_SEED, UNIT = 42, 2.0**-32


def own_words(text: bytes | None) -> list[bytes]:
    return words.split(text.lower() if text else text)


@dataclass
class Vocabulary:
    """Numbers, classes and log-probabilities within a class of the frequent words; the last class has all others,
    whose `within` lacks the logarithm of their own count."""

    known: dict[bytes, int]
    class_of: np.ndarray  # of each number
    within: np.ndarray
    rates: np.ndarray  # log-probability of each class

    @classmethod
    def build(cls, frequent: list[tuple[bytes, int]], total: int) -> Vocabulary:
        """frequent: (word, count) by falling count; total: words of the corpus."""
        spread = CLASSES - 1 - OWN
        classes = [i if i < OWN else OWN + zlib.crc32(w) % spread for i, (w, _) in enumerate(frequent)]
        class_of = np.full(PAD + 1, CLASSES - 1, np.int64)
        class_of[: len(classes)] = classes
        counts = np.array([n for _, n in frequent], float)
        sums = np.bincount(np.array(classes, np.int64), counts, CLASSES) if len(classes) else np.zeros(CLASSES)
        rest = max(1, total - int(counts.sum()))
        within = np.full(PAD + 1, -np.log(rest))
        within[: len(classes)] = np.log(counts / sums[classes]) if len(classes) else []
        sums[CLASSES - 1] = rest
        sums += 0.5
        return cls({w: i for i, (w, _) in enumerate(frequent)}, class_of, within, np.log(sums / sums.sum()))


class Numbers(dict):
    """Number of each word; others by their last two bytes."""

    def __init__(self, known: dict[bytes, int]) -> None:
        super().__init__(known)
        self.fixed = known

    def __missing__(self, word: bytes) -> int:
        value = VOCABULARY + zlib.crc32(word[-2:]) % OTHER
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update(self.fixed)
        self[word] = value
        return value

    def of_words(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint16, len(found))


def rare(found: list[bytes], ids: np.ndarray) -> np.ndarray:
    """Hashes of the words outside the vocabulary, as Spark's xxhash64 gives them."""
    at = np.flatnonzero(ids >= VOCABULARY).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(found[i], HASH_SEED) for i in at), np.uint64, len(at)).view(np.int64)


def start(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters that predict each class by its frequency, whatever the neighbours."""
    rng = np.random.default_rng(SEED)
    scale = {"e": 0.3, "w1": 0.15, "w2": 0.01, "b1": 0.0}
    p = {k: (rng.standard_normal(SHAPES[k]) * v).astype(np.float32) for k, v in scale.items()}
    return p | {"b2": vocabulary.rates.astype(np.float32)}


def around(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of at most STEP words of a text: the numbers of each word's neighbours, PAD beyond the ends, and the words'."""
    padded = np.pad(ids, SIDE, constant_values=PAD)
    for lo in range(0, len(ids), STEP):
        own = ids[lo : lo + STEP]
        yield np.stack([padded[lo + i : lo + i + len(own)] for i in range(2 * SIDE + 1) if i != SIDE], axis=1), own


def together(texts: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of several texts, joined to some STEP words."""
    near, own, waiting = [], [], 0
    for ids in texts:
        for x, y in around(ids):
            near.append(x), own.append(y)
            waiting += len(y)
            if waiting >= STEP:
                yield np.concatenate(near), np.concatenate(own)
                near, own, waiting = [], [], 0
    if waiting:
        yield np.concatenate(near), np.concatenate(own)


def forward(p: dict[str, np.ndarray], near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden values, and of each class the output, its exponential, and the sum of those."""
    x = p["e"].take(near.ravel(), axis=0).reshape(len(near), -1)
    hidden = x @ p["w1"]
    hidden += p["b1"]
    # tanh, as 1 - 2 / (exp(2h) + 1) takes half the time; beyond 20 it is 1 or -1 to the last bit
    hidden *= 2.0
    np.exp(np.clip(hidden, -40.0, 40.0, out=hidden), out=hidden)
    hidden += 1.0
    np.subtract(1.0, np.divide(2.0, hidden, out=hidden), out=hidden)
    out = hidden @ p["w2"]
    out += p["b2"]
    if np.abs(p["w2"]).sum(axis=0).max() + np.abs(p["b2"]).max() > SAFE:  # hidden values lie within -1 and 1
        out -= out.max(axis=1, keepdims=True)
    exps = np.exp(out)
    return x, hidden, out, exps, exps @ np.ones(CLASSES, exps.dtype)


def add_gradient(p: dict[str, np.ndarray], near: np.ndarray, target: np.ndarray, total: dict[str, np.ndarray]) -> None:
    """Adds the gradient of the cross-entropy of these words to total, where embeddings are transposed."""
    x, hidden, _, d, sums = forward(p, near)
    d /= sums[:, None]
    d[np.arange(len(target)), target] -= 1.0
    ones = np.ones(len(target), d.dtype)
    total["w2"] += hidden.T @ d
    total["b2"] += ones @ d
    back = d @ p["w2"].T
    hidden *= hidden
    back *= np.subtract(1.0, hidden, out=hidden)
    total["w1"] += x.T @ back
    total["b1"] += ones @ back
    # columns of the embeddings' gradients, one after the other, so that each is read in one go
    by_column = p["w1"].reshape(2 * SIDE, WIDTH, HIDDEN).transpose(1, 0, 2).reshape(-1, HIDDEN)
    columns, rows = (by_column @ back.T).astype(float).reshape(WIDTH, -1), near.T.ravel().astype(np.intp)
    for j in range(WIDTH):
        total["e"][j] += np.bincount(rows, columns[j], PAD + 1)


class Adam:
    """Steps along mean gradients, scaled by their running squares; the rate falls in the second half."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p, self.steps = p, 0
        self.mean, self.square = ({k: np.zeros(s) for k, s in SHAPES.items()} for _ in range(2))

    def step(self, gradient: dict[str, np.ndarray], left: float) -> None:
        """left: the share of the rounds that is still ahead."""
        self.steps += 1
        a, b = MEMORY
        for k, g in gradient.items():
            self.mean[k] = a * self.mean[k] + (1 - a) * g
            self.square[k] = b * self.square[k] + (1 - b) * g * g
            step = self.mean[k] / (1 - a**self.steps) / (np.sqrt(self.square[k] / (1 - b**self.steps)) + 1e-7)
            self.p[k] = (self.p[k] - RATE * min(1.0, 2 * left) * step).astype(np.float32)


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float64)


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k], at = values[at : at + n].reshape(s), at + n
    return out


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for text in words.texts(batch.column(0)):
            held.update(own_words(text))
        if len(held) > 300_000:
            yield flush()
    if held:
        yield flush()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n of all words, staged."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_counts, "word binary, n long")
    return stage(counted.groupBy("word").agg(F.sum("n").alias("n")), "word_counts")


def build_vocabulary(docs: DataFrame, text_col: str = "text", every: DataFrame | None = None) -> Vocabulary:
    """every: the result of `count_words`, if there is one."""
    every = count_words(docs, text_col) if every is None else every
    frequent = every.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()  # a fixed number of words
    return Vocabulary.build([(bytes(r.word), r.n) for r in frequent], every.agg(F.sum("n")).first()[0] or 0)


def round_ends() -> np.ndarray:
    """Where each round's share of the hashes ends, out of 1."""
    sizes = 1.0 + (GROWTH - 1.0) * np.linspace(0.0, 1.0, ROUNDS) ** 2
    return np.cumsum(sizes) / sizes.sum()


NUMBERED = "row long, doc_id long, n_words long, round int, ids binary, rare array<long>"


def numbered(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged: row number, doc_id, words, round, numbers of the words, and hashes of those outside the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    ends = round_ends()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, row = Numbers(shared.value.known), TaskContext.get().partitionId() << 40
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = words.texts(batch.column(1))
            found = [own_words(t) for t in texts]
            ids = [numbers.of_words(f) for f in found]
            outside = [rare(f, d) for f, d in zip(found, ids, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in outside])), pa.int32()), pa.array(np.concatenate(outside)))
            place = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts], np.uint64).astype(float) / 2.0**64
            rounds = np.minimum(np.searchsorted(ends, place, side="right"), ROUNDS - 1).astype(np.int32)
            rows = pa.array(np.arange(row, row + len(ids)))
            row += len(ids)
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), pa.array([len(d) for d in ids], pa.int64()), pa.array(rounds), pa.array([d.tobytes() for d in ids], pa.binary()), lists], ["row", "doc_id", "n_words", "round", "ids", "rare"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # sorted by round and in small pages, so that a round reads its own pages only
    return stage(base.mapInArrow(run, NUMBERED).sortWithinPartitions("round"), "numbered", **{"parquet.page.size": 1 << 16})


PARTS = "chunk int, part binary"


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, part) sorted by chunk -> sums; holds one sum at a time."""
    now, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "part"])
    for batch in batches:
        for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if chunk != now:
                if now is not None:
                    yield row()
                now, total = chunk, 0.0
            total = total + np.frombuffer(part)
    if now is not None:
        yield row()


def gradient(rows: DataFrame, p: dict[str, np.ndarray], vocabulary: Vocabulary) -> np.ndarray | None:
    """The number of words in staged rows (ids) and the sum of their gradients, flat; None without words."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast((p, vocabulary.class_of))

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, class_of = shared.value
        total, n = {k: np.zeros(s[::-1] if k == "e" else s) for k, s in SHAPES.items()}, 0
        texts = (np.frombuffer(x, np.uint16) for batch in batches for x in batch.column(0).to_pylist())
        for near, own in together(texts):
            add_gradient(p, near, class_of[own], total)
            n += len(own)
        if n:
            values = np.append(float(n), flat(total | {"e": total["e"].T}))
            parts = [values[i : i + CHUNK].tobytes() for i in range(0, len(values), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "part"])

    sums = rows.coalesce(TASKS_PER_CORE * context.defaultParallelism).mapInArrow(local, PARTS)
    parts = sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_summed, PARTS).collect()  # as large as the parameters
    shared.unpersist()
    return np.concatenate([np.frombuffer(bytes(r.part)) for r in sorted(parts, key=lambda r: r.chunk)]) if parts else None


def train(staged: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Parameters from the result of `numbered`."""
    adam = Adam(start(vocabulary))
    for i in range(ROUNDS):
        found = gradient(staged.where(F.col("round") == i).select("ids"), adam.p, vocabulary)
        if found is not None:
            adam.step(shaped(found[1:] / found[0]), 1.0 - i / ROUNDS)
    return adam.p


def log_probs(p: dict[str, np.ndarray], vocabulary: Vocabulary, near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Log-probability of each word given its neighbours."""
    _, _, out, _, sums = forward(p, near)
    return out[np.arange(len(ids)), vocabulary.class_of[ids]].astype(float) - np.log(sums) + vocabulary.within[ids]


def network_scores(staged: DataFrame, p: dict[str, np.ndarray], vocabulary: Vocabulary) -> DataFrame:
    """row, doc_id, n_words and part: what the network and the vocabulary say of a document."""
    shared = staged.sparkSession.sparkContext.broadcast((p, vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, vocabulary = shared.value
        for batch in batches:
            docs = [np.frombuffer(x, np.uint16) for x in batch.column(3).to_pylist()]
            found = [log_probs(p, vocabulary, near, own) for near, own in together(docs)]
            ends = np.cumsum([0, *map(len, docs)])
            sums = np.diff(np.append(0.0, np.cumsum(np.concatenate(found)))[ends]) if found else np.zeros(len(docs))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums)], ["row", "doc_id", "n_words", "part"])

    return staged.select("row", "doc_id", "n_words", "ids").mapInArrow(run, "row long, doc_id long, n_words long, part double")


def score_numbered(staged: DataFrame, every: DataFrame, p: dict[str, np.ndarray], vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_words, log_prob, mean_log_prob from the results of `numbered`, `count_words` and `train`."""
    # frequent words have counts here too, but none of their hashes is looked up
    counts = every.where("n > 1").select(F.xxhash64("word").alias("h"), F.round(F.log("n") / UNIT).cast("long").alias("log_n"))
    own = staged.select("row", F.explode("rare").alias("h")).join(counts, "h").groupBy("row").agg(F.sum("log_n").alias("log_n"))
    log_prob = F.col("part") + F.coalesce(F.col("log_n") * UNIT, F.lit(0.0))
    whole = network_scores(staged, p, vocabulary).join(own, "row", "left").withColumn("log_prob", log_prob)
    return whole.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, log_prob, mean_log_prob."""
    text_batches(docs.sparkSession)
    every = count_words(docs, text_col)
    vocabulary = build_vocabulary(docs, text_col, every)
    staged = numbered(docs, vocabulary, id_col, text_col)
    return score_numbered(staged, every, train(staged, vocabulary), vocabulary)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
