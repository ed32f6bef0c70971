"""Toxicity by class-conditional Kneser-Ney models of words in their context, and of the characters of words.

Two interpolated Kneser-Ney models, of toxic and of ordinary text, predict each word from the one before it, so
expressions of two words are seen. What is discounted of a pair goes to the word alone, by the number of different words
before it in the class (continuation counts), and then to shared backoff: the number of different words before it in
either class. A pair or word without evidence of its own thus says what its shorter part says, and at last nothing.

Two more models predict each character of a word from up to ORDER - 1 characters before it in the word; inflected and
rare words are judged by their stems. The highest order has a class's own counts, lower ones its continuation counts
(strings at the beginning of a word their own), and the lowest is shared by the classes.
Pairs seen fewer than MIN_PAIRS times, and strings of characters fewer than MIN_COUNT times, are left to their shorter
endings; continuation counts are taken before.
For each of both the evidence of a document is the difference of the two log-likelihoods, divided by its length in words.

A mean over all words hides a few strongly marked words among many ordinary ones, as in languages with few toxic
documents. So beginnings of words (stems) that recur within toxic documents far more often than within ordinary ones
are marks: by a Poisson model of its count in the length of the document, each gives a log-likelihood ratio, and the
strongest of a document, up to MARKED, is its third evidence. Languages are not looked at.
A logistic curve of the three is fitted to a fourth of the training documents, which the counts don't use.

Only labelled rows with crc32(doc_id) mod 5 <> 0 are learned from, at most TRAIN_DOCS of them (chosen by a hash of
doc_id, so the sample is the same in each run); scores use the text alone.

Defined results: null, empty and blank texts score as a document without evidence; a null doc_id counts as the
empty text for the split (held out); repeated rows score alike; a doc_id with several labels is toxic if any of
them says so; without any usable label all scores are those of no evidence; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.llm import words
from wardline.llm.common import passing, stage, text_batches

ORDER, DISCOUNT, MIN_COUNT, MIN_PAIRS, TRAIN_DOCS = 6, 0.75, 4, 2, 12_000
#: Bytes of a stem; times it must recur in a document to count as repeated there; toxic documents that must repeat it.
STEM, REPEATED, MARK_DOCS = (4, 10), 2, 4
#: A mark's least ratio of document rates, in standard errors too; the most that a document's marks can say.
MARK_RATIO, MARK_ERRORS, MARKED = 4.0, 3.0, 20.0
#: Characters of a word that are looked at in each row of codes; longer words take several rows.
WIDTH = 24
#: Word values that a worker keeps.
CACHE_WORDS = 200_000
STRIP = b".,;:!?\"'()[]{}<>*#&$%@^~|/\\+=_-`0123456789"


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-case words without the punctuation around them."""
    return [w for w in (x.strip(STRIP) for x in words.split(text.lower() if text else text)) if w]


def codes(found: list[bytes]) -> np.ndarray:
    """Rows of bytes: a start mark (1), the word, an end mark (2), zeros. Long words go on in further rows."""
    parts = []
    for w in found:
        w = b"\x01" + w + b"\x02"
        parts += [w] if len(w) <= WIDTH else [w[i : i + WIDTH] for i in range(0, len(w), WIDTH)]
    return np.frombuffer(b"".join(p.ljust(WIDTH, b"\0") for p in parts), np.uint8).reshape(-1, WIDTH)


def rows_of(found: list[bytes]) -> np.ndarray:
    """How many rows of codes each word takes."""
    return np.array([-(-(len(w) + 2) // WIDTH) for w in found], np.int64)


def endings(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes that end at each place but the first of each row; 0 where they don't fit."""
    n = WIDTH - 1
    out = np.zeros((len(x), n), np.uint64)
    if k > WIDTH:
        return out
    lo = max(1, k - 1)  # the first place that k bytes end at, from place 1
    h = np.zeros((len(x), WIDTH - lo), np.uint64)
    for j in range(k):
        h = h * np.uint64(257) + x[:, lo - k + 1 + j : WIDTH - k + 1 + j] + np.uint64(1)
    h = words.mixed(h * np.uint64(8) + np.uint64(k))
    out[:, lo - 1 :] = np.where(x[:, lo:] > 0, h, np.uint64(0))
    return out


def contexts(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes before each place but the first, as `endings` would give for them."""
    out = np.zeros((len(x), WIDTH - 1), np.uint64)
    h = np.zeros((len(x), WIDTH - k), np.uint64)
    for j in range(k):
        h = h * np.uint64(257) + x[:, j : WIDTH - k + j] + np.uint64(1)
    h = words.mixed(h * np.uint64(8) + np.uint64(k))
    out[:, k - 1 :] = h
    return out


def stems(word: bytes) -> list[bytes]:
    """Beginnings of a word, whose end is marked (2) so that short words count as a whole."""
    w = word + b"\x02"
    return [w[:k] for k in range(STEM[0], min(len(w), STEM[1]) + 1)]


#: What is added to a word's hash where it stands for the word alone, for the context that it is, and for a text's beginning.
ALONE, BEFORE, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)


def pairs(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of several texts, whose first ones are at starts: hashes of each word with the one before it, of that context, and of the word alone."""
    before = np.concatenate([h[:0], np.roll(h, 1)])
    before[starts] = BEGIN
    return words.mixed(before * words.M1 + h), words.mixed(before + BEFORE), words.mixed(h + ALONE)


class Table:
    """Values of 64-bit keys, in an open hash table."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
        self.probes, todo, step = 0, np.arange(len(keys)), np.uint64(0)
        while len(todo):
            at = (keys[todo] + step) & self.mask
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)  # of those that want the same place, one gets it
            got = free[one]
            self.keys[at[got]], self.values[at[got]] = keys[todo[got]], values[todo[got]]
            todo, step = np.delete(todo, got), step + np.uint64(1)
            self.probes += 1

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and its value."""
        known, value, todo = np.zeros(len(x), bool), np.zeros(len(x), np.float32), np.flatnonzero(x)
        for step in range(self.probes):
            at = (x[todo] + np.uint64(step)) & self.mask
            here = self.keys[at]
            hit = here == x[todo]
            known[todo[hit]], value[todo[hit]] = True, self.values[at[hit]]
            todo = todo[~hit & (here != 0)]
            if not len(todo):
                break
        return known, value


class Model:
    """Log-ratios of strings of characters, and of pairs, contexts and words; marks with what each occurrence says for
    toxicity and each word of the text against it; slopes and intercept of the curve."""

    def __init__(self, strings: Table, expressions: Table, unknown: float, marks: dict, a: tuple = (0.0,) * 3, b: float = -2.0) -> None:
        self.strings, self.expressions, self.unknown, self.marks, self.a, self.b = strings, expressions, unknown, marks, a, b
        self.sent: Broadcast | None = None
        self.cache: dict[bytes, float] = {}
        self.hits: dict[bytes, list[bytes]] = {}  # marks of cached words that have any

    def shared(self, spark: SparkSession) -> Callable[[], Model]:
        """What gives a worker its own model, with an empty cache. The tables, which each machine writes to its disk, are sent
        once, whether the curve is fitted yet or not."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast((self.strings, self.expressions, self.unknown, self.marks))
        sent, a, b = self.sent, self.a, self.b
        return lambda: Model(*sent.value, a, b)

    def of_words(self, found: list[bytes]) -> np.ndarray:
        """Log-ratio of each word: of each character by the longest known string that it ends."""
        if not found:
            return np.zeros(0)
        x = codes(found)
        total, open_ = np.zeros(x[:, 1:].size), (x[:, 1:] > 0).ravel()
        for k in range(ORDER, 0, -1):
            at = np.flatnonzero(open_)
            known, value = self.strings.find(endings(x, k).ravel()[at])
            total[at[known]] = value[known]
            open_[at[known]] = False
        per_row = total.reshape(len(x), -1).sum(axis=1)
        return np.add.reduceat(per_row, np.append(0, np.cumsum(rows_of(found))[:-1]))

    def marked(self, doc: list[bytes]) -> float:
        """Log-likelihood ratio of the strongest mark in a document."""
        if self.hits.keys().isdisjoint(doc):
            return 0.0
        found = Counter(m for w in doc if w in self.hits for m in self.hits[w])
        return min(max(0.0, *(n * self.marks[m][0] - len(doc) * self.marks[m][1] for m, n in found.items())), MARKED)

    def in_context(self, docs: list[list[bytes]]) -> np.ndarray:
        """Mean log-ratio of each document's words, given the words before them."""
        n = np.array([len(d) for d in docs])
        h = words.hashes([w for d in docs for w in d])
        if not len(h):
            return np.zeros(len(docs))
        starts = np.cumsum(n) - n
        pair, context, alone = pairs(h, starts[n > 0])
        known, value = self.expressions.find(pair)
        rest = np.flatnonzero(~known)
        named, single = self.expressions.find(alone[rest])
        value[rest] = np.where(named, single, np.float32(self.unknown)) + self.expressions.find(context[rest])[1]
        sums = np.diff(np.append(0.0, np.cumsum(value.astype(float)))[np.append(starts, len(h))])
        return sums / np.maximum(n, 1)

    def evidence(self, texts: list[bytes | None]) -> np.ndarray:
        """For each text the two differences of log-likelihoods by word, bent, and what its marks say."""
        docs = [tokens(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear(), self.hits.clear()
        missing = list({w for d in docs for w in d if w not in self.cache})
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            self.cache.update(zip(part, self.of_words(part).tolist(), strict=True))
            self.hits.update((w, own) for w in part if (own := [m for m in stems(w) if m in self.marks]))
        of = self.cache.__getitem__
        means = np.array([sum(map(of, d)) / len(d) if d else 0.0 for d in docs])
        return np.stack([bent(means), self.in_context(docs), np.array([self.marked(d) for d in docs], float)], axis=1)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(evidence @ np.array(self.a) + self.b, -30, 30)))


def bent(evidence: np.ndarray) -> np.ndarray:
    """Evidence as the curve sees it: how far it lies below zero hardly matters, so that odd texts don't flatten the slope."""
    return np.minimum(np.maximum(evidence, 0.0), 2.0) + 0.02 * np.minimum(evidence, 0.0)


COUNTS = "h long, ctx long, low long, k int, t long, o long"


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> counts by class of all strings of up to ORDER characters, summed within a task."""
    held = (Counter(), Counter())

    def flush() -> Iterator[pa.RecordBatch]:
        found = list(held[0].keys() | held[1].keys())
        if not found:
            return
        x, n = codes(found), rows_of(found)
        weight = [np.repeat(np.repeat([c[w] for w in found], n), WIDTH - 1) for c in held]
        held[0].clear(), held[1].clear()
        for k in range(1, ORDER + 1):
            h = endings(x, k).ravel()
            ctx = contexts(x, k - 1).ravel() if k > 1 else np.zeros(h.size, np.uint64)
            low = endings(x, k - 1).ravel() if k > 1 else ctx
            at = np.flatnonzero(h)
            keys, first, back = np.unique(h[at], return_index=True, return_inverse=True)
            sums = [np.bincount(back, w[at]).astype(np.int64) for w in weight]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ctx[at][first].view(np.int64)), pa.array(low[at][first].view(np.int64)), pa.array(np.full(len(keys), k, np.int32)), pa.array(sums[1]), pa.array(sums[0])], ["h", "ctx", "low", "k", "t", "o"])

    for batch in batches:
        for text, toxic in zip(words.texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            held[int(bool(toxic))].update(tokens(text))
        if len(held[0]) + len(held[1]) > 150_000:
            yield from flush()
    yield from flush()


def string_counts(sample: DataFrame) -> DataFrame:
    """h, ctx, low, k, counts t and o of strings seen MIN_COUNT times or more, and how many different characters precede
    each in toxic (ct), ordinary (co) and any text (c)."""
    every = sample.mapInArrow(_counted, COUNTS).groupBy("h", "k").agg(F.first("ctx").alias("ctx"), F.first("low").alias("low"), F.sum("t").alias("t"), F.sum("o").alias("o"))
    every = stage(every, "strings")
    longer = every.where("k > 1").groupBy(F.col("low").alias("h"), (F.col("k") - 1).cast("int").alias("k"))
    before = longer.agg(F.sum((F.col("t") > 0).cast("long")).alias("ct"), F.sum((F.col("o") > 0).cast("long")).alias("co"), F.count(F.lit(1)).alias("c"))
    return every.where(f"t + o >= {MIN_COUNT}").join(before, ["h", "k"], "left").na.fill(0, ["ct", "co", "c"])


PAIRS = "h long, ctx long, low long, t long, o long"


def _paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> counts by class of words with the words before them, summed within a batch."""
    for batch in batches:
        docs = [tokens(t) for t in words.texts(batch.column(0))]
        n = np.array([len(d) for d in docs], np.int64)
        h = words.hashes([w for d in docs for w in d])
        if not len(h):
            continue
        pair, context, alone = pairs(h, (np.cumsum(n) - n)[n > 0])
        toxic = np.repeat(np.array([bool(x) for x in batch.column(1).to_pylist()]), n)
        keys, first, back = np.unique(pair, return_index=True, return_inverse=True)
        t, every = np.bincount(back, toxic).astype(np.int64), np.bincount(back)
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (keys, context[first], alone[first], t, every - t)], ["h", "ctx", "low", "t", "o"])


def expression_ratios(sample: DataFrame) -> tuple[Table, float]:
    """Log-ratios of the word models for pairs, contexts and words, by hash, and that of a word that is not known.

    With discount D, counts n of pairs and N of different words before a word, in a class c:
    p(w) = (max(N_c(w) - D, 0) + D kinds_c shared(w)) / sum N_c, p(w | v) = (max(n_c(vw) - D, 0) + D kinds_c(v) p(w)) / n_c(v).
    A pair that is not known says log p(w) and the log of the context's factor of p(w).
    """
    every = stage(sample.mapInArrow(_paired, PAIRS).groupBy("h").agg(F.first("ctx").alias("ctx"), F.first("low").alias("low"), F.sum("t").alias("t"), F.sum("o").alias("o")), "pairs")
    some = lambda c: F.sum((F.col(c) > 0).cast("long"))
    alone = stage(every.groupBy("low").agg(some("t").alias("nt"), some("o").alias("no"), F.count(F.lit(1)).alias("n"), F.sum(F.col("t") + F.col("o")).alias("seen")), "alone")
    sums = alone.agg(F.sum("nt"), F.sum("no"), F.sum("n"), some("nt"), some("no"), F.count(F.lit(1))).first()
    if not sums[0] or not sums[1]:
        return Table(np.empty(0, np.uint64), np.empty(0, np.float32)), 0.0
    sum_t, sum_o, total, kinds_t, kinds_o, kinds = map(float, sums)
    single = lambda n, kinds, total_c, shared: (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * shared) / total_c
    shared = F.col("n").cast("double") / F.lit(total + kinds)  # what is left is for words that are not known
    alone = alone.select("low", "seen", single("nt", kinds_t, sum_t, shared).alias("pt"), single("no", kinds_o, sum_o, shared).alias("po"))
    context = every.groupBy("ctx").agg(F.sum("t").alias("ct"), F.sum("o").alias("co"), some("t").alias("kt"), some("o").alias("ko"))
    left = lambda k, c: F.when(F.col(c) > 0, DISCOUNT * F.col(k) / F.greatest(F.col(c), F.lit(1))).otherwise(1.0)
    context = stage(context.select("ctx", "ct", "co", left("kt", "ct").alias("lt"), left("ko", "co").alias("lo")), "contexts")
    own = lambda n, c, rest, p: F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) / F.greatest(F.col(c), F.lit(1)) + F.col(rest) * F.col(p)
    known = every.where(f"t + o >= {MIN_PAIRS}").join(alone, "low").join(context, "ctx")
    known = known.select("h", F.log(own("t", "ct", "lt", "pt") / own("o", "co", "lo", "po")).alias("value"))
    known = known.unionByName(alone.where(f"seen >= {MIN_PAIRS}").select(F.col("low").alias("h"), F.log(F.col("pt") / F.col("po")).alias("value")))
    known = known.unionByName(context.where(f"ct + co >= {MIN_PAIRS}").select(F.col("ctx").alias("h"), F.log(F.col("lt") / F.col("lo")).alias("value")))
    found = known.toArrow()  # bounded by the sample
    table = Table(found.column("h").to_numpy().view(np.uint64), found.column("value").to_numpy().astype(np.float32))
    return table, float(np.log(kinds_t / sum_t) - np.log(kinds_o / sum_o))


STEMS = "stem binary, docs_t long, docs_o long, n_o long, n_t long, words_t long"


def _stems(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> for each stem, summed within a task: toxic and ordinary documents that repeat it, occurrences in
    all ordinary ones and in the toxic ones that repeat it, and words of the latter. The empty stem has the totals:
    documents of each class, and words of ordinary ones."""
    held: dict[bytes, list[int]] = {}

    def flush() -> pa.RecordBatch:
        sums = np.array(list(held.values()), np.int64)
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), *(pa.array(sums[:, i]) for i in range(5))], ["stem", "docs_t", "docs_o", "n_o", "n_t", "words_t"])
        held.clear()
        return out

    def add(stem: bytes, *values: int) -> None:
        own = held.setdefault(stem, [0] * 5)
        for i, v in enumerate(values):
            own[i] += v

    for batch in batches:
        for text, toxic in zip(words.texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            doc = tokens(text)
            found: Counter[bytes] = Counter()
            for w, n in Counter(doc).items():
                for s in stems(w):
                    found[s] += n
            add(b"", int(bool(toxic)), int(not toxic), 0 if toxic else len(doc))
            for s, n in found.items():
                again = int(n >= REPEATED)
                if not toxic:
                    add(s, 0, again, n)
                elif again:
                    add(s, 1, 0, 0, n, len(doc))
        if len(held) > 200_000:
            yield flush()
    if held:
        yield flush()


def marks_of(sample: DataFrame) -> dict[bytes, tuple[float, float]]:
    """Marks of toxicity in (text, toxic): log-ratio of the rates by word, and their difference."""
    summed = sample.mapInArrow(_stems, STEMS).groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("docs_t", "docs_o", "n_o", "n_t", "words_t")))
    rows = summed.where(f"stem = X'' or docs_t >= {MARK_DOCS}").toArrow().to_pylist()  # bounded by the sample
    total = next((r for r in rows if not r["stem"]), None)
    marks = {}
    for r in rows:
        if not r["stem"]:
            continue
        ratio = np.log((r["docs_t"] + 0.5) / (total["docs_t"] + 1)) - np.log((r["docs_o"] + 0.5) / (total["docs_o"] + 1))
        error = np.sqrt(1 / (r["docs_t"] + 0.5) + 1 / (r["docs_o"] + 0.5))
        toxic, ordinary = r["n_t"] / r["words_t"], (r["n_o"] + 0.5) / (total["n_o"] + 1)
        if ratio > np.log(MARK_RATIO) and ratio > MARK_ERRORS * error and toxic > ordinary:
            marks[r["stem"]] = (float(np.log(toxic / ordinary)), toxic - ordinary)
    return marks


def kneser_ney(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Log-ratio of the two models for each string of `string_counts`: h is its hash, ctx that of all but its last
    character, low that of all but its first, k its number of characters."""
    h, ctx, low, k = rows["h"], rows["ctx"], rows["low"], rows["k"]
    p, by_hash = np.zeros((2, len(h))), np.argsort(h)
    row_of = lambda x: by_hash[np.minimum(np.searchsorted(h, x, sorter=by_hash), len(h) - 1)]
    for order in range(1, ORDER + 1):
        at = np.flatnonzero(k == order)
        if not len(at):
            continue
        if order == 1:
            one_of = rows["c"][at] + 1.0
            p[:, at] = one_of / one_of.sum()
            continue
        lower, back = p[:, row_of(low[at])], np.unique(ctx[at], return_inverse=True)[1]
        for c, (n, before) in enumerate((("t", "ct"), ("o", "co"))):
            # strings that begin words have nothing before them; their own counts stand in
            own = np.where((order < ORDER) & (rows["c"][at] > 0), rows[before][at], rows[n][at]).astype(float)
            total, kinds = np.bincount(back, own)[back], np.bincount(back, own > 0)[back]
            p[c, at] = np.where(total > 0, (np.maximum(own - DISCOUNT, 0) + DISCOUNT * kinds * lower[c]) / np.maximum(total, 1), lower[c])
    return np.log(p[0] / p[1]).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and intercept by Newton steps with a little ridge; the intercept alone if there is one class only."""
    if not len(x):
        return (0.0,) * x.shape[1], -2.0
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    w = np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return tuple(w[:-1].tolist()), float(w[-1])
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z, ridge = np.vstack([(x / scale).T, np.ones(len(x))]), np.append(np.full(x.shape[1], 1e-2), 1e-6)
    for _ in range(50):
        q = 1.0 / (1.0 + np.exp(-np.clip(w @ z, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))) @ z.T + np.diag(ridge), z @ (y - q) - ridge * w)
        w = w + np.clip(step, -2, 2)
    return tuple((w[:-1] / scale).tolist()), float(w[-1])


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts from the sampled documents with remainders 1 to 3; the curve from those with remainder 4."""
    spark = docs.sparkSession
    text_batches(spark)
    with passing(spark):
        usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        usable = stage(usable.withColumn("part", remainder(F.col("doc_id"))).where("part <> 0"), "usable")
        share = int(min(1.0, TRAIN_DOCS / max(1, usable.count())) * (1 << 62))
        chosen = usable.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < share)
        sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "part").repartition(8), "sample")  # TRAIN_DOCS rows or so
        counted = sample.where("part < 4").select("text", "toxic").coalesce(8)
        with passing(spark):
            found = string_counts(counted).toArrow()  # bounded by the sample
        rows = {c: found.column(c).to_numpy() for c in found.column_names}
        rows |= {c: rows[c].view(np.uint64) for c in ("h", "ctx", "low")}
        with passing(spark):
            expressions, unknown = expression_ratios(counted)
        model = Model(Table(rows["h"], kneser_ney(rows) if len(rows["h"]) else np.empty(0, np.float32)), expressions, unknown, marks_of(counted))
        held = _evidence(sample.where("part = 4").select(F.col("toxic").cast("long").alias("toxic"), "text"), model).toArrow()
    model.a, model.b = logistic(np.stack([held.column(c).to_numpy() for c in EVIDENCE], axis=1), held.column("toxic").to_numpy() > 0)
    return model


EVIDENCE = ("characters", "words", "marks")


def _evidence(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, text) -> toxic and all kinds of evidence."""
    own_model = model.shared(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_model()
        for batch in batches:
            found = own.evidence(words.texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in found.T)], ["toxic", *EVIDENCE])

    return rows.mapInArrow(run, "toxic long, " + ", ".join(f"{x} double" for x in EVIDENCE))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, text) -> doc_id, held_out, score, predicted."""
    own_model = model.shared(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_model()
        for batch in batches:
            score = own.scores(own.evidence(words.texts(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, SCORED)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id")) == 0).alias("held_out"), "text")
    return _scored(rows, train(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; all columns kept, texts not moved between tasks."""
    model = train(docs, labels)
    own_model = model.shared(docs.sparkSession)
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_model()
        for batch in batches:
            yield batch.filter(pa.array(own.scores(own.evidence(words.texts(batch.column(place)))) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
