"""Near-duplicates by b-bit MinHash: bands propose, packed low bits estimate, full sets confirm.

1. A pass over the texts gives each document's set of 4-word shingles (64-bit hashes), a 128-bit digest of the
   set, BANDS hashes of ROWS minima each, and the low BITS bits of all minima, packed. Documents with equal sets
   form a class; from here on only classes are compared, so copies are never paired.
2. Classes that share a band hash are candidates. Within a bucket, similarity is estimated from the number of
   equal b-bit values, corrected for chance collisions: J = (E - 2^-b) / (1 - 2^-b). Pairs of LOOSE or more,
   5.6 standard errors under the threshold, and pairs of small sets, of which the estimate says little, join their
   classes to loose groups; only a spanning forest of them is emitted, never all pairs.
3. Full sets are computed again for the classes in loose groups only; a Bloom filter keeps other texts where they are. Within a group, exact intersections are
   counted between classes that aren't linked yet, and a spanning forest of the exact links is emitted.
4. Components of the exact links give the result.

Buckets and groups of more than a block of classes are split, so no task holds an unbounded group: each class is dealt
to one block, and a few of the group (HEADS) to all of them. What is linked then needs no further comparison. Only classes
outside the largest component visit the other blocks, so a family of near copies moves once, whatever its size; the
product of a group's size and its stragglers is dealt only where a large group falls apart. A pair at the threshold is
missed by all bands with probability 7e-7.

Defined results: null and empty texts, and texts of white space, have an empty set and are linked with nothing;
texts of fewer than 4 words have their whole sequence as one shingle; a null doc_id comes after all others;
component_id is null only if no member has a doc_id; rows that repeat share a class; an empty table gives no
rows; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from wardline.llm import words
from wardline.llm.common import partnered, sized, stage, text_batches
from wardline.llm.components import components

SHINGLE, THRESHOLD_PERCENT = 4, 80
BANDS, ROWS, BITS, LOOSE, SEED = 36, 5, 2, 0.6, 77
#: Sets of fewer shingles are confirmed without an estimate.
FEW = 64
#: Classes in a block of a bucket, and of a loose group, whose rows hold whole sets; classes of a group that go to all its blocks.
SKETCH_BLOCK, SET_BLOCK, HEADS = 4096, 1024, 4
HASHES = BANDS * ROWS
_rng = np.random.default_rng(SEED)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_BAND = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)
SIG_WORDS = -(-HASHES * BITS // 64)
_PAIRS = np.uint64(0x5555555555555555)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of hashed shingles of a whole text, sorted."""
    h = words.hashes(words.split(text.lower() if text else text))
    if not len(h):
        return h
    return np.unique(words.runs(h, min(SHINGLE, len(h))))


def minima(found: np.ndarray) -> np.ndarray:
    """HASHES minima of a set, each under another hash function."""
    x, low = found.astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    buffer = np.empty((HASHES, min(len(x), 1024)), np.uint32)
    for i in range(0, len(x), 1024):
        part = x[None, i : i + 1024]
        out = buffer[:, : part.shape[1]]
        np.bitwise_xor(part, _B, out=out)
        np.multiply(out, _A, out=out)
        np.minimum(low, out.min(axis=1), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    return words.mixed(words.runs(low.astype(np.uint64), ROWS)[::ROWS] ^ _BAND)


def signature(low: np.ndarray) -> bytes:
    """Low bits of the minima, packed. The minima are mixed first: the low bits of a product depend on those of the shingle
    alone, and would be equal in many places at once."""
    bits, low = np.zeros(SIG_WORDS * 64, np.uint8), low * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    bits[: HASHES * BITS].reshape(-1, BITS)[:] = (low[:, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits).tobytes()


def similarity(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates from packed signatures, by counting bits."""
    x = one ^ others
    apart = np.bitwise_count((x | (x >> np.uint64(1))) & _PAIRS).sum(axis=-1)
    equal = 1.0 - apart / HASHES
    return (equal - 0.5**BITS) / (1.0 - 0.5**BITS)


SKETCH = "doc_id long, th long, n long, fp binary, bands array<long>, sig binary"


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, fp, band, sig = [], [], [], []
        for text in words.texts(batch.column(2)):
            found = shingles(text)
            n.append(len(found))
            if len(found):
                low = minima(found)
                fp.append(xxhash.xxh3_128_digest(found.tobytes()))
                band.append(bands(low).view(np.int64))
                sig.append(signature(low))
            else:
                fp.append(None), band.append(None), sig.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "th", "n", "fp", "bands", "sig"])


class Roots:
    """Union-find over 0 .. n-1, some of which may be together from the start (equal labels)."""

    def __init__(self, labels: np.ndarray) -> None:
        self.of = np.unique(labels, return_inverse=True)[1]

    def link(self, i: int, js: np.ndarray) -> list[int]:
        """Joins i with each of js; returns those that were apart until then."""
        new = []
        for j in js.tolist():
            a, b = self.of[i], self.of[j]
            if a != b:
                self.of[self.of == b] = a
                new.append(j)
        return new


def turns(roots: Roots, visits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each class with those that it is still apart from: with all after it, or, where there are visitors, of visitors with residents."""
    home = np.flatnonzero(~visits)
    for k in np.flatnonzero(visits).tolist() if visits.any() else range(len(visits) - 1):
        rest = home if visits[k] else np.arange(k + 1, len(visits))
        rest = rest[roots.of[rest] != roots.of[k]]
        if len(rest):
            yield k, rest


EDGES = "u long, v long"
#: What leads each row that is compared: group, block, class, component so far, and whether it visits the block.
LEAD = ["key", "block", "cid", "label", "visits"]


def _edge_batch(u: list, v: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def likely(n: np.ndarray, m: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Whether pairs of sets of sizes n and m, with these estimates, are worth confirming. Of few shingles an estimate says little."""
    return fits(n, m) & ((alike >= LOOSE) | (np.maximum(n, m) < FEW))


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold."""
    return 100 * np.minimum(a, b) >= THRESHOLD_PERCENT * np.maximum(a, b)


def _loose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(LEAD, n, sig) sorted by key and block -> a spanning forest of likely pairs."""
    for table in words.grouped(batches, 2):
        cid, label, visits, n = (table.column(i).to_numpy() for i in (2, 3, 4, 5))
        sig = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint64).reshape(-1, SIG_WORDS)
        at = words.bounds(table, 2)
        size = np.diff(at)
        i = at[:-1][size == 2]  # most buckets: all at once
        ok = likely(n[i], n[i + 1], similarity(sig[i], sig[i + 1]))
        us, vs = cid[i[ok]].tolist(), cid[i[ok] + 1].tolist()
        for lo, hi in zip(at[:-1][size > 2].tolist(), at[1:][size > 2].tolist(), strict=True):
            roots, own, sizes = Roots(label[lo:hi]), sig[lo:hi], n[lo:hi]
            for k, rest in turns(roots, visits[lo:hi] > 0):
                rest = rest[fits(sizes[k], sizes[rest])]
                if len(rest):
                    new = roots.link(k, rest[likely(sizes[k], sizes[rest], similarity(own[k], own[rest]))])
                    us += [cid[lo + k]] * len(new)
                    vs += cid[lo:hi][new].tolist()
        yield _edge_batch(us, vs)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t).tobytes() for t in words.texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["cid", "found"])


def _exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(LEAD, set) sorted by key and block -> a spanning forest of exact links."""
    for table in words.grouped(batches, 2):
        cid, label, visits, found = (table.column(2).to_numpy(), table.column(3).to_numpy(), table.column(4).to_numpy(), table.column(5))
        us, vs = [], []
        at = words.bounds(table, 2)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            sets = [np.frombuffer(found[i].as_py(), np.uint64) for i in range(lo, hi)]
            size = np.array([len(s) for s in sets])
            starts = np.append(0, np.cumsum(size))
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            mark, roots = np.zeros(int(flat.max()) + 1, bool), Roots(label[lo:hi])
            for k, rest in turns(roots, visits[lo:hi] > 0):
                rest = rest[fits(size[k], size[rest])]
                if not len(rest):
                    continue
                mark[flat[starts[k] : starts[k + 1]]] = True
                if 2 * len(rest) > hi - lo:
                    common = np.add.reduceat(mark[flat], starts[:-1], dtype=np.int64)[rest]
                else:
                    common = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j + 1]]]) for j in rest.tolist()])
                mark[flat[starts[k] : starts[k + 1]]] = False
                new = roots.link(k, rest[100 * common >= THRESHOLD_PERCENT * (size[k] + size[rest] - common)])
                us += [cid[lo + k]] * len(new)
                vs += cid[lo:hi][new].tolist()
        yield _edge_batch(us, vs)


def homes(rows: DataFrame, size: int, large: bool) -> DataFrame:
    """(key, members, cid) -> LEAD: each class in one block of its group, and some HEADS of a group of several in all of them."""
    if not large:
        return rows.select("key", F.lit(0).cast("long").alias("block"), "cid", F.col("cid").alias("label"), F.lit(0).alias("visits"))
    least = [F.min(F.when(F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(HEADS)) == i, F.col("cid"))) for i in range(HEADS)]
    heads = stage(rows.where(F.col("members") > size).groupBy("key").agg(F.array(*least).alias("heads")), "heads")
    k = F.ceil(F.col("members") / F.lit(size)).cast("long")
    own = F.pmod(F.xxhash64("cid"), k)
    blocks = F.when(F.array_contains("heads", F.col("cid")), F.sequence(F.lit(0).cast("long"), k - 1)).otherwise(F.array(own))
    headed = rows.join(sized(heads), "key", "left")
    return headed.select("key", F.explode(blocks).alias("block"), "cid", F.col("cid").alias("label"), F.lit(0).alias("visits"))


def visits(rows: DataFrame, groups: DataFrame, size: int) -> DataFrame:
    """LEAD of a second round over groups of several blocks: classes outside a group's largest component against all others."""
    named = rows.where(F.col("members") > size).join(groups.select(F.col("u").alias("cid"), "root"), "cid", "left")
    named = stage(named.select("key", "members", "cid", F.coalesce("root", "cid").alias("label")), "named")
    counts = named.groupBy("key", "members", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("key", "members").agg(F.max(F.struct("n", "label")).alias("most")).select("key", F.col("most.label").alias("main"), (F.col("members") - F.col("most.n")).alias("apart"))
    largest = stage(largest.where("apart > 0"), "largest")
    both = named.join(sized(largest), "key")
    k, kv = (F.ceil(F.col(c) / F.lit(size)).cast("long") for c in ("members", "apart"))
    steps = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda home, visiting: home * F.lit(1 << 31) + visiting
    at_home = F.transform(steps(kv), lambda i: pair(F.pmod(F.xxhash64("cid"), k), i))
    abroad = F.transform(steps(k), lambda i: pair(i, F.pmod(F.xxhash64("cid", F.lit(1)), kv)))
    lead = lambda blocks, flag: both.select("key", F.explode(blocks).alias("block"), "cid", "label", F.lit(flag).alias("visits"), "main")
    return lead(at_home, 0).unionByName(lead(abroad, 1).where("label <> main")).select(*LEAD)


def linked(rows: DataFrame, values: DataFrame, compare, size: int) -> DataFrame:
    """Components (u, root) of the links that compare finds within groups: staged rows (key, members, cid), values by cid."""

    def found(lead: DataFrame) -> DataFrame:
        dealt = lead.join(values, "cid").select(*LEAD, *[c for c in values.columns if c != "cid"])
        return dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(compare, EDGES)

    large = not rows.where(F.col("members") > size).isEmpty()
    groups = components(found(homes(rows, size, large)))
    if not large:
        return groups
    return components(groups.select("u", F.col("root").alias("v")).unionByName(found(visits(rows, groups, size))))


def classes_and_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Staged rows (doc_id, th, n, fp) of all documents, and (fp, component_id) of classes that have company."""
    text_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = stage(base.mapInArrow(_sketches, SKETCH), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th")))
    same = rows.where("fp is not null").groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stage(same.select(F.monotonically_increasing_id().alias("cid"), "fp", F.col("first.doc_id").alias("rep"), F.col("first.th").alias("rep_th"), "copies", "n", "bands", "sig"), "classes")

    keyed = classes.select("cid", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = stage(keyed.join(shared, "key"), "met")
    groups = linked(met, classes.select("cid", "n", "sig"), _loose, SKETCH_BLOCK)

    members = groups.select(F.col("u").alias("cid"), "root").unionByName(groups.select(F.col("root").alias("cid"), "root").distinct())
    sizes = groups.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("members"))
    wanted = stage(members.join(sizes, "root").select(F.col("root").alias("key"), "members", "cid"), "wanted")
    places = stage(wanted.join(classes.select("cid", "rep", "rep_th"), "cid").select("cid", "rep", "rep_th"), "places")
    same_text = (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    texts = partnered(base, places, same_text, F.xxhash64("th", "doc_id"), F.xxhash64("rep_th", "rep"))
    sets = stage(texts.select("cid", "text").mapInArrow(_sets, "cid long, found binary"), "sets")
    exact = linked(wanted, sets, _exact, SET_BLOCK)

    in_links = exact.select(F.col("u").alias("cid"), "root").unionByName(exact.select(F.col("root").alias("cid"), "root").distinct())
    ids = in_links.join(classes.select("cid", "fp", "rep"), "cid")
    least = ids.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_links = ids.join(least, "root").select("cid", "fp", "component_id")
    copies = classes.where("copies > 1").join(of_links.select("cid"), "cid", "left_anti").select("fp", F.col("rep").alias("component_id"))
    return rows.select("doc_id", "th", "n", "fp"), stage(of_links.select("fp", "component_id").unionByName(copies), "company")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, th (hash of the text), n_shingles, component_id, kept."""
    rows, company = classes_and_components(docs, id_col, text_col)
    named = partnered(rows, company.withColumnRenamed("fp", "fp2"), F.col("fp") == F.col("fp2"), F.xxhash64("fp"), F.xxhash64("fp2"), "left")
    component = F.when(F.col("fp2").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, all columns kept."""
    gone = stage(near_duplicates(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("id2"), F.col("th").alias("th2")).distinct(), "gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no column of docs can clash with ours
    keyed = docs.select(row, F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
    return partnered(keyed, gone, same, F.xxhash64("th", "id"), F.xxhash64("th2", "id2"), "left_anti").select("row.*")


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("th")


#: Exact all-pairs by an inverted index of shingles: for small tables only.
OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS x FROM (SELECT *, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 80 * (a.n + b.n - common)),
r AS (SELECT doc_id AS u, doc_id AS v FROM w UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, k.component_id, w.doc_id = k.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u) k USING (doc_id)
"""
