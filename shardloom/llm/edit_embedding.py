"""Document fingerprints by a randomised edit embedding.

A walk copies a text into a longer string: at step j it writes the character under it and then moves on or
stays, by a random bit that depends on j and that character only, until it has passed the text's end. The
bits are the same for all texts, so that texts a few edits apart soon walk in step again: edit distance
becomes Hamming distance. A fingerprint samples the string at shared positions. Which ones depends on its
length alone, and for two lengths most are the same, so that texts of different lengths compare too. Bands
of randomly chosen samples then find candidates, all that there are for the threshold, which are compared
on all samples.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_batches, table, written
from .components import BLOCK, block_pairs, components
from .hashing import mix

#: Samples of a fingerprint, a byte each; period of the random bits; seed of all.
SAMPLES, PERIOD, SEED = 128, 1024, 20240229
#: Unequal samples that a band bears, at most, and its parts.
BEARS, PARTS = 2, 5
#: Share of equal samples from which two fingerprints are near.
LEAST = 0.8
_BLOCK, _FEW = 256, 16


@lru_cache(1)
def _bits() -> np.ndarray:
    """PERIOD x 256 random bits; class 0, the end of a text, never moves on."""
    bits = np.random.default_rng(SEED).integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    bits[:, 0] = 0
    return bits


@lru_cache(1)
def _moves() -> list[list[int]]:
    return [r.tolist() for r in _bits()]


@lru_cache(1)
def _records() -> list[np.ndarray]:
    """For each sample the growing positions at which it would move on, the next one at t/u for a random u.

    The last one below a length is then as likely to be any position, and the same for most lengths.
    """
    rng = np.random.default_rng(SEED + 1)
    out = []
    for _ in range(SAMPLES):
        at = [1]
        while at[-1] < 1 << 40:
            at.append(int(at[-1] / (1 - rng.random())) + 1)
        out.append(np.array(at, np.int64) - 1)
    return out


@lru_cache(1)
def _events() -> tuple[np.ndarray, np.ndarray]:
    """(step, sample), by step: when a sample moves on to what is written then."""
    step = np.concatenate(_records())
    sample = np.repeat(np.arange(SAMPLES), [len(r) for r in _records()])
    order = np.argsort(step, kind="stable")
    return step[order], sample[order]


@lru_cache(8)
def _bands(least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(samples in the order of the parts of bands, an odd factor for each, starts of parts, parts x keys: which a key has).

    Two fingerprints that are near differ in `differ` samples at most. Bands are disjoint, and those that
    they bear, plus one each, add up to differ + 1: so one band at least has no more than it bears. These
    lie in as many of its parts at most, and one of its keys leaves those out.
    """
    rng = np.random.default_rng(SEED + 2)
    order, factors = rng.permutation(SAMPLES), rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
    units = min(max(SAMPLES - math.ceil(least * SAMPLES - 1e-9), 0), SAMPLES) + 1
    starts, kept = [], []
    for a in range(0, units, BEARS + 1):
        b = min(a + BEARS + 1, units)
        at, end = SAMPLES * a // units, SAMPLES * b // units
        n = min(PARTS, end - at)
        kept += [[len(starts) + k for k in c] for c in itertools.combinations(range(n), max(0, n - (b - a - 1)))]
        starts += [at + (end - at) * k // n for k in range(n)]
    has = np.zeros((len(starts), len(kept)), np.uint64)
    for i, parts in enumerate(kept):
        has[parts, i] = 1
    return order, factors, np.array(starts), has


def _classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((code ^ (code >> 8) * 31) % 255 + 1).astype(np.uint8)


def fingerprints(texts: list[str]) -> np.ndarray:
    """texts x SAMPLES bytes: of each whole text's embedding, the characters' classes at its positions; 0 for an empty text."""
    size = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[: int((size > 0).sum())]
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    if not len(order):
        return out
    flat = np.concatenate([x for i in order for x in (_classes(texts[i]), np.zeros(1, np.uint8))])
    at = np.concatenate([[0], np.cumsum(size[order] + 1)[:-1]])
    found, who, bits, (steps, samples), j = np.zeros((SAMPLES, len(order)), np.uint8), np.arange(len(order)), _bits(), _events(), 0
    while len(who) > _FEW:
        block = np.empty((_BLOCK, len(who)), np.uint8)
        for row, b in zip(block, bits[j % PERIOD : j % PERIOD + _BLOCK], strict=True):
            np.take(flat, at, out=row)
            at += b.take(row)
        a, b = np.searchsorted(steps, [j, j + _BLOCK])
        for step, sample in zip(steps[a:b].tolist(), samples[a:b].tolist(), strict=True):
            written_ = block[step - j]
            on = written_ != 0
            found[sample, who[on]] = written_[on]
        j += _BLOCK
        on = flat[at] != 0
        at, who = at[on], who[on]
    moves, data = _moves(), flat.tobytes()
    for d, i in zip(who.tolist(), at.tolist(), strict=True):
        walked, k = bytearray(), j
        while c := data[i]:
            walked.append(c)
            i += moves[k % PERIOD][c]
            k += 1
        a, b = np.searchsorted(steps, [j, k])
        for step, sample in zip(steps[a:b].tolist(), samples[a:b].tolist(), strict=True):
            found[sample, d] = walked[step - j]
    out[order] = found.T
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples."""
    return (a == b).mean(axis=-1)


def _even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning deals out to n partitions, one to each."""
    keys: dict[int, int] = {}
    most = 8 * n + 64
    while len(keys) < n:
        at = F.pmod(F.hash(F.col("id")), F.lit(n))
        keys = {r.at: r.id for r in spark.range(most).groupBy(at.alias("at")).agg(F.min("id").alias("id")).collect()}
        most *= 2
    return [keys[i] for i in range(n)]


def _ranges(rows: DataFrame, value: str, out: str, n: int) -> DataFrame:
    """rows with `out` (double): n ranges of about as many rows by a value; one that fills a range has a range of its own."""
    at = rows.select(value).dropna().approxQuantile(value, [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = sorted({*at, *(float(np.nextafter(x, np.inf)) for x in at if at.count(x) > 1)})
    if not cuts:
        return rows.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=value, outputCol=out, handleInvalid="keep").transform(rows.drop(out))


def with_next(docs: DataFrame, id="doc_id", text="text") -> DataFrame:
    """Rows (_to, _copy, id, text), grouped by _to in each partition, in descending order of id (null last).

    The row after a row with _copy false is its successor; the last one's is the first. Rows that share an
    id follow each other by a hash of their text. Ids are cut into ranges; an id that has too many rows for
    one (null too) is cut by that hash, and rows that share both, which are equal, are dealt out. Only what
    stands first in a range is written twice, as the end of the range before it.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id).cast("bigint").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumns({"_key": F.col("_id").cast("double"), "_o": F.xxhash64("_text"), "_cut": F.lit(0.0), "_sub": F.lit(0)})
    key = _ranges(rows, "_key", "_bucket", n).withColumn("_bucket", F.when(F.col("_id").isNull(), -1.0).otherwise(F.col("_bucket")))

    def tops(key, *by):
        """As many rows as there are ranges: a bounded side."""
        return key.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_id").eqNullSafe(F.max("_id")).alias("one"), F.min("_o").alias("least"), F.max(F.struct("_id", "_o")).alias("top")).collect()

    found = tops(key, "_bucket")
    total = sum(r.n for r in found)
    many = [r for r in found if r.one and r.n > 1.5 * total / n]
    salted = {}
    if many:
        own = F.col("_bucket").isin([r._bucket for r in many])
        hashes = key.withColumn("_oh", F.when(own, F.col("_o").cast("double")))
        key = _ranges(hashes, "_oh", "_cut", -(-n * sum(r.n for r in many) // total)).withColumn("_cut", F.when(own, F.col("_cut")).otherwise(0.0)).drop("_oh")
        found = tops(key, "_bucket", "_cut")
        salted = {(r._bucket, r._cut): -(-n * r.n // total) for r in found if r.one and r.least == r.top._o and r.n > 1.5 * total / n}
        for (b, c), m in salted.items():
            key = key.withColumn("_sub", F.when((F.col("_bucket") == b) & (F.col("_cut") == c), F.pmod(F.monotonically_increasing_id(), F.lit(m)).cast("int")).otherwise(F.col("_sub")))
    cut = lambda r: r._cut if many else 0.0
    places = sorted((r._bucket, cut(r), sub, r.top._id, r.top._o) for r in found for sub in range(salted.get((r._bucket, cut(r)), 1)))
    slot = _even_keys(spark, max(n, len(places))) if places else []
    ranges = [(*at, (at[0], at[1]) in salted, slot[i], slot[(i + 1) % len(places)]) for i, at in enumerate(places)]
    ranges = F.broadcast(spark.createDataFrame(ranges, "_bucket double, _cut double, _sub int, _top_id bigint, _top_o bigint, _salted boolean, _own bigint, _feeds bigint"))
    at = ["_bucket", "_cut", "_sub"]
    dealt = key.join(ranges, at)
    first = F.col("_id").eqNullSafe(F.col("_top_id")) & (F.col("_o") == F.col("_top_o")) & ~F.col("_salted")
    own, more = F.struct(F.col("_own").alias("to"), F.lit(False).alias("copy")), F.struct(F.col("_feeds").alias("to"), F.lit(True).alias("copy"))
    dealt = dealt.select("_id", "_o", "_text", F.explode(F.when(first, F.array(own, more)).otherwise(F.array(own))).alias("_at"))
    for (b, c), m in salted.items():
        # All rows there are equal: any one stands first in each of its ranges.
        one = key.filter((F.col("_bucket") == b) & (F.col("_cut") == c)).limit(1).withColumn("_sub", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        dealt = dealt.unionByName(one.join(ranges, at).select("_id", "_o", "_text", more.alias("_at")))
    dealt = dealt.select(F.col("_at.to").alias("_to"), F.col("_at.copy").alias("_copy"), "_id", "_text", "_o").repartition(max(n, len(places)), "_to")
    return dealt.sortWithinPartitions("_to", "_copy", F.col("_id").desc_nulls_last(), F.col("_o").desc()).select("_to", "_copy", "_id", "_text")


def edited(text: str, following: str) -> str:
    """text with its last half, rounded down, replaced by as much of the start of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PRINTS = "_id bigint, n_chars bigint, _sha binary, _f binary, _g binary, near_edited double, near_next double"


def _prints(docs: DataFrame, id: str, text: str) -> DataFrame:
    """A row per row of docs, with digests and fingerprints in binary."""
    small_batches(docs.sparkSession, 2000)

    def run(batches):
        held = None
        for batch in batches:
            rows = [*zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            rows = [held, *rows] if held else rows
            held = rows[-1]
            yield from pairs(rows)

    def pairs(rows):
        texts = [r[3] for r in rows]
        at = [i for i in range(len(rows) - 1) if not rows[i][1]]
        if not at:
            return
        changed = [edited(texts[i], texts[i + 1]) for i in at]
        prints = fingerprints(texts + changed)
        own, other, then = prints[at], prints[len(rows) :], prints[[i + 1 for i in at]]
        yield pa.RecordBatch.from_arrays([pa.array([rows[i][2] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in changed]), pa.array([x.tobytes() for x in own]), pa.array([x.tobytes() for x in other]), pa.array(likeness(own, other)), pa.array(likeness(own, then))], ["_id", "n_chars", "_sha", "_f", "_g", "near_edited", "near_next"])

    return with_next(docs, id, text).mapInArrow(run, _PRINTS)


def fingerprint_documents(docs: DataFrame, id="doc_id", text="text", least: float = LEAST) -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, rep_id, class_id, n_near.

    The next document is the one with the next smaller id; rows that share an id follow each other by a
    hash of their text. Null text counts as empty, whose fingerprint is all zero; a null id comes last.
    Fingerprints are hexadecimal. rep_id, class_id and n_near are those of near_documents(); documents
    without letters in common with others are classes of their own. An empty table gives an empty one.
    """
    prints = written(_prints(docs, id, text), "prints")
    near = near_documents(prints.select("_id", "_f"), "_id", "_f", least)
    near = written(near.filter("n_near > 0").withColumnRenamed("_f", "_of"), "near-prints")
    # The fingerprints that others are near to; the rows of hot ones can be split.
    few = near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = prints.join(F.broadcast(near) if few else near, F.col("_f") == F.col("_of"), "left")
    alone, hexed = F.col("_of").isNull(), lambda c: F.lower(F.hex(c))
    own = lambda c: F.when(alone, F.col("_id")).otherwise(F.col(c)).alias(c)
    return rows.select(F.col("_id").alias(id), "n_chars", hexed("_sha").alias("edited_sha256"), hexed("_f").alias("fingerprint"), hexed("_g").alias("edited_fingerprint"), "near_edited", "near_next", own("rep_id"), own("class_id"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"))


def band_keys(prints: np.ndarray, least: float = LEAST) -> np.ndarray:
    """prints x keys numbers, of which any two fingerprints share one that are near; what else shares one is verified."""
    order, factors, starts, has = _bands(least)
    parts = np.add.reduceat(prints[:, order] * factors, starts, axis=1)
    return mix(parts @ has + np.arange(has.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


#: Pairs up to which a bucket is compared at once. The least members of a block: a pair costs 128 bytes' comparison only.
_SMALL, _LEAST_BLOCK = 1024, 512


def _near(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which fingerprints of left and right are near."""
    if len(left) * len(right) <= _SMALL:
        same = np.count_nonzero(left[:, None] == right[None], axis=2)
    else:
        same = np.zeros((len(left), len(right)), np.uint8)
        for a, b in zip(left.T, right.T, strict=True):
            same += (a[:, None] == b[None]).view(np.uint8)
    return same >= least * SAMPLES - 1e-9


def _met(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of left and right have a key in common, at the same place."""
    if len(left) * len(right) <= _SMALL:
        return (left[:, None] == right[None]).any(axis=2)
    met = np.zeros((len(left), len(right)), bool)
    for a, b in zip(left.T, right.T, strict=True):
        met |= a[:, None] == b[None]
    return met


def _least_linked(near: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The least row that each is linked to by near ones, directly or through others, or itself."""
    to, todo = rows.copy(), near.any(axis=1)
    while todo.any():
        front, group = np.array([todo.argmax()]), np.zeros(len(rows), bool)
        group[front] = True
        while len(front):
            new = near[front].any(axis=0) & ~group
            group |= new
            front = np.flatnonzero(new)
        to[group] = rows[group].min()
        todo &= ~group
    return to


def _linked(key, band: int, own: np.ndarray, prints: np.ndarray, copies: np.ndarray, rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(copies of near ones, least row linked) for the members of a bucket, or of two of its blocks.

    Pairs that share a key before that one are left out.
    """
    left = np.flatnonzero(own == key[1])
    right = left if key[1] == key[2] else np.flatnonzero(own != key[1])
    linked, keys = np.zeros((len(rows), len(rows)), bool), None
    for k in range(0, len(left), 128):
        some = left[k : k + 128]
        near = _near(prints[some], prints[right], least)
        if right is left:
            near[np.arange(len(some)), np.arange(k, k + len(some))] = False
        if band and near.any():
            keys = band_keys(prints, least)[:, :band] if keys is None else keys
            near &= ~_met(keys[some], keys[right])
        linked[np.ix_(some, right)] = near
        if right is not left:
            linked[np.ix_(right, some)] = near.T
    return linked @ copies, _least_linked(linked, rows)


def near_documents(prints: DataFrame, id="doc_id", fingerprint="fingerprint", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """One row per distinct fingerprint: fingerprint, rep_id, class_id, n_near.

    prints: id, and fingerprint in binary. Two rows are near if at least that share of their samples is
    equal; candidates are those that share one of band_keys(), as all near pairs do, and each pair counts
    once, at the first key that it shares. n_near counts the other rows that are near, equal ones too;
    rep_id is the least id of the rows with that fingerprint, and class_id the least of all that are
    linked to it, directly or through others (null if they have null ids only). Null fingerprints are left
    out. Buckets of a key are cut into blocks, so that none becomes one task; no pair is emitted.
    """
    one = prints.select(F.col(id).alias("_i"), F.col(fingerprint).alias("_f")).filter("_f is not null").groupBy("_f").agg(F.min("_i").alias("_rep"), F.count(F.lit(1)).alias("_copies"))
    one = written(one.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")

    def explode(batches):
        for batch in batches:
            keys = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SAMPLES), least)
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), len(keys))), pa.array(keys.reshape(-1))], ["_row", "_band", "_key"])

    keyed = one.select("_row", "_f").mapInArrow(explode, "_row bigint, _band int, _key bigint")
    shared = written(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("_key").alias("_of")), "shared-bands")
    members = written(keyed.join(shared, F.col("_key") == F.col("_of")).select("_row", "_band", F.col("_key").alias("label")), "band-members")
    pairs = block_pairs(members.select(F.struct("_row", "_band").alias("node"), "label", F.lit(SAMPLES).alias("bytes")), block, least=_LEAST_BLOCK)
    work = one.select("_row", "_copies", "_f").join(pairs.select("node._row", "node._band", "label", "block", "i", "j"), "_row")
    work = work.select("label", "i", "j", "_band", "block", "_row", "_copies", "_f").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "_band")

    def verify(batches):
        key, members, ready = None, [], []

        def verified():
            own, rows, copies = (np.array([m[c] for m in members], np.int64) for c in (0, 1, 2))
            prints_ = np.frombuffer(b"".join([m[3] for m in members]), np.uint8).reshape(-1, SAMPLES)
            n, to = _linked(key, key[3], own, prints_, copies, rows, least)
            near = np.flatnonzero(n)
            if len(near):
                ready.append((rows[near], n[near], to[near]))

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*ready, strict=True)], ["_row", "n", "to"])
            ready.clear()

        for batch in batches:
            for *k, own, row, copies, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and members:
                    verified()
                    members = []
                    if len(ready) >= 1024:
                        yield from out()
                key = k
                members.append((own, row, copies, f))
        if members:
            verified()
        if ready:
            yield from out()

    found = work.mapInArrow(verify, "_row bigint, n bigint, to bigint")
    found = written(found.groupBy("_row").agg(F.sum("n").alias("n"), F.collect_set("to").alias("to")), "near")
    linked_to = components(found.select(F.col("_row").alias("a"), F.explode("to").alias("b")))
    known = one.join(found.select("_row", "n"), "_row", "left").join(linked_to.withColumnRenamed("node", "_row"), "_row", "left")
    known = written(known.select("_f", "_rep", F.coalesce("label", "_row").alias("_class"), (F.coalesce("n", F.lit(0)) + F.col("_copies") - 1).alias("n_near")), "near-classes")
    named = known.groupBy("_class").agg(F.min("_rep").alias("class_id"))
    return known.join(written(named, "near-names"), "_class").select(F.col("_f").alias(fingerprint), F.col("_rep").alias("rep_id"), "class_id", "n_near")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
