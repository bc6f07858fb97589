"""Similarity join on word n-gram sets: MinHash banding, then verification on the full sets.

Texts with the same words are one class from the start. Classes that share a band meet only by number: each
names the least of its bucket, and the components of those stars hold every candidate pair. Each class of a
component of two or more is then moved once, with its text, to where all pairs of the component are
verified on n-grams compared word for word; nothing is emitted per pair, but a count for each class and the
component it is in. Larger components are cut into blocks, and the pairs of blocks spread over tasks.
Hashes only find candidates.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered_columns, small_batches, table, without, written
from .components import BLOCK, block_pairs, components
from .hashing import gram_numbers, mix, ngram_hashes, word_hashes

WORDS, LEAST, RECALL, HASHES = 5, 0.8, 0.999, 320
_SLAB = 2048


def bands_for(least: float = LEAST, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, and so the fewest false candidates, with which a pair at the threshold is found with that probability."""
    fits = [(ceil(log(1 - recall) / log(1 - least**r)), r) for r in range(1, 33) if least < 1]
    return max(((b, r) for b, r in fits if b * r <= hashes), key=lambda x: x[1], default=(1, 1))


def lower_words(text: str | None) -> list[bytes]:
    """A text's words, in lower case."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def gram_sets(texts: list[list[bytes]], n: int = WORDS) -> list[np.ndarray]:
    """For each text, given by its words, where its distinct n-grams stand first, and their numbers: equal ones are equal word for word."""
    number, start = gram_numbers(texts, n)
    return [np.unique(number[a:b], return_index=True) for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.odd = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.join = rng.integers(0, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each band; two sets share it with their similarity to the power of the rows."""
        x = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.odd), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(x), 2048):
            np.minimum(least, (self.odd[:, None] * x[None, a : a + 2048]).min(axis=1), out=least)
        sums = (least.reshape(self.bands, self.rows).astype(np.uint64) * self.join).sum(axis=1, dtype=np.uint64)
        return mix(sums + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right (or of left)."""
    sets = left + (right or [])
    flat = np.concatenate(sets)
    _, gram, n = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = n > 1  # the others are in one set only
    number = np.cumsum(common) - 1
    keep = common[gram]
    gram, owner = number[gram[keep]], owner[keep]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    k = len(left)
    out = np.zeros((k, len(right) if right else k), np.float32)
    for a in range(0, int(common.sum()), _SLAB):
        lo, hi = np.searchsorted(gram, [a, a + _SLAB])
        x = np.zeros((len(sets), _SLAB), np.float32)
        x[owner[lo:hi], gram[lo:hi] - a] = 1
        out += x[:k] @ (x[k:] if right else x).T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least `least`."""
    shared = shared_counts(left, right).astype(np.float64)
    size = lambda sets: np.array([len(s) for s in sets], np.float64)
    either = size(left)[:, None] + size(right or left)[None] - shared
    out = shared >= least * either - 1e-9
    if right is None:
        np.fill_diagonal(out, False)
    return out


def _labels(links: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of rows (ids), the least id of its component under the symmetric matrix."""
    out = rows.copy()
    a, b = np.nonzero(links)
    while len(a):
        new = out.copy()
        np.minimum.at(new, a, out[b])
        if (new == out).all():
            break
        out = new
    return out


def _verify(key, members, words: int, least: float):
    """(row, links, to, many) for the members (row, copies, block, text) of a component or of two of its blocks."""
    rows, copies = np.array([m[0] for m in members], np.int64), np.array([m[1] for m in members], np.int64)
    sets = [grams for grams, _ in gram_sets([lower_words(m[3]) for m in members], words)]
    if key[1] == key[2]:
        links = linked(sets, None, least)
    else:
        first = np.array([m[2] == key[1] for m in members])
        i, j = np.flatnonzero(first), np.flatnonzero(~first)
        links = np.zeros((len(members), len(members)), bool)
        if len(i) and len(j):
            cross = linked([sets[x] for x in i], [sets[x] for x in j], least)
            links[np.ix_(i, j)], links[np.ix_(j, i)] = cross, cross.T
    return rows, links @ copies, _labels(links, rows)


def near_classes(docs: DataFrame, text="text", words: int = WORDS, least: float = LEAST, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(docs with _row, written; for each _row: _grams, the size of its n-gram set, _class and _links).

    _row numbers the rows. Two rows are linked if their sets' Jaccard similarity is at least `least`;
    _links counts the other rows so linked, _class is the least _row of the component of links. A text
    with fewer words than an n-gram has is one n-gram; null and texts without words have none, and no
    links. Names that start with an underscore are taken.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hasher, at = MinHash(*bands_for(least, recall)), docs.columns.index(text)
    names = [*docs.columns, "_set", "_grams", "_bands"]

    def sign(batches):
        import hashlib

        for batch in batches:
            rows, texts = [], [lower_words(t) for t in batch.column(at).to_pylist()]
            for w, (_, first) in zip(texts, gram_sets(texts, words), strict=True):
                grams = ngram_hashes(word_hashes(w), words)[first]
                rows.append((hashlib.blake2b(b" ".join(w), digest_size=16).digest(), len(first), hasher.band_hashes(grams)) if w else (None, 0, None))
            more = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    rows = docs.mapInArrow(sign, f"{kinds}, _set binary, _grams bigint, _bands array<bigint>")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "signed")
    sets = written(rows.filter("_set is not null").groupBy("_set").agg(F.min(F.struct("_row", "_bands", F.octet_length(text).alias("_bytes"))).alias("m"), F.count(F.lit(1)).alias("_copies")).select("_set", F.col("m._row").alias("_rep"), "m._bands", "m._bytes", "_copies"), "gram-sets")
    banded = sets.select("_rep", F.explode("_bands").alias("_band"))
    stars = banded.groupBy("_band").agg(F.min("_rep").alias("_hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_band", "_hub")
    candidates = components(banded.join(stars, "_band").select(F.col("_rep").alias("a"), F.col("_hub").alias("b")))
    members = written(candidates.withColumnRenamed("node", "_rep").join(sets.select("_rep", "_copies", "_bytes"), "_rep"), "members")
    pairs = block_pairs(members.select(F.col("_rep").alias("node"), "label", F.col("_bytes").alias("bytes")), block)
    pairs = pairs.join(members.select(F.col("_rep").alias("node"), "_copies"), "node")
    work = rows.select("_row", F.col(text).alias("_text")).join(pairs.hint("shuffle_hash"), F.col("_row") == F.col("node"))
    work = work.select("label", "i", "j", "_row", "_copies", "block", "_text").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")

    def verify(batches):
        key, members = None, []

        def out():
            r, n, to = _verify(key, members, words, least)
            return pa.RecordBatch.from_arrays([pa.array(r), pa.array(n.astype(np.int64)), pa.array(to)], ["_rep", "n", "to"])

        for batch in batches:
            for *k, row, copies, own, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and members:
                    yield out()
                    members = []
                key = k
                members.append((row, copies, own, t))
        if members:
            yield out()

    found = written(work.mapInArrow(verify, "_rep bigint, n bigint, to bigint"), "verified")
    linked_to = components(found.filter("_rep != to").select(F.col("_rep").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("_rep").agg(F.sum("n").alias("n"))
    by_set = sets.select("_set", "_rep", "_copies").join(counts, "_rep", "left").join(linked_to.withColumnRenamed("node", "_rep"), "_rep", "left")
    by_set = written(by_set.select(F.col("_set").alias("_of"), F.coalesce("label", "_rep").alias("_class"), (F.coalesce("n", F.lit(0).cast("bigint")) + F.col("_copies") - 1).alias("_links")), "classes")
    narrow = rows.select("_row", "_grams", "_set")
    known = narrow.filter("_set is not null").join(by_set, F.col("_set") == F.col("_of")).select("_row", "_grams", "_class", "_links")
    alone = narrow.filter("_set is null").select("_row", "_grams", F.col("_row").alias("_class"), F.lit(0).cast("bigint").alias("_links"))
    return rows.select(*docs.columns, "_row"), known.unionByName(alone)


def jaccard_join(docs: DataFrame, id="doc_id", text="text", **options) -> DataFrame:
    """One row per row of docs: id, class_id, n_links, n_grams; class_id is the least id of the component (null if it has null ids only)."""
    rows, classes = near_classes(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), **options)
    near = written(rows.select("id", "_row").join(classes, "_row"), "near")
    least = written(near.groupBy("_class").agg(F.min("id").alias("class_id")), "class-ids")
    return near.join(least, "_class").select(F.col("id").alias(id), "class_id", F.col("_links").alias("n_links"), F.col("_grams").alias("n_grams"))


def one_of_each(docs: DataFrame, id="doc_id", text="text", **options) -> DataFrame:
    """docs with one row of each component: that of the least id, of repeated ones the first. Rows without n-grams all stay."""
    names = docs.columns
    docs, (id, text) = numbered_columns(docs, id, text)
    rows, classes = near_classes(docs, text, **options)
    near = written(rows.select(F.col(id).alias("_id"), "_row").join(classes, "_row"), "near")
    first = near.groupBy("_class").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), "_row"))["_row"].alias("_first"))
    dropped = written(near.join(written(first, "firsts"), "_class").filter("_row != _first").select("_row"), "near-copies")
    return without(rows, dropped, ["_row"]).select(docs.columns).toDF(*names)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * s >= 4 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(d, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.d, e.b FROM c JOIN e ON e.a = c.r)
SELECT d AS doc_id, min(r) AS class_id, coalesce(any_value(k), 0) AS n_links, coalesce(any_value(n.n), 0) AS n_grams
FROM c LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY 1) ON a = d LEFT JOIN n ON n.doc_id = d GROUP BY 1
"""
