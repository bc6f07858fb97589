"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed n-grams of its letters (one to three characters, word ends marked),
weighted by TF-IDF and normalised. The hash gives each n-gram a sign too, so that collisions cancel out
and a text in a script that was not learned has a cosine near 0, however long it is. Spherical k-means
makes a few centroids for each language; a text gets the language of the centroid with the largest cosine,
and is rejected if that is too small: under LEAST, or far under what labelled texts of the language with as
many letters have.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, table, written

#: Labelled rows per language that a model is fitted on at most, and languages at most.
SAMPLE, LANGUAGES = 600, 200
DIMS, CENTROIDS, ROUNDS = 1 << 13, 3, 12
#: Cosine under which a text is rejected.
LEAST = 0.05
#: Texts with at least so many letters and word ends are rejected under MARGIN times the QUANTILE of the cosines that a
#: language's labelled texts have when cut to that length, if FEW of them are as long; else as at the length before.
LENGTHS, MARGIN, QUANTILE, FEW = (32, 64, 256, 1024, 4096, 16384), 0.5, 0.01, 30
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter or belongs to one (a combining mark)."""
    if not _LETTER:
        import unicodedata

        _LETTER.append(np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def letters(text: str) -> np.ndarray | None:
    """Code points of the letters of a whole text, runs of other characters as one word end; None if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    if not letter.any():
        return None
    # Runs of other characters become one word end; the text is in word ends.
    code = np.where(letter, code, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[32], code[keep], [32]]).astype(np.uint64)


def ngram_counts(a: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Hashed counts of the 1- to 3-grams of letters(); those of half the n-grams count as negative."""
    mix = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)) & np.uint64(2 * dims - 1)
    one, two = a + np.uint64(1 << 50), a[:-1] << np.uint64(21) | a[1:]
    three = (a[:-2] << np.uint64(42)) ^ (a[1:-1] << np.uint64(21)) ^ a[2:] ^ np.uint64(1 << 63)
    grams = np.concatenate([mix(one[one != np.uint64(32 + (1 << 50))]), mix(two ^ np.uint64(1 << 51)), mix(three)])
    both = np.bincount(grams.astype(np.int64), minlength=2 * dims).astype(np.float32)
    return both[::2] - both[1::2]


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.copysign(np.log1p(np.abs(counts)), counts) * idf)


class Centroids:
    """A fitted model: idf, centroids, and each one's language and least cosines by length; its size depends on its parameters alone."""

    def __init__(self, idf: np.ndarray, vectors: np.ndarray, languages: list[str], floors: list[list[float]]):
        self.idf, self.vectors, self.languages, self.floors = idf, vectors, languages, floors

    def vector(self, text: str) -> np.ndarray | None:
        a = letters(text)
        return None if a is None else _weighted(ngram_counts(a, len(self.idf)), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, cosine), the cosine as 0.0 if it is too small for a text of that language and length.

        ("und", 0.0) for null, a text without letters, or a model without languages.
        """
        a = letters(text) if text and self.languages else None
        if a is None:
            return UNKNOWN, 0.0
        cosines = self.vectors @ _weighted(ngram_counts(a, len(self.idf)), self.idf)
        best = int(cosines.argmax())
        least = self.floors[best][bisect_right(LENGTHS, len(a))]
        return self.languages[best], min(1.0, float(cosines[best])) if cosines[best] >= least else 0.0


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return (x / np.where(norm == 0, 1, norm)).astype(np.float32)


def _idf(seen: np.ndarray, n: int) -> np.ndarray:
    """Weights from the number of texts that have each n-gram, of n texts."""
    return (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)


def _clustered(texts: list[np.ndarray], idf: np.ndarray, centroids: int) -> tuple[np.ndarray, list[float]]:
    """(centroids of a language's texts, by spherical k-means; least cosines by length)."""
    x = np.stack([_weighted(ngram_counts(a, len(idf)), idf) for a in texts])
    # Farthest-first starts: the mean, then what is least like the centroids so far.
    c = _unit(x.mean(axis=0, keepdims=True))
    while len(c) < min(centroids, len(x)):
        c = np.vstack([c, x[(x @ c.T).max(axis=1).argmin()][None]])
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([_unit(x[own == k].mean(axis=0)) if (own == k).any() else c[k] for k in range(len(c))])
    return c, _floors(texts, idf, c)


def _model(idf: np.ndarray, found: dict[str, tuple[np.ndarray, list[float]]]) -> Centroids:
    names = [lang for lang in sorted(found) for _ in found[lang][0]]
    vectors = np.vstack([found[lang][0] for lang in sorted(found)]) if found else np.zeros((0, len(idf)), np.float32)
    return Centroids(idf, vectors, names, [found[lang][1] for lang in names])


def fit(texts: list[tuple[str, str]], centroids: int = CENTROIDS, dims: int = DIMS) -> Centroids:
    """From (language, text) rows; texts without letters are left out."""
    coded = [(lang, a) for lang, t in sorted((lang, t) for lang, t in texts if lang is not None and t) if (a := letters(t)) is not None]
    seen = np.sum([ngram_counts(a, dims) != 0 for _, a in coded], axis=0) if coded else np.zeros(dims)
    idf = _idf(seen, len(coded))
    return _model(idf, {lang: _clustered([a for k, a in coded if k == lang], idf, centroids) for lang in {k for k, _ in coded}})


def _floors(texts: list[np.ndarray], idf: np.ndarray, centroids: np.ndarray) -> list[float]:
    """The least cosine of a text shorter than all LENGTHS, and of one at least as long as each."""
    out = [LEAST]
    for n in LENGTHS:
        cosines = [float((centroids @ _weighted(ngram_counts(a[:n], len(idf)), idf)).max()) for a in texts if len(a) >= n]
        out.append(max(LEAST, MARGIN * float(np.quantile(cosines, QUANTILE))) if len(cosines) >= FEW else out[-1])
    return out


def held_out(id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, id="doc_id", text="text", lang="lang", sample: int = SAMPLE, centroids: int = CENTROIDS, dims: int = DIMS) -> Centroids:
    """A model from at most `sample` labelled rows of each language, chosen by a hash of the id; held-out rows have no part in it.

    Null texts and languages are left out, as are texts without letters; of rows that share an id and a
    language one is taken. An empty table gives a model without languages, which rejects all texts.
    """
    base = docs.filter(~held_out(id)).select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    counts = base.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: raise LANGUAGES, which bounds what the driver fits on")
    if not counts:
        return fit([])
    # Of a language's ids those with the least hashes; a share of the hashes that holds twice as many is cut off before they are ranked.
    share = docs.sparkSession.createDataFrame([(r.lang, (2 * sample + 200) / r.n) for r in counts], "lang string, share double")
    rows = base.select("lang", "id", F.xxhash64("id").alias("h")).join(F.broadcast(share), "lang")
    rows = rows.filter(F.col("h").bitwiseAND((1 << 52) - 1) < F.col("share") * float(1 << 52))
    order = W.partitionBy("lang").orderBy(F.col("h").bitwiseAND((1 << 52) - 1), "id")
    first = written(rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample).groupBy("lang", "id").agg(F.min("n").alias("n")), "sample")
    # At most sample x LANGUAGES ids: a bounded side. Of rows that share an id the text with the least hash is taken.
    found = base.join(F.broadcast(first), ["lang", "id"]).groupBy("lang", "n").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return _fit_in_tasks(written(found.select("lang", "text"), "labelled"), len(counts), centroids, dims)


def _fit_in_tasks(labelled: DataFrame, tasks: int, centroids: int, dims: int) -> Centroids:
    """fit() on (lang, text) rows, each language in one task; the driver gets sums and centroids, never texts.

    A task holds a language's letters, of at most SAMPLE texts; no text is cut.
    """
    small_batches(labelled.sparkSession)

    def counted(batches):
        seen, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for t in batch.column(1).to_pylist():
                if (a := letters(t)) is not None:
                    seen += ngram_counts(a, dims) != 0
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()]), pa.array([n], pa.int64())], ["seen", "n"])

    def clustered(batches):
        texts: dict[str, list] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (a := letters(t)) is not None:
                    texts.setdefault(lang, []).append((t, a))
        for lang, own in texts.items():
            c, floors = _clustered([a for _, a in sorted(own, key=lambda x: x[0])], idf, centroids)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.tobytes()]), pa.array([floors], pa.list_(pa.float64()))], ["lang", "vectors", "floors"])

    # A row for each task, of dims numbers, of as many tasks as there are languages.
    by_language = labelled.repartition(tasks, "lang")
    sums = by_language.mapInArrow(counted, "seen binary, n bigint").collect()
    seen = np.sum([np.frombuffer(r.seen, np.int64) for r in sums], axis=0) if sums else np.zeros(dims)
    idf = _idf(seen, sum(r.n for r in sums))
    found = by_language.mapInArrow(clustered, "lang string, vectors binary, floors array<double>").collect()
    return _model(idf, {r.lang: (np.frombuffer(r.vectors, np.float32).reshape(-1, dims), list(r.floors)) for r in found})



def identify(docs: DataFrame, model: Centroids, columns: list[str], text="text") -> DataFrame:
    """`columns` of docs with lang_pred, score and rejected, which says that the text is too far from every centroid.

    Only the text is read for a prediction. Null and texts without letters get "und", score 0, rejected.
    """
    small_batches(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(*[F.col(c) for c in columns], F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            found = [given.value.predict(t) for t in batch.column(len(columns)).to_pylist()]
            more = [pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([s < LEAST for _, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *more], [*columns, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_on(docs)
    return identify(docs.withColumn("held_out", held_out("doc_id")), model, ["doc_id", "held_out"])


def keep_identified(docs: DataFrame, text="text", **fitted_on) -> DataFrame:
    """docs without the rows that a model fitted on them rejects: null texts, texts without letters, and those far from every centroid."""
    small_batches(docs.sparkSession)
    given, at = docs.sparkSession.sparkContext.broadcast(fit_on(docs, text=text, **fitted_on)), docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([given.value.predict(t)[1] >= LEAST for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
