import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from shardloom.llm import language_id as L


def test_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.op4_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 0.02 * len(rows)


def test_model_ignores_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumn("lang", F.when(L.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    a, b = L.fit_on(docs), L.fit_on(other)
    assert a.languages == b.languages and (a.vectors == b.vectors).all() and (a.idf == b.idf).all()


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, score string, _id int"
    texts = [("the old house", "en"), ("das alte Haus", "de"), ("", "en"), (None, "de"), ("123 !", "en"), ("the", None), ("the old house", "en"), ("word " * 40000, "en"), ("das Haus steht", "de")]
    docs = spark.createDataFrame([(i, t, lang, "c", 1) for i, (t, lang) in enumerate(texts)] + [(None, "das", "de", "c", 1)], schema)
    rows = {r.doc_id: r for r in L.identify(docs, L.fit_on(docs), ["doc_id", "lang"]).collect()}
    assert len(rows) == 10
    assert [rows[i].lang_pred for i in (2, 3, 4)] == [L.UNKNOWN] * 3 and rows[3].score == 0 and rows[3].rejected
    assert rows[0].lang_pred in ("en", "de") and rows[0].score == rows[6].score > 0.5
    assert set(L.keep_identified(docs).columns) == set(docs.columns)
    assert L.keep_identified(docs).filter("doc_id in (2, 3, 4)").count() == 0
    empty = docs.limit(0)
    assert L.identify(empty, L.fit_on(empty), ["doc_id"]).count() == 0
    assert L.Centroids.predict(L.fit([]), "the") == (L.UNKNOWN, 0.0)


def test_nearest_centroid_by_brute_force(spark):
    texts = [("a", "xyz zyx"), ("a", "zzz yyy"), ("b", "mno onm"), ("b", "ooo")]
    m = L.fit(texts)
    for _, t in texts:
        v = m.vector(t)
        cosines = [float(sum(x * y for x, y in zip(c.tolist(), v.tolist(), strict=True))) for c in m.vectors]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert m.predict(t)[0] == m.languages[best] and abs(m.predict(t)[1] - min(1, cosines[best])) < 1e-5


def test_unlearned_scripts_and_gibberish_are_rejected_at_any_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, rng = L.fit_on(docs), random.Random(3)
    for low, n in ((0x430, 32), (0x3B1, 25), (0x4E00, 8000), (0x3041, 86), (0xAC00, 11000), (0x627, 36), (97, 26)):
        for size in (50, 200, 1000, 5000, 20_000, 100_000):
            for _ in range(5 if size < 100_000 else 1):
                t = "".join(rng.choice([" ", *(chr(low + rng.randrange(n)) for _ in range(6))]) for _ in range(size))
                assert model.predict(t)[1] < L.LEAST, (low, size)
    held = [r.text for r in docs.filter(L.held_out("doc_id")).collect() if r.text and L.letters(r.text) is not None]
    assert all(model.predict(t)[1] >= L.LEAST for t in held) and len(held) > 200


def test_fit_in_tasks_is_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.filter(~L.held_out("doc_id")).collect() if r.lang and r.text]
    a, b = L.fit_on(docs), L.fit(rows)
    assert a.languages == b.languages and a.floors == b.floors and (a.idf == b.idf).all() and np.allclose(a.vectors, b.vectors)
    assert len(a.languages) > 4


def test_idf_and_clusters_by_brute_force():
    texts = ["abcabc abcabc abc", "abcabc abcabc abd", "xyzxyz xyzxyz xyz", "xyzxyz xyzxyz xyw"]
    m = L.fit([("a", t) for t in texts], centroids=2)
    counts = [L.ngram_counts(L.letters(t)) for t in texts]
    for d in np.flatnonzero(counts[0]):
        assert np.isclose(m.idf[d], np.log(5 / (1 + sum(c[d] != 0 for c in counts))) + 1)
    x = [v / np.linalg.norm(v) for v in (np.sign(c) * np.log1p(np.abs(c)) * m.idf for c in counts)]
    halves = [(x[0] + x[1]) / np.linalg.norm(x[0] + x[1]), (x[2] + x[3]) / np.linalg.norm(x[2] + x[3])]
    assert sorted(max(float(h @ c) for c in m.vectors) > 0.9999 for h in halves) == [True, True]


def test_foreign_texts_go_and_labelled_languages_stay(spark):
    """5 to 3,000 words: at least 95 % of foreign texts are rejected, at most 2 % of the held-out ones."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, rng = L.fit_on(docs), random.Random(5)
    for low, n in ((0x3B1, 25), (0x430, 32), (0x4E00, 8000), (0xAC00, 11000), (0x5D0, 27)):
        vocabulary = ["".join(chr(low + rng.randrange(n)) for _ in range(rng.randint(2, 9))) for _ in range(500)]
        texts = [" ".join(rng.choices(vocabulary, k=k)) for k in (5, 20, 100, 500, 3000) for _ in range(20)]
        assert sum(model.predict(t)[1] < L.LEAST for t in texts) >= 0.95 * len(texts), low
    foreign = spark.createDataFrame([(10**6, texts[-1], None, "s", 1), (10**6 + 1, None, "en", "s", 1)], docs.schema)
    kept = L.keep_identified(docs.union(foreign)).select("doc_id").collect()
    assert max(r.doc_id for r in kept) < 10**6
    assert sum(r.rejected for r in L.identify(docs.filter(L.held_out("doc_id")), model, ["doc_id"]).collect()) <= 0.02 * 250


def test_repeated_ids_and_long_texts(spark):
    long = "the old house and the river " * 50_000
    docs = spark.createDataFrame([(1, "the house", "en"), (1, "das Haus", "de"), (1, long, "en"), (1, long, "en")], "doc_id bigint, text string, lang string")
    rows = L.identify(docs, L.fit_on(docs), ["doc_id"]).collect()
    assert len(rows) == 4 and sorted(r.lang_pred for r in rows)[0] == "de" and len({r.score for r in rows}) <= 3
