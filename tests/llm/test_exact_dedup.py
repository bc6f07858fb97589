import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shardloom.llm import exact_dedup as X

SCHEMA = "doc_id bigint, text string, _id string, _n int"


def corpus():
    rng = random.Random(6)
    long = ["".join(rng.choice("abcdehilpqt é\n") for _ in range(n)) for n in (300, 5000, 5000, 20000)]
    texts = [*long, *(x.upper().replace("É", "é") for x in long), *(x[:-1] for x in long), "Ä", "ä", "", None, "", "K", "k", "x" * 9000, "X" * 9000, "汉" * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, long[0]), (99, long[0]), (99, long[0]), (None, long[1]), (None, "only"), (None, "only")]
    return rows


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    keep = lambda t: max((i for i in groups[lower(t)] if i is not None), default=None)
    return [(i, keep(t), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows]


def key(r):
    return tuple((x is None, x) for x in r)


def check(spark, **options):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    got = X.exact_dedup(docs, **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute(rows), key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    out = X.keep_exact(docs, **options)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in out.collect()), key=key) == sorted(((r.doc_id, r.text_sha256) for r in kept), key=key)


def test_op8(spark):
    check(spark)


def test_clashing_names_are_told_apart(spark):
    check(spark, name=lambda c: F.pmod(F.xxhash64(c), F.lit(3)))


def test_chunks_make_up_the_text(spark):
    rows = [(i, t) for i, t in corpus() if t]
    got = spark.createDataFrame(rows, "doc_id bigint, text string").select("text", X.chunks(F.col("text")).alias("c")).collect()
    assert all(b"".join(r.c) == r.text.encode() for r in got)
    assert any(len(r.c) > 5 for r in got) and all(len(x) <= X.MAX_CHUNK for r in got for x in r.c)


@pytest.mark.parametrize(("low", "n"), [(97, 26), (0x430, 32), (0x4E00, 8000), (0x3041, 86), (0x627, 36), (0x1F600, 60)])
def test_an_edit_changes_few_chunks(spark, low, n):
    rng = random.Random(1)
    a = "".join(rng.choice([" ", chr(low + rng.randrange(n))]) if n < 100 else chr(low + rng.randrange(n)) for _ in range(40000))
    rows = spark.createDataFrame([(a,), (a[:5000] + chr(low) + a[5000:],)], "text string").select(X.chunks(F.col("text")).alias("c")).collect()
    x, y = set(rows[0].c), set(rows[1].c)
    assert len(x & y) >= 0.8 * len(x) and len(x) > 9


def test_columns_by_the_names_of_a_recipe(spark):
    docs = spark.createDataFrame([(1, "a", "mine"), (2, "a", "mine"), (3, None, "mine")], "doc_id bigint, text string, recipe string")
    rows = {r.doc_id: r for r in X.chunk_recipes(docs).collect()}
    assert rows[1].recipe == rows[2].recipe != rows[3].recipe == []
    assert X.keep_exact(docs.withColumnRenamed("recipe", "_chunks")).count() == 2 == X.keep_exact(docs.withColumnRenamed("recipe", "variants")).count()


def test_empty_table(spark):
    assert X.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
