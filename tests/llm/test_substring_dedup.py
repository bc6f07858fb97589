import hashlib
import random
import re

import numpy as np
import pytest

from shardloom.llm import substring_dedup as S


def brute(rows, window):
    """By all windows of all documents."""
    words = [(i if i is not None else 1 << 62, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 70, 130)]
    rows = []
    for i in range(40):
        parts = text(rng.choice([0, 3, 30, 80]))
        for _ in range(rng.randint(0, 3)):
            parts += rng.choice(passages) + text(rng.choice([0, 1, 20]))
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1].replace("\n", " ")), (102, rows[7][1] + " end"), (200, None), (201, ""), (202, "the " * 400), (203, "the " * 300), (204, "a b " * 100), (-3, " ".join(passages[4])), (205, "x\x85y z " * 60), (205, rows[9][1]), (None, rows[8][1]), (None, rows[8][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_words": 300}, {"hot": 1, "shard_words": 500}])
def test_op1(spark, options):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id bigint, text string, _doc string, kept int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_words, r.n_removed, r.kept_sha256) for r in S.substring_dedup(docs, **options).collect())
    want = sorted((i if i is not None else 1 << 62, *b) for (i, _), b in zip(rows, brute(rows, 50), strict=True))
    assert got == want and sum(r[2] for r in got) > 1000


def test_small_window_and_empty(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.substring_dedup(docs, window=8, size=3).collect())
    assert got == [(i, *b) for (i, _), b in zip(rows, brute(rows, 8), strict=True)]
    assert S.substring_dedup(docs.limit(0)).count() == 0


def prefixes(window, rows):
    where = {}
    for d, s in rows:
        for k in range(len(s)):
            for n in range(1, min(window, len(s) - k) + 1):
                key = tuple(s[k : k + n].tolist())
                where[key] = min(d, where.get(key, d))
    return where


@pytest.mark.parametrize("letters", [2, 3, 50])
def test_index_matches_brute_force(letters):
    rng = np.random.default_rng(letters)
    for _ in range(15):
        seqs = [rng.integers(0, letters, rng.integers(0, 90)) for _ in range(rng.integers(0, 12))]
        asked = seqs + [rng.integers(-1, letters + 1, rng.integers(0, 90)) for _ in range(6)]
        values = rng.permutation(len(seqs)).tolist()
        for w in (2, 5, 8):
            index = S.FMIndex(seqs, values, w)
            where = prefixes(w, zip(values, seqs, strict=True))
            for s, (length, left) in zip(asked, index.statistics(asked), strict=True):
                for k in range(len(s)):
                    n = max((n for n in range(1, min(w, len(s) - k) + 1) if tuple(s[k : k + n].tolist()) in where), default=0)
                    assert length[k] == n
                    if n == w:
                        assert index.least(left[k : k + 1])[0] == where[tuple(s[k : k + w].tolist())]


def test_large_index_widens_over_all_levels():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 3, 60)
    seqs = [np.concatenate([rng.integers(0, 3, rng.integers(0, 4)), base[: rng.integers(20, 61)], rng.integers(0, 3, 9)]) for _ in range(400)]
    index, where = S.FMIndex(seqs, [*range(400)], 12), prefixes(12, enumerate(seqs))
    assert len(index._tree) == 3
    for s, (length, left) in zip(seqs[::9], index.statistics(seqs)[::9], strict=True):
        for k in range(len(s) - 11):
            assert length[k] == 12 and index.least(left[k : k + 1])[0] == where[tuple(s[k : k + 12].tolist())]
    for length, _ in index.statistics([np.full(40, 7), np.zeros(0, np.int64)]):
        assert not length.any()


def thue_morse():
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_are_compared_and_not_their_hashes(spark):
    a, b = thue_morse()
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest} end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in S.substring_dedup(docs).collect()) == [(1, 50, 0), (2, 50, 0), (3, 51, 50)]
    stretches = [(bytes([i]), S.plain(t), i, True, True) for i, t in rows]
    assert {(d[0], tuple(doc)) for d, _, _, doc in S.first_documents(stretches, 50)} == {(1, (1,)), (2, (2,)), (3, (2, 3))}


def test_many_null_ids_and_a_document_that_repeats_an_anchor(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(None, f"n{i} {line}") for i in range(30)] + [(1, " ".join(f"x{i} {line}" for i in range(40)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for hot in (10, 4000):
        got = sorted((r.doc_id is None, r.n_words, r.n_removed) for r in S.substring_dedup(docs, hot=hot).collect())
        assert got == [(False, 40 * 61, 0)] + [(True, 61, 60)] * 30
