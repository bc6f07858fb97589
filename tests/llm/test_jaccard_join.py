import random

import numpy as np
import pytest
from test_substring_dedup import thue_morse

from shardloom.llm import components as C
from shardloom.llm import hashing as H
from shardloom.llm import jaccard_join as J


def grams(text, n=5):
    w = (text or "").lower().split()
    n = min(n, len(w)) or 1
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, least=0.8):
    sets = [grams(t) for t in texts]
    near = [{j for j in range(len(sets)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])} for i in range(len(sets))]
    label = list(range(len(sets)))
    while True:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(sets))]
        if new == label:
            return near, label
        label = new


def corpus(seed=3, families=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 8, 40, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
        texts.append("  ".join(base).upper())
    return [*texts, "", None, "   ", "one", "one", "two words", "é é é é é é", "x " * 30000]


def test_hashes_tell_words_apart():
    h = H.word_hashes("the cat  sat\ton\nthe\x0bmat é\xa0x the".encode().split()).tolist()
    assert len(h) == 8 and h[0] == h[4] == h[7] and len(set(h)) == 6
    assert len(H.word_hashes([])) == 0
    a, b = thue_morse()
    assert len(set(H.word_hashes([a.encode(), b.encode()]).tolist())) == 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_gram_numbers_match_brute_force(n):
    rng = random.Random(n)
    texts = [[rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.randint(0, 9))] for _ in range(200)] + [[]]
    number, start = H.gram_numbers(texts, n)
    known = {}
    for t, a, b in zip(texts, start.tolist(), start[1:].tolist(), strict=False):
        want = [tuple(t[i : i + n]) for i in range(max(1, len(t) - n + 1))] if t else []
        assert len(want) == b - a
        for w, got in zip(want, number[a:b].tolist(), strict=True):
            assert known.setdefault(w, got) == got
    assert len(set(known.values())) == len(known)
    assert len(H.gram_numbers([], n)[0]) == 0


def test_words_are_compared_and_not_their_hashes(spark):
    a, b = thue_morse()
    rest = " ".join(f"w{i}" for i in range(8))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{rest} {b}"), (4, f"{rest} {b}"), (5, a), (6, b)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_grams) for r in J.jaccard_join(docs).collect()) == [(1, 1, 0, 5), (2, 2, 0, 5), (3, 3, 1, 5), (4, 3, 1, 5), (5, 5, 0, 1), (6, 6, 0, 1)]
    assert [x.tolist() for x in J.linked([g for g, _ in J.gram_sets([[a.encode()], [b.encode()]])], None, 0.8)] == [[False, False], [False, False]]


def test_bands_reach_the_recall():
    for least in (0.5, 0.8, 0.9):
        b, r = J.bands_for(least)
        assert b * r <= J.HASHES and 1 - (1 - least**r) ** b >= J.RECALL


def test_band_collisions_follow_similarity():
    rng = np.random.default_rng(0)
    h, hits = J.MinHash(100, 2), 0
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
        a, b = np.unique(x[:100]), np.unique(x[50:])  # similarity 1/3
        hits += (h.band_hashes(a) == h.band_hashes(b)).mean()
    assert abs(hits / 40 - 1 / 9) < 0.03


@pytest.mark.parametrize("block", [4, 2048])
def test_op5(spark, block):
    texts = corpus()
    docs = spark.createDataFrame([(i * 7, t, "c", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, _row string, _bands int").repartition(5)
    near, label = brute(texts)
    rows = {r.doc_id // 7: r for r in J.jaccard_join(docs, block=block).collect()}
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        assert (rows[i].class_id // 7, rows[i].n_links, rows[i].n_grams) == (label[i], len(near[i]), len(grams(texts[i]) if (texts[i] or "").split() else ())), texts[i]
    kept = J.one_of_each(docs, block=block)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id // 7 for r in kept.collect()) == sorted(set(label))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in J.jaccard_join(docs).collect()) == [(0, 0, 0), (0, 1, 2), (1, 1, 2), (1, 1, 2)]
    assert J.one_of_each(docs).count() == 2
    assert J.jaccard_join(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {r.node: r.label for r in C.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    edges = [(a, b) for a, b in edges if a is not None and a != b]
    want = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
