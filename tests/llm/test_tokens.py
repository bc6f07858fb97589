"""BPE, token counts and packing against the library itself."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shardloom.llm import bpe, packing, token_counts

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    letters = "aAbBéÉßΣσς'’.,!  \t\n\x1c\x1f\x85 　١٢³ⅷ½éİıſKK\U0001f600Ǆﬁ汉字‍﻿́ͅ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "a", "'s", "'S", "12", "\n"]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", "aab" * 3000, "x y" * 9000, " \n \n  a  "]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, part int, length string, n_tokens int")


def rows_of(texts):
    return [(i, t, "clash", 1, "clash", 2) for i, t in enumerate(texts)]


def test_encode_decode(odd_texts):
    lib, own = library(WORD), bpe.WordBPE(bpe.tokenizer_file(WORD))
    for t in odd_texts:
        ids, e = own.encode(t), lib.encode(t, add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == e.ids
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)


def test_cache_generations():
    made = []
    c = bpe.Cache(lambda k: made.append(k) or k, 2 * (200 + 8))
    assert [c[k] for k in "1213145671"] == [*"1213145671"]
    assert len(c) <= 2 and len(c.old) <= 2 and made == [*"12345671"]


def test_cache_is_bounded_in_bytes():
    c = bpe.Cache(lambda k: k, 10_000)
    for i in range(1000):
        assert c[f"{i:0100}"] == f"{i:0100}" and c["x" * 5000 + str(i)]
    assert sum(len(k) for k in [*c, *c.old]) < 3000


def test_op9(spark, odd_texts):
    texts = [*odd_texts[:50], None, "same", "same"]
    lib = library(WORD)
    got = {r.doc_id: r for r in bpe.bpe_digests(frame(spark, rows_of(texts)), WORD).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_digests(frame(spark, []), WORD).count() == 0
    full = bpe.encode_documents(frame(spark, rows_of(["Hello wörld"])), WORD).first()
    assert full.decoded == lib.decode(lib.encode("Hello wörld", add_special_tokens=False).ids, skip_special_tokens=False)


@pytest.mark.parametrize("most", [0, 5, token_counts.FREQUENT])
def test_op10(spark, odd_texts, most):
    texts = [*odd_texts, None, "word " * 5000]
    lib = library(BYTE)
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, rows_of(texts)), BYTE, most=most).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 1024), repr(t)
    assert token_counts.token_counts(frame(spark, []), BYTE).count() == 0


def test_long_pretokens(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("0123456789abcdef") for _ in range(600)) for _ in range(17_000)] + ["ab" * 2_500_000, "汉字" * 3000, "x" * 129, "x" * 129]
    lib = library(BYTE)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, rows_of(texts)).repartition(4), BYTE).collect()}
    assert [got[i] for i in range(len(texts))] == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_a_word_of_1_mb():
    word = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    ids = library(WORD).encode(word, add_special_tokens=False).ids
    assert bpe.WordBPE(bpe.tokenizer_file(WORD)).encode(word) == np.array(ids, "<u4").tobytes() == packing.LibraryWordBPE(bpe.tokenizer_file(WORD)).encode(word)


def test_table_is_filled_up_to_its_bytes():
    counts = Counter({"aaa": 9, "éé": 8, "bbbb": 7, "c": 6})
    assert token_counts.filled(counts, 10, 8) == {"aaa": 9, "éé": 8} and token_counts.filled(counts, 1) == {"aaa": 9}


def test_summary_keeps_the_frequent(spark):
    docs = frame(spark, rows_of([f"the word{i} the" for i in range(300)])).repartition(7)
    assert {"the", " the"} == set(token_counts.frequent_pretokens(docs, most=2))


def brute_least(items, cap):
    """The least number of bins, by trying every place for every item."""
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in {x for x in rooms if x >= items[i]}:
            k = rooms.index(r)
            go(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, cap - items[i]])

    go(0, [])
    return best[0]


def plan_ok(plan, lengths, cap):
    plan = getattr(plan, "plan", plan)
    used = Counter()
    for pattern, n in plan:
        assert n > 0 and 0 < sum(pattern) <= cap
        for k in pattern:
            used[k] += n
    assert used == lengths
    return sum(n for _, n in plan)


def test_branch_and_bound_is_optimal_on_small_inputs():
    rng = random.Random(5)
    for _ in range(80):
        cap = rng.choice([10, 17, 40])
        items = sorted((rng.randint(1, cap) for _ in range(rng.randint(0, 9))), reverse=True)
        lengths = Counter(items)
        n = plan_ok(packing.pack_lengths(lengths, cap, width=1000), lengths, cap)
        assert n == brute_least(items, cap) >= packing.lower_bound(lengths, cap)
        assert plan_ok(packing.best_fit(lengths, cap), lengths, cap) >= n


def test_search_goes_on_after_a_perfect_filling():
    lengths = Counter([51, 47, 46, 32, 28, 26, 23, 14, 13, 12, 8])
    assert sum(n for _, n in packing.best_fit(lengths, 100)) == 4
    assert plan_ok(packing.pack_lengths(lengths, 100), lengths, 100) == 3


@pytest.mark.parametrize("options", [{}, {"width": 1}, {"steps": 3}])
def test_search_is_optimal_up_to_13_items(options):
    rng = random.Random(6)
    cases = [({10: 2, 8: 7, 4: 1, 3: 3}, 30), ({16: 3, 14: 6, 6: 3}, 50)]
    for _ in range(400):
        cap = rng.choice([10, 17, 30, 50, 100])
        kinds = [rng.randint(1, cap // rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 6))]
        cases.append((dict(Counter(rng.choice(kinds) for _ in range(rng.randint(0, 13)))), cap))
    for lengths, cap in cases:
        least = brute_least(sorted(Counter(lengths).elements(), reverse=True), cap)
        found = packing.pack_lengths(lengths, cap, **options)
        assert plan_ok(found, lengths, cap) == least and found.gap == 0


def test_work_leaves_a_gap_and_none_ends_with_proof():
    lengths = {10: 2, 8: 7, 4: 1, 3: 3}
    assert packing.pack_lengths(lengths, 30, work=0).gap == 1 and plan_ok(packing.pack_lengths(lengths, 30, work=0), lengths, 30) == 4
    proven = packing.pack_lengths({6: 5}, 10)  # the bound by the sum alone would be 3
    assert (sum(n for _, n in proven.plan), proven.gap) == (5, 0)
    open_ = packing.pack_lengths({4: 4, 7: 1, 9: 2, 13: 2}, 18, work=0)
    assert open_.gap >= 0 and sum(n for _, n in open_.plan) - open_.gap == packing.lower_bound({4: 4, 7: 1, 9: 2, 13: 2}, 18)


def test_bound_and_search_beat_best_fit():
    lengths = Counter({7: 4, 6: 4, 4: 4, 3: 4, 5: 4, 2: 8})
    assert plan_ok(packing.pack_lengths(lengths, 15), lengths, 15) == packing.lower_bound(lengths, 15)


def packed_ok(got, texts, cap):
    lib = library(WORD)
    want = {}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for p, s in enumerate(range(0, len(ids), cap)):
            own = np.array(ids[s : s + cap], "<u4").tobytes()
            want[i, p] = (s, len(own) // 4, zlib.crc32(own))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in by.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= cap
    lengths = Counter(n for _, n, _ in want.values())
    assert packing.lower_bound(lengths, cap) <= len(by) == plan_ok(packing.pack_lengths(lengths, cap, packing.WORK), lengths, cap)


def test_op7(spark, odd_texts):
    texts = [*odd_texts, None, "one two", "one two", "z " * 5000]
    packed_ok(packing.pack_documents(frame(spark, rows_of(texts)).repartition(5), WORD).collect(), texts, 2048)
    packed_ok(packing.pack_documents(frame(spark, rows_of(texts[:60])), WORD, cap=16).collect(), texts[:60], 16)
    assert packing.pack_documents(frame(spark, []), WORD).count() == 0
