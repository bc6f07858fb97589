import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from shardloom.llm import edit_embedding as E


def brute(text):
    """One step after another, one text at a time."""
    bits, out, i = E._bits(), [], 0
    cls = [*E._classes(text).tolist(), 0]
    j = 0
    while cls[i]:
        out.append(cls[i])
        i += int(bits[j % E.PERIOD][cls[i]])
        j += 1
    assert i == len(text)
    print_ = []
    for r in E._records():
        at = [p for p in r.tolist() if p < len(out)]
        print_.append(out[at[-1]] if at else 0)
    return print_


def texts(n=60):
    rng = random.Random(4)
    return ["".join(rng.choice("abcdef é汉\U0001f600\n") for _ in range(rng.choice([0, 1, 2, 5, 100, 700, 3000]))) for _ in range(n)]


def test_fingerprints_match_brute_force():
    for t in (texts(), texts(3), ["x" * 9000, "y"], [""], []):
        assert E.fingerprints(t).tolist() == [brute(x) for x in t]


def test_edits_keep_fingerprints_near():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    b = a[:2000] + "xyz" + a[2003:]
    c = a[:1000] + "inserted" + a[1000:]
    d = "".join(rng.choice("abcdefghij klmnop") for _ in range(4000))
    p = E.fingerprints([a, b, c, d])
    assert E.likeness(p[0], p[1]) > 0.8 and E.likeness(p[0], p[2]) > 0.6 and E.likeness(p[0], p[3]) < 0.25
    assert (E.fingerprints([a])[0] == p[0]).all()


def test_op3(spark):
    t = [*texts(40), None, "same text", "same text"]
    rng = random.Random(9)
    ids = rng.sample(range(-1000, 1000), len(t))
    docs = spark.createDataFrame([(i, x, "c", 1.0) for i, x in zip(ids, t, strict=True)] + [(None, "no id", "c", 1.0)], "doc_id bigint, text string, _to string, _bucket double").repartition(3)
    rows = {r.doc_id: r for r in E.fingerprint_documents(docs).collect()}
    order = [*sorted(zip(ids, t, strict=True), key=lambda x: -x[0]), (None, "no id")]
    assert len(rows) == len(order)
    for (i, x), (_, then) in zip(order, [*order[1:], order[0]], strict=True):
        x, then = x or "", then or ""
        half = len(x) // 2
        e = (x[:-half] if half else x) + then[:half]
        assert rows[i].n_chars == len(x) and rows[i].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        own, other, nxt = map(np.array, map(brute, (x, e, then)))
        assert bytes.fromhex(rows[i].fingerprint) == bytes(own.tolist()) and bytes.fromhex(rows[i].edited_fingerprint) == bytes(other.tolist())
        assert rows[i].near_edited == (own == other).mean() and rows[i].near_next == (own == nxt).mean()
    one = E.fingerprint_documents(docs.limit(0).union(spark.createDataFrame([(7, "abc", "c", 1.0)], docs.schema))).collect()
    assert one[0].near_next == 1 and one[0].n_chars == 3
    assert E.fingerprint_documents(docs.limit(0)).count() == 0
    schema = docs.schema
    twice = spark.createDataFrame([(7, "a", "c", 1.0), (7, "b", "c", 1.0), (7, "b", "c", 1.0)], schema)
    assert E.fingerprint_documents(twice).count() == 3


@pytest.mark.parametrize("same", [None, 5])
def test_many_rows_of_one_id_are_dealt_out(spark, same):
    rows = [(i, f"text {i}") for i in range(300)] + [(same, f"other {i}") for i in range(400)]
    parts = E.with_next(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).rdd.glom().collect()
    assert sum(not r[1] for p in parts for r in p) == 700 and max(map(len, parts)) < 350
    then = {}
    for p in parts:
        for a, b in itertools.pairwise(p):
            if not a[1]:
                assert a[0] == b[0]
                then[a[3]] = b[3]
    assert len(then) == 700 == len(set(then.values()))
    at, ids, of = "text 299", [], {t: i for i, t in rows}
    for _ in range(700):
        ids.append(of[at])
        at = then[at]
    assert at == "text 299" and ids == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i, reverse=True)


def test_equal_rows_of_one_id_are_dealt_out(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(None, None)] * 300 + [(None, f"other {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    parts = E.with_next(docs).rdd.glom().collect()
    assert sum(not r[1] for p in parts for r in p) == 650 and max(map(len, parts)) < 330
    pairs = Counter((a[3], b[3]) for p in parts for a, b in itertools.pairwise(p) if not a[1])
    assert pairs.total() == 650 and pairs["", ""] == 299 and pairs["text 7", "text 6"] == 1
    assert E.fingerprint_documents(docs).count() == 650


def classes(same, ids):
    """(class, near) of each fingerprint by all pairs."""
    label = list(range(len(same)))
    while (new := [min(label[j] for j in np.flatnonzero(row)) for row in same]) != label:
        label = new
    return {i: (ids[min(k for k in range(len(ids)) if label[k] == c)], int(row.sum()) - 1) for i, c, row in zip(ids, label, same, strict=True)}


def edit_distance(a, b):
    row = np.arange(len(b) + 1)
    b = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i, c in enumerate(a, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != ord(c)))
        row = np.minimum.accumulate(np.concatenate([[i], new]) - np.arange(len(row))) + np.arange(len(row))
    return int(row[-1])


def test_recall_on_families(spark):
    """Of pairs near by all samples, and of pairs near by edit distance, how many are found."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    docs, family = [], []
    for f in range(15):
        base = " ".join(word() for _ in range(250))
        for _ in range(12):
            t = base
            for _ in range(4):
                k = rng.randrange(len(t))
                t = t[:k] + rng.choice(["", "x", "yz"]) + t[k + rng.randint(0, 2) :]
            docs.append((len(docs), t))
            family.append(f)
    docs.append((len(docs), docs[5][1]))
    rows = sorted(E.fingerprint_documents(spark.createDataFrame(docs, "doc_id bigint, text string")).collect())
    p = np.array([list(bytes.fromhex(r.fingerprint)) for r in rows])
    near = (p[:, None] == p[None]).mean(axis=2) >= E.LEAST
    want, found = (near.sum() - len(p)) / 2, sum(r.n_near for r in rows) / 2
    assert want > 300 and 0.97 * want <= found <= want
    truth = classes(near, [i for i, _ in docs])
    assert sum(truth[r.doc_id][0] == r.class_id for r in rows) >= 0.97 * len(rows)
    assert {family[r.doc_id] == family[r.class_id] for r in rows[:-1]} == {True} and rows[-1].rep_id == 5
    close = [(i, j) for i in range(36) for j in range(i) if family[i] == family[j] and edit_distance(docs[i][1], docs[j][1]) <= 0.02 * len(docs[i][1])]
    assert len(close) > 150 and sum(rows[i].class_id == rows[j].class_id for i, j in close) >= 0.9 * len(close)


def test_near_documents_behind_a_template(spark):
    rng = np.random.default_rng(8)
    template = rng.integers(1, 256, E.SAMPLES)

    def change(p, share):
        return np.where(rng.random(E.SAMPLES) < share, rng.integers(1, 256, E.SAMPLES), p)

    rows = [change(template, 0.3) for _ in range(300)]  # the smaller ids: under 0.8 to nearly all others
    for _ in range(40):
        rows.append(change(template, 0.35))
        rows.append(change(rows[-1], 0.1))
    p = np.array(rows, np.uint8)
    ids = [f"id{i:04}" for i in range(len(p))]
    prints = spark.createDataFrame([*zip(ids, [x.tobytes() for x in p], strict=True), (None, bytes(E.SAMPLES)), ("id9999", None), ("id9998", p[0].tobytes())], "doc_id string, fingerprint binary")
    near = (p[:, None] == p[None]).mean(axis=2) >= E.LEAST
    keys = E.band_keys(p)
    met = near & ((keys[:, None] == keys[None]).any(axis=2))
    assert met.sum() >= 0.98 * near.sum() and met.sum() - len(p) > 60
    for block in (4, 1024):
        want = classes(met, ids)
        want["id0000"] = (want["id0000"][0], want["id0000"][1] + 1)
        got = {r.rep_id: (r.class_id, r.n_near) for r in E.near_documents(prints, block=block).collect()}
        assert got.pop(None) == (None, 0)
        linked_to_first = [i for i in ids if met[0, ids.index(i)] and i != "id0000"]
        for i in linked_to_first:
            want[i] = (want[i][0], want[i][1] + 1)
        assert got == want
    assert E.near_documents(prints.limit(0)).count() == 0


def test_no_pair_at_the_threshold_is_lost(spark):
    """Pairs that differ in as many samples as near ones may, and some in one more."""
    rng = np.random.default_rng(12)
    p = np.repeat(rng.integers(1, 256, (4000, E.SAMPLES), np.uint8), 2, axis=0)
    for k in range(1, len(p), 2):
        p[k, rng.permutation(E.SAMPLES)[: 25 + (k % 30 == 1)]] ^= 255
    prints = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(p)], "doc_id bigint, fingerprint binary")
    got = {r.rep_id: (r.class_id, r.n_near) for r in E.near_documents(prints).collect()}
    lost = [i for i in range(len(p)) if got.get(i) != ((i, 0) if i // 2 % 15 == 0 else (i - i % 2, 1))]
    assert not lost and len(got) == len(p)


def test_no_link_of_a_bucket_is_lost():
    """A chain whose rows are in any order: 6 is near 2 and 4, and 4 near no other; 9 and 3 meet through 8 and 7."""
    rows = np.array([2, 6, 4, 3, 7, 8, 9, 1], np.int64)
    rng = np.random.default_rng(14)
    p = rng.integers(1, 256, (len(rows), E.SAMPLES), np.uint8)
    for group in ((0, 1, 2), (3, 5, 4, 6)):
        for k, (a, b) in enumerate(itertools.pairwise(group)):
            p[b] = p[a]
            p[b, 20 * k : 20 * k + 20] ^= 255
    n, to = E._linked((0, 0, 0), 0, np.zeros(len(rows)), p, np.ones(len(rows), np.int64), rows, 0.8)
    assert n.tolist() == [1, 2, 1, 1, 2, 2, 1, 0] and to.tolist() == [2, 2, 2, 3, 3, 3, 3, 1]


def test_near_pairs_share_a_key():
    """Whatever the threshold, and wherever the unequal samples are."""
    rng = np.random.default_rng(13)
    for least in (0.0, 0.3, 0.5, 0.77, 0.8, 0.95, 1.0):
        differ = int(E.SAMPLES * (1 - least) + 1e-9)
        a = rng.integers(0, 256, (400, E.SAMPLES), np.uint8)
        b, order = a.copy(), E._bands(least)[0]
        for k, row in enumerate(b):
            at = rng.permutation(E.SAMPLES)[:differ] if k % 2 else order[np.linspace(0, E.SAMPLES - 1, differ).astype(int) if differ else []]
            row[at] ^= 1
        assert (E.band_keys(a, least) == E.band_keys(b, least)).any(axis=1).all()
