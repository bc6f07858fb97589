"""Substring dedup: matching statistics from a compressed FM-index per shard.

Equal windows of words have the same anchor: the n-gram with the least hash, at the same place in them. An
anchor that only one document has rules its windows out, so only stretches around anchors that several
documents share are routed on, each anchor's to one shard. A shard builds an FM-index (a wavelet matrix over
the Burrows-Wheeler transform) of the stretches that a later document may repeat, and streams those that an
earlier one may have through it: backward search gives the matching statistics, and a match as long as the
window reports the first document that has it. Hashes only pick anchors; an index compares words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written
from .hashing import Numbers, ngram_hashes, word_hashes

WINDOW, ANCHOR = 50, 12
#: Words of a shard, about; distinct stretches of an anchor beyond which its windows are routed one by one.
SHARD_WORDS, HOT = 400_000, 4000
#: Rows of a block of the index's minima.
_FAN = 64


class _Bits:
    """A bit vector: the bits, 64 to a word, and how many are set before each word."""

    def __init__(self, on: np.ndarray):
        self.packed = np.packbits(np.concatenate([on, np.zeros(-len(on) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class FMIndex:
    """A compressed index of sequences of numbers, each with a value, for matches up to `window` (at most 254) long.

    It keeps a wavelet matrix of the Burrows-Wheeler transform, a byte for the prefix that a suffix shares
    with the one before (cut at the window) with minima over blocks, and the least value of each distinct
    window. The suffix array itself is let go.
    """

    def __init__(self, sequences: list[np.ndarray], values: list[int], window: int):
        self.window = window
        size = np.array([len(s) for s in sequences], np.int64)
        self.size = n = int(size.sum()) + len(size)
        text = np.zeros(n, np.int64)
        keep = np.ones(n, bool)
        keep[np.cumsum(size + 1) - 1] = False
        if n:
            text[keep] = np.concatenate(sequences) + 1  # 0 ends a sequence
        order, shared = self._sort(text, len(size))
        self._wavelet(text[order - 1])
        first = shared[:-1] < window
        self._window = _Bits(first)
        self.values, value = np.unique(np.array(values, np.int64), return_inverse=True)
        owner = np.repeat(value, size + 1)[order]
        self._least = np.minimum.reduceat(owner, np.flatnonzero(first)).astype(np.int32) if n else owner
        self._tree = [shared]
        while len(self._tree[-1]) > _FAN:
            level = self._tree[-1]
            level = np.append(level, np.full(-len(level) % _FAN, 255, np.uint8)).reshape(-1, _FAN)
            self._tree[-1] = level
            self._tree.append(level.min(axis=1))
        self._tree[-1] = np.append(self._tree[-1], np.full(_FAN - len(self._tree[-1]), 255, np.uint8)).reshape(1, _FAN)

    def _sort(self, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array by prefix doubling, each of the k ends a symbol of its own, and the lengths that neighbours share."""
        n = len(text)
        rank = text + k
        rank[text == 0] = np.arange(k)
        ranks, length = {}, 1
        order = np.argsort(rank, kind="stable")
        while n:
            ordered = rank[order]
            dense = np.empty(n, np.int64)
            dense[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            if length <= self.window:
                ranks[length] = dense
            if dense[order[-1]] == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: max(0, n - length)] = dense[length:] + 1
            rank = dense * (n + 1) + after
            order, length = np.argsort(rank), 2 * length
        shared = np.zeros(n + 1, np.int64)
        a, b, at = order[:-1], order[1:], shared[1:-1]
        for p in sorted(ranks, reverse=True):
            inside = np.maximum(a, b) + at < n
            r = ranks[p]
            at += p * (inside & (r[np.minimum(a + at, n - 1)] == r[np.minimum(b + at, n - 1)]))
        return order, np.minimum(shared, self.window).astype(np.uint8)

    def _wavelet(self, bwt: np.ndarray) -> None:
        n, symbols = len(bwt), int(bwt.max(initial=0)) + 1
        self.levels = []
        x = bwt
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            on = (x >> bit & 1).astype(bool)
            self.levels.append((bit, _Bits(on), int(n - on.sum())))
            x = np.concatenate([x[~on], x[on]])
        # Where a symbol's suffixes start, less where its block starts below the last level.
        counts = np.bincount(bwt, minlength=symbols)
        block = np.zeros(symbols, np.int64)
        present = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if n else np.zeros(0, np.int64)
        block[x[present]] = present
        self.shift = np.concatenate([[0], np.cumsum(counts)[:-1]]) - block

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bounds of intervals, moved one symbol to the left."""
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at + self.shift[symbol]

    def _nearest(self, at: np.ndarray, depth: np.ndarray, left: bool) -> np.ndarray:
        """The nearest bound at or beyond each that shares less than depth with its neighbour."""
        out = at.copy()
        todo = np.flatnonzero(self._tree[0][at // _FAN, at % _FAN] >= depth)
        node, level, column = at[todo], 0, np.arange(_FAN)
        while len(todo):
            own, d = (node % _FAN)[:, None], depth[todo][:, None]
            hit = (self._tree[level][node // _FAN] < d) & (column < own if left else column > own)
            some = hit.any(axis=1)
            place = lambda h: _FAN - 1 - h[:, ::-1].argmax(axis=1) if left else h.argmax(axis=1)
            found = node[some] // _FAN * _FAN + place(hit[some])
            for below in range(level - 1, -1, -1):
                found = found * _FAN + place(self._tree[below][found] < d[some])
            out[todo[some]] = found
            todo, node, level = todo[~some], node[~some] // _FAN, level + 1
        return out

    def _widened(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of what the given ones share up to that depth."""
        lo, hi, some = np.where(depth, lo, 0), np.where(depth, hi, self.size), np.flatnonzero(depth)
        lo[some], hi[some] = self._nearest(lo[some], depth[some], True), self._nearest(hi[some], depth[some], False)
        return lo, hi

    def _shared(self, at: np.ndarray) -> np.ndarray:
        return self._tree[0][at // _FAN, at % _FAN].astype(np.int64)

    def statistics(self, sequences: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place of each sequence: (length of the longest match that starts there, at most the window; its interval's left end).

        Negative numbers match nothing. All sequences go from right to left in step. Where a match can't
        be continued, it is shortened to what its interval shares with a neighbour, until it can.
        """
        live = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        size = np.array([len(sequences[i]) for i in live], np.int64)
        start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        length, left = np.zeros(int(start[-1]), np.uint8), np.zeros(int(start[-1]), np.int32)
        flat = np.concatenate([sequences[i] for i in live]) + 1 if len(length) else np.zeros(0, np.int64)
        lo, hi, have = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64), np.zeros(len(live), np.int64)
        for t in range(1, int(size[0]) + 1 if len(length) and self.size else 1):
            n = int(np.searchsorted(-size, -t, "right"))
            at = start[:n] + size[:n] - t
            full = np.flatnonzero(have[:n] == self.window)
            have[full] -= 1
            lo[full], hi[full] = self._widened(lo[full], hi[full], have[full])
            lost = (flat[at] <= 0) | (flat[at] >= len(self.shift))
            lo[:n][lost], hi[:n][lost], have[:n][lost] = 0, self.size, 0
            todo = np.flatnonzero(~lost)
            while len(todo):
                symbol = flat[at[todo]]
                a, b = self._step(symbol, lo[todo]), self._step(symbol, hi[todo])
                ok = a < b
                lo[todo[ok]], hi[todo[ok]], have[todo[ok]] = a[ok], b[ok], have[todo[ok]] + 1
                todo = todo[~ok]
                todo = todo[have[todo] > 0]
                have[todo] = np.maximum(self._shared(lo[todo]), self._shared(hi[todo]))
                lo[todo], hi[todo] = self._widened(lo[todo], hi[todo], have[todo])
            length[at], left[at] = have[:n], lo[:n]
        out: list = [None] * len(live)
        for k, i in enumerate(live):
            out[i] = (length[start[k] : start[k + 1]], left[start[k] : start[k + 1]])
        return out

    def least(self, left: np.ndarray) -> np.ndarray:
        """The least value of the sequences that have the windows whose intervals start there."""
        return self.values[self._least[self._window.rank(left.astype(np.int64))]]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def plain(text: str | None) -> bytes:
    """A text's words with one space between."""
    return b" ".join(words_of(text))


def anchored(words: np.ndarray, window: int = WINDOW, size: int = ANCHOR):
    """(anchor, first window, end of windows) of each run of windows with one anchor."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = ngram_hashes(words, size)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - size + 1)
    at = np.concatenate([views[a : a + 8192].argmin(axis=1) + np.arange(a, min(a + 8192, len(views))) for a in range(0, len(views), 8192)])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[first]].astype(np.int64), first, np.append(first[1:], len(at))


def _digest(words: bytes) -> bytes:
    """128 bits of the BLAKE2b hash of words with one space between, for which no two different texts are known to be equal."""
    return hashlib.blake2b(words, digest_size=16).digest()


def first_documents(stretches, window: int):
    """For stretches (digest, words, least document, whether indexed, whether streamed) of a shard: (digest, runs).

    A run is (first window, end, first document that has these windows); windows that no indexed stretch
    has are in none.
    """
    numbers, split = Numbers(), [s[1].split(b" ") for s in stretches]
    indexed = [(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)), s[2]) for s, w in zip(stretches, split, strict=True) if s[3]]
    index = FMIndex([c for c, _ in indexed], [v for _, v in indexed], window)
    del indexed
    streamed = [i for i, s in enumerate(stretches) if s[4]]
    codes = [np.fromiter((numbers.get(x, -1) for x in split[i]), np.int64, len(split[i])) for i in streamed]
    for i, (length, left) in zip(streamed, index.statistics(codes), strict=True):
        at = np.flatnonzero(length == window)
        if len(at):
            doc = index.least(left[at])
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
            yield stretches[i][0], at[new], at[np.append(new[1:], len(at)) - 1] + 1, doc[new]


_NULL = (1 << 63) - 1


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(_id, _doc, _h, _text): a row is known by its id, null as the largest bigint, and a hash of its text, so that rows that share an id can be dealt out."""
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    return rows.withColumns({"_doc": F.coalesce("_id", F.lit(_NULL)), "_h": F.xxhash64("_text")})


def repeated_words(docs: DataFrame, id="doc_id", text="text", window: int = WINDOW, size: int = ANCHOR, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(_doc, _h, _seq, spans): for documents with them, the spans [start, end) of words to remove.

    _doc and _h are those of _keyed(); _seq is a digest of the words, which tells rows apart that share both.
    Copies of a whole document are settled by its digest; the first of them stands for all.
    """
    small_batches(docs.sparkSession)

    def sign(batches):
        for batch in batches:
            rows = []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                rows.append((_digest(b" ".join(words)), len(words), np.unique(anchored(word_hashes(words), window, size)[0])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *_columns(rows, pa.binary(), pa.int64(), pa.list_(pa.int64()))], ["_doc", "_h", "_seq", "_n", "_anchors"])

    base = _keyed(docs, id, text).select("_doc", "_h", "_text")
    signed = base.mapInArrow(sign, "_doc bigint, _h bigint, _seq binary, _n bigint, _anchors array<bigint>")
    signed = written(signed.filter(F.col("_n") >= window), "anchors")
    firsts = written(signed.groupBy("_seq").agg(F.min("_doc").alias("_first"), F.count(F.lit(1)).alias("_copies")).filter("_copies > 1").select("_seq", "_first"), "copies")
    copies = signed.select("_doc", "_h", "_seq", "_n").join(firsts, "_seq").filter("_doc > _first").select("_doc", "_h", "_seq", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("_n").alias("end"))).alias("spans")).distinct()
    alone = signed.join(firsts, "_seq", "left").filter("_first is null or _doc = _first").select("_doc", "_h", F.explode("_anchors").alias("_anchor"))
    shared = written(alone.groupBy("_anchor").agg(F.min("_doc").alias("lo"), F.max("_doc").alias("hi")).filter("lo < hi"), "shared-anchors")
    wanted = alone.join(shared, "_anchor").groupBy("_doc", "_h").agg(F.collect_set(F.struct("_anchor", "lo", "hi")).alias("_wanted"))
    # The text moves once, to the few anchors that it shares.
    work = base.join(wanted.hint("shuffle_hash"), ["_doc", "_h"]).select("_doc", "_h", "_text", "_wanted._anchor", "_wanted.lo", "_wanted.hi")

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, h, t, keys, los, his in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, known = words_of(t), dict(zip(keys, zip(los, his, strict=True), strict=True))
                anchors, first, end = anchored(word_hashes(parts), window, size)
                pick = np.flatnonzero(np.isin(anchors, np.array(keys, np.int64)))
                seq = _digest(b" ".join(parts))
                for k in pick.tolist():
                    key, a = int(anchors[k]), int(first[k])
                    lo, hi = known[key]
                    words = b" ".join(parts[a : int(end[k]) + window - 1])
                    rows.append((key, _digest(words), words, doc, h, seq, a, doc < hi, doc > lo))
                    if len(rows) > 4000:
                        yield stretch_batch(rows)
                        rows = []
            if rows:
                yield stretch_batch(rows)

    def stretch_batch(rows):
        return pa.RecordBatch.from_arrays(_columns(rows, pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()), ["_key", "_digest", "_words", "_doc", "_h", "_seq", "_at", "_in", "_out"])

    stretches = written(work.mapInArrow(cut, "_key bigint, _digest binary, _words binary, _doc bigint, _h bigint, _seq binary, _at bigint, _in boolean, _out boolean"), "stretches")
    # What one document has in front of the others' is indexed, what one has behind others' is streamed.
    distinct = written(stretches.groupBy("_key", "_digest", "_words").agg(F.min("_doc").alias("_least"), F.max("_doc").alias("_most"), F.max("_in").alias("_in"), F.max("_out").alias("_out")), "distinct-stretches")
    shared_hot = written(distinct.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select(F.col("_key").alias("_hot")), "hot-anchors")
    if shared_hot.isEmpty():
        runs = _search(distinct, window, shard_words)
    else:
        cool = distinct.join(shared_hot, F.col("_key") == F.col("_hot"), "left_anti")
        runs = _search(cool, window, shard_words).unionByName(_search_hot(distinct.join(shared_hot, F.col("_key") == F.col("_hot"), "left_semi"), window, shard_words))
    found = stretches.filter("_out").select("_digest", "_doc", "_h", "_seq", "_at").join(runs, "_digest").filter("doc < _doc")
    spans = found.select("_doc", "_h", "_seq", F.struct((F.col("_at") + F.col("a")).alias("start"), (F.col("_at") + F.col("b") - 1 + window).alias("end")).alias("s"))
    return spans.groupBy("_doc", "_h", "_seq").agg(F.sort_array(F.collect_set("s")).alias("spans")).unionByName(copies)


def _columns(rows: list[tuple], *kinds) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]


def _search(distinct: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(_digest, a, b, doc), written: the runs of first_documents() for distinct stretches, those of a key in one shard."""
    total = distinct.agg(F.sum(F.octet_length("_words"))).first()[0] or 0
    shards = max(1, total // (6 * shard_words) + 1)
    sharded = distinct.withColumn("_shard", F.pmod(F.xxhash64("_key"), F.lit(shards))).select("_shard", "_digest", "_words", "_least", "_in", "_out").repartition(F.col("_shard")).sortWithinPartitions("_shard")

    def search(batches):
        shard, rows = None, []

        def found():
            cols = [*zip(*first_documents(rows, window), strict=True)] or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary())] + [pa.array(c, pa.list_(pa.int64())) for c in cols[1:]], ["_digest", "a", "b", "doc"])

        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard and rows:
                    yield found()
                    rows = []
                shard = s
                rows.append(row)
        if rows:
            yield found()

    runs = sharded.mapInArrow(search, "_digest binary, a array<bigint>, b array<bigint>, doc array<bigint>")
    return written(runs.select("_digest", F.explode(F.arrays_zip("a", "b", "doc")).alias("r")).select("_digest", "r.*"), "runs")


def _search_hot(distinct: DataFrame, window: int, shard_words: int) -> DataFrame:
    """The same for anchors with many distinct stretches, whose windows are dealt out one by one.

    First only digests of windows move, until it is known which ones several documents have. Each of these
    is searched for once, in the shard of its own content, and the answers go back to the stretches.
    """

    def windows(batches):
        for batch in batches:
            rows = []
            for digest, words, least, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = words.split()
                rows += [(digest, k, _digest(b" ".join(parts[k : k + window])), least, most) for k in range(len(parts) - window + 1)]
            yield pa.RecordBatch.from_arrays(_columns(rows, pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), ["_of", "_k", "_window", "_least", "_most"])

    each = written(distinct.select("_digest", "_words", "_least", "_most").mapInArrow(windows, "_of binary, _k int, _window binary, _least bigint, _most bigint"), "hot-windows")
    common = each.groupBy("_window").agg(F.min("_least").alias("_least"), F.max("_most").alias("_most"), F.min(F.struct("_of", "_k")).alias("m")).filter("_least < _most")
    common = written(common.select("_window", "_least", "m.*"), "common-windows")
    words = F.array_join(F.slice(F.split(F.col("_words").cast("string"), " "), F.col("_k") + 1, F.lit(window)), " ").cast("binary")
    once = common.join(distinct.select(F.col("_digest").alias("_of"), "_words"), "_of").select(F.xxhash64("_window").alias("_key"), F.col("_window").alias("_digest"), words.alias("_words"), "_least", F.lit(True).alias("_in"), F.lit(True).alias("_out"))
    answers = _search(once, window, shard_words).select(F.col("_digest").alias("_window"), "doc")
    by_stretch = each.select("_of", "_k", "_window").join(answers, "_window").groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("_k", "doc"))).alias("w"))

    def joined(batches):
        for batch in batches:
            rows = []
            for digest, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, doc = np.array([w["_k"] for w in found], np.int64), np.array([w["doc"] for w in found], np.int64)
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]))
                rows += zip([digest] * len(new), at[new].tolist(), (at[np.append(new[1:], len(at)) - 1] + 1).tolist(), doc[new].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(_columns(rows, pa.binary(), pa.int64(), pa.int64(), pa.int64()), ["_digest", "a", "b", "doc"])

    return written(by_stretch.mapInArrow(joined, "_digest binary, a bigint, b bigint, doc bigint"), "hot-runs")


def substring_dedup(docs: DataFrame, id="doc_id", text="text", window: int = WINDOW, **options) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256, kept (the words that stay, one space between).

    Words are runs without space, tab or line breaks. A word goes if a window of `window` words that covers
    it starts, word for word, in a document with a smaller id too. Null text has no words; rows with equal
    ids take nothing from each other; a null id counts as the largest. Other columns are ignored.
    """
    spans = repeated_words(docs, id, text, window, **options)
    by_row = written(spans.groupBy("_doc", "_h").agg(F.collect_list(F.struct("_seq", "spans")).alias("_spans")), "spans")
    rows = _keyed(docs, id, text).join(by_row.hint("shuffle_hash"), ["_doc", "_h"], "left").select("_id", "_text", "_spans")

    def remove(batches):
        for batch in batches:
            rows = []
            for t, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, gone = plain(t), 0
                n = data.count(b" ") + 1 if data else 0
                if known and n >= window:
                    seq = _digest(data)
                    for own in known:
                        if own["_seq"] == seq:
                            parts, end, kept = data.split(b" "), 0, []
                            for s in own["spans"]:
                                kept += parts[end : max(end, s["start"])]
                                gone += max(0, s["end"] - max(end, s["start"]))
                                end = max(end, s["end"])
                            data = b" ".join(kept + parts[end:])
                rows.append((n, gone, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "surrogatepass")))
            cols = [*zip(*rows, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True))], [id, "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.mapInArrow(remove, f"`{id}` bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS m FROM x GROUP BY h HAVING count(DISTINCT doc_id) > 1),
r AS (SELECT DISTINCT doc_id, i + k AS p FROM x JOIN f USING (h), range(50) t(k) WHERE m < doc_id),
a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
g AS (SELECT doc_id, count(r.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (r.p IS NULL), '') AS kept FROM a LEFT JOIN r USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
