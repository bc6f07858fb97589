"""Best-fit packing by bin-completion branch and bound.

The driver packs lengths, not documents: a histogram over at most `cap` lengths says all about the
problem, however many documents there are. A plan is a list of patterns (lengths that share a sequence)
with how often each is used. It is turned into slots by length, and each piece finds its own slot by its
rank among the pieces of its length, so that no piece moves to the driver and no group to one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import CACHE_BYTES, WordBPE, byte_alphabet, loaded, tokenizer_file
from .common import small_batches, table, written

CAP = 2048
#: Steps of the search for fewer sequences than best fit needs; what it leaves open is in the result's gap.
WORK = 1_000_000
Plan = list[tuple[tuple[int, ...], int]]


class Packing(NamedTuple):
    """A plan, and by how many sequences at most it is longer than it must be: 0 if it is known to be optimal."""

    plan: Plan
    gap: int


class LibraryWordBPE(WordBPE):
    """Ids by the library's model; pre-tokens and their cache as in WordBPE."""

    def __init__(self, data: bytes, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        super().__init__(data, most)
        self.model, self.alphabet = Tokenizer.from_buffer(data).model, dict(enumerate(byte_alphabet()))
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.strings))]

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalnum()):  # those bytes stand for themselves
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(piece)])


def lower_bound(lengths: dict[int, int], cap: int = CAP) -> int:
    """Sequences at least: what the sum needs, or the large lengths with what can't join them."""
    best = -(-sum(k * n for k, n in lengths.items()) // cap)
    keys = sorted(lengths)
    n = np.array([lengths[k] for k in keys], dtype=np.int64)
    k = np.array(keys, dtype=np.int64)
    for least in [x for x in keys if 2 * x <= cap] or [0]:
        alone, half = k > cap - least, (k <= cap - least) & (2 * k > cap)
        small = (k >= least) & (2 * k <= cap)
        room = int((n * half).sum() * cap - (n * k * half).sum())
        best = max(best, int((n * (alone | half)).sum()) + max(0, -(-(int((n * k * small).sum()) - room) // cap)))
    return best


def best_fit(lengths: dict[int, int], cap: int = CAP) -> Plan:
    """Best fit, longest first, on equal lengths and equal open sequences at once."""
    rooms: list[int] = []  # sorted
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: Plan = []

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if room == 0:
            done.append((pattern, n))
        elif n:
            if room not in open_:
                rooms.insert(bisect_left(rooms, room), room)
                open_[room] = []
            open_[room].append((pattern, n))

    for k in sorted(lengths, reverse=True):
        left = lengths[k]
        while left:
            at = bisect_left(rooms, k)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, pattern, n = cap, (), -(-left // (cap // k))
            each = room // k
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            put(room - each * k, pattern + (k,) * each, full) if full else None
            if rest:
                put(room - rest * k, pattern + (k,) * rest, 1)
            put(room, pattern, n - full - bool(rest))
            left -= full * each + rest
    return done + [x for xs in open_.values() for x in xs]


def completions(keys: list[int], counts: dict[int, int], room: int, width: int, steps: int) -> Iterator[tuple[list[tuple[int, ...]], int]]:
    """All undominated fillings of `room`, in batches, and the steps taken to find each batch.

    In an undominated filling no unused length fits beside the others, or in place of a shorter one. A
    batch is in order of waste and ends with a perfect filling, `width` fillings or `steps` steps. Keys and
    counts must be the same whenever a batch is asked for.
    """

    def dominated(waste: int, chosen: tuple[int, ...]) -> bool:
        used = Counter(chosen)
        free = lambda lo, hi: any(counts[k] > used[k] for k in keys[bisect_right(keys, lo) : bisect_right(keys, hi)])
        return waste > 0 and (free(0, waste) or any(free(c, c + waste) for c in used))

    stack, first = [(room, bisect_right(keys, room) - 1, ())], True
    while stack:
        found: list[tuple[int, tuple[int, ...]]] = []
        budget = steps
        while stack and len(found) < width and budget:
            budget -= 1
            left, at, chosen = stack.pop()
            if left == 0 or at < 0 or keys[0] > left:
                if not dominated(left, chosen):
                    found.append((left, chosen))
                    if left == 0:
                        break
                continue
            k = keys[at]
            stack.append((left, at - 1, chosen))
            most = min(left // k, counts[k])
            for m in range(1, most + 1):
                stack.append((left - m * k, min(at - 1, bisect_right(keys, left - m * k) - 1), chosen + (k,) * m))
        if first and not found:  # the steps ran out: the longest that fit
            left, chosen = room, ()
            for k in reversed(keys):
                m = min(left // k, counts[k])
                left, chosen = left - m * k, chosen + (k,) * m
            found.append((left, chosen))
        first = False
        yield [c for _, c in sorted(found)], steps - budget


def pack_lengths(lengths: dict[int, int], cap: int = CAP, work: int | None = None, width: int = 16, steps: int = 4_000) -> Packing:
    """Patterns and their numbers of uses, for lengths (1 to cap) and their counts.

    Best fit gives the first incumbent. Then, depth first: around the longest length left, the fillings
    are tried batch by batch, each as often as the counts allow, and after all of them each less often; a
    branch ends where the waste so far rules out fewer sequences than the incumbent has. The search ends
    at the lower bound, or when nothing is left to try: the incumbent is optimal. Where `work` is given, it
    ends after so many steps at the latest, with the incumbent and its gap to the lower bound. `width` and
    `steps` bound a batch: more are made when the search comes back for them.
    """
    work = float("inf") if work is None else work
    lengths = {k: n for k, n in lengths.items() if n}
    total, least = sum(k * n for k, n in lengths.items()), lower_bound(lengths, cap)
    best = best_fit(lengths, cap)
    size = lambda plan: sum(n for _, n in plan)
    counts, keys = dict(lengths), sorted(lengths)
    path: Plan = []
    waste = [0]
    frames: list = []

    def take(pattern: tuple[int, ...], n: int) -> None:
        for k, m in Counter(pattern).items():
            if counts[k] == 0:
                keys.insert(bisect_left(keys, k), k)
            counts[k] -= m * n
            if counts[k] == 0:
                keys.remove(k)

    def branch():
        nonlocal work
        longest, before = keys[-1], path[-1][0] if path else ()
        for largest in (True, False):
            batches = completions(keys, counts, cap - longest, width, steps)
            while work > 0:
                counts[longest] -= 1
                batch, used = next(batches, (None, 0))
                counts[longest] += 1
                if batch is None:
                    break
                work -= used
                for pattern in [(longest, *c) for c in batch]:
                    most = min(counts[k] // m for k, m in Counter(pattern).items())
                    if pattern != before:  # more of the same was tried above
                        yield from ((pattern, n) for n in ([most] if largest else range(most - 1, 0, -1)))

    while work > 0 and size(best) > least:
        work -= 10
        if not keys:
            if size(path) < size(best):
                best = list(path)
        elif waste[-1] <= (size(best) - 1) * cap - total:
            frames.append(branch())
        while frames:
            if len(path) == len(frames):
                pattern, n = path.pop()
                waste.pop()
                take(pattern, -n)
            if option := next(frames[-1], None):
                pattern, n = option
                take(pattern, n)
                path.append((pattern, n))
                waste.append(waste[-1] + n * (cap - sum(pattern)))
                break
            frames.pop()
        if not frames:
            return Packing(best, size(best) - least if work <= 0 else 0)
    return Packing(best, size(best) - least)


def slots(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of the length in each, offset), sorted; ranks start at 0 for each length."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern, n in plan:
        offset = 0
        for k, m in sorted(Counter(pattern).items(), reverse=True):
            rows.append((k, rank[k], sequence, m, offset))
            rank[k] += m * n
            offset += m * k
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def tokenized_pieces(docs: DataFrame, tokenizer: str, id="doc_id", text="text", cap: int = CAP) -> DataFrame:
    """Pieces of at most cap ids: id, piece, start, length, ids_crc32; part and nth number a piece among its length's in a task."""
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))

    def run(batches):
        bpe, seen, part = loaded(LibraryWordBPE, data), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = bpe.encode(t or "") + b"\0\0\0\0"
                for p, start in enumerate(range(0, len(ids), 4 * cap)):
                    own = ids[start : start + 4 * cap]
                    n = len(own) // 4
                    at.append(i)
                    rows.append((p, start // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            cols = np.array(rows, dtype=np.int64).reshape(-1, 6).T
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)], [id, "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


def pack_documents(docs: DataFrame, tokenizer: str, id="doc_id", text="text", cap: int = CAP, work: int | None = WORK) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, gap (the same in all rows, see Packing).

    Every document is its ids and id 0; null text counts as empty, so that it is the one id 0. Ids may be
    null or repeat: each row of docs is packed. Sequences have no holes; only those that no filling
    completes are shorter than cap. An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = written(tokenized_pieces(docs, tokenizer, id, text, cap), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")))
    # At most cap rows, whatever the input.
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    packing = pack_lengths(histogram, cap, work)
    at = spark.sparkContext.broadcast(slots(packing.plan))
    ranked = pieces.join(counts.select("part", "length", "base"), ["part", "length"]).select(id, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        k, first, sequence, m, offset = at.value.T
        keys = (k << 48) + first
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            s = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            i = rank - first[s]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[s] + i // m[s]), pa.array(offset[s] + i % m[s] * length)], [id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, f"`{id}` {docs.schema[id].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.withColumn("gap", F.lit(packing.gap).cast("bigint"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
