"""Token counts by two tiers of lookup, without moving a pre-token between tasks.

A first pass counts the pre-tokens of all documents where they stand; each partition keeps a summary of
bounded size, and summaries are merged in two steps. The most frequent ones, with their numbers of
tokens, form a compact table that is broadcast, filled up to a bound in entries and in bytes. The second
pass adds up lengths from that table; what it lacks is encoded by the library once and kept in the worker's
cache, or each time if it is long. So the table says what is looked up where, and never what is counted.

A pre-token here is a maximal run that the tokenizer's own pattern never crosses: an optional space and
what follows up to the next white space, or a run of white space.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from math import isqrt

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CACHE_BYTES, LONGEST, SPACE, Cache, byte_alphabet, loaded, tokenizer_file
from .common import small_batches, table, written

#: The table's entries at most, and the bytes of their strings at most.
FREQUENT, MAX_TABLE = 16_384, 1 << 20
#: Distinct pre-tokens that a partition counts at once, of LONGEST characters at most; beyond it the rarer half is let go.
COUNTED = 200_000
_RUN = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Lengths:
    """Numbers of tokens of pre-tokens, by the library's byte-level BPE model."""

    def __init__(self, data: bytes, most: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("not a tokenizer of the kind that this class counts")
        self.model = Tokenizer.from_buffer(data).model
        # The byte-level pattern.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or "(?!)")
        self.cache = Cache(self._length, most)

    def _length(self, run: str) -> int:
        tokenize, alphabet = self.model.tokenize, self.alphabet
        return sum(len(tokenize(p.encode().decode("latin-1").translate(alphabet))) for p in self.pattern.findall(run))

    def count(self, text: str, known) -> int:
        """known: pre-token to length, falling back on the cache."""
        if "<|" not in text:
            return sum(map(known.__getitem__, _RUN.findall(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(known.__getitem__, _RUN.findall(p))) for p in parts)


class Known(dict):
    """The broadcast table; a missing key is looked up in the worker's cache, and not kept here."""

    def __init__(self, entries, cache: Cache):
        super().__init__(entries)
        self.cache = cache

    def __missing__(self, key):
        return self.cache[key]


def pack(lengths: dict[str, int]) -> bytes:
    return zlib.compress(json.dumps([[*lengths], [*lengths.values()]]).encode(), 1)


def unpack(data: bytes) -> dict[str, int]:
    return dict(zip(*json.loads(zlib.decompress(data)), strict=True))


def _halved(counts: Counter, most: int) -> Counter:
    return counts if len(counts) <= most else Counter(dict(counts.most_common(most // 2)))


def filled(counts: Counter, most: int, size: int = MAX_TABLE) -> dict[str, int]:
    """The most frequent ones with their counts, as many as `most` and as `size` bytes of strings allow."""
    out = {}
    for t, n in counts.most_common(most):
        size -= len(t.encode("utf-8", "surrogatepass"))
        if size < 0:
            break
        out[t] = n
    return out


def frequent_pretokens(docs: DataFrame, text="text", most: int = FREQUENT) -> dict[str, int]:
    """About the `most` most frequent pre-tokens of all documents that aren't long; which ones only affects speed."""

    def summary(part, counts):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(filled(counts, most))], pa.binary())], ["part", "summary"])

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = _RUN.findall(t or "")
                if max(map(len, found), default=0) > LONGEST:
                    found = [x for x in found if len(x) <= LONGEST]
                counts.update(found)
                if len(counts) > COUNTED:
                    counts = _halved(counts, COUNTED)
        yield summary(TaskContext.get().partitionId(), counts)

    def merge(batches):
        counts: Counter = Counter()
        for batch in batches:
            for s in batch.column("summary").to_pylist():
                counts.update(unpack(s))
                counts = _halved(counts, 4 * COUNTED)
        yield summary(0, counts)

    kind = "part int, summary binary"
    parts = written(docs.select(text).mapInArrow(count, kind), "pretoken-counts")
    n = parts.count()
    step = max(1, isqrt(n))
    merged = written(parts.repartition(step, F.col("part") % step).mapInArrow(merge, kind), "pretoken-counts")
    # One summary of bounded size is left.
    rows = merged.coalesce(1).mapInArrow(merge, kind).collect()
    return unpack(rows[0].summary) if rows else {}


def token_counts(docs: DataFrame, tokenizer: str, id="doc_id", text="text", limit: int = 1024, most: int = FREQUENT) -> DataFrame:
    """For each row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    No begin, end or added special tokens, truncation or padding; special strings inside a text count as
    the library counts them by default. Null text counts as empty. Ids may be null or repeat; an empty table
    gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    data = tokenizer_file(tokenizer)
    lengths = Lengths(data)
    packed = pack({t: lengths._length(t) for t in frequent_pretokens(docs, text, most)})
    data, frequent = spark.sparkContext.broadcast(data), spark.sparkContext.broadcast(packed)

    def run(batches):
        lengths = loaded(Lengths, data)
        known = Known(unpack(frequent.value), lengths.cache)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [lengths.count(t, known) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], [id, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
