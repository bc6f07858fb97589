"""BPE encoding and decoding: merge ranks in a priority queue over a doubly linked symbol list.

A text is taken apart at its white space; what stands between is encoded once and kept in a worker's
cache of bounded bytes. Tokenizer files are the public .json ones, read by the driver and broadcast
(their size is checked); they are never trained or written here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

MAX_FILE = 64 << 20
#: Bytes of a generation of a worker's cache, about, and characters of its longest key.
CACHE_BYTES, LONGEST = 64 << 20, 128
#: What Unicode calls white space; Python's str.split() also splits at U+001C to U+001F.
SPACE = "\t-\r \x85\xa0  -     　"
_NOT_SPACE = re.compile(f"[^{SPACE}]+")
_EXTRA = re.compile("[\x1c-\x1f]")
_POS = 32


def tokenizer_file(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MAX_FILE:
        raise ValueError(f"{path} has {len(data)} bytes, too many to broadcast")
    return data


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in keep else chr(next(free)) for b in range(256)]


class Cache(dict):
    """Calls make(key) for a missing key, a string or bytes; of the last two generations none is made again.

    A generation ends when it has about `most` bytes. Keys longer than LONGEST are made each time.
    """

    def __init__(self, make, most: int = CACHE_BYTES):
        self.make, self.most, self.old, self.size = make, most, {}, 0

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if self.size >= self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        # An entry of a table, a key and a value, of at most four bytes a character.
        self.size += 200 + 8 * len(key)
        self[key] = value
        return value


def words(text: str) -> list[str]:
    """The runs without white space."""
    return _NOT_SPACE.findall(text) if _EXTRA.search(text) else text.split()


class WordBPE:
    """A lower-casing BPE with word ends, from the bytes of its tokenizer file."""

    def __init__(self, data: bytes, most: int = CACHE_BYTES):
        spec = json.loads(data)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or model["unk_token"] or model["ignore_merges"] or spec["decoder"]:
            raise ValueError("not a tokenizer of the kind that this class encodes")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *added.values()]))
        for s, i in [*vocab.items(), *added.items()]:
            self.strings[i] = s
        alphabet = byte_alphabet()
        self.inner = [vocab.get(c) for c in alphabet]
        self.last = [vocab.get(c + end) for c in alphabet]
        self.merges = {}
        for rank, (a, b) in enumerate(x if isinstance(x, list) else x.split(" ") for x in model["merges"]):
            self.merges[vocab[a] << _POS | vocab[b]] = (rank, vocab[a + b])
        self.added = added
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.pieces = Cache(self._piece, most // 4)  # words hold the runs of a to z
        self.words = Cache(self._word, most)

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the merges in order of rank, the leftmost of equals first."""
        n, merges = len(symbols), self.merges
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        heap = []
        for i, (a, b) in enumerate(pairwise(symbols)):
            if m := merges.get(a << _POS | b):
                heap.append(m[0] << _POS | i)
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i = entry & ((1 << _POS) - 1)
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            m = merges.get(symbols[i] << _POS | symbols[j])
            if not m or m[0] != entry >> _POS:
                continue  # stale: one of the two was merged meanwhile
            symbols[i], symbols[j] = m[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(symbols[i] << _POS | symbols[k]):
                    heapq.heappush(heap, m[0] << _POS | i)
            h = before[i]
            if h >= 0 and (m := merges.get(symbols[h] << _POS | symbols[i])):
                heapq.heappush(heap, m[0] << _POS | h)
        return [s for s in symbols if s >= 0]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        inner = self.inner
        symbols = [inner[b] for b in raw[:-1]]
        symbols.append(self.last[raw[-1]])
        if len(symbols) > 1:
            symbols = self.merge([s for s in symbols if s is not None])
        return array("I", symbols).tobytes()

    def _word(self, word: str) -> bytes:
        if self.special and "<|" in word:
            parts = [x for x in self.special.split(word) if x]
            if len(parts) > 1 or parts[0] in self.added:
                return b"".join(array("I", [self.added[x]]).tobytes() if x in self.added else self._word(x) for x in parts)
        if word.isascii():
            low = word.lower()
            if low.isalpha():
                return self._piece(low) if low == word else self.words[low]
        else:
            low = unicodedata.normalize("NFC", word)
            low = "".join(c.lower() for c in low) if "Σ" in low else low.lower()
            if low.isalpha():
                return self.pieces[low]
        # Runs of a to z are words of their own, kept once.
        whole, pieces = self.words, self.pieces
        return b"".join([(whole if p.isascii() and p.isalpha() else pieces)[p] for p in self.pattern.findall(low)])

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        if text.isascii() and "<|" not in text:  # else special strings come first, and marks join letters before case goes
            text = text.lower()
        return b"".join(map(self.words.__getitem__, words(text)))

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings, with a space between, as the library joins them where no decoder is set."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict = {}


def loaded(kind, data):
    """One tokenizer a worker process and file; its caches outlive the tasks."""
    key = (kind, data.id) if hasattr(data, "id") else (kind, hash(data))
    if key not in _LOADED:
        _LOADED[key] = kind(data.value if hasattr(data, "value") else data)
    return _LOADED[key]


def encode_documents(docs: DataFrame, tokenizer: str, id="doc_id", text="text") -> DataFrame:
    """For each row: id, ids (binary, little-endian unsigned 32-bit) and decoded.

    Null text counts as empty, which has no ids and decodes to an empty string. Ids may be null or repeat,
    each row is encoded by itself; an empty table gives an empty one. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))
    key = docs.schema[id]

    def run(batches):
        bpe = loaded(WordBPE, data)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], [id, "ids", "decoded"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {key.dataType.simpleString()}, ids binary, decoded string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def bpe_digests(docs: DataFrame, tokenizer: str, id="doc_id", text="text") -> DataFrame:
    """encode_documents() with the ids and the decoded text as their SHA-256, hashed where they are made.

    Nulls, repeated rows, empty tables and other columns are as there.
    """
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))

    def run(batches):
        bpe = loaded(WordBPE, data)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], [id, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
