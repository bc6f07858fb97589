"""Secret scans: Aho-Corasick keywords first, anchored expressions near the hits, then checksums.

No expression reads a whole text. The automaton runs over it once and reports where a keyword (or four
hexadecimal digits in a row) ends; only there an expression is matched, anchored at its start.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: Kinds in the order in which equal starts are listed; the last two carry a checksum.
KINDS = ("assign", "access", "hex", "github", "npm")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CHECKED = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_GRAM = 4
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _base62(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n, 62)
        out = _DIGITS[k] + out
    return out.rjust(6, "0")


def checksum_holds(body: str) -> bool:
    """Of 36 characters the last six are the CRC-32 of the others, in base 62."""
    return _base62(zlib.crc32(body[:-6].encode())) == body[-6:]


def automaton() -> ahocorasick.Automaton:
    """Keywords in either case, the fixed prefixes, and every run of four hexadecimal digits."""
    a = ahocorasick.Automaton()
    for w in _ASSIGN_WORDS:
        for cased in product(*({c, c.upper()} for c in w)):
            a.add_word("".join(cased), ("assign", len(w)))
    a.add_word("AKIA", ("access", 4))
    for w in _CHECKED:
        a.add_word(w, (_CHECKED[w], len(w)))
    for g in product("0123456789abcdef", repeat=_GRAM):
        a.add_word("".join(g), ("hex", _GRAM))
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, in code points, by start and then by kind."""
    if not _AUTOMATON:
        _AUTOMATON.append(automaton())
    out = []
    ends = dict.fromkeys(KINDS, 0)
    for last, (kind, n) in _AUTOMATON[0].iter(text):
        start = last + 1 - n
        if start < ends[kind]:
            continue  # inside a span of this kind, or of a failing match
        if kind == "hex":
            # A run's first four digits are its first hit, so that the run starts here.
            ends[kind] = end = _HEX.match(text, start).end()
            if end - start >= 24:
                out.append((start, kind, end))
        elif kind == "assign":
            if m := _ASSIGN.match(text, start):
                ends[kind] = m.end()
                if m.end() - m.start(2) >= 6:
                    out.append((start, kind, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                ends[kind] = m.end()
                if m.end() - start >= 20:
                    out.append((start, kind, m.end()))
        elif (start == 0 or not (text[start - 1].isalnum() or text[start - 1] == "_")) and (m := _TOKEN.match(text, start)) and checksum_holds(m[1]):
            ends[kind] = m.end()
            out.append((start, kind, m.end()))
    if len(out) > 1:
        out.sort(key=lambda s: (s[0], KINDS.index(s[1])))
    return out


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, id="doc_id", text="text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, base_sha256, spans, n_checked, redacted.

    spans lists all kinds, base_sha256 the first three; n_checked counts spans whose embedded checksum
    holds. redacted is the text (null where the text is) with spans, merged where they overlap, replaced
    by [REDACTED]. Null counts as empty; ids may be null or repeat; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                spans = find_secrets(t) if t else []
                base = [s for s in spans if s[1] in KINDS[:3]]
                n = [sum(s[1] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base), redact(t, spans)))
            cols = [*zip(*rows, strict=True)] or [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked", "redacted"])

    return docs.select(id, text).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_checked bigint, redacted string")


def redact(text: str | None, spans) -> str | None:
    if not spans:
        return text
    out, end = [], 0
    for start, _, stop in spans:
        if start >= end:
            out += [text[end:start], "[REDACTED]"]
        end = max(end, stop)
    return "".join(out) + text[end:]


def redact_documents(docs: DataFrame, text="text", n_chars: str | None = None) -> DataFrame:
    """docs with secrets in its text replaced, and n_chars (a bigint column, if named) corrected where that happened; all rows and columns stay."""
    small_batches(docs.sparkSession)
    at, size = docs.columns.index(text), docs.columns.index(n_chars) if n_chars else None

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            clean = [redact(t, find_secrets(t)) if t else t for t in texts]
            batch = batch.set_column(at, text, pa.array(clean, pa.string()))
            if n_chars:
                sizes = [n if a is b else len(b) for a, b, n in zip(texts, clean, batch.column(size).to_pylist(), strict=True)]
                batch = batch.set_column(size, n_chars, pa.array(sizes, pa.int64()))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("redacted")
