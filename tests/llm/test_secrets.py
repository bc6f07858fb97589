import hashlib
import random
import re

from shardloom.llm import secrets as S


def brute(text):
    """The base kinds, by expressions over the whole text."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), "assign", m.end()) for m in re.finditer(assign, text, re.A | re.I) if len(m[2]) >= 6]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], S.KINDS.index(s[1])))


def token(prefix="ghp_", body="a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"):
    import zlib

    return prefix + body + S._base62(zlib.crc32(body.encode()))


def odd_texts():
    rng = random.Random(2)
    parts = ["password", "PassWord", "paſſword", "toKen", "apikey", "api_key", "=", ":", " ", '"', "'", "secret", "AKIA", "AKIAAKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "f", "é", "\U0001f600", "x", "-", "token=secret=abcdefgh", "\n"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return [*out, "", "a" * 50000, "password=" * 3000, "0" * 23, "0" * 24]


def test_base_kinds_match_brute_force():
    for t in odd_texts():
        assert [s for s in S.find_secrets(t) if s[1] in S.KINDS[:3]] == brute(t), t


def test_checksum():
    good = token()
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    assert ("github", 4, 44) in [(k, a, b) for a, k, b in S.find_secrets(f"my, {good} x")]
    assert not [s for s in S.find_secrets(f"my, {bad} x") if s[1] == "github"]
    assert not [s for s in S.find_secrets(f"my{good}") if s[1] == "github"]
    assert [s[1] for s in S.find_secrets(token("npm_"))] == ["npm"]


def test_redact():
    t = "x password=abcdefgh token = 0123456789abcdef0123456789abcdef y"
    assert S.redact(t, S.find_secrets(t)) == "x [REDACTED] [REDACTED] y"


def test_op6(spark):
    texts = [*odd_texts()[:300], None, token(), token(), "clean"]
    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, kind string")
    rows = {r.doc_id: r for r in S.scan_secrets(docs).collect()}
    for i, t in enumerate(texts):
        base = brute(t or "")
        r = rows[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base) for k in S.KINDS[:3]]
        assert r.base_sha256 == hashlib.sha256(S._joined(base).encode()).hexdigest()
    assert rows[300].redacted is None and rows[303].redacted == "clean" and rows[301].n_checked == 1
    out = S.redact_documents(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == {i: r.redacted for i, r in rows.items()}
    assert S.scan_secrets(docs.limit(0)).count() == 0
