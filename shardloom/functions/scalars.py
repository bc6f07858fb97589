"""Scalar helpers: labels, names, parsing, hashes, half precision, 32-bit arithmetic."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

_M32, _M64 = (1 << 32) - 1, (1 << 64) - 1
#: FNV-1a, 64 bits.
FNV_SEED, FNV_PRIME = 1469598103934665603, 1099511628211
#: What a flag field may say; an empty one is false.
TRUE, FALSE = ("1", "true", "TRUE", "yes", "YES"), ("0", "false", "FALSE", "no", "NO", "")


def sanitize_label(label: Column, fallback: str) -> Column:
    """Letters, digits, "_", "." and "-" stay, others become "_"; none at the ends; the fallback for what is left empty."""
    kept = F.regexp_replace(F.coalesce(label, F.lit("")), "[^A-Za-z0-9_.-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "^_+|_+$", ""), F.lit("")), F.lit(fallback))


def default_name(name: Column, prefix: str, index: Column) -> Column:
    """prefix and the index where the name is empty or missing."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.concat(F.lit(prefix), index.cast("string"))).otherwise(name)


def parse_count(text: Column) -> Column:
    """A number that is not negative; 0 if empty, null if it is no number."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.lit(0).cast("bigint")).when(t.rlike("^[0-9]+$"), t.try_cast("bigint"))


def parse_flag(text: Column) -> Column:
    """A boolean; null if the text says neither."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def fnv1a(data: bytes, state: int = FNV_SEED) -> int:
    for b in data:
        state = (state ^ b) * FNV_PRIME & _M64
    return state


def feature_order_hash(ids: Iterable[str]) -> int:
    """FNV-1a over the ids in order, a zero byte after each."""
    state = FNV_SEED
    for i in ids:
        state = fnv1a(i.encode() + b"\0", state)
    return state


@F.pandas_udf(FloatType())
def half(values: pd.Series) -> pd.Series:
    """Values rounded to half precision, ties to even; what is too large becomes infinite."""
    import numpy as np

    with np.errstate(over="ignore"):
        return values.astype("float32").astype("float16").astype("float32")


def add_u32(a: Column, b: Column) -> Column:
    return (a + b).bitwiseAND(_M32)


def sub_u32(a: Column, b: Column) -> Column:
    return (a - b).bitwiseAND(_M32)


def mul_u32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product; the factors are split so that it fits 64 bits."""
    low = (a * b.bitwiseAND(0xFFFF)).bitwiseAND(_M32)
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(_M32)


def mad_u32(a: Column, b: Column, c: Column) -> Column:
    return add_u32(mul_u32(a, b), c)


def pack_blocked_aux(width: int, block: int) -> int:
    return width << 16 | block


def unpack_blocked_aux(aux: int) -> tuple[int, int]:
    return aux >> 16, aux & 0xFFFF


def pack_sliced_aux(slots: int, slices: int) -> int:
    return slots << 32 | slices


def unpack_sliced_aux(aux: int) -> tuple[int, int]:
    return aux >> 32, aux & _M32
