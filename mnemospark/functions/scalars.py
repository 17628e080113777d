"""Identifiers, enumerations, numbers and JSON as columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import INVALID_QUERY, MemoryError_


def hash_id(*parts: Column | str) -> Column:
    """The identifier of a record: a 64-bit hash of its canonical key text."""
    return F.xxhash64(F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def to_hex(id_: Column) -> Column:
    """An identifier as 16 lower-case hexadecimal digits; their order is the unsigned order."""
    return F.lpad(F.lower(F.hex(id_)), 16, "0")


def from_hex(text: Column) -> Column:
    """The identifier of exactly 16 hexadecimal digits, else null."""
    high, low = F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.conv(F.substring(text, 9, 8), 16, 10).cast("long")
    return F.when(text.rlike("^[0-9a-f]{16}$"), F.shiftleft(high, 32).bitwiseOR(low))


def parse_id(text: str) -> int:
    """An identifier's signed value from its hexadecimal form."""
    if len(text) != 16 or any(c not in "0123456789abcdef" for c in text):
        raise MemoryError_(INVALID_QUERY, f"invalid identifier {text!r}")
    value = int(text, 16)
    return value - (1 << 64) if value >> 63 else value


def format_id(value: int) -> str:
    return f"{value & (1 << 64) - 1:016x}"


def enum_name(code: Column, names: dict[int, str], kind: str) -> Column:
    """The display name of a code; kind(code) if unknown."""
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable(names.items())))
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.concat(F.lit(f"{kind}("), code.cast("string"), F.lit(")")))


def clamp(value: Column, low: float, high: float) -> Column:
    """value within [low, high]; NaN and null count as 0."""
    clean = F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)
    return F.least(F.greatest(clean, F.lit(low)), F.lit(high))


def three_decimals(value: Column) -> Column:
    return F.format_string("%.3f", value)


def strip_fences(reply: Column) -> Column:
    """The JSON in a model's reply: without a code fence around it."""
    inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(reply))


def flexible_id(text: Column) -> Column:
    """An identifier given in decimal, else in hexadecimal digits."""
    decimal = F.when(text.rlike("^[0-9]{1,18}$"), text.cast("long"))
    return F.coalesce(decimal, from_hex(F.lower(text)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for empty, unequal or vanishing vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    scale = F.sqrt(dot(a, a) * dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale >= 1e-10)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))


def hours_between(now_ms: Column, then_ms: Column) -> Column:
    return F.greatest(now_ms - then_ms, F.lit(0)) / 3_600_000.0
