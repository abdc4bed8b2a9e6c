"""Bucket numbers: murmur3 (x86, 32 bits, seed 0) of a row's key as text, modulo the number of buckets, plus 1.

``bucket_sql`` is the same as a Spark expression of built-in functions, so a pseudo-column of a whole table is made
inside the JVM, with the aggregate function over a text's four-byte blocks in place of a Python worker.
"""

from __future__ import annotations

from decimal import Decimal

from ..errors import QueryError

# Fixed values of the hash function.
C1, C2, ADD, F1, F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF
BUCKETS = 30_000


def murmur3(data: bytes) -> int:
    def scrambled(k: int) -> int:
        k = k * C1 & MASK
        return (k << 15 | k >> 17) * C2 & MASK

    h, whole = 0, len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= scrambled(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & MASK) * 5 + ADD & MASK
    h ^= scrambled(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * F1 & MASK
    h = (h ^ h >> 13) * F2 & MASK
    return h ^ h >> 16


def key_text(value: object) -> str:
    """A key value as the hash reads it."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, Decimal):
        text = format(value, "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def bucket_id(values: object, buckets: int = BUCKETS) -> int:
    """The bucket of a text, or of a row's key values."""
    parts = [values] if isinstance(values, str) else list(values)  # type: ignore[call-overload]
    if not parts:
        raise QueryError("a bucket needs a key")
    return murmur3("".join(map(key_text, parts)).encode()) % buckets + 1


def _let(value: str, name: str, body: str) -> str:
    """body, with name standing for value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _times(x: str, c: int) -> str:
    """A name times a constant, modulo 2**32, without overflow of 64 bits."""
    return f"((({x} & 65535L) * {c}L + shiftleft((shiftright({x}, 16) * {c}L) & 65535L, 16)) & {MASK}L)"


def _turned(x: str, by: int) -> str:
    return f"((shiftleft({x}, {by}) | shiftright({x}, {32 - by})) & {MASK}L)"


def _scrambled(k: str) -> str:
    return _let(k, "k", _let(_times("k", C1), "m", _let(_turned("m", 15), "r", _times("r", C2))))


def _block(hexes: str, i: str) -> str:
    """Four bytes at block i, the first of which is the lowest."""
    turned = " || ".join(f"substr({hexes}, 8 * {i} + {at}, 2)" for at in (7, 5, 3, 1))
    return f"cast(conv({turned}, 16, 10) as bigint)"


def _tail(hexes: str, n: str) -> str:
    turned = " || ".join(f"substr({hexes}, 8 * ({n} div 4) + {at}, 2)" for at in (5, 3, 1))
    return f"coalesce(cast(conv(nullif({turned}, ''), 16, 10) as bigint), 0L)"


def text_sql(sql: str, kind: str) -> str:
    """A column as the hash reads it."""
    text = f"cast({sql} as string)"
    if kind in ("decimal", "number"):
        text = f"if(contains({text}, '.'), rtrim('.', rtrim('0', {text})), {text})"
    elif kind == "double":
        text = f"if({sql} = floor({sql}) AND abs({sql}) < 1e15, cast(cast({sql} as bigint) as string), {text})"
    return f"coalesce({text}, 'NULL')"


def bucket_sql(columns: list[tuple[str, str]], buckets: int = BUCKETS) -> str:
    """columns: (sql, type of the dialect) of each column of the key."""
    text = f"concat({', '.join(text_sql(*c) for c in columns)})"
    # x: the key's bytes in hexadecimal; n: their number
    mixed = _let(f"h ^ {_scrambled(_block('x', 'i'))}", "v", _let(_turned("v", 13), "w", f"((w * 5L + {ADD}L) & {MASK}L)"))
    blocks = "if(n < 4, cast(array() as array<bigint>), sequence(0L, n div 4 - 1))"
    whole = f"aggregate({blocks}, 0L, (h, i) -> {mixed})"
    h = f"({whole} ^ {_scrambled(_tail('x', 'n'))} ^ n)"
    for shift, times in ((16, F1), (13, F2)):
        h = _let(h, "h", _let(f"h ^ shiftright(h, {shift})", "v", _times("v", times)))
    h = _let(h, "h", "h ^ shiftright(h, 16)")
    return _let(f"hex(encode({text}, 'UTF-8'))", "x", _let("cast(length(x) div 2 as bigint)", "n", f"({h} % {buckets}L + 1L)"))
