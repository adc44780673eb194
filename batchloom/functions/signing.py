"""HMAC-SHA256 and cuts at a number of bytes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.functions.dates import let

_BLOCK = 64
_HEX = "0123456789ABCDEF"


def _xored(key_hex: Column, byte: int) -> Column:
    """Every byte of a hexadecimal text combined with one byte, digit by digit."""
    other = lambda digit: "".join(_HEX[k ^ digit] for k in range(16))
    pair = lambda x: F.concat(F.translate(F.left(x, F.lit(1)), _HEX, other(byte >> 4)), F.translate(F.right(x, F.lit(1)), _HEX, other(byte & 15)))
    return F.unhex(F.array_join(F.transform(F.regexp_extract_all(key_hex, F.lit(".."), F.lit(0)), pair), ""))


def hmac_sha256(key: Column, message: Column) -> Column:
    """The code of binary ``message`` under binary ``key``, as binary."""
    short = F.when(F.octet_length(key) > _BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    padded = F.rpad(F.hex(short), 2 * _BLOCK, "0")
    digest = lambda x: F.unhex(F.sha2(x, 256))
    return let(padded, lambda k: digest(F.concat(_xored(k, 0x5C), digest(F.concat(_xored(k, 0x36), message)))))


def within_bytes(text: Column, most: int) -> Column:
    """The longest beginning of a text whose UTF-8 has at most so many bytes."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    fits = lambda n: F.octet_length(F.left(text, n)) <= most
    length = F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.length(text)) & fits(n + step), n + step).otherwise(n))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.left(text, length))
