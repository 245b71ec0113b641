"""Hashes and bits as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_to_long(text: Column) -> Column:
    """Up to 16 hex digits as the 64 bits of a signed long."""
    return F.conv(text, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two longs differ."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def hex_hamming(a: Column, b: Column) -> Column:
    return hamming(hex_to_long(a), hex_to_long(b))


def sign_bits(vector: Column, first: int = 0, n: int = 32) -> Column:
    """A difference hash: a bit is set where an element is above the next one."""
    bit = lambda k: F.when(F.element_at(vector, first + k + 1) > F.element_at(vector, first + k + 2), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return sum((bit(k) for k in range(n)), F.lit(0).cast("long"))


def byte_at(content: Column, offset: int) -> Column:
    """A byte of a binary value as an int."""
    return F.conv(F.hex(F.substring(content, offset + 1, 1)), 16, 10).cast("int")


def unsigned(content: Column, offset: int, size: int, little: bool = False) -> Column:
    """``size`` bytes from ``offset`` as an unsigned long; null where they are not all there."""
    own = F.substring(content, offset + 1, size)
    text = F.hex(own)
    if little:
        text = F.concat(*[F.substring(text, 2 * k - 1, 2) for k in range(size, 0, -1)])
    return F.when(F.length(own) == size, F.conv(text, 16, 10).cast("long"))


def severity(confidence: Column) -> Column:
    """1 (most certain) to 4 from the confidence's name; 5 for any other."""
    name = F.upper(confidence)
    return F.when(name == "OBSERVED", 1).when(name == "DERIVED", 2).when(name == "INDICATIVE", 3).when(name == "INCONCLUSIVE", 4).otherwise(5)
