"""Bit packing of small unsigned codes into ``binary`` with built-in functions.

Layout (per row of D codes in [0, 2^bits)):
  1 bit : 8 codes per byte, first code in the most significant bit; the last
          byte is zero-padded when D is not a multiple of 8.
  2 bits: 4 codes per byte, first code in the top two bits; D % 4 == 0.
  4 bits: 2 codes per byte, first code in the high nibble; D % 2 == 0.
  other : one byte per code (3, 5, 6, 7 and 8 bits).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKED_WIDTHS = (1, 2, 4)


def codes_per_byte(bits: int) -> int:
    return 8 // bits if bits in PACKED_WIDTHS else 1


def packed_len(d: int, bits: int) -> int:
    """Bytes per row of the packed form."""
    if bits == 1:
        return math.ceil(d / 8)
    if bits == 2:
        if d % 4:
            raise ValueError(f"D={d} must be divisible by 4 for 2-bit packing")
        return d // 4
    if bits == 4:
        if d % 2:
            raise ValueError(f"D={d} must be divisible by 2 for 4-bit packing")
        return d // 2
    if not 1 <= bits <= 8:
        raise ValueError(f"bits must be in 1..8, got {bits}")
    return d


def pack_hex(codes: Column, d: int, bits: int) -> Column:
    """Upper-case hex string of the packed bytes (two characters per byte).

    Each byte folds its codes most-significant first; a short last byte (1 bit,
    D not a multiple of 8) is shifted left, i.e. zero-padded on the right.
    """
    n = packed_len(d, bits)
    per = codes_per_byte(bits)
    base = 1 << bits

    def byte(b):
        part = F.slice(codes, b * per + 1, per)
        v = F.aggregate(part, F.lit(0), lambda a, x: a * base + x.cast("int"))
        pad = (F.lit(per) - F.size(part)) * bits
        return F.lpad(F.hex(v * F.pow(F.lit(2), pad).cast("int")), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), byte), "")


def pack(codes: Column, d: int, bits: int) -> Column:
    return F.unhex(pack_hex(codes, d, bits))


def unpack(packed: Column, d: int, bits: int) -> Column:
    """array<int> of the D codes held in ``packed`` (binary), truncated to D."""
    per = codes_per_byte(bits)
    mask = 1 << bits if bits in PACKED_WIDTHS else 256

    def body(h):
        def code(i):
            byte = F.conv(h.substr((F.floor(i / per) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
            shift = (F.lit(8) - (i % per + 1) * bits) if bits in PACKED_WIDTHS else F.lit(0)
            return (F.floor(byte / F.pow(F.lit(2), shift)) % mask).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), code)

    from .vectors import let
    return let(F.hex(packed), body)
