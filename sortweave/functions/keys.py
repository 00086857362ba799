"""The five orders of an 8-byte key, as sortable columns.

=====  ==========================================  =========================
order  meaning                                     sortable type
=====  ==========================================  =========================
O1     unsigned bytes, left to right (any width)   BINARY
O2     little-endian signed 64-bit integer         BIGINT
O3     big-endian signed 64-bit integer            BIGINT
O4     little-endian unsigned 64-bit integer       BIGINT with flipped sign
O5     big-endian unsigned 64-bit integer          BIGINT with flipped sign
=====  ==========================================  =========================

Unsigned orders sort on a BIGINT whose sign bit is flipped: it orders as the unsigned value does and
keeps Spark's 64-bit radix prefix sort, which DECIMAL(20,0) does not. ``unsigned_decimal`` gives the
value itself where it has to be shown or written.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGN = -(1 << 63)
ORDERS = ("O1", "O2", "O3", "O4", "O5")


def bswap64(k: Column) -> Column:
    """The BIGINT whose eight bytes are those of ``k`` in reverse."""
    out = None
    for byte in range(8):
        up = 56 - 16 * byte  # where this byte goes, in bits from where it is
        mask = F.lit(0xFF << (8 * byte)) if byte < 7 else F.lit(SIGN >> 7)
        part = F.shiftleft(k.bitwiseAND(mask), up) if up > 0 else F.shiftrightunsigned(k.bitwiseAND(mask), -up)
        out = part if out is None else out.bitwiseOR(part)
    return out


def flip_sign(k: Column) -> Column:
    """Maps signed order to unsigned order and back."""
    return k.bitwiseXOR(F.lit(SIGN))


def key_of_long(k: Column) -> Column:
    """The 8 big-endian bytes of a BIGINT, as BINARY."""
    return F.unhex(F.lpad(F.hex(k), 16, "0"))


def long_of_key(key: Column) -> Column:
    """The big-endian signed BIGINT of 8 key bytes."""
    return F.conv(F.hex(key), 16, -10).cast("bigint")


def unsigned_decimal(k: Column) -> Column:
    """The unsigned value of a BIGINT's 64 bits, as DECIMAL(20,0)."""
    wide = k.cast("decimal(20,0)")
    return F.when(k < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def clear_msb(k: Column) -> Column:
    """Clears the first bit of the first byte of a big-endian key."""
    return k.bitwiseAND(F.lit((1 << 63) - 1))


def sort_key(key: Column, order: str = "O1") -> Column:
    """What to sort by for BINARY keys; all orders but O1 need keys of 8 bytes."""
    if order == "O1":
        return key
    big = long_of_key(key)
    forms = {"O2": lambda: bswap64(big), "O3": lambda: big, "O4": lambda: flip_sign(bswap64(big)), "O5": lambda: flip_sign(big)}
    if order not in forms:
        raise ValueError(f"order must be one of {ORDERS}, not {order!r}")
    return forms[order]()


def midpoint(a: Column, b: Column) -> Column:
    """floor((a + b) / 2) without overflow."""
    return a.bitwiseAND(b) + F.shiftright(a.bitwiseXOR(b), 1)


def increment(k: Column) -> Column:
    """The next key; the 64 bits wrap around."""
    return F.when(k == F.lit((1 << 63) - 1), F.lit(SIGN)).otherwise(k + F.when(k < F.lit((1 << 63) - 1), 1).otherwise(0))


def decrement(k: Column) -> Column:
    """The key before; the 64 bits wrap around."""
    return F.when(k == F.lit(SIGN), F.lit((1 << 63) - 1)).otherwise(k - F.when(k > F.lit(SIGN), 1).otherwise(0))
