"""Size strings ("64KB", "1.5g") and record arithmetic, as Python helpers and as columns."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIZE = re.compile(r"^\s*(\d+(?:\.\d+)?)\s*([kmgt]?)b?\s*$", re.IGNORECASE)
_POWER = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4}


def parse_size(text: str) -> int:
    """Bytes of a size string: decimals allowed, units B/K/M/G/T with an optional B, base 1024.

    A malformed string, or one that comes to less than one byte, raises ValueError.
    """
    found = _SIZE.match(text or "")
    if not found:
        raise ValueError(f"not a size: {text!r}")
    size = int(Decimal(found[1]) * 1024 ** _POWER[found[2].lower()])
    if size <= 0:
        raise ValueError(f"a size must be positive: {text!r}")
    return size


def format_size(size: int) -> str:
    """The largest unit of which ``size`` holds at least one, with the integer part only."""
    power = min(4, max(0, (size.bit_length() - 1) // 10))
    return f"{size >> (10 * power)}{'BKMGT'[power]}"


def record_counts(total_bytes: int, key_bytes: int, value_bytes: int) -> tuple[int, int]:
    """Whole records in ``total_bytes``, and the bytes left over."""
    width = key_bytes + value_bytes
    if key_bytes <= 0 or value_bytes < 0:
        raise ValueError("key_bytes must be positive and value_bytes must not be negative")
    if total_bytes < width:
        raise ValueError(f"{total_bytes} bytes do not hold one record of {width} bytes")
    return divmod(total_bytes, width)


def size_bytes(text: Column) -> Column:
    """``parse_size`` as a BIGINT column; malformed or non-positive sizes give null."""
    pattern = r"^\s*(\d+(?:\.\d+)?)\s*([kKmMgGtT]?)[bB]?\s*$"
    number = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("decimal(18,4)")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    scale = F.lit(None).cast("bigint")
    for name, power in _POWER.items():
        scale = F.when(unit == name, F.lit(1024**power)).otherwise(scale)
    size = F.floor(number * scale.cast("decimal(18,0)")).cast("bigint")
    return F.when(size > 0, size)


def size_text(size: Column) -> Column:
    """``format_size`` as a column."""
    out = F.concat(size.cast("string"), F.lit("B"))
    for power, unit in enumerate("KMGT", 1):
        out = F.when(size >= 1 << (10 * power), F.concat(F.shiftright(size, 10 * power).cast("string"), F.lit(unit))).otherwise(out)
    return out


def records_in(total: Column, key_bytes: int, value_bytes: int) -> tuple[Column, Column]:
    """``record_counts`` as columns: whole records in a size, and the bytes left over."""
    width = F.lit(key_bytes + value_bytes)
    return F.floor(total / width).cast("bigint"), total % width


def run_count(rows: Column, run_rows: int) -> Column:
    """Runs of ``run_rows`` rows that ``rows`` rows fill, the last one perhaps in part."""
    return F.floor((rows + F.lit(run_rows - 1)) / F.lit(run_rows)).cast("bigint")


def align_down(offset: Column, unit: int = 4096) -> Column:
    return offset - F.pmod(offset, F.lit(unit))


def align_up(offset: Column, unit: int = 4096) -> Column:
    return align_down(offset + F.lit(unit - 1), unit)
