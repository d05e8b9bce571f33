"""Log positions: 64-bit numbers with the text form ``HI/LO`` in upper-case hex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end of the log: an open row version lives up to here.
HEAD = 2**63 - 1


def parse_lsn(text: str) -> int:
    """``1/2A05F200`` as a number. Raises ValueError for anything else and for positions beyond HEAD."""
    high, slash, low = text.strip().partition("/")
    if not slash or not high or not low or len(low) > 8 or len(high) > 8:
        raise ValueError(f"not a log position: {text!r}")
    value = int(high, 16) << 32 | int(low, 16)
    if value > HEAD:
        raise ValueError(f"log position beyond 2^63 - 1: {text!r}")
    return value


def format_lsn(lsn: int) -> str:
    return f"{lsn >> 32:X}/{lsn & 0xFFFFFFFF:X}"


def lsn_column(text: Column) -> Column:
    high = F.conv(F.substring_index(text, "/", 1), 16, 10).cast("bigint")
    low = F.conv(F.substring_index(text, "/", -1), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low)


def lsn_text(lsn: Column) -> Column:
    return F.concat(F.hex(F.shiftright(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF))))
