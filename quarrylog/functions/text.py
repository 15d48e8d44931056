"""Column functions for lenient number parsing, bounded copies and epoch times.

All are plain expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def lenient_bigint(c: Column) -> Column:
    """Leading blanks, a sign and digits are read, the rest is ignored; NULL where there are no
    digits or the value does not fit BIGINT."""
    return F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def clip_chars(c: Column, n: int) -> Column:
    """The first n characters (decision N4)."""
    return F.substring(c, 1, n)


def clip_bytes(c: Column, n: int) -> Column:
    """The longest prefix of at most n UTF-8 bytes that ends on a character border."""
    cut = F.substring(c.cast("binary"), 1, n)
    whole = F.octet_length(c) <= n
    # a prefix cut inside a character is trimmed by at most three bytes
    valid = [F.substring(c.cast("binary"), 1, n - k) for k in range(4)]
    picked = F.coalesce(*[F.when(F.is_valid_utf8(v.cast("string")), v.cast("string")) for v in valid])
    return F.when(whole, c).otherwise(F.when(cut.isNotNull(), picked))


def epoch_ms(ts: Column) -> Column:
    """Whole milliseconds since 1970 of a zone-less timestamp, floored; independent of the session's
    time zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    return F.floor(micros / F.lit(1000)).cast("bigint")


def from_epoch_ms(ms: Column) -> Column:
    """TIMESTAMP_NTZ of epoch milliseconds; NULL beyond the years 1 to 9999."""
    fits = ms.between(-62135596800000, 253402300799999)
    return F.when(fits, F.timestamp_add("MILLISECOND", ms, F.lit("1970-01-01").cast("timestamp_ntz")))
