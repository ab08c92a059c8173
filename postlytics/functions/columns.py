"""Scalar helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlytics.session import cut_lineage

# A plain decimal number: what pandas' to_numeric accepts after the
# thousands separators and unit signs are gone.  Spark's own cast also takes
# suffixes such as ``1.0d`` or ``1f``, so every text cast is guarded by it.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def rint_round(c: Column | str, digits: int) -> Column:
    """Round half-to-even on the scaled double, as NumPy/pandas ``round`` do.

    ``F.round`` rounds half-up on the decimal value and disagrees on ties.
    """
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def safe_div(num: Column, den: Column) -> Column:
    """num / den with a zero denominator giving null (pandas ``replace(0, nan)``)."""
    return num / F.nullif(den, F.lit(0.0))


#: Unicode white space, as text functions of most languages strip it.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
                                0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any kind (tabs, no-break spaces) at either end."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def strip_number_text(c: Column) -> Column:
    """Remove ``, % $`` and surrounding white space; blank text becomes null."""
    s = strip(F.regexp_replace(c, r"[,%$]", ""))
    return F.when(s == "", None).otherwise(s)


def to_double_guarded(s: Column) -> Column:
    """Text to double only when it is a plain number, else null (never raises)."""
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def ntz_text(c: Column | str, style: str = "iso") -> Column:
    """Wall-clock text of a timestamp, independent of the session time zone.

    (``date_format`` routes through the session zone and moves wall times that
    fall in a daylight-saving gap.)  ``style``: ``iso`` = yyyy-MM-dd HH:mm:ss,
    ``dmy`` = dd/MM/yyyy HH:mm:ss, ``date`` = yyyy-MM-dd.
    """
    c = F.col(c) if isinstance(c, str) else c
    if style == "date":
        return c.cast("date").cast("string")
    parts = [F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c), F.floor(F.second(c)).cast("int")]
    if style == "iso":
        return F.format_string("%04d-%02d-%02d %02d:%02d:%02d", *parts)
    if style == "dmy":
        y, mo, d, h, mi, s = parts
        return F.format_string("%02d/%02d/%04d %02d:%02d:%02d", d, mo, y, h, mi, s)
    raise ValueError(style)


#: Groups a per-group table may have to be sent to all tasks; each is a key and a few numbers.
MAX_BROADCAST_GROUPS = 100_000


def broadcast_groups(groups: DataFrame) -> DataFrame:
    """A per-group table, broadcast after its rows are counted, so that raw rows
    need no shuffle on a key of a few values.  Beyond the bound no value is hot
    by its number alone and the join is left to Spark (with AQE's skew splits)."""
    rows = cut_lineage(groups)
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_GROUPS else rows
