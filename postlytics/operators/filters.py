"""Row filters and labels (P21-P27): all plain ``where`` / ``when`` expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlytics.operators.features import ER, Prepared
from postlytics.operators.stats import duration_rows, reel_rows


def reel_filter(pre: Prepared) -> DataFrame:
    """Reels / videos only."""
    return reel_rows(pre)


def duration_filter(pre: Prepared, lo: float = 3.0, hi: float = 90.0, lo_inclusive: bool = False) -> DataFrame:
    """Library bound ``3 < d <= 90``; the notebook's ``3 <= d <= 180`` via parameters."""
    return duration_rows(pre, lo, hi, lo_inclusive)


def period(is_weekend: Column | None = None) -> Column:
    """Weekend / Weekday label."""
    wk = is_weekend if is_weekend is not None else F.col("is_weekend")
    return F.when(wk, F.lit("Weekend")).otherwise(F.lit("Weekday"))


def complete_cases(pre: Prepared, subset: list[str] | None = None) -> DataFrame:
    """P25 report: rows before and after dropping incomplete cases (one aggregate)."""
    r = pre.roles
    if subset is None:
        subset = [c for c in (r.reach, r.views, r.likes, r.comments, r.saves, r.shares, r.follows, r.type)
                  if c] + [c for c in ("weekday", "hour") if c in pre.df.columns] + [ER]
    complete = F.lit(True)
    for c in subset:
        complete = complete & F.col(c).isNotNull()
    return pre.df.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(complete).alias("rows_after"))
