"""Sinks (S10-S13): JSON-safe tables, previews and CSV/JSON writers.

Writers go through Spark's distributed writers; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlytics.functions.columns import ntz_text, rint_round


def json_safe(df: DataFrame, ndigits: int = 4) -> DataFrame:
    """NaN / +-Inf -> null, floats rounded, timestamps -> ISO date text."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            out[f.name] = F.when(bad, F.lit(None).cast("double")).otherwise(rint_round(c.cast("double"), ndigits))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = ntz_text(c, "date")
    return df.withColumns(out) if out else df


def preview(df: DataFrame, n: int = 5, order_by: str | None = None) -> DataFrame:
    """The first n rows in file order, timestamps as text."""
    key = order_by or ("_row_id" if "_row_id" in df.columns else ("post_id" if "post_id" in df.columns else None))
    base = df.orderBy(key) if key else df
    conv = {f.name: ntz_text(f.name, "iso")
            for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    return base.limit(n).withColumns(conv) if conv else base.limit(n)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """Header CSV.  ``single_file`` only for small report tables."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S12 sink: JSON lines of a json-safe table."""
    json_safe(df).write.mode(mode).json(path)


def write_summary_csv(pre, path: str) -> None:
    """The describe table (with outlier counts) as one small CSV."""
    from postlytics.operators.eda import describe_numeric

    write_csv(describe_numeric(pre), path, single_file=True)


def write_top_posts_csv(pre, path: str, n: int = 10) -> None:
    """Date, rate, total and denominator of the n best posts."""
    from postlytics.operators.eda import top_posts_library

    write_csv(top_posts_library(pre, n), path, single_file=True)
