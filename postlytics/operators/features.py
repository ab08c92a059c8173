"""Preprocessing: typed metrics, engagement totals, rates and calendar features.

``preprocess`` is one lazy ``select`` over the input.  The only eager step is
the denominator choice (one aggregate of three ``count(col)``), which decides
the *schema*-level question "which column divides the engagement total".
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlytics.functions.columns import ntz_text, rint_round, safe_div, strip_number_text, to_double_guarded
from postlytics.operators.roles import Roles, resolve_roles

ER = "engagement_rate_pct"
TOTAL = "total_engagements"
DENOMINATOR_THRESHOLD = 0.25

# Report column order of the reference.
PRIORITY_NAMES = ["weekday", "hour", "month", ER, TOTAL]
KPI_NAMES = ["save_rate_pct", "share_rate_pct", "comments_per_like", "like_rate_on_views_pct"]


@dataclass(frozen=True)
class Prepared:
    """A preprocessed table plus what was learnt about its columns."""

    df: DataFrame
    roles: Roles
    denominator: str  # "reach" | "impressions" | "views" | "unknown"

    @property
    def denominator_col(self) -> str | None:
        return getattr(self.roles, self.denominator) if self.denominator != "unknown" else None

    @property
    def has_calendar(self) -> bool:
        return "weekday" in self.df.columns


def metric_to_double(df: DataFrame, name: str) -> Column:
    """Metric text to double; ``, % $`` removed, blanks null, no k/m expansion."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return to_double_guarded(strip_number_text(c))
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    return c.cast("double")


def metrics_to_numeric(df: DataFrame, roles: Roles) -> DataFrame:
    cols = roles.metrics()
    return df.withColumns({c: metric_to_double(df, c) for c in cols}) if cols else df


def total_engagements(roles: Roles) -> Column:
    """Sum of the engagement parts, each clipped at 0, nulls as 0."""
    parts = roles.engagement_parts()
    if not parts:
        return F.lit(None).cast("double")
    acc = None
    for p in parts:
        term = F.coalesce(F.greatest(F.col(p), F.lit(0.0)), F.lit(0.0))
        acc = term if acc is None else acc + term
    return acc


def _column_counts(df: DataFrame, roles: Roles, date: str | None) -> dict[str, int]:
    """One aggregate: row count, non-null counts of the denominator candidates and the date."""
    cands = [(name, getattr(roles, name)) for name in ("reach", "impressions", "views")]
    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.count(F.col(c)).alias(f"__{n}") for n, c in cands if c]
    if date:
        aggs.append(F.count(F.col(date)).alias("__date"))
    return df.agg(*aggs).first().asDict()


def _choose_denominator(counts: dict[str, int], roles: Roles, threshold: float) -> str:
    total = counts["__n"]
    for n in ("reach", "impressions", "views"):
        if getattr(roles, n) and counts[f"__{n}"] > total * threshold:
            return n
    return "unknown"


def denominator_choice(df: DataFrame, roles: Roles, threshold: float = DENOMINATOR_THRESHOLD) -> DataFrame:
    """P10 as a lazy one-row frame: the first of reach, impressions, views with
    more than 25 % non-null cells, else ``unknown``."""
    n = F.count(F.lit(1))
    choice = F.lit("unknown")
    for name in reversed(("reach", "impressions", "views")):
        c = getattr(roles, name)
        if c:
            choice = F.when(F.count(F.col(c)) > n * F.lit(threshold), F.lit(name)).otherwise(choice)
    return df.agg(choice.alias("denominator"))


def pick_denominator(df: DataFrame, roles: Roles, threshold: float = DENOMINATOR_THRESHOLD) -> str:
    """P10: first of reach, impressions, views with > 25 % non-null cells."""
    return _choose_denominator(_column_counts(df, roles, None), roles, threshold)


def rate(num: Column, den: Column, scale: float = 100.0, digits: int = 4) -> Column:
    """``scale * num / den`` (0 -> null), half-even to ``digits``."""
    value = safe_div(F.lit(scale) * num, den) if scale != 1.0 else safe_div(num, den)
    return rint_round(value, digits)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """English weekday and month names, hour, weekend flag (null -> false)."""
    return {
        "weekday": F.date_format(ts, "EEEE"),
        "hour": F.hour(ts),
        "month": F.date_format(ts, "MMMM"),
        "is_weekend": F.coalesce(F.weekday(ts) >= 5, F.lit(False)),
    }


def hour_label(hour: Column) -> Column:
    """``9:00`` text; null hour stays null."""
    return F.concat(hour.cast("string"), F.lit(":00"))


def preprocess(df: DataFrame, roles: Roles | None = None, *, check_dates: bool = True) -> Prepared:
    """P20: roles, typed metrics, totals, rates, calendar features, column order."""
    roles = roles or resolve_roles(df.columns)
    # date: a string column is parsed the loader's way; timestamps are kept
    date = roles.date
    if date is not None:
        dtype = df.schema[date].dataType
        if isinstance(dtype, T.StringType):
            from postlytics.sources.csv_export import parse_dates_column

            df = df.withColumn(date, parse_dates_column(df, date))
        elif isinstance(dtype, T.DateType):
            df = df.withColumn(date, F.col(date).cast("timestamp_ntz"))
        elif not isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            date = None
    typed = metrics_to_numeric(df, roles)
    if roles.duration and not isinstance(typed.schema[roles.duration].dataType, T.NumericType):
        typed = typed.withColumn(roles.duration, metric_to_double(typed, roles.duration))
    counts = _column_counts(typed, roles, date)
    denominator = _choose_denominator(counts, roles, DENOMINATOR_THRESHOLD)
    den_col = getattr(roles, denominator) if denominator != "unknown" else None

    new: dict[str, Column] = {TOTAL: total_engagements(roles)}
    if den_col:
        new[ER] = rate(F.col(TOTAL), F.col(den_col))
    else:
        new[ER] = F.lit(None).cast("double")
    if roles.saves and den_col:
        new["save_rate_pct"] = rate(F.col(roles.saves), F.col(den_col))
    if roles.shares and den_col:
        new["share_rate_pct"] = rate(F.col(roles.shares), F.col(den_col))
    if roles.likes and roles.comments:
        new["comments_per_like"] = rate(F.col(roles.comments), F.col(roles.likes), scale=1.0)
    if roles.views and roles.likes:
        new["like_rate_on_views_pct"] = rate(F.col(roles.likes), F.col(roles.views))
    if roles.follows and roles.profile_visits:
        new["profile_to_follow_conversion_pct"] = rate(F.col(roles.follows), F.col(roles.profile_visits))
    if date and (not check_dates or counts.get("__date", 0) > 0):
        new.update(calendar_columns(F.col(date)))

    # total first: the rates read it
    out = typed.withColumn(TOTAL, new.pop(TOTAL)).withColumns(new)
    out = order_columns(out, roles)
    return Prepared(out, Roles(**{**dict(roles.items()), "date": date}), denominator)


def order_columns(df: DataFrame, roles: Roles) -> DataFrame:
    """The reference's priority columns first, the rest after in place."""
    pri = [
        roles.date, "weekday", "hour", "month", ER, TOTAL,
        roles.reach, roles.impressions, roles.views, roles.likes, roles.comments,
        roles.saves, roles.shares, roles.follows,
        *KPI_NAMES, roles.type, roles.duration,
    ]
    seen: list[str] = []
    for c in pri:
        if c and c in df.columns and c not in seen:
            seen.append(c)
    rest = [c for c in df.columns if c not in seen]
    return df.select(*seen, *rest)


def meta_summary(pre: Prepared) -> DataFrame:
    """A1: row count, avg / median / max ER (2 digits), date range, denominator."""
    from postlytics.functions.ranking import group_quantiles

    er = F.col(ER)
    aggs = [
        F.count(F.lit(1)).alias("total_rows"),
        rint_round(F.avg(er), 2).alias("avg_engagement_rate"),
        rint_round(F.max(er), 2).alias("max_engagement_rate"),
    ]
    if pre.roles.date:
        d = F.col(pre.roles.date)
        aggs += [ntz_text(F.min(d), "date").alias("date_range_start"),
                 ntz_text(F.max(d), "date").alias("date_range_end")]
    else:
        aggs += [F.lit(None).cast("string").alias("date_range_start"),
                 F.lit(None).cast("string").alias("date_range_end")]
    med = group_quantiles(pre.df, None, ER, [0.5]).select(
        rint_round(F.col("q")[0], 2).alias("median_engagement_rate"))
    return pre.df.agg(*aggs).crossJoin(med).withColumn("engagement_denominator", F.lit(pre.denominator))
