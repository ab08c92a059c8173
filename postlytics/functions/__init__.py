"""Column-expression helpers (pure ``pyspark.sql.functions`` compositions)."""

from postlytics.functions.columns import (
    rint_round,
    safe_div,
    to_double_guarded,
    strip_number_text,
    NUMBER_PATTERN,
)
from postlytics.functions.distributions import (
    f_sf,
    t_two_sided_p,
    norm_ppf,
    norm_cdf,
    t_ppf,
)

__all__ = [
    "rint_round", "safe_div", "to_double_guarded", "strip_number_text", "NUMBER_PATTERN",
    "f_sf", "t_two_sided_p", "norm_ppf", "norm_cdf", "t_ppf",
]
