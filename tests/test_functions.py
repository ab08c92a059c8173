import math

import pytest
from pyspark.sql import functions as F

from postlytics.functions.columns import rint_round
from postlytics.functions.distributions import f_sf, norm_cdf, norm_ppf, t_ppf, t_two_sided_p


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("f,d1,d2,expected", [
    (3.0, 2, 27, 0.06659975), (2.1, 3, 4002, 0.09807162), (3.85, 1, 500, 0.05030023)])
def test_f_pvalues_match_published(spark, f, d1, d2, expected):
    assert one(spark, f_sf(f, d1, d2))[0] == pytest.approx(expected, abs=1e-8)


def test_t_and_normal(spark):
    row = one(spark, t_two_sided_p(2.0, 10), norm_ppf(F.lit(0.975)), norm_cdf(F.lit(-3.0)), t_ppf(0.975, 10))
    assert row[0] == pytest.approx(0.07338803, abs=1e-7)
    assert row[1] == pytest.approx(1.959963985, abs=1e-9)
    assert row[2] == pytest.approx(0.001349898, abs=1e-9)
    assert row[3] == pytest.approx(2.228138852, abs=1e-6)


def test_huge_degrees_of_freedom_tend_to_chi_square(spark):
    # F(3, 4e8) at 1.2 ~ P(chi2_3 > 3.6)
    assert one(spark, f_sf(1.2, 3, 4e8))[0] == pytest.approx(0.30802, abs=1e-4)


@pytest.mark.parametrize("d2", [1e3, 1.9e5, 2.1e5, 1e9, 1e13, 1e15])
@pytest.mark.parametrize("f", [1e-6, 0.3, 1.0, 3.7, 40.0])
def test_many_degrees_of_freedom_keep_their_digits(spark, d2, f):
    # closed forms: two and four degrees of freedom above; y is 1 - x with all its digits
    def tail(d1):
        log_x = -math.log1p(d1 * f / d2) * d2 / 2
        y = d1 * f / (d2 + d1 * f)
        return math.exp(log_x) * (1 if d1 == 2 else 1 + d2 / 2 * y)

    row = one(spark, f_sf(f, 2, d2), f_sf(f, 4, d2), t_two_sided_p(math.sqrt(f), d2), f_sf(f, 1, d2))
    assert row[0] == pytest.approx(tail(2), rel=1e-8) and row[1] == pytest.approx(tail(4), rel=1e-8)
    assert row[2] == pytest.approx(row[3], rel=1e-9)
    if d2 >= 1e9:
        assert row[2] == pytest.approx(math.erfc(math.sqrt(f / 2)), rel=1e-6)


@pytest.mark.parametrize("d1", [1, 7, 40])
def test_both_ways_meet_at_the_switch(spark, d1):
    d2 = 2 * 1e5 * max(1, d1 / 2) ** 1.5
    below, above = one(spark, f_sf(1.3, d1, d2 * (1 - 1e-9)), f_sf(1.3, d1, d2 * (1 + 1e-9)))
    assert below == pytest.approx(above, rel=1e-7)


def test_half_even_rounding(spark):
    row = one(spark, rint_round(F.lit(0.12345), 4), rint_round(F.lit(2.5), 0), rint_round(F.lit(3.5), 0))
    assert row[0] == 0.1234 and row[1] == 2.0 and row[2] == 4.0


def test_norm_ppf_symmetry(spark):
    row = one(spark, norm_ppf(F.lit(1e-10)), norm_ppf(F.lit(1 - 1e-10)), norm_ppf(F.lit(0.5)))
    assert row[0] == pytest.approx(-row[1], rel=1e-7)  # 1 - 1e-10 is itself rounded
    assert row[2] == 0.0
    assert math.isclose(row[0], -6.361340902, rel_tol=1e-8)


def test_wall_clock_text_ignores_session_zone(spark):
    import datetime as dt

    from postlytics.functions.columns import ntz_text
    from postlytics.sources.csv_export import _parse_ntz

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("10/03/2024 02:05:45",)], "s string")  # inside the DST gap
        row = df.select(_parse_ntz(F.col("s"), "dd/MM/yyyy HH:mm:ss").alias("t")).select(
            "t", ntz_text("t", "dmy").alias("dmy"), ntz_text("t", "iso").alias("iso"),
            ntz_text("t", "date").alias("d")).first()
        assert row["t"] == dt.datetime(2024, 3, 10, 2, 5, 45)
        assert (row["dmy"], row["iso"], row["d"]) == ("10/03/2024 02:05:45", "2024-03-10 02:05:45", "2024-03-10")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_json_safe_nulls_non_finite(spark):
    import datetime as dt

    from postlytics.sources.sinks import json_safe

    df = spark.createDataFrame([(float("nan"), 1.23456789, dt.datetime(2024, 3, 10, 2, 5)),
                                (float("inf"), -float("inf"), None)], "a double, b double, t timestamp_ntz")
    rows = json_safe(df).collect()
    assert rows[0]["a"] is None and rows[0]["b"] == 1.2346 and rows[0]["t"] == "2024-03-10"
    assert rows[1]["a"] is None and rows[1]["b"] is None and rows[1]["t"] is None
