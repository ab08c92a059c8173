"""DuckDB SQL twins of the registered queries (the correctness oracle).

Every statement starts from the same ``posts`` derivation and the same
preprocessing written in SQL, then answers one question.  Rounding is
half-even on the scaled double (``round_even(x * 10^n, 0) / 10^n``) to match
the Spark side's ``rint``.
"""

from __future__ import annotations

from postlytics.sources.fixtures import POSTS_SQL


def r(expr: str, digits: int) -> str:
    scale = f"{10 ** digits}.0"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def rate(num: str, den: str, scale: float = 100.0) -> str:
    body = f"({scale} * ({num})) / nullif({den}, 0)" if scale != 1.0 else f"({num}) / nullif({den}, 0)"
    return r(body, 4)


_TOTAL = " + ".join(f"coalesce(greatest(CAST({c} AS DOUBLE), 0.0), 0.0)"
                    for c in ["likes", "comments", "saves", "shares", "follows"])

PREFIX = f"""
WITH posts AS ({POSTS_SQL}),
dn AS (
  SELECT CASE WHEN count(reach) > count(*) * 0.25 THEN 'reach'
              WHEN count(impressions) > count(*) * 0.25 THEN 'impressions'
              WHEN count(views) > count(*) * 0.25 THEN 'views' ELSE 'unknown' END AS denominator
  FROM posts
),
typed AS (
  SELECT post_id, publish_time, post_type, duration_sec,
         CAST(reach AS DOUBLE) AS reach, CAST(impressions AS DOUBLE) AS impressions,
         CAST(views AS DOUBLE) AS views, CAST(likes AS DOUBLE) AS likes,
         CAST(comments AS DOUBLE) AS comments, CAST(saves AS DOUBLE) AS saves,
         CAST(shares AS DOUBLE) AS shares, CAST(follows AS DOUBLE) AS follows,
         CAST(profile_visits AS DOUBLE) AS profile_visits,
         {_TOTAL} AS total_engagements,
         CASE dn.denominator WHEN 'reach' THEN CAST(reach AS DOUBLE)
              WHEN 'impressions' THEN CAST(impressions AS DOUBLE)
              WHEN 'views' THEN CAST(views AS DOUBLE) END AS den
  FROM posts CROSS JOIN dn
),
pre AS (
  SELECT publish_time,
         dayname(publish_time) AS weekday,
         CAST(hour(publish_time) AS INTEGER) AS hour,
         monthname(publish_time) AS month,
         {rate('total_engagements', 'den')} AS engagement_rate_pct,
         total_engagements, reach, impressions, views, likes, comments, saves, shares, follows,
         {rate('saves', 'den')} AS save_rate_pct,
         {rate('shares', 'den')} AS share_rate_pct,
         {rate('comments', 'likes', 1.0)} AS comments_per_like,
         {rate('likes', 'views')} AS like_rate_on_views_pct,
         post_type, duration_sec, post_id, profile_visits,
         {rate('follows', 'profile_visits')} AS profile_to_follow_conversion_pct,
         coalesce(isodow(publish_time) >= 6, false) AS is_weekend
  FROM typed
)
"""

PRE_COLUMNS = [
    "publish_time", "weekday", "hour", "month", "engagement_rate_pct", "total_engagements",
    "reach", "impressions", "views", "likes", "comments", "saves", "shares", "follows",
    "save_rate_pct", "share_rate_pct", "comments_per_like", "like_rate_on_views_pct",
    "post_type", "duration_sec", "post_id", "profile_visits", "profile_to_follow_conversion_pct",
    "is_weekend",
]
NUMERIC_COLUMNS = [c for c in PRE_COLUMNS
                   if c not in ("publish_time", "weekday", "month", "post_type", "is_weekend", "post_id")]

ER = "engagement_rate_pct"


def q(body: str) -> str:
    return PREFIX + body


def _describe() -> str:
    unp = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM pre" for c in NUMERIC_COLUMNS)
    return q(f"""
, long AS ({unp}),
st AS (
  SELECT column_name, count(value) AS cnt, avg(value) AS mean, stddev_samp(value) AS std,
         min(value) AS mn, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
         quantile_cont(value, 0.75) AS p75, max(value) AS mx
  FROM long GROUP BY column_name
),
b AS (SELECT *, p75 - p25 AS iqr, p25 - 1.5 * (p75 - p25) AS lb, p75 + 1.5 * (p75 - p25) AS ub FROM st),
o AS (SELECT l.column_name, count(*) FILTER (WHERE l.value < b.lb OR l.value > b.ub) AS oc
      FROM long l JOIN b USING (column_name) GROUP BY l.column_name)
SELECT b.column_name, CAST(cnt AS DOUBLE) AS count, {r('mean', 2)} AS mean, {r('std', 2)} AS std,
       {r('mn', 2)} AS min, {r('p25', 2)} AS p25, {r('p50', 2)} AS p50, {r('p75', 2)} AS p75,
       {r('mx', 2)} AS max, {r('iqr', 2)} AS iqr, {r('lb', 2)} AS lower_bound, {r('ub', 2)} AS upper_bound,
       CAST(coalesce(o.oc, 0) AS BIGINT) AS outliers_count
FROM b LEFT JOIN o USING (column_name)
""")


def _missing() -> str:
    unp = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM pre" for c in PRE_COLUMNS)
    return q(f"SELECT column_name, CAST(missing AS BIGINT) AS missing FROM ({unp}) WHERE missing > 0")


BOUNDS = """
, bnd AS (
  SELECT quantile_cont(engagement_rate_pct, 0.25) AS q1, quantile_cont(engagement_rate_pct, 0.5) AS median,
         quantile_cont(engagement_rate_pct, 0.75) AS q3 FROM pre
), bb AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM bnd)
"""


def _histogram(bins: int = 30) -> str:
    return q(f"""
, rg AS (SELECT min(engagement_rate_pct) AS lo, max(engagement_rate_pct) AS hi FROM pre),
c AS (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((engagement_rate_pct - lo) / ((hi - lo) / {float(bins)})), {bins - 1}) END AS INTEGER) AS bin,
         count(*) AS posts
  FROM pre CROSS JOIN rg WHERE engagement_rate_pct IS NOT NULL GROUP BY 1
)
SELECT CAST(s.bin AS INTEGER) AS bin,
       {r(f'lo + s.bin * (hi - lo) / {float(bins)}', 6)} AS bin_start,
       {r(f'lo + (s.bin + 1) * (hi - lo) / {float(bins)}', 6)} AS bin_end,
       CAST(coalesce(c.posts, 0) AS BIGINT) AS posts
FROM (SELECT range AS bin FROM range({bins})) s CROSS JOIN rg LEFT JOIN c ON c.bin = s.bin
""")


def _box(group: str | None, src: str = "pre", ctes: str = "") -> str:
    g = "'all'" if group is None else f"CAST({group} AS VARCHAR)"
    return q(ctes + f"""
, d AS (SELECT {g} AS grp, engagement_rate_pct AS v FROM {src} WHERE engagement_rate_pct IS NOT NULL AND {g} IS NOT NULL),
qq AS (SELECT grp, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM d GROUP BY grp),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM qq)
SELECT f.grp, {r('q1', 4)} AS q1, {r('median', 4)} AS median, {r('q3', 4)} AS q3, {r('q3 - q1', 4)} AS iqr,
       {r('min(v) FILTER (WHERE v >= lo_f AND v <= hi_f)', 4)} AS whisker_low,
       {r('max(v) FILTER (WHERE v >= lo_f AND v <= hi_f)', 4)} AS whisker_high,
       CAST(count(*) FILTER (WHERE NOT (v >= lo_f AND v <= hi_f)) AS BIGINT) AS outliers,
       count(*) AS n
FROM d JOIN f USING (grp) GROUP BY f.grp, q1, median, q3
""")


def _mean_ci(n_boot: int = 1000) -> str:
    from postlytics.operators.eda import DRAWS, POISSON_BOUNDS

    draw = lambda j: f"CAST(('0x' || substr(h, {4 * j + 1}, 4)) AS INTEGER)"
    weight = lambda j: "(" + " + ".join(f"CAST({draw(j)} >= {b} AS INTEGER)" for b in POISSON_BOUNDS) + ")"
    reps = " UNION ALL ".join(f"SELECT grp, block, {j} AS j, sum({weight(j)} * v) / nullif(sum({weight(j)}), 0) AS m FROM h GROUP BY grp, block"
                              for j in range(DRAWS))
    return q(f"""
, x AS (SELECT CAST(weekday AS VARCHAR) AS grp, {ER} AS v, CAST(post_id AS VARCHAR) AS key FROM pre WHERE weekday IS NOT NULL AND {ER} IS NOT NULL),
h AS (SELECT grp, v, range AS block, md5('42|' || key || '|' || CAST(range AS VARCHAR)) AS h FROM x CROSS JOIN range({-(-n_boot // DRAWS)})),
m AS ({reps}),
ci AS (SELECT grp, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m WHERE block * {DRAWS} + j < {n_boot} AND m IS NOT NULL GROUP BY grp),
b AS (SELECT grp, avg(v) AS mean, count(*) AS n FROM x GROUP BY grp)
SELECT grp, n, {r('mean', 6)} AS mean, {r('lo', 6)} AS ci_low, {r('hi', 6)} AS ci_high FROM b JOIN ci USING (grp)""")


def _quantiles() -> str:
    return q(f"""
SELECT CAST(post_type AS VARCHAR) AS post_type, quantile_cont({ER}, 0.1) AS q10, quantile_cont({ER}, 0.5) AS q50, quantile_cont({ER}, 0.9) AS q90
FROM pre WHERE post_type IS NOT NULL AND {ER} IS NOT NULL GROUP BY 1""").replace("quantile_cont(", "round(quantile_cont(") \
        .replace(", 0.1) AS", ", 0.1), 9) AS").replace(", 0.5) AS", ", 0.5), 9) AS").replace(", 0.9) AS", ", 0.9), 9) AS")


def eda_sql() -> dict[str, str]:
    er = ER
    return {
        "er_by_weekday": q(f"""
SELECT weekday, CAST(min(isodow(publish_time)) AS INTEGER) AS day_order, {r(f'avg({er})', 2)} AS avg_er,
       count({er}) AS posts
FROM pre WHERE weekday IS NOT NULL GROUP BY weekday"""),
        "meta_summary": q(f"""
SELECT count(*) AS total_rows, {r(f'avg({er})', 2)} AS avg_engagement_rate,
       {r(f'median({er})', 2)} AS median_engagement_rate, {r(f'max({er})', 2)} AS max_engagement_rate,
       strftime(min(publish_time), '%Y-%m-%d') AS date_range_start,
       strftime(max(publish_time), '%Y-%m-%d') AS date_range_end,
       (SELECT denominator FROM dn) AS engagement_denominator
FROM pre"""),
        "preprocess": q("SELECT * FROM pre"),
        "engagement_rate": q(f"SELECT post_id, total_engagements, {er} FROM pre"),
        "kpi_rates": q("""SELECT post_id, save_rate_pct, share_rate_pct, comments_per_like,
       like_rate_on_views_pct, profile_to_follow_conversion_pct FROM pre"""),
        "total_engagements": q("SELECT post_id, total_engagements FROM pre"),
        "calendar_features": q("SELECT post_id, weekday, hour, month, is_weekend FROM pre"),
        "hour_label": q("SELECT post_id, CAST(hour AS VARCHAR) || ':00' AS hour_label FROM pre"),
        "pick_denominator": q("SELECT denominator FROM dn"),
        "describe_numeric": _describe(),
        "er_stats": q(f"""
SELECT {r(f'avg({er})', 2)} AS mean, {r(f'quantile_cont({er}, 0.5)', 2)} AS median,
       {r(f'stddev_samp({er})', 2)} AS std, {r(f'min({er})', 2)} AS min, {r(f'max({er})', 2)} AS max,
       {r(f'quantile_cont({er}, 0.25)', 2)} AS q25, {r(f'quantile_cont({er}, 0.75)', 2)} AS q75
FROM pre"""),
        "er_outlier_summary": q(BOUNDS + f"""
SELECT {r('q1', 4)} AS q1, {r('median', 4)} AS median, {r('q3', 4)} AS q3, {r('iqr', 4)} AS iqr,
       {r('lower_bound', 4)} AS lower_bound, {r('upper_bound', 4)} AS upper_bound,
       CAST(count(*) FILTER (WHERE {er} < lower_bound OR {er} > upper_bound) AS BIGINT) AS outliers,
       {r(f'count(*) FILTER (WHERE {er} < lower_bound OR {er} > upper_bound) / count(*) * 100.0', 1)} AS outlier_pct
FROM pre CROSS JOIN bb GROUP BY q1, median, q3, iqr, lower_bound, upper_bound"""),
        "outlier_rows": q(BOUNDS + f"""
SELECT pre.* FROM pre CROSS JOIN bb WHERE {er} < lower_bound OR {er} > upper_bound"""),
        "missing_values": _missing(),
        "best_weekday": q(f"""
SELECT weekday AS best_weekday, {r('m', 2)} AS avg_er FROM (
  SELECT weekday, avg({er}) AS m FROM pre WHERE weekday IS NOT NULL GROUP BY weekday)
WHERE m IS NOT NULL ORDER BY m DESC, weekday LIMIT 1"""),
        "er_by_hour": q(f"""
SELECT hour, {r(f'avg({er})', 2)} AS avg_er, count({er}) AS posts FROM pre WHERE hour IS NOT NULL GROUP BY hour"""),
        "top_hours": q(f"""
SELECT CAST(row_number() OVER (ORDER BY m DESC, hour) AS INTEGER) AS rank, hour, {r('m', 2)} AS avg_er FROM (
  SELECT hour, avg({er}) AS m FROM pre WHERE hour IS NOT NULL GROUP BY hour) WHERE m IS NOT NULL
ORDER BY m DESC, hour LIMIT 3"""),
        "er_by_type": q(f"""
SELECT post_type, {r(f'avg({er})', 2)} AS avg_er, {r(f'median({er})', 2)} AS median_er,
       count({er}) AS posts, {r(f'stddev_samp({er})', 2)} AS std_er
FROM pre WHERE post_type IS NOT NULL GROUP BY post_type"""),
        "best_type": q(f"""
SELECT post_type AS best_type, {r('m', 2)} AS avg_er FROM (
  SELECT post_type, avg({er}) AS m FROM pre WHERE post_type IS NOT NULL GROUP BY post_type)
WHERE m IS NOT NULL ORDER BY m DESC, post_type LIMIT 1"""),
        "interaction_breakdown": q(f"""
, s AS (SELECT CAST(sum(likes) AS BIGINT) AS likes, CAST(sum(comments) AS BIGINT) AS comments,
              CAST(sum(saves) AS BIGINT) AS saves, CAST(sum(shares) AS BIGINT) AS shares FROM pre),
l AS (SELECT 'likes' AS interaction, likes AS total FROM s UNION ALL SELECT 'comments', comments FROM s
      UNION ALL SELECT 'saves', saves FROM s UNION ALL SELECT 'shares', shares FROM s)
SELECT interaction, total, {r('total / (sum(total) OVER ()) * 100.0', 2)} AS share_pct FROM l"""),
        "monthly_trend": q(f"""
SELECT month_end, {r('m', 2)} AS avg_er FROM (
  SELECT last_day(publish_time) AS month_end, avg({er}) AS m FROM pre WHERE publish_time IS NOT NULL GROUP BY 1)
WHERE m IS NOT NULL"""),
        "weekend_vs_weekday": q(f"""
SELECT {r(f'avg({er}) FILTER (WHERE is_weekend)', 2)} AS weekend_avg,
       {r(f'avg({er}) FILTER (WHERE NOT is_weekend)', 2)} AS weekday_avg,
       count({er}) FILTER (WHERE is_weekend) AS weekend_posts,
       count({er}) FILTER (WHERE NOT is_weekend) AS weekday_posts,
       {r(f'abs(avg({er}) FILTER (WHERE is_weekend) - avg({er}) FILTER (WHERE NOT is_weekend))', 2)} AS abs_difference
FROM pre"""),
        "reach_er_correlation": q(f"""
SELECT 'reach' AS x_column, {r(f'corr(reach, {er})', 6)} AS pearson_r, count(*) AS n_pairs
FROM pre WHERE reach IS NOT NULL AND {er} IS NOT NULL"""),
        "trend_line": q(f"""
SELECT 'reach' AS x_column, {r(f'regr_slope({er}, reach)', 10)} AS slope,
       {r(f'regr_intercept({er}, reach)', 6)} AS intercept, {r(f'regr_r2({er}, reach)', 6)} AS r2,
       CAST(regr_count({er}, reach) AS BIGINT) AS n_pairs FROM pre"""),
        "er_histogram": _histogram(30),
        "box_stats": _box(None),
        "box_stats_by_type": _box("post_type"),
        "column_defaults": q("""
, med AS (
  SELECT 'reach' AS feature, median(reach) AS median FROM pre UNION ALL SELECT 'views', median(views) FROM pre
  UNION ALL SELECT 'likes', median(likes) FROM pre UNION ALL SELECT 'comments', median(comments) FROM pre
  UNION ALL SELECT 'saves', median(saves) FROM pre UNION ALL SELECT 'shares', median(shares) FROM pre
  UNION ALL SELECT 'follows', median(follows) FROM pre),
m1 AS (SELECT 'post_type' AS feature, CAST(post_type AS VARCHAR) AS mode FROM pre WHERE post_type IS NOT NULL
       GROUP BY post_type ORDER BY count(*) DESC, post_type LIMIT 1),
m2 AS (SELECT 'weekday' AS feature, weekday AS mode FROM pre WHERE weekday IS NOT NULL
       GROUP BY weekday ORDER BY count(*) DESC, weekday LIMIT 1),
m3 AS (SELECT 'hour' AS feature, CAST(hour AS VARCHAR) AS mode FROM pre WHERE hour IS NOT NULL
       GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1)
SELECT feature, CAST(median AS DOUBLE) AS median, CAST(NULL AS VARCHAR) AS mode FROM med
UNION ALL SELECT feature, CAST(NULL AS DOUBLE), mode FROM m1
UNION ALL SELECT feature, CAST(NULL AS DOUBLE), mode FROM m2
UNION ALL SELECT feature, CAST(NULL AS DOUBLE), mode FROM m3"""),
        "distinct_types": q("SELECT DISTINCT post_type AS content_type FROM pre WHERE post_type IS NOT NULL"),
        "top_posts": q(f"""
SELECT CAST(row_number() OVER (ORDER BY {er} DESC NULLS LAST, post_id) AS INTEGER) AS rank,
       publish_time, {er}, post_type, likes, saves
FROM pre ORDER BY {er} DESC NULLS LAST, post_id LIMIT 10"""),
        "top5_posts": q(f"""
SELECT CAST(row_number() OVER (ORDER BY {er} DESC NULLS LAST, post_id) AS INTEGER) AS rank,
       coalesce(strftime(publish_time, '%Y-%m-%d'), 'N/A') AS date,
       coalesce(CAST(post_type AS VARCHAR), '') AS content_type,
       CAST(total_engagements AS BIGINT) AS interactions, {r(er, 1)} AS er_1dp
FROM pre ORDER BY {er} DESC NULLS LAST, post_id LIMIT 5"""),
        "top_posts_library": q(f"""
SELECT CAST(row_number() OVER (ORDER BY {er} DESC NULLS LAST, post_id) AS INTEGER) AS rank,
       publish_time, {er}, total_engagements, reach
FROM pre ORDER BY {er} DESC NULLS LAST, post_id LIMIT 10"""),
        "er_histogram_25": _histogram(25),
        "benchmark_check_notebook": q(f"""
SELECT {r(f'avg({er})', 2)} AS avg_er, CAST(3.5 AS DOUBLE) AS benchmark, avg({er}) > 3.5 AS beats_benchmark FROM pre"""),
        "benchmark_check": q(f"""
SELECT {r(f'avg({er})', 2)} AS avg_er, CAST(5.0 AS DOUBLE) AS benchmark, avg({er}) > 5.0 AS beats_benchmark FROM pre"""),
        "benchmark_status": q(f"""
, a AS (SELECT {r(f'avg({er})', 2)} AS avg_er FROM pre)
SELECT avg_er, CAST(5.0 AS DOUBLE) AS benchmark,
       CASE WHEN avg_er >= 7.5 THEN 'outstanding' WHEN avg_er >= 5.0 THEN 'above' ELSE 'below' END AS status,
       CASE WHEN avg_er >= 7.5 THEN {r('avg_er / 5.0', 1)} END AS multiple,
       {r('avg_er - 5.0', 1)} AS delta,
       CASE WHEN {r('avg_er - 5.0', 1)} >= 0 THEN 'up' ELSE 'down' END AS direction
FROM a"""),
    }


# ---------------------------------------------------------------- hypothesis tests
def _fx(v: str) -> str:
    return f"(CASE WHEN abs({v}) < 1e-300 THEN 1e-300 ELSE {v} END)"


def betainc_ctes(src: str, out: str, half_steps: int = 1000) -> str:
    """CTEs turning ``src(id, a, b, x)`` into ``out(id, ibeta)`` = I_x(a, b).

    The same modified-Lentz continued fraction as the Spark side, unrolled as
    a recursive CTE (needs ``WITH RECURSIVE``).
    """
    m = "((cf.j + 2) // 2)"
    odd = f"({m} * (bb - {m}) * xx / ((aa - 1.0 + 2 * {m}) * (aa + 2 * {m})))"
    even = f"(-(aa + {m}) * (aa + bb + {m}) * xx / ((aa + 2 * {m}) * (aa + 1.0 + 2 * {m})))"
    coef = f"(CASE WHEN (cf.j + 1) % 2 = 1 THEN {odd} ELSE {even} END)"
    d_new = f"(1.0 / {_fx(f'1.0 + {coef} * cf.d')})"
    c_new = _fx(f"1.0 + {coef} / cf.c")
    d0 = f"(1.0 / {_fx('1.0 - (aa + bb) * xx / (aa + 1.0)')})"
    return f"""
, {out}_p AS (
  SELECT id, a, b, x, x >= (a + 1.0) / (a + b + 2.0) AS sw,
         CASE WHEN x >= (a + 1.0) / (a + b + 2.0) THEN b ELSE a END AS aa,
         CASE WHEN x >= (a + 1.0) / (a + b + 2.0) THEN a ELSE b END AS bb,
         CASE WHEN x >= (a + 1.0) / (a + b + 2.0) THEN 1.0 - x ELSE x END AS xx
  FROM {src}
),
{out}_cf(id, j, c, d, h) AS (
  SELECT id, 0, 1.0::DOUBLE, {d0}, {d0} FROM {out}_p
  UNION ALL
  SELECT cf.id, cf.j + 1, {c_new}, {d_new}, cf.h * {d_new} * {c_new}
  FROM {out}_cf cf JOIN {out}_p p ON p.id = cf.id WHERE cf.j < {half_steps}
),
{out} AS (
  SELECT p.id,
         CASE WHEN p.x IS NULL THEN NULL WHEN p.x <= 0 THEN 0.0 WHEN p.x >= 1 THEN 1.0
              ELSE (CASE WHEN sw THEN 1.0 - fr * h / aa ELSE fr * h / aa END) END AS ibeta
  FROM (SELECT p.*, exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * ln(xx) + bb * ln(1.0 - xx)) AS fr
        FROM {out}_p p) p
  JOIN (SELECT id, h FROM {out}_cf WHERE j = {half_steps}) c ON c.id = p.id
)
"""


def qr(body: str) -> str:
    return PREFIX.replace("WITH posts AS", "WITH RECURSIVE posts AS", 1) + body


def _label(e: str) -> str:
    return (f"CASE WHEN {e} < 0.01 THEN 'negligible' WHEN {e} < 0.06 THEN 'small' "
            f"WHEN {e} < 0.14 THEN 'medium' ELSE 'large' END")


def _anova_tail(g: str) -> str:
    """ANOVA CTEs over a moments CTE ``g(grp, n, mean, var)`` -> ``st`` with f, p, eta2."""
    return f"""
, tot AS (SELECT CAST(sum(n) AS BIGINT) AS n_total, count(*) AS k, sum(n * mean) / sum(n) AS gm FROM {g}),
a AS (SELECT n_total, k, sum(n * pow(mean - gm, 2)) AS ssb, sum((n - 1) * coalesce(var, 0.0)) AS ssw
      FROM {g} CROSS JOIN tot GROUP BY n_total, k),
st0 AS (SELECT *, CAST(k - 1 AS DOUBLE) AS d1, CAST(n_total - k AS DOUBLE) AS d2,
               (ssb / CAST(k - 1 AS DOUBLE)) / (ssw / CAST(n_total - k AS DOUBLE)) AS f,
               CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) ELSE 0.0 END AS eta2 FROM a),
src AS (SELECT 1 AS id, d2 / 2.0 AS a, d1 / 2.0 AS b, d2 / (d2 + d1 * f) AS x FROM st0)
{betainc_ctes('src', 'pv')}
, st AS (SELECT st0.*, CASE WHEN f <= 0 THEN 1.0 ELSE pv.ibeta END AS p FROM st0 CROSS JOIN pv)
"""


def _moments(group_expr: str, where: str = "TRUE", min_n: int = 5, value: str = ER, src: str = "pre") -> str:
    return f"""
, g AS (SELECT CAST({group_expr} AS VARCHAR) AS grp, count({value}) AS n, avg({value}) AS mean,
              var_samp({value}) AS var
        FROM {src} WHERE {group_expr} IS NOT NULL AND {value} IS NOT NULL AND {where}
        GROUP BY 1 HAVING count({value}) >= {min_n})
"""


def _welch(equal_var: bool) -> str:
    n1, n2 = "CAST(n1 AS DOUBLE)", "CAST(n2 AS DOUBLE)"
    se_w = f"sqrt(v1 / {n1} + v2 / {n2})"
    df_w = f"(pow(v1 / {n1} + v2 / {n2}, 2) / (pow(v1 / {n1}, 2) / ({n1} - 1) + pow(v2 / {n2}, 2) / ({n2} - 1)))"
    sp2 = f"((({n1} - 1) * v1 + ({n2} - 1) * v2) / ({n1} + {n2} - 2))"
    se_p = f"sqrt({sp2} * (1.0 / {n1} + 1.0 / {n2}))"
    se, dfree = (se_p, f"({n1} + {n2} - 2)") if equal_var else (se_w, df_w)
    mm = f"(({n1} * m1 + {n2} * m2) / ({n1} + {n2}))"
    ssb = f"({n1} * pow(m1 - {mm}, 2) + {n2} * pow(m2 - {mm}, 2))"
    ssw = f"(({n1} - 1) * coalesce(v1, 0.0) + ({n2} - 1) * coalesce(v2, 0.0))"
    name = "Student t-test" if equal_var else "Welch t-test"
    return qr(f"""
, w1 AS (SELECT count({ER}) AS n1, avg({ER}) AS m1, var_samp({ER}) AS v1 FROM pre WHERE is_weekend AND {ER} IS NOT NULL),
w2 AS (SELECT count({ER}) AS n2, avg({ER}) AS m2, var_samp({ER}) AS v2 FROM pre WHERE NOT is_weekend AND {ER} IS NOT NULL),
t0 AS (SELECT *, (m1 - m2) / {se} AS t, {dfree} AS df,
              CASE WHEN {ssb} + {ssw} > 0 THEN {ssb} / ({ssb} + {ssw}) ELSE 0.0 END AS eta2
       FROM w1 CROSS JOIN w2),
src AS (SELECT 1 AS id, df / 2.0 AS a, 0.5 AS b, df / (df + t * t) AS x FROM t0)
{betainc_ctes('src', 'pv')}
SELECT '{name}' AS test, {r('t', 4)} AS statistic, {r('pv.ibeta', 4)} AS p_value, {r('df', 4)} AS df,
       pv.ibeta < 0.05 AS reject_h0, {r('eta2', 4)} AS effect_size, {_label(r('eta2', 4))} AS effect_label,
       CASE WHEN m1 > m2 THEN 'Weekend' ELSE 'Weekday' END AS better_period,
       {r('m2', 2)} AS weekday_avg, {r('m1', 2)} AS weekend_avg, n1 AS weekend_n, n2 AS weekday_n
FROM t0 CROSS JOIN pv WHERE n1 >= 5 AND n2 >= 5""")


_REELS = (f"regexp_matches(CAST(post_type AS VARCHAR), 'reel|video', 'i') AND CAST(duration_sec AS DOUBLE) > 3.0 "
          f"AND CAST(duration_sec AS DOUBLE) <= 90.0 AND duration_sec IS NOT NULL AND {ER} IS NOT NULL")


def _pvalues_sql() -> str:
    d = stats_sql_base()
    return (
        f"SELECT 'content_type_anova' AS test_name, statistic, df_between AS df1, df_within AS df2, p_value "
        f"FROM ({d['anova_content_type']}) "
        f"UNION ALL SELECT 'weekend_welch', statistic, 1.0, df, p_value FROM ({d['welch_weekend']}) "
        f"UNION ALL SELECT 'weekend_student', statistic, 1.0, df, p_value FROM ({d['student_t']}) "
        f"UNION ALL SELECT 'content_type_levene', statistic, df_between, df_within, p_value FROM ({d['levene']})")


def stats_sql() -> dict[str, str]:
    out = stats_sql_base()
    out["p_values"] = _pvalues_sql()
    return out


def _tercile_ctes(where: str) -> str:
    return f"""
, reels AS (SELECT CAST(duration_sec AS DOUBLE) AS d, {ER} AS v, {ER} FROM pre WHERE {where}),
qt AS (SELECT quantile_cont(d, 1.0 / 3.0) AS q1, quantile_cont(d, 2.0 / 3.0) AS q2, min(d) AS dmin, max(d) AS dmax FROM reels),
lab AS (SELECT reels.*, CASE WHEN NOT (dmin < q1 AND q1 < q2 AND q2 < dmax) THEN NULL
                             WHEN d <= q1 THEN 'Short' WHEN d <= q2 THEN 'Medium' ELSE 'Long' END AS duration_group
        FROM reels CROSS JOIN qt)"""


def _terciles_sql(where: str) -> str:
    return q(_tercile_ctes(where) + f"""
SELECT duration_group, CASE duration_group WHEN 'Short' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS group_order,
       count(*) AS reels, {r('avg(v)', 2)} AS mean_er, min(d) AS min_duration, max(d) AS max_duration
FROM lab WHERE duration_group IS NOT NULL GROUP BY duration_group""")


_REELS_NOTEBOOK = (f"regexp_matches(CAST(post_type AS VARCHAR), 'reel|video', 'i') "
                   f"AND CAST(duration_sec AS DOUBLE) >= 3.0 AND CAST(duration_sec AS DOUBLE) <= 180.0 "
                   f"AND duration_sec IS NOT NULL AND {ER} IS NOT NULL")


def stats_sql_base() -> dict[str, str]:
    return {
        "mean_ci": _mean_ci(),
        "quantiles_by_map": _quantiles(),
        "quantiles_by_rank": _quantiles(),
        "quantiles_by_refining": _quantiles(),
        "box_stats_by_duration": _box("duration_group", "lab", _tercile_ctes(_REELS)),
        "duration_terciles_notebook": _terciles_sql(_REELS_NOTEBOOK),
        "anova_content_type": qr(_moments("post_type") + _anova_tail("g") + f"""
, best AS (SELECT grp AS best FROM g ORDER BY mean DESC, grp LIMIT 1)
SELECT 'One-Way ANOVA' AS test, {r('f', 4)} AS statistic, {r('p', 4)} AS p_value, d1 AS df_between,
       d2 AS df_within, p < 0.05 AS reject_h0, {r('eta2', 4)} AS effect_size,
       {_label(r('eta2', 4))} AS effect_label, best AS best_group, k AS groups, n_total
FROM st CROSS JOIN best WHERE k >= 2"""),
        "anova_group_means": q(_moments("post_type") + f"SELECT grp, n, {r('mean', 2)} AS mean_er FROM g"),
        "welch_weekend": _welch(False),
        "student_t": _welch(True),
        "levene": qr(f"""
, d AS (SELECT CAST(post_type AS VARCHAR) AS grp, {ER} AS v FROM pre WHERE post_type IS NOT NULL AND {ER} IS NOT NULL),
md AS (SELECT grp, median(v) AS med FROM d GROUP BY grp HAVING count(*) >= 5),
z AS (SELECT grp, abs(v - med) AS z FROM d JOIN md USING (grp))
""" + _moments("grp", min_n=1, value="z", src="z") + _anova_tail("g") + f"""
SELECT {r('f', 4)} AS statistic, {r('p', 4)} AS p_value, d1 AS df_between, d2 AS df_within,
       k AS groups, n_total FROM st"""),
        "duration_terciles": q(f"""
, reels AS (SELECT CAST(duration_sec AS DOUBLE) AS d, {ER} AS v FROM pre WHERE {_REELS}),
qq AS (SELECT quantile_cont(d, 1.0 / 3.0) AS q1, quantile_cont(d, 2.0 / 3.0) AS q2, min(d) AS dmin, max(d) AS dmax FROM reels),
lab AS (SELECT reels.*, CASE WHEN NOT (dmin < q1 AND q1 < q2 AND q2 < dmax) THEN NULL
                             WHEN d <= q1 THEN 'Short' WHEN d <= q2 THEN 'Medium' ELSE 'Long' END AS duration_group
        FROM reels CROSS JOIN qq)
SELECT duration_group, CASE duration_group WHEN 'Short' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS group_order,
       count(*) AS reels, {r('avg(v)', 2)} AS mean_er, min(d) AS min_duration, max(d) AS max_duration
FROM lab WHERE duration_group IS NOT NULL GROUP BY duration_group"""),
    }


# ---------------------------------------------------------------- filters, sinks, reports
_DOUBLE_COLUMNS = ["engagement_rate_pct", "total_engagements", "reach", "impressions", "views", "likes",
                   "comments", "saves", "shares", "follows", "save_rate_pct", "share_rate_pct",
                   "comments_per_like", "like_rate_on_views_pct", "profile_visits",
                   "profile_to_follow_conversion_pct"]


def _json_safe_cols() -> str:
    out = []
    for c in PRE_COLUMNS:
        if c in _DOUBLE_COLUMNS:
            out.append(f"CASE WHEN isnan({c}) OR isinf({c}) THEN NULL ELSE {r(c, 4)} END AS {c}")
        elif c == "publish_time":
            out.append(f"strftime({c}, '%Y-%m-%d') AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


def _preview_cols() -> str:
    return ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" if c == "publish_time" else c
                     for c in PRE_COLUMNS)


def misc_sql() -> dict[str, str]:
    return {
        "reel_filter": q(f"""SELECT post_id, post_type, duration_sec, {ER} FROM pre
WHERE coalesce(regexp_matches(CAST(post_type AS VARCHAR), 'reel|video', 'i'), false)"""),
        "duration_filter": q(f"""SELECT post_id, post_type, CAST(duration_sec AS DOUBLE) AS duration_sec, {ER}
FROM pre WHERE {_REELS}"""),
        "complete_cases": q(f"""SELECT count(*) AS rows_before,
       count(*) FILTER (WHERE reach IS NOT NULL AND views IS NOT NULL AND likes IS NOT NULL AND comments IS NOT NULL
                        AND saves IS NOT NULL AND shares IS NOT NULL AND follows IS NOT NULL AND post_type IS NOT NULL
                        AND weekday IS NOT NULL AND hour IS NOT NULL AND {ER} IS NOT NULL) AS rows_after FROM pre"""),
        "box_stats_by_period": _box("CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END"),
        "period_label": q("SELECT post_id, CASE WHEN is_weekend THEN 'Weekend' ELSE 'Weekday' END AS period FROM pre"),
        "json_safe": q(f"SELECT {_json_safe_cols()} FROM pre"),
        "preview": q(f"SELECT {_preview_cols()} FROM pre ORDER BY post_id LIMIT 5"),
        "overview": q(f"""
, m AS (SELECT count(*) AS total_rows, strftime(min(publish_time), '%Y-%m-%d') AS date_range_start,
              strftime(max(publish_time), '%Y-%m-%d') AS date_range_end, {r(f'avg({ER})', 2)} AS avg_er,
              {r(f'max({ER})', 2)} AS max_er FROM pre),
d AS (SELECT weekday AS best_day, {r('mm', 1)} AS best_day_er FROM (
        SELECT weekday, avg({ER}) AS mm FROM pre WHERE weekday IS NOT NULL GROUP BY weekday)
      WHERE mm IS NOT NULL ORDER BY mm DESC, weekday LIMIT 1),
h AS (SELECT hour AS best_hour FROM (SELECT hour, avg({ER}) AS mm FROM pre WHERE hour IS NOT NULL GROUP BY hour)
      WHERE mm IS NOT NULL ORDER BY mm DESC, hour LIMIT 1),
t AS (SELECT post_type AS best_type FROM (
        SELECT post_type, avg({ER}) AS mm FROM pre WHERE post_type IS NOT NULL GROUP BY post_type)
      WHERE mm IS NOT NULL ORDER BY mm DESC, post_type LIMIT 1)
SELECT * FROM m CROSS JOIN d CROSS JOIN h CROSS JOIN t"""),
    }


def loader_sql() -> dict[str, str]:
    export = """
, export AS (
  SELECT CAST(post_id AS VARCHAR) AS post_id, date_trunc('second', publish_time) AS publish_time, post_type,
         CAST(duration_sec AS VARCHAR) AS duration_sec, CAST(reach AS DOUBLE) AS reach,
         CAST(impressions AS DOUBLE) AS impressions,
         CASE WHEN views % 100 = 0 THEN CAST(printf('%.1f', views / 1000.0) AS DOUBLE) * 1000.0
              ELSE CAST(views AS DOUBLE) END AS views,
         CAST(likes AS DOUBLE) AS likes, CAST(comments AS DOUBLE) AS comments, CAST(saves AS DOUBLE) AS saves,
         CAST(shares AS DOUBLE) AS shares, CAST(follows AS DOUBLE) AS follows,
         CAST(profile_visits AS DOUBLE) AS profile_visits
  FROM posts
)
"""
    e = eda_sql()
    return {
        "read_export": q(export + "SELECT * FROM export"),
        "read_export_messy": q(export + "SELECT *, CASE WHEN CAST(post_id AS BIGINT) % 4 = 1 THEN CASE WHEN CAST(post_id AS BIGINT) % 41 = 0 "
                               "THEN 'caf\u00e9, au lait' ELSE 'plain words' END END AS caption FROM export"),
        "smart_numeric": q("SELECT post_id, CASE WHEN post_id % 5 = 2 AND views % 100 = 0 THEN CAST(printf('%.1f', views / 1000.0) AS DOUBLE) * 1000.0 "
                           "ELSE CAST(views AS DOUBLE) END AS views FROM posts"),
        "parse_dates": q("SELECT post_id, date_trunc('second', publish_time) AS publish_time FROM posts"),
        "null_tokens": q("SELECT post_id, CASE WHEN post_id % 7 <> 0 THEN post_type END AS post_type FROM posts"),
        "drop_empty_rows": q("SELECT post_id AS _row_id, CAST(likes AS VARCHAR) AS likes FROM posts WHERE post_id % 7 <> 0"),
        "read_export_er_by_type": e["er_by_type"],
        "read_export_monthly_trend": e["monthly_trend"],
    }


def ml_sql() -> dict[str, str]:
    rows = f"""
, mr AS (
  SELECT CAST(post_id AS VARCHAR) AS row_key, reach, views, likes, comments, saves, shares, follows,
         CAST(post_type AS VARCHAR) AS post_type, CAST(weekday AS VARCHAR) AS weekday, lpad(CAST(hour AS VARCHAR), 2, '0') AS hour,
         CAST(('0x' || substr(md5('42|' || CAST(post_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS INTEGER) AS bucket, {ER} AS label
  FROM pre
  WHERE reach IS NOT NULL AND views IS NOT NULL AND likes IS NOT NULL AND comments IS NOT NULL AND saves IS NOT NULL
    AND shares IS NOT NULL AND follows IS NOT NULL AND post_type IS NOT NULL AND weekday IS NOT NULL
    AND hour IS NOT NULL AND {ER} IS NOT NULL
)
"""
    numbers = ["reach", "views", "likes", "comments", "saves", "shares", "follows"]
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in numbers)
    shown = ", ".join(f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE round((CAST({c} AS DOUBLE) - m_{c}) / s_{c}, 6) END AS scaled_{c}"
                      for c in numbers)
    scaled = f", st AS (SELECT {stats} FROM mr WHERE bucket >= 20) SELECT row_key, {shown} FROM mr CROSS JOIN st"
    cats = ["post_type", "weekday", "hour"]
    levels = ", ".join(f"lv_{c} AS (SELECT DISTINCT {c} AS lv FROM mr WHERE bucket >= 20 "
                       f"AND {c} > (SELECT min({c}) FROM mr WHERE bucket >= 20))" for c in cats)
    digits = ", ".join(f"(SELECT string_agg(CASE WHEN lv = mr.{c} THEN '1' ELSE '0' END, '' ORDER BY lv DESC) "
                       f"FROM lv_{c}) AS one_hot_{c}" for c in cats)
    one_hot = f", {levels} SELECT row_key, {digits} FROM mr"

    def labels(label: str) -> str:
        return f"""
, sc AS (SELECT row_key, (CAST(views AS DOUBLE) % 400) / 10.0 AS p FROM mr),
av AS (SELECT avg({ER}) AS avg_er, max({ER}) AS best FROM pre)
SELECT row_key, p AS predicted_er, {r('p', 2)} AS predicted_er_2dp, {r('avg_er', 2)} AS your_avg_er, p >= avg_er AS above_avg,
       p >= 5.0 AS above_benchmark, {label} AS recommendation, {r('p - avg_er', 1)} AS delta_vs_avg,
       {r('p - 5.0', 1)} AS delta_vs_benchmark, {r('best', 1)} AS best_post_er
FROM sc CROSS JOIN av"""

    def linear(model: str, alpha: float, folds: bool) -> str:
        """Normal equations in long form, solved by Gauss-Jordan steps over a flat matrix; part -1 is the test split."""
        parts = "(VALUES (0), (1), (2), (3), (4)) p(part)" if folds else "(VALUES (-1)) p(part)"
        held = "(CASE WHEN part < 0 THEN bucket < 20 ELSE bucket % 5 = part END)"
        num = " UNION ALL ".join(f"SELECT part, row_key, held, label, 'n_{c}' AS f, (CAST({c} AS DOUBLE) - m_{c}) / s_{c} AS v "
                                 f"FROM al JOIN ms USING (part) WHERE s_{c} > 0" for c in numbers)
        cat = " UNION ALL ".join(f"SELECT a.part, row_key, held, label, 'c_{c}_' || {c} AS f, 1.0 AS v FROM al a JOIN "
                                 f"(SELECT part, min({c}) AS lo FROM al WHERE NOT held GROUP BY part) l ON l.part = a.part WHERE {c} > lo "
                                 f"AND EXISTS (SELECT 1 FROM al t WHERE t.part = a.part AND NOT t.held AND t.{c} = a.{c})" for c in cats)
        solved = f"""
, al AS (SELECT part, {held} AS held, mr.* FROM mr, {parts}),
ms AS (SELECT part, {stats} FROM al WHERE NOT held GROUP BY part),
fx AS ({num} UNION ALL {cat} UNION ALL SELECT part, row_key, held, label, '0' AS f, 1.0 AS v FROM al),
ix AS (SELECT part, f, row_number() OVER (PARTITION BY part ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY part) AS p
       FROM (SELECT DISTINCT part, f FROM fx WHERE NOT held)),
gr AS (SELECT a.part, a.f AS f1, b.f AS f2, sum(a.v * b.v) AS g FROM fx a JOIN fx b ON a.part = b.part AND a.row_key = b.row_key
       WHERE NOT a.held GROUP BY a.part, a.f, b.f
       UNION ALL SELECT part, f, 'y', sum(v * label) FROM fx WHERE NOT held GROUP BY part, f),
en AS (SELECT x.part, x.p, x.i * (x.p + 1) + j.i AS place,
              coalesce(g, 0.0) + CASE WHEN x.f = j.f AND x.f <> '0' THEN {alpha} ELSE 0.0 END AS g
       FROM ix x JOIN (SELECT part, f, i FROM ix UNION ALL SELECT DISTINCT part, 'y', p FROM ix) j ON x.part = j.part
       LEFT JOIN gr ON gr.part = x.part AND gr.f1 = x.f AND gr.f2 = j.f),
m0 AS (SELECT part, p, list(g ORDER BY place) AS a FROM en GROUP BY part, p),
gj AS (SELECT part, p, 0 AS k, a FROM m0
       UNION ALL
       SELECT part, p, k + 1, list_transform(range(p * (p + 1)), lambda x:
         CASE WHEN x // (p + 1) = k THEN a[x + 1] / a[k * (p + 1) + k + 1]
              ELSE a[x + 1] - a[(x // (p + 1)) * (p + 1) + k + 1] * a[k * (p + 1) + x % (p + 1) + 1] / a[k * (p + 1) + k + 1] END)
       FROM gj WHERE k < p),
co AS (SELECT ix.part, f, a[i * (ix.p + 1) + ix.p + 1] AS w FROM gj JOIN ix ON ix.part = gj.part WHERE k = gj.p),
pr AS (SELECT fx.part, row_key, any_value(label) AS label, sum(v * w) AS prediction FROM fx JOIN co ON co.part = fx.part AND co.f = fx.f
       WHERE held GROUP BY fx.part, row_key),
sc AS (SELECT part, 1.0 - sum(pow(label - prediction, 2)) / (var_pop(label) * count(*)) AS r2,
              avg(abs(label - prediction)) AS mae, sqrt(avg(pow(label - prediction, 2))) AS rmse FROM pr GROUP BY part)
"""
        shown = (f"SELECT '{model}' AS model, {r('avg(r2)', 4)} AS cv_r2_mean, {r('stddev_pop(r2)', 4)} AS cv_r2_std FROM sc" if folds else
                 f"SELECT '{model}' AS model, {r('r2', 4)} AS r2, {r('mae', 4)} AS mae, {r('rmse', 4)} AS rmse FROM sc")
        out = q(rows + solved + shown)
        return out if "WITH RECURSIVE" in out else out.replace("WITH", "WITH RECURSIVE", 1)

    return {
        "linear_model": linear("Linear Regression", 0.0, False),
        "ridge_model": linear("Ridge Regression", 1.0, False),
        "cross_validate": linear("Linear Regression", 0.0, True),
        "cross_validate_ridge": linear("Ridge Regression", 1.0, True),
        "scaled_features": q(rows + scaled),
        "one_hot": q(rows + one_hot),
        "prediction_label": q(rows + labels("CASE WHEN p >= avg_er THEN 'Above the account''s mean: worth promoting.' "
                                            "ELSE 'Below the account''s mean: try another type or time.' END")),
        "prediction_label_dashboard": q(rows + labels("CASE WHEN p >= avg_er * 1.1 THEN 'ABOVE YOUR AVERAGE' "
                                                      "WHEN p >= 5.0 THEN 'ABOVE BENCHMARK' ELSE 'BELOW BENCHMARK' END")),
        "model_rows": q(rows + "SELECT row_key, bucket, bucket % 5 AS fold FROM mr"),
        "split": q(rows + "SELECT CASE WHEN bucket < 20 THEN 'test' ELSE 'train' END AS part, count(*) AS rows "
                   "FROM mr GROUP BY 1"),
        "evaluate": q(f"""
, m AS (SELECT post_type, avg({ER}) AS prediction FROM pre GROUP BY post_type),
p AS (SELECT {ER} AS label, prediction FROM pre JOIN m USING (post_type) WHERE {ER} IS NOT NULL),
a AS (SELECT sum(pow(label - prediction, 2)) AS sse, avg(abs(label - prediction)) AS mae,
             avg(pow(label - prediction, 2)) AS mse, var_pop(label) AS vy, count(label) AS n FROM p)
SELECT {r('1.0 - sse / (vy * n)', 4)} AS r2, {r('mae', 4)} AS mae, {r('sqrt(mse)', 4)} AS rmse FROM a"""),
    }


def report_sql() -> dict[str, str]:
    e = eda_sql()

    def part(section: str, body: str, key: str, value: str, text: str) -> str:
        return (f"SELECT '{section}' AS section, CAST({key} AS VARCHAR) AS key, CAST({value} AS DOUBLE) AS value, "
                f"CAST({text} AS VARCHAR) AS text FROM ({body})")

    er_long = " UNION ALL ".join(
        f"SELECT '{c}' AS k, {c} AS v FROM ({e['er_stats']})" for c in
        ["mean", "median", "std", "min", "max", "q25", "q75"])
    parts = [
        part("summary", e["meta_summary"], "'total_posts'", "total_rows", "NULL"),
        part("date_range", e["meta_summary"], "'start'", "NULL", "date_range_start"),
        part("date_range", e["meta_summary"], "'end'", "NULL", "date_range_end"),
        part("engagement_rate", er_long, "k", "v", "NULL"),
        part("day_averages", e["er_by_weekday"], "weekday", "avg_er", "NULL"),
        part("best_day", e["best_weekday"], "'best_day'", "avg_er", "best_weekday"),
        part("top3_hours", e["top_hours"], "rank", "hour", "NULL"),
        part("content_type_avg", e["er_by_type"], "post_type", "avg_er", "NULL"),
        part("content_type_median", e["er_by_type"], "post_type", "median_er", "NULL"),
        part("content_type_posts", e["er_by_type"], "post_type", "posts", "NULL"),
        part("best_content_type", e["best_type"], "'best_type'", "avg_er", "best_type"),
        part("engagement_breakdown", e["interaction_breakdown"], "interaction", "total", "NULL"),
        part("monthly_trend", e["monthly_trend"], "month_end", "avg_er", "NULL"),
        part("top10_posts", e["top_posts"], "rank", ER, "NULL"),
        part("top10_dates", e["top_posts"], "rank", "NULL", "strftime(publish_time, '%Y-%m-%d')"),
        part("top10_types", e["top_posts"], "rank", "NULL", "post_type"),
        part("top10_likes", e["top_posts"], "rank", "likes", "NULL"),
        part("top10_saves", e["top_posts"], "rank", "saves", "NULL"),
        part("benchmark", e["benchmark_check"], "'beats_benchmark'", "benchmark", "beats_benchmark"),
    ]
    density = q(f"""
, st AS (SELECT count({ER}) AS n, stddev_samp({ER}) AS sd, min({ER}) AS lo, max({ER}) AS hi FROM pre),
st2 AS (SELECT *, nullif(sd * pow(CAST(n AS DOUBLE), -0.2), 0) AS bw FROM st WHERE n > 0),
st3 AS (SELECT *, lo - 3.0::DOUBLE * coalesce(bw, 0) AS g_lo, hi + 3.0::DOUBLE * coalesce(bw, 0) AS g_hi, bw / 32 AS cell FROM st2),
st4 AS (SELECT *, (g_hi - g_lo) / 199.0::DOUBLE AS step FROM st3),
placed AS (SELECT ({ER} - lo) / cell AS place FROM pre CROSS JOIN st4 WHERE {ER} IS NOT NULL AND cell IS NOT NULL),
cells AS (SELECT CAST(floor(place) AS BIGINT) AS node, count(*) AS c, sum(place - floor(place)) AS over FROM placed GROUP BY 1),
nodes AS (SELECT node, sum(w) AS w FROM (SELECT node, c - over AS w FROM cells UNION ALL SELECT node + 1, over FROM cells) GROUP BY node),
grid AS (SELECT CAST(range AS INTEGER) AS point, g_lo + range * step AS x, n, bw FROM range(200) CROSS JOIN st4),
s AS (SELECT point, sum(w * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) AS s
      FROM (SELECT w, lo + node * cell AS v FROM nodes CROSS JOIN st4) JOIN grid ON abs(x - v) <= 8 * bw GROUP BY point)
SELECT point, {r('x', 8)} AS x, {r('coalesce(s, 0) / (n * bw * 2.5066282746310002::DOUBLE)', 10)} AS density FROM grid LEFT JOIN s USING (point)""")
    return {"eda_report": " UNION ALL ".join(parts), "er_density": density}


# ---------------------------------------------------------------- Shapiro-Wilk twin
def _poly_sql(coefs: list[float], x: str) -> str:
    acc = repr(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = f"(({acc}) * ({x}) + {c!r})"
    return acc


def norm_ppf_sql(p: str) -> str:
    """AS 241 from the same coefficient table as the Spark expression."""
    from postlytics.functions import distributions as dd

    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    central = f"({q} * {_poly_sql(dd._A, rc)} / {_poly_sql(dd._B, rc)})"
    rr = f"sqrt(-ln(least({p}, 1.0 - ({p}))))"
    near = f"({_poly_sql(dd._C, f'{rr} - 1.6')} / {_poly_sql(dd._D, f'{rr} - 1.6')})"
    far = f"({_poly_sql(dd._E, f'{rr} - 5.0')} / {_poly_sql(dd._Fc, f'{rr} - 5.0')})"
    tail = f"(CASE WHEN {rr} <= 5.0 THEN {near} ELSE {far} END)"
    tail = f"(CASE WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {central} ELSE {tail} END)"


def normcdf_ctes(src: str, out: str, steps: int = 400) -> str:
    """``src(id, z)`` -> ``out(id, cdf)``: series / continued fraction of Q(1/2, z^2/2)."""
    import math as _m

    lg = repr(_m.lgamma(0.5))
    tiny = "1e-300"

    def fx(v):
        return f"(CASE WHEN abs({v}) < {tiny} THEN {tiny} ELSE {v} END)"

    an = "(-(s.i + 1.0) * ((s.i + 1.0) - 0.5))"
    d_new = f"(1.0 / {fx(f'{an} * s.d + (s.b + 2.0)')})"
    c_new = fx(f"(s.b + 2.0) + {an} / s.c")
    return f"""
, {out}_x AS (SELECT id, z, z * z / 2.0 AS x FROM {src}),
{out}_s(id, i, term, total) AS (
  SELECT id, 0, 1.0 / 0.5, 1.0 / 0.5 FROM {out}_x
  UNION ALL
  SELECT s.id, s.i + 1, s.term * x.x / (0.5 + (s.i + 1)), s.total + s.term * x.x / (0.5 + (s.i + 1))
  FROM {out}_s s JOIN {out}_x x ON x.id = s.id WHERE s.i < {steps}
),
{out}_c(id, i, c, d, h, b) AS (
  SELECT id, 0, 1.0 / {tiny}, 1.0 / (x + 0.5), 1.0 / (x + 0.5), x + 0.5 FROM {out}_x
  UNION ALL
  SELECT s.id, s.i + 1, {c_new}, {d_new}, s.h * {d_new} * {c_new}, s.b + 2.0
  FROM {out}_c s WHERE s.i < {steps}
),
{out} AS (
  SELECT x.id,
         CASE WHEN x.z IS NULL THEN NULL WHEN x.z = 0 THEN 0.5
              ELSE (CASE WHEN x.z > 0 THEN 1.0 - uq / 2.0 ELSE uq / 2.0 END) END AS cdf
  FROM (SELECT x.*, CASE WHEN x.x < 1.5
                         THEN 1.0 - s.total * exp(-x.x + 0.5 * ln(x.x) - {lg})
                         ELSE exp(-x.x + 0.5 * ln(x.x) - {lg}) * c.h END AS uq
        FROM {out}_x x JOIN (SELECT id, total FROM {out}_s WHERE i = {steps}) s ON s.id = x.id
        JOIN (SELECT id, h FROM {out}_c WHERE i = {steps}) c ON c.id = x.id) x
)
"""


def shapiro_sql_body(data_cte: str) -> str:
    """CTEs from ``data_cte(grp, x)`` to ``sw(grp, n, w, p)`` (Royston 1995)."""
    c1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
    c2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
    m = norm_ppf_sql("(rank - 0.375) / (n + 0.25)")
    return f"""
, sr AS (SELECT grp, x, row_number() OVER (PARTITION BY grp ORDER BY x) AS rank,
                count(*) OVER (PARTITION BY grp) AS n FROM {data_cte}),
sm AS (SELECT *, {m} AS m, least(rank, n - rank + 1) AS j,
              CASE WHEN rank * 2 < n + 1 THEN -1.0 WHEN rank * 2 > n + 1 THEN 1.0 ELSE 0.0 END AS sgn FROM sr),
sa AS (SELECT grp, n, sum(m * m) AS summ2,
              sum(CASE WHEN j > 2 THEN m * x ELSE 0.0 END) AS mx_mid, sum(CASE WHEN j = 2 THEN m * x ELSE 0.0 END) AS mx_2,
              sum(CASE WHEN j = 1 THEN sgn * x ELSE 0.0 END) AS sx_1, sum(CASE WHEN j = 2 THEN sgn * x ELSE 0.0 END) AS sx_2,
              max(CASE WHEN rank = 1 THEN m END) AS m1, max(CASE WHEN rank = 2 THEN m END) AS m2, var_samp(x) AS var
       FROM sm GROUP BY grp, n HAVING n >= 3),
s1 AS (SELECT *, 1.0 / sqrt(CAST(n AS DOUBLE)) AS u, sqrt(summ2) AS ss FROM sa),
s2 AS (SELECT *, {_poly_sql(c1, 'u')} - m1 / ss AS a1, {_poly_sql(c2, 'u')} - m2 / ss AS a2 FROM s1),
s3 AS (SELECT *, CASE WHEN n > 5 THEN sqrt((summ2 - 2 * pow(m1, 2) - 2 * pow(m2, 2)) / (1 - 2 * pow(a1, 2) - 2 * pow(a2, 2)))
                      ELSE sqrt((summ2 - 2 * pow(m1, 2)) / (1 - 2 * pow(a1, 2))) END AS fac FROM s2),
s4 AS (SELECT *, CASE WHEN n = 3 THEN {0.5 ** 0.5!r} * sx_1
                      ELSE mx_mid / fac + a1 * sx_1 + CASE WHEN n > 5 THEN a2 * sx_2 ELSE mx_2 / fac END END AS lin FROM s3),
s5 AS (SELECT *, least(pow(lin, 2) / (var * (n - 1)), 1.0) AS w FROM s4),
s6 AS (SELECT *, ln(1.0 - w) AS wy, {_poly_sql([-2.273, 0.459], 'CAST(n AS DOUBLE)')} AS gamma FROM s5),
s7 AS (SELECT *, row_number() OVER (ORDER BY grp) AS id,
              CASE WHEN n <= 11 THEN (-ln(gamma - wy) - {_poly_sql([0.5440, -0.39978, 0.025054, -6.714e-4], 'CAST(n AS DOUBLE)')})
                                     / exp({_poly_sql([1.3822, -0.77857, 0.062767, -0.0020322], 'CAST(n AS DOUBLE)')})
                   ELSE (wy - {_poly_sql([-1.5861, -0.31082, -0.083751, 0.0038915], 'ln(CAST(n AS DOUBLE))')})
                        / exp({_poly_sql([-0.4803, -0.082676, 0.0030302], 'ln(CAST(n AS DOUBLE))')}) END AS z FROM s6)
{normcdf_ctes('(SELECT id, z FROM s7)', 'nc')}
, sw AS (
  SELECT s7.grp, s7.n, s7.w,
         CASE WHEN s7.n = 3 THEN greatest(0.0, {6 / 3.141592653589793!r} * (asin(sqrt(s7.w)) - {__import__('math').asin(0.75 ** 0.5)!r}))
              WHEN s7.n <= 11 AND s7.wy >= s7.gamma THEN 1e-99
              ELSE 1.0 - nc.cdf END AS p
  FROM s7 JOIN nc ON nc.id = s7.id
)
"""


def shapiro_sql() -> dict[str, str]:
    body = f"""
, sd AS (SELECT CAST(post_type AS VARCHAR) AS grp, {ER} AS x FROM pre WHERE post_type IS NOT NULL AND {ER} IS NOT NULL)
""" + shapiro_sql_body("sd")
    return {"shapiro_wilk": qr(body + f"SELECT grp, n, {r('w', 4)} AS W, {r('p', 4)} AS p_value, p > 0.05 AS normal FROM sw"),
            "duration_test": duration_test_sql(),
            "duration_test_notebook": duration_test_sql(_REELS_NOTEBOOK, "pooled"), "test_summary": test_summary_sql(),
            "trend_line_ci": trend_band_sql()}


def _anova_ctes(g: str, prefix: str) -> str:
    """``g(grp, n, mean, var)`` -> ``{prefix}2(n_total, k, ssb, ssw, d1, d2, f, eta2)``; always one row."""
    return f"""
, {prefix}t AS (SELECT CAST(sum(n) AS BIGINT) AS n_total, count(*) AS k, sum(n * mean) / sum(n) AS gm FROM {g}),
{prefix}1 AS (SELECT max(t.n_total) AS n_total, coalesce(max(t.k), 0) AS k,
                     sum(g.n * pow(g.mean - t.gm, 2)) AS ssb, sum((g.n - 1) * coalesce(g.var, 0.0)) AS ssw
              FROM {prefix}t t LEFT JOIN {g} g ON TRUE),
{prefix}2 AS (SELECT *, CAST(k - 1 AS DOUBLE) AS d1, CAST(n_total - k AS DOUBLE) AS d2,
                     (ssb / CAST(k - 1 AS DOUBLE)) / (ssw / CAST(n_total - k AS DOUBLE)) AS f,
                     CASE WHEN ssb + ssw > 0 THEN ssb / (ssb + ssw) ELSE 0.0 END AS eta2 FROM {prefix}1)
"""


def duration_test_sql(where: str = _REELS, t_test: str = "levene") -> str:
    pooled = "levene_p > 0.05" if t_test == "levene" else "TRUE"
    n1, n2 = "CAST(n1 AS DOUBLE)", "CAST(n2 AS DOUBLE)"
    se_w = f"sqrt(v1 / {n1} + v2 / {n2})"
    df_w = f"(pow(v1 / {n1} + v2 / {n2}, 2) / (pow(v1 / {n1}, 2) / ({n1} - 1) + pow(v2 / {n2}, 2) / ({n2} - 1)))"
    sp2 = f"((({n1} - 1) * v1 + ({n2} - 1) * v2) / ({n1} + {n2} - 2))"
    se_p = f"sqrt({sp2} * (1.0 / {n1} + 1.0 / {n2}))"
    body = f"""
, reels AS (SELECT CAST(duration_sec AS DOUBLE) AS d, {ER} AS v FROM pre WHERE {where}),
qq AS (SELECT quantile_cont(d, 1.0 / 3.0) AS q1, quantile_cont(d, 2.0 / 3.0) AS q2, min(d) AS dmin, max(d) AS dmax FROM reels),
lab AS (SELECT reels.*, CASE WHEN NOT (dmin < q1 AND q1 < q2 AND q2 < dmax) THEN NULL
                             WHEN d <= q1 THEN 'Short' WHEN d <= q2 THEN 'Medium' ELSE 'Long' END AS grp
        FROM reels CROSS JOIN qq),
t AS (SELECT * FROM lab WHERE grp IS NOT NULL),
g AS (SELECT grp, count(v) AS n, avg(v) AS mean, var_samp(v) AS var,
             CASE grp WHEN 'Short' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS ord
      FROM t GROUP BY grp HAVING count(v) >= 3)
{_anova_ctes('g', 'an')}
, tz AS (SELECT t.grp, t.v FROM t JOIN g USING (grp)),
md AS (SELECT grp, quantile_cont(v, 0.5) AS med FROM tz GROUP BY grp),
zz AS (SELECT grp, abs(v - med) AS z FROM tz JOIN md USING (grp)),
lg AS (SELECT grp, count(z) AS n, avg(z) AS mean, var_samp(z) AS var FROM zz GROUP BY grp)
{_anova_ctes('lg', 'lv')}
, g1 AS (SELECT n AS n1, mean AS m1, var AS v1 FROM g ORDER BY ord LIMIT 1),
g2 AS (SELECT n AS n2, mean AS m2, var AS v2 FROM g ORDER BY ord DESC LIMIT 1),
tt AS (SELECT (m1 - m2) / {se_p} AS tp, ({n1} + {n2} - 2) AS dfp, (m1 - m2) / {se_w} AS tw, {df_w} AS dfw
       FROM (SELECT 1) one LEFT JOIN g1 ON TRUE LEFT JOIN g2 ON TRUE),
src AS (
  SELECT 1 AS id, d2 / 2.0 AS a, d1 / 2.0 AS b, d2 / (d2 + d1 * f) AS x FROM an2
  UNION ALL SELECT 2, d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f) FROM lv2
  UNION ALL SELECT 3, dfp / 2.0, 0.5, dfp / (dfp + tp * tp) FROM tt
  UNION ALL SELECT 4, dfw / 2.0, 0.5, dfw / (dfw + tw * tw) FROM tt
)
{betainc_ctes('src', 'pv')}
, sd2 AS (SELECT grp, v AS x FROM tz)
{shapiro_sql_body('sd2')}
, res AS (
  SELECT (SELECT count(*) FROM reels) AS valid_reels, (SELECT count(*) FROM t) AS total_reels,
         an2.k, an2.f, an2.eta2,
         (SELECT CASE WHEN f <= 0 THEN 1.0 ELSE ibeta END FROM pv, an2 WHERE pv.id = 1) AS p_anova,
         (SELECT ibeta FROM pv WHERE id = 2) AS levene_p,
         tt.tp, tt.tw,
         (SELECT ibeta FROM pv WHERE id = 3) AS p_pooled, (SELECT ibeta FROM pv WHERE id = 4) AS p_welch,
         (SELECT bool_and(p > 0.05) FROM sw) AS normality_passed,
         (SELECT '{{' || string_agg('"' || grp || '":' || CAST(n AS VARCHAR), ',' ORDER BY grp) || '}}' FROM g) AS group_counts,
         (SELECT '{{' || string_agg('"' || grp || '":"' || printf('%.2f%%', mean) || '"', ',' ORDER BY grp) || '}}' FROM g)
           AS group_means,
         (SELECT grp FROM g ORDER BY mean DESC, grp LIMIT 1) AS best
  FROM an2 CROSS JOIN tt
),
fin AS (
  SELECT *, CASE WHEN k = 2 THEN (CASE WHEN {pooled} THEN tp ELSE tw END) ELSE f END AS stat,
            CASE WHEN k = 2 THEN (CASE WHEN {pooled} THEN p_pooled ELSE p_welch END) ELSE p_anova END AS pval
  FROM res
)
SELECT CASE WHEN valid_reels < 15 THEN printf('%d reels with a duration and a rate; the test needs %d.', valid_reels, 15)
            WHEN total_reels = 0 THEN 'The durations'' terciles coincide: no three groups.'
            WHEN k < 2 THEN 'Fewer than two duration groups have enough reels.' END AS error,
       CASE WHEN k = 2 THEN 'Two-Sample t-Test' ELSE 'One-Way ANOVA' END AS test_used,
       valid_reels AS total_reels_analyzed, group_counts, group_means, best AS best_duration_group,
       normality_passed, {r('levene_p', 4)} AS equal_variance_p, {r('stat', 3)} AS statistic,
       {r('pval', 4)} AS p_value, CAST(0.05 AS DOUBLE) AS alpha, pval < 0.05 AS reject_h0,
       {r('eta2', 3)} AS effect_size_eta2,
       'Engagement by duration: ' || CASE WHEN pval < 0.05 THEN 'significant' ELSE 'not significant' END
         || ' difference, p ' || printf('%.4f', pval) || '; null hypothesis '
         || CASE WHEN pval < 0.05 THEN 'rejected' ELSE 'kept' END || '.' AS conclusion,
       CASE WHEN best = 'Short' THEN 'Short reels have the best mean rate: make more of them.'
            ELSE 'Short reels aren''t ahead: vary the content before the length.' END AS agency_recommendation
FROM fin
"""
    return qr(body)


def test_summary_sql() -> str:
    s = stats_sql_base()
    dur = duration_test_sql()

    def pstr(p: str) -> str:
        return f"regexp_replace(printf('%.4f', {p}), '(\\.[0-9]*?)0+$', '\\1')"

    rows = f"""
SELECT 'content_type' AS test_name, test, statistic, p_value, reject_h0, effect_size, effect_label,
       'Rates by content type ' || CASE WHEN reject_h0 THEN 'differ' ELSE 'don''t differ clearly' END || ': p '
       || {pstr('p_value')} || ', effect ' || effect_label || ', highest mean ' || best_group || '.' AS interpretation
FROM ({s['anova_content_type']})
UNION ALL
SELECT 'weekend', test, statistic, p_value, reject_h0, effect_size, effect_label,
       better_period || ' has the higher mean rate, ' || CASE WHEN reject_h0 THEN 'clearly' ELSE 'not clearly' END
       || ': p ' || {pstr('p_value')} || ', effect ' || effect_label || ', weekday '
       || printf('%.2f', weekday_avg) || ', weekend ' || printf('%.2f', weekend_avg) || '.'
FROM ({s['welch_weekend']})
UNION ALL
SELECT 'reel_duration', test_used, statistic, p_value, reject_h0, {r('effect_size_eta2', 4)},
       {_label('effect_size_eta2')}, conclusion
FROM ({dur}) WHERE error IS NULL
"""
    return f"""
SELECT *, CASE WHEN reject_h0 THEN 'reject H0' ELSE 'do not reject H0' END AS decision,
       CASE WHEN reject_h0 THEN 'Act on ' || test_name || ': the difference is real.'
            ELSE 'No action on ' || test_name || ': the difference may be chance.' END AS action
FROM ({rows})
"""


def lgamma_sql(z: str) -> str:
    """Lanczos log-gamma with the Spark expression's coefficients and order of operations."""
    import math as _m

    from postlytics.functions import distributions as dd

    zz = f"(({z}) - 1.0)"
    acc = repr(dd._LANCZOS[0])
    for i, coef in enumerate(dd._LANCZOS[1:], start=1):
        acc = f"({acc} + {coef!r} / ({zz} + {float(i)!r}))"
    t = f"({zz} + {dd._LANCZOS_G + 0.5!r})"
    return f"({0.5 * _m.log(2 * _m.pi)!r} + ({zz} + 0.5) * ln({t}) - {t} + ln({acc}))"


def t_ppf_ctes(src: str, out: str, prob: float = 0.975, iters: int = 80, half_steps: int = 600) -> str:
    """``src(id, df)`` -> ``out(id, tq)``: the Spark bisection (80 halvings of
    [0, 1000] on the two-sided p) with the continued fraction run inside the same
    recursive CTE (``half_steps`` + 1 rows per halving)."""
    J = half_steps

    def mid_terms(lo: str, hi: str, pre: str) -> str:
        mid = f"(({lo} + {hi}) / 2.0)"
        x = f"(df / (df + {mid} * {mid}))"
        a, b = "(df / 2.0)", "0.5"
        sw = f"({x} >= ({a} + 1.0) / ({a} + {b} + 2.0))"
        return (f"{mid} AS {pre}mid, {x} AS {pre}x, {sw} AS {pre}sw, "
                f"CASE WHEN {sw} THEN {b} ELSE {a} END AS {pre}aa, "
                f"CASE WHEN {sw} THEN {a} ELSE {b} END AS {pre}bb, "
                f"CASE WHEN {sw} THEN 1.0 - {x} ELSE {x} END AS {pre}xx")

    def d0(pre: str) -> str:
        return f"(1.0 / {_fx(f'1.0 - ({pre}aa + {pre}bb) * {pre}xx / ({pre}aa + 1.0)')})"

    m = "((j + 2) // 2)"
    odd = f"({m} * (bb - {m}) * xx / ((aa - 1.0 + 2 * {m}) * (aa + 2 * {m})))"
    even = f"(-(aa + {m}) * (aa + bb + {m}) * xx / ((aa + 2 * {m}) * (aa + 1.0 + 2 * {m})))"
    coef = f"(CASE WHEN (j + 1) % 2 = 1 THEN {odd} ELSE {even} END)"
    d_new = f"(1.0 / {_fx(f'1.0 + {coef} * d')})"
    c_new = _fx(f"1.0 + {coef} / c")
    front = (f"exp({lgamma_sql('aa + bb')} - {lgamma_sql('aa')} - {lgamma_sql('bb')} "
             f"+ aa * ln(xx) + bb * ln(1.0 - xx))")
    ibeta = (f"(CASE WHEN x <= 0 THEN 0.0 WHEN x >= 1 THEN 1.0 "
             f"WHEN sw THEN 1.0 - {front} * h / aa ELSE {front} * h / aa END)")
    target = repr((1.0 - prob) * 2.0)
    return f"""
, {out}_rec(id, step, lo, hi, c, d, h, done) AS (
  SELECT id, 0, 0.0::DOUBLE, 1099511627776.0::DOUBLE, 1.0::DOUBLE, {d0('n_')}, {d0('n_')}, false
  FROM (SELECT id, df, {mid_terms('0.0', '1099511627776.0', 'n_')} FROM {src})
  UNION ALL
  SELECT id, step + 1, nlo, nhi,
         CASE WHEN j < {J} THEN (CASE WHEN done THEN c ELSE {c_new} END) ELSE 1.0 END,
         CASE WHEN j < {J} THEN (CASE WHEN done THEN d ELSE {d_new} END) ELSE {d0('n_')} END,
         CASE WHEN j < {J} THEN (CASE WHEN done THEN h ELSE h * {d_new} * {c_new} END) ELSE {d0('n_')} END,
         CASE WHEN j < {J} THEN (done OR ((j + 1) % 2 = 0 AND abs({d_new} * {c_new} - 1.0) < 1e-15)) ELSE false END
  FROM (
    SELECT q2.*, {mid_terms('nlo', 'nhi', 'n_')}
    FROM (
      SELECT q1.*,
             CASE WHEN j = {J} AND {ibeta} > {target} THEN mid ELSE lo END AS nlo,
             CASE WHEN j = {J} AND NOT ({ibeta} > {target}) THEN mid ELSE hi END AS nhi
      FROM (
        SELECT r.id, r.step, r.lo, r.hi, r.c, r.d, r.h, r.done, r.step % ({J} + 1) AS j, s.df,
               {mid_terms('r.lo', 'r.hi', '')}
        FROM {out}_rec r JOIN {src} s ON s.id = r.id
        WHERE r.step < {iters} * ({J} + 1)
      ) q1
    ) q2
  ) q3
),
{out} AS (SELECT id, (lo + hi) / 2.0 AS tq FROM {out}_rec WHERE step = {iters} * ({J} + 1))
"""


def trend_band_sql(points: int = 100, level: float = 0.95) -> str:
    prob = 1 - (1 - level) / 2
    gx = f"(x_lo + g.id * (x_hi - x_lo) / {float(points - 1)!r})"
    fit = f"(a + b * {gx})"
    se = f"sqrt(s2 * (1.0 / n + pow({gx} - mx, 2) / sxx))"
    return qr(f"""
, pairs AS (SELECT CAST(reach AS DOUBLE) AS xc, {ER} AS y FROM pre WHERE reach IS NOT NULL AND {ER} IS NOT NULL),
st0 AS (SELECT count(*) AS n, avg(xc) AS mx, avg(y) AS my, var_pop(xc) AS vx, regr_slope(y, xc) AS b,
               regr_intercept(y, xc) AS a, min(xc) AS x_lo, max(xc) AS x_hi, sum(y * y) AS syy,
               sum(xc * y) AS sxy, sum(y) AS sy FROM pairs),
st AS (SELECT *, greatest(syy - a * sy - b * sxy, 0.0) / (n - 2) AS s2, vx * n AS sxx FROM st0),
tsrc AS (SELECT 1 AS id, CAST(n - 2 AS DOUBLE) AS df FROM st)
{t_ppf_ctes('tsrc', 'tt', prob)}
SELECT CAST(g.id AS INTEGER) AS point, {r(gx, 6)} AS x, {r(fit, 6)} AS fit,
       {r(f'{fit} - tq * {se}', 6)} AS ci_low, {r(f'{fit} + tq * {se}', 6)} AS ci_high
FROM (SELECT range AS id FROM range({points})) g CROSS JOIN st CROSS JOIN tt""")
