"""Registered queries: distributions, correlation, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens import constants as K
from loanlens.operators import corr, distribution, histogram, sample
from loanlens.oracle import D, with_customers
from loanlens.plans.registry import register
from loanlens.sources.customers import customers

R6 = 6

# --- FIXED VALUES: the published coefficients of Acklam's approximation, kept
# apart from the operator's own so that a slip in either shows.
_A = [-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690,
      -30.66479806614716, 2.506628277459239]
_B = [-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972,
      -13.28068155288572]
_C = [-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734,
      4.374664141464968, 2.938163982698783]
_D = [0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416]
_P_LOW = 0.02425


# ------------------------------------------------------------ SQL helpers ---
def _edge_sql(i: str, bins: int) -> str:
    return (f"(CASE WHEN {i} >= {bins} THEN hi ELSE CAST({i} AS DOUBLE) * "
            f"((hi - lo) / {D(bins)}) + lo END)")


def hist_sql_ctes(values_select: str, bins: int, keyed: bool, p: str = "h") -> str:
    """CTEs ``{p}_out`` with (k?, bin, bin_lo, bin_hi, count) for the values
    ``(k?, x)`` produced by ``values_select``."""
    k = "k, " if keyed else ""
    on = "USING (k)" if keyed else "ON TRUE"
    return f"""{p}_v AS ({values_select}),
{p}_r AS (SELECT {k}CASE WHEN min(x) = max(x) THEN min(x) - {D(0.5)} ELSE min(x) END AS lo,
          CASE WHEN min(x) = max(x) THEN max(x) + {D(0.5)} ELSE max(x) END AS hi
          FROM {p}_v {'GROUP BY k' if keyed else ''}),
{p}_i0 AS (SELECT {k}x, lo, hi, least(CAST(floor((x - lo) / (hi - lo) * {D(bins)}) AS INTEGER),
           {bins - 1}) AS i0 FROM {p}_v JOIN {p}_r {on}),
{p}_i1 AS (SELECT {k}x, lo, hi, CASE WHEN x < {_edge_sql('i0', bins)} THEN i0 - 1 ELSE i0 END
           AS i1 FROM {p}_i0),
{p}_i2 AS (SELECT {k}CASE WHEN x >= {_edge_sql('i1 + 1', bins)} AND i1 <> {bins - 1}
           THEN i1 + 1 ELSE i1 END AS bin FROM {p}_i1),
{p}_c AS (SELECT {k}bin, count(*) AS cnt FROM {p}_i2 GROUP BY {k}bin),
{p}_g AS (SELECT {k}lo, hi, CAST(g.bin AS INTEGER) AS bin FROM {p}_r,
          (SELECT range AS bin FROM range(0, {bins})) AS g),
{p}_out AS (SELECT {k}bin, {_edge_sql('bin', bins)} AS bin_lo, {_edge_sql('bin + 1', bins)}
            AS bin_hi, coalesce(cnt, 0) AS "count" FROM {p}_g LEFT JOIN {p}_c USING ({k}bin))"""


def _horner_sql(coefs, x: str, tail_one: bool = False) -> str:
    acc = D(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {D(c)})"
    return f"({acc} * {x} + {D(1.0)})" if tail_one else acc


def norm_ppf_sql(p: str) -> str:
    q = f"({p} - {D(0.5)})"
    r = f"({q} * {q})"
    central = f"({_horner_sql(_A, r)} * {q} / {_horner_sql(_B, r, True)})"
    ql = f"sqrt({D(-2.0)} * ln({p}))"
    lower = f"({_horner_sql(_C, ql)} / {_horner_sql(_D, ql, True)})"
    qu = f"sqrt({D(-2.0)} * ln({D(1.0)} - {p}))"
    upper = f"(-({_horner_sql(_C, qu)} / {_horner_sql(_D, qu, True)}))"
    return (f"(CASE WHEN {p} < {D(_P_LOW)} THEN {lower} WHEN {p} > {D(1.0 - _P_LOW)} "
            f"THEN {upper} ELSE {central} END)")


def md5_order(key: str, seed: int) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|' || '{seed}')"


def sample_sql(n: int, seed: int, cols: str) -> str:
    return (f"SELECT {cols} FROM customers ORDER BY {md5_order('RespondentID', seed)}, "
            f"RespondentID LIMIT {n}")


# ------------------------------------------------------------- histograms ---
def _hist_entry(c: str, bins: int):
    sql = with_customers(
        'SELECT bin, bin_lo, bin_hi, "count" FROM h_out',
        hist_sql_ctes(f"SELECT CAST({c} AS DOUBLE) AS x FROM customers WHERE {c} IS NOT NULL",
                      bins, False))
    register(f"histogram_{c}", sql, digits={"bin_lo": R6, "bin_hi": R6})(
        lambda spark, d: histogram.histogram(customers(spark, d), c, bins))


_hist_entry("CreditScore", 50)
_hist_entry("AnnualIncome_INR", 40)
_hist_entry("EmergencyFundMonths", 45)


def _hist_by_entry(c: str, key: str, bins: int):
    sql = with_customers(
        f'SELECT k AS {key}, bin, bin_lo, bin_hi, "count" FROM h_out',
        hist_sql_ctes(f"SELECT {key} AS k, CAST({c} AS DOUBLE) AS x FROM customers "
                      f"WHERE {key} IS NOT NULL AND {c} IS NOT NULL", bins, True))
    register(f"histogram_{c}_by_{key}", sql, digits={"bin_lo": R6, "bin_hi": R6})(
        lambda spark, d: histogram.histogram_by(customers(spark, d), c, key, bins))


_hist_by_entry("CreditScore", "LoanApproved", 40)
_hist_by_entry("EmergencyFundMonths", "CityTier", 40)


def _grid_sql(cols, bins):
    vals = " UNION ALL ".join(f"SELECT '{c}' AS k, CAST({c} AS DOUBLE) AS x FROM customers "
                              f"WHERE {c} IS NOT NULL" for c in cols)
    mom = ("mo AS (SELECT k, avg(x) AS mean, avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), "
           f"{D(1.5)}) AS skew FROM h_v JOIN (SELECT k, avg(x) AS mu FROM h_v GROUP BY k) "
           "AS __m USING (k) GROUP BY k)")
    return with_customers(
        'SELECT k AS feature, bin, bin_lo, bin_hi, "count", mean, skew FROM h_out '
        "LEFT JOIN mo USING (k)", hist_sql_ctes(vals, bins, True) + ",\n" + mom)


_GRID = [c for c in K.GRID_COLUMNS if c in K.CUSTOMER_COLUMNS]
register("histogram_grid", _grid_sql(_GRID, 30),
         digits={"bin_lo": R6, "bin_hi": R6, "mean": R6, "skew": R6})(
    lambda spark, d: histogram.histogram_grid(customers(spark, d), _GRID, 30))


# ------------------------------------------------------------- box plots ----
def _box_sql(key, c):
    return with_customers(
        'SELECT g AS "group", count(*) AS n, q1, median, q3, '
        "coalesce(min(CASE WHEN x >= lo_f THEN x END), q1) AS whisker_lo, "
        "coalesce(max(CASE WHEN x <= hi_f THEN x END), q3) AS whisker_hi, "
        "count(*) FILTER (WHERE x < lo_f OR x > hi_f) AS n_fliers "
        "FROM bv JOIN bf USING (g) GROUP BY g, q1, median, q3, lo_f, hi_f",
        f"bv AS (SELECT CAST({key} AS VARCHAR) AS g, CAST({c} AS DOUBLE) AS x FROM customers "
        f"WHERE {key} IS NOT NULL AND {c} IS NOT NULL),\n"
        "bq AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, "
        "quantile_cont(x, 0.75) AS q3 FROM bv GROUP BY g),\n"
        f"bf AS (SELECT g, q1, median, q3, q1 - {D(1.5)} * (q3 - q1) AS lo_f, "
        f"q3 + {D(1.5)} * (q3 - q1) AS hi_f FROM bq)")


for _key, _c in [("MarketingSegment", "CreditScore"), ("LoanApproved", "RiskScore"),
                 ("RepaymentHistory", "EmergencyFundMonths")]:
    register(f"box_{_c}_by_{_key}", _box_sql(_key, _c),
             digits={"q1": R6, "median": R6, "q3": R6})(
        (lambda k, c: lambda spark, d: distribution.box_stats(customers(spark, d), k, c))(
            _key, _c))


@register("box_fliers_AnnualIncome_INR_by_CityTier", with_customers(
    'SELECT g AS "group", x FROM bv JOIN bf USING (g) WHERE x < lo_f OR x > hi_f',
    "bv AS (SELECT CAST(CityTier AS VARCHAR) AS g, CAST(AnnualIncome_INR AS DOUBLE) AS x "
    "FROM customers WHERE CityTier IS NOT NULL AND AnnualIncome_INR IS NOT NULL),\n"
    "bq AS (SELECT g, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 "
    "FROM bv GROUP BY g),\n"
    f"bf AS (SELECT g, q1 - {D(1.5)} * (q3 - q1) AS lo_f, q3 + {D(1.5)} * (q3 - q1) AS hi_f "
    "FROM bq)"))
def box_fliers(spark, d):
    """A15 fliers."""
    return distribution.box_fliers(customers(spark, d), "CityTier", "AnnualIncome_INR")


# ------------------------------------------------------------------ Q-Q -----
def _qq_points_sql(c):
    p = ("CASE WHEN i = n - 1 THEN pow(" + D(0.5) + f", {D(1.0)} / CAST(n AS DOUBLE)) "
         f"WHEN i = 0 THEN {D(1.0)} - pow({D(0.5)}, {D(1.0)} / CAST(n AS DOUBLE)) "
         f"ELSE (CAST(i + 1 AS DOUBLE) - {D(0.3175)}) / (CAST(n AS DOUBLE) + {D(0.365)}) END")
    return (f"qv AS (SELECT CAST({c} AS DOUBLE) AS x FROM customers WHERE {c} IS NOT NULL),\n"
            "qr AS (SELECT row_number() OVER (ORDER BY x) - 1 AS i, x, "
            "(SELECT count(*) FROM qv) AS n FROM qv),\n"
            f"qp AS (SELECT i, x, {p} AS p FROM qr),\n"
            f"qq AS (SELECT CAST(i AS BIGINT) AS i, p, {norm_ppf_sql('p')} AS theoretical, "
            "x AS sample FROM qp)")


for _c in ["CreditScore", "AnnualIncome_INR"]:
    register(f"qq_points_{_c}", with_customers("SELECT i, p, theoretical, sample FROM qq",
                                                _qq_points_sql(_c)),
             digits={"p": 9, "theoretical": R6})(
        (lambda c: lambda spark, d: distribution.qq_points(customers(spark, d), c))(_c))
    register(f"qq_fit_{_c}", with_customers(
        "SELECT count(*) AS n, regr_slope(sample, theoretical) AS slope, "
        "regr_intercept(sample, theoretical) AS intercept, "
        "covar_pop(theoretical, sample) / (stddev_pop(theoretical) * stddev_pop(sample)) AS r "
        "FROM qq", _qq_points_sql(_c)), digits={"slope": 4, "intercept": 4, "r": R6})(
        (lambda c: lambda spark, d: distribution.qq_fit(customers(spark, d), c))(_c))


# ------------------------------------------------------------ correlation ---
_NC = [c for c in K.CORR_COLUMNS if c in K.CUSTOMER_COLUMNS]


def _pair_sql(a, b, i, j):
    x, y = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
    return (f"SELECT '{a}' AS a, '{b}' AS b, CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, "
            f"CASE WHEN min({x}) = max({x}) OR min({y}) = max({y}) THEN NULL ELSE "
            f"covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END AS r "
            f"FROM customers WHERE {a} IS NOT NULL AND {b} IS NOT NULL")


def _diag_sql(a, i):
    return (f"SELECT '{a}' AS a, '{a}' AS b, CAST({i} AS INTEGER) AS i, CAST({i} AS INTEGER) AS j, "
            f"CASE WHEN min(CAST({a} AS DOUBLE)) < max(CAST({a} AS DOUBLE)) THEN {D(1.0)} END AS r "
            f"FROM customers")


def _corr_sql(cols, triangle):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                parts.append(_pair_sql(a, b, i, j))
            elif j > i and not triangle:
                parts.append(_pair_sql(a, b, i, j))
            elif i == j and not triangle:
                parts.append(_diag_sql(a, i))
    return with_customers(" UNION ALL ".join(parts))


register("corr_matrix", _corr_sql(_NC, False), digits={"r": R6})(
    lambda spark, d: corr.corr_matrix(customers(spark, d), _NC))
register("corr_lower_triangle", _corr_sql(_NC, True), digits={"r": R6})(
    lambda spark, d: corr.corr_matrix(customers(spark, d), _NC, triangle=True))


def _corr_with_sql(target):
    parts = [f"SELECT feature, r FROM ({_pair_sql(c, target, 0, 0)}) AS __p".replace(
        f"'{c}' AS a", f"'{c}' AS feature") for c in _NC if c != target]
    return " UNION ALL ".join(parts)


for _t in ["CreditScore", "LoanApproved"]:
    register(f"corr_with_{_t}", with_customers(
        f"SELECT feature, r FROM ({_corr_with_sql(_t)}) AS __u ORDER BY r, feature"),
        digits={"r": R6})(
        (lambda t: lambda spark, d: corr.corr_with(customers(spark, d), _NC, t))(_t))

register("top_drivers_CreditScore", with_customers(
    "(SELECT 'positive' AS side, feature, r FROM cw WHERE r > 0 ORDER BY r DESC, feature LIMIT 4) "
    "UNION ALL (SELECT 'negative' AS side, feature, r FROM cw WHERE r < 0 "
    "ORDER BY r, feature LIMIT 4)", f"cw AS ({_corr_with_sql('CreditScore')})"),
    digits={"r": R6})(
    lambda spark, d: corr.top_drivers(customers(spark, d), _NC, "CreditScore", 4))


@register("linregress_scatter", with_customers(
    "SELECT count(*) AS n, regr_slope(CAST(NumDependents AS DOUBLE), CAST(Age AS DOUBLE)) "
    "AS slope, regr_intercept(CAST(NumDependents AS DOUBLE), CAST(Age AS DOUBLE)) AS intercept, "
    "covar_pop(CAST(Age AS DOUBLE), CAST(NumDependents AS DOUBLE)) / "
    "(stddev_pop(CAST(Age AS DOUBLE)) * stddev_pop(CAST(NumDependents AS DOUBLE))) AS r "
    "FROM s WHERE Age IS NOT NULL AND NumDependents IS NOT NULL HAVING count(*) >= 6",
    f"s AS ({sample_sql(700, 1, 'RespondentID, Age, NumDependents')})"),
    digits={"slope": R6, "intercept": R6, "r": R6})
def linregress_scatter(spark, d):
    """A25 on the interactive scatter's sample (700 rows, seed 1)."""
    s = sample.scatter_table(customers(spark, d), "Age", "NumDependents", n=700, seed=1)
    return corr.linregress(s, "Age", "NumDependents")


# --------------------------------------------------------------- sampling ---
_PP = [c for c in K.PAIRPLOT_DEFAULTS if c in K.CUSTOMER_COLUMNS]


@register("pair_sample", with_customers(
    sample_sql(500, 42, "RespondentID, LoanApproved, " + ", ".join(_PP))))
def pair_sample(spark, d):
    """K3 + K4: the 500-row pair-plot sample."""
    return sample.pair_table(customers(spark, d), _PP, n=500, seed=42)


def _pair_diag_sql():
    parts = []
    ctes = [f"ps AS ({sample_sql(500, 42, 'RespondentID, LoanApproved, ' + ', '.join(_PP))})"]
    for n, c in enumerate(_PP):
        ctes.append(hist_sql_ctes(f"SELECT LoanApproved AS k, CAST({c} AS DOUBLE) AS x FROM ps "
                                  f"WHERE LoanApproved IS NOT NULL AND {c} IS NOT NULL",
                                  20, True, p=f"h{n}"))
        parts.append(f'SELECT k AS LoanApproved, bin, bin_lo, bin_hi, "count", '
                     f"'{c}' AS feature FROM h{n}_out")
    return with_customers(" UNION ALL ".join(parts), ",\n".join(ctes))


register("pair_diagonal", _pair_diag_sql(), digits={"bin_lo": R6, "bin_hi": R6})(
    lambda spark, d: sample.pair_diagonal(customers(spark, d), _PP, n=500, seed=42, bins=20))


@register("scatter_sample", with_customers(
    sample_sql(700, 1, "RespondentID, Age, NumDependents, LoanApproved")))
def scatter_sample(spark, d):
    """K4 scatter table."""
    return sample.scatter_table(customers(spark, d), "Age", "NumDependents", n=700, seed=1)


@register("split_summary", with_customers(
    "SELECT is_test, count(*) AS n, avg(CAST(LoanApproved AS DOUBLE)) AS approval_rate "
    "FROM (SELECT CAST(CASE WHEN CAST('0x' || substr(" + md5_order("RespondentID", 42)
    + ", 1, 8) AS BIGINT) % 100 < 20 THEN 1 ELSE 0 END AS INTEGER) AS is_test, LoanApproved "
    "FROM customers) AS __s GROUP BY is_test"), digits={"approval_rate": R6})
def split_summary(spark, d):
    """M2: the seeded 80/20 split, summarised."""
    s = sample.split(customers(spark, d), 20, 42)
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"),
                                    F.avg(F.col("LoanApproved").cast("double"))
                                    .alias("approval_rate"))
