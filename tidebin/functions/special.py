"""Distribution functions and published test tables, for use inside tasks."""

from __future__ import annotations

import math

import numpy as np

# MacKinnon (1994) p-value polynomials for a regression with constant,
# lowest power first, with the range in which they hold.
ADF_P_SMALL = (2.1659, 1.4412, 0.038269)
ADF_P_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_P_SWITCH = -1.61
ADF_P_MAX = 2.74
ADF_P_MIN = -18.83

# MacKinnon (2010) critical values with constant, in powers of 1/T.
ADF_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.04),
    "10%": (-2.56677, -1.5384, -2.809),
}

# Dickey-Fuller percentiles with constant and trend (Banerjee et al. 1993).
TREND_P = (0.01, 0.025, 0.05, 0.10, 0.90, 0.95, 0.975, 0.99)
TREND_N = (25, 50, 100, 250, 500, 100_000)
TREND_TABLE = (
    (-4.38, -3.95, -3.60, -3.24, -1.14, -0.80, -0.50, -0.15),
    (-4.15, -3.80, -3.50, -3.18, -1.19, -0.87, -0.58, -0.24),
    (-4.04, -3.73, -3.45, -3.15, -1.22, -0.90, -0.62, -0.28),
    (-3.99, -3.69, -3.43, -3.13, -1.23, -0.92, -0.64, -0.31),
    (-3.98, -3.68, -3.42, -3.13, -1.24, -0.93, -0.65, -0.32),
    (-3.96, -3.66, -3.41, -3.12, -1.25, -0.94, -0.66, -0.33),
)


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def adf_pvalue(stat: float) -> float:
    if not math.isfinite(stat):
        return float("nan")
    if stat > ADF_P_MAX:
        return 1.0
    if stat < ADF_P_MIN:
        return 0.0
    poly = ADF_P_SMALL if stat <= ADF_P_SWITCH else ADF_P_LARGE
    return normal_cdf(sum(c * stat**i for i, c in enumerate(poly)))


def adf_critical(n: float) -> dict[str, float]:
    return {level: sum(c / n**i for i, c in enumerate(poly)) for level, poly in ADF_CRITICAL.items()}


def trend_pvalue(stat: float, n: int) -> float:
    """p-value by table: linear in n, then linear in p, clamped to [0.01, 0.99]."""
    row = [np.interp(n, TREND_N, column) for column in zip(*TREND_TABLE)]
    return float(np.interp(stat, row, TREND_P))


def student_t_pvalues(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """`student_t_pvalue` of many values at once."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    out = np.full(t.shape, np.nan)
    good = np.isfinite(t) & (df > 0)
    a, x = df[good] / 2.0, df[good] / (df[good] + t[good] ** 2)
    b = np.full(len(a), 0.5)
    swap = x > (a + 1.0) / (a + b + 2.0)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1.0 - x, x)
    logs = {v: math.lgamma(v) for v in np.unique(np.concatenate([a, b, a + b])).tolist()}
    log_gamma = np.vectorize(logs.get, otypes=[float])
    tail = np.zeros(len(a))
    for m in range(400, 0, -1):
        k = m // 2
        coef = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)) if m % 2 else k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        tail = coef / (1.0 + tail)
    if len(a):
        with np.errstate(divide="ignore"):
            front = log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)
        value = np.where(x <= 0.0, 0.0, np.exp(front) / (a * (1.0 + tail)))
        out[good] = np.where(swap, 1.0 - value, value)
    return out


def student_t_pvalue(t: float, df: float) -> float:
    """Two-sided p-value, as the regularised incomplete beta I_x(df/2, 1/2)."""
    if not (math.isfinite(t) and df > 0):
        return float("nan")
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    # evaluated from the far end; 400 terms exceed double precision in this half
    tail = 0.0
    for m in range(400, 0, -1):
        k = m // 2
        if m % 2:
            coef = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        else:
            coef = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        tail = coef / (1.0 + tail)
    return math.exp(log_front) / (a * (1.0 + tail))
