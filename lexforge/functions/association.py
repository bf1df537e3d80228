"""Association measures on a two-by-two table as column expressions: o11 joint, f1 and f2 marginal counts, n the total."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def expected(f1, f2, n) -> Column:
    return _d(f1) * _d(f2) / _d(n)


def log_dice(o11, f1, f2) -> Column:
    """14 + log2 of the Dice coefficient; 0 where there is no joint occurrence."""
    dice = 2 * _d(o11) / (_d(f1) + _d(f2))
    return F.when(dice > 0, 14 + F.log2(dice)).otherwise(0.0)


def dice(o11, f1, f2) -> Column:
    return F.when(_d(f1) + _d(f2) > 0, 2 * _d(o11) / (_d(f1) + _d(f2))).otherwise(0.0)


def mutual_information(o11, f1, f2, n, power: int = 1) -> Column:
    """log2 of observed (to `power`) over expected."""
    return F.when(_d(o11) > 0, F.log2(F.pow(_d(o11), F.lit(float(power))) / expected(f1, f2, n))).otherwise(0.0)


def t_score(o11, f1, f2, n) -> Column:
    return F.when(_d(o11) > 0, (_d(o11) - expected(f1, f2, n)) / F.sqrt(_d(o11))).otherwise(0.0)


def _cell(o: Column, e: Column) -> Column:
    return F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(0.0)


def log_likelihood(o11, f1, f2, n) -> Column:
    """G squared over the four cells, an empty cell adding nothing."""
    a, r, c, t = _d(o11), _d(f1), _d(f2), _d(n)
    b, x = r - a, c - a
    y = t - r - c + a
    return 2 * (_cell(a, r * c / t) + _cell(b, r * (t - c) / t) + _cell(x, (t - r) * c / t) + _cell(y, (t - r) * (t - c) / t))


def keyness(o1, n1, o2, n2) -> Column:
    """Signed log-likelihood of a frequency in a focus corpus against a reference; negative where it is rarer there."""
    a, p, b, q = _d(o1), _d(n1), _d(o2), _d(n2)
    e1, e2 = p * (a + b) / (p + q), q * (a + b) / (p + q)
    g = 2 * (_cell(a, e1) + _cell(b, e2))
    return F.when(a / p >= b / q, g).otherwise(-g)


def chi_square(o1, n1, o2, n2) -> Column:
    """Signed chi square of the two-by-two table of a word in two corpora."""
    a, p, b, q = _d(o1), _d(n1), _d(o2), _d(n2)
    c, e, n = p - a, q - b, p + q
    top = n * F.pow(a * e - b * c, F.lit(2.0))
    low = (a + b) * (c + e) * p * q
    x = F.when(low > 0, top / low).otherwise(0.0)
    return F.when(a / p >= b / q, x).otherwise(-x)


MEASURES = {
    "logdice": lambda o, f1, f2, n: log_dice(o, f1, f2), "dice": lambda o, f1, f2, n: dice(o, f1, f2), "mi": mutual_information,
    "mi3": lambda o, f1, f2, n: mutual_information(o, f1, f2, n, 3), "t": t_score, "g2": log_likelihood,
}
