"""Column functions over vectors and Dirichlet evidence: arrays of double, all built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def unit(x: Column) -> Column:
    """x / |x|; a zero vector stays."""
    return let(x, lambda a: let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda v: v / n)).otherwise(a)))


def unit_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of unit vectors."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot(a, b)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def digamma(x: Column) -> Column:
    """Shift by 6, then the asymptotic series to 1/x^8; error under 1e-9 for x >= 1."""
    y = x + 6
    r = 1 / (y * y)
    series = F.ln(y) - 0.5 / y - r * (F.lit(1 / 12) - r * (F.lit(1 / 120) - r * (F.lit(1 / 252) - r * F.lit(1 / 240))))
    return series - 1 / x - 1 / (x + 1) - 1 / (x + 2) - 1 / (x + 3) - 1 / (x + 4) - 1 / (x + 5)


def lgamma(x: Column) -> Column:
    """Stirling's series after a shift by 6."""
    y = x + 6
    series = (y - 0.5) * F.ln(y) - y + F.lit(0.9189385332046727) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y)
    return series - F.ln(x) - F.ln(x + 1) - F.ln(x + 2) - F.ln(x + 3) - F.ln(x + 4) - F.ln(x + 5)


def epistemic(alpha: Column) -> Column:
    """Of one position: sum rho (psi(a + 1) - psi(S + 1)) - sum rho ln rho, at least 0."""
    parts = let(F.struct(alpha.alias("x"), total(alpha).alias("s")), lambda t: F.transform(t["x"], lambda a: a / t["s"] * (digamma(a + 1) - digamma(t["s"] + 1)) - a / t["s"] * F.ln(a / t["s"])))
    return F.greatest(total(parts), F.lit(0.0))


def aleatoric(alpha: Column, most: float = 0.95) -> Column:
    """Of one position: sum rho (psi(S + 1) - psi(a + 1)), kept in 0 to `most`."""
    parts = let(F.struct(alpha.alias("x"), total(alpha).alias("s")), lambda t: F.transform(t["x"], lambda a: a / t["s"] * (digamma(t["s"] + 1) - digamma(a + 1))))
    return F.least(F.greatest(total(parts), F.lit(0.0)), F.lit(most))


def bayes_risk(alpha: Column, label: Column) -> Column:
    """Cross-entropy Bayes risk: psi(S) - psi(alpha of the label)."""
    return digamma(total(alpha)) - digamma(F.get(alpha, label))


def type_two_likelihood(alpha: Column, label: Column) -> Column:
    return F.ln(total(alpha)) - F.ln(F.get(alpha, label))


def squares_risk(alpha: Column, label: Column) -> Column:
    """Sum of squares Bayes risk: sum (y - rho)^2 + rho (1 - rho) / (S + 1)."""
    s = total(alpha)
    part = lambda a, i: (F.when(i == label, 1.0).otherwise(0.0) - a / s) * (F.when(i == label, 1.0).otherwise(0.0) - a / s) + a / s * (1 - a / s) / (s + 1)
    return total(F.transform(alpha, part))


def dirichlet_kl(alpha: Column) -> Column:
    """Divergence from Dir(alpha) to the uniform Dirichlet of the same size."""
    s, k = total(alpha), F.size(alpha).cast("double")
    parts = F.transform(alpha, lambda a: (a - 1) * (digamma(a) - digamma(s)) - lgamma(a))
    return lgamma(s) - lgamma(k) + total(parts)


def without_label(alpha: Column, label: Column) -> Column:
    """Evidence of the label taken out, as the divergence term wants it: alpha of the label becomes 1."""
    return F.transform(alpha, lambda a, i: F.when(i == label, 1.0).otherwise(a))


def annealing(epoch: Column, over: int) -> Column:
    return F.least(F.lit(1.0), epoch / over)


def late_annealing(epoch: Column, start: int = 5, over: int = 10) -> Column:
    """0 up to epoch `start`, then rising to 1 over as many epochs as `over` says."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (epoch - start) / over))


def pair_weight(ui: Column, uj: Column, ai: Column, aj: Column, temperature: float = 1.0) -> Column:
    """exp(-(u_i + u_j) / temperature) * (1 - max(ale_i, ale_j))"""
    return F.exp(-(ui + uj) / temperature) * (1 - F.greatest(ai, aj))


def entropy_strength(p: Column) -> Column:
    """1 / (1 + H(p))"""
    return 1 / (1 - total(F.transform(p, lambda x: F.when(x > 0, x * F.ln(x)).otherwise(0.0))))
