"""Random columns as pure functions of (seed, index): any partition can draw any row's number, and a retry draws the same.

The bits come from a 64-bit hash of the seed, the stream and the index; distributions use inversion or Box-Muller.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(idx: Column, seed: int, stream: int = 0, low: float = 0.0, high: float = 1.0) -> Column:
    bits = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), F.lit(stream), idx), F.lit(11))
    return bits * (2.0**-53) * (high - low) + low


def integers(idx: Column, seed: int, low: int, high: int, stream: int = 0) -> Column:
    return F.floor(uniform(idx, seed, stream) * (high - low)).cast("long") + low


def normal(idx: Column, seed: int, mean: float = 0.0, sd: float = 1.0, stream: int = 0) -> Column:
    u, v = uniform(idx, seed, 2 * stream + 1), uniform(idx, seed, 2 * stream + 2)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v) * sd + mean


def exponential(idx: Column, seed: int, scale: float = 1.0, stream: int = 0) -> Column:
    return -F.log(1 - uniform(idx, seed, stream)) * scale


def lognormal(idx: Column, seed: int, mean: float = 0.0, sd: float = 1.0, stream: int = 0) -> Column:
    return F.exp(normal(idx, seed, mean, sd, stream))


def weibull(idx: Column, seed: int, a: float, stream: int = 0) -> Column:
    return F.pow(exponential(idx, seed, 1.0, stream), F.lit(1.0 / a))


def pareto(idx: Column, seed: int, a: float, stream: int = 0) -> Column:
    return F.exp(exponential(idx, seed, 1.0, stream) / a) - 1


def logistic(idx: Column, seed: int, loc: float = 0.0, scale: float = 1.0, stream: int = 0) -> Column:
    u = F.greatest(uniform(idx, seed, stream), F.lit(2.0**-53))
    return F.log(u / (1 - u)) * scale + loc


def gumbel(idx: Column, seed: int, loc: float = 0.0, scale: float = 1.0, stream: int = 0) -> Column:
    return -F.log(F.greatest(exponential(idx, seed, 1.0, stream), F.lit(2.0**-1000))) * scale + loc


def laplace(idx: Column, seed: int, loc: float = 0.0, scale: float = 1.0, stream: int = 0) -> Column:
    u = uniform(idx, seed, stream) - 0.5
    return F.lit(loc) - F.signum(u) * F.log(1 - 2 * F.abs(u) + 2.0**-60) * scale


def rayleigh(idx: Column, seed: int, scale: float = 1.0, stream: int = 0) -> Column:
    return F.sqrt(2 * exponential(idx, seed, 1.0, stream)) * scale


def standard_cauchy(idx: Column, seed: int, stream: int = 0) -> Column:
    return F.tan(math.pi * (uniform(idx, seed, stream) - 0.5))


def triangular(idx: Column, seed: int, left: float, mode: float, right: float, stream: int = 0) -> Column:
    u, cut = uniform(idx, seed, stream), (mode - left) / (right - left)
    return F.when(u < cut, left + F.sqrt(u * (right - left) * (mode - left))).otherwise(right - F.sqrt((1 - u) * (right - left) * (right - mode)))


def geometric(idx: Column, seed: int, p: float, stream: int = 0) -> Column:
    return F.ceil(exponential(idx, seed, 1.0, stream) / -math.log1p(-p)).cast("long")


def bernoulli(idx: Column, seed: int, p: float, stream: int = 0) -> Column:
    return uniform(idx, seed, stream) < p


def binomial(idx: Column, seed: int, n: int, p: float, stream: int = 0) -> Column:
    """The number of successes among n draws, n streams of the row."""
    draws = F.sequence(F.lit(1), F.lit(n))
    hit = lambda s, k: s + F.when(F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), F.lit(stream), idx, k), F.lit(11)) * (2.0**-53) < p, 1).otherwise(0)
    return F.aggregate(draws, F.lit(0), hit)


def poisson(idx: Column, seed: int, lam: float, stream: int = 0, most: int | None = None) -> Column:
    """By inversion over the cumulative probabilities, up to where the rest is below 2**-53."""
    most = most or int(lam + 12 * math.sqrt(lam) + 20)
    total, p, out = 0.0, math.exp(-lam), F.lit(0)
    u = uniform(idx, seed, stream)
    for k in range(most):
        total += p
        out = out + (u >= total).cast("int")
        p *= lam / (k + 1)
    return out


def choice(idx: Column, seed: int, values: list, weights: list[float] | None = None, stream: int = 0) -> Column:
    weights = weights or [1.0] * len(values)
    u, total, out = uniform(idx, seed, stream) * sum(weights), 0.0, F.lit(values[-1])
    edges = []
    for w in weights:
        total += w
        edges.append(total)
    for v, e in reversed(list(zip(values[:-1], edges[:-1], strict=True))):
        out = F.when(u < e, F.lit(v)).otherwise(out)
    return out


def permutation(df: DataFrame, idx: str, seed: int, out: str = "place") -> DataFrame:
    """A random order of all rows: ranks of their hashes, numbered in two passes."""
    from gridloom.operators.scan import row_index

    return row_index(df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(idx))), ["__h", idx], out).drop("__h")


def shuffle_within(df: DataFrame, idx: str, by: list[str], seed: int, out: str = "place") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.col(idx)), idx)) - 1)


# Distributions by transformation, rejection-free: fixed numbers of hashed draws a row -----------------------------------


def _draw(idx: Column, seed: int, stream: int, k: Column) -> Column:
    """The k-th uniform of a row's own stream, in (0, 1)."""
    return (F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), F.lit(stream), idx, k), F.lit(11)) + 0.5) * (2.0**-53)


def standard_gamma(idx: Column, seed: int, shape: float, stream: int = 0, tries: int = 24) -> Column:
    """Marsaglia and Tsang's method with ``tries`` proposals a row, of which the first accepted counts.

    A proposal is rejected with probability below 0.05, so that all of them fail with probability below 1e-31; the shape is
    raised by one below 1 and the result scaled back.
    """
    a = shape + 1 if shape < 1 else shape
    d = a - 1 / 3
    c = 1 / math.sqrt(9 * d)

    def attempt(k: Column) -> Column:
        x = F.sqrt(-2 * F.log(_draw(idx, seed, stream, 3 * k))) * F.cos(2 * math.pi * _draw(idx, seed, stream, 3 * k + 1))
        v = F.pow(1 + c * x, F.lit(3.0))
        u = _draw(idx, seed, stream, 3 * k + 2)
        return F.when((v > 0) & (F.log(u) < 0.5 * x * x + d - d * v + d * F.log(F.when(v > 0, v))), d * v)

    first = lambda acc, k: F.coalesce(acc, attempt(k))
    out = F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(tries)), F.lit(None).cast("double"), first), F.lit(d))
    return out * F.pow(_draw(idx, seed, stream, F.lit(0)), F.lit(1.0 / shape)) if shape < 1 else out


def gamma(idx: Column, seed: int, shape: float, scale: float = 1.0, stream: int = 0) -> Column:
    return standard_gamma(idx, seed, shape, stream) * scale


def beta(idx: Column, seed: int, a: float, b: float, stream: int = 0) -> Column:
    x, y = standard_gamma(idx, seed, a, 2 * stream + 101), standard_gamma(idx, seed, b, 2 * stream + 102)
    return x / (x + y)


def chisquare(idx: Column, seed: int, df: float, stream: int = 0) -> Column:
    return 2 * standard_gamma(idx, seed, df / 2, stream)


def noncentral_chisquare(idx: Column, seed: int, df: float, nonc: float, stream: int = 0) -> Column:
    """A central one of df - 1 and the square of a shifted normal; for df of at most 1 a Poisson mixture of central ones would be needed."""
    if df <= 1:
        raise ValueError("df must be above 1")
    return chisquare(idx, seed, df - 1, 2 * stream + 201) + F.pow(normal(idx, seed, math.sqrt(nonc), 1.0, 2 * stream + 202), F.lit(2.0))


def f(idx: Column, seed: int, dfnum: float, dfden: float, stream: int = 0) -> Column:
    return chisquare(idx, seed, dfnum, 2 * stream + 301) / dfnum / (chisquare(idx, seed, dfden, 2 * stream + 302) / dfden)


def noncentral_f(idx: Column, seed: int, dfnum: float, dfden: float, nonc: float, stream: int = 0) -> Column:
    return noncentral_chisquare(idx, seed, dfnum, nonc, 2 * stream + 401) / dfnum / (chisquare(idx, seed, dfden, 2 * stream + 402) / dfden)


def standard_t(idx: Column, seed: int, df: float, stream: int = 0) -> Column:
    return normal(idx, seed, 0.0, 1.0, 2 * stream + 501) / F.sqrt(chisquare(idx, seed, df, 2 * stream + 502) / df)


def power(idx: Column, seed: int, a: float, stream: int = 0) -> Column:
    return F.pow(uniform(idx, seed, stream), F.lit(1.0 / a))


def wald(idx: Column, seed: int, mean: float, scale: float, stream: int = 0) -> Column:
    """Inverse Gaussian by the method of Michael, Schucany and Haas."""
    y = F.pow(normal(idx, seed, 0.0, 1.0, 2 * stream + 601), F.lit(2.0)) * mean
    x = mean + mean / (2 * scale) * (y - F.sqrt(4 * scale * y + y * y))
    return F.when(uniform(idx, seed, 2 * stream + 602) <= mean / (mean + x), x).otherwise(mean * mean / x)


def negative_binomial(idx: Column, seed: int, n: float, p: float, stream: int = 0) -> Column:
    """Failures before the n-th success: a Poisson count whose rate is gamma, by the waiting times of one row's own stream."""
    rate = standard_gamma(idx, seed, n, stream + 701) * ((1 - p) / p)
    most = int(n * (1 - p) / p + 12 * math.sqrt(n * (1 - p)) / p + 40 / p + 40)
    u = uniform(idx, seed, stream + 702)
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), (acc["t"] + acc["p"] * rate / k).alias("t"), (acc["n"] + F.when(u >= acc["t"], 1).otherwise(0)).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("t"), F.lit(0).alias("n")), step, lambda acc: acc["n"]).cast("long")


def logseries(idx: Column, seed: int, p: float, stream: int = 0) -> Column:
    """Kemp's method."""
    u, v = uniform(idx, seed, 2 * stream + 801), _draw(idx, seed, 2 * stream + 802, F.lit(0))
    q = 1 - F.exp(math.log1p(-p) * u)
    return F.when(v >= p, 1).when(v <= q * q, F.floor(1 + F.log(v) / F.log(q))).when(v >= q, 1).otherwise(2).cast("long")


def zipf(idx: Column, seed: int, a: float, stream: int = 0, tries: int = 40) -> Column:
    """Rejection from a Pareto proposal (Devroye), the first of ``tries`` that is accepted."""
    b = 2.0 ** (a - 1)

    def attempt(k: Column) -> Column:
        x = F.floor(F.pow(_draw(idx, seed, stream, 2 * k), F.lit(-1.0 / (a - 1))))
        t = F.pow(1 + 1 / x, F.lit(a - 1))
        return F.when((x < 2.0**62) & (_draw(idx, seed, stream, 2 * k + 1) * x * (t - 1) / (b - 1) <= t / b), x)

    first = lambda acc, k: F.coalesce(acc, attempt(k))
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(tries)), F.lit(None).cast("long"), first), F.lit(1)).cast("long")


def hypergeometric(idx: Column, seed: int, good: int, bad: int, sample: int, stream: int = 0) -> Column:
    """Draws without replacement, one after the other."""
    step = lambda acc, k: acc + F.when(_draw(idx, seed, stream, k) * (good + bad - k + 1) < good - acc, 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(sample)), F.lit(0), step).cast("long") if sample else F.lit(0).cast("long")


def dirichlet(idx: Column, seed: int, alpha: list[float], stream: int = 0) -> Column:
    """An array of shares that add up to 1."""
    parts = F.array(*[standard_gamma(idx, seed, a, 100 * stream + 901 + k) for k, a in enumerate(alpha)])
    return F.transform(F.array(parts), lambda g: F.transform(g, lambda x: x / F.aggregate(g, F.lit(0.0), lambda s, y: s + y)))[0]


def multinomial(idx: Column, seed: int, n: int, weights: list[float], stream: int = 0) -> Column:
    """How often each outcome comes up in n draws, as an array."""
    total, edges = 0.0, []
    for w in weights:
        total += w / sum(weights)
        edges.append(total)
    which = lambda k: sum(((_draw(idx, seed, stream, k) >= e).cast("int") for e in edges[:-1]), F.lit(0))
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), which)
    return F.transform(F.array(draws), lambda d: F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda j: F.size(F.filter(d, lambda x: x == j))))[0]


def multivariate_normal(idx: Column, seed: int, mean: list[float], cov: list[list[float]], stream: int = 0) -> Column:
    """Independent normals through the Cholesky factor of the covariance, as an array."""
    import numpy as np

    low = np.linalg.cholesky(np.asarray(cov, float))
    z = [normal(idx, seed, 0.0, 1.0, 50 * stream + 1001 + k) for k in range(len(mean))]
    return F.array(*[sum((z[k] * float(low[i, k]) for k in range(i + 1)), F.lit(float(mean[i]))) for i in range(len(mean))])


def vonmises(idx: Column, seed: int, mu: float, kappa: float, stream: int = 0, tries: int = 60) -> Column:
    """Best and Fisher's rejection, the first of ``tries`` that is accepted."""
    tau = 1 + math.sqrt(1 + 4 * kappa * kappa)
    rho = (tau - math.sqrt(2 * tau)) / (2 * kappa)
    r = (1 + rho * rho) / (2 * rho)

    def attempt(k: Column) -> Column:
        z = F.cos(math.pi * _draw(idx, seed, stream, 3 * k))
        w = (1 + r * z) / (r + z)
        y = kappa * (r - w)
        v = _draw(idx, seed, stream, 3 * k + 1)
        sign = F.when(_draw(idx, seed, stream, 3 * k + 2) < 0.5, -1.0).otherwise(1.0)
        return F.when((y * (2 - y) - v >= 0) | (F.log(y / v) + 1 - y >= 0), sign * F.acos(w))

    first = lambda acc, k: F.coalesce(acc, attempt(k))
    angle = F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(tries)), F.lit(None).cast("double"), first), F.lit(0.0)) + mu
    return angle - 2 * math.pi * F.floor((angle + math.pi) / (2 * math.pi))


def standard_normal(idx: Column, seed: int, stream: int = 0) -> Column:
    return normal(idx, seed, 0.0, 1.0, stream)


def standard_exponential(idx: Column, seed: int, stream: int = 0) -> Column:
    return exponential(idx, seed, 1.0, stream)


def random(idx: Column, seed: int, stream: int = 0) -> Column:
    return uniform(idx, seed, stream)
