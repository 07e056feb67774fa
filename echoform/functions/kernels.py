"""Elementary models as column expressions: activation, match, update and new weight of one (row, weight) pair.

The same formulas as operators.kernels, for plans that stay inside the JVM: scoring
against literal or joined weights, and the native fold for small fits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoform.functions.vectors import bind, concat, dot, gap2, head, least, mix, product, total

one = lambda v: F.array(v)


@dataclass(frozen=True)
class NativeKernel:
    """Functions of (x, w) columns. spread: the sum of counts that Gaussian activations are shared by."""

    choice: Callable[[Column, Column], Column]
    match: Callable[[Column, Column], Column]
    update: Callable[[Column, Column], Column]
    new: Callable[[Column], Column]


def fuzzy(d: int, alpha: float = 1e-10, beta: float = 1.0) -> NativeKernel:
    both = lambda x, w: total(least(x, w))
    below = lambda w: F.lit(alpha) + total(w)
    return NativeKernel(
        lambda x, w: F.when(below(w) == 0, F.lit(0.0)).otherwise(both(x, w) / F.when(below(w) == 0, F.lit(1.0)).otherwise(below(w))),
        lambda x, w: both(x, w) / F.lit(float(d)), lambda x, w: mix(least(x, w), w, beta), lambda x: x,
    )


def art1(d: int, L: float = 2.0) -> NativeKernel:
    down = lambda w: F.slice(w, d + 1, d)
    kept = lambda x, w: F.zip_with(x, down(w), lambda a, b: F.when(b != 0, a).otherwise(F.lit(0.0)))
    scale = lambda t: F.lit(L) / (F.lit(L - 1) + total(t))
    return NativeKernel(
        lambda x, w: dot(x, head(w, d)), lambda x, w: F.size(F.filter(F.zip_with(x, down(w), lambda a, b: (a != 0) & (b != 0)), lambda v: v)) / F.lit(float(d)),
        lambda x, w: concat(F.transform(kept(x, w), lambda v: (scale(kept(x, w)) * v).cast("float").cast("double")), kept(x, w)),
        lambda x: concat(F.transform(x, lambda v: F.lit(L / (L - 1 + d)) * v), x),
    )


def art2a(alpha: float = 0.0, beta: float = 1.0) -> NativeKernel:
    return NativeKernel(dot, lambda x, w: F.when(dot(x, w) >= F.lit(alpha) * total(x), dot(x, w)).otherwise(F.lit(-1.0)), lambda x, w: mix(x, w, beta), lambda x: x)


def hypersphere(d: int, alpha: float = 1e-10, beta: float = 1.0, r_hat: float = 1.0) -> NativeKernel:
    radius = lambda w: F.get(w, F.lit(d))
    r = lambda x, w: F.sqrt(gap2(x, head(w, d)))
    most = lambda x, w: F.greatest(radius(w), r(x, w))
    ratio = lambda x, w: F.when(r(x, w) + F.lit(alpha) == 0, F.lit(1.0)).otherwise(F.least(radius(w), r(x, w)) / (r(x, w) + F.lit(alpha)))
    return NativeKernel(
        lambda x, w: (F.lit(r_hat) - most(x, w)) / (F.lit(r_hat) - radius(w) + F.lit(alpha)), lambda x, w: F.lit(1.0) - most(x, w) / F.lit(r_hat),
        lambda x, w: concat(F.zip_with(x, head(w, d), lambda a, c: c + F.lit(beta / 2) * (a - c) * (F.lit(1.0) - ratio(x, w))), one(radius(w) + F.lit(beta / 2) * (most(x, w) - radius(w)))),
        lambda x: concat(x, one(F.lit(0.0))),
    )


def ellipsoid(d: int, alpha: float = 1e-10, beta: float = 1.0, mu: float = 0.8, r_hat: float = 1.0) -> NativeKernel:
    radius, axis = (lambda w: F.get(w, F.lit(2 * d))), (lambda w: F.slice(w, d + 1, d))
    gap = lambda x, w: F.zip_with(x, head(w, d), lambda a, b: a - b)
    along = lambda x, w: dot(axis(w), gap(x, w))
    r = lambda x, w: F.when(F.exists(axis(w), lambda v: v != 0), F.sqrt(F.greatest(F.lit(0.0), gap2(x, head(w, d)) - F.lit(1 - mu**2) * along(x, w) * along(x, w))) / F.lit(mu)).otherwise(F.sqrt(gap2(x, head(w, d))))
    most = lambda x, w: F.greatest(radius(w), r(x, w))
    # Each step is computed once: inside a lambda it would be computed for every number.
    near = lambda q, w: F.when(q == 0, F.lit(1.0)).otherwise(F.least(radius(w), q) / F.when(q == 0, F.lit(1.0)).otherwise(q))
    centre = lambda x, w, q: bind(near(q, w), lambda n: F.zip_with(x, head(w, d), lambda a, c: c + F.lit(beta / 2) * (a - c) * (F.lit(1.0) - n)))
    turned = lambda x, w, c: bind(F.sqrt(gap2(x, c)), lambda s: F.when((radius(w) != 0) & (s != 0), F.zip_with(x, c, lambda a, v: (a - v) / F.when(s == 0, F.lit(1.0)).otherwise(s))).otherwise(axis(w)))
    update = lambda x, w: bind(r(x, w), lambda q: bind(centre(x, w, q), lambda c: concat(c, turned(x, w, c), one(radius(w) + F.lit(beta / 2) * (F.greatest(radius(w), q) - radius(w))))))
    return NativeKernel(
        lambda x, w: (F.lit(r_hat) - radius(w) - most(x, w)) / (F.lit(r_hat + alpha) - 2 * radius(w)), lambda x, w: F.lit(1.0) - (radius(w) + most(x, w)) / F.lit(r_hat),
        update, lambda x: concat(x, F.array_repeat(F.lit(0.0), d + 1)),
    )


def gaussian(d: int, alpha: float = 1e-10, sigma: float = 0.5, spread: Column | float = 1.0) -> NativeKernel:
    mean, inverse = (lambda w: head(w, d)), (lambda w: F.slice(w, 2 * d + 1, d))
    root, count = (lambda w: F.get(w, F.lit(3 * d))), (lambda w: F.get(w, F.lit(3 * d + 1)))
    share = lambda: F.lit(spread) if isinstance(spread, float) else spread
    e = lambda x, w: F.exp(F.lit(-0.5) * dot(F.zip_with(mean(w), x, lambda a, b: (a - b) * (a - b)), inverse(w)))
    n = lambda w: count(w) + 1
    moved = lambda x, w: F.zip_with(x, mean(w), lambda a, m: (F.lit(1.0) - 1 / n(w)) * m + a / n(w))
    square = lambda x, w: F.zip_with(F.slice(w, d + 1, d), F.zip_with(moved(x, w), x, lambda m, a: (m - a) * (m - a)), lambda s, g: (F.lit(1.0) - 1 / n(w)) * s * s + g / n(w))
    return NativeKernel(
        lambda x, w: e(x, w) / (F.lit(alpha) + root(w)) * count(w) / share(), e,
        lambda x, w: concat(moved(x, w), F.transform(square(x, w), F.sqrt), F.transform(square(x, w), lambda v: 1 / v), F.array(F.sqrt(product(square(x, w))), n(w))),
        lambda x: concat(x, F.array_repeat(F.lit(sigma), d), F.array_repeat(F.lit(1 / sigma**2), d), F.array(F.lit(sigma**d), F.lit(1.0))),
    )


def bayesian2(spread: Column | float = 1.0, variance: float = 1e-2) -> NativeKernel:
    """Two dimensions, where inverse and determinant have closed forms. The vigilance bounds the match from above."""
    at = lambda w, k: F.get(w, F.lit(k))
    det = lambda w: at(w, 2) * at(w, 5) - at(w, 3) * at(w, 4)
    u, v = (lambda x, w: at(x, 0) - at(w, 0)), (lambda x, w: at(x, 1) - at(w, 1))
    share = lambda: F.lit(spread) if isinstance(spread, float) else spread
    power = lambda x, w: (at(w, 5) * u(x, w) * u(x, w) - (at(w, 3) + at(w, 4)) * u(x, w) * v(x, w) + at(w, 2) * v(x, w) * v(x, w)) / det(w)

    def update(x: Column, w: Column) -> Column:
        n = at(w, 6)
        m = [(F.lit(1.0) - 1 / (n + 1)) * at(w, k) + at(x, k) / (n + 1) for k in (0, 1)]
        g = [at(x, k) - m[k] for k in (0, 1)]
        return F.array(*m, *[n / (n + 1) * at(w, 2 + 2 * i + j) + g[i] * g[j] / (n + 1) for i in (0, 1) for j in (0, 1)], n + 1)

    return NativeKernel(lambda x, w: F.exp(F.lit(-0.5) * power(x, w)) / (F.lit(2.0) * F.pi() * F.sqrt(det(w))) * at(w, 6) / share(), lambda x, w: det(update(x, w)), update, lambda x: concat(x, F.array(*[F.lit(v) for v in (variance, 0.0, 0.0, variance, 1.0)])))


def quadratic(d: int, s: float = 0.5, lr_b: float = 0.1, lr_w: float = 0.1, lr_s: float = 0.1) -> NativeKernel:
    matrix_row, b, width = (lambda w, i: F.slice(w, i * d + 1, d)), (lambda w: F.slice(w, d * d + 1, d)), (lambda w: F.get(w, F.lit(d * d + d)))
    z = lambda x, w: F.array(*[dot(matrix_row(w, i), x) for i in range(d)])
    active = lambda zz, w: F.exp(-width(w) * width(w) * gap2(zz, b(w)))
    t = lambda x, w: bind(z(x, w), lambda zz: active(zz, w))

    def update(x: Column, w: Column) -> Column:
        # Projection, activation and pulls are computed once, not for every number of the weight.
        def moved(zz: Column, at: Column, pull: Column) -> Column:
            row = lambda i: bind(F.get(pull, F.lit(i)), lambda p: F.zip_with(matrix_row(w, i), x, lambda a, v: a - F.lit(lr_w) * p * v))
            rows = [row(i) for i in range(d)]
            return concat(*rows, F.array(*[F.get(b(w), F.lit(i)) + F.lit(lr_b) * F.get(pull, F.lit(i)) for i in range(d)]), one(width(w) - F.lit(lr_s) * 2 * width(w) * at * gap2(zz, b(w))))

        pulls = lambda zz, at: F.zip_with(zz, b(w), lambda p, q: 2 * width(w) * width(w) * at * (p - q))
        return bind(z(x, w), lambda zz: bind(active(zz, w), lambda at: bind(pulls(zz, at), lambda pull: moved(zz, at, pull))))

    eye = [1.0 if i == j else 0.0 for i in range(d) for j in range(d)]
    return NativeKernel(
        t, t,
        update,
        lambda x: concat(F.array(*[F.lit(v) for v in eye]), x, one(F.lit(s))),
    )
