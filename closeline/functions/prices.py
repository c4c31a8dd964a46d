"""Price arithmetic as column expressions (American odds, probabilities, stakes)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EDGE_THRESHOLD = 0.02
PRICE_BAND = (-400.0, 600.0)

# Size of a stake in units, by trust and by length of price.
BASE_UNITS, MAX_UNITS, UNIT_STEP = 1.0, 2.0, 0.2
LADDER_FROM = 200
LADDER = ((500, 0.6), (1500, 0.4))
LONGEST_UNITS = 0.2

# Rational approximation of the normal distribution function
# (Hart 1968, algorithm 5666), accurate to double precision.
_HART_TOP = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
_HART_BOTTOM = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: Column | str) -> Column:
    """Double, or null when unreadable or NaN."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def payout(odds: Column | str) -> Column:
    """Units won per unit staked; null for zero or unreadable odds."""
    o = number(odds)
    return F.when(o > 0, o / 100.0).when(o < 0, -100.0 / o)


def ranked_payout(odds: Column | str) -> Column:
    """Payout for ordering: unreadable sorts below every price."""
    return F.coalesce(payout(odds), F.lit(float("-inf")))


def decimal_price(odds: Column | str) -> Column:
    """Decimal price of a board quote; only |odds| >= 100 is a price."""
    o = number(odds)
    return F.when(o >= 100, 1.0 + o / 100.0).when(o <= -100, 1.0 - 100.0 / o)


def implied(odds: Column | str) -> Column:
    return 1.0 / (1.0 + payout(odds))


def expected_value(probability: Column | str, odds: Column | str) -> Column:
    return number(probability) * (1.0 + payout(odds)) - 1.0


def profit_units(outcome: Column | str, odds: Column | str) -> Column:
    o = F.lower(F.trim(col(outcome)))
    return (
        F.when(o == "won", payout(odds))
        .when(o == "lost", F.lit(-1.0))
        .when(o.isin("push", "void"), F.lit(0.0))
    )


def in_price_band(odds: Column | str, band: tuple[float, float] = PRICE_BAND) -> Column:
    return number(odds).between(*band)


def power_exponent(first: Column | str, second: Column | str) -> Column:
    """k > 1 with first**k + second**k = 1; null unless both in (0,1) and sum > 1.

    The left side is convex and falling in k, so Newton steps from k = 1 rise to the
    root and never pass it; sixteen steps reach double precision.
    """
    a, b = col(first), col(second)
    valid = (a > 0) & (a < 1) & (b > 0) & (b < 1) & (a + b > 1)

    def step(k: Column, _i: Column) -> Column:
        pa, pb = F.pow(a, k), F.pow(b, k)
        return k - (pa + pb - 1.0) / (pa * F.ln(a) + pb * F.ln(b))

    k = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(1.0), step)
    return F.when(valid, k)


def power_fair(first: Column | str, second: Column | str) -> Column:
    """Margin-free probability of the first side by the power rule."""
    return F.pow(col(first), power_exponent(first, second))


def normal_cdf(x: Column | str) -> Column:
    x = col(x).cast("double")
    z = F.abs(x)

    def horner(coefficients: tuple[float, ...]) -> Column:
        total = F.lit(coefficients[0])
        for c in coefficients[1:]:
            total = total * z + F.lit(c)
        return total

    near = F.exp(-z * z / 2.0) * horner(_HART_TOP) / horner(_HART_BOTTOM)
    far = F.exp(-z * z / 2.0) / (
        2.506628274631 * (z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65)))))
    )
    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def bet_down_to(
    probability: Column | str,
    threshold: float = EDGE_THRESHOLD,
    band: tuple[float, float] = PRICE_BAND,
) -> Column:
    """Shortest American price that keeps the edge; null when it is past the band."""
    p = number(probability)
    need = (1.0 + threshold) / p - 1.0
    raw = -F.floor(F.round(F.try_divide(F.lit(100.0), need), 9))
    start = F.when(need >= 1.0, F.ceil(F.round(100.0 * need, 9))).otherwise(
        F.when(raw == -100, F.lit(100)).otherwise(raw)
    ).cast("double")

    def worsen(a: Column, _i: Column) -> Column:
        ok = p * (1.0 + F.when(a > 0, a / 100.0).otherwise(-100.0 / a)) - 1.0 >= threshold
        return F.when(ok, a).when(a == -101, F.lit(101.0)).otherwise(a + 1.0)

    american = F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, worsen)
    return (
        F.when(p.isNull() | ~((p > 0) & (p < 1)), None)
        .when(need <= 0, F.lit(int(band[0])))
        .when(american > band[1], None)
        .otherwise(F.greatest(american, F.lit(float(band[0]))))
        .cast("long")
    )


def bet_down_to_from_edge(edge: Column | str, odds: Column | str, **rule) -> Column:
    return bet_down_to((1.0 + number(edge)) / (1.0 + payout(odds)), **rule)


def ladder_units(price: Column | str) -> Column:
    p = number(price)
    out = F.when(p.isNull() | (p < LADDER_FROM), None)
    for longest, size in LADDER:
        out = out.when(p <= longest, F.lit(size))
    return out.otherwise(F.lit(LONGEST_UNITS))


def units(weight: Column | str, price: Column | str) -> Column:
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(weight)))
    stepped = F.bround(BASE_UNITS * (1.0 + w) / UNIT_STEP, 0) * UNIT_STEP
    trusted = F.round(F.greatest(F.lit(BASE_UNITS), F.least(F.lit(MAX_UNITS), stepped)), 2)
    return F.coalesce(ladder_units(price), F.when(number(weight).isNull(), F.lit(BASE_UNITS)).otherwise(trusted))


def wilson(successes: Column, trials: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 0) without trials."""
    n = trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    scale = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / scale
    half = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n)) / scale
    return (
        F.when(trials > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0)),
        F.when(trials > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(0.0)),
    )


def shrink(observed: Column, n: Column, prior: Column | float, k: Column | float) -> Column:
    """n/(n+k) of the observed value, the rest of the prior; the prior without data."""
    prior = prior if isinstance(prior, Column) else F.lit(float(prior))
    weight = F.try_divide(n, n + k)
    blended = weight * observed + (1.0 - weight) * prior
    return F.when((n > 0) & (n + k > 0), blended).otherwise(prior)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


# Rational approximations of the normal quantile's tail (algorithm AS 241), by powers of r.
_NEAR = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
         (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
_FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def upper_quantile(tail: Column) -> Column:
    """Normal quantile that leaves ``tail`` (up to 0.075) above it, to about 1e-15."""
    r = F.sqrt(-F.ln(tail))

    def ratio(x: Column, parts) -> Column:
        above, below = (sum_by_powers(x, c) for c in parts)
        return above / below

    return F.when(r <= 5.0, ratio(r - 1.6, _NEAR)).otherwise(ratio(r - 5.0, _FAR))


def sum_by_powers(x: Column, factors) -> Column:
    """Polynomial with the given factors, constant first."""
    out = F.lit(float(factors[-1]))
    for f in reversed(factors[:-1]):
        out = out * x + F.lit(float(f))
    return out
