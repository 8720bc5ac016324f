"""Statistics as Column expressions: Wilson bounds, binomial tails, exact tests, risk p-values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Fixed value: one-sided 95 % normal quantile as the score uses it.
Z95 = 1.645
#: Lanczos coefficients for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def wilson_lcb(k, n, z: float = Z95) -> Column:
    """One-sided Wilson lower bound of k of n, in [0, 1]; 0 without trials."""
    k, n = d(k), d(n)
    p = k / F.nullif(n, F.lit(0.0))
    zz = z * z
    bound = (p + zz / (2 * n) - z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n)
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), bound)))


def unanimous_score(n, z: float = Z95) -> Column:
    """wilson_lcb(n, n): n / (n + z**2)."""
    n = d(n)
    return F.when(n <= 0, 0.0).otherwise(n / (n + z * z))


def min_samples_for(want, z: float = Z95, most: int = 100_000) -> Column:
    """The fewest unanimous samples whose score reaches `want`; 0 if no fan-out up to `most` does."""
    want = d(want)
    near = F.greatest(F.lit(1), F.ceil(z * z * want / F.nullif(1 - want, F.lit(0.0))))
    n = F.when((near > 1) & (unanimous_score(near - 1, z) >= want), near - 1).when(unanimous_score(near, z) < want, near + 1).otherwise(near)
    return F.when((want < 1) & (n <= most), n).otherwise(0).cast("long")


def log_gamma(x) -> Column:
    """ln Gamma(x) for x >= 0.5."""
    x = d(x) - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.log(t) - t + F.log(series)


def log_choose(n, k) -> Column:
    n, k = d(n), d(k)
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def _fraction(a: Column, b: Column, x: Column, steps: int) -> Column:
    """Lentz's continued fraction of the incomplete beta function; steps should exceed a few sqrt(max(a, b))."""
    tiny = F.lit(1e-300)
    guard = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    first = let(1 - (a + b) * x / (a + 1), lambda v: 1 / guard(v))
    start = let(first, lambda f: F.struct(f.alias("d"), F.lit(1.0).alias("c"), f.alias("h"), F.lit(False).alias("done")))

    def term(i: Column) -> Column:
        m = F.floor(i / 2).cast("double")
        return let(m, lambda m: F.when(i % 2 == 0, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))).otherwise(-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))))

    def step(s: Column, i: Column) -> Column:
        bare = let(term(i), lambda t: F.struct((1 + t * s["d"]).alias("d"), (1 + t / s["c"]).alias("c")))
        safe = let(bare, lambda v: F.struct((1 / guard(v["d"])).alias("d"), guard(v["c"]).alias("c")))
        moved = let(safe, lambda v: F.struct(v["d"].alias("d"), v["c"].alias("c"), (s["h"] * v["d"] * v["c"]).alias("h"), ((i % 2 == 1) & (F.abs(v["d"] * v["c"] - 1) < 1e-15)).alias("done")))
        return F.when(s["done"], s).otherwise(moved)

    stretch = 40  # steps between two looks at whether the fraction has converged
    on = lambda s, i: F.when(s["done"], s).otherwise(F.aggregate(F.sequence(i, i + stretch - 1), s, step))
    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * steps + 1), F.lit(stretch)), start, on)["h"]


def beta_inc(a, b, x, steps: int = 300) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    given = F.struct(d(a).alias("a"), d(b).alias("b"), d(x).alias("x"))

    def inside(v: Column) -> Column:
        swap = v["x"] >= (v["a"] + 1) / (v["a"] + v["b"] + 2)  # the fraction converges fast below this point
        turned = F.when(swap, F.struct(v["b"].alias("a"), v["a"].alias("b"), (1 - v["x"]).alias("x"), swap.alias("swap"))).otherwise(F.struct(v["a"].alias("a"), v["b"].alias("b"), v["x"].alias("x"), swap.alias("swap")))

        def value(u: Column) -> Column:
            front = F.exp(log_gamma(u["a"] + u["b"]) - log_gamma(u["a"]) - log_gamma(u["b"]) + u["a"] * F.log(u["x"]) + u["b"] * F.log(1 - u["x"]))
            return let(front * _fraction(u["a"], u["b"], u["x"], steps) / u["a"], lambda r: F.when(u["swap"], 1 - r).otherwise(r))

        return F.when(v["x"] <= 0, 0.0).when(v["x"] >= 1, 1.0).otherwise(let(turned, value))

    return let(given, inside)


def binom_cdf(k, n, p, steps: int = 300) -> Column:
    """P(X <= k) for X ~ Binomial(n, p); k < 0 gives 0, k >= n gives 1."""
    given = F.struct(d(k).alias("k"), d(n).alias("n"), d(p).alias("p"))
    cdf = lambda v: F.when(v["k"] < 0, 0.0).when(v["k"] >= v["n"], 1.0).when(v["p"] <= 0, 1.0).when(v["p"] >= 1, 0.0).otherwise(beta_inc(v["n"] - v["k"], v["k"] + 1, 1 - v["p"], steps))
    return let(given, cdf)


def bernoulli_kl(a, b) -> Column:
    """Divergence of Bernoulli(a) from Bernoulli(b); infinite where b rules out what a allows."""
    a, b = F.least(F.greatest(d(a), F.lit(0.0)), F.lit(1.0)), d(b)
    inf = F.lit(float("inf"))
    left = F.when(a <= 0, 0.0).when(b <= 0, inf).otherwise(a * F.log(a / b))
    right = F.when(a >= 1, 0.0).when(b >= 1, inf).otherwise((1 - a) * F.log((1 - a) / (1 - b)))
    return left + right


def hoeffding_bentkus(risk, n, alpha) -> Column:
    """p-value of the null `risk > alpha` from an empirical risk over n trials."""
    risk, n, alpha = d(risk), d(n), d(alpha)
    hoeffding = F.exp(-n * bernoulli_kl(risk, alpha))
    bentkus = math.e * binom_cdf(F.ceil(n * risk), n, alpha)
    return F.when((n <= 0) | (risk >= alpha), 1.0).otherwise(F.least(F.lit(1.0), hoeffding, bentkus))


def min_calibration_size(alpha, delta) -> Column:
    """Fewest error-free trials that certify alpha at delta; 0 for values outside (0, 1)."""
    alpha, delta = d(alpha), d(delta)
    ok = (alpha > 0) & (alpha < 1) & (delta > 0) & (delta < 1)
    return F.when(ok, F.ceil(F.log(delta) / F.log(1 - alpha))).otherwise(0).cast("long")


def clopper_pearson_upper(k, n, delta, halvings: int = 60) -> Column:
    """Upper end p with P(X <= k; n, p) = delta, by bisection; closed form at k = 0, 1 at k = n."""
    k, n, delta = d(k), d(n), d(delta)

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = binom_cdf(k, n, mid, 80) > delta
        return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), step, lambda s: (s["lo"] + s["hi"]) / 2)
    return F.when(k >= n, 1.0).when(k <= 0, 1 - F.pow(delta, 1 / n)).otherwise(found)


def mcnemar_exact(b, c) -> Column:
    """Two-sided exact test on discordant pairs; 1 without any."""
    b, c = d(b), d(c)
    return F.when(b + c == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binom_cdf(F.least(b, c), b + c, 0.5)))


def hypergeometric(a, b, c, dd) -> Column:
    """Probability of a 2 x 2 table with its margins fixed."""
    a, b, c, dd = d(a), d(b), d(c), d(dd)
    return F.exp(log_choose(a + b, a) + log_choose(c + dd, c) - log_choose(a + b + c + dd, a + c))


def fisher(a, b, c, dd) -> Column:
    """one_sided and two_sided: P(first cell >= a), and the sum over the tables that are no likelier than the one seen.

    Tables are weighed against the likeliest one, each by its ratio to its neighbour, so nothing is lost to logarithms of
    large factorials. By Hoeffding's bound a table farther than sqrt(375 k) from the mean, k the least margin, has less than
    exp(-750), which is 0 as a double; so steps grow with the root of the counts, not with them.
    """
    given = F.struct(d(a).alias("a"), d(b).alias("b"), d(c).alias("c"), d(dd).alias("e"))

    def margins(v: Column) -> Column:
        r, s = v["a"] + v["b"], v["a"] + v["c"]
        n = r + v["c"] + v["e"]
        least = F.least(r, s, v["c"] + v["e"], v["b"] + v["e"])
        low, high = F.greatest(F.lit(0.0), v["a"] - v["e"]), F.least(r, s)
        mean = r * s / F.greatest(n, F.lit(1.0))
        reach = F.sqrt(375 * least) + 2
        whole = lambda x: x.cast("long")
        mode = F.least(high, F.greatest(low, F.floor((r + 1) * (s + 1) / (n + 2)).cast("double")))
        return F.struct(
            r.alias("r"), s.alias("s"), (v["e"] - v["a"]).alias("off"), whole(v["a"]).alias("seen"), whole(mode).alias("mode"),
            whole(F.greatest(low, F.floor(mean - reach).cast("double"))).alias("low"), whole(F.least(high, F.ceil(mean + reach).cast("double"))).alias("high"),
        )

    up = lambda t, w, x: w * (t["r"] - x) * (t["s"] - x) / ((x + 1.0) * (t["off"] + x + 1.0))  # noqa: E731  of x + 1, from that of x
    down = lambda t, w, x: w * x * (t["off"] + x) / ((t["r"] - x + 1.0) * (t["s"] - x + 1.0))  # noqa: E731  of x - 1
    none = F.array().cast("array<long>")
    over = lambda t, to: F.when(to > t["mode"], F.sequence(t["mode"], to - 1)).otherwise(none)
    under = lambda t, to: F.when(to < t["mode"], F.sequence(t["mode"], to + 1, F.lit(-1).cast("long"))).otherwise(none)

    def weight(t: Column) -> Column:
        inside = (t["seen"] >= t["low"]) & (t["seen"] <= t["high"])
        above = F.aggregate(over(t, t["seen"]), F.lit(1.0), lambda w, x: up(t, w, x))
        return F.when(~inside, 0.0).when(t["seen"] >= t["mode"], above).otherwise(F.aggregate(under(t, t["seen"]), F.lit(1.0), lambda w, x: down(t, w, x)))

    def sums(t: Column, seen: Column) -> Column:
        def add(s: Column, w: Column, x: Column) -> Column:
            return F.struct(w.alias("w"), (s["all"] + w).alias("all"), (s["tail"] + F.when(x >= t["seen"], w).otherwise(0.0)).alias("tail"), (s["two"] + F.when(w <= seen * (1 + 1e-7), w).otherwise(0.0)).alias("two"))

        zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("all"), F.lit(0.0).alias("tail"), F.lit(0.0).alias("two"))
        back = lambda s: F.struct(F.lit(1.0).alias("w"), s["all"].alias("all"), s["tail"].alias("tail"), s["two"].alias("two"))
        above = F.aggregate(over(t, t["high"]), add(zero, F.lit(1.0), t["mode"]), lambda s, x: let(up(t, s["w"], x), lambda w: add(s, w, x + 1)))
        return F.aggregate(under(t, t["low"]), back(above), lambda s, x: let(down(t, s["w"], x), lambda w: add(s, w, x - 1)))

    share = lambda s: F.struct(F.least(F.lit(1.0), s["tail"] / s["all"]).alias("one_sided"), F.least(F.lit(1.0), s["two"] / s["all"]).alias("two_sided"))
    found = let(given, lambda v: let(margins(v), lambda t: let(weight(t), lambda w: let(sums(t, w), share))))
    return F.when(d(a).isNotNull() & d(b).isNotNull() & d(c).isNotNull() & d(dd).isNotNull(), found)


def fisher_one_sided(a: Column, b: Column, c: Column, dd: Column) -> Column:
    """P(first cell >= a)."""
    return fisher(a, b, c, dd)["one_sided"]


def fisher_two_sided(a: Column, b: Column, c: Column, dd: Column) -> Column:
    """Sum over the tables that are no likelier than the one seen."""
    return fisher(a, b, c, dd)["two_sided"]


def normal_two_sided(z) -> Column:
    """P(|Z| >= |z|) of a standard normal: the series of the error function up to 3, a continued fraction beyond."""
    x = F.abs(d(z)) / F.sqrt(F.lit(2.0))
    steps = F.sequence(F.lit(1), F.lit(80))

    def tail(x: Column) -> Column:
        term = F.struct(x.alias("t"), x.alias("s"))
        add = lambda a, k: F.struct((a["t"] * -x * x / k).alias("t"), (a["s"] - a["t"] * x * x / k / (2 * k + 1)).alias("s"))
        near = 1 - F.aggregate(steps, term, add)["s"] * (2 / math.sqrt(math.pi))
        fraction = F.aggregate(F.reverse(steps), x, lambda a, k: x + k / F.lit(2.0) / a)
        far = F.exp(-x * x) / (fraction * math.sqrt(math.pi))
        return F.when(x < 3, F.greatest(near, F.lit(0.0))).otherwise(far)

    return let(x, tail)
