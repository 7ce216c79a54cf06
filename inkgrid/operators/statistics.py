"""Stratified cluster statistics: pooled ratios with linearised errors, bootstrap intervals, adjustments.

Point estimates and standard errors are window aggregates. Intervals are resampled in one Arrow task
a cell: a cell holds a row a cluster (tens), never the resamples as rows. Draws come from a
generator seeded by the declared seed and the cell's name, over rows sorted by cluster, so results do
not depend on partitioning.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

# Fixed values of the declared analysis.
SEED = 20260924
RESAMPLES = 9999
BAND = (0.93, 0.97)

_NORMAL = NormalDist()


# ---------------------------------------------------------------- estimates in SQL


def _with_totals(df: DataFrame, cell: list[str], totals: dict[str, Column]) -> DataFrame:
    """Adds aggregates of the whole cell, by a join with a row a cell: no task holds a cell, as that of a window would."""
    keys = [f"_c{i}" for i in range(len(cell))]
    whole = df.groupBy(*[F.col(c).alias(k) for c, k in zip(cell, keys, strict=True)]).agg(*[a.alias(n) for n, a in totals.items()])
    same = [df[c].eqNullSafe(F.col(k)) for c, k in zip(cell, keys, strict=True)]
    return df.join(whole, same).drop(*keys)


def ratio_with_error(df: DataFrame, cell: list[str], stratum: str, num: str, den: str) -> DataFrame:
    """cell, ratio, se: sum over sum, with the stratified with-replacement error of its linear form."""
    rows = _with_totals(df, cell, {"_t": F.sum(den), "_r": F.sum(num) / F.sum(den)})
    rows = rows.withColumn("_u", (F.col(num) - F.col("_r") * F.col(den)) / F.col("_t"))
    parts = rows.groupBy(*cell, stratum).agg(F.first("_r").alias("_r"), F.count("*").alias("_n"), F.var_pop("_u").alias("_v"))
    share = F.when(F.col("_n") >= 2, F.col("_n") * F.col("_n") / (F.col("_n") - 1) * F.col("_v")).otherwise(0.0)
    return parts.groupBy(*cell).agg(F.first("_r").alias("ratio"), F.sqrt(F.sum(share)).alias("se"))


def difference_with_error(df: DataFrame, cell: list[str], stratum: str, a: tuple[str, str], b: tuple[str, str], log: bool = False) -> DataFrame:
    """cell, estimate, se of the paired difference of two ratios, or of the logarithm of their quotient (null at rate 0)."""
    whole = Window.partitionBy(*cell)
    rows = df
    for s, (num, den) in (("a", a), ("b", b)):
        rows = rows.withColumn(f"_l{s}", F.sum(den).over(whole)).withColumn(f"_r{s}", F.sum(num).over(whole) / F.sum(den).over(whole))
        scale = F.col(f"_l{s}") * (F.col(f"_r{s}") if log else F.lit(1.0))
        rows = rows.withColumn(f"_u{s}", F.try_divide(F.col(num) - F.col(f"_r{s}") * F.col(den), scale))
    estimate = F.ln(F.col("_ra")) - F.ln(F.col("_rb")) if log else F.col("_ra") - F.col("_rb")
    rows = rows.withColumn("_e", estimate).withColumn("_u", F.col("_ua") - F.col("_ub"))
    parts = rows.groupBy(*cell, stratum).agg(F.first("_e").alias("_e"), F.count("*").alias("_n"), F.var_pop("_u").alias("_v"))
    share = F.when(F.col("_n") >= 2, F.col("_n") * F.col("_n") / (F.col("_n") - 1) * F.col("_v")).otherwise(0.0)
    return parts.groupBy(*cell).agg(F.first("_e").alias("estimate"), F.sqrt(F.sum(share)).alias("se"))


def leave_one_out(df: DataFrame, cell: list[str], num: str, den: str) -> DataFrame:
    """Adds ``without``: the pooled ratio without the row."""
    whole = Window.partitionBy(*cell)
    return df.withColumn("without", F.try_divide(F.sum(num).over(whole) - F.col(num), F.sum(den).over(whole) - F.col(den)))


def jackknife(df: DataFrame, cell: list[str], order: list[str], states: dict[str, tuple[Column, str]], finish: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """Adds ``without``: the statistic of all other rows of the cell, for any statistic whose state can be merged.

    ``states`` are the parts of a row's state and how two are merged (sum, max or min), ``finish`` makes the statistic of merged parts. The
    others are the rows before and the rows behind: two running merges, spread over ranges, so no part need be taken out again
    (there is no way back from a maximum) and a cell may hold any number of rows. ``order`` must tell the rows of a cell apart."""
    before = scans.running_states(df, cell, [F.col(c) for c in order], {f"_p_{n}": s for n, s in states.items()})
    both = scans.running_states(before, cell, [F.col(c).desc() for c in order], {f"_s_{n}": s for n, s in states.items()})
    merged = {n: scans.merge_two(F.col(f"_p_{n}"), F.col(f"_s_{n}"), kind) for n, (_, kind) in states.items()}
    return both.select(*df.columns, finish(merged).alias("without"))


def mergeable(name: str, x: Column, y: Column) -> tuple[dict[str, tuple[Column, str]], Callable[[dict[str, Column]], Column]]:
    """(states, finish) of ``sum``, ``max``, ``ratio`` (of x to y) or ``correlation``."""
    if name == "sum":
        return {"x": (x, "sum")}, lambda s: s["x"]
    if name == "max":
        return {"x": (x, "max")}, lambda s: s["x"]
    if name == "ratio":
        return {"x": (x, "sum"), "y": (y, "sum")}, lambda s: F.try_divide(s["x"], s["y"])
    if name == "correlation":
        parts = {"n": F.lit(1).cast("long"), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}

        def finish(s: dict[str, Column]) -> Column:
            spread = (s["n"] * s["xx"] - s["x"] * s["x"]).cast("double") * (s["n"] * s["yy"] - s["y"] * s["y"]).cast("double")
            return F.when(spread > 0, (s["n"] * s["xy"] - s["x"] * s["y"]).cast("double") / F.sqrt(spread))

        return {n: (v, "sum") for n, v in parts.items()}, finish
    raise ValueError(f"no statistic {name!r}")


def sample_size(half_width: Column, point: Column, pilot: int, full: int) -> Column:
    """struct<projected, threshold, increase>: half-width scaled to the full design against the larger of 0.2 points
    and a quarter of the estimate."""
    projected, threshold = half_width * math.sqrt(pilot / full), F.greatest(F.lit(0.002), 0.25 * point)
    return F.struct(projected.alias("projected"), threshold.alias("threshold"), (projected > threshold).alias("increase"))


def choose_method(coverage: DataFrame, band: tuple[float, float] = BAND, nominal: float = 0.95) -> DataFrame:
    """A row a method (scenario, target, method, coverage): worst gap, whether it covers both targets in every
    scenario within the band, and whether it is the passing one of least gap."""
    scenarios = coverage.select("scenario").distinct().agg(F.count("*").alias("_s"))
    rows = coverage.groupBy("method").agg(F.min("coverage").alias("least"), F.max("coverage").alias("most"), F.max(F.abs(F.col("coverage") - nominal)).alias("worst_gap"), F.count_if(F.col("target") == "diff").alias("_d"))
    rows = rows.crossJoin(F.broadcast(scenarios))  # one row: the number of scenarios
    rows = rows.withColumn("passes", (F.col("_d") == F.col("_s")) & (F.col("least") >= band[0]) & (F.col("most") <= band[1])).drop("_d", "_s")
    best = Window.orderBy(F.col("passes").desc(), "worst_gap", "method")
    return rows.withColumn("chosen", F.col("passes") & (F.row_number().over(best) == 1))


# ---------------------------------------------------------------- distributions


def student_cdf(t: float, df: float) -> float:
    """By the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    tail = 0.5 * _beta_inc(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    c, d, out = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300), 0.0
    out = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out / a


def student_quantile(p: float, df: float) -> float:
    """Bisection of the distribution function."""
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


# ---------------------------------------------------------------- intervals


@dataclass(frozen=True)
class Target:
    """A statistic of the column totals of a cell, and its gradient: a first-order change of the totals moves it by so much.
    ``outward`` maps it to the scale that is reported, ``floor`` bounds that from below."""

    value: Callable[[np.ndarray], np.ndarray]
    gradient: Callable[[np.ndarray], np.ndarray]
    outward: Callable[[float], float] = float
    floor: float = -math.inf


def _quotient(t: np.ndarray) -> np.ndarray:
    return t[..., 0] / t[..., 1]


def _quotient_gradient(t: np.ndarray) -> np.ndarray:
    return np.stack((1 / t[..., 1], -t[..., 0] / t[..., 1] ** 2), axis=-1)


def _signs(t: np.ndarray) -> np.ndarray:
    return np.array([1.0, -1.0, -1.0, 1.0]) / t


RATIO = Target(_quotient, _quotient_gradient, floor=0.0)
DIFFERENCE = Target(lambda t: _quotient(t[..., :2]) - _quotient(t[..., 2:]), lambda t: np.concatenate((_quotient_gradient(t[..., :2]), -_quotient_gradient(t[..., 2:])), axis=-1))
#: The logarithm of the quotient of two ratios is a signed sum of logarithms of the four totals.
LOG_QUOTIENT = Target(lambda t: (np.log(t) * np.array([1.0, -1.0, -1.0, 1.0])).sum(axis=-1), _signs, outward=lambda x: float(np.exp(min(x, 700.0))))


#: Counts of draws that are held at once.
DRAWN = 1 << 19


class Moments:
    """A cell of clusters (rows) by columns, and ``b`` resamples of it, told as how often each row of a stratum is drawn:
    totals and errors of all resamples are products of these counts with first and second moments."""

    def __init__(self, columns: list, strata: list, target: Target, b: int, seed: int):
        self.x, self.target, names = np.column_stack([np.asarray(c, float) for c in columns]), target, np.asarray(strata)
        self.b, self.seed = b, seed
        self.groups = [np.flatnonzero(names == s) for s in sorted(set(names.tolist()))]
        self.totals = self.x.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.point = float(target.value(self.totals))
            drawn, moments = self.drawn(lambda size, n: np.ones((size, n)), 1)
            self.error = float(self.errors(self.totals[None, :], moments)[0])
            drawn, moments = self.drawn(self._draws(), b)
            self.values, self.spreads = target.value(drawn), self.errors(drawn, moments)
            self.without = target.value(self.totals - self.x)

    def _draws(self) -> Callable[[int, int], np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return lambda size, n: rng.multinomial(n, np.full(n, 1 / n), size=size).astype(float)

    @property
    def counts(self) -> list[np.ndarray]:
        """How often each row of a stratum is drawn, all resamples at once and drawn anew: to look at, for small cells."""
        draw = self._draws()
        return [draw(self.b, len(g)) for g in self.groups]

    def drawn(self, draw: Callable[[int, int], np.ndarray], b: int) -> tuple[np.ndarray, list]:
        """Totals of ``b`` resamples, and for each stratum its rows and the first and second moments of each resample. Counts are drawn and
        multiplied some resamples at a time, in one order, so no more than ``DRAWN`` of them are held, however many rows a stratum has."""
        k = self.x.shape[1]
        totals, moments = np.zeros((b, k)), []
        for g in self.groups:
            n, x = len(g), self.x[g]
            centre = x.mean(axis=0)
            centred = x - centre
            square = (centred[:, :, None] * centred[:, None, :]).reshape(n, k * k)
            first, second, step = np.empty((b, k)), np.empty((b, k * k)), max(1, DRAWN // n)
            for lo in range(0, b, step):
                w = draw(min(step, b - lo), n)
                totals[lo : lo + step] += w @ x
                first[lo : lo + step], second[lo : lo + step] = w @ centred / n, w @ square / n
            moments.append((n, first, second.reshape(b, k, k)))
        return totals, moments

    def errors(self, totals: np.ndarray, moments: list) -> np.ndarray:
        """Standard error of each resample: n^2 / (n - 1) times the variance of gradient . row, summed over strata."""
        slope, square = self.target.gradient(totals), np.zeros(len(totals))
        for n, mean, second in moments:
            if n > 1:
                variance = np.einsum("bi,bij,bj->b", slope, second, slope) - (slope * mean).sum(axis=1) ** 2
                square += n * n / (n - 1) * np.maximum(variance, 0)
        return np.sqrt(square)

    @property
    def freedom(self) -> int:
        return len(self.x) - len(self.groups)

    def studentised(self) -> np.ndarray:
        """(value - point) / error of the resamples that have one; what rounding leaves of an error of 0 is none."""
        usable = np.isfinite(self.values) & np.isfinite(self.spreads) & (self.spreads > 1e-6 * self.error)
        return (self.values[usable] - self.point) / self.spreads[usable]


def _tail(draws: np.ndarray, at: float) -> float:
    """Two-sided: twice the smaller share of draws on one side of ``at``, which belongs to both."""
    return min(1.0, 2 * float(min((draws >= at).mean(), (draws <= at).mean())))


#: Fixed value: the share of resamples below the estimate is kept this far from 0 and 1.
LEAST_SHARE = 1e-6


def _from_quantiles(m: Moments, levels: np.ndarray) -> tuple[float, float, float]:
    lo, hi = np.quantile(m.values, levels)
    return lo, hi, _tail(m.values, 0.0)


def _percentile(m: Moments, alpha: float):
    return _from_quantiles(m, np.array([alpha / 2, 1 - alpha / 2]))


def _bias_corrected(m: Moments, alpha: float):
    """Quantile levels moved by the median bias and by the acceleration (a sixth of the skewness of the jackknife)."""
    share = 0.5 * (float((m.values < m.point).mean()) + float((m.values <= m.point).mean()))
    bias = _NORMAL.inv_cdf(np.clip(share, LEAST_SHARE, 1 - LEAST_SHARE))
    pull = m.without.mean() - m.without
    size = float(np.sqrt((pull**2).sum()))
    acceleration = float(((pull / size) ** 3).sum()) / 6 if size > 0 else 0.0
    moved = [bias + _NORMAL.inv_cdf(q) for q in (alpha / 2, 1 - alpha / 2)]
    return _from_quantiles(m, np.array([_NORMAL.cdf(bias + z / (1 - acceleration * z)) for z in moved]))


def _pivot(m: Moments, alpha: float, symmetric: bool):
    t = m.studentised()
    if m.error == 0 or not len(t):
        return m.point, m.point, float(m.point == 0)
    seen = m.point / m.error
    if symmetric:
        reach = float(np.quantile(np.abs(t), 1 - alpha))
        return m.point - reach * m.error, m.point + reach * m.error, float((np.abs(t) >= abs(seen)).mean())
    low, high = m.point - m.error * np.quantile(t, [1 - alpha / 2, alpha / 2])
    return low, high, _tail(t, seen)


def _log_t(m: Moments, alpha: float):
    """Student's t on the log scale; a rate of 0 has no logarithm and stays. Without a degree of freedom any rate is possible."""
    if m.point <= 0:
        return 0.0, 0.0, None
    if m.freedom < 1:
        return 0.0, math.inf, None
    factor = math.exp(student_quantile(1 - alpha / 2, m.freedom) * m.error / m.point)
    return m.point / factor, m.point * factor, None


_TAILS: dict[str, Callable] = {
    "percentile": _percentile, "bca": _bias_corrected, "log_t": _log_t, "boot_t": partial(_pivot, symmetric=False), "boot_t_sym": partial(_pivot, symmetric=True),
}
#: Methods by number of columns: (num, den), or those of two sides.
METHODS = {2: {m: (RATIO, m) for m in ("percentile", "bca", "boot_t", "log_t")}, 4: {**{m: (DIFFERENCE, m) for m in ("percentile", "bca", "boot_t", "boot_t_sym")}, "log_boot_t": (LOG_QUOTIENT, "boot_t"), "log_boot_t_sym": (LOG_QUOTIENT, "boot_t_sym")}}
_INTERVAL = "estimate double, lo double, hi double, half_width double, p double, resamples_used long, undefined boolean"


def interval(columns: list, strata: list, method: str = "boot_t", b: int = RESAMPLES, seed: int = SEED, alpha: float = 0.05) -> dict:
    """Two columns (num, den): their ratio, not below 0. Four: the difference of two ratios, or for ``log_boot_t`` and
    ``log_boot_t_sym`` their quotient, which is undefined where a total is 0 or nothing varies. p is two-sided, against
    no difference. ``resamples_used`` counts the resamples with a finite value and an error of their own."""
    if method not in METHODS[len(columns)]:
        raise ValueError(f"unknown method {method!r}")
    target, tails = METHODS[len(columns)][method]
    m = Moments(columns, strata, target, b, seed)
    if target is LOG_QUOTIENT and not (math.isfinite(m.point) and math.isfinite(m.error) and m.error > 0):
        known = math.exp(m.point) if math.isfinite(m.point) else None
        return dict.fromkeys(("lo", "hi", "half_width", "p", "resamples_used")) | {"estimate": known, "undefined": True}
    lo, hi, p = _TAILS[tails](m, alpha)
    lo, hi = max(target.floor, target.outward(float(lo))), target.outward(float(hi))
    return {"estimate": target.outward(m.point), "lo": lo, "hi": hi, "half_width": (hi - lo) / 2, "p": None if target is RATIO else p, "resamples_used": len(m.studentised()), "undefined": False}


def cell_seed(seed: int, names: tuple) -> int:
    return int.from_bytes(hashlib.sha256(repr((seed, *names)).encode()).digest()[:8], "big") >> 1


def intervals(df: DataFrame, cell: list[str], cluster: str, stratum: str, columns: list[str], method: str, b: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """One ``interval`` a cell. The clusters of a cell (tens, by design of the study) are one frame."""
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cell)

    def solve(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([stratum, cluster])
        found = interval([rows[c] for c in columns], list(rows[stratum]), method, b, cell_seed(seed, names))
        return pd.DataFrame([dict(zip(cell, names, strict=True)) | found])

    return df.select(*dict.fromkeys([*cell, cluster, stratum, *columns])).groupBy(*cell).applyInPandas(solve, f"{keys}, {_INTERVAL}")


def populations(spark, scenarios: dict[str, dict], clusters: int, strata: int, sims: int, seed: int = SEED) -> DataFrame:
    """Synthetic clusters (scenario, sim, cluster, stratum, len, ed_a, ed_b), generated where they are used.
    A scenario gives ``rate``, ``ratio`` (b over a), ``spread`` of a log-normal length and ``shape`` of a beta rate."""
    names = [(n, float(s["rate"]), float(s.get("ratio", 1.0)), float(s.get("spread", 0.5)), float(s.get("shape", 4.0))) for n, s in scenarios.items()]
    grid = spark.createDataFrame(names, "scenario string, rate double, ratio double, spread double, shape double").crossJoin(spark.range(sims).withColumnRenamed("id", "sim"))
    schema = "scenario string, sim long, cluster int, stratum int, len long, ed_a long, ed_b long"

    def make(frames):
        for rows in frames:
            out = []
            for r in rows.itertuples():
                rng = np.random.Generator(np.random.PCG64(cell_seed(seed, (r.scenario, int(r.sim)))))
                n = clusters * strata
                length = np.maximum(1, rng.lognormal(6, r.spread, n)).astype(np.int64)
                rates = rng.beta(r.shape * r.rate, r.shape * (1 - r.rate), n)
                a, b = rng.binomial(length, rates), rng.binomial(length, np.clip(rates * r.ratio, 0, 1))
                out.append(pd.DataFrame({"scenario": r.scenario, "sim": r.sim, "cluster": np.arange(n), "stratum": np.arange(n) % strata, "len": length, "ed_a": a, "ed_b": b}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["scenario", "sim", "cluster", "stratum", "len", "ed_a", "ed_b"])

    return grid.repartition("scenario", "sim").mapInPandas(make, schema)


def coverage(found: DataFrame, truth: DataFrame) -> DataFrame:
    """scenario, method, target, coverage: share of intervals (lo, hi) that hold the true ``value``."""
    hit = F.col("value").between(F.col("lo"), F.col("hi"))
    return found.join(F.broadcast(truth), ["scenario", "target"]).groupBy("scenario", "method", "target").agg(F.avg(hit.cast("double")).alias("coverage"))
