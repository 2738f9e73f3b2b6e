"""Posterior returns, optimal weights and whole-share orders for many portfolios as one job.

The dense solves run as grouped kernels: Spark shuffles by portfolio, each task solves the portfolios
it holds. A portfolio's input is its covariance matrix, so a group is as large as the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiltlab.params import WEIGHT_DUST

MAX_STEPS = 20_000
TOLERANCE = 1e-12


def blend(sigma: np.ndarray, pi: np.ndarray, tau: float, picks: np.ndarray, q: np.ndarray, omega: np.ndarray):
    """Posterior mean and predictive covariance; the prior itself without views."""
    if not (np.isfinite(sigma).all() and np.isfinite(pi).all()):
        raise ValueError("a prior that is not finite")
    prior = tau * sigma
    if len(q) == 0:
        return pi.copy(), sigma + prior
    cross = prior @ picks.T
    spread = picks @ cross + np.diag(omega)
    np.linalg.cholesky(spread)  # raises unless positive definite
    gain = np.linalg.solve(spread, cross.T).T
    return pi + gain @ (q - picks @ pi), sigma + prior - gain @ cross.T


class _Free:
    """The curvature with the free names swept: its block over them is their inverse, negated. A name enters or leaves by one pivot."""

    def __init__(self, hess: np.ndarray):
        self.hess = hess
        self.mask = np.ones(len(hess), bool)
        self.rebuild()

    def rebuild(self) -> None:
        free, pinned = np.flatnonzero(self.mask), np.flatnonzero(~self.mask)
        self.swept = np.full_like(self.hess, np.nan)
        try:
            inverse = np.linalg.inv(self.hess[np.ix_(free, free)])
        except np.linalg.LinAlgError:
            return  # left undefined: ``step`` solves with the constraint instead
        across = inverse @ self.hess[np.ix_(free, pinned)]
        self.swept[np.ix_(free, free)] = -inverse
        self.swept[np.ix_(free, pinned)] = across
        self.swept[np.ix_(pinned, free)] = across.T
        self.swept[np.ix_(pinned, pinned)] = self.hess[np.ix_(pinned, pinned)] - self.hess[np.ix_(pinned, free)] @ across

    def flip(self, name: int) -> None:
        """Let a name enter or leave."""
        column, pivot = self.swept[:, name].copy(), self.swept[name, name]
        self.swept -= np.outer(column, column / pivot)
        self.swept[:, name] = self.swept[name] = (-column if self.mask[name] else column) / pivot
        self.swept[name, name] = -1.0 / pivot
        self.mask[name] = not self.mask[name]

    def step(self, grad: np.ndarray) -> tuple[np.ndarray, float]:
        """The move to the best point with the same sum, zero for names that are not free, and the price of the sum."""
        mask = self.mask
        for attempt in range(2):
            bare, ones = (np.where(mask, self.swept @ np.where(mask, v, 0.0), 0.0) for v in (grad, 1.0))
            price = -bare.sum() / ones.sum()
            move = bare + price * ones
            miss = np.where(mask, self.hess @ move + price + grad, 0.0)
            if np.abs(miss).max() <= 1e-10 * max(1.0, np.abs(grad).max()):
                return move, price
            if attempt == 0:
                self.rebuild()  # rounding piled up
        free = np.flatnonzero(mask)  # nearly singular: solve with the constraint
        kkt = np.ones((len(free) + 1, len(free) + 1))
        kkt[:-1, :-1], kkt[-1, -1] = self.hess[np.ix_(free, free)], 0.0
        solved = np.linalg.solve(kkt, np.append(-grad[free], 0.0))
        move = np.zeros(len(grad))
        move[free] = solved[:-1]
        return move, solved[-1]


def best_weights(mu: np.ndarray, sigma: np.ndarray, risk_aversion: float, cap: float):
    """Maximise mu'w - risk_aversion/2 w'Sw with sum 1 and 0 <= w <= cap, by an active-set method.

    Each step goes to the best point of the free names, or to the first bound on the way, or releases the bound with the most
    negative multiplier. One bound changes a step, and the inverse over the free names follows it by one pivot, so a step costs
    names squared. Returns weights, steps and whether it stopped at the optimum.
    """
    n = len(mu)
    if n == 0 or risk_aversion <= 0 or cap * n < 1.0 - TOLERANCE:
        raise ValueError("infeasible portfolio")
    hess = risk_aversion * sigma
    cap = max(cap, 1.0 / n)
    w = np.full(n, 1.0 / n)
    pinned = np.zeros(n, dtype=int)  # -1 at zero, +1 at cap
    free = _Free(hess)
    grad = hess @ w - mu

    def release(name: int) -> None:
        pinned[name] = 0
        free.flip(name)

    for step in range(1, MAX_STEPS + 1):
        move, price = np.zeros(n), 0.0
        if free.mask.any():
            move, price = free.step(grad)
        if np.abs(move).max(initial=0.0) > TOLERANCE:
            room = np.full(n, np.inf)
            down, up = move < 0, move > 0
            room[down] = w[down] / -move[down]
            room[up] = (cap - w[up]) / move[up]
            hit = int(np.argmin(room))
            if room[hit] < 1.0:
                w = w + max(room[hit], 0.0) * move
                pinned[hit] = -1 if move[hit] < 0 else 1
                w[hit] = 0.0 if move[hit] < 0 else cap
                free.flip(hit)
            else:
                w = w + move
            grad = hess @ w - mu
            continue
        # At the best point of the free set: is any bound holding the wrong way?
        at_zero, at_cap = pinned == -1, pinned == 1
        if not free.mask.any():
            # Everything pinned: any price between the two groups' gradients supports the point.
            floor = (-grad[at_zero]).max(initial=-np.inf)
            ceiling = (-grad[at_cap]).min(initial=np.inf)
            if floor <= ceiling + TOLERANCE:
                return np.clip(w, 0.0, cap), step, True
            first, second = np.flatnonzero(at_zero)[np.argmax(-grad[at_zero])], np.flatnonzero(at_cap)[np.argmin(-grad[at_cap])]
            release(int(first))
            release(int(second))
            continue
        slack = np.where(at_zero, grad + price, np.where(at_cap, -(grad + price), np.inf))
        worst = int(np.argmin(slack))
        if slack[worst] >= -TOLERANCE:
            return np.clip(w, 0.0, cap), step, True
        release(worst)
    return np.clip(w, 0.0, cap), MAX_STEPS, False


def _setting(value: float | str) -> Column:
    """A number for all portfolios, or the name of a column that holds each one's."""
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["sigma"].tolist(), dtype=float)


def posterior(assets: DataFrame, views: DataFrame, group: str, tau: float | str) -> DataFrame:
    """``(group, ticker, mu, sigma)`` per asset: posterior mean and its row of the predictive covariance.

    ``assets`` is ``(group, ticker, pi, sigma)`` with sigma rows in ticker order; ``views`` is
    ``(group, view_id, ticker, pick, q, omega)`` and may hold relative views. ``tau`` is a number or a column of
    ``assets``. A group whose solve fails yields no rows, and the others are not touched.
    """
    schema = f"{group} {assets.schema[group].dataType.simpleString()}, ticker string, mu double, sigma array<double>"
    said = (
        views.select(group, "ticker", F.struct(F.col("view_id").cast("string").alias("id"), "pick", "q", "omega").alias("v"))
        .groupBy(group, "ticker")
        .agg(F.array_sort(F.collect_list("v")).alias("v"))
        .select(group, "ticker", "v.id", "v.pick", "v.q", "v.omega")
    )

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker")
        entries = [
            (view, asset, pick, q, omega)
            for asset, (ids, picks, qs, omegas) in enumerate(zip(rows["id"], rows["pick"], rows["q"], rows["omega"]))
            if ids is not None
            for view, pick, q, omega in zip(ids, picks, qs, omegas)
        ]
        order = {view: k for k, view in enumerate(sorted({e[0] for e in entries}))}
        picks, q, omega = np.zeros((len(order), len(rows))), np.zeros(len(order)), np.zeros(len(order))
        for view, asset, pick, value, variance in entries:
            k = order[view]
            picks[k, asset], q[k], omega[k] = pick, value, variance
        out = rows[[group, "ticker"]]
        try:
            mu, sigma = blend(_matrix(rows), rows["pi"].to_numpy(), rows["_tau"].iloc[0], picks, q, omega)
        except ValueError:  # also numpy's LinAlgError
            return pd.DataFrame(columns=[group, "ticker", "mu", "sigma"], dtype=object)
        return out.assign(mu=mu, sigma=list(sigma))

    viewed = assets.select(group, "ticker", "pi", "sigma", _setting(tau).alias("_tau")).join(said, [group, "ticker"], "left")
    return viewed.groupBy(group).applyInPandas(solve, schema)


def optimal_weights(assets: DataFrame, group: str, risk_aversion: float | str, max_weight: float | str) -> DataFrame:
    """``(group, ticker, weight, iterations, converged)``; the cap is raised to 1/n where it is infeasible.

    ``assets`` is ``(group, ticker, mu, sigma)`` with sigma rows in ticker order; the settings are numbers or columns of it. A group
    whose solve fails yields no rows.
    """
    schema = (
        f"{group} {assets.schema[group].dataType.simpleString()}, ticker string, weight double, "
        "iterations int, converged boolean"
    )

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker")
        cap = max(rows["_cap"].iloc[0], 1.0 / len(rows))
        out = rows[[group, "ticker"]]
        try:
            w, steps, done = best_weights(rows["mu"].to_numpy(), _matrix(rows), rows["_aversion"].iloc[0], cap)
        except ValueError:  # also numpy's LinAlgError
            return pd.DataFrame(columns=[group, "ticker", "weight", "iterations", "converged"], dtype=object)
        return out.assign(weight=w, iterations=steps, converged=done)

    known = assets.select(group, "ticker", "mu", "sigma", _setting(risk_aversion).alias("_aversion"), _setting(max_weight).alias("_cap"))
    return known.groupBy(group).applyInPandas(solve, schema)


def view_weights(assets: DataFrame, keys: tuple[str, ...], tau: float, risk_aversion: float, max_weight: float) -> DataFrame:
    """Posterior and optimum in one grouped pass: ``(keys, ticker, mu, weight, iterations, converged)``.

    ``assets`` has ``pi``, the ``sigma`` row in ticker order, and at most one absolute view per asset in
    nullable ``q`` and ``omega``. A portfolio whose solve fails yields no rows.
    """
    types = ", ".join(f"{k} {assets.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, ticker string, mu double, weight double, iterations int, converged boolean"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ticker")
        viewed = np.flatnonzero(rows["q"].notna())
        picks = np.eye(len(rows))[viewed]
        said = rows.iloc[viewed]
        out = rows[[*keys, "ticker"]]
        try:
            mu, sigma = blend(
                _matrix(rows), rows["pi"].to_numpy(), tau, picks, said["q"].to_numpy(), said["omega"].to_numpy()
            )
            cap = max(max_weight, 1.0 / len(rows))
            w, steps, done = best_weights(mu, sigma, risk_aversion, cap)
        except ValueError:  # also numpy's LinAlgError
            return out.iloc[:0].assign(mu=0.0, weight=0.0, iterations=0, converged=False)
        return out.assign(mu=mu, weight=w, iterations=steps, converged=done)

    return assets.select(*keys, "ticker", "pi", "sigma", "q", "omega").groupBy(*keys).applyInPandas(solve, schema)


def clean_weights(weights: DataFrame, keys: tuple[str, ...], weight: str = "weight") -> DataFrame:
    """Drop dust and renormalise."""
    kept = F.when(F.col(weight) < WEIGHT_DUST, 0.0).otherwise(F.col(weight))
    out = weights.withColumn(weight, kept)
    return out.withColumn(weight, F.col(weight) / F.sum(weight).over(Window.partitionBy(*keys)))


def feasible_cap(max_weight: Column, names: Column) -> Column:
    return F.greatest(max_weight, F.lit(1.0) / names)


def project_capped_simplex(points: DataFrame, keys: tuple[str, ...], value: str, cap: Column) -> DataFrame:
    """Add ``weight``: the nearest point with sum 1 and 0 <= weight <= cap, NULL where none exists.

    The weight is clamp(v - theta, 0, cap). As theta passes v - cap an asset starts to shrink and at v
    it is gone, so the sum is piecewise linear between these breakpoints; running totals over the sorted
    breakpoints give the segment that holds 1, and theta in closed form.
    """
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ready = points.withColumn("_cap", cap).withColumn("_n", size)
    bends = ready.select(
        *keys,
        "_cap",
        "_n",
        F.inline(
            F.array(
                F.struct((F.col(value) - F.col("_cap")).alias("b"), F.lit(1).alias("d")),
                F.struct(F.col(value).alias("b"), F.lit(-1).alias("d")),
            )
        ),
    )
    upto = Window.partitionBy(*keys).orderBy("b")
    running = (
        bends.withColumn("_a", F.sum(F.col("d") * F.col("b")).over(upto))
        .withColumn("_k", F.sum("d").over(upto))
        .withColumn("_sum", F.col("_n") * F.col("_cap") + F.col("_a") - F.col("_k") * F.col("b"))
    )
    theta = F.when(
        F.col("_k") > 0,
        F.try_divide(F.col("_n") * F.col("_cap") + F.col("_a") - 1.0, F.col("_k").cast("double")),
    ).otherwise(F.col("b"))
    found = (
        running.where("_sum >= 1 - 1e-12")
        .groupBy(*keys)
        .agg(F.max_by(theta, F.struct("b", "_k")).alias("_theta"))
    )
    clamped = F.least(F.greatest(F.col(value) - F.col("_theta"), F.lit(0.0)), F.col("_cap"))
    weight = F.when(F.col("_theta").isNotNull(), clamped)
    return ready.join(found, list(keys), "left").withColumn("weight", weight).drop("_theta", "_cap", "_n")


def whole_shares(assets: DataFrame, keys: tuple[str, ...], budget: Column) -> DataFrame:
    """``(keys, ticker, price, weight, shares, cash_left)``: share counts within the budget.

    Floors first. Cash only falls and no asset can gain more than one extra share, so spending the
    rest is one pass over the portfolio in order of shortfall (ties: later ticker first). Rows stream
    through a task in that order and the pass remembers the cash left, nothing else.
    """
    target = F.col("weight") * budget
    whole = Window.partitionBy(*keys)
    floored = (
        assets.withColumn("_target", target)
        .withColumn("_shares", F.greatest(F.floor(target / F.col("price")), F.lit(0)).cast("bigint"))
        .withColumn("_short", F.col("_target") - F.col("_shares") * F.col("price"))
        .withColumn("_budget", budget)
        .withColumn("_cash", F.col("_budget") - F.sum(F.col("_shares") * F.col("price")).over(whole))
        .select(*keys, "ticker", "price", "weight", F.col("_shares").alias("shares"), "_short", "_budget", "_cash")
    )
    ordered = floored.repartition(*keys).sortWithinPartitions(*keys, F.desc("_short"), F.desc("ticker"))

    def spend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cash = object(), 0.0
        for batch in batches:
            shares = []
            names = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            numbers = (batch.column(c).to_pylist() for c in ("shares", "price", "_short", "_cash"))
            for name, count, price, short, start in zip(names, *numbers, strict=True):
                if name != now:
                    now, cash = name, start
                buys = short is not None and short > price / 2.0 and price <= cash
                cash -= price if buys else 0.0
                shares.append(count + buys)
            yield batch.set_column(batch.schema.get_field_index("shares"), "shares", pa.array(shares, pa.int64()))

    spent = ordered.mapInArrow(spend, ordered.schema)
    left = F.col("_budget") - F.sum(F.col("shares") * F.col("price")).over(whole)
    return spent.select(*keys, "ticker", "price", "weight", "shares", left.alias("cash_left"))
