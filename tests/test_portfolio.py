import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltlab.operators import portfolio, risk, views
from tiltlab.params import TRADING_DAYS

SIGMA = np.array([[0.04, 0.006, 0.01], [0.006, 0.09, 0.012], [0.01, 0.012, 0.0625]])
NAMES = ["A", "B", "C"]


def shrink(x):
    """Textbook identity-target shrinkage with explicit per-day matrices."""
    x = x - x.mean(axis=0)
    t, n = x.shape
    s = x.T @ x / t
    m = np.trace(s) / n
    d2 = ((s - m * np.eye(n)) ** 2).sum() / n
    b2 = min(sum(((np.outer(r, r) - s) ** 2).sum() / n for r in x) / t**2, d2)
    k = b2 / d2 if d2 > 0 else 1.0
    return (k * m * np.eye(n) + (1 - k) * s) * TRADING_DAYS, k


def returns(spark, matrices):
    start = dt.date(2025, 1, 1)
    rows = [
        (g, start + dt.timedelta(days=k), f"n{i}", float(v))
        for g, x in matrices.items() for k, row in enumerate(x) for i, v in enumerate(row)
    ]
    return spark.createDataFrame(rows, "g string, date date, ticker string, ret double")


def test_covariance_matches_numpy_and_rejects_short_windows(spark):
    rng = np.random.default_rng(1)
    common = rng.normal(0, 0.01, (250, 1))
    factor = common + rng.normal(0, 0.01, (250, 5))
    flip = np.array([[0.01, -0.01], [-0.01, 0.01]] * 50)
    flat = np.array([[0.01, 0.01], [-0.01, -0.01]] * 50)
    cov, scalars = risk.covariance(returns(spark, {"f": factor, "x": flip, "y": flat, "short": factor[:10]}), "g")
    got, info = {}, {r.g: r for r in scalars.collect()}
    for r in cov.collect():
        got.setdefault(r.g, {})[(r.i, r.j)] = r.value
    assert set(got) == {"f", "x", "y"}
    for g, x in (("f", factor), ("x", flip), ("y", flat)):
        want, k = shrink(x)
        n = x.shape[1]
        have = np.array([[got[g][(f"n{i}", f"n{j}")] for j in range(n)] for i in range(n)])
        assert np.allclose(have, want, atol=1e-12) and abs(info[g].shrinkage - k) < 1e-9
        assert info[g].observations == len(x) and info[g].names == n
        assert np.linalg.eigvalsh(have).min() > -1e-12
    corr = {(r.i, r.j): r.correlation for r in risk.correlation(cov.where("g = 'f'"), "g").collect()}
    assert abs(corr[("n0", "n0")] - 1) < 1e-12 and 0 < corr[("n0", "n1")] < 1


def matrix(spark, sigma, mu, group="p"):
    rows = [(group, NAMES[i], float(mu[i]), [float(v) for v in sigma[i]]) for i in range(len(mu))]
    return spark.createDataFrame(rows, "g string, ticker string, pi double, sigma array<double>")


VIEWS = "g string, view_id int, ticker string, pick double, q double, omega double"


def test_posterior(spark):
    pi, tau = np.array([0.06, 0.08, 0.07]), 0.05
    said = [("p", 0, "A", 1.0, 0.10, 0.002), ("p", 1, "B", 1.0, 0.03, 0.004), ("p", 1, "C", -1.0, 0.03, 0.004)]
    out = portfolio.posterior(matrix(spark, SIGMA, pi), spark.createDataFrame(said, VIEWS), "g", tau).orderBy("ticker").collect()
    p, q, om = np.array([[1, 0, 0], [0, 1, -1.0]]), np.array([0.10, 0.03]), np.diag([0.002, 0.004])
    prior = np.linalg.inv(tau * SIGMA)
    precision = prior + p.T @ np.linalg.inv(om) @ p
    mu = np.linalg.solve(precision, prior @ pi + p.T @ np.linalg.inv(om) @ q)
    assert np.allclose([r.mu for r in out], mu, atol=1e-10)
    assert np.allclose([r.sigma for r in out], SIGMA + np.linalg.inv(precision), atol=1e-10)
    none = portfolio.posterior(matrix(spark, SIGMA, pi), spark.createDataFrame([], VIEWS), "g", tau).orderBy("ticker").collect()
    assert np.allclose([r.mu for r in none], pi) and np.allclose([r.sigma for r in none], (1 + tau) * SIGMA)
    sure = spark.createDataFrame([("p", 0, "A", 1.0, 0.2, 0.0)], VIEWS)
    assert abs(portfolio.posterior(matrix(spark, SIGMA, pi), sure, "g", tau).where("ticker = 'A'").first().mu - 0.2) < 1e-9


def test_best_weights():
    w_mkt = np.array([0.5, 0.3, 0.2])
    w, steps, done = portfolio.best_weights(2.5 * SIGMA @ w_mkt, SIGMA, 2.5, 1.0)
    assert done and np.allclose(w, w_mkt, atol=1e-9)
    w, _, _ = portfolio.best_weights(np.array([0.15, -0.30, 0.05]), SIGMA, 2.5, 0.6)
    assert abs(w.sum() - 1) < 1e-9 and w.min() > -1e-12 and w[1] < 1e-9 and abs(w[0] - 0.6) < 1e-9
    mu = np.array([0.08, 0.12, 0.07])
    best, _, _ = portfolio.best_weights(mu, SIGMA, 3.0, 0.5)
    value = lambda v: v @ mu - 1.5 * v @ SIGMA @ v
    for a, b in itertools.product(range(11), range(11)):
        v = np.array([a, b, 10 - a - b]) / 10
        if v.min() >= 0 and v.max() <= 0.5:
            assert value(best) >= value(v) - 1e-12
    with pytest.raises(ValueError):
        portfolio.best_weights(np.zeros(3), SIGMA, 2.5, 0.2)


def test_best_weights_satisfy_optimality_on_random_problems():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(2, 15))
        a = rng.normal(size=(n, n + 3))
        sigma = a @ a.T / n * 0.05
        mu = rng.normal(0, 0.3, n)
        cap = max(rng.uniform(0.05, 1.0), 1 / n)
        w, _, done = portfolio.best_weights(mu, sigma, 2.5, cap)
        assert done and abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= cap + 1e-12
        gain = mu - 2.5 * sigma @ w
        # Whatever can still grow must not beat whatever can still shrink.
        grow, cut = gain[w < cap - 1e-9], gain[w > 1e-9]
        if len(grow) and len(cut):
            assert grow.max() <= cut.min() + 1e-7


def test_weights_job(spark):
    assets = matrix(spark, SIGMA, [0.15, -0.3, 0.05]).withColumn("q", F.lit(None).cast("double")).withColumn("omega", F.col("q"))
    out = portfolio.view_weights(assets, ("g",), 0.05, 2.5, 0.2).collect()
    assert all(abs(r.weight - 1 / 3) < 1e-9 and r.converged for r in out)
    dusty = spark.createDataFrame([("p", "A", 1e-7), ("p", "B", 0.6), ("p", "C", 0.4)], "g string, ticker string, weight double")
    got = {r.ticker: r.weight for r in portfolio.clean_weights(dusty, ("g",)).collect()}
    assert got["A"] == 0.0 and abs(got["B"] - 0.6) < 1e-6 and abs(sum(got.values()) - 1) < 1e-12


def project(v, cap):
    lo, hi = min(v) - cap, max(v)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(max(x - mid, 0), cap) for x in v) > 1 else (lo, mid)
    return [min(max(x - (lo + hi) / 2, 0), cap) for x in v]


def test_projection_matches_bisection(spark):
    rng = np.random.default_rng(2)
    cases = {"fixed": ([3.0, -1.0, 0.2, 0.9], 0.4), "ties": ([0.5] * 4, 0.25), "tight": ([0.9, 0.1], 0.5), "none": ([1.0, 2.0], 0.3)}
    cases |= {f"r{k}": (rng.normal(size=n).round(3).tolist(), float(rng.uniform(1 / n, 1))) for k, n in enumerate(rng.integers(2, 12, 60))}
    rows = [(g, i, float(x), cap) for g, (v, cap) in cases.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, i int, v double, cap double")
    got = {}
    for r in portfolio.project_capped_simplex(df, ("g",), "v", F.col("cap")).collect():
        got.setdefault(r.g, {})[r.i] = r.weight
    assert set(got.pop("none").values()) == {None}
    for g, w in got.items():
        v, cap = cases[g]
        assert np.allclose([w[i] for i in range(len(v))], project(v, cap), atol=1e-9), g


def greedy(budget, weights, prices):
    """Repeatedly buy the furthest-short asset that is affordable and more than half a share short."""
    shares = [max(int(w * budget // p), 0) for w, p in zip(weights, prices)]
    while True:
        cash = budget - sum(s * p for s, p in zip(shares, prices))
        short = [(w * budget - s * p, i) for i, (w, s, p) in enumerate(zip(weights, shares, prices)) if p <= cash]
        short = [x for x in short if x[0] > prices[x[1]] / 2]
        if not short:
            return shares
        shares[max(short)[1]] += 1


def test_whole_shares_match_the_greedy_rule(spark):
    rng = np.random.default_rng(4)
    cases = {"fixed": ([0.3, 0.3, 0.2, 0.2], [333.0, 241.6, 531.9, 380.7])}
    for k in range(150):
        n = int(rng.integers(2, 9))
        cases[f"r{k}"] = (rng.dirichlet(np.ones(n)).tolist(), rng.uniform(5, 900, n).round(2).tolist())
    rows = [(g, f"t{i:02d}", float(w), float(p)) for g, (ws, ps) in cases.items() for i, (w, p) in enumerate(zip(ws, ps))]
    df = spark.createDataFrame(rows, "g string, ticker string, weight double, price double")
    got = {}
    for r in portfolio.whole_shares(df, ("g",), F.lit(5000.0)).collect():
        got.setdefault(r.g, {})[r.ticker] = (r.shares, r.cash_left)
    for g, (ws, ps) in cases.items():
        shares = [got[g][f"t{i:02d}"][0] for i in range(len(ws))]
        assert shares == greedy(5000.0, ws, ps), g
        spent = sum(s * p for s, p in zip(shares, ps))
        assert spent <= 5000.0 + 1e-9 and abs(got[g]["t00"][1] - (5000.0 - spent)) < 1e-6


ASSETS = "g string, ticker string, pi double, volatility double, score double, dispersion double, effective_count double, fscore double"


def viewed(spark, scores, kappa, se):
    rows = [("p", NAMES[i], 0.05, 0.3, s, 0.4, 10.0, None) for i, s in enumerate(scores)]
    fixed = F.struct(F.lit(kappa).alias("kappa"), F.lit(se).alias("se"), F.lit(kappa / se).alias("t"))
    none = F.lit(None).cast("struct<kappa:double,se:double,t:double>")
    df = spark.createDataFrame(rows, ASSETS)
    return {r.ticker: r for r in views.calibrated_views(df, "g", fixed, none).collect()}


def test_calibrated_views(spark):
    got = viewed(spark, [0.3, 0.1, -0.1], 0.5, 0.2)
    assert abs(got["B"].q - 0.05) < 1e-12 and abs(got["A"].q - 0.05 - 0.3 * 0.42 * 0.2) < 1e-12 and got["C"].q < 0.05
    assert all(r.q is None for r in viewed(spark, [0.8, -0.8], 0.3, 0.4).values())
    assert viewed(spark, [0.5, -0.5], 0.5, 0.3)["A"].omega > 2 * viewed(spark, [0.5, -0.5], 0.5, 0.05)["A"].omega
    assert viewed(spark, [0.5, None, -0.5], 0.5, 0.1)["B"].q is None
    shown = spark.createDataFrame([("A", 0.05, 0.3, 0.08, 0.0045), ("B", 0.05, 0.3, None, None)], "ticker string, pi double, volatility double, q double, omega double")
    out = {r.ticker: r for r in views.tilt_readback(shown, 0.05).collect()}
    assert abs(out["A"].value - 0.1) < 1e-12 and abs(out["A"].confidence - 0.5) < 1e-12 and out["B"].value == out["B"].confidence == 0.0


def test_heuristic_views(spark):
    rows = [("A", 0.05, 0.3, 0.5, 0.5), ("B", 0.05, 0.3, -0.5, 0.5), ("C", 0.05, 0.3, 0.5, 0.01)]
    df = spark.createDataFrame(rows, "ticker string, pi double, volatility double, value double, confidence double")
    got = {r.ticker: r for r in views.heuristic_views(df, 0.05, 0.25).collect()}
    assert got["A"].q > 0.05 > got["B"].q and got["C"].q is None
    assert abs(got["A"].omega - 0.05 * 0.09) < 1e-12


def test_tiles_of_any_size_give_the_same_matrix(spark):
    rng = np.random.default_rng(12)
    days = 40
    rows = [(g, k, f"N{(7 * i) % n:02d}", float(rng.normal())) for g, n in (("small", 3), ("large", 23)) for i in range(n) for k in range(days)]
    df = spark.createDataFrame(rows, "g string, date int, ticker string, ret double")
    want = {(r.g, r.i, r.j): r.value for r in risk.covariance(df, "g")[0].collect()}
    got = {(r.g, r.i, r.j): r.value for r in risk.covariance(df, "g", tile=5)[0].collect()}
    assert len(want) == 3 * 3 + 23 * 23 and want.keys() == got.keys()
    assert max(abs(want[k] - got[k]) for k in want) < 1e-12
    tiles = risk._pairs(risk._vectors(df, "g"), "g", 5)
    assert tiles.groupBy("g", "i", "j").count().where("count > 1").isEmpty()


def test_free_names_are_followed_by_pivots():
    rng = np.random.default_rng(13)
    root = rng.normal(size=(9, 12))
    hess, grad = root @ root.T, rng.normal(size=9)
    free = portfolio._Free(hess)
    for name in rng.integers(0, 9, 200):
        if free.mask.sum() > 1 or not free.mask[name]:
            free.flip(int(name))
        at = np.flatnonzero(free.mask)
        move, price = free.step(grad)
        assert abs(move.sum()) < 1e-9 and not move[~free.mask].any()
        assert np.allclose((hess @ move + grad)[at], -price)


def test_optimum_with_a_singular_matrix_that_the_constraint_settles():
    root = np.random.default_rng(14).normal(size=(5, 4))
    sigma, mu = root @ root.T, np.array([0.1, 0.3, 0.2, 0.0, 0.25])
    w, _, done = portfolio.best_weights(mu, sigma, 2.5, 0.6)
    assert done and abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= 0.6
    slope = 2.5 * sigma @ w - mu
    inside = (w > 1e-9) & (w < 0.6 - 1e-9)
    price = slope[inside].mean()
    assert np.ptp(slope[inside]) < 1e-8 and (slope[w <= 1e-9] >= price - 1e-8).all()


def test_whole_shares_remember_cash_only(spark):
    rows = [(p, f"T{k:03d}", 10.0 + (k * 37 + p) % 91, 1.0 / 200) for p in range(3) for k in range(200)]
    df = spark.createDataFrame(rows, "p int, ticker string, price double, weight double")
    got = portfolio.whole_shares(df, ("p",), F.lit(5000.0)).collect()
    for p in range(3):
        mine = {r.ticker: r for r in got if r.p == p}
        base = {t: int(5000.0 * r.weight // r.price) for t, r in mine.items()}
        cash = 5000.0 - sum(base[t] * r.price for t, r in mine.items())
        for t, r in sorted(mine.items(), key=lambda x: (5000.0 * x[1].weight - base[x[0]] * x[1].price, x[0]), reverse=True):
            if 5000.0 * r.weight - base[t] * r.price > r.price / 2 and r.price <= cash:
                base[t] += 1
                cash -= r.price
        assert {t: r.shares for t, r in mine.items()} == base
        assert all(abs(r.cash_left - cash) < 1e-6 for r in mine.values())
