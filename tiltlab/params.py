"""Run parameters and the fixed values that define results."""

from __future__ import annotations

from dataclasses import dataclass, field

# Calendar and estimation constants.
TRADING_DAYS = 252
HALF_LIFE_DAYS = 3.0
CONFIDENCE_HALF_COUNT = 6.0
DISPERSION_FLOOR = 0.3
MIN_NAMES = 5
MIN_IC_DATES = 20
NEWS_PERSISTENCE = 5
FUNDAMENTAL_PERSISTENCE = 21
FUNDAMENTALS_CONFIDENCE = 0.35
MIN_VIEW_CONFIDENCE = 0.02
MAX_VIEW_CONFIDENCE = 0.95
OMEGA_FLOOR = 1e-6
MAX_ANNUAL_AGE_DAYS = 550
MAX_INSTANT_AGE_DAYS = 400
ANNUAL_PERIOD_DAYS = (350, 380)
PRIOR_YEAR_GAP_DAYS = (300, 430)
MIN_COVARIANCE_ROWS = 30
MIN_STRATEGY_DAYS = 20
MIN_LONG_SHORT_DAYS = 60
MIN_LONG_SHORT_ACTIVE = 30
WEIGHT_DUST = 1e-6
MAX_TICKERS = 20
COST_LEVELS_BPS = (10.0, 25.0, 50.0)
BENCHMARK_LARGE = "SPY"
BENCHMARK_SMALL = "IWM"

# Strategy names, the first is the active-return benchmark.
STRATEGIES = (
    "Market cap",
    "Equal weight",
    "BL, no views",
    "BL + heuristic views",
    "BL + calibrated views",
)

# Signal names with the persistence used in HAC lags.
LEVEL = "News sentiment (level)"
SURPRISE = "News sentiment (surprise vs 60d)"
EX_MOMENTUM = "News sentiment ex 5d momentum"
FUNDAMENTALS = "Fundamentals quality"
SIGNAL_PERSISTENCE = {
    LEVEL: NEWS_PERSISTENCE,
    SURPRISE: NEWS_PERSISTENCE,
    EX_MOMENTUM: NEWS_PERSISTENCE,
    FUNDAMENTALS: FUNDAMENTAL_PERSISTENCE,
}


@dataclass(frozen=True)
class EvalParams:
    """Settings of one historical evaluation; lengths count calendar rows of the panel."""

    news_window_days: int = 7
    min_headlines: int = 3
    vol_window: int = 63
    surprise_window: int = 60
    surprise_min_obs: int = 20
    momentum_lookback: int = 5
    horizons: tuple[int, ...] = (1, 5, 21)
    calibration_horizon: int = 21
    min_calibration_dates: int = 126
    rebalance_every: int = 21
    cov_window: int = 252
    cost_bps: float = 10.0
    max_weight: float = 0.35
    risk_aversion: float = 2.5
    tau: float = 0.05
    view_scale: float = 0.25
    sentiment_weight: float = 0.7
    leg_fraction: float = 1.0 / 3.0
    bootstrap_block: float = 10.0
    bootstrap_reps: int = 2000
    bootstrap_seed: int = 42

    @property
    def calibration_lags(self) -> int:
        return self.calibration_horizon - 1 + NEWS_PERSISTENCE


@dataclass(frozen=True)
class AnalysisParams:
    """Settings of one cross-section analysis ("what to hold today")."""

    tickers: tuple[str, ...] = field(default_factory=tuple)
    budget: float = 10_000.0
    max_weight: float = 0.35
    lookback_days: int = 365
    news_days: int = 7
    max_headlines: int = 40
    risk_aversion: float = 2.5
    tau: float = 0.05
    view_scale: float = 0.25
    sentiment_weight: float = 0.7
    heuristic_views: bool = False
