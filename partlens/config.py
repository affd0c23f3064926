"""Thresholds of the pricing engine, in one place."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # fixed values: they define the results
    half_life_months: float = 12.0
    days_per_month: float = 30.44
    ask_discount: float = 0.79
    alpha: float = 1.0
    beta: float = 0.10
    demand_weight: float = 0.05
    trend_clip: float = 0.10
    growth_clip: float = 0.08
    horizon_months: float = 6.0
    max_days: float = 3650.0
    bands: tuple[float, float, float] = (0.15, 0.25, 0.40)
    mad_scale: float = 1.4826
    mad_cut: float = 3.5
    tukey: float = 1.5
    cohort_fine: tuple[int, int] = (5, 3)
    cohort_global: tuple[int, int] = (25, 10)
    elasticity: float = 1.5
    score_weights: tuple[float, float, float, float, float] = (0.35, 0.25, 0.20, 0.10, 0.10)
    quality_penalty: float = 0.34
    # days: label, first, last
    buckets: tuple[tuple[str, int, int | None], ...] = (("0-30", 0, 30), ("31-90", 31, 90), ("91-183", 91, 183), ("184-365", 184, 365), ("366-548", 366, 548), ("549-730", 549, 730), ("731-1065", 731, 1065), ("1066+", 1066, None))

    @property
    def decay(self) -> float:
        return math.log(2) / self.half_life_months


CONFIG = Config()
