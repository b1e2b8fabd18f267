"""Parameters of the pricing engine; nothing else in the package hard-codes them."""

from __future__ import annotations

from dataclasses import dataclass

# Tiers are (upper bound, rate, least amount), the last without a bound.
RESERVE_TIERS = ((1_000_000, 0.08, 65_000), (2_500_000, 0.065, 85_000), (5_000_000, 0.055, 130_000), (None, 0.045, 220_000))
COMMISSION_TIERS = ((1_500_000, 0.045, 50_000), (4_000_000, 0.035, 80_000), (7_000_000, 0.03, 120_000), (None, 0.025, 175_000))
DAMAGE_PENALTY = {"NO": 0.0, "YES": 0.08}
UNKNOWN_PENALTY = 0.04
REGIONAL_MULTIPLIERS = {"Istanbul": 1.0, "Ankara": 0.98, "Izmir": 0.99}


@dataclass(frozen=True)
class PricingConfig:
    """Reference year, sanity bounds and the version of the snapshots that are served."""

    ref_year: int = 2026
    min_price: int = 50_000
    max_price: int = 150_000_000
    min_year: int = 1980
    max_mileage: int = 2_000_000
    yearly_mileage: int = 15_000
    default_decay: float = 0.0025
    default_growth: float = 0.08
    version: str = "v2.0"


DEFAULT = PricingConfig()
