"""Column functions on prices: guards, rounding, ticks, fees and costs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Round-trip cost of a market in basis points.
COST_BPS = {"GOLD": 5.0, "FOREX": 1.5, "TH_STOCK": 40.0, "US_STOCK": 5.0, "CRYPTO": 25.0}
#: Exchange price bands, (from, tick).
TICK_BANDS = ((0.0, 0.01), (2.0, 0.02), (5.0, 0.05), (10.0, 0.10), (25.0, 0.25), (100.0, 0.50), (200.0, 1.00), (400.0, 2.00))
#: Commission per side, least commission of an order, amount at risk, ticks of slippage.
COMMISSION, LEAST_FEE, RISKED, SLIP_TICKS = 0.00157, 50.0, 2000.0, 1


def finite(x: Column) -> Column:
    """NaN and infinities become null: the library's only missing value."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def usable(o: str = "open", h: str = "high", lo: str = "low", c: str = "close") -> Column:
    """Whether a bar has four finite positive prices and low <= high."""
    good = F.lit(True)
    for name in (o, h, lo, c):
        good = good & F.coalesce(finite(F.col(name)) > 0, F.lit(False))
    return good & F.coalesce(F.col(lo) <= F.col(h), F.lit(False))


def rounder(market: pd.Series) -> Callable[[np.ndarray], np.ndarray]:
    """The price rounding of a batch's markets: currencies keep 5 decimals, other markets 4; prices under 1 keep 5
    and 6 significant digits.  Half goes up on the scaled value."""
    forex = (market == "FOREX").to_numpy()

    def rounded(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            small = 10.0 ** (np.where(forex, 4, 5) - np.floor(np.log10(np.abs(x))))
            scale = np.where((np.abs(x) < 1) & (x != 0), small, np.where(forex, 1e5, 1e4))
            return np.floor(x * scale + 0.5) / scale

    return rounded


@F.pandas_udf(DoubleType())
def round_price(x: pd.Series, market: pd.Series) -> pd.Series:
    """The price rounding as a column function."""
    return pd.Series(rounder(market)(x.to_numpy(float)))


def exact_round(x: Column, places: int, even: bool = False) -> Column:
    """Rounds the exact binary value to decimal places; ties go away from zero, or with ``even`` to the even digit.

    The scaled value is kept as a product and its rounding error (Veltkamp's and Dekker's splitting), so a value
    next to a tie falls to its true side, as it does where all digits are written out.  Sizes from 2^52 up, scaled, have no
    decimals and stay as they are."""
    scale, a = float(10**places), F.abs(x)
    split = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    high, top = split(a), scale * 134217729.0 - (scale * 134217729.0 - scale)
    product = a * scale
    error = (a - high) * (scale - top) - (((product - high * top) - (a - high) * top) - high * (scale - top))
    whole = F.floor(product)
    past = (product - whole - 0.5) + error
    up = (past > 0) | ((past == 0) & (whole % 2 == 1)) if even else past >= 0
    return F.when(product < 2.0**52, F.signum(x) * (whole + up.cast("int")) / scale).otherwise(x)


def tick_size(price: Column) -> Column:
    out = F.lit(TICK_BANDS[0][1])
    for start, tick in TICK_BANDS[1:]:
        out = F.when(price >= start, F.lit(tick)).otherwise(out)
    return F.when(price.isNotNull(), out)


def thai_cost_r(price: Column, stop_share: Column) -> Column:
    """Cost in units of risk: commission of both sides with its least amount, and slippage."""
    value = RISKED / stop_share
    fee = 2 * F.greatest(value * COMMISSION, F.lit(LEAST_FEE))
    return (fee + value * SLIP_TICKS * tick_size(price) / price) / RISKED


def thai_cost_parts(price: Column, stop_share: Column, risked: Column | float = RISKED, ticks: Column | int = SLIP_TICKS) -> Column:
    """The parts of that cost for other amounts at risk and spreads: commission_r, tick_r and whether the least commission is paid."""
    value = F.lit(risked) / stop_share
    commission = 2 * F.greatest(value * COMMISSION, F.lit(LEAST_FEE)) / risked
    spread = F.lit(ticks) * tick_size(price) / price / stop_share
    return F.struct(commission.alias("commission_r"), spread.alias("tick_r"), (value * COMMISSION < LEAST_FEE).alias("least_fee"))


def cost_bps(market: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COST_BPS.items() for x in pair])
    return table[market]


def risk_reward(entry: Column, stop: Column, target: Column) -> Column:
    """Reward over risk; null where there is no risk."""
    return F.when(F.abs(entry - stop) > 0, F.abs(target - entry) / F.abs(entry - stop))


def composite_score(strength: Column, confidence: Column, rr: Column, urgency: Column) -> Column:
    """Digest score: strength, confidence, capped reward-to-risk and urgency."""
    base = F.create_map(*[F.lit(x) for x in ("very_strong", 40.0, "strong", 28.0, "moderate", 14.0, "weak", 0.0)])
    return F.coalesce(base[strength], F.lit(0.0)) + confidence / 100 * 30 + F.least(rr, F.lit(3.0)) / 3 * 20 + urgency
