"""The parts of a posting's rank, each 0 to 1 with 0.5 for what is not known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 0.5
# Weights of the composite, in order of summation.
WEIGHTS = {"pay": 0.29, "recency": 0.23, "deadline": 0.15, "location": 0.10, "prestige": 0.23}
# Working hours of a year, floor and target of hourly pay.
HOURS, PAY_FLOOR, PAY_CEILING = 2080.0, 15.0, 65.0
HALF_LIFE_DAYS, SOON_DAYS, FAR_DAYS = 30.0, 7.0, 90.0
TIERS = {1: 1.00, 2: 0.88, 3: 0.78}


def days(later: Column, earlier: Column) -> Column:
    return (F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))) / F.lit(86_400_000.0)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rounded(c: Column, digits: int) -> Column:
    """To so many decimals as SQL engines with binary numbers do: the scaled number to the nearest whole one, halves away from zero.

    ``round`` goes by the decimal that a number is printed as, so 0.37944740849999997 is below the half for it; scaled by
    10^9 it is the half itself.
    """
    scale = F.lit(10.0**digits)
    return F.round(c * scale) / scale


def hourly_usd(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """Midpoint in dollars an hour; null if absent or not comparable."""
    middle = F.coalesce((low + high) / 2, low)
    rate = F.when(period == "hour", middle).when(period == "month", middle / F.lit(HOURS / 12)).when(period == "year", middle / F.lit(HOURS))
    return F.when((currency == "USD") & ~F.isnan(rate), rate)


def pay_scale(hourly: Column) -> Column:
    return clamp((hourly - PAY_FLOOR) / (PAY_CEILING - PAY_FLOOR))


def pay_score(hourly: Column, stated: Column, median: Column, observations: Column) -> Column:
    """Known pay, else (where none is stated) a damped company median of three or more, else neutral."""
    damped = F.lit(NEUTRAL) + (pay_scale(median) - NEUTRAL) * 0.7
    return F.when(hourly.isNotNull(), pay_scale(hourly)).when(stated, F.lit(NEUTRAL)).when(observations >= 3, F.coalesce(damped, F.lit(NEUTRAL))).otherwise(F.lit(NEUTRAL))


def recency(posted: Column, estimated: Column, now: Column) -> Column:
    decay = F.pow(F.lit(0.5), F.greatest(F.lit(0.0), days(now, posted)) / HALF_LIFE_DAYS)
    return F.when(posted.isNull(), F.lit(NEUTRAL)).when(estimated, F.least(decay, F.lit(NEUTRAL))).otherwise(decay)


def deadline(at: Column, now: Column) -> Column:
    left = days(at, now)
    return F.when(at.isNull(), F.lit(NEUTRAL)).when(left < 0, F.lit(0.0)).when(left <= SOON_DAYS, F.lit(1.0)).when(left >= FAR_DAYS, F.lit(0.0)).otherwise((FAR_DAYS - left) / (FAR_DAYS - SOON_DAYS))


def location(remote: Column) -> Column:
    return F.when(remote, F.lit(1.0)).otherwise(F.lit(NEUTRAL))


def prestige(tier: Column, live: Column, sources: Column, most_sources: Column, median: Column) -> Column:
    """Curated tier, else evidence from postings, sources and pay, else null."""
    curated = F.when(tier == 1, F.lit(TIERS[1])).when(tier == 2, F.lit(TIERS[2])).when(tier.isNotNull(), F.lit(TIERS[3]))
    volume = clamp(F.log1p(F.greatest(live, F.lit(0)).cast("double")) / F.log(F.lit(41.0)))
    spread = F.when(most_sources <= 1, F.lit(NEUTRAL)).otherwise(clamp(sources / most_sources))
    pay = F.coalesce(clamp(median / 90.0), (volume + spread) / 2)
    derived = 0.35 + 0.30 * clamp(0.5 * pay + 0.3 * volume + 0.2 * spread)
    evidence = (live >= 2) | (sources >= 2) | median.isNotNull()
    return F.coalesce(curated, F.when(evidence, derived))


def composite(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + parts[name] * weight
    return total


def tri_state(c: Column, wanted, keep_unknown: bool = True) -> Column:
    """True if nothing is wanted; unknown rows are kept or dropped as told; else equality."""
    if wanted is None:
        return F.lit(True)
    return F.when(c.isNull(), F.lit(keep_unknown)).otherwise(c == wanted)


def half_life(value: Column, age_days: Column, half: float) -> Column:
    return value * F.pow(F.lit(0.5), age_days / half)
