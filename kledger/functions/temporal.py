"""Lenient time parsing, decay and the ordered freshness rules. The clock is always a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half lives in days and the two decay thresholds.
HALF_LIFE = {"volatile": 30.0, "drifting": 90.0}
REVIEW_RATIO = 0.5
STALE_RATIO = 0.25
# Ranking factors.
CONFIDENCE_FACTOR = {"high": 1.0, "medium": 0.9, "low": 0.75}
IMPORTANCE_FLOOR = 0.5
IMPORTANCE_UNKNOWN = 0.6

ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"
DAY_MICROS = 86400e6


def parse_ts(c: Column) -> Column:
    """NULL when blank, malformed or reduced to a bare year; naive values are read in the session zone, UTC."""
    return F.when(c.rlike(ISO_SHAPE), c.try_cast("timestamp"))


def now_lit(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def age_days(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(DAY_MICROS)


def base_time(observed_at: Column, created: Column) -> Column:
    return F.coalesce(parse_ts(observed_at), parse_ts(created))


def base_field(observed_at: Column, created: Column) -> Column:
    return F.when(parse_ts(observed_at).isNotNull(), "observed_at").when(parse_ts(created).isNotNull(), "created")


def half_life(volatility: Column, table: dict[str, float] | None = None) -> Column:
    out = F.lit(None).cast("double")
    for k, v in (table or HALF_LIFE).items():
        out = F.when(volatility == k, F.lit(float(v) if v > 0 else None).cast("double")).otherwise(out)
    return out


def decay(age: Column, half: Column) -> Column:
    return F.when(half.isNull() | (half <= 0) | age.isNull() | (age <= 0), F.lit(1.0)).otherwise(
        F.pow(F.lit(0.5), age / half)
    )


def confidence_factor(c: Column) -> Column:
    out = F.lit(CONFIDENCE_FACTOR["medium"])
    for k, v in CONFIDENCE_FACTOR.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def importance_factor(c: Column) -> Column:
    v = F.when(c.isNull(), F.lit(IMPORTANCE_UNKNOWN)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return F.lit(IMPORTANCE_FLOOR) + F.lit(1.0 - IMPORTANCE_FLOOR) * v


@dataclass(frozen=True)
class FreshnessSettings:
    """Thresholds, with optional per-kind overrides. Out-of-range numbers are pulled into range."""

    half_life_days: dict = field(default_factory=lambda: dict(HALF_LIFE))
    review_ratio: float = REVIEW_RATIO
    stale_ratio: float = STALE_RATIO
    per_kind: dict = field(default_factory=dict)

    @staticmethod
    def layered(*half_life_layers: dict, **kw) -> FreshnessSettings:
        merged = dict(HALF_LIFE)
        for layer in half_life_layers:
            merged.update({k: float(v) for k, v in layer.items() if v is not None})
        return FreshnessSettings(half_life_days=merged, **kw)

    def bounds(self, review=None, stale=None) -> tuple[float, float]:
        r = min(1.0, max(0.0, self.review_ratio if review is None else review))
        s = min(1.0, max(0.0, self.stale_ratio if stale is None else stale))
        return r, min(s, r)

    def columns(self, kind: Column, volatility: Column) -> tuple[Column, Column, Column]:
        """Effective (half life, review ratio, stale ratio) of each row, as literal CASE chains."""
        r, s = self.bounds()
        half, review, stale = half_life(volatility, self.half_life_days), F.lit(r), F.lit(s)
        for name, over in self.per_kind.items():
            kr, ks = self.bounds(over.get("review_ratio"), over.get("stale_ratio"))
            table = {**self.half_life_days, **over.get("half_life_days", {})}
            half = F.when(kind == name, half_life(volatility, table)).otherwise(half)
            review = F.when(kind == name, F.lit(kr)).otherwise(review)
            stale = F.when(kind == name, F.lit(ks)).otherwise(stale)
        return half, review, stale
