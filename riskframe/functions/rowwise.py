"""Features that need one row only: every function returns column expressions.

Callers put all of them into one ``withColumns``, so a row is projected once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.spec import TableSpec

# Calendar units, markers, band edges and device patterns.
SECONDS_PER_HOUR = 3600
SECONDS_PER_DAY = 86400
SECONDS_PER_WEEK = 604800
NIGHT_UNTIL_HOUR = 5
NIGHT_FROM_HOUR = 22
MISSING_KEY = "__NA__"
MISSING_CATEGORY = "__MISSING__"
MISSING_GROUP = "__missing__"
AMOUNT_BANDS = (
    (10, "00_0_10"),
    (25, "01_10_25"),
    (50, "02_25_50"),
    (100, "03_50_100"),
    (250, "04_100_250"),
    (500, "05_250_500"),
    (1000, "06_500_1000"),
)
TOP_AMOUNT_BAND = "07_1000_plus"
DEVICE_PATTERNS = (
    ("apple", "iphone|ipad|ios"),
    ("android", "android|samsung|sm-"),
    ("windows", "windows"),
    ("mac", "mac"),
)
OTHER_DEVICE = "other"
FAR_DISTANCE = 1000


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def finite(amount: str | Column) -> Column:
    """The amount, or NULL where it is NaN or infinite."""
    column = F.col(amount) if isinstance(amount, str) else amount
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), column)


def minor_units(amount: str | Column, scale: int) -> Column:
    """The amount as a whole number of its smallest unit, for exact sums. NaN and infinite amounts are unknown."""
    return F.round(finite(amount) * F.lit(10**scale), 0).cast("bigint")


def exact_amount(amount: str | Column) -> Column:
    """The amount as a decimal of nine places, for exact sums of amounts whose decimals aren't known."""
    return finite(amount).cast("decimal(28,9)")


def exact_units(amount: str | Column) -> Column:
    """The amount in whole billionths."""
    return (exact_amount(amount) * F.lit(10**9)).cast("decimal(38,0)")


def fits_scale(amount: str | Column, scale: int) -> Column:
    """Whether the amount has no more than ``scale`` decimals; unknown amounts do."""
    exact = exact_amount(amount)
    return F.coalesce(exact == F.round(exact, scale), F.lit(True))


def normalised(column: str) -> Column:
    """Trimmed lower-case text; blank becomes NULL."""
    return F.nullif(F.lower(F.trim(F.col(column).cast("string"))), F.lit(""))


def time_parts(time: str) -> dict[str, Column]:
    """Calendar-like parts of a relative number of seconds."""
    seconds = F.col(time)
    day = F.floor(seconds / SECONDS_PER_DAY).cast("bigint")
    week = F.floor(seconds / SECONDS_PER_WEEK).cast("bigint")
    hour = F.floor((seconds % SECONDS_PER_DAY) / SECONDS_PER_HOUR).cast("int")
    return {
        "transaction_day": day,
        "transaction_week": week,
        "transaction_hour": hour,
        "transaction_day_of_week_proxy": (day % 7).cast("int"),
        "transaction_age_days": (seconds / SECONDS_PER_DAY).cast("double"),
        "is_night_transaction": flag((hour <= NIGHT_UNTIL_HOUR) | (hour >= NIGHT_FROM_HOUR)),
        "transaction_period": F.concat(F.lit("week_"), week.cast("string")),
    }


def amount_band(amount: Column) -> Column:
    """Right-closed bands. A NULL amount meets no upper edge and takes the top band."""
    upper, name = AMOUNT_BANDS[0]
    band = F.when(amount <= upper, name)
    for upper, name in AMOUNT_BANDS[1:]:
        band = band.when(amount <= upper, name)
    return band.otherwise(TOP_AMOUNT_BAND)


def amount_parts(amount: str) -> dict[str, Column]:
    value = F.col(amount)
    return {
        "log_transaction_amount": F.log1p(value.cast("double")),
        "amount_decimal": (value - F.floor(value)).cast("double"),
        "amount_band": amount_band(value),
    }


def missing_count(columns: Sequence[str]) -> Column:
    """How many of the columns are NULL in the row."""
    return reduce(add, (F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def missingness(columns: Sequence[str], spec: TableSpec) -> dict[str, Column]:
    """Missing counts and ratios over the watched and the side-table columns."""
    watched = [c for c in spec.watched if c in columns]
    identity = [c for c in columns if c.startswith(spec.identity_prefix)]
    return {
        "selected_missing_count": missing_count(watched),
        "selected_missing_ratio": missing_count(watched) / F.lit(float(max(len(watched), 1))),
        "identity_missing_count": missing_count(identity),
        "identity_missing_ratio": missing_count(identity) / F.lit(float(max(len(identity), 1))),
    }


def any_present(columns: Sequence[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()


def presence(spec: TableSpec) -> dict[str, Column]:
    """Presence flags. Two missing e-mail domains count as the same domain."""
    return {
        "has_device_info": F.col(spec.device_info).isNotNull().cast("int"),
        "has_p_email": F.col(spec.payer_email).isNotNull().cast("int"),
        "has_r_email": F.col(spec.receiver_email).isNotNull().cast("int"),
        "has_distance": any_present(spec.distances).cast("int"),
        "has_address": any_present(spec.addresses).cast("int"),
        "same_email_domain": F.col(spec.payer_email).eqNullSafe(F.col(spec.receiver_email)).cast("int"),
    }


def device_family(device_info: str) -> Column:
    """First family whose pattern occurs; no text and no match are both 'other'."""
    text = F.lower(F.col(device_info))
    matches = [F.when(text.rlike(pattern), family) for family, pattern in DEVICE_PATTERNS]
    return F.coalesce(*matches, F.lit(OTHER_DEVICE))


def entity_key(*columns: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING_KEY)) for c in columns]
    return F.concat_ws("|", *parts)


def entity_keys(columns: Sequence[str], spec: TableSpec) -> dict[str, Column]:
    return {
        "card_entity_key": entity_key(*[c for c in spec.card_parts if c in columns]),
        "email_entity_key": entity_key(spec.payer_email),
        "device_entity_key": entity_key(spec.device_type, spec.device_info),
        "address_entity_key": entity_key(*spec.addresses),
    }


def outlier_flags(spec: TableSpec, upper_cap: float, high_amount: float) -> dict[str, Column]:
    """Capped amount and flags under frozen thresholds.

    ``least`` skips NULL, so a NULL amount becomes the cap itself.
    """
    amount = F.col(spec.amount).cast("double")
    far = reduce(lambda a, b: a | b, (flag(F.col(c) >= FAR_DISTANCE) == 1 for c in spec.distances))
    return {
        "transaction_amount_capped": F.least(amount, F.lit(float(upper_cap))),
        "high_amount_flag": flag(amount >= F.lit(float(high_amount))),
        "amount_outlier_flag": flag(amount >= F.lit(float(upper_cap))),
        "distance_outlier_flag": far.cast("int"),
    }


def amount_against_mean(amount: str, mean: str) -> dict[str, Column]:
    """Amount relative to the entity's own mean; 1.0 when there is no positive mean."""
    value, average = F.col(amount).cast("double"), F.col(mean)
    return {
        "amount_ratio_to_card_mean": F.when(average > 0, value / average).otherwise(F.lit(1.0)),
        "amount_deviation_from_card_mean": value - average,
    }


def normalise(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.withColumns({c: normalised(c) for c in spec.normalised if c in df.columns})


def base_features(df: DataFrame, spec: TableSpec) -> DataFrame:
    """All row features that need no fitted statistic, on normalised columns."""
    clean = normalise(df, spec)
    return clean.withColumns(
        {
            **time_parts(spec.time),
            **amount_parts(spec.amount),
            **missingness(clean.columns, spec),
            **presence(spec),
            "device_family": device_family(spec.device_info),
            **entity_keys(clean.columns, spec),
        }
    )
