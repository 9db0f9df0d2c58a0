"""Column builders: null-safe arithmetic, cleaning, calendar parts and labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean a category, as the shop's exports write them.
PAYMENT_METHODS = {
    "creditcard": "credit_card",
    "credit_card": "credit_card",
    "card": "credit_card",
    "cod": "cod",
    "cash_on_delivery": "cod",
    "cashondelivery": "cod",
    "banktransfer": "bank_transfer",
    "bank_transfer": "bank_transfer",
    "wire_transfer": "bank_transfer",
    "applepay": "apple_pay",
    "apple_pay": "apple_pay",
    "paypal": "paypal",
    "ewallet": "ewallet",
    "e_wallet": "ewallet",
}
RETURN_REASONS = {
    "size_issue": "wrong_size",
    "too_small": "wrong_size",
    "too_large": "wrong_size",
    "fit_issue": "wrong_size",
    "changedmind": "changed_mind",
    "no_longer_needed": "changed_mind",
    "buyer_remorse": "changed_mind",
    "did_not_want": "changed_mind",
    "damaged": "defective",
    "faulty": "defective",
}
TRAFFIC_SOURCES = {
    "organic": ["organic"],
    "paid": ["paid", "ppc", "cpc", "sem"],
    "email": ["email", "newsletter"],
    "social": ["social"],
    "direct": ["direct"],
    "referral": ["referral", "affiliate"],
    "display": ["display", "banner"],
}
SOCIAL_NAMES = ["facebook", "instagram", "twitter", "x", "tiktok", "linkedin"]
PREMIUM_TERMS = [
    "premium", "luxury", "high_end", "highend", "elite", "pro", "prestige", "upper",
]
COMPLETED_STATUSES = ["delivered", "shipped", "paid"]
AGE_BANDS = [
    (17, "under_18"), (24, "18_24"), (34, "25_34"), (44, "35_44"), (54, "45_54"), (64, "55_64"),
]
HORIZON_BANDS = [
    (30, "days_1_30"), (90, "days_31_90"), (180, "days_91_180"), (365, "days_181_365"),
]
WRONG_SIZE_TERMS = ["wrong_size", "size_issue", "too_small", "too_large", "fit_issue"]
DEFECT_TERMS = ["defective", "damaged", "broken", "quality_issue", "faulty"]
PEAK_MONTHS, LOW_MONTHS, PEAK_QUARTERS, LOW_QUARTERS = [4, 5, 6], [11, 12, 1], [2], [4]


# --- arithmetic -----------------------------------------------------------------

def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where the denominator is zero."""
    return top / F.nullif(bottom, F.lit(0))


def safe_divide(top: Column, bottom: Column, eps: float = 1e-9) -> Column:
    """``top / bottom``, null where the denominator is nearly zero."""
    return F.when(F.abs(bottom) > eps, top / bottom)


def change(value: Column, base: Column) -> Column:
    """Relative change of ``value`` from ``base``."""
    return value / F.nullif(base, F.lit(0)) - 1


def clip(value: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Limit ``value`` to ``[low, high]``; null stays null."""
    out = value
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def log1p_safe(value: Column) -> Column:
    """``log(1 + x)``, null at and below -1."""
    return F.when(value > -1, F.log1p(value))


def repair_ratio(value: Column) -> Column:
    """Percentages written as 45 become 0.45."""
    return F.when(F.abs(value) > 1.5, value / 100).otherwise(value)


def at_least(value: Column, cut: Column) -> Column:
    """``value >= cut`` where the cut is a statistic of the same values.

    Both sides can be sums that were added up in different orders, so a value that
    defines the cut must not fall on its wrong side by the last bit.
    """
    return value >= cut - F.abs(cut) * 1e-12


def at_most(value: Column, cut: Column) -> Column:
    """``value <= cut``, see :func:`at_least`."""
    return value <= cut + F.abs(cut) * 1e-12


# --- cleaning -------------------------------------------------------------------

def normalize_key(value: Column) -> Column:
    """Trim ids, drop blank markers and the ``.0`` a float column leaves behind."""
    text = F.trim(value.cast("string"))
    text = F.when(~F.lower(text).isin("", "nan", "none", "<na>", "null"), text)
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")


def snake_case(value: Column) -> Column:
    """Lower-case label with single underscores."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9]+", "_")
    return F.regexp_replace(text, r"^_+|_+$", "")


def parse_number(value: Column) -> Column:
    """Number in text with thousands commas and percent signs removed."""
    return F.regexp_replace(F.trim(value), "[,%]", "").try_cast("double")


def mapped(value: Column, mapping: dict[str, str]) -> Column:
    """Replace known spellings, keep the rest."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, value), value)


def standard_payment(value: Column) -> Column:
    """Common spelling of a payment method."""
    return mapped(snake_case(value), PAYMENT_METHODS)


def standard_reason(value: Column) -> Column:
    """Common spelling of a return reason."""
    return mapped(F.translate(F.lower(F.trim(value)), "- ", "__"), RETURN_REASONS)


def standard_source(value: Column) -> Column:
    """Traffic source by the first keyword group that occurs in the label."""
    text = F.regexp_replace(F.lower(F.trim(value)), r"[\s\-]+", "_")
    out = F.when(text.isNull() | (text == ""), "unknown")
    for label, words in TRAFFIC_SOURCES.items():
        hit = text.rlike("|".join(words))
        if label == "social":
            hit = hit | text.isin(*SOCIAL_NAMES)
        out = out.when(hit, label)
    return out.otherwise(text)


def is_wrong_size(reason: Column) -> Column:
    """Return reason about size or fit."""
    return F.coalesce(reason.rlike("|".join(WRONG_SIZE_TERMS)), F.lit(False))


def is_defective(reason: Column) -> Column:
    """Return reason about a defect."""
    return F.coalesce(reason.rlike("|".join(DEFECT_TERMS)), F.lit(False))


def is_premium(label: Column) -> Column:
    """Label that names a premium line."""
    return F.coalesce(snake_case(label).rlike("|".join(PREMIUM_TERMS)), F.lit(False))


def promo_type(kind: Column, name: Column, value: Column) -> Column:
    """Promotion type from its texts, else from the size of its value."""
    text = F.lower(F.concat_ws(" ", kind, name))
    return (
        F.when(text.rlike("percent|percentage|pct|%"), "percentage")
        .when(text.rlike("fixed|amount|cash|value|vnd|currency"), "fixed")
        .when((value > 0) & (value <= 1), "percentage_inferred")
        .when((value > 1) & (value <= 100) & text.rlike("sale|discount|promo"), "percentage_inferred")
        .when(value > 100, "fixed_inferred")
        .otherwise("other_unknown")
    )


# --- status ---------------------------------------------------------------------

def is_completed(status: Column) -> Column:
    """Order reached the customer or was paid."""
    return F.coalesce(F.lower(status).isin(*COMPLETED_STATUSES), F.lit(False))


def is_cancelled(status: Column) -> Column:
    """Order was cancelled, failed or voided."""
    return F.coalesce(F.lower(status).rlike("cancel|failed|void"), F.lit(False))


def is_returned(status: Column) -> Column:
    """Order was returned or refunded."""
    return F.coalesce(F.lower(status).rlike("return|refund"), F.lit(False))


# --- calendar -------------------------------------------------------------------

def month_start(day: Column) -> Column:
    """First day of the month."""
    return F.trunc(day, "MM")


def calendar_parts(day: Column) -> dict[str, Column]:
    """Plain calendar parts; Monday is weekday 0 and weeks are ISO weeks."""
    return {
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "week": F.weekofyear(day),
        "day_of_year": F.dayofyear(day),
        "day": F.dayofmonth(day),
        "weekday": F.weekday(day),
        "month_index": F.year(day) * 12 + F.month(day),
        "is_weekend": F.weekday(day) >= 5,
        "is_month_start": F.dayofmonth(day) == 1,
        "is_month_end": day == F.last_day(day),
    }


def season_flags(day: Column) -> dict[str, Column]:
    """Fixed peak and low months and quarters."""
    return {
        "is_peak_month": F.month(day).isin(PEAK_MONTHS),
        "is_low_month": F.month(day).isin(LOW_MONTHS),
        "is_peak_quarter": F.quarter(day).isin(PEAK_QUARTERS),
        "is_low_quarter": F.quarter(day).isin(LOW_QUARTERS),
    }


def cyclic(value: Column, period: float, name: str) -> dict[str, Column]:
    """Sine and cosine of a position in a cycle."""
    angle = value * F.lit(2 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def cyclic_parts(day: Column, harmonics: int = 4) -> dict[str, Column]:
    """Cyclical encodings of month, quarter, weekday, day of month and year."""
    angle = (F.dayofmonth(day) - 1) / F.dayofmonth(F.last_day(day)) * F.lit(2 * math.pi)
    out = {
        **cyclic(F.month(day), 12, "month"),
        **cyclic(F.quarter(day), 4, "quarter"),
        **cyclic(F.weekday(day), 7, "weekday"),
        "day_sin": F.sin(angle),
        "day_cos": F.cos(angle),
    }
    for k in range(1, harmonics + 1):
        out |= cyclic(F.dayofyear(day) * k, 365.25, f"year_{k}")
    return out


def days_to_month_end(day: Column) -> Column:
    """Days left in the month."""
    return F.datediff(F.last_day(day), day)


def month_position(day: Column, edge: int = 7) -> Column:
    """First and last ``edge`` days of a month against the middle."""
    return (
        F.when(F.dayofmonth(day) <= edge, "month_start")
        .when(days_to_month_end(day) < edge, "month_end")
        .otherwise("month_middle")
    )


def payday_window(day: Column) -> Column:
    """Days 25-31 and 1-5, when wages usually arrive."""
    dom = F.dayofmonth(day)
    inside = dom.between(25, 31) | dom.between(1, 5)
    return F.when(inside, "payday_proxy_window").otherwise("non_payday_proxy_window")


# --- bins and labels ------------------------------------------------------------

def bands(value: Column, edges: Sequence[tuple[float, str]], last: str) -> Column:
    """Right-closed bins; values above the last edge get ``last``, null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        out = out.when(value <= edge, label)
    return out.otherwise(last)


def age_band(age: Column) -> Column:
    """Age group; impossible or missing ages are Unknown."""
    valid = F.when(age.between(0, 110), age)
    return F.coalesce(bands(valid, AGE_BANDS, "65_plus"), F.lit("Unknown"))


def age_on(birth: Column, day: Column) -> Column:
    """Age in years on a day."""
    return F.datediff(day, birth) / 365.25


def order_tier(orders: Column) -> Column:
    """Order-count tier of a customer."""
    return bands(orders, [(1, "one_time"), (3, "2_3_orders"), (5, "4_5_orders")], "6_plus_orders")


def horizon_band(step: Column) -> Column:
    """Forecast-horizon bucket of a day number."""
    return bands(step, HORIZON_BANDS, "days_366_plus")


def correlation_label(value: Column) -> Column:
    """Strength and direction of a correlation."""
    size = F.abs(value)
    strength = (
        F.when(size >= 0.7, "strong")
        .when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak")
        .otherwise("very weak")
    )
    direction = F.when(value > 0, "positive").when(value < 0, "negative").otherwise("zero")
    return F.when(value.isNull(), "not available").otherwise(
        F.concat_ws(" ", strength, direction)
    )


def equal_count_bin(position: Column, size: Column, bins: int) -> Column:
    """Bin 1..bins of a row number when edges are quantiles of the row numbers."""
    return F.greatest(
        F.lit(1), F.ceil((position - 1) * bins / F.nullif(size - 1, F.lit(0)))
    ).cast("int")


def stockout(flag: Column, days: Column, stock: Column) -> Column:
    """Given flag, else days out of stock, else an empty shelf."""
    return F.coalesce(flag, days > 0, stock <= 0, F.lit(False))


# --- aggregates -----------------------------------------------------------------

def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean weighted by positive weights; plain mean where none is positive."""
    use = value.isNotNull() & (weight > 0)
    top = F.sum(F.when(use, value * weight))
    bottom = F.sum(F.when(use, weight))
    return F.coalesce(ratio(top, bottom), F.avg(value))


def skew_adjusted(value: Column) -> Column:
    """Sample skewness, adjusted for bias; null below three values."""
    n = F.count(value)
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))
    return F.when((n >= 3) & (F.stddev_pop(value) > 0), F.skewness(value) * factor)


def entropy(share: Column) -> Column:
    """Shannon entropy of shares."""
    return -F.sum(F.when(share > 0, share * F.ln(share)).otherwise(0.0))


def herfindahl(share: Column) -> Column:
    """Sum of squared shares."""
    return F.sum(share * share)


def share_of(total: Column, whole: Column) -> Column:
    """Fraction, null when the whole is zero."""
    return ratio(total, whole)
