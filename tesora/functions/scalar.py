"""Column expressions: lenient parsing, safe ratios, fiscal indicators, calendar parts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words read as true, state names, and the reference feature list.
TRUE_WORDS = ("1", "1.0", "true", "yes", "y", "да", "истина")
ACTIVE_STATES = ("WARNING", "BREAK_CONFIRMED")
DUAL_STATES = ("NORMAL", "EARLY_WARNING", "FISCAL_DIVERGENCE", "SYSTEMIC_STRESS")
REFERENCE_FEATURES = (
    "revision_magnitude",
    "execution_gap",
    "coverage_gap",
    "transfer_dependency",
    "budget_provision_change",
    "debt_burden",
    "article136_regime",
)

#: The last line terminator may be one that is no blank.
_DECIMAL_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[\u0085\u2028\u2029]?\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- parsing -----------------------------------------------------------------


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def parse_number(c: Column | str) -> Column:
    """Text to double: inner blanks dropped, decimal comma, unicode minus, ``#...`` missing.

    Every step names the one before once, so a text is read once.
    """
    text = F.regexp_replace(_col(c).cast("string"), r"[\s\u00a0]", "")
    text = F.translate(text, ",−", ".-")
    number = F.regexp_extract(text, _DECIMAL_TEXT, 0).try_cast("double")
    return F.nullif(F.nullif(number, F.lit(math.inf)), F.lit(-math.inf))


def parse_bool(df: DataFrame, name: str) -> Column:
    """Boolean from a boolean, a number (non-zero) or a word; missing is false."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


# ---- ratios ------------------------------------------------------------------


def safe_ratio(num: Column | str, den: Column | str) -> Column:
    """NULL when either side is missing or the denominator is zero."""
    den = _col(den)
    return _col(num) / F.when(den != 0, den)


def floor_zero(c: Column | str) -> Column:
    """``max(c, 0)`` that keeps NULL (``greatest`` would skip it)."""
    c = _col(c)
    return F.when(c > 0, c).when(c.isNotNull(), F.lit(0.0))


def revision_rate(initial, revised) -> Column:
    return safe_ratio(_col(revised) - _col(initial), initial)


def revision_magnitude(initial, revised) -> Column:
    return safe_ratio(F.abs(_col(revised) - _col(initial)), F.abs(_col(initial)))


def execution_rate(revised, actual) -> Column:
    return safe_ratio(actual, revised)


def execution_gap(revised, actual) -> Column:
    return safe_ratio(_col(actual) - _col(revised), revised)


def coverage_gap(resources, cost) -> Column:
    return safe_ratio(resources, cost) - 1.0


def i13(tax_initial, nontax_initial, tax_actual, nontax_actual) -> Column:
    initial = _col(tax_initial) + _col(nontax_initial)
    actual = _col(tax_actual) + _col(nontax_actual)
    return floor_zero(safe_ratio(actual - initial, initial))


def i15(program_expense, total_expense) -> Column:
    return safe_ratio(program_expense, total_expense)


def i25(q1, q2, q3, q4) -> Column:
    return safe_ratio(q4, (_col(q1) + _col(q2) + _col(q3)) / 3.0)


def i26(utility_compensation, total_expense) -> Column:
    return safe_ratio(utility_compensation, total_expense)


def i27(overdue_payables, total_expense) -> Column:
    return safe_ratio(overdue_payables, total_expense)


def i33(municipal_debt, own_revenue_base) -> Column:
    return safe_ratio(municipal_debt, own_revenue_base)


def reference_features(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The seven reference features; a feature the table lacks is NULL."""
    present = set(df.columns)
    return df.select(
        *keys,
        *[
            (F.col(n).cast("double") if n in present else F.lit(None).cast("double")).alias(n)
            for n in REFERENCE_FEATURES
        ],
    )


# ---- calendar and growth -----------------------------------------------------


def month_bounds(c: Column | str) -> tuple[Column, Column]:
    day = _col(c).cast("date")
    return F.trunc(day, "MM"), F.last_day(day)


def calendar_features(period: Column | str) -> dict[str, Column]:
    period = _col(period)
    angle = F.month(period) * F.lit(2.0 * math.pi) / F.lit(12.0)
    return {
        "month": F.month(period),
        "quarter": F.quarter(period),
        "year": F.year(period),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def log_growth(value: Column | str, lag1: Column | str) -> Column:
    """``ln(value / lag1)``; NULL where the logarithm is not finite."""
    value, lag1 = _col(value), _col(lag1)
    return F.when((lag1 != 0) & (value / F.when(lag1 != 0, lag1) > 0), F.ln(value / F.when(lag1 != 0, lag1)))


def from_log_growth(lag1: Column | str, growth: Column | str) -> Column:
    return _col(lag1) * F.exp(_col(growth))


def residual(actual, forecast) -> Column:
    return _col(actual) - _col(forecast)


def standardized_residual(res, sigma) -> Column:
    return safe_ratio(res, sigma)


# ---- two-contour fusion ------------------------------------------------------


def state_active(state: Column | str) -> Column:
    return F.coalesce(_col(state).isin(*ACTIVE_STATES), F.lit(False))


def dual_state_code(reference_state, predictive_state) -> Column:
    return 2 * state_active(reference_state).cast("int") + state_active(predictive_state).cast("int")


def dual_state(reference_state, predictive_state) -> Column:
    code = dual_state_code(reference_state, predictive_state)
    return F.element_at(F.array(*[F.lit(s) for s in DUAL_STATES]), code + 1)


def noisy_or(r: Column | str, p: Column | str) -> Column:
    """``1 - (1-r)(1-p)``; NULL when an input is outside [0, 1]."""
    r, p = _col(r), _col(p)
    return F.when(r.between(0.0, 1.0) & p.between(0.0, 1.0), 1.0 - (1.0 - r) * (1.0 - p))


# ---- territory codes and names -----------------------------------------------


def territory_code(c: Column | str) -> Column:
    """Eight digits; an eleven-digit code is cut; anything else is NULL."""
    digits = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"[^0-9]", "")
    return F.when(F.length(digits) == 11, F.substring(digits, 1, 8)).when(F.length(digits) == 8, digits)


def code_part(c: Column | str, width: int) -> Column:
    """Digits of one code part, zero-padded on the left; no digits gives an empty text."""
    digits = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), r"[^0-9]", "")
    return F.when(digits == "", F.lit("")).when(F.length(digits) >= width, digits).otherwise(
        F.lpad(digits, width, "0")
    )


def name_key(c: Column | str) -> Column:
    """Lower case, one spelling of the letter yo, everything else than letters and digits to a blank."""
    text = F.translate(F.lower(F.coalesce(_col(c), F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(text, "[^0-9a-zа-я]+", " "))


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, in the given order; NULL when none does."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in reasons]) if reasons else F.lit(None).cast("string")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
