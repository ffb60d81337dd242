"""Scalar expressions: labels, losses, skill and class rules."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pollutants in scope and accent folding for header values.
ALLOWED_POLLUTANTS = ("PM10", "PM2.5")
ACCENTED, PLAIN = "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc"


def normalize_pollutant(x: Column) -> Column:
    """Upper case without blanks; ``PM25`` is read as ``PM2.5``."""
    tight = F.replace(F.upper(F.trim(x.cast("string"))), F.lit(" "), F.lit(""))
    return F.when(tight == "PM25", F.lit("PM2.5")).otherwise(tight)


def normalize_component(x: Column) -> Column:
    return normalize_pollutant(x)


def safe_tag(x: Column) -> Column:
    """Pollutant tag usable in a file name: no dot."""
    return F.replace(normalize_pollutant(x), F.lit("."), F.lit(""))


def normalize_city(x: Column) -> Column:
    return F.replace(F.trim(x.cast("string")), F.lit(" "), F.lit("_"))


def require_allowed(df: DataFrame, column: str, allowed: Sequence[str] = ALLOWED_POLLUTANTS) -> DataFrame:
    """Replace ``column`` by its normalized form; a value outside ``allowed`` fails the job."""
    norm = normalize_pollutant(F.col(column))
    checked = F.when(norm.isin(list(allowed)), norm).otherwise(
        F.raise_error(F.concat(F.lit("value out of scope: "), F.coalesce(F.col(column).cast("string"), F.lit("NULL"))))
    )
    return df.withColumn(column, checked)


def normalize_header(name: str) -> str:
    """Lower case, no byte-order mark, outer blanks or accents."""
    text = unicodedata.normalize("NFD", str(name).replace("﻿", "").strip().lower())
    return "".join(c for c in text if unicodedata.category(c) != "Mn")


def normalize_label(x: Column) -> Column:
    """The same rule for values, as an expression."""
    return F.translate(F.lower(F.trim(F.replace(x, F.lit("﻿"), F.lit("")))), ACCENTED, PLAIN)


def loss(y_true: Column, y_pred: Column, kind: str = "squared_error") -> Column:
    error = y_true - y_pred
    if kind == "squared_error":
        return error * error
    if kind == "absolute_error":
        return F.abs(error)
    raise ValueError(f"unsupported loss: {kind}")


def skill(model: Column, baseline: Column) -> Column:
    """1 - model/baseline, NULL where that is not finite."""
    return F.lit(1.0) - F.try_divide(model, baseline)


def strict_skill(model: Column, baseline: Column) -> Column:
    """As :func:`skill`, but a baseline that is not positive is an error."""
    bad = F.raise_error(F.lit("the baseline error must be positive")).cast("double")
    return F.when(baseline > 0, F.lit(1.0) - F.try_divide(model, baseline)).otherwise(bad)


def skill_class(value: Column, band: float = 0.02) -> Column:
    return (
        F.when(value > band, F.lit("gain")).when(value < -band, F.lit("loss")).otherwise(F.lit("neutral"))
    )


def significance_class(p_value: Column, delta: Column, alpha: float = 0.05) -> Column:
    """Direction by the sign of the delta (0 where absent) and filled/open by p < alpha."""
    direction = F.when(F.coalesce(delta, F.lit(0.0)) >= 0, F.lit("gain")).otherwise(F.lit("loss"))
    return F.concat(direction, F.when(p_value < alpha, F.lit("_significant")).otherwise(F.lit("_open")))


def lead_steps(h: Column, stride: int) -> Column:
    """Lead time in forecast updates: ceil(h / stride)."""
    return F.ceil(h / F.lit(stride)).cast("int")


def overlap_bandwidth(h: Column, stride: int) -> Column:
    return F.greatest(F.lit(0), lead_steps(h, stride) - 1)


def automatic_bandwidth(n: Column) -> Column:
    return F.floor(F.lit(4.0) * F.pow(n / F.lit(100.0), F.lit(2.0 / 9.0))).cast("int")


def claim_status(expected: Column, found: Column, found_number: Column) -> Column:
    """Compare a claimed value (text) with a recomputed one.

    Numbers: equal → MATCH; within max(1, 1 %) → ROUNDING_MATCH; else MISMATCH. Otherwise text equality.
    """
    claimed = F.replace(expected, F.lit(","), F.lit("")).try_cast("double")
    gap = F.round(F.abs(claimed - found_number), 6)
    numeric = (
        F.when(gap == 0, F.lit("MATCH"))
        .when(gap <= F.greatest(F.lit(1.0), F.lit(0.01) * F.abs(claimed)), F.lit("ROUNDING_MATCH"))
        .otherwise(F.lit("MISMATCH"))
    )
    text = F.when(expected == found, F.lit("MATCH")).otherwise(F.lit("MISMATCH"))
    return (
        F.when(found.isNull(), F.lit("SOURCE_NOT_FOUND"))
        .when(claimed.isNotNull() & found_number.isNotNull(), numeric)
        .otherwise(text)
    )
