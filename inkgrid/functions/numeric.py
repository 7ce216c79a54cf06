"""Scalar rules and measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calibration range, certainty and scale steps.
CALIBRATION = (0.30, 0.90)
CONFIDENCE_STEPS = (0.95, 0.85)
MARGIN_STEPS = (0.05, 0.02)
STROKE_STEPS = (2.2, 4.2)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def calibrated(score: Column) -> Column:
    low, high = CALIBRATION
    return clamp((score - low) / (high - low), 0, 1)


def region_confidence(recognised: Column, score: Column) -> Column:
    return F.least(recognised, calibrated(score))


def confidence_level(value: Column) -> Column:
    none, quiet = CONFIDENCE_STEPS
    return F.when(value.isNull() | (value >= none), "none").when(value >= quiet, "quiet").otherwise("warning")


def margin_level(value: Column) -> Column:
    sure, likely = MARGIN_STEPS
    return F.when(value.isNull(), "n/a").when(value >= sure, "certain").when(value >= likely, "likely").otherwise("uncertain")


def size_hint(size: Column, substitute_ratio: Column, true_ratio: Column) -> Column:
    """Size at which the true face looks as large; null if a ratio is not known."""
    return F.try_divide(size * substitute_ratio, true_ratio)


def scale_bucket(stroke: Column) -> Column:
    one, two = STROKE_STEPS
    return F.when(stroke.isNull() | (stroke < one), 1).when(stroke < two, 2).otherwise(3)


def nudged(offset: Column, by: Column, limit: float = 48.0) -> Column:
    return clamp(offset + by, -limit, limit)


def _linear(c: Column) -> Column:
    s = c / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * _linear(r) + 0.7152 * _linear(g) + 0.0722 * _linear(b)


def contrast_ratio(fg: list[Column], alpha: Column, bg: list[Column]) -> Column:
    """Contrast of a colour laid over an opaque ground, 3 digits."""
    over = [f * alpha + b * (1 - alpha) for f, b in zip(fg, bg, strict=True)]
    a, b = luminance(*over), luminance(*bg)
    return F.round((F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05), 3)


def psnr(mean_squared_error: Column) -> Column:
    """Decibels, 4 digits; null for identical images."""
    return F.round(F.when(mean_squared_error > 0, 10 * F.log10(F.lit(255.0**2) / mean_squared_error)), 4)


def bits_per_pixel(n_bytes: Column, width: Column, height: Column) -> Column:
    return F.try_divide(n_bytes * 8, width * height)


def seed_of(name: Column) -> Column:
    """Number from the first 8 hex digits of the SHA-256 of a name."""
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def relative_delta(value: Column, target: Column) -> Column:
    """|value - target| / target, null if either is missing or the target is 0."""
    return F.abs(value - target) / F.when(target != 0, target)


def fit_scale(width: Column, height: Column, view_width: Column, view_height: Column) -> Column:
    k = F.least(F.try_divide(view_width, width), F.try_divide(view_height, height))
    return F.when(k > 0, k).otherwise(1.0)


def ratio(num: Column, den: Column) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(num, den)


def f1(precision: Column, recall: Column) -> Column:
    """0 if either is 0 or missing."""
    return F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)).otherwise(0.0)
