"""Column expressions: rounding, angles, costs, string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_dead(v: Column, places: int, zero: float) -> Column:
    """Rounded away from zero at ties; nothing within the dead zone."""
    return F.when(F.abs(v) < zero, 0.0).otherwise(F.signum(v) * F.round(F.abs(v), places))


def rounded(v: Column | str, places: int) -> Column:
    """A double to the nearest number of units (half a unit goes away from zero), as SQL engines count them; Spark's own round looks at the number's shortest decimal form."""
    units = 10.0**places
    return F.round((F.col(v) if isinstance(v, str) else v) * units) / units


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def direction_angle(dx: Column, dy: Column) -> Column:
    """Angle of a vector in image axes, 0 to 2 pi; null for no length."""
    n = F.sqrt(dx * dx + dy * dy)
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dx / F.nullif(n, F.lit(0.0)))))
    return F.when(n > 0, F.when(dy <= 0, turn).otherwise(2 * F.pi() - turn))


def similarity_cost(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.nullif(a + b, F.lit(0.0))


def replace_range_value(v: Column, low: float, high: float, new: float) -> Column:
    return F.when((v >= low) & (v < high), new).otherwise(v)


def replace_nonfinite(v: Column, new: float) -> Column:
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), new).otherwise(v)


def count_occurrences(text: Column, sub: Column) -> Column:
    """Occurrences that don't overlap; none for an empty pattern."""
    return F.when(F.length(sub) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, sub, F.lit("")))) / F.length(sub)).cast("int"))


def time_cost(day0: Column, day1: Column) -> Column:
    """0 for one date apart, towards 1 for more and for none; 100 for a later source."""
    gap = day1 - day0
    return F.when(gap < 0, 100.0).otherwise(1 - 1 / (1.0 + F.abs(gap - 1)))


def orientation_cost(vx: Column, vy: Column, ex: Column, ey: Column) -> Column:
    """Squared half of 1 minus the cosine of two vectors; null if one has no length."""
    norm = F.sqrt(vx * vx + vy * vy) * F.sqrt(ex * ex + ey * ey)
    return F.pow((1 - (vx * ex + vy * ey) / F.nullif(norm, F.lit(0.0))) / 2, F.lit(2))


def connectivity_cost(path: Column) -> Column:
    """By the number of components between the ends; 100 for a path without two ends."""
    between = F.size(path) - 2
    return F.when(between < 0, 100.0).otherwise(1 - 1 / (1.0 + F.abs(between)))


def mad_cost(value: Column, median: Column, low: Column, high: Column, alpha: float = 1.0, eps: float = 1e-6) -> Column:
    """1 - exp(-n alpha / 2) for the number n of scaled deviations on the value's side."""
    side = F.when(value < median, median - low).otherwise(high - median)
    return 1 - F.exp(-F.abs(value - median) / (1.4826 * (side + eps)) * alpha / 2)


def speed_colour(speed: Column, fastest: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(50 + 205 * speed / fastest))).cast("int")


def anomaly_code(reason: Column) -> Column:
    """Initials of a reason's words, in upper case."""
    return F.upper(F.array_join(F.transform(F.split(reason, "_"), lambda w: F.substring(w, 1, 1)), ""))
