"""Times, rounding and other scalars of reports as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def iso(ts: Column) -> Column:
    """A timestamp (UTC) as 2024-01-01T00:00:00Z, to whole seconds; null stays null."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def within_days(ts: Column, days: int | None, now: Column) -> Column:
    """Whether a time is at most ``days`` before ``now``; always with None. A null time counts as 1970."""
    if days is None:
        return F.lit(True)
    if days < 0:
        raise ValueError("days is at least 0")
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.coalesce(seconds(ts), F.lit(0)) >= seconds(now) - days * 86_400_000_000


def relative(ts: Column, now: Column) -> Column:
    """How long ago a time was: minutes in the last hour, hours in the last day, days in the last
    week, else the date; a dash if it is null."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 1_000_000
    ago = lambda unit, mark: F.concat((age / unit).cast("int").cast("string"), F.lit(f"{mark} ago"))
    return F.when(ts.isNull(), "—").when(age < 3600, ago(60, "m")).when(age < 86400, ago(3600, "h")).when(age < 7 * 86400, ago(86400, "d")).otherwise(F.date_format(ts, "MMM d"))


def half_even(value: Column, digits: int) -> Column:
    """``value`` rounded by its exact binary value, ties to even (2.675 to 2.67)."""

    @F.pandas_udf(T.DoubleType())
    def rounded(v):
        import pandas as pd

        return pd.Series([None if x is None or x != x else round(x, digits) for x in v], dtype="float64")

    return rounded(value.cast("double"))
