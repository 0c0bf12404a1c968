"""Durations and step intervals."""

from pyspark.sql import Column, functions as F


def duration_text(seconds: Column) -> Column:
    """``XhMMm``, ``XmSSs`` or ``Xs``; ``unknown`` when null or not positive."""
    whole = F.floor(seconds).cast("bigint")
    hours = F.floor(whole / 3600).cast("bigint")
    minutes = F.floor(whole % 3600 / 60).cast("bigint")
    rest = whole % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(seconds.isNull() | (seconds <= 0), F.lit("unknown"))
        .when(hours > 0, F.concat(hours.cast("string"), F.lit("h"), two(minutes), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"), two(rest), F.lit("s")))
        .otherwise(F.concat(rest.cast("string"), F.lit("s")))
    )


def interval_value(text: Column) -> Column:
    """A step interval given as text; anything but a positive integer means disabled (0)."""
    number = F.trim(text.cast("string")).try_cast("bigint")
    return F.greatest(F.coalesce(number, F.lit(0)), F.lit(0)).cast("bigint")


def next_step(step: Column, interval: Column, max_steps: Column) -> Column:
    """Next multiple of ``interval`` after ``step``; null when disabled or past the end."""
    safe = F.when(interval > 0, interval)
    following = (F.floor(step / safe) + 1).cast("bigint") * safe
    return F.when((interval > 0) & (step < max_steps) & (following <= max_steps), following)
