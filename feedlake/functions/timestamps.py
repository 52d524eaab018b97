"""Timestamps as text and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedlake.functions.text import _col


def parse_iso(c: Column | str, on_error: Column | None = None) -> Column:
    """ISO-8601 text, with ``Z`` or an offset or neither; null or ``on_error`` where it does not parse."""
    parsed = F.try_to_timestamp(_col(c))
    return parsed if on_error is None else F.coalesce(parsed, on_error)


def iso_text(c: Column | str) -> Column:
    """ISO-8601 text; fractional seconds only where there are some."""
    c = _col(c)
    fraction = F.date_format(c, ".SSSSSS")
    return F.concat(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == ".000000", F.lit("")).otherwise(fraction),
    )


def is_aware(df: DataFrame, name: str) -> bool:
    """True for instants; a timestamp without zone, or text, carries none of its own."""
    return isinstance(df.schema[name].dataType, T.TimestampType)


def utc_wall(df: DataFrame, name: str) -> Column:
    """The UTC wall clock of a column, as the session shows it, whatever the session's zone.

    A timestamp without zone is taken as UTC. Text is parsed, null where it does not parse.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.col(name).cast("timestamp")
    instant = F.try_to_timestamp(F.col(name)) if isinstance(kind, T.StringType) else F.col(name).cast("timestamp")
    return in_utc(instant)


def in_utc(instant: Column) -> Column:
    return F.to_utc_timestamp(instant, F.current_timezone())


def rfc822(c: Column | str) -> Column:
    return F.date_format(_col(c), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def micros(c: Column | str) -> Column:
    return F.unix_micros(_col(c).cast("timestamp"))
