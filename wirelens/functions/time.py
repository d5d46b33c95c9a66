"""Event-time expressions. Zone-less timestamps are taken as UTC."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp column, with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def parse_event_ts(text: Column) -> Column:
    """ISO-8601 text to epoch microseconds; null or invalid text gives 0."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)), F.lit(0).cast("long"))


def instant(df: DataFrame, column: str, as_of: datetime, back: timedelta = timedelta(0)) -> Column:
    """``as_of - back`` as a literal of the column's own type, so the comparison reaches the scan."""
    return F.lit(as_of - back).cast(df.schema[column].dataType)


def iso_utc(ts: Column) -> Column:
    """UTC second string, the form in which queue and lesson times are stored and compared."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
