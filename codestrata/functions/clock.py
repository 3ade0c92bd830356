"""Time expressions on zone-free UTC timestamps."""
from pyspark.sql import Column
from pyspark.sql import functions as F

PACIFIC = "America/Los_Angeles"


def pacific_day(ts: Column) -> Column:
    """Calendar day in the Pacific zone of a UTC wall-clock timestamp (TIMESTAMP_NTZ)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(PACIFIC), ts))


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a UTC wall-clock timestamp, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def pacific_reset_seconds(ts: Column) -> Column:
    """Whole seconds, rounded up and at least one, to the next Pacific midnight; daylight saving included."""
    next_day = F.date_add(pacific_day(ts), 1).cast("timestamp_ntz")
    reset = F.convert_timezone(F.lit(PACIFIC), F.lit("UTC"), next_day)
    return F.greatest(F.lit(1), F.ceil(seconds_between(ts, reset))).cast("long")


def utc_reset_seconds(ts: Column) -> Column:
    reset = F.date_add(F.to_date(ts), 1).cast("timestamp_ntz")
    return F.greatest(F.lit(1.0), seconds_between(ts, reset))


def retry_after_seconds(header: Column, now: Column) -> Column:
    """Seconds asked for by a retry header (a number or an HTTP date), clamped to one day; 60 when unreadable."""
    number = F.trim(header).rlike(r"^\d+(\.\d+)?$")
    seconds = F.trim(header).try_cast("double")
    moment = F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT", 1),
                                F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")
    wait = F.when(number, F.coalesce(seconds, F.lit(86400.0))).otherwise(seconds_between(now, moment))
    return F.when(wait.isNull(), F.lit(60.0)).otherwise(F.least(F.lit(86400.0), F.greatest(F.lit(1.0), wait)))
