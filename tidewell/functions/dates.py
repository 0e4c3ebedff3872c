"""Dates of posts: everything is read as a date at UTC+8; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = "+08:00"


def epoch_date(value: Column) -> Column:
    """The first ten digits as seconds."""
    seconds = F.substring(value.cast("string"), 1, 10).try_cast("bigint")
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), OFFSET))


def iso_date(value: Column) -> Column:
    """ISO 8601; with an offset it is moved to UTC+8, without one the date stays. The session's time zone is UTC."""
    aware = value.rlike(r"[T ]\d\d:\d\d.*(Z|[+-]\d\d:?\d\d)$")
    moved = F.to_date(F.from_utc_timestamp(F.try_to_timestamp(value), OFFSET))
    return F.when(aware, moved).otherwise(calendar_date(value))


def calendar_date(value: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(value, r"^(20\d\d-\d\d-\d\d)", 1), F.lit("")), "yyyy-MM-dd")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def relative_date(value: Column, today: Column) -> Column:
    """In this order: year-month-day (an invalid one is null), month-day (of the year before where it would be more
    than a week ahead), words for days, and so many days ago."""
    full, part, ago = r"(20\d\d)\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})", r"(\d{1,2})\s*[-/.月]\s*(\d{1,2})", r"(\d+)\s*天前"
    got = lambda pattern, k: F.regexp_extract(value, pattern, k)
    short = _date(F.year(today), got(part, 1), got(part, 2))
    earlier = _date(F.year(today) - 1, got(part, 1), got(part, 2))
    return (
        F.when(value.rlike(full), _date(got(full, 1), got(full, 2), got(full, 3)))
        .when(value.rlike(part), F.when(short > F.date_add(today, 7), earlier).otherwise(short))
        .when(value.contains("前天"), F.date_sub(today, 2))
        .when(value.contains("昨天"), F.date_sub(today, 1))
        .when(value.rlike("今天|刚刚|分钟前|小时前"), today)
        .when(value.rlike(ago), F.date_sub(today, got(ago, 1).try_cast("int")))
    )


def in_period(date: Column, first: Column, last: Column) -> Column:
    return F.coalesce(date.between(first, last), F.lit(False))


#: Variants of ISO 8601 and the common order of day and month, tried in this order.
FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "MM/dd/yyyy")


def date_of(value: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The date by the first format that fits the whole value; null if none does."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(value), F.lit(f))) for f in formats])


def today(now: Column | None = None) -> Column:
    """Today at UTC+8; `now` is a timestamp (UTC), the current one by default."""
    return F.to_date(F.from_utc_timestamp(F.current_timestamp() if now is None else now, OFFSET))


def scan_start(first: Column, last: Column, least: int = 14, most: int = 30) -> Column:
    """Where a run starts to look: before the period if that is short, never more than `most` days back."""
    return F.greatest(F.least(first, F.date_sub(last, least)), F.date_sub(last, most))
