"""Time windows and calendars. A window is (start, end) in the type of the table's time column."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRANULARITIES = ("day", "week", "month")


def checked_days(days: int) -> int:
    if not 1 <= int(days) <= 365:
        raise ValueError("a window has 1 to 365 days")
    return int(days)


def checked_limit(limit: int, most: int = 500) -> int:
    return max(1, min(int(limit), most))


def inclusive_end(end: datetime | None) -> datetime | None:
    """A midnight end stands for the whole day."""
    if end is not None and (end.hour, end.minute, end.second, end.microsecond) == (0, 0, 0, 0):
        return end + timedelta(days=1, microseconds=-1)
    return end


def to_utc(said: str | datetime | None, now: datetime | None = None) -> datetime | None:
    """now, today, 'N days ago' or an ISO time, as UTC; None for what can't be read. now is a parameter, for reruns."""
    if said is None or isinstance(said, datetime):
        return said if said is None or said.tzinfo else said.replace(tzinfo=UTC)
    text = said.strip().lower()
    now = now or datetime.now(UTC)
    if text in ("", "now"):
        return now
    if text == "today":
        return now.replace(hour=0, minute=0, second=0, microsecond=0)
    if m := re.fullmatch(r"(\d+)\s+(minute|hour|day|week)s?\s+ago", text):
        return now - timedelta(**{m[2] + "s": int(m[1])})
    try:
        found = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", said.strip()))
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


def bucket(time: Column, granularity: str = "day") -> Column:
    """The first date of the day, Monday week or month."""
    day = F.to_date(time)
    if granularity == "day":
        return day
    if granularity == "week":
        return F.date_sub(day, F.weekday(day))
    if granularity == "month":
        return F.trunc(day, "month")
    raise ValueError(f"granularity must be one of {GRANULARITIES}")


def newest(df: DataFrame, column: str = "fetch_ts") -> Column:
    """The newest time of a table as a literal, null for an empty one. It is looked up now, so that filters by it reach the scan and prune days."""
    found = df.agg(F.max(column).cast("string")).first()[0]
    return F.lit(found).cast(df.schema[column].dataType)


def tail(df: DataFrame, days: int, column: str = "fetch_ts", end: Column | None = None) -> DataFrame:
    """Rows of the last days before the corpus's newest time (end, if it is known), ends included."""
    end = newest(df, column) if end is None else end
    return pruned(df, end - F.expr(f"interval {checked_days(days)} days"), end, column)


def calendar(df: DataFrame, days: int, column: str = "fetch_ts", granularity: str = "day", end: Column | None = None) -> DataFrame:
    """Every bucket of the tail window, in column bucket; none for an empty table."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[granularity]
    end = newest(df, column) if end is None else end
    first = bucket(end - F.expr(f"interval {checked_days(days)} days"), granularity)
    return df.sparkSession.range(1).select(F.explode(F.sequence(first, bucket(end, granularity), F.expr(step))).alias("bucket"))


def pruned(df: DataFrame, start: Column | None, end: Column | None, column: str = "fetch_ts") -> DataFrame:
    """A time filter that also prunes day partitions, where the table has fetch_day."""
    for edge, op in ((start, "ge"), (end, "le")):
        if edge is not None:
            df = df.filter(F.col(column) >= edge if op == "ge" else F.col(column) <= edge)
            if "fetch_day" in df.columns and column == "fetch_ts":
                df = df.filter(F.col("fetch_day") >= F.to_date(edge) if op == "ge" else F.col("fetch_day") <= F.to_date(edge))
    return df
