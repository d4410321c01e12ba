"""Date parsing and null-default casts (T10-T12) as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Social-media date: "Mon Dec 30 14:24:08 +0000 2024". The weekday is cut off (Spark refuses pattern
# letter E for parsing) and the offset text is dropped so the wall clock is kept, not converted.
SOCIAL_RE = r"^\s*[A-Za-z]{3} ([A-Za-z]{3}) +(\d{1,2}) (\d{1,2}:\d{2}:\d{2}) [+-]\d{4} (\d{4})\s*$"
DAY_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
OUT_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_social_date(c) -> Column:
    """Parse the social-media format to TIMESTAMP_NTZ keeping the wall clock; failure -> null."""
    c = _col(c)
    norm = F.concat_ws(" ", F.regexp_extract(c, SOCIAL_RE, 1), F.regexp_extract(c, SOCIAL_RE, 2),
                       F.regexp_extract(c, SOCIAL_RE, 3), F.regexp_extract(c, SOCIAL_RE, 4))
    ts = F.try_to_timestamp(norm, F.lit("MMM d H:mm:ss yyyy"))
    return F.when(c.rlike(SOCIAL_RE), ts.cast("timestamp_ntz"))


def parse_created_at(c) -> Column:
    """T10, import path: social-media format, else ``yyyy-MM-dd HH:mm:ss``, else null."""
    c = _col(c)
    iso = F.try_to_timestamp(F.trim(c), F.lit(OUT_FORMAT)).cast("timestamp_ntz")
    return F.coalesce(parse_social_date(c), iso)


def format_created_at(c) -> Column:
    """Store path of T10: strings holding a day name are parsed and re-formatted; others pass through."""
    c = _col(c)
    has_day = F.lit(False)
    for d in DAY_NAMES:
        has_day = has_day | F.contains(c, F.lit(d))
    return F.when(has_day, F.date_format(parse_social_date(c), OUT_FORMAT)).otherwise(c)


def likes_to_int(c) -> Column:
    """Text or number to INT via double (so '12.0' works); null, blank or junk -> 0."""
    return F.coalesce(F.expr(f"try_cast(try_cast({_sql(c)} as double) as int)"), F.lit(0))


def _sql(c) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("pass a column name")
