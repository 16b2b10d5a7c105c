"""Epoch milliseconds and calendar strings in Korean time, and kinds of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Korean time has had this offset since 1988.
OFFSET, OFFSET_MILLIS = "+09:00", 32_400_000
SOURCE_TYPES = {"call": 0, "sms": 1, "mms": 2, "image": 3, "file": 4}
#: Prefixes of external ids. Images and files have names of their own here.
PREFIXES = {"call_": 0, "sms_": 1, "mms_": 2, "img_": 3, "document_": 4}
#: What filters may call them.
ALIASES = {**SOURCE_TYPES, "document": 4, "message": 1}


def to_millis(text: Column) -> Column:
    """YYYY-MM-DD, blank or T, HH:MM:SS to epoch milliseconds; 0 if malformed."""
    at = F.try_to_timestamp(F.concat(F.regexp_replace(text, "T", " "), F.lit(OFFSET)), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    return F.coalesce(F.unix_millis(at), F.lit(0).cast("long"))


def day_start(day: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(F.concat(day, F.lit(" 00:00:00" + OFFSET)), F.lit("yyyy-MM-dd HH:mm:ssXXX")))


def day_end(day: Column) -> Column:
    return day_start(day) + 86_399_999


def to_iso(millis: Column) -> Column:
    """Empty up to 0."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    local = F.timestamp_add("SECOND", F.floor((millis + OFFSET_MILLIS) / 1000), epoch)
    return F.when(millis > 0, F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(OFFSET))).otherwise("")


def source_type(external_id: Column) -> Column:
    """From the prefix of an external id; null if there is none."""
    out = F.lit(None).cast("short")
    for prefix, number in reversed(PREFIXES.items()):
        out = F.when(external_id.startswith(prefix), F.lit(number).cast("short")).otherwise(out)
    return out


def source_name(number: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, n in SOURCE_TYPES.items():
        out = F.when(number == n, name).otherwise(out)
    return out
