"""Column functions shared by batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Africa/Johannesburg has no daylight saving time.
BUSINESS_OFFSET = "interval 2 hours"
OPEN_FROM, OPEN_TO = "1900-01-01 00:00:00", "9999-12-31 00:00:00"


def timestamp_ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def business_date(at: Column) -> Column:
    """The store's calendar day of a UTC time."""
    return (at + F.expr(BUSINESS_OFFSET)).cast("date")


def epoch_millis(at: Column) -> Column:
    """Milliseconds since 1970 of a zone-less UTC time."""
    return F.timestamp_diff("MILLISECOND", timestamp_ntz("1970-01-01 00:00:00"), at)


def from_millis(ms: Column) -> Column:
    """The zone-less UTC time of epoch milliseconds."""
    return F.timestamp_add("MILLISECOND", ms, timestamp_ntz("1970-01-01 00:00:00"))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, each cut to its second first."""
    return F.timestamp_diff("SECOND", F.date_trunc("second", a).cast("timestamp_ntz"), F.date_trunc("second", b).cast("timestamp_ntz"))


def rounded(x: Column, digits: int) -> Column:
    """Rounds half up in plain double arithmetic, so that every engine agrees."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b, null for a zero divisor."""
    return rounded(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), digits)


def surrogate_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("-", *(p.cast("string") for p in parts)))


def mask_email(email: Column) -> Column:
    """First character and domain."""
    return F.regexp_replace(email, r"^(.)[^@]*(@.*)$", r"$1***$2")


def mask_phone(phone: Column) -> Column:
    """First five and last two characters; shorter numbers, which those would show whole, are hidden."""
    return F.when(phone.isNull(), None).when(F.char_length(phone) > 7, F.concat(F.substring(phone, 1, 5), F.lit("*****"), F.right(phone, F.lit(2)))).otherwise(F.lit("*****"))


def partner_time(text: Column) -> Column:
    """A partner's local time in one of two formats as UTC; null for anything else."""
    iso = F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
    dmy = F.when(text.rlike(r"^\d\d/\d\d/\d{4} \d\d:\d\d$"), F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm")).cast("timestamp_ntz"))
    return F.coalesce(iso, dmy) - F.expr(BUSINESS_OFFSET)
