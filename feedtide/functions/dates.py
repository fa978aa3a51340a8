"""Feed date strings to timestamps and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 822 date forms once the weekday is stripped and the zone is an offset.
RFC822_FORMATS = (
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm Z",
    "d MMM yy HH:mm:ss Z",
    "d MMM yy HH:mm Z",
)

# RFC 822 zone names. They are plain offsets, without daylight rules.
RFC822_ZONES = {
    "UT": "+0000",
    "UTC": "+0000",
    "GMT": "+0000",
    "Z": "+0000",
    "EST": "-0500",
    "EDT": "-0400",
    "CST": "-0600",
    "CDT": "-0500",
    "MST": "-0700",
    "MDT": "-0600",
    "PST": "-0800",
    "PDT": "-0700",
}


def feed_time(value: Column) -> Column:
    """Timestamp of an RFC 822 or ISO 8601 date string; null when neither form fits."""
    text = F.trim(value)
    bare = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    zones = F.create_map(*[F.lit(part) for pair in RFC822_ZONES.items() for part in pair])
    offset = F.try_element_at(zones, F.upper(F.regexp_extract(bare, r"([A-Za-z]+)$", 1)))
    numeric = F.when(offset.isNull(), bare).otherwise(F.concat(F.regexp_replace(bare, r"[A-Za-z]+$", ""), offset))
    looks_iso = text.rlike(r"^\d{4}-\d{2}-\d{2}")
    return F.when(looks_iso, F.try_to_timestamp(text)).otherwise(
        F.coalesce(*[F.try_to_timestamp(numeric, F.lit(pattern)) for pattern in RFC822_FORMATS])
    )


def iso_utc(ts: Column) -> Column:
    """Millisecond ISO 8601 form in UTC, whatever the session zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
