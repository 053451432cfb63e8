"""Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; null where the denominator is zero or null."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 UTC; zone-less times are meant as UTC (so must be the session's zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def millis(ts: Column) -> Column:
    """Milliseconds since 1970-01-01 UTC, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 (`…T…Z`) or SQL (`yyyy-MM-dd HH:mm:ss[.SSS]`) text to a timestamp; null if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", ""))


def payload_fields(payload: Column, **fields: str) -> Column:
    """The named JSON fields as one struct, each cast to the given type (null if it can't be)."""
    parsed = F.from_json(payload, ", ".join(f"`{name}` string" for name in fields))
    return F.struct(*(parsed[name].try_cast(kind).alias(name) for name, kind in fields.items()))


def promoted(column: Column, payload: Column, name: str, kind: str) -> Column:
    """A promoted column, filled from the payload where it is empty; the JSON is read only there."""
    found = F.when(payload.contains(f'"{name}"'), F.get_json_object(payload, f"$.{name}").try_cast(kind))
    return F.coalesce(column, found)


def uuid_bytes(text: Column) -> Column:
    """The 16 bytes of an identifier however it is written.

    Case, blanks, braces, hyphens and the `urn:uuid:` prefix don't count. Null and
    blank give null. Text that isn't a UUID gives the MD5 of its trimmed lower-case
    form, so that it is compared as it stands. The patterns run only on such text.
    """
    bare = F.translate(F.replace(F.lower(text), F.lit("urn:uuid:"), F.lit("")), "-{}() \t\r\n", "")
    plain = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.coalesce(F.when(F.length(bare) == 32, F.unhex(bare)), F.when(F.length(plain) > 0, F.unhex(F.md5(plain))))


def canonical_uuid(text: Column) -> Column:
    """``uuid_bytes`` as 32 lower-case hex digits."""
    return F.lower(F.hex(uuid_bytes(text)))


def event_type_name(text: Column) -> Column:
    """Type names in one spelling: lower case, words joined by `_`; null and blank are `unknown`."""
    name = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_")
    return F.when(text.isNull() | name.isin("", "_"), F.lit("unknown")).otherwise(name)
