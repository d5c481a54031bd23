"""Scalar expressions: times in UTC, keys, URIs and URLs, Base64 and fingerprints, maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc(ts: Column) -> Column:
    """The UTC wall clock as timestamp_ntz, whatever zone the session has: a time without zone is UTC already."""
    seconds = (F.unix_micros(ts.cast("timestamp")) / 1_000_000).cast("decimal(18,6)")
    days = F.floor(seconds / 86400).cast("int")
    moved = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=days, secs=(seconds - days * 86400).cast("decimal(18,6)"))
    return F.when(F.typeof(ts) == "timestamp", moved).otherwise(ts.cast("timestamp_ntz"))


_ISO = r"\A\s*(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?))?\s*(Z|[+-]\d\d:?\d\d)?\s*\z"


def try_parse_iso(text: Column) -> Column:
    """ISO 8601 text as a UTC wall clock, null if it is none; text without a zone is UTC."""
    day, time, zone = (F.regexp_extract(text, _ISO, i) for i in (1, 2, 3))
    local = F.try_to_timestamp(F.concat(day, F.lit(" "), F.when(time == "", "00:00:00").when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time), F.lit(" +00:00")))
    digits = F.regexp_replace(zone, ":", "")
    minutes = F.when(F.length(digits) == 5, (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")) * F.when(F.startswith(digits, F.lit("-")), -1).otherwise(1)).otherwise(0)
    shifted = F.timestamp_micros(F.unix_micros(local) - minutes.cast("long") * 60_000_000)
    return F.when(F.rlike(text, F.lit(_ISO)), utc(shifted))


def parse_iso(text: Column) -> Column:
    """As try_parse_iso, but text that is no time is an error; null stays null."""
    got = try_parse_iso(text)
    return F.when(text.isNull() | got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit("not a time: "), text)).cast("timestamp_ntz"))


def uid_of_key(key: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(key, ":", 1)


def time_of_key(key: Column) -> Column:
    """What stands behind the first colon; null if there is none."""
    return F.when(F.contains(key, F.lit(":")), F.regexp_extract(key, r"(?s)\A[^:]*:(.*)\z", 1))


def unpadded(encoded: Column) -> Column:
    return F.rtrim(encoded, F.lit("="))


def fingerprint(key: Column) -> Column:
    """SHA256: and the Base64 of the key's digest without padding."""
    return F.concat(F.lit("SHA256:"), unpadded(F.base64(F.unhex(F.sha2(key, 256)))))


def try_base64(text: Column) -> Column:
    """The bytes, null if the text is no strict Base64."""
    strict = F.rlike(text, F.lit(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z"))
    return F.when(strict, F.try_to_binary(text, F.lit("base64")))


def prefix(text: Column) -> Column:
    """An object prefix: empty, or with one slash at its end."""
    return F.when((text == "") | F.endswith(text, F.lit("/")), text).otherwise(F.concat(text, F.lit("/")))


def is_s3(uri: Column) -> Column:
    return F.startswith(uri, F.lit("s3://"))


_OBJECT = r"\As3://([^/?#]+)/+([^?#]+)\z"


def s3_bucket(uri: Column) -> Column:
    """Null where the URI names no object, or has a query or fragment."""
    return F.nullif(F.regexp_extract(uri, _OBJECT, 1), F.lit(""))


def s3_key(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, _OBJECT, 2), F.lit(""))


def uid_of_url(url: Column) -> Column:
    """The last part of .../files/{uid}; null for other URLs."""
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), r"\A/+|/+\z", "")
    return F.nullif(F.regexp_extract(path, r"(?:\A|/)files/([^/]+)\z", 1), F.lit(""))


def with_created_at(url: Column, created_at: Column) -> Column:
    """The URL with created_at in its query, unless it is there."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    there = F.rlike(query, F.lit(r"(?:\A|&)created_at="))
    own = F.concat(F.lit("created_at="), F.url_encode(created_at))
    head, fragment = F.regexp_extract(url, r"\A([^#]*)", 1), F.regexp_extract(url, r"(#.*)?\z", 1)
    glue = F.when(F.endswith(head, F.lit("?")) | F.endswith(head, F.lit("&")), "").when(F.contains(head, F.lit("?")), "&").otherwise("?")
    return F.when(there, url).otherwise(F.concat(head, glue, own, fragment))


def not_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole microseconds apart, in seconds, on the UTC clock."""
    return F.timestamp_diff("MICROSECOND", utc(earlier), utc(later)) / 1_000_000


def time_left(due: Column, created: Column, days: Column, now: Column) -> Column:
    """Interval until the due date, or else until the end of standard retention; negative when it has passed."""
    end = F.coalesce(utc(due), utc(created) + F.make_dt_interval(days=days))
    return end - utc(now)


def entry(index: Column, key: Column) -> Column:
    """The map's value at the key, null if it has none."""
    return F.try_element_at(index, key)


def put(index: Column, key: Column, value: Column) -> Column:
    """The map with one entry set."""
    rest = F.map_filter(index, lambda k, _: k != key)
    return F.map_concat(rest, F.create_map(key, value))
