"""Scalar functions on columns: URLs, words, ids, times and delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds in a month of 30 days, the unit of relative times.
MONTH = 2592000
#: Fixed value: the ASCII punctuation that word splitting replaces by spaces.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def url_user(url: Column) -> Column:
    """The host-like part of a URL, lower-cased and at most 100 characters; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^https?://+([^/?]*\w+[^/?]*)", 1)
    return F.nullif(F.substring(found, 1, 100), F.lit(""))


def truncated_url(url: Column) -> Column:
    """URLs of over 100 characters keep their first and last 50."""
    return F.when(F.length(url) > 100, F.concat(F.left(url, F.lit(50)), F.right(url, F.lit(50)))).otherwise(url)


def words(text: Column) -> Column:
    """Lower-cased words, with punctuation as space."""
    spaced = F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))
    return F.filter(F.split(F.lower(spaced), r"\s+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if one is empty."""
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def padded_id(number: Column) -> Column:
    """A numeric id as 24 digits."""
    return F.lpad(number.cast("string"), 24, "0")


def utc_time(text: Column, pattern: str, zone: str = "Asia/Tehran") -> Column:
    """A local time text as a timestamp in UTC."""
    return F.to_utc_timestamp(F.to_timestamp(text, pattern), zone)


def recipients(header: Column) -> Column:
    """Addresses of a mail header."""
    return F.split(F.regexp_replace(header, r"[\n\t ]", ""), ",")


def is_number(text: Column) -> Column:
    """ASCII or Persian digits only."""
    return text.rlike("^[0-9۰-۹]+$")


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time with or without a zone; the library keeps its sessions in UTC."""
    return F.unix_micros(time.cast("timestamp"))


def months_between(later: Column, earlier: Column) -> Column:
    """Time from earlier to later in months of 30 days."""
    return (micros(later) - micros(earlier)) / F.lit(1e6) / F.lit(MONTH)


def delay(rate: Column) -> Column:
    """Months until a receiver acts: 1/rate, at most 24; 24 where the rate is not positive."""
    return F.when(rate > 0, F.least(1 / rate, F.lit(24.0))).otherwise(24.0)


def received(sent: Column, rate: Column) -> Column:
    """When a receiver acts on what was sent."""
    return F.timestamp_micros(micros(sent) + F.round(delay(rate) * MONTH * 1000000).cast("long"))


def guarded(dt: Column, least: float = 1 / 43200) -> Column:
    """A time difference that is never 0."""
    return F.when(dt == 0, least).otherwise(dt)


def observation_text(obs: Column) -> Column:
    """An array of booleans as a text of 0 and 1."""
    return F.array_join(F.transform(obs, lambda x: x.cast("int").cast("string")), "")
