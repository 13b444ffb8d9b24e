"""Derived ids and deterministic sampling."""

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the namespace of ids that follow from other ids.
NAMESPACE = "6f1d3c2a-5b7e-4c1d-9a8f-2e4b6c8d0a1f"


def derived(*parts: Column) -> Column:
    """Id that follows from other ids, so that work done again gives the same one."""
    return uuid5(NAMESPACE, F.concat_ws("/", *parts))


def derived_hex(prefix: str, *parts: Column) -> Column:
    """`derived` without hyphens, after a prefix."""
    return F.concat(F.lit(prefix), F.replace(derived(*parts), F.lit("-"), F.lit("")))


def uuid5(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a name in a namespace."""
    h = F.sha1(F.concat(F.lit(uuid.UUID(namespace).bytes), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def uuid7_millis(text: Column) -> Column:
    """Unix milliseconds in a version-7 UUID."""
    return F.conv(F.substring(F.regexp_replace(text, "-", ""), 1, 12), 16, 10).cast("long")


def hash_fraction(text: Column) -> Column:
    """First eight bytes of SHA-256 as a share of 2^64."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def sample_slot(text: Column) -> Column:
    """Slot 0 to 9,999 of an id."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 10_000


def in_sample(text: Column, rate: float) -> Column:
    return sample_slot(text) < round(rate * 10_000)


def short_hash(prefix: str, text: Column, size: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, size))
