"""Name-based identities (UUID version 5) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"(?i)^(?:urn:uuid:)?\{?([0-9a-f]{8})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{4})-([0-9a-f]{12})\}?$|^([0-9a-f]{32})$"


def is_uuid(text: Column) -> Column:
    """Whether a text is a UUID: with hyphens (bare, in braces or as a URN) or 32 hexadecimal digits."""
    return F.coalesce(text.rlike(_DIGITS), F.lit(False))


def named_uuid(namespace: Column, name: Column) -> Column:
    """The version 5 UUID of a name in UTF-8 below a namespace UUID."""
    digits = F.unhex(F.regexp_replace(F.regexp_replace(namespace, "(?i)^urn:uuid:", ""), "[{}-]", ""))
    digest = F.sha1(F.concat(digits, F.encode(name, "UTF-8")))

    def parts(h: Column) -> Column:
        part = lambda at, n: F.substring(h, at, n)
        variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))

    # the digest is bound to a name, so that it is made once and not for each part
    return F.get(F.transform(F.array(digest), parts), F.lit(0))


def identity(namespace: Column, text: Column) -> Column:
    """``text`` if it is a UUID, else the UUID that it names below ``namespace``."""
    return F.when(is_uuid(text), text).otherwise(named_uuid(namespace, text))
