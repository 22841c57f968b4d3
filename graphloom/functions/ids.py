"""Deterministic identifiers: version-5 UUIDs as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the namespaces and the separator that identifiers are derived from
PARSE_NAMESPACE = "6f6b6bd0-6b8e-4e7a-9e3b-9a6f7f6e0b3f"
EDGE_NAMESPACE = "2f7b6a3e-8c1d-4b5a-9e2f-6a1d3c8b7e4f"
SEPARATOR = "\x1f"


def as_text(part: Column) -> Column:
    """A part as it is hashed; a missing one is the word None."""
    return F.coalesce(part.cast("string"), F.lit("None"))


def uuid5(namespace: str, *parts: Column) -> Column:
    """uuid5 of the parts joined by the separator."""
    name = F.concat_ws(SEPARATOR, *[as_text(p) for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    # the variant: two high bits of the ninth byte become 10
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 19, 2)), F.substring(digest, 21, 12))
