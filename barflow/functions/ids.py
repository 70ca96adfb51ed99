"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The DNS namespace of RFC 4122.
NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(namespace: str, *parts: Column) -> Column:
    """RFC 4122 version 5 UUID of ``parts`` joined by colons, within a namespace of 32 hex digits. Null if a part is null."""
    name = F.concat(*[c for i, p in enumerate(parts) for c in ([F.lit(":")] if i else []) + [p.cast("string")]])
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    # the variant nibble keeps its two low bits below the fixed 10
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def canonical_json(*fields: str) -> Column:
    """Compact JSON of the fields in name order; nulls are left out."""
    return F.to_json(F.struct(*sorted(fields)))
