"""Canonical JSON, content hashes and commitments, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(**fields: str | Column) -> Column:
    """Object text with keys in code point order, no blanks, nulls kept. Values: strings, integers, booleans."""
    cols = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in sorted(fields.items())]
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def commitment(**fields: str | Column) -> Column:
    """Content-derived identity of a record."""
    return digest(canonical_json(**fields))


def opaque_id(prefix: str, text: Column, size: int = 24) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(text, 256), F.lit(size)))


def list_digest(sorted_digests: Column) -> Column:
    """Commitment to a sorted array of digests."""
    return digest(F.array_join(sorted_digests, ","))
