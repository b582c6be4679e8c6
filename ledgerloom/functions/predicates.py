"""Row contracts as boolean Catalyst expressions; null counts as failing unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path parts of low priority, and protected hash shapes.
LOW_PARTS = ("test", "tests", "example", "examples", "doc", "docs")


def matches(c: Column, pattern: str) -> Column:
    """The whole value matches (both ends anchored)."""
    return F.coalesce(c.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def canonical_path(c: Column) -> Column:
    """Relative POSIX path that is already canonical: it is rejected otherwise, never normalised."""
    bad = c.rlike(r"[\\:\x00-\x1f\x7f]|//|^/|/$|(?:^|/)\.{1,2}(?:/|$)")
    return F.coalesce((F.length(c) > 0) & ~bad, F.lit(False))


def low_priority(c: Column) -> Column:
    """Some part of the path is test, example or documentation; no path: no."""
    return F.coalesce(F.arrays_overlap(F.split(F.lower(c), "/"), F.array(*map(F.lit, LOW_PARTS))), F.lit(False))


def opaque(c: Column) -> Column:
    """An id that doesn't give away a public advisory."""
    return F.coalesce(~F.lower(c).rlike(r"^(?:cve|ghsa)-"), F.lit(False))


def generic_basis(c: Column, markers: tuple[str, ...]) -> Column:
    """A stated basis that says nothing: null, blank or holding a marker."""
    return F.coalesce(F.trim(c) == "", F.lit(True)) | F.lower(c).rlike("|".join(markers))


def failing(**checks: Column) -> Column:
    """Names of the checks that fail, in the order given, joined by ';' ('' when all hold)."""
    return F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()))), ";")


def head_tail(c: Column, limit: int, marker: str) -> Column:
    """Text cut to ``limit`` characters, keeping head and tail around ``marker``."""
    room = limit - len(marker)
    if limit <= 0:
        return F.when(c.isNotNull(), F.lit(""))
    if room < 0:
        return F.when(F.length(c) <= limit, c).when(c.isNotNull(), F.lit(marker[:limit]))
    head, tail = (room + 1) // 2, room // 2
    end = F.right(c, F.lit(tail)) if tail else F.lit("")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(marker), end))


def redacted_url(c: Column) -> Column:
    """URL without user information, query and fragment."""
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^([a-z+]+://)[^/@]*@", "$1")
