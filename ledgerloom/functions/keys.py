"""Canonical forms of registry identifiers, as Catalyst expressions (no Python per row).

Every function takes and returns a Column; null in gives null out, and so does a value that names nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width ASCII block U+FF01..U+FF5E folds to ASCII by its fixed offset; the rest are blanks and hyphens.
_WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F)) + "　    " + "‐‑‒–—―−"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " " * 5 + "-" * 7
#: Characters without width; translate() drops what has no counterpart.
_ZERO = "​‌‍⁠﻿­"
#: Spellings that stand for "no value" in revision columns.
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "nil", "none", "null", "pending", "tba", "tbd", "todo", "unknown", "unset", "xxx", "missing", "not available", "to be determined"]


def fold(c: Column) -> Column:
    """Lower case, one width, no zero-width characters, no outer blanks."""
    narrow = F.when(c.rlike(r"^[ -~]*$"), c).otherwise(F.translate(c, _WIDE + _ZERO, _NARROW))  # ASCII skips the map
    return F.lower(F.regexp_replace(narrow, r"^\s+|\s+$", ""))


def _plain(c: Column, rx: str, plain: Column, other: Column) -> Column:
    """Most values are written plainly: one pattern tells, and only the rest go through ``other``."""
    return F.when(c.rlike(rx), plain).otherwise(other)


def pair_key(c: Column) -> Column:
    """``round:number`` of a pair id, whatever the case, separators and leading zeros; else null."""
    rx = r"^r0*(\d+)[\s_\-.]*pair[\s_\-.]*0*(\d+)$"
    s = fold(c)
    return _plain(c, r"^r0?[1-9]-pair-\d{8}$", F.regexp_replace(c, r"^r0?([1-9])-pair-0*(\d+)$", "$1:$2"), F.when(s.rlike(rx), F.regexp_replace(s, rx, "$1:$2")))


def family_key(c: Column) -> Column:
    """``owner/name`` of a project family.

    Case, width, blanks, the kind of separator and what stands around owner/name (scheme, host, ``.git``,
    slashes) don't matter. Null or blank names no family.
    """
    s = F.regexp_replace(fold(c), r"\\", "/")
    s = F.regexp_replace(s, r"\s*/\s*", "/")
    s = F.regexp_replace(s, r"^(?:[a-z+]+:/+)?(?:[^/@]*@)?|[?#].*$", "")
    s = F.regexp_replace(s, r"^([a-z0-9\-]+(?:\.[a-z0-9\-]+)+):(?:\d+/)?", "$1/")
    s = F.regexp_replace(s, r"/{2,}", "/")
    s = F.regexp_replace(s, r"^/+|(?:\.git)?/*$", "")
    s = F.regexp_replace(s, r"^[^/]*\.[^/]*/([^/]+/[^/]+)(?:/.*)?$", "$1")
    s = F.regexp_replace(s, r"[\s_\-.]+", "-")
    return _plain(c, r"^[a-z0-9]+(?:-[a-z0-9]+)*/[a-z0-9]+(?:-[a-z0-9]+)*$", c, F.when(F.length(s) > 0, s))


def locator_key(c: Column) -> Column:
    """``host/owner/name`` that a locator leads to; null where it doesn't name all three."""
    s = F.regexp_replace(F.regexp_replace(fold(c), r"\s+", ""), r"\\", "/")
    s = F.regexp_replace(s, r"^[a-z+]+:/+|[?#].*$", "")
    s = F.regexp_replace(s, r"^(?:[^/@]*@)?(?:www\.)?", "")
    s = F.regexp_replace(s, r"^([^/:]+):(?:\d+(?=/))?", "$1/")
    s = F.regexp_replace(s, r"/{2,}", "/")
    rx = r"^([^/]+)/([^/]+)/([^/]+?)(?:\.git)?(?:/.*)?$"
    return _plain(c, r"^https://(?!www\.)[a-z0-9.\-]+/[a-z0-9\-]+/[a-z0-9\-]+$", F.substr(c, F.lit(9)), F.when(s.rlike(rx), F.regexp_replace(s, rx, "$1/$2/$3")))


def revision_core(c: Column) -> Column:
    """The commit that a revision writes, without its wrapping (quotes, prefixes, peel marks, commit URL,
    describe form) and in lower case; null where it is absent (null, blank, placeholder)."""
    s = F.regexp_replace(fold(c), r"""^['"`\s]+|['"`\s]+$""", "")
    u = F.regexp_replace(s, r"(?:\^\{[a-z]*\}|\^0|~0)$|[?#].*$", "")
    u = F.regexp_replace(u, r"^.*/(?=[0-9a-z]{8,}/?$)", "")
    u = F.regexp_replace(u, r"^(?:commit|rev|revision|git|sha|sha1|hg)[:\s@]+|/+$", "")
    u = F.regexp_replace(u, r"^.*-\d+-g(?=[0-9a-z]{8,}$)", "")
    # no commit: a placeholder, zeros only, or a word (no digit, and letters beyond a to f)
    named = ~s.isin(PLACEHOLDERS) & ~u.isin(PLACEHOLDERS) & ~u.rlike(r"^[0\s\-]*$|^[^0-9]*[^0-9a-f][^0-9]*$")
    return _plain(c, r"^(?=.*[1-9a-f])[0-9a-f]{8,}$", c, F.when(named, u))


def split_key(c: Column) -> Column:
    """Split name without case and outer blanks; null for blank."""
    s = fold(c)
    return F.when(F.length(s) > 0, s)


def case_key(c: Column) -> Column:
    """Catalog case id without case and outer blanks; null for blank."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(F.length(s) > 0, s)


def lower_trim(c: Column) -> Column:
    """Source name without case and outer blanks; null for blank."""
    return case_key(c)


def agree(a: Column, b: Column) -> Column:
    """Two revision cores write the same commit: equal, or one abbreviates the other to at least 8 characters."""
    short = F.least(F.length(a), F.length(b))
    return F.coalesce((a == b) | ((short >= 8) & (F.left(a, short) == F.left(b, short))), F.lit(False))


def mistyped(a: Column, b: Column, full: int = 36, edits: int = 2) -> Column:
    """Two cores written in full that don't agree are at most ``edits`` edits apart (banded DP in the JVM)."""
    return F.coalesce((F.length(a) >= full) & (F.length(b) >= full) & ~agree(a, b) & (F.levenshtein(a, b, edits) >= 0), F.lit(False))


def same_change(anchor_a, buggy_a, fixed_a, anchor_b, buggy_b, fixed_b) -> Column:
    """Both revisions agree; or the anchors agree, one revision agrees and the other is mistyped or absent."""
    ab, af = agree(buggy_a, buggy_b), agree(fixed_a, fixed_b)
    anchor = F.coalesce(anchor_a == anchor_b, F.lit(False))
    loose = lambda x, y: x.isNull() | y.isNull() | mistyped(x, y)
    return (ab & af) | (anchor & ((ab & loose(fixed_a, fixed_b)) | (af & loose(buggy_a, buggy_b))))
