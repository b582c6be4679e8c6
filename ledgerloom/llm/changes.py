"""Edit-distance segment join of change records (anchor, buggy revision, fixed revision).

Two records state the same change when both revisions agree, or when the anchors agree, one revision agrees
and the other is absent on a side or a mistyped copy (at most ``EDITS`` edits). See ``functions.keys.same_change``.

The join cuts one side's revision into ``EDITS + 1`` segments and matches the other side's substrings at the
positions the pigeonhole principle allows (PassJoin's multi-match-aware windows), then verifies with banded
dynamic programming. Agreement is the case of no edits: one segment, the 8-character prefix that every
abbreviation keeps. Every key also holds the revision that must agree and the anchor, so rows that share a hot
anchor or a hot revision but contradict each other never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.session import remembered

EDITS = 2
FULL = 36
PREFIX = 8


def canonical(df: DataFrame, id_col: str, anchor: Column, buggy: str, fixed: str, *extra: Column) -> DataFrame:
    """(id, a, b, f, extra): canonical anchor and revision cores; other columns, whatever their names, are left out."""
    return df.select(F.col(id_col).alias("id"), anchor.alias("a"), K.revision_core(F.col(buggy)).alias("b"), K.revision_core(F.col(fixed)).alias("f"), *extra)


@remembered
def can_match(a: str = "a", b: str = "b", f: str = "f") -> Column:
    """A row can state the same change as another only with both revisions, or with the anchor and one of them."""
    return (F.col(b).isNotNull() & F.col(f).isNotNull()) | (F.col(a).isNotNull() & F.coalesce(F.col(b), F.col(f)).isNotNull())


def _key(kind: int, *parts: Column) -> Column:
    """A 64-bit key, null when a part is. Collisions cost a verification, never a wrong pair."""
    ok = parts[0].isNotNull()
    for p in parts[1:]:
        ok = ok & p.isNotNull()
    return F.when(ok, F.xxhash64(F.lit(kind), *parts))


@remembered
def signature() -> Column:
    """Minwise signature of the record as a set of up to three tokens (anchor, buggy prefix, fixed prefix): their hashes.

    The hash family ranks tokens by kind first and hash second, with the kinds in each of three rotations, so three
    tokens are the whole signature and nothing is left to chance.
    """
    tokens = (F.col("a"), F.left("b", F.lit(PREFIX)), F.left("f", F.lit(PREFIX)))
    return F.array(*(F.when(t.isNotNull(), F.xxhash64(F.lit(i), t)) for i, t in enumerate(tokens)))


@remembered
def band_keys() -> Column:
    """Of column ``sig``, one band per rotation of the kinds: the two least tokens of the signature, hashed. Records that state the same
    change share two tokens, which are the two least under some rotation, so they share a key."""
    bands, sig = [], F.col("sig")
    for r in range(3):
        least = F.array_compact(F.array(*(sig[(r + i) % 3] for i in range(3))))
        bands.append(F.when(F.size(least) >= 2, F.xxhash64(F.least(least[0], least[1]), F.greatest(least[0], least[1]))))
    return F.array_distinct(F.array_compact(F.array(*bands)))


def _windows() -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings that must be tried."""
    out = []
    for d in range(-EDITS, EDITS + 1):
        for i in range(EDITS + 1):
            lo, hi = max(-i, d - (EDITS - i)), min(i, d + (EDITS - i))
            out += [(d, i, s) for s in range(lo, hi + 1)]
    return out


SIDES = ((0, "b", "f"), (1, "f", "b"))


@remembered
def _segment_steps(places: tuple[tuple[int, int, int], ...]) -> tuple[Column, ...]:
    at = F.expr("explode(array(" + ", ".join(f"named_struct('s', {s}, 'd', {d}, 'i', {i}, 't', {t})" for s, _, _ in SIDES for d, i, t in places) + "))").alias("x")
    base = F.expr(f"xxhash64(x.s, a, left(if(x.s = 0, b, f), {PREFIX})) AS base")
    cut = f"floor(n / {EDITS + 1})"
    longer = f"({EDITS + 1} - n % {EDITS + 1})"  # segments from this one on are a character longer
    start = F.expr(f"i * {cut} + greatest(0, i - {longer}) + t AS start")
    return at, base, F.expr("if(x.s = 0, f, b) AS r"), start, F.expr(f"{cut} + int(i >= {longer}) AS size"), F.expr("xxhash64(40, base, n, i, substring(r, int(start + 1), int(size))) AS k")


def _segment_keys(rows: DataFrame, places: list[tuple[int, int, int]], *keep: str) -> DataFrame:
    """(k, keep) of the segments or substrings at ``places`` of each row's revision in full, for either revision
    as the mistyped one: its key holds the anchor, the other revision, the cut string's length and the segment."""
    at, base, r, start, size, k = _segment_steps(tuple(places))
    x = rows.filter("a IS NOT NULL AND b IS NOT NULL AND f IS NOT NULL").select("*", at)
    x = x.select(*keep, base, r, "x").filter(f"length(r) >= {FULL}").selectExpr(*keep, "base", "r", "length(r) - x.d AS n", "x.i AS i", "x.t AS t")
    x = x.select("*", start, size).filter(f"n >= {FULL} AND start >= 0 AND start + size <= length(r)")
    return x.select(k, *keep)


@remembered
def _plain(absent: int, present: int) -> Column:
    out = [_key(10, F.left("b", F.lit(PREFIX)), F.left("f", F.lit(PREFIX)))]
    for s, same, other in SIDES:
        g = F.left(same, F.lit(PREFIX))
        out.append(F.when(F.col(other).isNull(), _key(absent + s, F.col("a"), g)))
        out.append(_key(present + s, F.col("a"), g) if absent > present else F.when(F.col(other).isNotNull(), _key(present + s, F.col("a"), g)))
    return F.explode(F.array_compact(F.array(*out))).alias("k")


def _plain_keys(rows: DataFrame, absent: int, present: int, *keep: str) -> DataFrame:
    """(k, keep) for agreement of both revisions, and of one where the other is absent on this side or the other."""
    return rows.select(_plain(absent, present), *keep)


def cut_keys(rows: DataFrame, *keep: str) -> DataFrame:
    """Keys of the side that is cut into segments."""
    return _plain_keys(rows, 20, 30, *keep).union(_segment_keys(rows, [(0, i, 0) for i in range(EDITS + 1)], *keep))


def window_keys(rows: DataFrame, *keep: str) -> DataFrame:
    """Keys of the side whose substrings are matched at the allowed positions."""
    return _plain_keys(rows, 30, 20, *keep).union(_segment_keys(rows, _windows(), *keep))


@remembered
def _states_the_same() -> Column:
    return K.same_change(*(F.col(f"{side}.{c}") for side in "cw" for c in "abf"))


def verified_pairs(cut: DataFrame, windowed: DataFrame, also: str = "true", within: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """(cut_id, windowed_id, within, and of either side keep) of rows that state the same change, each pair once.

    Both sides have (id, a, b, f), ids being unique on a side, and the columns ``within``, in which a pair must agree.
    ``also`` is a further condition on ``cut_id`` and ``windowed_id``; ``keep`` names columns of the rows that come along
    as ``cut_`` and ``windowed_``. A pair is only made for an equal key; AQE splits hot keys. Keys travel with the id
    alone; the rows are joined to the few candidates and verified there.
    """
    c = cut_keys(cut, "id", *within).withColumnRenamed("id", "cut_id")
    w = window_keys(windowed, "id", *within).withColumnRenamed("id", "windowed_id")
    pairs = c.join(w, ["k", *within]).filter(also).select("cut_id", "windowed_id", *within).distinct()
    row = ", ".join(("a", "b", "f", *keep))
    pairs = pairs.join(cut.selectExpr("id AS cut_id", f"struct({row}) AS c"), "cut_id").join(windowed.selectExpr("id AS windowed_id", f"struct({row}) AS w"), "windowed_id")
    return pairs.filter(_states_the_same()).select("cut_id", "windowed_id", *within, *(F.col(f"{side}.{c}").alias(f"{name}_{c}") for c in keep for side, name in (("c", "cut"), ("w", "windowed"))))
