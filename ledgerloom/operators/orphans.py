"""References to records that do not exist: missing, deleted or not there yet.

Parents are range-partitioned by key and stored sorted; batches of references probe their range by vectorised
binary search. A range with many references (a hot key) is cut into chunks, each with a copy of the range's
parents, so no task grows with one key's references.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import Scratch

#: Parents of a range, references of a chunk: what one task holds at once. Neither drops a row. Up to CASES ranges are
#: found by nested CASE expressions, more by a vectorised search; there is no greatest number of ranges.
PER_RANGE, PER_CHUNK, CASES = 200_000, 200_000, 1024
FOREVER = (1 << 63) - 1
OUT = "ref_id bigint, ref_column string, reason string, at timestamp"


def _short(key: Column) -> Column:
    """Keys of bounded width: a longer one is replaced by its SHA-256."""
    return F.when(F.octet_length(key) > 64, F.sha2(key, 256)).otherwise(key)


def _range_of(key: Column, lows: list[str]) -> Column:
    """Index of the last lower bound at or below ``key``; keys below all bounds are in the first range."""
    if len(lows) > CASES:
        bounds = np.array([b.encode() for b in lows], dtype=object)  # a bound per PER_RANGE parents

        @F.pandas_udf("int")
        def found(keys: pd.Series) -> pd.Series:
            return pd.Series(np.maximum(np.searchsorted(bounds, np.array([k.encode() for k in keys], dtype=object), "right") - 1, 0).astype("int32"))

        return found(key)

    def search(a: int, b: int) -> Column:
        if b - a == 1:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(key >= F.lit(lows[m]), search(m, b)).otherwise(search(a, m))

    return search(0, len(lows)) if lows else F.lit(0)


def _last_at_or_before(starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each probe, how many of ``starts[lo:hi]`` (sorted) are at or before ``at``: all probes halve together."""
    a, b = lo.copy(), hi.copy()
    while (open_ := a < b).any():
        mid = (a + b) // 2
        right = open_ & (starts[np.minimum(mid, len(starts) - 1)] <= at)
        a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
    return a - lo


def _probe(refs: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
    if refs.empty:
        return pd.DataFrame({"ref_id": pd.Series(dtype="int64"), "ref_column": pd.Series(dtype=str), "reason": pd.Series(dtype=str), "at": pd.Series(dtype="datetime64[ns]")})
    have, want = (np.array([k.encode() + b"." for k in t["key"]], dtype=bytes) for t in (parents, refs))  # as wide as the longest key; numpy cuts trailing zero bytes
    starts, ends = parents["begins"].to_numpy("int64"), parents["ends"].to_numpy("int64")
    order = np.lexsort((starts, have))
    have, starts, ends = have[order], starts[order], ends[order]
    new = np.r_[True, have[1:] != have[:-1]] if len(have) else np.empty(0, bool)
    group = np.cumsum(new)
    latest = pd.Series(ends).groupby(group).cummax().to_numpy() if len(have) else ends
    lo, hi = np.searchsorted(have, want, "left"), np.searchsorted(have, want, "right")
    at = refs["micros"].to_numpy("int64")
    begun = _last_at_or_before(starts, lo, hi, at) if len(have) else np.zeros(len(want), "int64")
    live = begun > 0
    live[live] = latest[(lo + begun - 1)[live]] > at[live]
    reason = np.where(lo == hi, "missing", np.where(begun > 0, "deleted", "late"))
    out = refs[["ref_id", "ref_column", "at"]].assign(reason=reason)[~live]
    return out[["ref_id", "ref_column", "reason", "at"]]


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_id, ref_column, reason, at) of references without a live parent.

    ``refs`` has (ref_id, ref_column, key, at), ``parents`` (ref_column, key, begins, ends): a parent is live from
    ``begins`` (inclusive) to ``ends`` (exclusive; null: for ever). A null key is no reference, a null ``begins``
    no parent's beginning (the key exists but never lives). A null ``at`` comes before all times. Repeated rows
    are reported each. No parents: every reference is missing.
    """
    scratch = Scratch(refs.sparkSession, "orphans")
    tagged = F.concat_ws("|", "ref_column", _short(F.col("key")))
    micros = lambda c, none: F.coalesce(F.unix_micros(F.col(c)), F.lit(none))
    parents = parents.filter("key IS NOT NULL").select(tagged.alias("key"), micros("begins", FOREVER).alias("begins"), micros("ends", FOREVER).alias("ends"))
    # rows that never end say no more than the earliest of them, nor do repeated beginnings
    parents = parents.groupBy("key", F.when(F.col("ends") < FOREVER, F.col("begins")).alias("closed")).agg(F.min("begins").alias("begins"), F.max("ends").alias("ends")).drop("closed")
    parents = scratch.save(parents, "parents")
    n = max(1, math.ceil(parents.count() / PER_RANGE))
    parents = scratch.save(parents.repartitionByRange(n, "key").sortWithinPartitions("key", "begins").withColumn("slot", F.spark_partition_id()), "ranges")
    lows = sorted(r.low for r in parents.groupBy("slot").agg(F.min("key").alias("low")).collect())  # a row per PER_RANGE parents
    refs = refs.filter("key IS NOT NULL").select("ref_id", "ref_column", tagged.alias("key"), "at", micros("at", -FOREVER).alias("micros"))
    refs = refs.withColumn("slot", _range_of(F.col("key"), lows))
    parents = parents.withColumn("slot", _range_of(F.col("key"), lows))
    chunks = {r.slot: math.ceil(r["count"] / PER_CHUNK) for r in refs.groupBy("slot").count().collect()}  # a row per range
    hot = {s: c for s, c in chunks.items() if c > 1}
    pieces = F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps({str(s): c for s, c in hot.items()})), "map<string,int>"), F.col("slot").cast("string")), F.lit(1)) if hot else F.lit(1)
    refs = refs.withColumn("chunk", F.pmod(F.xxhash64("ref_id", "ref_column"), pieces).cast("int"))
    parents = parents.select("key", "begins", "ends", "slot", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("chunk"))
    return refs.groupBy("slot", "chunk").cogroup(parents.groupBy("slot", "chunk")).applyInPandas(lambda r, p: _probe(r, p), OUT)


def orphan_report(orphans: DataFrame, table: str) -> DataFrame:
    """Counts per table, reference column, month and reason; orphans without a time have a null month."""
    month = F.date_format("at", "yyyy-MM")
    return orphans.groupBy(F.lit(table).alias("table_name"), "ref_column", month.alias("month"), "reason").agg(F.count("*").alias("n"))
