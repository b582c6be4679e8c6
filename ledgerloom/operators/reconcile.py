"""Reconciliation of requested items with results, inventories and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_by_left_join(requested: DataFrame, results: DataFrame, key: str, status: Column, gap: str = "gap") -> DataFrame:
    """Each requested row with ``status``; ``gap`` where there is no result. ``results`` are made distinct by key."""
    have = results.select(key).distinct().withColumn("_has", F.lit(True))
    out = requested.join(have, key, "left")
    return out.withColumn("status", F.when(F.col("_has").isNull(), F.lit(gap)).otherwise(status)).drop("_has")


def inventory_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) of keys that were created, deleted or modified; equal nulls are no change."""
    j = before.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")).join(after.select(key, F.col(value).alias("_b"), F.lit(1).alias("_y")), key, "full_outer")
    change = F.when(F.col("_x").isNull(), "created").when(F.col("_y").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return j.select(key, change.alias("change")).filter("change IS NOT NULL")


def precedence_union(base: DataFrame, increment: DataFrame, key: str) -> DataFrame:
    """Rows of ``base``, and those of ``increment`` whose key base hasn't; ``origin`` tells which."""
    extra = increment.join(base.select(key).distinct(), key, "left_anti")
    return base.withColumn("origin", F.lit("base")).unionByName(extra.withColumn("origin", F.lit("increment")))


def multiplicity(items: DataFrame, references: DataFrame, key: str, ref: str) -> DataFrame:
    """How often each item is referred to; 0 for none. References are counted before they are joined."""
    n = references.groupBy(F.col(ref).alias(key)).agg(F.count("*").alias("n_refs"))
    return items.join(n, key, "left").withColumn("n_refs", F.coalesce("n_refs", F.lit(0)))


def set_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in a, only in b, in both; distinct keys, nulls left out."""
    x = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer").filter(F.col(key).isNotNull())
    return x.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("in_both"))
