"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the source's cumulative tokens up to it, in shuffled order,
divided by the source's share. Taking documents in order of finish time keeps all sources at their shares at
every moment; the order is a global range sort, truncated at the total budget.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import keys as K
from ledgerloom.session import Scratch, parallelism

#: Buckets of the shuffled order within a source and round: a running sum per bucket plus offsets, so that a
#: source with a third of all documents is no single task.
BUCKETS = 256


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.select(K.lower_trim(F.col("source")).alias("source"), F.col("target_weight").alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r"))
    t = t.filter("source IS NOT NULL AND w > 0 AND NOT isnan(w)").groupBy("source").agg(F.sum("w").alias("w"), F.max("r").alias("repeats"))
    return t.withColumn("target_share", F.col("w") / F.sum("w").over(Window.partitionBy())).drop("w")  # one row per source


def _horizon(plan: list, budget: int) -> float:
    """A finish time by which the budget is certainly reached: each source has given its share less one document by
    then, or all it has. Infinite where the sources can't fill the budget."""
    given = lambda t: sum(min(p.tokens * p.repeats, max(0.0, p.share * t - p.longest)) for p in plan)
    if sum(p.tokens * p.repeats for p in plan) <= budget:
        return math.inf
    low, high = 0.0, float(budget + 1)
    while given(high) < budget:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if given(mid) >= budget else (mid, high)
    return high * (1 + 1e-9) + 1


def draw_mix(docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, copy, n_tokens, position) and its shares, from ``docs`` (doc_id, source, n_tokens).

    Sources agree without case and outer blanks. Shares are the targets' weights scaled to 1; sources without
    tokens can't be drawn, and the others keep their proportions. A source is used at most ``max_repeats`` times
    (null: once; 0: never), a further round only after all its documents. ``budget`` is in tokens; by default the
    most for which every source can still give its share. With a larger one, exhausted sources fall short, as the
    report shows. Documents without tokens, without a source or of a source without target are not drawn. Ties
    of the finish time go by source, round and document. Empty tables give an empty mix.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    docs = scratch.save(docs.select("doc_id", K.lower_trim(F.col("source")).alias("source"), F.col("n_tokens").cast("bigint").alias("n_tokens")), "docs")
    have = docs.filter("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("n_tokens").alias("longest"))
    plan = _targets(targets).join(have, "source", "full_outer")
    able = (F.col("target_share") > 0) & (F.col("tokens") > 0) & (F.col("repeats") > 0)
    plan = plan.withColumn("share", F.when(able, F.col("target_share")))
    plan = scratch.save(plan.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy())), "plan")  # sources
    if budget is None:
        budget = int(plan.agg(F.min(F.floor(F.col("tokens") * F.col("repeats") / F.col("share")))).head()[0] or 0)
    horizon = _horizon(plan.filter("share IS NOT NULL").collect(), budget)  # sources
    # no document that finishes later can be taken, nor any of a round that begins later
    rounds = F.least(F.col("repeats").cast("double"), F.ceil(F.lit(horizon) * F.col("share") / F.col("tokens")).cast("double") + 1) if horizon < math.inf else F.col("repeats")
    chosen = plan.filter("share IS NOT NULL").select("source", "share", rounds.cast("int").alias("repeats"))
    h = F.xxhash64(F.lit(seed), "doc_id", "copy")
    copies = docs.filter("n_tokens > 0").join(F.broadcast(chosen), "source")  # no more rows than targets
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).withColumn("h", h).withColumn("bucket", F.shiftright("h", 56) + 128)
    copies = copies.select("doc_id", "source", "copy", "n_tokens", "share", "h", "bucket")
    sums = copies.groupBy("source", "copy", "bucket").agg(F.sum("n_tokens").alias("s"))  # sources x rounds x buckets
    offsets = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("copy", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    own = F.sum("n_tokens").over(Window.partitionBy("source", "copy", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    timed = copies.withColumn("own", own).join(offsets, ["source", "copy", "bucket"])
    timed = timed.select("doc_id", "source", "copy", "n_tokens", ((F.col("before") + F.col("own")) / F.col("share")).alias("finish"), "h")
    timed = timed.filter(F.col("finish") <= horizon)
    order = ["finish", "source", "copy", "h", "doc_id"]
    ranged = timed.repartitionByRange(max(1, parallelism(spark)), *order).withColumn("part", F.spark_partition_id())
    ranged = scratch.save(ranged.sortWithinPartitions(*order), "ranged")
    parts = ranged.groupBy("part").agg(F.sum("n_tokens").alias("s"), F.count("*").alias("c"))  # one row per range
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("s").over(run), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("c").over(run), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("part").orderBy(*order)
    total = F.col("tokens_before") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    mix = ranged.join(F.broadcast(parts), "part").select("doc_id", "source", "copy", "n_tokens", total.alias("total"), (F.col("rows_before") + F.row_number().over(within)).alias("position"))
    mix = scratch.save(mix.filter(F.col("total") <= budget).drop("total"), "drawn")
    scratch.drop("docs", "ranged")
    got = mix.groupBy("source").agg(F.count("*").alias("draws"), F.sum("n_tokens").alias("drawn_tokens"), F.max("copy").alias("rounds"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    all_ = F.sum("drawn_tokens").over(Window.partitionBy())
    shares = plan.join(got, "source", "left").select("source", "target_share", F.col("share").alias("reachable_share"), "repeats", zero("documents"), zero("tokens"), zero("draws"), zero("rounds"), zero("drawn_tokens"), F.round(F.coalesce(F.col("drawn_tokens") / all_, F.lit(0.0)), 6).alias("actual_share"))
    return mix, shares
