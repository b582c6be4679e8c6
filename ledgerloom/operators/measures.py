"""Measures that the training plan specifies: rewards, ranking, calibration, intervals by resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a unit of each cost takes off a reward.
COSTS = {"tokens": 0.00001, "tool_calls": 0.05, "wall_seconds": 0.001, "analysis_units": 0.02}


def reward(gain: Column, **costs: Column) -> Column:
    """Gain less normalised costs; a missing cost is none."""
    for name, amount in costs.items():
        gain = gain - F.coalesce(amount, F.lit(0)) * COSTS[name]
    return gain


def ranking(df: DataFrame, group: str, gain: str, order: list[Column], ndcg: int, recall: int) -> DataFrame:
    """(group, ndcgN, recallN, top1) of a ranking per group with 0/1 gains; 0 for a group without gains.

    Only the first ``max(ndcg, recall)`` ranks are kept (Spark cuts them before the shuffle); the ideal order needs
    no more than each group's sum of gains.
    """
    most = max(ndcg, recall)
    first = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= most)
    at = lambda k: F.sum(F.when(F.col("_r") <= k, F.col(gain) / F.log2(F.col("_r") + 1)))
    got = first.groupBy(group).agg(at(ndcg).alias("_dcg"), F.sum(F.when(F.col("_r") <= recall, F.col(gain))).alias("_hit"), F.max(F.when(F.col("_r") == 1, F.col(gain))).alias("top1"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_all"), F.lit(ndcg))), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    out = got.join(df.groupBy(group).agg(F.sum(gain).cast("int").alias("_all")), group)
    share = lambda x, y: F.round(F.when(F.col("_all") > 0, x / y).otherwise(0.0), 6)
    return out.select(group, share(F.col("_dcg"), ideal).alias(f"ndcg{ndcg}"), share(F.col("_hit"), F.col("_all")).alias(f"recall{recall}"), F.coalesce("top1", F.lit(0)).alias("top1"))


def calibration(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """One row: Brier score, expected calibration error over equal bins of [0, 1], and AUC (ties count half).

    The AUC comes from label counts per distinct score, in ranges of the score first, so no task orders all scores.
    """
    p, y = F.col(score), F.col(label)
    b = df.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.avg(p).alias("c"), F.avg(y).alias("f"))
    ece = b.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("f"))) / F.sum("n"), 6).alias("ece"))
    brier = df.agg(F.round(F.avg((p - y) * (p - y)), 6).alias("brier"))
    h = df.groupBy(F.floor(p * 1000).alias("_range"), p.alias("p")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = h.groupBy("_range").agg(F.sum("neg").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_far"))  # at most 1001 rows
    own = F.coalesce(F.sum("neg").over(Window.partitionBy("_range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = h.join(F.broadcast(ranges), "_range").withColumn("_below", F.col("_far") + own)
    auc = below.agg(F.round(F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))
    return brier.crossJoin(ece).crossJoin(auc)  # one row each


#: The cumulative Poisson distribution with mean 1.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)


def cluster_bootstrap(clusters: DataFrame, key: str, hits: str, size: str, replicates: int, low: int, high: int) -> DataFrame:
    """One row (low, high, rate, replicates): interval of a rate when whole clusters are resampled.

    A cluster's weight in a replicate is Poisson, told by a hash of cluster and replicate, so runs agree and replicates
    are one aggregation of one row per cluster. ``low`` and ``high`` are ranks among the replicates.
    """
    x = clusters.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.conv(F.left(F.sha2(F.concat(F.coalesce(F.col(key), F.lit("~")), F.lit("|"), F.col("b").cast("string")), 256), F.lit(8)), 16, 10).cast("bigint") / 4294967296.0
    m = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    rates = x.withColumn("_m", m).groupBy("b").agg((F.sum(F.col(hits) * F.col("_m")) / F.sum(F.col(size) * F.col("_m"))).alias("rate"))
    ranked = rates.withColumn("r", F.row_number().over(Window.orderBy("rate")))  # replicates
    at = lambda k, n: F.round(F.min(F.when(F.col("r") == k, F.col("rate"))), 6).alias(n)
    whole = clusters.agg(F.round(F.sum(hits) / F.sum(size), 6).alias("rate"))
    return ranked.agg(at(low, "low"), at(high, "high"), F.count("*").alias("replicates")).crossJoin(whole)  # one row each
