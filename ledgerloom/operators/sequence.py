"""Operators over ordered events: chains, state machines, intervals, budgets, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Order values per bucket: a key with a third of all rows is ordered in pieces of this span.
SPAN = 50_000


def _bucketed(df: DataFrame, order: str, span: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(order) / span))


def positioned(df: DataFrame, keys: list[str], order: str, previous: dict[str, Column] | None = None, following: dict[str, Column] | None = None, span: int = SPAN) -> DataFrame:
    """With ``position`` (from 0) in the key's order, and values of the row before and after, by new name.

    Exactly what windows over the keys give, but no task orders a whole key: rows are ordered within buckets of
    the (numeric, unique) order column, and buckets are tied together by one row each. A null order comes first.
    """
    previous, following = previous or {}, following or {}
    df = _bucketed(df, order, span)
    for name, c in (previous | following).items():
        df = df.withColumn(f"_v_{name}", c)
    near = [F.count("*").alias("_n")]
    near += [F.max_by(f"_v_{n}", F.coalesce(order, F.lit(-(1 << 62)))).alias(f"_e_{n}") for n in previous]
    near += [F.min_by(f"_v_{n}", F.coalesce(order, F.lit(-(1 << 62)))).alias(f"_e_{n}") for n in following]
    w = Window.partitionBy(*keys).orderBy("_b")
    ties = df.groupBy(*keys, "_b").agg(*near)
    ties = ties.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_b").alias("_kb"), "_n",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        *(F.lag(f"_e_{n}").over(w).alias(f"_t_{n}") for n in previous), *(F.lead(f"_e_{n}").over(w).alias(f"_t_{n}") for n in following))
    same = F.col("_b").eqNullSafe(F.col("_kb"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    own = Window.partitionBy(*keys, "_b").orderBy(order)
    out = df.join(ties, same).withColumn("_r", F.row_number().over(own))
    for n in previous:
        out = out.withColumn(n, F.when(F.col("_r") == 1, F.col(f"_t_{n}")).otherwise(F.lag(f"_v_{n}").over(own)))
    for n in following:
        out = out.withColumn(n, F.when(F.col("_r") == F.col("_n"), F.col(f"_t_{n}")).otherwise(F.lead(f"_v_{n}").over(own)))
    out = out.withColumn("position", (F.col("_before") + F.col("_r") - 1).cast("bigint"))
    return out.drop("_b", "_kb", "_n", "_before", "_r", *(f"_k_{k}" for k in keys), *(f"{p}_{n}" for n in previous | following for p in ("_v", "_t")))


def chain(df: DataFrame, keys: list[str], order: str, record: Column, span: int = SPAN) -> DataFrame:
    """With ``position`` (from 0), ``event_sha`` of the record and ``previous_sha`` of the one before (null at 0)."""
    df = df.withColumn("event_sha", F.sha2(record, 256))
    return positioned(df, keys, order, previous={"previous_sha": F.col("event_sha")}, span=span)


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str, tie: str, span: int = 86_400_000_000) -> DataFrame:
    """(keys, start, end, n): overlapping or touching intervals merged; islands by the running greatest end.

    The running values go through buckets of ``span`` start units, tied together by one row per bucket.
    """
    w, own = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys, "_b").orderBy(start, tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = _bucketed(df, start, span)
    far = df.groupBy(*keys, "_b").agg(F.max(end).alias("_m")).withColumn("_far", F.max("_m").over(before)).drop("_m")
    reach = F.greatest("_far", F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.join(far, [*keys, "_b"]).withColumn("_reach", reach)
    df = df.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0))
    new = df.groupBy(*keys, "_b").agg(F.sum("_new").alias("_s")).withColumn("_islands", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    island = F.col("_islands") + F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))
    df = df.join(new, [*keys, "_b"]).withColumn("_island", island)
    return df.groupBy(*keys, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_island")


def ordered_codes(df: DataFrame, keys: list[str], order: str, code: Column) -> DataFrame:
    """(keys, codes): the codes of each short sequence joined in order; for state machines written as patterns."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, code.alias("_code")))), lambda x: x["_code"]), "").alias("codes"))


def greedy_pack(df: DataFrame, keys: list[str], order: str, size: str, budget: int) -> DataFrame:
    """(keys, order column, packed): items in order are taken while they fit; one that doesn't is skipped, not final.

    For groups that are bounded by their key (chunks of a case); the fold holds one group at a time.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("s"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("took"))
    fold = F.aggregate(items, start, lambda a, x: F.when(a["used"] + x["s"] <= budget, F.struct((a["used"] + x["s"]).alias("used"), F.array_append(a["took"], x["o"]).alias("took"))).otherwise(a))
    return df.groupBy(*keys).agg(fold.alias("p")).select(*keys, F.explode("p.took").alias(order))


def budgeted_replay(df: DataFrame, keys: list[str], order: str, terminal: Column, budget: int) -> DataFrame:
    """(keys, reads, outcome): events are read in order until a terminal one or until the budget is spent."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= budget).withColumn("_t", terminal)
    done = F.min(F.when(F.col("_t"), F.col("_n")))
    out = seen.groupBy(*keys).agg(F.coalesce(done, F.count("*")).cast("bigint").alias("reads"), done.alias("_done"), F.count("*").alias("_all"))
    outcome = F.when(F.col("_done").isNotNull(), "finish").when(F.col("_all") == budget, "budget_exhausted").otherwise("insufficient_material")
    return out.select(*keys, "reads", outcome.alias("outcome"))


def round_robin(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first of every group, then the second of every group, and so on; ``limit`` rows in all (a top-k).

    Ranks beyond the limit can't be among the first ``limit`` rows and are cut before the sort.
    """
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= limit).orderBy("rank", group).limit(limit)


def built_chain(df: DataFrame, keys: list[str], order: str, code: Column) -> DataFrame:
    """(keys, n, head): each short sequence as a hash chain; the head commits to all of it.

    Building is sequential, so the fold runs over one bounded sequence at a time (checking a chain is not: ``chain``).
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), code.alias("c"))))
    head = F.aggregate(items, F.lit(""), lambda a, x: F.sha2(F.concat(a, F.lit("|"), x["c"]), 256))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), head.alias("head"))


def evidence_update(**columns: Column) -> Column:
    """What a piece of evidence does to a hypothesis: support, counter, unknown (counts added, the last may be negative),
    status (set), revision (set where it was supported), terminal and reason. Missing: nothing."""
    kinds = {"support": "int", "counter": "int", "unknown": "int", "status": "string", "revision": "string", "terminal": "string", "reason": "string"}
    return F.struct(*(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))


def evidence_replay(df: DataFrame, keys: list[str], order: str, update: Column, budget: int, unknowns: int = 0) -> DataFrame:
    """(keys, reads, support, counter, unknowns, status, terminal, reason): each case's evidence read in order.

    The budget is tested before each read, so only the first ``budget`` rows of a case can be read; these are cut off
    before the shuffle and folded, a bounded array per case, whatever the length of its history. A terminal ends the
    reading. FINISH with an undecided hypothesis becomes UNRESOLVED; so does a case without terminal, by
    'budget_exhausted' or 'insufficient_material', and an unresolved case takes a decision back.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    first = df.withColumn("_u", update).withColumn("_r", rank).filter(F.col("_r") <= budget)
    steps = F.transform(F.array_sort(F.collect_list(F.struct("_r", "_u"))), lambda x: x["_u"])
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(0).alias("reads"), F.lit(0).alias("support"), F.lit(0).alias("counter"), F.lit(unknowns).alias("unknowns"), F.lit("open").alias("status"), none.alias("terminal"), none.alias("reason"))
    add = lambda s, n, d: (s[n] + F.coalesce(d, F.lit(0))).alias(n)

    def step(s: Column, u: Column) -> Column:
        decided = s["status"].isin("supported", "refuted")
        status = F.coalesce(u["status"], F.when(s["status"] == "supported", u["revision"]), s["status"])
        lost = (u["terminal"] == "FINISH") & ~decided
        terminal = F.when(lost, "UNRESOLVED").otherwise(u["terminal"])
        reason = F.when(lost, F.coalesce(u["reason"], F.lit("insufficient_material"))).otherwise(u["reason"])
        read = F.struct((s["reads"] + 1).alias("reads"), add(s, "support", u["support"]), add(s, "counter", u["counter"]), F.greatest(F.lit(0), s["unknowns"] + F.coalesce(u["unknown"], F.lit(0))).alias("unknowns"), status.alias("status"), terminal.alias("terminal"), reason.alias("reason"))
        return F.when(s["terminal"].isNotNull(), s).otherwise(read)

    out = first.groupBy(*keys).agg(F.aggregate(steps, start, step).alias("s")).select(*keys, "s.*")
    early = F.when(F.col("reads") == budget, "budget_exhausted").otherwise("insufficient_material")
    reason = F.when(F.col("terminal").isNull(), early).otherwise(F.col("reason"))
    status = F.when(F.col("terminal") == "FINISH", F.col("status")).otherwise("unresolved")
    return out.select(*keys, "reads", "support", "counter", "unknowns", status.alias("status"), F.coalesce("terminal", F.lit("UNRESOLVED")).alias("terminal"), reason.alias("reason"))


def level_digest(df: DataFrame, order: str, digest: str, levels: int, width: int = 512) -> DataFrame:
    """One row (digest): commitment to all rows in order of a number, by buckets of ``width`` numbers level by level.

    No task holds more than a bucket of one level; with enough levels that bounds it for any table.
    """
    line = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, digest))), lambda x: F.concat(x[order].cast("string"), F.lit("\n"), x[digest])), "\n")
    for _ in range(levels):
        df = df.groupBy(F.floor(F.col(order) / width).alias("_b")).agg(F.sha2(line(), 256).alias("_h")).select(F.col("_b").alias(order), F.col("_h").alias(digest))
    return df.agg(F.sha2(line(), 256).alias("digest"))


def exact_quantiles(df: DataFrame, group: str, value: str, ranks: dict[str, Column], span: float) -> DataFrame:
    """(group, names of ``ranks``): values at ranks (from 1; an expression of ``n``, the group's non-null values).

    Values are counted once each, ranks looked for in ranges of ``span`` first and then within the few ranges that hold
    one, so no task sorts a group. A rank between two numbers gives both neighbours' interpolation.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, F.floor(F.col(value) / span).alias("_b"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    own = Window.partitionBy(group, "_b").orderBy("_v")
    coarse = counts.groupBy(group, "_b").agg(F.sum("_c").alias("_s"))
    w = Window.partitionBy(group)
    coarse = coarse.select(F.col(group).alias("_g"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_s").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), "_s", F.sum("_s").over(w).alias("n"))
    ends = [f(r) for r in ranks.values() for f in (F.floor, F.ceil)]
    held = F.lit(False)
    for r in ends:
        held = held | ((r > F.col("_before")) & (r <= F.col("_before") + F.col("_s")))
    few = counts.join(coarse.filter(held), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_kb")))
    upto = F.col("_before") + F.sum("_c").over(own.rowsBetween(Window.unboundedPreceding, 0))
    few = few.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    at = lambda r: F.min(F.when((r > F.col("_from")) & (r <= F.col("_to")), F.col("_v")))
    cols = []
    for name, r in ranks.items():
        cols += [at(F.floor(r)).alias(f"_lo_{name}"), at(F.ceil(r)).alias(f"_hi_{name}"), F.max(r - F.floor(r)).alias(f"_f_{name}")]
    out = few.groupBy(group).agg(*cols)
    mixed = lambda n: (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
    return out.select(group, *map(mixed, ranks))
