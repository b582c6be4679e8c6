"""Splits that keep linked records together.

Records are linked by shared keys (family, pair). Keys are the nodes of a graph, records its edges. Borůvka-style
contraction: every component picks its least edge, the picks are contracted by pointer jumping, and the edges
picked form a persisted spanning forest. Components are then dealt to splits by size band.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import keys as K
from ledgerloom.session import Scratch

PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def spanning_forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v: strings); the forest's edges are appended to ``forest``.

    Rounds are logarithmic in the largest component; each reads and writes tables in the shared folder. Self
    loops and repeated edges are ignored; the root is the least node of a round's mutual pair.
    """
    weight = F.xxhash64(F.least("u", "v"), F.greatest("u", "v")).alias("w")  # random order keeps the picked paths short
    live = scratch.save(edges.filter("u <> v").select(F.col("u").alias("cu"), F.col("v").alias("cv"), F.struct(weight, F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).alias("e")), "edges-0")
    labels, k = live.select(F.col("cu").alias("node")).union(live.select("cv")).distinct().withColumn("root", F.col("node")), 0
    while not live.isEmpty():
        k += 1
        ends = live.union(live.select("cv", "cu", "e"))
        picks = scratch.save(ends.groupBy("cu").agg(F.min(F.struct("e", "cv")).alias("p")).select(F.col("cu").alias("c"), F.col("p.cv").alias("to"), "p.e"), f"picks-{k}")
        scratch.append(picks.select("e.lo", "e.hi").distinct(), "forest")
        back = picks.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = picks.join(back, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up"))
        j = 0
        while True:  # pointer jumping: path lengths halve
            up = scratch.save(up, f"up-{k}-{j}")
            jumped = up.join(up.select(F.col("c").alias("up"), F.col("up").alias("up2")), "up")
            if jumped.filter("up <> up2").isEmpty():
                break
            up, j = jumped.select("c", F.col("up2").alias("up")), j + 1
        of = lambda name: up.select(F.col("c").alias(name), F.col("up").alias(f"{name}2"))  # noqa: E731, B023
        moved = live.join(of("cu"), "cu").join(of("cv"), "cv").filter("cu2 <> cv2")
        moved = moved.select(F.least("cu2", "cv2").alias("cu"), F.greatest("cu2", "cv2").alias("cv"), "e")
        live = scratch.save(moved.groupBy("cu", "cv").agg(F.min("e").alias("e")), f"edges-{k}")
        labels = scratch.save(labels.join(up.select(F.col("c").alias("root"), F.col("up").alias("root2")), "root", "left").select("node", F.coalesce("root2", "root").alias("root")), f"labels-{k}")
    return labels


def linked_groups(df: DataFrame, id_col="record_id", family="project_family", pair="pair_id", split_col="split", forest: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, node, split) and nodes (node, root, rows, lo, hi): the linked group of a row is its node's root.

    ``lo`` and ``hi`` are the least and greatest present split of the node's rows (null: none). Null or blank
    keys link nothing; a row without keys is its own group. Repeated rows belong to the same group. The spanning
    forest (lo, hi), edges between families and pairs, is kept in the folder ``forest`` if one is given.
    """
    scratch = Scratch(df.sparkSession, "groups")
    key = lambda mark, c: F.concat(F.lit(mark), c)
    rows = df.select(F.col(id_col).alias("id"), key("f:", K.family_key(F.col(family))).alias("f"), key("p:", K.pair_key(F.col(pair))).alias("p"), K.split_key(F.col(split_col)).alias("split"))
    rows = scratch.save(rows, "rows")
    # a pair of one family hangs on its only edge; only pairs of several families need the contraction
    pairs = scratch.save(rows.filter("f IS NOT NULL AND p IS NOT NULL").groupBy("p").agg(F.min("f").alias("f1"), F.max("f").alias("f2")), "pairs")
    scratch.append(pairs.filter("f1 = f2").select(F.col("f1").alias("lo"), F.col("p").alias("hi")), "forest")
    core = rows.filter("f IS NOT NULL").join(pairs.filter("f1 <> f2").select("p"), "p", "left_semi").select(F.col("p").alias("u"), F.col("f").alias("v")).distinct()
    labels = spanning_forest(core, scratch)
    lone = rows.filter("f IS NULL AND p IS NOT NULL").join(pairs.select("p", "f1"), "p", "left")
    keyless = rows.filter("f IS NULL AND p IS NULL")
    node = lambda r, c: r.select("id", c.alias("node"), "split")
    rows = node(rows.filter("f IS NOT NULL"), F.col("f")).union(node(lone, F.coalesce("f1", "p")))
    rows = rows.union(node(keyless, F.concat(F.lit("r:"), F.col("id").cast("string"))))
    nodes = rows.groupBy("node").agg(F.count("*").alias("rows"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    nodes = nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rows", "lo", "hi")
    nodes = scratch.save(nodes, "nodes")
    if forest:
        df.sparkSession.read.schema("lo string, hi string").parquet(scratch.path("forest")).write.mode("overwrite").parquet(forest)
    return rows, nodes


def forest_groups(forest: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of a persisted forest: groups can be told again, or joined by new edges, without the rows."""
    return spanning_forest(forest.select(F.col("lo").alias("u"), F.col("hi").alias("v")), scratch)


def broken_groups(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id) of all rows of groups whose rows have more than one distinct split."""
    bad = nodes.groupBy("root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
    return rows.join(nodes.join(bad, "root", "left_semi").select("node"), "node", "left_semi").select("id")


#: Groups of more than this part of all rows are dealt one by one, so there are at most as many of them; the rest is
#: dealt along so many rounds through the splits.
LARGE, ROUNDS = 2000, 64


def _greedy(large: list, wanted: dict[str, float]) -> tuple[list[tuple[str, str]], dict[str, float]]:
    """Largest group first, to the split that lacks the most rows; and what the splits still lack."""
    left, out = dict(wanted), []
    for r in large:
        split = max(left, key=lambda s: left[s])
        out.append((r.root, split))
        left[split] -= r.rows
    return out, {s: max(0.0, x) for s, x in left.items()}


def deal(nodes: DataFrame, proportions=PROPORTIONS, buckets: int = 256) -> DataFrame:
    """(node, root, dealt): groups are dealt to splits, one split per group, so that the splits' rows have the proportions.

    Groups are stratified by size band (powers of two), ordered within a band by a hash of the root and dealt
    systematically along their running number of rows, as far as the large groups, which are dealt first and one by one,
    have left room in each split. Running sums are by bucket with offsets, so no task orders a whole band. A group
    larger than a split makes that split's share unreachable; it goes where most rows are lacking.
    """
    spark = nodes.sparkSession
    roots = nodes.groupBy("root").agg(F.sum("rows").alias("rows"))
    total = roots.agg(F.sum("rows")).head()[0] or 0
    whole = sum(p for _, p in proportions)
    large = roots.filter(F.col("rows") * LARGE > total).orderBy(F.desc("rows"), "root").collect()  # fewer than LARGE
    fixed, left = _greedy(large, {s: total * p / whole for s, p in proportions})
    rest = sum(left.values())
    shares = [(s, left[s] / rest if rest else p / whole) for s, p in proportions]
    small = roots.filter(F.col("rows") * LARGE <= total).select("root", "rows", F.floor(F.log2("rows")).cast("int").alias("band"), F.xxhash64("root").alias("h"))
    small = small.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    sizes = small.groupBy("band", "bucket").agg(F.sum("rows").alias("n"))  # at most 64 bands times buckets
    order = Window.orderBy(F.desc("band"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("band", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    own = F.sum("rows").over(Window.partitionBy("band", "bucket").orderBy("h", "root").rowsBetween(Window.unboundedPreceding, 0))
    count = max(1, total - sum(r.rows for r in large))
    x = (F.col("before") + own - F.col("rows") / 2) * F.lit(ROUNDS / count)
    small = small.join(F.broadcast(offsets), ["band", "bucket"]).withColumn("x", x - F.floor(x))
    name, upto = F.lit(shares[-1][0]), 1.0
    for (split, _), (_, share) in zip(reversed(shares[:-1]), reversed(shares)):
        upto -= share
        name = F.when(F.col("x") < upto, F.lit(split)).otherwise(name)
    dealt = small.select("root", name.alias("dealt")).union(spark.createDataFrame(fixed, "root string, dealt string"))
    return nodes.join(dealt, "root").select("node", "root", "dealt")
