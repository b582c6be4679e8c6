"""Deduplication of new batches against everything accepted before."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.llm import changes as C
from ledgerloom.session import Scratch, delete, exists, parallelism

#: Keys of a probe that are sent along as literals, at most, so that Spark opens their buckets only. More keys than
#: that lie in all buckets anyway and are joined bucket by bucket. Live links that one task settles at once, at most.
LITERAL_KEYS, LOCAL_LINKS = 256, 200_000
#: Rows of loads that are decided together, at most; a larger load is decided alone. Each decision is three jobs with large plans,
#: which the driver holds until its garbage is collected, so small loads that are decided one by one cost it more than their rows.
TOGETHER = 2_000_000
#: Decisions after which the driver's garbage, and with it what finished batches left on the executors' disks, is collected.
COLLECT = 3
#: Rows of a batch up to which ids of the batch are broadcast (16 bytes each) to find its rows; more are shuffled.
SMALL_BATCH = 500_000
#: Index rows that a bucket should hold, when the number of buckets is chosen from the data.
PER_BUCKET = 1_000_000
COLUMNS = "h BIGINT, id BIGINT, sig ARRAY<BIGINT>, a STRING, b STRING, f STRING, batch BIGINT, kind INT"
KEY, RECORD = 0, 1


class AcceptedIndex:
    """Band keys of all accepted records, and the records with their signatures, in a folder.

    Both are hash-partitioned into buckets: keys (``h``, id) by the key, records (``h``, id, signature, a, b, f) by a hash
    of their id, so a record is kept once whatever its number of keys. The folder outlives the session: ``open`` finds
    it again with its number of buckets. One partition per batch, so appending a batch leaves the old files as they are,
    and a batch that is appended again replaces itself. Rows are sorted by ``h`` in their files. A probe never shuffles
    the index, and opens only the buckets its keys fall into.
    """

    def __init__(self, spark: SparkSession, path: str, generation: int, buckets: int):
        self.spark, self.path, self.generation, self.buckets = spark, path, generation, buckets
        self.name = f"accepted_{hashlib.sha256(path.encode()).hexdigest()[:24]}_{generation}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({COLUMNS}) USING parquet PARTITIONED BY (batch, kind) CLUSTERED BY (h) SORTED BY (h) INTO {buckets} BUCKETS LOCATION '{path}/keys-{generation}'")
        self.empty = not exists(spark, f"{path}/keys-{generation}")
        if not self.empty:  # the batches that other sessions have written
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    @classmethod
    def open(cls, spark: SparkSession, path: str, rows: int | None = None, buckets: int | None = None) -> AcceptedIndex:
        """The index in ``path``; a new one has ``buckets``, or as many as ``rows`` records need."""
        if exists(spark, f"{path}/generations"):
            generation, kept = spark.read.parquet(f"{path}/generations").orderBy(F.desc("generation")).head()
        else:
            generation, kept = 0, buckets or max(parallelism(spark), math.ceil(3 * (rows or 0) / PER_BUCKET))
            cls._note(spark, path, generation, kept)
        return cls(spark, path, generation, kept)

    @staticmethod
    def _note(spark: SparkSession, path: str, generation: int, buckets: int) -> None:
        spark.createDataFrame([(generation, buckets)], "generation int, buckets int").coalesce(1).write.mode("append").parquet(f"{path}/generations")

    def _table(self, kind: int) -> DataFrame:
        return self.spark.table(self.name).filter(F.col("kind") == kind)

    def probe(self, keys: DataFrame, n: int | None = None) -> DataFrame:
        """Accepted rows (k, id, a, b, f) that share a key with ``keys`` (k), of which there are ``n`` if known.

        Few keys are put into the scan's filter: other buckets aren't opened, and row groups without them are
        skipped. Many keys are shuffled to the buckets and joined there; so are the ids they lead to.
        """
        found, records = self._table(KEY).select("h", "id"), self._table(RECORD).select("h", "id", "a", "b", "f")
        few = n is not None and n <= LITERAL_KEYS
        if few:
            found = found.filter(F.col("h").isin([r.k for r in keys.select("k").distinct().collect()]))  # at most LITERAL_KEYS
        else:
            found = found.join(keys.select(F.col("k").alias("h")).distinct().hint("shuffle_hash"), "h", "left_semi")
        found = found.select(F.col("h").alias("k"), F.xxhash64("id").alias("h"))  # one to one, for a single number
        if few:
            some = found.select("h").distinct().limit(LITERAL_KEYS + 1).collect()
            if len(some) <= LITERAL_KEYS:
                records = records.filter(F.col("h").isin([r.h for r in some]))
        return found.hint("shuffle_hash").join(records, "h").select("k", "id", "a", "b", "f")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write the accepted rows (id, a, b, f) of ``batch`` and their keys, in place of what was written for it before."""
        self.append_all(rows.withColumn("batch", F.lit(batch)), [batch])

    def append_all(self, rows: DataFrame, batches: list[int]) -> None:
        """As ``append``, for the rows (id, a, b, f, batch) of several batches in one write. A batch may have no rows."""
        entry = lambda h, kind: F.struct(h.alias("h"), F.lit(kind).alias("kind"))
        entries = F.concat(F.transform(C.band_keys(), lambda k: entry(k, KEY)), F.array(entry(F.xxhash64("id"), RECORD)))
        rows = rows.withColumn("sig", C.signature()).select("id", "sig", "a", "b", "f", "batch", F.explode(entries).alias("x"))
        kept = lambda c: F.when(F.col("x.kind") == RECORD, F.col(c)).alias(c)
        self._write(rows.select("x.h", "id", *map(kept, ("sig", "a", "b", "f")), "batch", "x.kind"), batches)
        self.empty = False

    def _write(self, rows: DataFrame, batches: list[int]) -> None:
        for batch in batches:
            self._delete(batch)
        rows.repartition(self.buckets, "h").createOrReplaceTempView(f"{self.name}_new")
        self.spark.sql(f"INSERT INTO TABLE {self.name} PARTITION (batch, kind) SELECT h, id, sig, a, b, f, batch, kind FROM {self.name}_new")
        self.spark.catalog.dropTempView(f"{self.name}_new")

    def _delete(self, batch: int) -> None:
        path = f"{self.path}/keys-{self.generation}/batch={batch}"
        if not self.empty and exists(self.spark, path):
            delete(self.spark, path)
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {batch}, kind = {KEY}), PARTITION (batch = {batch}, kind = {RECORD})")

    def ids(self) -> DataFrame:
        """(id) of the accepted rows that can match others, each once."""
        return self._table(RECORD).select("id")

    def compact(self, buckets: int | None = None) -> AcceptedIndex:
        """The index with one file per bucket, as a new generation; for now and then, when batches have left many
        small files or the buckets have grown. The old generation stays until it is deleted."""
        new = AcceptedIndex(self.spark, self.path, self.generation + 1, buckets or self.buckets)
        new._write(self.spark.table(self.name).withColumn("batch", F.lit(-1)), [-1])
        self._note(self.spark, self.path, new.generation, new.buckets)
        self.close()
        return AcceptedIndex.open(self.spark, self.path)

    def close(self) -> None:
        """Forget the session's name for the folder; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def settled(earlier: np.ndarray, later: np.ndarray) -> list[int]:
    """Ids that are cases: a row is one when an earlier row that is linked to it is none. Each row is told after its earlier ones."""
    linked, waits, cases = defaultdict(list), Counter(later.tolist()), set()
    for e, x in zip(earlier.tolist(), later.tolist()):
        linked[e].append(x)
    told = [i for i in linked if i not in waits]
    while told:
        i = told.pop()
        for x in linked.get(i, ()):
            if i not in cases:
                cases.add(x)
            waits[x] -= 1
            if not waits[x]:
                told.append(x)
    return sorted(cases)


def _banded(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.withColumn("sig", C.signature()).select("id", *keep, F.explode(C.band_keys()).alias("k"))


def links_within(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, earlier, later) of rows (id, a, b, f, batch, part) of one part that state the same change; rows are in order of batch, then id.

    Only rows with a band key that occurs twice in their part are joined by segments.
    """
    keys = _banded(rows, "part")
    shared = keys.groupBy("part", "k").agg(F.count("*").alias("x")).filter("x > 1").select("part", "k")
    pool = scratch.save(rows.join(keys.join(shared, ["part", "k"], "left_semi").select("id"), "id", "left_semi"), "pool")
    pairs = C.verified_pairs(pool, pool, "windowed_id < cut_id", ("part",), ("batch",))
    ends = ("windowed_id", "cut_id")
    at = lambda x, y: f"if(windowed_batch <= cut_batch, {x}, {y})"
    return pairs.selectExpr("part", f"{at(*ends)} AS earlier", f"{at(*reversed(ends))} AS later")


class BatchDeduplicator:
    """Decides batches one after another against an index; ``process`` accepts what isn't a case.

    Within a batch, rows are taken by id: a row is a case when it states the same change as a row accepted before
    it. Ids are unique. The greedy choice is settled over the batch's own links only: links of settled rows are
    taken away in rounds until the live ones fit one task. Batches that follow one another can be decided together
    (``decide``), with the links between them as their own: the choice is the same, as it depends on the links' order only.
    """

    def __init__(self, spark: SparkSession, index: AcceptedIndex):
        self.spark, self.index, self.scratch, self.decided = spark, index, Scratch(spark, "history"), 0

    def process(self, batch: DataFrame, number: int) -> None:
        """Accept the rows of a batch of (id, a, b, f) that add something.

        The copies of a row that can match state its change, so the first of them stands for all. Rows that can't
        match are accepted and stay out of the index, as no row will ever match them.
        """
        first, n = self.scratch.save_counted(batch.filter(C.can_match()).groupBy("a", "b", "f").agg(F.min("id").alias("id")), "first")
        first = first.withColumn("batch", F.lit(number))
        links, live = self.scratch.save_counted(links_within(first.withColumn("part", F.lit(0)), self.scratch), "within")
        self.decide(first, [number], n, links.select("earlier", "later"), live)
        self.scratch.drop("first", "within", "pool")

    def decide(self, batch: DataFrame, numbers: list[int], n: int, links: DataFrame, live: int) -> None:
        """As ``process``, for at most ``n`` rows (id, a, b, f, batch) of the batches ``numbers``, of which none are copies, with their
        ``live`` links (earlier, later)."""
        repeated, few = None, (F.broadcast if n <= SMALL_BATCH else lambda df: df)
        if not self.index.empty:
            keys = _banded(batch)
            old = self.scratch.save(self.index.probe(keys, 3 * n), "old")
            suspects = batch.join(few(keys.join(old.select("k"), "k", "left_semi").select("id").distinct()), "id", "left_semi")
            repeated = self.scratch.save(C.verified_pairs(suspects, old.dropDuplicates(["id"])).select(F.col("cut_id").alias("id")).distinct(), "repeated")
        cases = self._cases(links, live, repeated)
        self.index.append_all(batch if cases is None else batch.join(few(cases), "id", "left_anti"), numbers)
        self.scratch.drop("old", "repeated", "live", "dead")
        self.decided += 1
        if self.decided % COLLECT == 0:
            self.spark.sparkContext._jvm.System.gc()  # Spark removes shuffle files and broadcasts once their handles are collected

    def _cases(self, links: DataFrame, live: int, cases: DataFrame | None) -> DataFrame | None:
        without = lambda e, dead: e if dead is None else e.join(dead.withColumnRenamed("id", "earlier"), "earlier", "left_anti").join(dead.withColumnRenamed("id", "later"), "later", "left_anti")
        k = 0
        while live > LOCAL_LINKS:  # rows without a live earlier link are accepted, the rows linked to them are cases
            links, live = self.scratch.save_counted(without(links, cases), f"live/{k}")
            first = links.select("earlier").join(links.select(F.col("later").alias("earlier")), "earlier", "left_anti")
            dead = self.scratch.save(links.join(first, "earlier", "left_semi").select(F.col("later").alias("id")).distinct(), f"dead/{k}")
            links, cases, k = without(links, dead), dead if cases is None else cases.union(dead), k + 1

        def rest(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"id": np.array(settled(part["earlier"].to_numpy(), part["later"].to_numpy()), "int64")})

        if not live:
            return cases
        own = without(links, cases).groupBy().applyInPandas(rest, "id bigint")  # at most LOCAL_LINKS rows
        return own if cases is None else cases.union(own)


def together(sizes: dict[int, int]) -> dict[int, list[int]]:
    """Loads in order, by the running part in which they are decided: as many as have at most ``TOGETHER`` rows, or one."""
    parts, n = defaultdict(list), 0
    for seq in sorted(sizes):
        n += sizes[seq]
        if not parts or n > TOGETHER:
            k, n = len(parts), sizes[seq]
        parts[k].append(seq)
    return dict(parts)


def batch_duplicates(df: DataFrame, loads: DataFrame, id_col="record_id", load_col="load_id", seq_col="load_seq", anchor="pair_id", buggy="buggy_revision", fixed="fixed_revision", path: str | None = None) -> DataFrame:
    """(id) of the rows that add nothing, with the loads taken in order of ``seq_col``.

    Small loads are decided together, which gives the same rows. Rows of no known load come after all loads, as one
    batch. Rows without two of anchor and revisions match nothing and are accepted. An empty table gives no rows. The
    index is kept in ``path``, or in the scratch space.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "batches")
    order = loads.select(F.col(load_col).alias("load"), F.col(seq_col).cast("long").alias("seq")).groupBy("load").agg(F.min("seq").alias("seq"))
    rows = C.canonical(df, id_col, K.pair_key(F.col(anchor)), buggy, fixed, F.col(load_col).alias("load"))
    rows = rows.join(order, "load", "left").select("id", "a", "b", "f", F.coalesce("seq", F.lit((1 << 62))).alias("seq"))
    rows = scratch.save(rows.filter(C.can_match()), "rows")
    sizes = {r.seq: r["count"] for r in rows.groupBy("seq").count().collect()}  # as many as there are loads
    parts = together(sizes)
    part = F.broadcast(spark.createDataFrame([(seq, k) for k, seqs in parts.items() for seq in seqs], "seq bigint, part int"))
    first = rows.join(part, "seq").groupBy("part", "a", "b", "f").agg(F.min(F.struct("seq", "id")).alias("x"))
    first.selectExpr("a", "b", "f", "x.id AS id", "x.seq AS batch", "part").write.partitionBy("part").parquet(scratch.path("first"))
    first = spark.read.schema("a string, b string, f string, id bigint, batch bigint, part int").parquet(scratch.path("first"))
    ids = scratch.save(rows.select("id"), "ids")
    scratch.drop("rows")
    links_within(first, scratch).write.partitionBy("part").parquet(scratch.path("within"))  # no part's own links depend on another
    within = spark.read.schema("earlier bigint, later bigint, part int").parquet(scratch.path("within"))
    live = {r.part: r["count"] for r in within.groupBy("part").count().collect()}
    index = AcceptedIndex.open(spark, path or scratch.path("index"), sum(sizes.values()))
    batches = BatchDeduplicator(spark, index)
    of = lambda df, k, *cols: df.filter(F.col("part") == k).select(*cols)
    for k, seqs in parts.items():
        batches.decide(of(first, k, "id", "a", "b", "f", "batch"), seqs, sum(sizes[x] for x in seqs), of(within, k, "earlier", "later"), live.get(k, 0))
    out = scratch.save(ids.join(index.ids(), "id", "left_anti"), "cases")
    scratch.drop("first", "within", "pool", "ids")
    index.close()
    return out
