"""Records that occur, exactly or almost, in more than one split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.llm import changes as C
from ledgerloom.session import Scratch

#: The training split and the evaluation splits.
TRAIN = ["train"]
EVALUATION = ["dev_pilot", "dev", "time_ood_test"]


def cross_split_classes(df: DataFrame, id_col="record_id", split_col="split", anchor="source_locator", buggy="buggy_revision", fixed="fixed_revision", train=TRAIN, evaluation=EVALUATION) -> tuple[DataFrame, DataFrame]:
    """Pairs (eval_class, train_class) of classes that state the same change, and the membership (class, id).

    A class holds the rows of one side (evaluation or training) that are copies in anchor and revisions, and is named
    by its least id; copies are never expanded into pairs. Rows of no split, and rows that can't match (no two of
    anchor and revisions), are in no class. An empty input gives no pairs. Null never agrees with null.

    First a narrow pass finds classes with a band key that occurs in both splits (64-bit keys and ids only, with
    map-side combining, so a hot key is no hot task); only these are joined by segments and verified.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "overlap")
    split = K.split_key(F.col(split_col))
    rows = C.canonical(df, id_col, K.locator_key(F.col(anchor)), buggy, fixed, F.when(split.isin(evaluation), True).when(split.isin(train), False).alias("ev"))
    rows = scratch.save(rows.filter(F.col("ev").isNotNull() & C.can_match()).withColumn("h", F.sha2(F.to_json(F.struct("ev", "a", "b", "f")), 256)), "rows")
    keys = rows.withColumn("sig", C.signature()).select("id", "ev", F.explode(C.band_keys()).alias("k"))
    both = keys.groupBy("k").agg(F.bool_or("ev").alias("e"), F.bool_or(~F.col("ev")).alias("t")).filter("e AND t").select("k")
    ids = keys.join(both, "k", "left_semi").select("id")
    suspects = scratch.save(rows.join(ids, "id", "left_semi"), "suspects")
    classes = suspects.groupBy("h").agg(F.min("id").alias("class"))
    members = scratch.save(suspects.select("id", "h").join(classes, "h").select("class", "id"), "members")
    reps = suspects.join(members.select(F.col("class").alias("id")), "id", "left_semi")
    pairs = C.verified_pairs(reps.filter("ev"), reps.filter("NOT ev"))
    return scratch.save(pairs.select(F.col("cut_id").alias("eval_class"), F.col("windowed_id").alias("train_class")), "pairs"), members


def cross_split_pairs(df: DataFrame, **columns) -> DataFrame:
    """(eval_id, train_id) of every evaluation row and training row that state the same change, copies expanded.

    For callers who need every pair; ``cross_split_classes`` says the same without squaring groups of copies.
    """
    pairs, members = cross_split_classes(df, **columns)
    side = lambda name: members.select(F.col("class").alias(f"{name}_class"), F.col("id").alias(f"{name}_id"))
    return pairs.join(side("eval"), "eval_class").join(side("train"), "train_class").select("eval_id", "train_id")


def overlap_report(df: DataFrame, pairs: DataFrame, members: DataFrame, id_col="record_id", split_col="split", source="dataset_origin") -> DataFrame:
    """Counts per evaluation split and source of the evaluation row: pairs, rows concerned, rows in all, share.

    Pairs are counted from the classes and their sizes and never made.
    """
    rows = df.select(F.col(id_col).alias("eval_id"), K.split_key(F.col(split_col)).alias("split"), K.lower_trim(F.col(source)).alias("source"))
    sizes = members.groupBy(F.col("class").alias("train_class")).agg(F.count("*").alias("size"))
    hits = pairs.join(sizes, "train_class").groupBy("eval_class").agg(F.sum("size").alias("n"))
    hits = members.select(F.col("class").alias("eval_class"), F.col("id").alias("eval_id")).join(hits, "eval_class").select("eval_id", "n")
    out = rows.filter(F.col("split").isin(EVALUATION)).join(hits, "eval_id", "left").groupBy("split", "source")
    out = out.agg(F.count("*").alias("eval_rows"), F.count("n").alias("overlapping_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    return out.withColumn("overlap_share", F.round(F.col("overlapping_rows") / F.col("eval_rows"), 6))
