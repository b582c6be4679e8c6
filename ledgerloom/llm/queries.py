"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.grouped_split import broken_groups, deal, forest_groups, linked_groups
from ledgerloom.llm.history import batch_duplicates
from ledgerloom.llm.mixing import draw_mix
from ledgerloom.llm.overlap import cross_split_classes, cross_split_pairs, overlap_report
from ledgerloom.llm.subjects import document_subjects, subject_composition
from ledgerloom.llm.tokens import encoded, round_trip, token_counts
from ledgerloom.session import Scratch
from ledgerloom.sources.tables import load


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split_pairs(load(spark, d, "r01_candidates"))
    return pairs.select(F.least("eval_id", "train_id").alias("record_id_a"), F.greatest("eval_id", "train_id").alias("record_id_b"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "r01_candidates")
    return overlap_report(rows, *cross_split_classes(rows))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return batch_duplicates(load(spark, d, "r01_candidates"), load(spark, d, "registry_loads")).select(F.col("id").alias("record_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_groups(*linked_groups(load(spark, d, "r01_candidates"))).select(F.col("id").alias("record_id"))


def p4_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its group's new split."""
    rows, nodes = linked_groups(load(spark, d, "r01_candidates"))
    return rows.join(deal(nodes), "node").select(F.col("id").alias("record_id"), F.col("root").alias("group_id"), F.col("dealt").alias("split"))


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    """Rows and groups per new split, with the share reached."""
    _, nodes = linked_groups(load(spark, d, "r01_candidates"))
    out = nodes.join(deal(nodes), ["node", "root"]).groupBy(F.col("dealt").alias("split")).agg(F.sum("rows").alias("n_rows"), F.count_distinct("root").alias("n_groups"))
    total = out.agg(F.sum("n_rows").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("split", "n_rows", "n_groups", F.round(F.col("n_rows") / F.col("total"), 6).alias("share"))  # one row of totals


def p4_forest(spark: SparkSession, d: str) -> DataFrame:
    """How many trees of each size the persisted forest has, with their edges."""
    scratch = Scratch(spark, "forest")
    linked_groups(load(spark, d, "r01_candidates"), forest=scratch.path("kept"))
    kept = spark.read.parquet(scratch.path("kept")).distinct()
    labels = forest_groups(kept, scratch)
    edges = kept.join(labels.withColumnRenamed("node", "lo"), "lo").groupBy("root").agg(F.count("*").alias("n_edges"))
    trees = labels.groupBy("root").agg(F.count("*").alias("n_nodes")).join(edges, "root")
    return trees.groupBy("n_nodes", "n_edges").agg(F.count("*").alias("n_trees"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(load(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its tokens, and whether decoding gives the text again."""
    return round_trip(load(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, d, "documents")
    return draw_mix(token_counts(docs, "source"), load(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return document_subjects(load(spark, d, "documents"), load(spark, d, "subjects"), load(spark, d, "subject_labels"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subject_composition(load(spark, d, "documents"), p9_found(spark, d))


QUERIES = {q.__name__: q for q in (p1_found, p1_report, p3_found, p4_found, p4_assignment, p4_balance, p4_forest, p7_ids, p7_round_trip, p8_mix, p8_shares, p9_found, p9_composition)}


def _revision_sql(c: str) -> str:
    s = f"lower(trim(replace({c}, chr(8203), '')))"
    s = f"""regexp_replace({s}, '^"|"$|\\^\\{{commit\\}}$', '', 'g')"""
    s = f"regexp_replace({s}, '^(commit |git:)', '')"
    s = f"regexp_replace(regexp_replace({s}, '^.*/', ''), '^v[0-9.]+-[0-9]+-g', '')"
    return f"CASE WHEN length({s}) >= 8 AND {s} NOT IN ('undefined', repeat('0', 40)) THEN {s} END"


def _locator_sql(c: str) -> str:
    s = f"lower(trim(replace({c}, chr(8203), '')))"
    s = f"regexp_replace(regexp_replace(regexp_replace({s}, '^git[+]', ''), '^[a-z]+://', ''), '[?#].*$', '')"
    s = f"regexp_replace(regexp_replace(regexp_replace({s}, '^[^/@]*@', ''), '^www[.]', ''), ':22/', '/')"
    s = f"regexp_replace(regexp_replace(replace({s}, ':', '/'), '/+', '/', 'g'), '([.]git)?/?$', '')"
    return f"nullif(array_to_string(string_split({s}, '/')[1:3], '/'), '')"


_AGREE = "({0} = {1} OR (least(length({0}), length({1})) >= 8 AND (starts_with({0}, {1}) OR starts_with({1}, {0}))))"
_TYPO = "(length({0}) >= 36 AND length({1}) >= 36 AND abs(length({0}) - length({1})) <= 2 AND levenshtein({0}, {1}) <= 2)"


def _overlap_sql() -> str:
    """Rows that share a revision's first 8 characters, then the rule in full."""
    b, f = _AGREE.format("e.b", "t.b"), _AGREE.format("e.f", "t.f")
    loose = lambda x: f"(e.{x} IS NULL OR t.{x} IS NULL OR {_TYPO.format('e.' + x, 't.' + x)})"
    rows = f"SELECT record_id, {_locator_sql('source_locator')} AS a, {_revision_sql('buggy_revision')} AS b, {_revision_sql('fixed_revision')} AS f, lower(trim(split)) AS split FROM r01_candidates"
    keyed = "SELECT *, unnest([('b', left(b, 8)), ('f', left(f, 8))]) AS k FROM rows"
    return f"""WITH rows AS MATERIALIZED ({rows}), keyed AS ({keyed}),
pairs AS (SELECT DISTINCT e.record_id AS e_id, t.record_id AS t_id FROM (SELECT * FROM keyed WHERE split IN ('dev_pilot', 'dev', 'time_ood_test') AND k[2] IS NOT NULL) e JOIN (SELECT * FROM keyed WHERE split = 'train' AND k[2] IS NOT NULL) t ON e.k = t.k
WHERE coalesce({b}, false) AND coalesce({f}, false) OR e.a = t.a AND (coalesce({b}, false) AND {loose("f")} OR coalesce({f}, false) AND {loose("b")}))"""


def _history_sql() -> str:
    """Links from each row to earlier ones, then one row after another with the list of cases so far."""
    b, f = _AGREE.format("x.b", "y.b"), _AGREE.format("x.f", "y.f")
    loose = lambda c: f"(x.{c} IS NULL OR y.{c} IS NULL OR {_TYPO.format('x.' + c, 'y.' + c)})"
    rx = "'^r0*([0-9]+)[ _-]+pair[ _-]+0*([0-9]+)$'"
    pair = f"CASE WHEN regexp_matches(lower(trim(pair_id)), {rx}) THEN regexp_replace(lower(trim(pair_id)), {rx}, '\\1:\\2') END"
    rows = f"SELECT record_id, row_number() OVER (ORDER BY coalesce(load_seq, 1000000000), record_id) AS place, {pair} AS a, {_revision_sql('buggy_revision')} AS b, {_revision_sql('fixed_revision')} AS f FROM r01_candidates LEFT JOIN registry_loads USING (load_id)"
    return f"""WITH RECURSIVE rows AS MATERIALIZED ({rows}), keyed AS MATERIALIZED (SELECT *, unnest([('b', left(b, 8)), ('f', left(f, 8))]) AS k FROM rows),
links AS MATERIALIZED (SELECT DISTINCT x.place AS earlier, y.place AS later FROM keyed x JOIN keyed y ON x.k = y.k AND x.place < y.place WHERE x.k[2] IS NOT NULL
AND (coalesce({b}, false) AND coalesce({f}, false) OR x.a = y.a AND (coalesce({b}, false) AND {loose("f")} OR coalesce({f}, false) AND {loose("b")}))),
steps AS MATERIALIZED (SELECT later, list(earlier) AS before, row_number() OVER (ORDER BY later) AS i FROM links GROUP BY later),
taken(i, cases) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT s.i, CASE WHEN len(list_filter(s.before, lambda e: NOT list_contains(t.cases, e))) > 0 THEN list_append(t.cases, s.later) ELSE t.cases END FROM taken t JOIN steps s ON s.i = t.i + 1)
SELECT record_id FROM rows WHERE place IN (SELECT unnest(cases) FROM taken WHERE i = (SELECT max(i) FROM taken))"""


def _groups_sql() -> str:
    """Rows with the least family that can be reached through shared pairs."""
    f = "lower(replace(replace(replace(replace(project_family, chr(65295), '/'), chr(8208), '-'), chr(92), '/'), '_', '-'))"
    f = f"regexp_replace(regexp_replace({f}, '[ ]', '', 'g'), '([.]git)?/?$', '')"
    f = f"nullif(regexp_replace({f}, '^[^/]*[.][^/]*/([^/]+/[^/]+)$', '\\1'), '')"
    rx = "'^r0*([0-9]+)[ _-]+pair[ _-]+0*([0-9]+)$'"
    p = f"CASE WHEN regexp_matches(lower(trim(pair_id)), {rx}) THEN regexp_replace(lower(trim(pair_id)), {rx}, '\\1:\\2') END"
    return f"""WITH RECURSIVE g AS MATERIALIZED (SELECT record_id, {f} AS f, {p} AS p, nullif(lower(trim(split)), '') AS split FROM r01_candidates),
fp AS MATERIALIZED (SELECT DISTINCT f, p FROM g WHERE f IS NOT NULL AND p IS NOT NULL),
edges AS MATERIALIZED (SELECT DISTINCT a.f AS a, b.f AS b FROM fp a JOIN fp b ON a.p = b.p AND a.f <> b.f),
reach(f, h) AS (SELECT DISTINCT f, f FROM g WHERE f IS NOT NULL UNION SELECT r.f, e.b FROM reach r JOIN edges e ON r.h = e.a),
roots AS (SELECT f, min(h) AS root FROM reach GROUP BY 1),
pairs AS (SELECT p, min(f) AS f FROM fp GROUP BY 1),
grouped AS (SELECT record_id, split, coalesce(roots.root, 'p:' || g.p, 'r:' || record_id) AS root FROM g LEFT JOIN pairs ON g.p = pairs.p LEFT JOIN roots ON coalesce(g.f, pairs.f) = roots.f)"""


ORACLE: dict[str, str] = {
    "p3_found": _history_sql(),
    "p4_found": f"{_groups_sql()} SELECT record_id FROM grouped WHERE root IN (SELECT root FROM grouped GROUP BY 1 HAVING count(DISTINCT split) > 1)",
    "p4_forest": f"{_groups_sql()}, tree AS (SELECT roots.root, count(DISTINCT f) AS fs FROM roots GROUP BY 1), hung AS (SELECT r.root, count(*) AS ps FROM pairs JOIN roots r USING (f) GROUP BY 1) SELECT fs + ps AS n_nodes, fs + ps - 1 AS n_edges, count(*) AS n_trees FROM tree JOIN hung USING (root) GROUP BY 1, 2",
    "p1_found": f"{_overlap_sql()} SELECT least(e_id, t_id) AS record_id_a, greatest(e_id, t_id) AS record_id_b FROM pairs",
    "p1_report": f"{_overlap_sql()}, hits AS (SELECT e_id, count(*) AS n FROM pairs GROUP BY 1) SELECT lower(trim(split)) AS split, nullif(lower(trim(dataset_origin)), '') AS source, count(*) AS eval_rows, count(n) AS overlapping_rows, coalesce(sum(n), 0)::BIGINT AS pairs, round(count(n) / count(*), 6) AS overlap_share FROM r01_candidates LEFT JOIN hits ON e_id = record_id WHERE lower(trim(split)) IN ('dev_pilot', 'dev', 'time_ood_test') GROUP BY 1, 2",
}
