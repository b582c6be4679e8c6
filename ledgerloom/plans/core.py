"""Queries of the core operators: name -> (spark, folder) -> DataFrame, and their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.operators.drift import file_fields, rejected_lines, schema_changes, unified_table
from ledgerloom.operators.orphans import orphan_references, orphan_report
from ledgerloom.operators.profile import base_profile, column_changes, load_profile, quality_issues
from ledgerloom.plans import evidence, reference  # noqa: F401 (evidence registers its queries with those of reference)
from ledgerloom.sources.tables import load

#: One row of totals is joined to each row of a report: the only cross joins here.


def _readiness_orphans(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "r01_readiness").select(F.col("readiness_id").alias("ref_id"), "pair_id", "local_catalog_key", F.col("checked_at").alias("at"))
    fallback = lambda c: F.coalesce(K.pair_key(F.col(c)), K.case_key(F.col(c)))
    refs = r.select("ref_id", F.lit("pair_id").alias("ref_column"), fallback("pair_id").alias("key"), "at").union(r.select("ref_id", F.lit("local_catalog_key"), K.case_key(F.col("local_catalog_key")), "at"))
    c, k = load(spark, d, "r01_candidates"), load(spark, d, "case_catalog")
    parents = c.select(F.lit("pair_id").alias("ref_column"), fallback("pair_id").alias("key"), F.col("loaded_at").alias("begins"), F.col("removed_at").alias("ends"))
    parents = parents.union(k.select(F.lit("local_catalog_key"), K.case_key(F.col("case_id")), "added_at", "removed_at"))
    return orphan_references(refs, parents)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _readiness_orphans(spark, d).select(F.col("ref_id").alias("readiness_id"), "ref_column", "reason")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_readiness_orphans(spark, d), "r01_readiness")


#: The forms of the columns with known trouble.
_NAME = r"[A-Za-z0-9._+\-]+"
BLOCKERS = ("frozen_revision_not_locatable", "license_unclear", "citation_range_missing", "obligation_basis_generic_or_missing", "logic_not_confirmed")
CANDIDATE_FORMS = {
    "blocker": (";", "(?=;.)" + "".join(f"(?:;{b})?" for b in BLOCKERS)),
    "license_note": ("", f"artifact_license:{_NAME}(?:;spdx_guess:{_NAME})?"),
    "dataset_revision": ("", "sha256:[0-9a-f]{64}"),
}
READINESS_FORMS = {"ready": ("", "yes|no")}


def _quality_tables(spark: SparkSession, d: str) -> dict:
    return {
        "r01_candidates": (load(spark, d, "r01_candidates"), "record_id", "load_id", CANDIDATE_FORMS),
        "r01_readiness": (load(spark, d, "r01_readiness"), "readiness_id", "load_id", READINESS_FORMS),
    }


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return quality_issues(_quality_tables(spark, d), load(spark, d, "registry_loads"))


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    """Base aggregates of every column of both tables."""
    parts = [base_profile(df, name, df.columns, forms, i, l) for name, (df, i, l, forms) in _quality_tables(spark, d).items()]
    return parts[0].union(parts[1])


def p2_load_profile(spark: SparkSession, d: str) -> DataFrame:
    """Null rate, distinct values and the greatest share of a value, of every column in every load."""
    parts = [load_profile(df, name, df.columns, l) for name, (df, _, l, _) in _quality_tables(spark, d).items()]
    return parts[0].union(parts[1])


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes between loads of every column of both tables."""
    return column_changes({name: (df, i, l, df.columns) for name, (df, i, l, _) in _quality_tables(spark, d).items()}, load(spark, d, "registry_loads"))


def _streams(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t, s: load(spark, d, t).select(F.lit(s).alias("stream"), "raw_id", "file_name", "line_no", "body")
    return part("enrichment_raw", "enrichment").union(part("push_receipt_raw", "push_receipt"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(_streams(spark, d))


def p6_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return unified_table(_streams(spark, d), "enrichment", typed=True)


def p6_push_receipt(spark: SparkSession, d: str) -> DataFrame:
    return unified_table(_streams(spark, d), "push_receipt", typed=True)


def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each file with their types: what changes are told from."""
    return file_fields(_streams(spark, d))


def p6_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The lines that the unified tables don't hold, and why."""
    return rejected_lines(_streams(spark, d))


def _profile_sql(table: str, columns: list[str], bad: dict[str, str]) -> str:
    """Base aggregates in plain SQL, one column after another."""
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, min({v}) AS least, max({v}) AS greatest, {b} AS n_malformed, round((count(*) - count({c})) / count(*), 6) AS null_rate FROM {t}"
    return " UNION ALL ".join(one.format(t=table, c=c, v=f"{c}::VARCHAR", b=f"count(*) FILTER ({bad[c]})" if c in bad else "0") for c in columns)


_READINESS = ["pair_id", "category_claim", "versions_locatable", "license_clear", "citation_range_exists", "actor_view_generated", "ready", "blocker", "split", "cited_path", "local_catalog_key", "load_id"]


def readiness_profile(spark: SparkSession, d: str) -> DataFrame:
    """Base aggregates of the readiness table's text columns."""
    return base_profile(load(spark, d, "r01_readiness"), "r01_readiness", _READINESS, READINESS_FORMS, "readiness_id", "load_id")


def _pair_sql(c: str) -> str:
    s = f"lower(trim({c}))"
    rx = r"'^r0*([0-9]+)[ _-]+pair[ _-]+0*([0-9]+)$'"
    return f"CASE WHEN regexp_matches({s}, {rx}) THEN regexp_replace({s}, {rx}, '\\1:\\2') ELSE nullif({s}, '') END"


_ORPHAN_SQL = f"""WITH p AS (SELECT 'pair_id' AS ref_column, {_pair_sql("pair_id")} AS key, loaded_at AS s, removed_at AS e FROM r01_candidates UNION ALL SELECT 'local_catalog_key', nullif(lower(trim(case_id)), ''), added_at, removed_at FROM case_catalog),
r AS (SELECT readiness_id, 'pair_id' AS ref_column, {_pair_sql("pair_id")} AS key, checked_at FROM r01_readiness UNION ALL SELECT readiness_id, 'local_catalog_key', nullif(lower(trim(local_catalog_key)), ''), checked_at FROM r01_readiness),
j AS (SELECT readiness_id, r.ref_column, checked_at, count(p.key) AS n, coalesce(bool_or(s <= checked_at), false) AS begun, coalesce(bool_or(s <= checked_at AND (e IS NULL OR checked_at < e)), false) AS live FROM r LEFT JOIN p ON p.ref_column = r.ref_column AND p.key = r.key WHERE r.key IS NOT NULL GROUP BY ALL)
SELECT readiness_id, ref_column, checked_at, CASE WHEN n = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'late' END AS reason FROM j WHERE NOT live"""

_BLOCKER_BAD = "NOT regexp_full_match(';' || blocker, '" + "".join(f"(;{b})?" for b in BLOCKERS) + "') OR blocker = ''"
_LICENSE_BAD = r"NOT regexp_full_match(license_note, 'artifact_license:[A-Za-z0-9._+\-]+(;spdx_guess:[A-Za-z0-9._+\-]+)?')"
_REVISION_BAD = "NOT regexp_full_match(dataset_revision, 'sha256:[0-9a-f]{64}')"
_CANDIDATE_BAD = {"blocker": _BLOCKER_BAD, "license_note": _LICENSE_BAD, "dataset_revision": _REVISION_BAD}


def _issues_sql() -> str:
    parts = []
    for table, row, c, bad in [*(("r01_candidates", "record_id", c, b) for c, b in _CANDIDATE_BAD.items()), ("r01_readiness", "readiness_id", "ready", "ready NOT IN ('yes', 'no')")]:
        parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, 'pattern' AS issue, load_id, {row} AS row_id FROM {table} WHERE {c} IS NOT NULL AND ({bad})")
        shares = f"SELECT k, v, n / sum(n) OVER (PARTITION BY k) AS share FROM (SELECT dense_rank() OVER (ORDER BY l.load_seq) AS k, t.{c} AS v, count(*) AS n FROM {table} t JOIN registry_loads l USING (load_id) GROUP BY l.load_seq, t.{c})"
        ranks = f"SELECT DISTINCT dense_rank() OVER (ORDER BY l.load_seq) AS k, load_id FROM {table} JOIN registry_loads l USING (load_id)"
        moved = f"SELECT k, v, sum(x) AS d FROM (SELECT k, v, share AS x FROM ({shares}) UNION ALL SELECT k + 1, v, -share FROM ({shares})) GROUP BY 1, 2"
        parts.append(f"SELECT DISTINCT '{table}', '{c}', 'shift', load_id, 0::BIGINT FROM ({moved}) m JOIN ({ranks}) r USING (k) WHERE k > 1 AND abs(d) > 0.2 + 1e-12")
    return " UNION ALL ".join(parts)


_CANDIDATE_COLUMNS = ["record_id", "pair_id", "project_family", "dataset_origin", "dataset_revision", "source_locator", "buggy_revision", "fixed_revision", "category_claim", "obligation_basis", "status", "license_note", "split", "blocker", "local_catalog_key", "load_id"]


def candidate_profile(spark: SparkSession, d: str) -> DataFrame:
    """Base aggregates of the candidate table's columns but for times; ranges by text, as in the SQL."""
    return base_profile(load(spark, d, "r01_candidates"), "r01_candidates", _CANDIDATE_COLUMNS, CANDIDATE_FORMS, "record_id", "load_id", as_text=True)


_CANDIDATE_TIMES, _READINESS_TIMES = ["registered_at", "loaded_at", "removed_at"], ["checked_at"]


def _typed_profile_sql(table: str, text: list[str], numbers: list[str], times: list[str], bad: dict[str, str]) -> str:
    """As ``_profile_sql``, with ranges by the order of numbers and times."""
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, {lo} AS least, {hi} AS greatest, {b} AS n_malformed, round((count(*) - count({c})) / count(*), 6) AS null_rate FROM {t}"
    ends = lambda c: [f"({f}({c}))::VARCHAR" if c in numbers else f"rtrim(rtrim(strftime({f}({c}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')" if c in times else f"{f}({c})" for f in ("min", "max")]
    return " UNION ALL ".join(one.format(t=table, c=c, lo=ends(c)[0], hi=ends(c)[1], b=f"count(*) FILTER ({bad[c]})" if c in bad else "0") for c in numbers + text + times)


def _load_profile_sql(table: str, columns: list[str]) -> str:
    one = "SELECT '{t}' AS table_name, '{c}' AS column_name, load_id, sum(n)::BIGINT AS n_rows, round(coalesce(sum(n) FILTER (v IS NULL), 0) / sum(n), 6) AS null_rate, count(v) AS n_distinct, round(max(n) / sum(n), 6) AS top_share FROM (SELECT load_id, {c}::VARCHAR AS v, count(*) AS n FROM {t} GROUP BY ALL) GROUP BY load_id"
    return " UNION ALL ".join(one.format(t=table, c=c) for c in columns)


def _changes_sql(table: str, columns: list[str]) -> str:
    """Loads in which the share of a value, null included, differs from the load before by more than 0.2."""
    out = []
    for c in columns:
        counts = f"SELECT dense_rank() OVER (ORDER BY l.load_seq) AS k, t.{c}::VARCHAR AS v, count(*) AS n FROM {table} t JOIN registry_loads l USING (load_id) GROUP BY l.load_seq, t.{c}"
        shares = f"SELECT k, v, n / sum(n) OVER (PARTITION BY k) AS share FROM ({counts})"
        ranks = f"SELECT DISTINCT dense_rank() OVER (ORDER BY l.load_seq) AS k, load_id FROM {table} JOIN registry_loads l USING (load_id)"
        moved = f"SELECT k, v, sum(x) AS d FROM (SELECT k, v, share AS x FROM ({shares}) UNION ALL SELECT k + 1, v, -share FROM ({shares})) GROUP BY 1, 2"
        out.append(f"SELECT DISTINCT '{table}' AS table_name, '{c}' AS column_name, load_id FROM ({moved}) m JOIN ({ranks}) r USING (k) WHERE k > 1 AND abs(d) > 0.2 + 1e-12")
    return " UNION ALL ".join(out)


_ALL_CANDIDATE, _ALL_READINESS = _CANDIDATE_COLUMNS + _CANDIDATE_TIMES, ["readiness_id", *_READINESS, *_READINESS_TIMES]
_TYPE = "CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END"
FIELDS = {"p6_fields": " UNION ALL ".join(f"SELECT '{s}' AS stream, file_name, regexp_replace(substr(fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') AS field_path, coalesce(string_agg(DISTINCT {_TYPE}, ';' ORDER BY {_TYPE}), '') AS types FROM {t}, json_tree(CASE WHEN json_valid(body) THEN body END) WHERE fullkey <> '$' AND NOT ends_with(fullkey, ']') GROUP BY 1, 2, 3" for t, s in (("enrichment_raw", "enrichment"), ("push_receipt_raw", "push_receipt")))}
REJECTS = {"p6_rejects": " UNION ALL ".join(f"SELECT '{s}' AS stream, raw_id, file_name, line_no, CASE WHEN body IS NULL THEN 'null' WHEN NOT json_valid(body) THEN 'unreadable' ELSE 'no object' END AS reason FROM {t} WHERE body IS NULL OR NOT json_valid(body) OR json_type(CASE WHEN json_valid(body) THEN body END) <> 'OBJECT'" for t, s in (("enrichment_raw", "enrichment"), ("push_receipt_raw", "push_receipt")))}
ORPHANS = {
    "p5_found": f"SELECT readiness_id, ref_column, reason FROM ({_ORPHAN_SQL})",
    "p5_report": f"SELECT 'r01_readiness' AS table_name, ref_column, strftime(checked_at AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n FROM ({_ORPHAN_SQL}) GROUP BY ALL",
}
PROFILES = {
    "p2_profile": " UNION ALL ".join([_typed_profile_sql("r01_candidates", [c for c in _CANDIDATE_COLUMNS if c != "record_id"], ["record_id"], _CANDIDATE_TIMES, _CANDIDATE_BAD), _typed_profile_sql("r01_readiness", _READINESS, ["readiness_id"], _READINESS_TIMES, {"ready": "ready NOT IN ('yes', 'no')"})]),
    "p2_load_profile": " UNION ALL ".join([_load_profile_sql("r01_candidates", _ALL_CANDIDATE), _load_profile_sql("r01_readiness", _ALL_READINESS)]),
    "p2_changes": " UNION ALL ".join([_changes_sql("r01_candidates", _ALL_CANDIDATE), _changes_sql("r01_readiness", _ALL_READINESS)]),
    "readiness_profile": _profile_sql("r01_readiness", _READINESS, {"ready": "ready NOT IN ('yes', 'no')"}),
    "candidate_profile": _profile_sql("r01_candidates", _CANDIDATE_COLUMNS, _CANDIDATE_BAD),
}
QUERIES = reference.QUERIES | {q.__name__: q for q in (p2_found, p2_profile, p2_load_profile, p2_changes, readiness_profile, candidate_profile, p5_found, p5_report, p6_found, p6_enrichment, p6_push_receipt, p6_fields, p6_rejects)}
ORACLE = reference.ORACLE | PROFILES | ORPHANS | FIELDS | REJECTS | {"p2_found": _issues_sql()}
