"""Queries of the evidence-dataset operators, each with its SQL for the oracle. All run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import canonical as C
from ledgerloom.functions import keys as K
from ledgerloom.functions import predicates as P
from ledgerloom.operators import reconcile as R
from ledgerloom.operators import sequence as S
from ledgerloom.sources.tables import load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
COL = F.col


def query(sql: str | None = None):
    """Register a query and its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def long(c):
    return c.cast("bigint")


# ---- coverage and reconciliation

_STATUS = "CASE WHEN l.l_orderkey IS NULL THEN 'gap' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END"
_COVERED = f"SELECT o.*, {_STATUS} AS status FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) l ON o_orderkey = l_orderkey"


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").select(COL("l_orderkey").alias("o_orderkey"))
    return R.status_by_left_join(load(spark, d, "orders"), lines, "o_orderkey", F.when(COL("o_orderstatus") == "P", "failed").otherwise("success"))


@query(f"SELECT status, count(*) AS n, (SELECT count(*) FROM orders) AS requested FROM ({_COVERED}) GROUP BY status")
def coverage_status(spark, d):
    """Counts per status beside what was requested, which is counted apart, so a lost or doubled row shows."""
    asked = load(spark, d, "orders").agg(F.count("*").alias("requested"))
    return _coverage(spark, d).groupBy("status").agg(F.count("*").alias("n")).crossJoin(F.broadcast(asked))  # one row of totals


@query(f"SELECT o_orderkey, status FROM ({_COVERED})")
def coverage_rows_ordered(spark, d):
    return _coverage(spark, d).select("o_orderkey", "status").orderBy("o_orderkey")


@query("SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'created' WHEN b.o_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderstatus <> 'O') b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus")
def inventory_delta(spark, d):
    o = load(spark, d, "orders")
    after = o.filter("o_orderstatus <> 'O'").withColumn("o_orderstatus", F.when(COL("o_orderpriority").startswith("1"), "X").otherwise(COL("o_orderstatus")))
    return R.inventory_delta(o.filter("o_orderstatus <> 'F'"), after, "o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey = p_partkey AS part_bound, coalesce(l_suppkey = s_suppkey, false) AS supplier_bound, l_shipdate >= o_orderdate AS date_bound FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey")
def manifest_binding(spark, d):
    x = load(spark, d, "lineitem").join(load(spark, d, "orders"), COL("l_orderkey") == COL("o_orderkey"))
    x = x.join(load(spark, d, "part"), COL("l_partkey") == COL("p_partkey"), "left").join(load(spark, d, "supplier"), COL("l_suppkey") == COL("s_suppkey"), "left")
    return x.select(COL("l_orderkey").alias("orderkey"), COL("l_linenumber").alias("line"), (COL("l_partkey") == COL("p_partkey")).alias("part_bound"), F.coalesce(COL("l_suppkey") == COL("s_suppkey"), F.lit(False)).alias("supplier_bound"), (COL("l_shipdate") >= COL("o_orderdate")).alias("date_bound"))


@query("SELECT p_partkey, coalesce(n, 0) AS n_refs FROM part LEFT JOIN (SELECT l_partkey, count(*) n FROM lineitem GROUP BY 1) ON p_partkey = l_partkey")
def reference_multiplicity(spark, d):
    return R.multiplicity(load(spark, d, "part").select("p_partkey"), load(spark, d, "lineitem"), "p_partkey", "l_partkey")


@query("SELECT n_nationkey AS nationkey, 'base' AS origin FROM nation WHERE n_nationkey < 15 UNION ALL SELECT DISTINCT c_nationkey, 'increment' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 15)")
def precedence_union(spark, d):
    base = load(spark, d, "nation").filter("n_nationkey < 15").select(COL("n_nationkey").alias("nationkey"))
    return R.precedence_union(base, load(spark, d, "customer").select(COL("c_nationkey").alias("nationkey")).distinct(), "nationkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM subject_labels)")
def anti_missing(spark, d):
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "subject_labels"), "doc_id", "left_anti")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id IN (SELECT doc_id FROM subject_labels)")
def semi_overlap(spark, d):
    return load(spark, d, "documents").filter("lang = 'en'").select("doc_id").join(load(spark, d, "subject_labels"), "doc_id", "left_semi")


@query("SELECT count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS in_both FROM (SELECT DISTINCT o_custkey AS a FROM orders) FULL JOIN (SELECT DISTINCT c_custkey AS b FROM customer) ON a = b")
def set_equality(spark, d):
    return R.set_comparison(load(spark, d, "orders").select(COL("o_custkey").alias("k")), load(spark, d, "customer").select(COL("c_custkey").alias("k")), "k")


@query("SELECT count(*)::BIGINT AS collisions FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def disjointness(spark, d):
    o = load(spark, d, "orders")
    pick = lambda s: o.filter(COL("o_orderstatus") == s).select("o_custkey")
    return pick("F").intersect(pick("P")).agg(F.count("*").alias("collisions"))


@query("SELECT record_id, CASE WHEN k.case_id IS NULL THEN 'unknown_case_id' WHEN ood THEN 'time_ood_forbidden' ELSE 'eligible' END AS eligibility FROM (SELECT record_id, nullif(lower(trim(local_catalog_key)), '') AS key FROM r01_candidates) c LEFT JOIN (SELECT lower(trim(case_id)) AS case_id, coalesce(bool_or(lower(trim(split)) = 'time_ood_test'), false) AS ood FROM case_catalog GROUP BY 1) k ON c.key = k.case_id")
def catalog_eligibility(spark, d):
    key = lambda c: F.lower(F.trim(COL(c)))
    k = load(spark, d, "case_catalog").groupBy(key("case_id").alias("key")).agg(F.coalesce(F.bool_or(key("split") == "time_ood_test"), F.lit(False)).alias("ood"), F.lit(1).alias("has"))
    c = load(spark, d, "r01_candidates").select("record_id", F.nullif(key("local_catalog_key"), F.lit("")).alias("key")).join(k, "key", "left")
    return c.select("record_id", F.when(COL("has").isNull(), "unknown_case_id").when(COL("ood"), "time_ood_forbidden").otherwise("eligible").alias("eligibility"))


# ---- hashes and commitments

_ORDER_JSON = """'{"custkey":' || o_custkey || ',"key":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}'"""


def _order_hash():
    return C.commitment(key="o_orderkey", custkey="o_custkey", status="o_orderstatus", priority="o_orderpriority")


@query(f"SELECT o_orderkey, 'sha256:' || sha256({_ORDER_JSON}) AS commitment FROM orders")
def canonical_hash_orders(spark, d):
    return load(spark, d, "orders").select("o_orderkey", _order_hash().alias("commitment"))


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey % 50 <> 0 AND NOT (o_orderpriority LIKE '1%' AND o_custkey % 9 = 0)) AS n_valid FROM orders GROUP BY 1")
def self_commitment_check(spark, d):
    """Records that carry their own commitment: recomputed without that field. Some were altered after it was made, or lost a field."""
    o = load(spark, d, "orders").withColumn("own", _order_hash())
    o = o.withColumn("o_custkey", F.when(COL("o_orderkey") % 50 == 0, COL("o_custkey") + 1).otherwise(COL("o_custkey"))).withColumn("o_orderpriority", F.when(COL("o_orderpriority").startswith("1") & (COL("o_custkey") % 9 == 0) & (COL("o_orderkey") % 50 != 0), F.lit(None)).otherwise(COL("o_orderpriority")))
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(_order_hash() == COL("own")).alias("n_valid"))


@query("SELECT c_mktsegment, sha256(string_agg(h, ',' ORDER BY bucket)) AS set_commitment FROM (SELECT c_mktsegment, c_custkey // 100 AS bucket, sha256(string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey)) AS h FROM customer GROUP BY 1, 2) GROUP BY 1")
def set_commitment_by_segment(spark, d):
    """Digest of digests: a bucket of keys is hashed first, so no task gathers a segment's keys."""
    b = load(spark, d, "customer").groupBy("c_mktsegment", F.floor(COL("c_custkey") / 100).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ","), 256).alias("h"))
    return b.groupBy("c_mktsegment").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"]), ","), 256).alias("set_commitment"))


@query(f"SELECT o_custkey, count(*) AS n_orders, 'sha256:' || sha256(string_agg('sha256:' || sha256({_ORDER_JSON}), ',' ORDER BY o_orderkey)) AS episode_commitment FROM orders GROUP BY 1")
def commitment_of_commitments(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", _order_hash().alias("h"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), C.list_digest(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "h"))), lambda x: x["h"])).alias("episode_commitment"))


@query("""SELECT c_custkey, 'case-' || left(sha256('["' || c_name || '",' || c_nationkey || ']'), 24) AS opaque_id FROM customer""")
def opaque_ids(spark, d):
    return load(spark, d, "customer").select("c_custkey", C.opaque_id("case-", F.concat(F.lit('["'), "c_name", F.lit('",'), COL("c_nationkey").cast("string"), F.lit("]"))).alias("opaque_id"))


@query("SELECT sha256(text) AS content_sha, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def content_duplicates(spark, d):
    g = load(spark, d, "documents").filter("text IS NOT NULL").groupBy(F.sha2("text", 256).alias("content_sha"))
    return g.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query("SELECT user_id, string_agg(h, ',' ORDER BY h) AS diagnostics FROM (SELECT DISTINCT user_id, sha256(event_type) AS h FROM events) GROUP BY 1")
def redacted_diagnostics(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(F.sha2("event_type", 256))), ",").alias("diagnostics"))


@query("SELECT dedup_key, count(*) AS n, min(record_id) AS kept FROM (SELECT record_id, sha256(coalesce(source_locator, '~') || '|' || coalesce(buggy_revision, '~') || '|' || coalesce(category_claim, '~') || '|' || coalesce(obligation_basis, '~') || '|' || coalesce(fixed_revision, '~')) AS dedup_key FROM r01_candidates) GROUP BY 1")
def dedup_key(spark, d):
    """SPEC: one row per content key, the first kept."""
    part = lambda c: F.coalesce(COL(c), F.lit("~"))
    k = F.sha2(F.concat_ws("|", *map(part, ("source_locator", "buggy_revision", "category_claim", "obligation_basis", "fixed_revision"))), 256)
    return load(spark, d, "r01_candidates").groupBy(k.alias("dedup_key")).agg(F.count("*").alias("n"), F.min("record_id").alias("kept"))


# ---- contracts and predicates


@query("SELECT event_id, concat_ws(';', CASE WHEN NOT coalesce(event_type IN ('view', 'click', 'purchase', 'signup'), false) THEN 'type' END, CASE WHEN NOT coalesce(value >= 5, false) THEN 'value' END, CASE WHEN NOT coalesce(user_id % 7 <> 0, false) THEN 'user' END) AS failing FROM events")
def contract_check_events(spark, d):
    checks = P.failing(type=COL("event_type").isin("view", "click", "purchase", "signup"), value=COL("value") >= 5, user=COL("user_id") % 7 != 0)
    return load(spark, d, "events").select("event_id", checks.alias("failing"))


@query("SELECT event_id, json_valid(props) AS valid, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def strict_json_props(spark, d):
    v = F.try_parse_json("props")
    return load(spark, d, "events").select("event_id", v.isNotNull().alias("valid"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("SELECT raw_id, json_valid(body) AS readable, CASE WHEN json_valid(body) THEN json_type(body, '$.schema_version') = 'VARCHAR' END AS strict_version FROM enrichment_raw")
def strict_lines(spark, d):
    v = F.try_parse_json("body")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.schema_version", "variant"))
    return load(spark, d, "enrichment_raw").select("raw_id", v.isNotNull().alias("readable"), (kind == "STRING").alias("strict_version"))


@query(r"SELECT readiness_id, coalesce(length(cited_path) > 0 AND NOT regexp_matches(cited_path, '[\\:\x00-\x1f\x7f]|//|^/|/$|(^|/)\.{1,2}(/|$)'), false) AS canonical, coalesce(list_has_any(string_split(lower(cited_path), '/'), ['test', 'tests', 'example', 'examples', 'doc', 'docs']), false) AS low_priority FROM r01_readiness")
def path_contracts(spark, d):
    return load(spark, d, "r01_readiness").select("readiness_id", P.canonical_path(COL("cited_path")).alias("canonical"), P.low_priority(COL("cited_path")).alias("low_priority"))


@query("SELECT record_id, regexp_full_match(coalesce(buggy_revision, ''), '[0-9a-f]{40}') AS commit_ok, regexp_full_match(coalesce(dataset_revision, ''), 'sha256:[0-9a-f]{64}') AS digest_ok, NOT coalesce(regexp_matches(lower(pair_id), '^(cve|ghsa)-'), true) AS opaque, coalesce(trim(obligation_basis) = '', true) OR contains(lower(obligation_basis), 'family_template') AS generic FROM r01_candidates")
def registry_contracts(spark, d):
    c = load(spark, d, "r01_candidates")
    return c.select("record_id", P.matches(COL("buggy_revision"), "[0-9a-f]{40}").alias("commit_ok"), P.matches(COL("dataset_revision"), "sha256:[0-9a-f]{64}").alias("digest_ok"), P.opaque(COL("pair_id")).alias("opaque"), P.generic_basis(COL("obligation_basis"), ("family_template",)).alias("generic"))


@query("SELECT readiness_id, concat_ws(';', CASE WHEN versions_locatable IS DISTINCT FROM 'yes' THEN 'frozen_revision_not_locatable' END, CASE WHEN license_clear IS DISTINCT FROM 'yes' THEN 'license_unclear' END, CASE WHEN citation_range_exists IS DISTINCT FROM 'yes' THEN 'citation_range_missing' END, CASE WHEN category_claim LIKE 'logic%' AND actor_view_generated IS DISTINCT FROM 'yes' THEN 'logic_not_confirmed' END) AS blockers FROM r01_readiness")
def readiness_blockers(spark, d):
    yes = lambda c: COL(c) == "yes"
    logic = F.coalesce(COL("category_claim").startswith("logic"), F.lit(False))
    found = P.failing(frozen_revision_not_locatable=yes("versions_locatable"), license_unclear=yes("license_clear"), citation_range_missing=yes("citation_range_exists"), logic_not_confirmed=~logic | F.coalesce(yes("actor_view_generated"), F.lit(False)))
    return load(spark, d, "r01_readiness").select("readiness_id", found.alias("blockers"))


@query("SELECT doc_id, length(text) AS chars, octet_length(encode(text)) AS bytes, coalesce(octet_length(encode(text)) <= 8192, false) AS in_bounds FROM documents")
def metadata_bounds(spark, d):
    return load(spark, d, "documents").select("doc_id", long(F.length("text")).alias("chars"), long(F.octet_length("text")).alias("bytes"), F.coalesce(F.octet_length("text") <= 8192, F.lit(False)).alias("in_bounds"))


@query("SELECT p_partkey, op, CASE WHEN op = 'compare' THEN p_size > 10 WHEN op = 'read' THEN true WHEN op = 'trace' THEN p_brand <> 'Brand#11' ELSE p_size % 2 = 0 END AS legal FROM part CROSS JOIN (VALUES ('read'), ('compare'), ('trace'), ('list'), ('search'), ('close')) t(op)")
def legality_mask(spark, d):
    return _candidates(spark, d).select("p_partkey", "op", "legal")


_OPS = ("read", "compare", "trace", "list", "search", "close")


def _candidates(spark, d):
    """Every part with each of the fixed operations: an array literal is exploded, nothing is joined."""
    x = load(spark, d, "part").withColumn("op", F.explode(F.array(*map(F.lit, _OPS))))
    legal = F.when(COL("op") == "compare", COL("p_size") > 10).when(COL("op") == "read", True).when(COL("op") == "trace", COL("p_brand") != "Brand#11").otherwise(COL("p_size") % 2 == 0)
    return x.withColumn("legal", legal).withColumn("action_id", F.sha2(F.concat(COL("p_partkey").cast("string"), F.lit("|"), "op"), 256))


_CAND = "SELECT p_partkey, op, sha256(p_partkey || '|' || op) AS h FROM part CROSS JOIN (VALUES ('read'), ('compare'), ('trace'), ('list'), ('search'), ('close')) t(op)"


@query(f"SELECT p_partkey, count(*) AS n, count(DISTINCT h) AS n_ids FROM ({_CAND}) GROUP BY 1")
def candidate_expansion(spark, d):
    return _candidates(spark, d).groupBy("p_partkey").agg(F.count("*").alias("n"), F.count_distinct("action_id").alias("n_ids"))


@query(f"SELECT p_partkey, op, row_number() OVER (PARTITION BY p_partkey ORDER BY h) AS position, 'A-' || left(h, 24) AS action_id FROM ({_CAND})")
def hash_order_candidates(spark, d):
    w = Window.partitionBy("p_partkey").orderBy("action_id")
    return _candidates(spark, d).select("p_partkey", "op", long(F.row_number().over(w)).alias("position"), F.concat(F.lit("A-"), F.left("action_id", F.lit(24))).alias("action_id"))


@query("SELECT catalog_row, list_contains(['T1', 'T2'], evidence_tier) AS allowed, len(artifacts.test_paths)::BIGINT AS n_tests FROM case_catalog")
def evidence_allow_list(spark, d):
    return load(spark, d, "case_catalog").select("catalog_row", F.array_contains(F.array(F.lit("T1"), F.lit("T2")), COL("evidence_tier")).alias("allowed"), long(F.size("artifacts.test_paths")).alias("n_tests"))


@query("SELECT catalog_row, regexp_full_match(coalesce(cwe_normalized_primary, ''), 'CWE-[0-9]+') AS cwe_ok, coalesce(repository.vulnerable_commit <> repository.fixed_commit, false) AS commits_differ FROM case_catalog")
def collision_guard(spark, d):
    return load(spark, d, "case_catalog").select("catalog_row", P.matches(COL("cwe_normalized_primary"), "CWE-[0-9]+").alias("cwe_ok"), F.coalesce(COL("repository.vulnerable_commit") != COL("repository.fixed_commit"), F.lit(False)).alias("commits_differ"))


# ---- projections


@query("SELECT catalog_row, 'case-' || left(sha256(coalesce(case_id, '')), 24) AS opaque_id, family, split, 4 AS budget FROM case_catalog")
def policy_seed(spark, d):
    """White-list projection: built from named fields only."""
    return load(spark, d, "case_catalog").select("catalog_row", C.opaque_id("case-", F.coalesce("case_id", F.lit(""))).alias("opaque_id"), "family", "split", F.lit(4).alias("budget"))


@query(r"SELECT record_id, regexp_replace(regexp_replace(source_locator, '[?#].*$', ''), '^([a-z+]+://)[^/@]*@', '\1') AS redacted FROM r01_candidates")
def url_redaction(spark, d):
    return load(spark, d, "r01_candidates").select("record_id", P.redacted_url(COL("source_locator")).alias("redacted"))


@query("SELECT catalog_row, CASE WHEN artifacts.manifest_path IS NULL THEN '__batch__' WHEN artifacts.patch_path LIKE '%.patch' THEN 'patch' WHEN artifacts.patch_path IS NULL THEN '__derived__' ELSE 'other' END AS kind FROM case_catalog")
def artifact_kind(spark, d):
    p = COL("artifacts.patch_path")
    return load(spark, d, "case_catalog").select("catalog_row", F.when(COL("artifacts.manifest_path").isNull(), "__batch__").when(p.endswith(".patch"), "patch").when(p.isNull(), "__derived__").otherwise("other").alias("kind"))


@query("SELECT raw_id, CASE WHEN json_valid(body) THEN coalesce(json_array_length(body, '$.payload.trace'), 0) END::BIGINT AS n_trace, CASE WHEN json_valid(body) THEN coalesce(json_array_length(body, '$.payload.locations'), 0) END::BIGINT AS n_locations FROM enrichment_raw")
def payload_summary(spark, d):
    v = F.try_parse_json("body")
    n = lambda p: F.when(v.isNotNull(), F.coalesce(F.size(F.try_variant_get(v, p, "array<variant>")), F.lit(0)))
    return load(spark, d, "enrichment_raw").select("raw_id", long(n("$.payload.trace")).alias("n_trace"), long(n("$.payload.locations")).alias("n_locations"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 94) || '\n[cut here]\n' || right(text, 94) END AS cut FROM documents")
def head_tail_truncate(spark, d):
    return load(spark, d, "documents").select("doc_id", P.head_tail(COL("text"), 200, "\n[cut here]\n").alias("cut"))


@query("SELECT doc_id, i AS line_no, t[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), generate_series(3, 6) g(i) WHERE i <= len(t)")
def line_window(spark, d):
    window = F.slice(F.split("text", "\n"), 3, 4)  # cut out before lines become rows
    return load(spark, d, "documents").select("doc_id", F.posexplode(window).alias("i", "line")).select("doc_id", long(COL("i") + 3).alias("line_no"), "line")


@query("SELECT event_id, event_id % 101 <> 0 AND event_id % 103 <> 0 AS agree, CASE WHEN event_id % 101 = 0 THEN 'missing' WHEN event_id % 103 = 0 THEN 'differs' ELSE 'same' END AS how FROM events")
def dual_views_agree(spark, d):
    """Two views of one sequence must give the same events; one of them lost some and changed others."""
    e = load(spark, d, "events")
    h = lambda t: C.commitment(t=t, u="user_id")
    a = e.select("event_id", h("event_type").alias("ha"))
    b = e.filter("event_id % 101 <> 0").select("event_id", h(F.when(COL("event_id") % 103 == 0, "other").otherwise(COL("event_type"))).alias("hb"))
    how = F.when(COL("ha").isNull() | COL("hb").isNull(), "missing").when(COL("ha") != COL("hb"), "differs").otherwise("same")
    return a.join(b, "event_id", "full_outer").select("event_id", (how == "same").alias("agree"), how.alias("how"))


# ---- aggregates


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def group_counts_sorted(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def map_sum_usage(spark, d):
    usage = F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "n")
    return load(spark, d, "events").select("event_type", usage).filter("key = 'k'").groupBy("event_type").agg(F.sum("n").alias("total"))


@query("SELECT event_type, round(sum(value), 4) AS total, round(count(*) FILTER (value > 10) / count(*), 6) AS rate FROM events GROUP BY 1")
def rate_and_latency(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.round(F.count_if(COL("value") > 10) / F.count("*"), 6).alias("rate"))


@query("SELECT lang, min(n_chars) AS shortest, median(n_chars) AS middle, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS longest FROM documents GROUP BY 1")
def summary_nearest_rank(spark, d):
    docs = load(spark, d, "documents")
    ranks = {"middle": (COL("n") + 1) / 2, "p95": F.ceil(COL("n") * F.lit(0.95))}
    q = S.exact_quantiles(docs, "lang", "n_chars", ranks, span=1000).withColumnRenamed("lang", "l")
    ends = docs.groupBy("lang").agg(F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))
    return ends.join(q, COL("lang").eqNullSafe(COL("l")), "left").select("lang", "shortest", COL("middle").cast("double").alias("middle"), long(COL("p95")).alias("p95"), "longest")


@query("SELECT event_type, round(coalesce(quantile_cont(value, 0.95), 0), 4) AS p95 FROM events GROUP BY 1")
def summary_linear(spark, d):
    e = load(spark, d, "events")
    q = S.exact_quantiles(e, "event_type", "value", {"p95": (COL("n") - 1) * F.lit(0.95) + 1}, span=0.25)
    return e.select("event_type").distinct().join(q, "event_type", "left").select("event_type", F.round(F.coalesce("p95", F.lit(0.0)), 4).alias("p95"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return load(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus = 'X') AS X FROM orders GROUP BY 1")
def zero_filled_pivot(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P", "X"]).count().fillna(0)


@query("SELECT n_name, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def ids_by_category(spark, d):
    x = load(spark, d, "supplier").join(load(spark, d, "nation"), COL("s_nationkey") == COL("n_nationkey"))
    return x.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set("s_suppkey")).cast("array<string>"), ",").alias("suppliers"))


@query("SELECT event_type, string_agg(u, ',' ORDER BY u) AS weekdays FROM (SELECT DISTINCT event_type, dayname(ts) AS u FROM events) GROUP BY 1")
def distinct_sorted_values(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_set(F.date_format("ts", "EEEE"))), ",").alias("weekdays"))


@query("SELECT l_orderkey, bool_and(l_quantity > 0) AND bool_and(l_discount <= 0.05) AND bool_and(l_tax >= 0) AS all_passed FROM lineitem GROUP BY 1")
def all_gates(spark, d):
    gates = F.every(COL("l_quantity") > 0) & F.every(COL("l_discount") <= 0.05) & F.every(COL("l_tax") >= 0)
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(gates.alias("all_passed"))


@query("SELECT pair_id, count(*) AS n, count(DISTINCT sha256(coalesce(buggy_revision, '~') || '|' || coalesce(fixed_revision, '~'))) = 1 AS consistent, count(*) = 2 AS exact_repeat FROM r01_candidates GROUP BY 1 HAVING count(*) > 1")
def repeat_consistency(spark, d):
    h = F.sha2(F.concat_ws("|", F.coalesce("buggy_revision", F.lit("~")), F.coalesce("fixed_revision", F.lit("~"))), 256)
    g = load(spark, d, "r01_candidates").select("pair_id", h.alias("h")).groupBy("pair_id")
    return g.agg(F.count("*").alias("n"), (F.min("h") == F.max("h")).alias("consistent"), (F.count("*") == 2).alias("exact_repeat")).filter("n > 1")


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity, count(*) FILTER (l_discount = 0) AS undiscounted, count(*) FILTER (l_tax > 0.05) AS taxed FROM lineitem GROUP BY 1")
def multi_totals(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count_if(COL("l_discount") == 0).alias("undiscounted"), F.count_if(COL("l_tax") > 0.05).alias("taxed"))


@query("SELECT load_id, count(*) AS n, count(DISTINCT project_family) AS families, count(*) FILTER (source_locator IS NULL) AS no_locator, count(*) FILTER (status = 'source_resolved') AS resolved FROM r01_candidates GROUP BY 1")
def inventory_counts(spark, d):
    return load(spark, d, "r01_candidates").groupBy("load_id").agg(F.count("*").alias("n"), F.count_distinct("project_family").alias("families"), F.count_if(COL("source_locator").isNull()).alias("no_locator"), F.count_if(COL("status") == "source_resolved").alias("resolved"))


@query("SELECT user_id, count(*) FILTER (event_type = 'error')::BIGINT AS illegal, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS reward FROM events GROUP BY 1")
def transition_metrics(spark, d):
    return load(spark, d, "events").groupBy("user_id").agg(F.count_if(COL("event_type") == "error").alias("illegal"), F.round(F.sum(F.when(COL("event_type") == "purchase", COL("value")).otherwise(0.0)), 4).alias("reward"))


@query("SELECT o_custkey, min(o_orderstatus) = max(o_orderstatus) AS shared FROM orders GROUP BY 1")
def shared_value_check(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg((F.min("o_orderstatus") == F.max("o_orderstatus")).alias("shared"))


@query("SELECT load_id, count(*) AS slots, CASE WHEN coalesce(bool_and(actor_view_generated = 'yes'), true) THEN 'exact' ELSE 'upper_bound' END AS bound FROM r01_readiness GROUP BY 1")
def invocation_bound(spark, d):
    return load(spark, d, "r01_readiness").groupBy("load_id").agg(F.count("*").alias("slots"), F.when(F.coalesce(F.every(COL("actor_view_generated") == "yes"), F.lit(True)), "exact").otherwise("upper_bound").alias("bound"))


# ---- order and sequence


@query("SELECT event_id, 'S-' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY event_id))::VARCHAR, 6, '0') AS step FROM events")
def step_numbering(spark, d):
    e = S.positioned(load(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")
    return e.select("event_id", F.concat(F.lit("S-"), F.lpad((COL("position") + 1).cast("string"), 6, "0")).alias("step"))


_SHA = "sha256(event_id || '|' || event_type)"


@query(f"SELECT event_id, row_number() OVER w - 1 AS position, {_SHA} AS event_sha, lag({_SHA}) OVER w AS previous_sha FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def event_chain(spark, d):
    record = F.concat_ws("|", COL("event_id").cast("string"), "event_type")
    return S.chain(load(spark, d, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", record).select("event_id", "position", "event_sha", "previous_sha")


@query("SELECT file_name, bool_and(line_no = r) AS gap_free FROM (SELECT file_name, line_no, row_number() OVER (PARTITION BY file_name ORDER BY line_no) AS r FROM enrichment_raw) GROUP BY 1")
def gap_free_sequence(spark, d):
    """Distinct line numbers from 1 to the count: two aggregates, no ordering of a file's lines."""
    return load(spark, d, "enrichment_raw").groupBy("file_name").agg(((F.min("line_no") == 1) & (F.max("line_no") == F.count("*")) & (F.count_distinct("line_no") == F.count("*"))).alias("gap_free"))


@query("SELECT user_id, day, codes, regexp_full_match(codes, '[vcs]*(p[vcs]*)*e?') AS legal FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, string_agg(left(event_type, 1), '' ORDER BY event_id) AS codes FROM events GROUP BY 1, 2)")
def fsm_replay(spark, d):
    e = load(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return S.ordered_codes(e, ["user_id", "day"], "event_id", F.left("event_type", F.lit(1))).withColumn("legal", P.matches(COL("codes"), "[vcs]*(p[vcs]*)*e?"))


@query("SELECT event_id, coalesce(string_agg(event_id::VARCHAR, ',') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history FROM events")
def bounded_history(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-5, -1)
    return load(spark, d, "events").select("event_id", F.array_join(F.collect_list("event_id").over(w).cast("array<string>"), ",").alias("history"))


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS done FROM events")
def terminal_flag(spark, d):
    """The last row of each key is the greatest: an aggregate and a join, no ordering."""
    e = load(spark, d, "events").select("event_id", "user_id")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("last"))
    return e.join(last, "user_id").select("event_id", (COL("event_id") == COL("last")).alias("done"))


@query("SELECT event_id, CASE coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') WHEN 'error' THEN 'repair' WHEN '' THEN 'initial' ELSE 'continue' END AS purpose FROM events")
def transition_from_previous(spark, d):
    e = S.positioned(load(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", previous={"before": COL("event_type")})
    return e.select("event_id", F.when(COL("before") == "error", "repair").when(COL("before").isNull(), "initial").otherwise("continue").alias("purpose"))


@query("SELECT o_custkey, max(o_orderkey) - min(o_orderkey) + 1 = count(*) AND count(DISTINCT o_orderkey) = count(*) AS contiguous FROM orders GROUP BY 1")
def contiguous_segment(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(((F.max("o_orderkey") - F.min("o_orderkey") + 1 == F.count("*")) & (F.count_distinct("o_orderkey") == F.count("*"))).alias("contiguous"))


@query("SELECT o_orderkey, o_custkey, rank FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) ORDER BY rank, o_custkey LIMIT 64")
def round_robin_topk(spark, d):
    return S.round_robin(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 64)


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size > 40, CASE WHEN p_size > 40 THEN 0 ELSE p_size END, p_partkey LIMIT 32")
def candidate_sort_limit(spark, d):
    big = COL("p_size") > 40
    return load(spark, d, "part").select("p_partkey", "p_size").orderBy(big, F.when(big, 0).otherwise(COL("p_size")), "p_partkey").limit(32)


@query("SELECT user_id, min(s) AS start, max(e) AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id) AS island FROM (SELECT *, CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END AS fresh FROM (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT user_id, event_id, epoch_us(ts) - 1800000000 AS s, epoch_us(ts) + 1800000000 AS e FROM events)))) GROUP BY user_id, island")
def interval_merge(spark, d):
    at = F.unix_micros(COL("ts").cast("timestamp"))
    e = load(spark, d, "events").select("user_id", "event_id", (at - 1_800_000_000).alias("s"), (at + 1_800_000_000).alias("e"))
    return S.merged_intervals(e, ["user_id"], "s", "e", "event_id")


@query("WITH RECURSIVE x AS (SELECT doc_id // 50 AS chunk, doc_id, coalesce(n_chars, 0) AS size, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS r FROM documents), p AS (SELECT chunk, r, doc_id, size <= 20000 AS took, CASE WHEN size <= 20000 THEN size ELSE 0 END::BIGINT AS used FROM x WHERE r = 1 UNION ALL SELECT x.chunk, x.r, x.doc_id, p.used + x.size <= 20000, (p.used + CASE WHEN p.used + x.size <= 20000 THEN x.size ELSE 0 END)::BIGINT FROM p JOIN x ON x.chunk = p.chunk AND x.r = p.r + 1) SELECT chunk, doc_id FROM p WHERE took")
def greedy_pack(spark, d):
    docs = load(spark, d, "documents").withColumn("chunk", F.floor(COL("doc_id") / 50))
    return S.greedy_pack(docs, ["chunk"], "doc_id", "n_chars", 20_000)


@query("SELECT user_id, coalesce(min(r) FILTER (event_type = 'error'), count(*)) AS reads, CASE WHEN bool_or(event_type = 'error') THEN 'finish' WHEN count(*) = 4 THEN 'budget_exhausted' ELSE 'insufficient_material' END AS outcome FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 4 GROUP BY 1")
def ordered_budget_replay(spark, d):
    return S.budgeted_replay(load(spark, d, "events"), ["user_id"], "event_id", COL("event_type") == "error", 4)


@query("SELECT user_id, arg_max(event_type, event_id) AS last_outcome, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'retries_exhausted' ELSE 'completed' END AS reason FROM events GROUP BY 1")
def retry_terminal_reason(spark, d):
    g = load(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_outcome"))
    return g.withColumn("reason", F.when(COL("last_outcome") == "error", "retries_exhausted").otherwise("completed"))


# ---- leakage


@query("WITH h AS (SELECT doc_id, left(unnest(regexp_extract_all(lower(text), '[0-9a-f]{9,40}')), 9) AS c FROM documents), s AS (SELECT left(lower(repository.vulnerable_commit), 9) AS c FROM case_catalog UNION SELECT left(lower(buggy_revision), 9) FROM r01_candidates) SELECT DISTINCT doc_id, sha256(h.c) AS secret_sha FROM h JOIN s ON h.c = s.c")
def leakage_commits(spark, d):
    """Protected commits written in texts, also abbreviated to 9 characters: what looks like one is cut out and
    equi-joined, so no text meets all secrets."""
    short = lambda c: F.left(F.lower(COL(c)), F.lit(9)).alias("c")
    secrets = load(spark, d, "case_catalog").select(short("repository.vulnerable_commit")).union(load(spark, d, "r01_candidates").select(short("buggy_revision"))).distinct()
    hits = load(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([0-9a-f]{9,40})"), F.lit(1))).alias("c"))
    hits = hits.select("doc_id", F.left("c", F.lit(9)).alias("c"))
    return hits.join(secrets, "c", "left_semi").select("doc_id", F.sha2("c", 256).alias("secret_sha")).distinct()


@query()
def leakage_revisions(spark, d):
    """(doc_id, secret_sha): every protected revision that a text writes, in full or abbreviated to 8 characters or more.

    Protected are both revisions of the candidates and both commits of the catalog, without their wrapping. Runs of
    hex digits and of letters and digits are cut out of the text, equi-joined on 8 characters and verified. Null
    texts and absent revisions give nothing; a commit that a text repeats comes out once.
    """
    c, k = load(spark, d, "r01_candidates"), load(spark, d, "case_catalog")
    cores = [t.select(K.revision_core(COL(x)).alias("core")) for t, x in ((c, "buggy_revision"), (c, "fixed_revision"), (k, "repository.vulnerable_commit"), (k, "repository.fixed_commit"))]
    secrets = cores[0].union(cores[1]).union(cores[2]).union(cores[3]).filter(F.length("core") >= 8).distinct()
    text = K.fold(COL("text"))
    runs = F.array_union(F.regexp_extract_all(text, F.lit("([0-9a-f]{8,})"), F.lit(1)), F.regexp_extract_all(text, F.lit("([0-9a-z]*[0-9][0-9a-z]*)"), F.lit(1)))
    hits = load(spark, d, "documents").select("doc_id", F.explode(runs).alias("c")).filter(F.length("c") >= 8).distinct()
    key = lambda x: F.left(x, F.lit(8)).alias("k")
    found = hits.select("doc_id", "c", key(COL("c"))).join(secrets.select("core", key(COL("core"))), "k").filter(K.agree(COL("c"), COL("core")))
    return found.select("doc_id", F.sha2("core", 256).alias("secret_sha")).distinct()


@query("SELECT DISTINCT record_id FROM r01_candidates WHERE lower(trim(project_family)) IN (SELECT lower(trim(repository.upstream_id)) FROM case_catalog)")
def leakage_exact(spark, d):
    key = load(spark, d, "case_catalog").select(F.lower(F.trim("repository.upstream_id")).alias("k"))
    return load(spark, d, "r01_candidates").select("record_id", F.lower(F.trim("project_family")).alias("k")).join(key, "k", "left_semi").select("record_id")


# ---- specified measures


@query("SELECT c_custkey, CASE WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'dev' ELSE 'test' END AS split FROM (SELECT c_custkey, ('0x' || left(sha256('n' || c_nationkey), 8))::BIGINT % 10 AS b FROM customer)")
def group_disjoint_split(spark, d):
    b = F.conv(F.left(F.sha2(F.concat(F.lit("n"), COL("c_nationkey").cast("string")), 256), F.lit(8)), 16, 10).cast("bigint") % 10
    return load(spark, d, "customer").select("c_custkey", F.when(b < 8, "train").when(b == 8, "dev").otherwise("test").alias("split"))


@query("SELECT o_custkey, count(*) AS n, least(count(*), 5) AS kept, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM orders GROUP BY 1")
def per_group_cap(spark, d):
    """SPEC quota: what a cap of five per group keeps, and the group's share."""
    o = load(spark, d, "orders")
    total = o.agg(F.count("*").alias("all"))
    return o.groupBy("o_custkey").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("o_custkey", "n", F.least(COL("n"), F.lit(5)).alias("kept"), F.round(COL("n") / COL("all"), 8).alias("share"))  # one row of totals


@query("SELECT event_id, round(value + 0.99 * coalesce(lead(value, 1) OVER w, 0) + 0.9801 * coalesce(lead(value, 2) OVER w, 0), 6) AS return3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def k_step_return(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    step = lambda k, g: F.coalesce(F.lead("value", k).over(w), F.lit(0.0)) * g
    return load(spark, d, "events").select("event_id", F.round(COL("value") + step(1, 0.99) + step(2, 0.9801), 6).alias("return3"))


@query("SELECT bucket, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS frequency FROM (SELECT least(floor(l_discount * 100), 9)::BIGINT AS bucket, l_discount AS p, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem) GROUP BY 1")
def calibration_bins(spark, d):
    x = load(spark, d, "lineitem").select(long(F.least(F.floor(COL("l_discount") * 100), F.lit(9))).alias("bucket"), COL("l_discount").alias("p"), F.when(COL("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return x.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg("y"), 6).alias("frequency"))


@query("SELECT user_id, round(sum(g / log2(r + 1)), 6) AS dcg FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS g, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 10 GROUP BY 1")
def dcg_topk(spark, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    x = load(spark, d, "events").select("user_id", F.when(COL("event_type") == "purchase", 1).otherwise(0).alias("g"), r.alias("r")).filter("r <= 10")
    return x.groupBy("user_id").agg(F.round(F.sum(COL("g") / F.log2(COL("r") + 1)), 6).alias("dcg"))


@query("SELECT a AS event_type, b AS next_type, count(*) AS n, a <> 'error' OR b <> 'purchase' AS legal FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NOT NULL GROUP BY 1, 2")
def automaton_transitions(spark, d):
    e = S.positioned(load(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", following={"next_type": COL("event_type")})
    g = e.select("event_type", "next_type").filter("next_type IS NOT NULL").groupBy("event_type", "next_type").agg(F.count("*").alias("n"))
    return g.withColumn("legal", (COL("event_type") != "error") | (COL("next_type") != "purchase"))


@query("SELECT o_orderkey, coalesce(o_totalprice <= lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), true) AS monotone FROM orders")
def budget_monotonicity(spark, d):
    o = S.positioned(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey", previous={"before": COL("o_totalprice")})
    return o.select("o_orderkey", F.coalesce(COL("o_totalprice") <= COL("before"), F.lit(True)).alias("monotone"))


# ---- further projections, rules and joins


@query("SELECT event_id, sha256('{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}') AS identity FROM events")
def identity_projection(spark, d):
    """The record without its own id, name and time: what is compared when runs are repeated."""
    r = F.struct(COL("event_id").alias("id"), COL("ts"), COL("event_type").alias("type"), COL("user_id").alias("user"))
    return load(spark, d, "events").select("event_id", F.sha2(F.to_json(r.dropFields("id", "ts")), 256).alias("identity"))


@query("SELECT event_id, count(*) OVER w AS state_version, count(*) OVER w - 1 AS history_size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def state_projection(spark, d):
    e = S.positioned(load(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id")
    return e.select("event_id", (COL("position") + 1).alias("state_version"), COL("position").alias("history_size"))


@query("SELECT doc_id, (i - 1) // 4 AS chunk, string_agg(t[i], ' / ' ORDER BY i) AS joined FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL), unnest(range(1, len(t) + 1)) AS g(i) GROUP BY 1, 2")
def chunk_regroup(spark, d):
    lines = load(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    g = lines.groupBy("doc_id", long(F.floor(COL("i") / 4)).alias("chunk"))
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " / ").alias("joined"))


@query(r"SELECT doc_id, coalesce(len(list_filter(string_split(text, chr(10))[greatest(pos - 3, 1):pos + 3], lambda x: regexp_matches(x, '\bguard\b'))) > 0, false) AS grounded FROM (SELECT *, coalesce(n_chars, 0) % 20 + 1 AS pos FROM documents)")
def grounded_locations(spark, d):
    """Range join of a location and its file's lines, with EXISTS semantics: three lines around are searched in place."""
    at = (F.coalesce("n_chars", F.lit(0)) % 20 + 1).cast("int")
    first = F.greatest(at - 3, F.lit(1))
    near = F.slice(F.split("text", "\n"), first, at + 3 - first + 1)
    return load(spark, d, "documents").select("doc_id", F.coalesce(F.exists(near, lambda x: x.rlike(r"\bguard\b")), F.lit(False)).alias("grounded"))


@query("SELECT readiness_id, ready IN ('yes', 'no') AS ready_ok, NOT (coalesce(ready = 'yes', false) AND blocker IS NOT NULL) AS blocker_ok, CASE WHEN ready = 'yes' AND blocker IS NOT NULL THEN 'path' WHEN ready IS NULL THEN 'structured' WHEN ready NOT IN ('yes', 'no') THEN 'semantic' ELSE 'valid' END AS repair_class FROM r01_readiness")
def report_domain_checks(spark, d):
    ok = COL("ready").isin("yes", "no")
    clash = F.coalesce(COL("ready") == "yes", F.lit(False)) & COL("blocker").isNotNull()
    kind = F.when(clash, "path").when(COL("ready").isNull(), "structured").when(~ok, "semantic").otherwise("valid")
    return load(spark, d, "r01_readiness").select("readiness_id", ok.alias("ready_ok"), (~clash).alias("blocker_ok"), kind.alias("repair_class"))


@query("SELECT load_id, coalesce(string_agg(DISTINCT blocker, ',' ORDER BY blocker) FILTER (blocker NOT IN ('license_unclear', 'logic_not_confirmed', 'citation_range_missing', 'frozen_revision_not_locatable', 'obligation_basis_generic_or_missing') AND NOT contains(blocker, ';')), '') AS misses FROM r01_readiness GROUP BY 1")
def vocabulary_misses(spark, d):
    known = F.array(*map(F.lit, ("license_unclear", "logic_not_confirmed", "citation_range_missing", "frozen_revision_not_locatable", "obligation_basis_generic_or_missing")))
    seen = load(spark, d, "r01_readiness").groupBy("load_id").agg(F.collect_set(F.when(~F.contains("blocker", F.lit(";")), COL("blocker"))).alias("seen"))
    return seen.select("load_id", F.array_join(F.array_sort(F.array_except("seen", known)), ",").alias("misses"))


@query("SELECT record_id, NOT (source_locator IS NULL AND NOT contains(coalesce(blocker, ''), 'not_locatable')) AS uncertainty_ok, CASE WHEN load_id = (SELECT arg_max(load_id, load_seq) FROM registry_loads) THEN 'current' WHEN load_id IS NULL THEN 'unknown' ELSE load_id || '-stale' END AS generation FROM r01_candidates")
def evidence_rules(spark, d):
    silent = COL("source_locator").isNull() & ~F.contains(F.coalesce("blocker", F.lit("")), F.lit("not_locatable"))
    latest = load(spark, d, "registry_loads").agg(F.max_by("load_id", "load_seq").alias("latest"))
    generation = F.when(COL("load_id") == COL("latest"), "current").when(COL("load_id").isNull(), "unknown").otherwise(F.concat("load_id", F.lit("-stale")))
    return load(spark, d, "r01_candidates").crossJoin(F.broadcast(latest)).select("record_id", (~silent).alias("uncertainty_ok"), generation.alias("generation"))  # one row


@query("SELECT readiness_id, coalesce(sum(n), 0)::BIGINT AS n_receipts, coalesce(bool_or(c.local_catalog_key = r.local_catalog_key), false) AS bound FROM r01_readiness r LEFT JOIN (SELECT pair_id, local_catalog_key, count(*) AS n FROM r01_candidates GROUP BY 1, 2) c ON r.pair_id = c.pair_id GROUP BY readiness_id")
def slots_and_receipts(spark, d):
    """Receipts are counted per key before the join, so repeated rows don't multiply."""
    c = load(spark, d, "r01_candidates").groupBy("pair_id", COL("local_catalog_key").alias("key")).agg(F.count("*").alias("n"))
    j = load(spark, d, "r01_readiness").select("readiness_id", "pair_id", "local_catalog_key").join(c, "pair_id", "left")
    return j.groupBy("readiness_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_receipts"), F.coalesce(F.bool_or(COL("key") == COL("local_catalog_key")), F.lit(False)).alias("bound"))


_PROFILE = {"view": ("source_location", 1), "click": ("symbol", 2), "purchase": ("patch", 3), "error": ("trace", 5)}


@query("SELECT event_id, coalesce(p.evidence, 'any') AS evidence, coalesce(p.cost, 4) AS cost FROM events LEFT JOIN (VALUES ('view', 'source_location', 1), ('click', 'symbol', 2), ('purchase', 'patch', 3), ('error', 'trace', 5)) p(op, evidence, cost) ON event_type = p.op")
def operation_profile(spark, d):
    """A fixed dimension of a few rows, as a map literal; operations it hasn't get the default."""
    m = lambda i: F.create_map(*(F.lit(x) for k, v in _PROFILE.items() for x in (k, v[i])))
    return load(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(m(0), COL("event_type")), F.lit("any")).alias("evidence"), F.coalesce(F.try_element_at(m(1), COL("event_type")), F.lit(4)).alias("cost"))


@query("SELECT coalesce(a.user_id, b.user_id) AS user_id, count(*) AS steps, coalesce(bool_and(coalesce(a.event_id = b.event_id, false)), false) AS identical FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) a FULL JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_id % 211 <> 0) b ON a.user_id = b.user_id AND a.r = b.r GROUP BY 1")
def events_and_transitions(spark, d):
    """Step by step, an event and its transition; a longer side is told, not cut off."""
    e = load(spark, d, "events").select("user_id", "event_id", F.unix_micros(COL("ts").cast("timestamp")).alias("at"))
    step = lambda df, order, name: S.positioned(df, ["user_id"], order, span=S.SPAN if order == "event_id" else 1 << 40).select("user_id", "position", COL("event_id").alias(name))
    both = step(e, "event_id", "a").join(step(e.filter("event_id % 211 <> 0"), "at", "b"), ["user_id", "position"], "full_outer")
    return both.groupBy("user_id").agg(F.count("*").alias("steps"), F.every(F.coalesce(COL("a") == COL("b"), F.lit(False))).alias("identical"))


@query("SELECT event_id, printf('O-%04d', list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)) AS obligation FROM events")
def obligation_renumber(spark, d):
    at = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), COL("event_type"))
    unknown = F.raise_error(F.concat(F.lit("unknown obligation "), F.coalesce("event_type", F.lit("(null)"))))
    return load(spark, d, "events").select("event_id", F.when(at > 0, F.format_string("O-%04d", at)).otherwise(unknown).alias("obligation"))


@query("SELECT pair_id, count(*) AS n, count(*) FILTER (CASE WHEN same THEN 'reuse' ELSE 'recompute' END = 'reuse') AS reused FROM (SELECT c.pair_id, c.buggy_revision IS NOT DISTINCT FROM f.b AND c.fixed_revision IS NOT DISTINCT FROM f.x AS same FROM r01_candidates c JOIN (SELECT pair_id, arg_min(coalesce(buggy_revision, '~'), record_id) AS b0, arg_min(coalesce(fixed_revision, '~'), record_id) AS x0, nullif(b0, '~') AS b, nullif(x0, '~') AS x FROM r01_candidates GROUP BY pair_id) f ON c.pair_id = f.pair_id) GROUP BY 1")
def reuse_decision(spark, d):
    c = load(spark, d, "r01_candidates").filter("pair_id IS NOT NULL").select("pair_id", "record_id", "buggy_revision", "fixed_revision")
    first = c.groupBy("pair_id").agg(F.min_by(F.struct("buggy_revision", "fixed_revision"), "record_id").alias("f"))
    same = COL("buggy_revision").eqNullSafe(COL("f.buggy_revision")) & COL("fixed_revision").eqNullSafe(COL("f.fixed_revision"))
    return c.join(first, "pair_id").groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if(same).alias("reused"))


@query("SELECT coalesce(c.load_id, l.load_id) AS load_id, coalesce(c.n, 0) AS counted, coalesce(l.n, 0) AS listed, coalesce(c.n, 0) = coalesce(l.n, 0) AS agree FROM (SELECT load_id, count(DISTINCT pair_id) AS n FROM r01_readiness GROUP BY 1) c FULL JOIN (SELECT load_id, count(DISTINCT pair_id) AS n FROM r01_candidates GROUP BY 1) l ON c.load_id IS NOT DISTINCT FROM l.load_id")
def counts_agree(spark, d):
    """Pairs counted in the checks of a load against those its registry lists."""
    n = lambda t, name: load(spark, d, t).groupBy("load_id").agg(F.count_distinct("pair_id").alias(name))
    c, l = n("r01_readiness", "counted"), n("r01_candidates", "listed").withColumnRenamed("load_id", "l")
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return c.join(l, COL("load_id").eqNullSafe(COL("l")), "full_outer").select(F.coalesce("load_id", "l").alias("load_id"), zero("counted"), zero("listed"), (F.coalesce("counted", F.lit(0)) == F.coalesce("listed", F.lit(0))).alias("agree"))


@query("SELECT load_id, passed, failed, skipped, sha256(string_agg(h, ',' ORDER BY b)) AS ids FROM (SELECT load_id, readiness_id // 1000 AS b, sha256(string_agg(readiness_id::VARCHAR, ',' ORDER BY readiness_id)) AS h FROM r01_readiness GROUP BY 1, 2) JOIN (SELECT load_id, count(*) FILTER (ready = 'yes') AS passed, count(*) FILTER (ready = 'no') AS failed, count(*) FILTER (ready IS NULL OR ready NOT IN ('yes', 'no')) AS skipped FROM r01_readiness GROUP BY 1) USING (load_id) GROUP BY 1, 2, 3, 4")
def outcome_counts(spark, d):
    """Outcomes per load and the commitment to its ordered ids, by buckets of ids first."""
    r = load(spark, d, "r01_readiness")
    b = r.groupBy("load_id", F.floor(COL("readiness_id") / 1000).alias("b")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("readiness_id")).cast("array<string>"), ","), 256).alias("h"),
        F.count_if(COL("ready") == "yes").alias("p"), F.count_if(COL("ready") == "no").alias("f"), F.count("*").alias("n"))
    ids = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ","), 256)
    return b.groupBy("load_id").agg(F.sum("p").alias("passed"), F.sum("f").alias("failed"), (F.sum("n") - F.sum("p") - F.sum("f")).alias("skipped"), ids.alias("ids"))


@query("SELECT user_id, day, string_agg(event_type, '>' ORDER BY first) AS kinds FROM (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, min(event_id) AS first FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2")
def first_seen_distinct(spark, d):
    e = load(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.min("event_id").alias("first"))
    return e.groupBy("user_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ">").alias("kinds"))


@query("SELECT count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS in_both FROM (SELECT DISTINCT pair_id AS a FROM documents WHERE pair_id IS NOT NULL) FULL JOIN (SELECT DISTINCT pair_id AS b FROM r01_candidates WHERE pair_id IS NOT NULL) ON a = b")
def pairing_equality(spark, d):
    return R.set_comparison(load(spark, d, "documents").select("pair_id"), load(spark, d, "r01_candidates").select("pair_id"), "pair_id")


@query("SELECT count(*)::BIGINT AS outside FROM r01_candidates WHERE load_id IS NULL OR load_id NOT IN (SELECT load_id FROM registry_loads)")
def subset_check(spark, d):
    return load(spark, d, "r01_candidates").select("load_id").join(load(spark, d, "registry_loads"), "load_id", "left_anti").agg(F.count("*").alias("outside"))


@query(r"SELECT readiness_id, nullif(regexp_extract(cited_path, '([A-Za-z_]\w*)\.\w+$', 1), '') AS identifier, coalesce(nullif(trim(category_claim), ''), 'unknown') AS claim FROM r01_readiness")
def final_identifier(spark, d):
    return load(spark, d, "r01_readiness").select("readiness_id", F.nullif(F.regexp_extract("cited_path", r"([A-Za-z_]\w*)\.\w+$", 1), F.lit("")).alias("identifier"), F.coalesce(F.nullif(F.trim("category_claim"), F.lit("")), F.lit("unknown")).alias("claim"))


@query("SELECT event_id, greatest(0, floor(value - 10))::BIGINT AS latency FROM events")
def latency_floor(spark, d):
    return load(spark, d, "events").select("event_id", F.greatest(F.lit(0), F.floor(COL("value") - 10)).alias("latency"))


@query("SELECT event_type, CASE WHEN event_type = 'error' THEN 'provider' WHEN value < 5 THEN 'validation' WHEN value < 10 THEN 'context' ELSE 'none' END AS error_kind, count(*) AS n FROM events GROUP BY 1, 2")
def error_classes(spark, d):
    kind = F.when(COL("event_type") == "error", "provider").when(COL("value") < 5, "validation").when(COL("value") < 10, "context").otherwise("none")
    return load(spark, d, "events").groupBy("event_type", kind.alias("error_kind")).agg(F.count("*").alias("n"))


@query("WITH RECURSIVE x AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d')) AS n FROM events), h AS (SELECT user_id, day, r, n, sha256('|' || event_type) AS head FROM x WHERE r = 1 UNION ALL SELECT x.user_id, x.day, x.r, x.n, sha256(h.head || '|' || x.event_type) FROM h JOIN x ON x.user_id = h.user_id AND x.day = h.day AND x.r = h.r + 1) SELECT user_id, day, n, head FROM h WHERE r = n")
def episode_compile(spark, d):
    e = load(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return S.built_chain(e, ["user_id", "day"], "event_id", COL("event_type"))


@query("SELECT evidence_tier, family, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () <= 0.25 AS within_quota FROM case_catalog GROUP BY 1, 2")
def quota_table(spark, d):
    """SPEC: share of each tier and family against its quota."""
    g = load(spark, d, "case_catalog").groupBy("evidence_tier", "family").agg(F.count("*").alias("n"))
    share = COL("n") / F.sum("n").over(Window.partitionBy())  # one row per tier and family
    return g.select("evidence_tier", "family", "n", F.round(share, 6).alias("share"), (share <= 0.25).alias("within_quota"))


@query("SELECT name, round(rate, 6) AS rate, rate >= least AS passed FROM (SELECT 'versions' AS name, avg((versions_locatable = 'yes')::INT) AS rate, 0.8 AS least FROM r01_readiness UNION ALL SELECT 'license', avg((license_clear = 'yes')::INT), 0.95 FROM r01_readiness UNION ALL SELECT 'citation', avg((citation_range_exists = 'yes')::INT), 0.5 FROM r01_readiness)")
def engineering_gates(spark, d):
    """SPEC: rates against thresholds."""
    gates = {"versions": ("versions_locatable", 0.8), "license": ("license_clear", 0.95), "citation": ("citation_range_exists", 0.5)}
    rates = load(spark, d, "r01_readiness").agg(*(F.avg((COL(c) == "yes").cast("int")).alias(n) for n, (c, _) in gates.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), COL(n).alias("rate"), F.lit(t).alias("least")) for n, (_, t) in gates.items()))).alias("g")
    return rates.select(rows).select("g.name", F.round("g.rate", 6).alias("rate"), (COL("g.rate") >= COL("g.least")).alias("passed"))


# ---- functions that SQL lacks (checked by tests)


@query()
def nfkc_families(spark, d):
    from ledgerloom.functions.text import nfkc_casefold

    return load(spark, d, "r01_candidates").select("record_id", nfkc_casefold("project_family").alias("folded"))


@query()
def json_tree_bounds(spark, d):
    from ledgerloom.functions.text import json_tree_stats

    return load(spark, d, "enrichment_raw").select("raw_id", json_tree_stats("body").alias("t")).select("raw_id", "t.nodes", "t.depth", (F.coalesce(COL("t.nodes") <= 4096, F.lit(False)) & F.coalesce(COL("t.depth") <= 128, F.lit(False))).alias("in_bounds"))


@query()
def forbidden_key_paths(spark, d):
    from ledgerloom.functions.text import forbidden_key_paths as paths

    return load(spark, d, "enrichment_raw").select("raw_id", F.explode(paths({"guard_location", "prompt_sha256"})("body")).alias("key_path"))


@query()
def patch_hunks(spark, d):
    from ledgerloom.functions.patches import parse_patches

    return parse_patches(load(spark, d, "documents"), "doc_id", "text")


@query()
def contract_key_scan(spark, d):
    from ledgerloom.functions.text import contract_key_paths

    return load(spark, d, "enrichment_raw").select("raw_id", F.explode(contract_key_paths({"sha256", "guard"})("body")).alias("key_path"))


@query()
def oracle_scalars(spark, d):
    from ledgerloom.functions.text import protected_scalars

    return load(spark, d, "enrichment_raw").select("raw_id", F.explode(protected_scalars({"hypothesis", "sha256"})("body")).alias("scalar"))


@query()
def fitted_truncation(spark, d):
    from ledgerloom.functions.text import fitting_length

    return load(spark, d, "documents").select("doc_id", fitting_length(400)("text").alias("fits")).withColumn("cut", COL("fits") < 400)
