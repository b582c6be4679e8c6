"""Further queries of the evidence operators: contracts of records, consistency of tables, streams, measures, sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import canonical as C
from ledgerloom.functions import jsonwalk
from ledgerloom.functions import predicates as P
from ledgerloom.operators import leakage, measures
from ledgerloom.operators import sequence as S
from ledgerloom.plans.reference import COL, ORACLE, long, query
from ledgerloom.session import Scratch
from ledgerloom.sources import files
from ledgerloom.sources.tables import load

_READABLE = "CASE WHEN json_valid(body) THEN body END"
_NODES = f"SELECT raw_id, j.* FROM enrichment_raw, json_tree({_READABLE}) j"

# ---- walks over JSON, with the tree function of the oracle

ORACLE["json_tree_bounds"] = f"SELECT raw_id, n::INT AS nodes, d::INT AS depth, coalesce(n <= 4096 AND d <= 128, false) AS in_bounds FROM enrichment_raw LEFT JOIN (SELECT raw_id, count(*) AS n, max(1 + len(regexp_extract_all(fullkey, '[.[]'))) AS d FROM ({_NODES}) GROUP BY 1) USING (raw_id)"
ORACLE["forbidden_key_paths"] = f"SELECT raw_id, substr(fullkey, 3) AS key_path FROM ({_NODES}) WHERE lower(key) IN ('guard_location', 'prompt_sha256')"
ORACLE["contract_key_scan"] = f"SELECT raw_id, substr(fullkey, 3) AS key_path FROM ({_NODES}) WHERE NOT ends_with(fullkey, ']') AND regexp_matches(replace(lower(key), '-', '_'), 'sha256|guard')"
ORACLE["oracle_scalars"] = f"SELECT DISTINCT raw_id, atom->>'$' AS scalar FROM ({_NODES}) WHERE type = 'VARCHAR' AND regexp_matches(lower(fullkey), 'hypothesis|sha256')"
ORACLE["fitted_truncation"] = "SELECT doc_id, fits::INT AS fits, fits < 400 AS cut FROM (SELECT doc_id, CASE WHEN text IS NOT NULL THEN (SELECT count(*) FROM range(1, length(text) + 1) r(i) WHERE i <= 400 AND octet_length(encode(to_json(left(text, i)::VARCHAR)::VARCHAR)) <= 400) END AS fits FROM documents)"


@query(f"SELECT raw_id, CASE WHEN json_valid(body) THEN coalesce(n, 0) END AS n_forbidden FROM enrichment_raw LEFT JOIN (SELECT raw_id, count(*) AS n FROM ({_NODES}) WHERE NOT ends_with(fullkey, ']') AND key IN ('provider', 'model', 'prompt_sha256') GROUP BY 1) USING (raw_id)")
def forbidden_key_scan(spark, d):
    """Exact keys anywhere in the record, whatever blanks stand around them."""
    return load(spark, d, "enrichment_raw").select("raw_id", jsonwalk.key_count({"provider", "model", "prompt_sha256"})("body").alias("n_forbidden"))


@query(f"SELECT raw_id, octet_length(encode(body)) AS bytes, s AS longest_string, l AS longest_list, i AS longest_inner_list, coalesce(octet_length(encode(body)) <= 1048576 AND s <= 8192 AND l <= 256 AND i <= 64, false) AS in_bounds FROM enrichment_raw LEFT JOIN (SELECT raw_id, coalesce(max(octet_length(encode(atom->>'$'))) FILTER (type = 'VARCHAR'), 0) AS s, coalesce(max(json_array_length(value)) FILTER (type = 'ARRAY' AND fullkey <> '$'), 0) AS l, coalesce(max(json_array_length(value)) FILTER (type = 'ARRAY' AND contains(fullkey, '[')), 0) AS i FROM ({_NODES}) GROUP BY 1) USING (raw_id)")
def payload_bounds(spark, d):
    x = load(spark, d, "enrichment_raw").select("raw_id", long(F.octet_length("body")).alias("bytes"), jsonwalk.json_sizes("body").alias("s")).select("raw_id", "bytes", "s.*")
    ok = (COL("bytes") <= 1 << 20) & (COL("longest_string") <= 8192) & (COL("longest_list") <= 256) & (COL("longest_inner_list") <= 64)
    return x.withColumn("in_bounds", F.coalesce(ok, F.lit(False)))


# ---- records

_LISTS = ("invalid_locations", "invalid_trace_locations", "invalid_goals", "invalid_operations", "invalid_target_kinds", "invalid_tool_classes")
_EMPTY = " AND ".join(f"json_array_length(body, '$.validation.{c}') = 0" for c in _LISTS)


@query(f"SELECT raw_id, CASE WHEN json_valid(body) THEN coalesce((body->'$.validation.valid')::VARCHAR = 'true' AND (body->'$.validation.family_mismatch')::VARCHAR = 'false' AND {_EMPTY}, false) END AS clean FROM enrichment_raw")
def clean_validation(spark, d):
    """All flags false and all lists of faults empty; what is missing isn't clean. Parsed once a line."""
    x = load(spark, d, "enrichment_raw").select("raw_id", F.try_variant_get(F.try_parse_json("body"), "$", "variant").alias("v"))
    flag = lambda c, want: F.to_json(F.try_variant_get("v", f"$.validation.{c}", "variant")) == want
    clean = flag("valid", "true") & flag("family_mismatch", "false")
    for c in _LISTS:
        clean = clean & (F.size(F.try_variant_get("v", f"$.validation.{c}", "array<variant>")) == 0)
    return x.select("raw_id", F.when(COL("v").isNotNull(), F.coalesce(clean, F.lit(False))).alias("clean"))


_FIELD = "CASE WHEN json_valid(body) THEN body->>'$.{0}' END"


@query(f"""WITH r AS (SELECT raw_id, file_name, line_no, {_FIELD.format('case_id')} AS case_id, {_FIELD.format('source_context_sha256')} AS context, {_FIELD.format('model')} AS model, {_FIELD.format('requested_model')} AS requested, {_FIELD.format('provider_response_model')} AS answered, TRY_CAST({_FIELD.format('max_tokens')} AS BIGINT) AS tokens FROM enrichment_raw),
now AS (SELECT case_id, arg_max(coalesce(context, '~'), (file_name, line_no)) AS latest FROM r WHERE case_id IS NOT NULL GROUP BY 1)
SELECT raw_id, concat_ws(';', CASE WHEN NOT coalesce(context = latest, false) THEN 'context' END, CASE WHEN NOT coalesce(model = requested AND model = answered, false) THEN 'model' END, CASE WHEN NOT coalesce(tokens <= 4096, false) THEN 'max_tokens' END) AS stale FROM r JOIN now USING (case_id)""")
def record_currency(spark, d):
    """Whether a committed record is still current: its context is the case's latest, and it was made as asked for."""
    v = load(spark, d, "enrichment_raw").select("raw_id", "file_name", "line_no", F.try_parse_json("body").alias("v"))
    get = lambda c, t="string": F.try_variant_get("v", f"$.{c}", t)
    r = v.select("raw_id", "file_name", "line_no", get("case_id").alias("case_id"), get("source_context_sha256").alias("context"), get("model").alias("model"), get("requested_model").alias("requested"), get("provider_response_model").alias("answered"), get("max_tokens", "bigint").alias("tokens")).filter("case_id IS NOT NULL")
    now = r.groupBy("case_id").agg(F.max_by(F.coalesce("context", F.lit("~")), F.struct("file_name", "line_no")).alias("latest"))
    stale = P.failing(context=COL("context") == COL("latest"), model=(COL("model") == COL("requested")) & (COL("model") == COL("answered")), max_tokens=COL("tokens") <= 4096)
    return r.join(now, "case_id").select("raw_id", stale.alias("stale"))


_RANKS = {"metadata_only": 0, "evidence_draft": 1, "source_resolved": 2, "excluded": 3}


@query("SELECT record_id, before, status, coalesce(status IN ('metadata_only', 'evidence_draft', 'source_resolved', 'excluded'), false) AND NOT coalesce(before = 'excluded' AND status <> 'excluded', false) AS legal FROM (SELECT record_id, status, lag(status) OVER (PARTITION BY pair_id ORDER BY record_id) AS before FROM r01_candidates)")
def status_transitions(spark, d):
    """Rows made by machine have one of four statuses (never one that a person gives), and what is excluded stays so."""
    c = S.positioned(load(spark, d, "r01_candidates").select("record_id", "pair_id", "status"), ["pair_id"], "record_id", previous={"before": COL("status")})
    back = F.coalesce((COL("before") == "excluded") & (COL("status") != "excluded"), F.lit(False))
    return c.select("record_id", "before", "status", (F.coalesce(COL("status").isin(*_RANKS), F.lit(False)) & ~back).alias("legal"))


@query("SELECT record_id, 'EP-' || left(sha256('{\"case\":\"' || coalesce(lower(trim(local_catalog_key)), '') || '\",\"record\":' || record_id || ',\"version\":\"1.0\"}'), 32) AS episode_id FROM r01_candidates")
def episode_ids(spark, d):
    c = load(spark, d, "r01_candidates")
    body = C.canonical_json(case=F.coalesce(F.lower(F.trim("local_catalog_key")), F.lit("")), record="record_id", version=F.lit("1.0"))
    return c.select("record_id", C.opaque_id("EP-", body, 32).alias("episode_id"))


_KINDS = ("authorization", "source_to_sink")


@query("SELECT catalog_row, sha256('{\"context\":{\"family\":' || coalesce('\"' || family || '\"', 'null') || ',\"tier\":' || coalesce('\"' || evidence_tier || '\"', 'null') || '},\"flags\":{\"repair\":false,\"strict\":true},\"vocabulary\":[\"authorization\",\"source_to_sink\"]}') AS request_sha FROM case_catalog")
def request_envelopes(spark, d):
    """The request of a case as canonical JSON (context, sorted vocabulary, flags); only its hash is kept."""
    context = F.struct(COL("family").alias("family"), COL("evidence_tier").alias("tier"))
    body = F.struct(context.alias("context"), F.struct(F.lit(False).alias("repair"), F.lit(True).alias("strict")).alias("flags"), F.array(*map(F.lit, _KINDS)).alias("vocabulary"))
    return load(spark, d, "case_catalog").select("catalog_row", F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256).alias("request_sha"))


# ---- consistency of several tables


@query(f"""WITH ids AS (SELECT DISTINCT nullif(lower(trim(local_catalog_key)), '') AS key FROM r01_readiness WHERE nullif(lower(trim(local_catalog_key)), '') IS NOT NULL),
rec AS (SELECT lower(trim({_FIELD.format('case_id')})) AS key, arg_max({_FIELD.format('payload.family')}, (file_name, line_no)) AS family FROM enrichment_raw GROUP BY 1),
cat AS (SELECT lower(trim(case_id)) AS key, min(family) AS lo, max(family) AS hi, bool_or(removed_at IS NULL) AS live FROM case_catalog GROUP BY 1)
SELECT key, CASE WHEN rec.key IS NULL THEN 'no_record' WHEN cat.key IS NULL THEN 'no_context' WHEN NOT live THEN 'removed' WHEN coalesce(family IN (lo, hi), false) THEN 'ok' ELSE 'other_family' END AS status FROM ids LEFT JOIN rec USING (key) LEFT JOIN cat USING (key)""")
def requested_chain(spark, d):
    """Requested ids, their committed records and the current catalog: a miss at either step is a row with its reason."""
    ids = load(spark, d, "r01_readiness").select(F.nullif(F.lower(F.trim("local_catalog_key")), F.lit("")).alias("key")).filter("key IS NOT NULL").distinct()
    v = load(spark, d, "enrichment_raw").select("file_name", "line_no", F.try_parse_json("body").alias("v"))
    get = lambda p: F.try_variant_get("v", p, "string")
    rec = v.groupBy(F.lower(F.trim(get("$.case_id"))).alias("key")).agg(F.max_by(get("$.payload.family"), F.when(get("$.payload.family").isNotNull(), F.struct("file_name", "line_no"))).alias("family"), F.lit(1).alias("r"))
    cat = load(spark, d, "case_catalog").groupBy(F.lower(F.trim("case_id")).alias("key")).agg(F.min("family").alias("lo"), F.max("family").alias("hi"), F.bool_or(COL("removed_at").isNull()).alias("live"), F.lit(1).alias("c"))
    same = F.coalesce(COL("family").isin(COL("lo"), COL("hi")), F.lit(False))
    status = F.when(COL("r").isNull(), "no_record").when(COL("c").isNull(), "no_context").when(~COL("live"), "removed").when(same, "ok").otherwise("other_family")
    return ids.join(rec, "key", "left").join(cat, "key", "left").select("key", status.alias("status"))


@query("SELECT load_id, s.load_id IS NOT NULL AS in_state, coalesce(r.n, 0) AS n_report, coalesce(m.n, 0) AS n_manifest, coalesce(r.pairs, 0) AS report_pairs, coalesce(m.pairs, 0) AS manifest_pairs, s.load_id IS NOT NULL AND r.n IS NOT NULL AND m.n IS NOT NULL AND m.pairs <= r.pairs AS consistent FROM registry_loads s FULL JOIN (SELECT load_id, count(*) AS n, count(DISTINCT pair_id) AS pairs FROM r01_candidates WHERE load_id IS NOT NULL GROUP BY 1) r USING (load_id) FULL JOIN (SELECT load_id, count(*) AS n, count(DISTINCT pair_id) AS pairs FROM r01_readiness WHERE load_id IS NOT NULL GROUP BY 1) m USING (load_id)")
def three_way_consistency(spark, d):
    """State, report and manifest of a load: all there, and none speaks of more pairs than the report knows."""
    part = lambda t, n: load(spark, d, t).filter("load_id IS NOT NULL").groupBy("load_id").agg(F.count("*").alias(f"n_{n}"), F.count_distinct("pair_id").alias(f"{n}_pairs"))
    x = load(spark, d, "registry_loads").select("load_id", F.lit(True).alias("s")).join(part("r01_candidates", "report"), "load_id", "full_outer").join(part("r01_readiness", "manifest"), "load_id", "full_outer")
    ok = COL("s").isNotNull() & COL("n_report").isNotNull() & COL("n_manifest").isNotNull() & (COL("manifest_pairs") <= COL("report_pairs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.select("load_id", COL("s").isNotNull().alias("in_state"), *map(zero, ("n_report", "n_manifest", "report_pairs", "manifest_pairs")), F.coalesce(ok, F.lit(False)).alias("consistent"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 97 <> 0 GROUP BY 1, 2) SELECT user_id, count(*) AS kinds, count(*) FILTER (c.n IS DISTINCT FROM m.n) AS differing FROM c FULL JOIN m USING (user_id, event_type) GROUP BY 1")
def counts_against_manifest(spark, d):
    """Event counts per kind against a manifest's map, which was made before some events came; kinds missing on a side differ."""
    e = load(spark, d, "events")
    manifest = e.filter("event_id % 97 <> 0").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("listed"))
    counted = e.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "count"))).alias("counted"))
    kinds = F.array_union(F.coalesce(F.map_keys("counted"), F.array().cast("array<string>")), F.coalesce(F.map_keys("listed"), F.array().cast("array<string>")))
    differ = F.size(F.filter("kinds", lambda k: ~F.try_element_at("counted", k).eqNullSafe(F.try_element_at("listed", k))))
    return counted.join(manifest, "user_id", "full_outer").withColumn("kinds", kinds).select("user_id", long(F.size("kinds")).alias("kinds"), long(differ).alias("differing"))


@query("SELECT pair_id, n AS attempts, CASE last WHEN 'source_resolved' THEN 'reuse' WHEN 'excluded' THEN 'quarantine' WHEN 'evidence_draft' THEN 'finalise' ELSE CASE WHEN n >= 2 THEN 'exhausted' ELSE 'retry' END END AS action FROM (SELECT pair_id, count(*) AS n, arg_max(coalesce(status, ''), record_id) AS last FROM r01_candidates WHERE pair_id IS NOT NULL GROUP BY 1)")
def resume_plan(spark, d):
    """What a restart does with each case: reuse what is done, finalise an interrupted slot, else another of two slots."""
    g = load(spark, d, "r01_candidates").filter("pair_id IS NOT NULL").groupBy("pair_id").agg(F.count("*").alias("attempts"), F.max_by(F.coalesce("status", F.lit("")), "record_id").alias("last"))
    action = F.when(COL("last") == "source_resolved", "reuse").when(COL("last") == "excluded", "quarantine").when(COL("last") == "evidence_draft", "finalise").when(COL("attempts") >= 2, "exhausted").otherwise("retry")
    return g.select("pair_id", "attempts", action.alias("action"))


# ---- streams and state machines over whole sequences


@query("WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lead(event_id) OVER w IS NULL AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS answers, count(*) FILTER (before = 'purchase' AND event_type <> 'signup' OR before IS NULL AND event_type <> 'view' OR event_type = 'error') AS violations, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'provider_failure' WHEN count(*) FILTER (event_type = 'purchase') <> 1 THEN 'ambiguous_answer' WHEN count(*) FILTER (before = 'purchase' AND event_type <> 'signup' OR before IS NULL AND event_type <> 'view') > 0 THEN 'invalid_order' WHEN bool_or(last AND event_type <> 'signup') THEN 'incomplete' ELSE 'completed' END AS outcome FROM x GROUP BY 1")
def stream_phases(spark, d):
    """Phases of a provider's event stream: it begins, answers exactly once, and nothing but the close follows the answer.

    The phase is told by the event before, so a whole sequence is checked row by row and no task folds a hot key.
    """
    e = S.positioned(load(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", previous={"before": COL("event_type")}, following={"after": COL("event_id")})
    kind = COL("event_type")
    order = F.coalesce((COL("before") == "purchase") & (kind != "signup"), F.lit(False)) | (COL("before").isNull() & (kind != "view"))
    g = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(kind == "purchase").alias("answers"), F.count_if(order | (kind == "error")).alias("violations"), F.count_if(order).alias("_o"), F.count_if(kind == "error").alias("_e"), F.bool_or(COL("after").isNull() & (kind != "signup")).alias("_i"))
    outcome = F.when(COL("_e") > 0, "provider_failure").when(COL("answers") != 1, "ambiguous_answer").when(COL("_o") > 0, "invalid_order").when(COL("_i"), "incomplete").otherwise("completed")
    return g.select("user_id", "n", "answers", "violations", outcome.alias("outcome"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT DISTINCT user_id, 0::BIGINT AS r, n, 4 AS budget, 0 AS reads, 0 AS support, 0 AS counter, 1 AS unknowns, 'open' AS status, NULL::VARCHAR AS terminal, NULL::VARCHAR AS reason FROM e
UNION ALL SELECT s.user_id, s.r + 1, s.n, s.budget - 1, s.reads + 1, s.support + (e.event_type IN ('view', 'signup'))::INT, s.counter + (e.event_type IN ('click'))::INT, CASE WHEN e.event_type = 'click' THEN s.unknowns + 1 WHEN e.event_type = 'view' THEN greatest(0, s.unknowns - 1) ELSE s.unknowns END,
CASE e.event_type WHEN 'signup' THEN 'supported' WHEN 'click' THEN CASE WHEN s.status = 'supported' THEN 'refuted' ELSE s.status END WHEN 'error' THEN 'unresolved' ELSE s.status END,
CASE e.event_type WHEN 'purchase' THEN CASE WHEN s.status IN ('supported', 'refuted') THEN 'FINISH' ELSE 'UNRESOLVED' END WHEN 'error' THEN 'UNRESOLVED' END, CASE e.event_type WHEN 'purchase' THEN CASE WHEN s.status IN ('supported', 'refuted') THEN NULL ELSE 'insufficient_material' END WHEN 'error' THEN 'contradiction' END
FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1 WHERE s.terminal IS NULL AND s.budget > 0),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS k FROM s) WHERE k = 1)
SELECT user_id, reads, support, counter, unknowns, CASE WHEN terminal = 'FINISH' THEN status ELSE 'unresolved' END AS status, coalesce(terminal, 'UNRESOLVED') AS terminal, CASE WHEN terminal IS NULL THEN CASE WHEN budget = 0 THEN 'budget_exhausted' ELSE 'insufficient_material' END ELSE reason END AS reason FROM z""")
def evidence_replay(spark, d):
    """Budgeted replay with hypothesis state: evidence is read in order, updates the hypothesis and may end the case.

    The budget is tested before each read; a script that ends without a terminal is unresolved, by the budget or for
    want of material; a case that finishes undecided is unresolved, and an exhausted budget takes decisions back.
    """
    kind = COL("event_type")
    update = S.evidence_update(
        support=F.when(kind.isin("view", "signup"), 1), counter=F.when(kind == "click", 1), unknown=F.when(kind == "click", 1).when(kind == "view", -1),
        status=F.when(kind == "signup", "supported").when(kind == "error", "unresolved"), revision=F.when(kind == "click", "refuted"),
        terminal=F.when(kind == "purchase", "FINISH").when(kind == "error", "UNRESOLVED"), reason=F.when(kind == "error", "contradiction"))
    return S.evidence_replay(load(spark, d, "events"), ["user_id"], "event_id", update, budget=4, unknowns=1)


# ---- leakage


@query("""WITH v AS (SELECT DISTINCT lower(trim(x)) AS value FROM (SELECT unnest([repository.upstream_id, repository.fixed_commit, artifacts.patch_path, artifacts.poc_url, views.oracle_view_path, case_id, left(repository.fixed_commit, 10)]) AS x FROM case_catalog)),
a AS (SELECT DISTINCT lower(trim(x)) AS value FROM (SELECT CASE WHEN evidence_tier = 'T1' AND catalog_row % 8 = 0 THEN repository.upstream_id END AS x FROM case_catalog UNION ALL SELECT repository.vulnerable_commit FROM case_catalog)),
s AS (SELECT value FROM v WHERE value <> '' AND value NOT IN (SELECT value FROM a WHERE value IS NOT NULL)), t AS (SELECT doc_id, lower(trim(text)) AS t FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, sha256(value) AS secret_sha FROM t JOIN s ON CASE WHEN octet_length(encode(value)) >= 8 THEN contains(t, value) ELSE t = value END""")
def leakage_substring(spark, d):
    """Protected values of the catalog (also abbreviated commits) inside texts, minus what is allowed (some projects, and the
    commits that a policy may see); hits are hashed."""
    k = load(spark, d, "case_catalog")
    column = lambda cols: k.select(F.explode(F.array(*cols)).alias("value"))
    values = column([COL("repository.upstream_id"), COL("repository.fixed_commit"), COL("artifacts.patch_path"), COL("artifacts.poc_url"), COL("views.oracle_view_path"), COL("case_id"), F.left("repository.fixed_commit", F.lit(10))])
    public = F.when((COL("evidence_tier") == "T1") & (COL("catalog_row") % 8 == 0), COL("repository.upstream_id"))
    allowed = column([public, COL("repository.vulnerable_commit")])
    texts = load(spark, d, "documents").select(COL("doc_id").alias("id"), "text")
    return leakage.contained_values(texts, values, allowed).select(COL("id").alias("doc_id"), F.sha2("value", 256).alias("secret_sha"))


# ---- specified measures


@query("SELECT event_id, round(CASE event_type WHEN 'purchase' THEN 1.5 WHEN 'signup' THEN 1.0 WHEN 'click' THEN 0.3 WHEN 'error' THEN -1.0 ELSE 0 END - (0.05 + 0.00001 * CAST(json_extract_string(props, '$.k') AS BIGINT) + 0.001 * value), 6) AS reward FROM events")
def reward_arithmetic(spark, d):
    """SPEC: process rewards less the normalised cost of tokens, tool calls and seconds."""
    gain = F.when(COL("event_type") == "purchase", 1.5).when(COL("event_type") == "signup", 1.0).when(COL("event_type") == "click", 0.3).when(COL("event_type") == "error", -1.0).otherwise(0.0)
    tokens = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return load(spark, d, "events").select("event_id", F.round(measures.reward(gain, tokens=tokens, tool_calls=F.lit(1), wall_seconds=COL("value")), 6).alias("reward"))


@query("WITH r AS (SELECT o_custkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS ideal FROM orders) SELECT k AS o_custkey, round(coalesce(sum(g / log2(r + 1)) FILTER (r <= 10) / nullif(sum(g / log2(ideal + 1)) FILTER (ideal <= 10), 0), 0), 6) AS ndcg10, round(coalesce(sum(g) FILTER (r <= 3) / nullif(sum(g), 0), 0), 6) AS recall3, coalesce(max(g) FILTER (r = 1), 0)::INT AS top1 FROM r GROUP BY 1")
def ranking_metrics(spark, d):
    """SPEC: NDCG, recall and top-1 of a ranking per group."""
    o = load(spark, d, "orders").select("o_custkey", F.when(COL("o_orderstatus") == "F", 1).otherwise(0).alias("gain"), "o_totalprice", "o_orderkey")
    return measures.ranking(o, "o_custkey", "gain", [F.desc("o_totalprice"), COL("o_orderkey")], ndcg=10, recall=3)


@query("WITH x AS (SELECT l_discount AS p, (l_returnflag = 'R')::INT AS y FROM lineitem), h AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY 1), b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS c, avg(y) AS f FROM x GROUP BY 1) SELECT (SELECT round(avg((p - y) * (p - y)), 6) FROM x) AS brier, (SELECT round(sum(n * abs(c - f)) / sum(n), 6) FROM b) AS ece, (SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM h)) AS auc")
def calibration_metrics(spark, d):
    """SPEC: Brier score, expected calibration error and AUC of a score against labels."""
    x = load(spark, d, "lineitem").select(COL("l_discount").alias("p"), F.when(COL("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return measures.calibration(x, "p", "y", bins=10)


_U = "('0x' || left(sha256(coalesce(project_family, '~') || '|' || b), 8))::BIGINT / 4294967296.0"
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563)


@query(f"WITH c AS (SELECT project_family, count(*) AS n, count(*) FILTER (status = 'source_resolved') AS k FROM r01_candidates GROUP BY 1), w AS (SELECT b, n, k, {_U} AS u FROM c, range(200) t(b)), s AS (SELECT b, sum(k * m) / sum(n * m) AS rate FROM (SELECT *, {' + '.join(f'(u >= {x})::INT' for x in _POISSON)} AS m FROM w) GROUP BY 1) SELECT round(min(rate) FILTER (r = 5), 6) AS low, round(min(rate) FILTER (r = 195), 6) AS high, (SELECT round(sum(k) / sum(n), 6) FROM c) AS rate, count(*) AS replicates FROM (SELECT rate, row_number() OVER (ORDER BY rate) AS r FROM s)")
def bootstrap_interval(spark, d):
    """SPEC: confidence interval by resampling whole families (seeded, with Poisson weights: no row is gathered)."""
    c = load(spark, d, "r01_candidates").groupBy("project_family").agg(F.count("*").alias("n"), F.count_if(COL("status") == "source_resolved").alias("k"))
    return measures.cluster_bootstrap(c, "project_family", "k", "n", replicates=200, low=5, high=195)


# ---- sources and sinks: files written from the tables and read again under their contracts


def _lines(df, *columns):
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


@query("SELECT record_id, pair_id, project_family, split FROM r01_candidates")
def registry_jsonl_scan(spark, d):
    """Strict JSON lines with a unique key."""
    path = Scratch(spark, "registry").path("lines")
    _lines(load(spark, d, "r01_candidates"), "record_id", "pair_id", "project_family", "split").write.text(path)
    return files.strict_jsonl(spark, path, "record_id bigint, pair_id string, project_family string, split string", "record_id")


@query("SELECT catalog_row, case_id, repository.fixed_commit AS fixed_commit, len(artifacts.test_paths) AS n_tests FROM case_catalog")
def catalog_jsonl_scan(spark, d):
    """Strict JSON lines of a nested schema."""
    path, k = Scratch(spark, "catalog").path("lines"), load(spark, d, "case_catalog")
    cols = ["catalog_row", "case_id", "repository", "artifacts"]
    _lines(k, *cols).write.text(path)
    back = files.strict_jsonl(spark, path, k.select(*cols).schema)
    return back.select("catalog_row", "case_id", COL("repository.fixed_commit").alias("fixed_commit"), long(F.size("artifacts.test_paths")).alias("n_tests"))


@query("SELECT readiness_id::VARCHAR AS readiness_id, coalesce(pair_id, '') AS pair_id, CASE WHEN ready IN ('yes', 'no') THEN ready ELSE 'unknown' END AS ready FROM r01_readiness")
def checked_csv_scan(spark, d):
    """CSV with an exact header and a value domain; all values stay strings."""
    path = Scratch(spark, "csv").path("rows")
    ready = F.when(COL("ready").isin("yes", "no"), COL("ready")).otherwise("unknown")
    load(spark, d, "r01_readiness").select("readiness_id", F.coalesce("pair_id", F.lit("")).alias("pair_id"), ready.alias("ready")).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    out = files.checked_csv(spark, path, ["readiness_id", "pair_id", "ready"], exact=True, domains={"ready": ["yes", "no", "unknown"]})
    return out.select("readiness_id", F.coalesce("pair_id", F.lit("")).alias("pair_id"), "ready")


@query("SELECT load_id AS id, row_number() OVER (ORDER BY load_seq) AS place FROM registry_loads")
def frozen_id_list(spark, d):
    """An ordered id list with comments and blanks, read in order."""
    path = Scratch(spark, "ids").path("list")
    load(spark, d, "registry_loads").orderBy("load_seq").agg(F.concat(F.lit("# loads\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("load_seq", "load_id"))), lambda x: F.concat(F.lit(" "), x["load_id"], F.lit(" # a load"))), "\n")).alias("value")).coalesce(1).write.text(path)  # the fixed loads
    ids = files.id_list(spark, path, r"load-\d+")
    return ids.select("id", long(F.row_number().over(Window.orderBy("position"))).alias("place"))  # a list of ids


@query("SELECT file_name, count(*) AS n_lines, count(*) FILTER (json_valid(body)) AS n_valid, count(*) <= 30 AND bool_and(json_valid(body)) AS accepted FROM enrichment_raw GROUP BY 1")
def bounded_event_files(spark, d):
    """Files of event lines: within a number of lines, and every line readable, or the file is refused."""
    e = load(spark, d, "enrichment_raw").groupBy("file_name")
    ok = F.try_parse_json("body").isNotNull()
    return e.agg(F.count("*").alias("n_lines"), F.count_if(ok).alias("n_valid"), ((F.count("*") <= 30) & F.every(ok)).alias("accepted"))


@query("SELECT count(*) AS n_rows, 'o_custkey,o_orderkey,o_totalprice' AS columns, true AS as_declared, 'zstd' AS codec FROM orders")
def parquet_write_and_check(spark, d):
    """Parquet written, read back and compared; then its files' footers against the declared columns and limits."""
    path = Scratch(spark, "sink").path("rows")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    files.write_verified(o, path)
    f = files.parquet_footers(spark, path)
    ok = (F.size("columns") == 3) & (COL("row_groups") >= 1)
    return f.agg(F.sum("n_rows").alias("n_rows"), F.array_join(F.array_sort(F.flatten(F.collect_set("columns"))), ",").alias("columns"), F.every(F.coalesce(ok, F.lit(False))).alias("as_declared"), F.max("codec").alias("codec"))


@query("SELECT event_id, event_type, user_id FROM events")
def jsonl_write_and_check(spark, d):
    """JSON lines of one kind, written, read back and compared."""
    return files.write_verified(load(spark, d, "events").select("event_id", "event_type", "user_id"), Scratch(spark, "sink").path("lines"), "json")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not_allowed' WHEN text IS NULL THEN 'missing' WHEN doc_id % 7 = 0 THEN 'altered' ELSE 'ok' END AS state, CASE WHEN doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN length(text) END AS chars FROM documents")
def evidence_integrity(spark, d):
    """Evidence bodies against recorded hashes (some records are of other bodies), after the allow-list."""
    x = load(spark, d, "documents").select("doc_id", COL("text").cast("binary").alias("content"), (COL("doc_id") % 5 != 0).alias("allowed"), F.sha2(F.when(COL("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(COL("text")), 256).alias("content_sha256"))
    return files.integrity(x).select("doc_id", "state", long(F.length("text")).alias("chars"))


@query("SELECT record_id, coalesce(n, 0) AS n_blobs, coalesce(bytes, 0)::BIGINT AS bytes, n IS NOT NULL AS found, coalesce(bytes > 4096, false) AS too_large FROM r01_candidates LEFT JOIN (SELECT pair_id, count(*) AS n, sum(octet_length(encode(text))) AS bytes FROM documents WHERE text IS NOT NULL AND pair_id IS NOT NULL GROUP BY 1) USING (pair_id)")
def blob_lookup(spark, d):
    """Requests against a table of blobs by key: whether there are any, and whether they may be read."""
    blobs = load(spark, d, "documents").filter("text IS NOT NULL AND pair_id IS NOT NULL").groupBy("pair_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    x = load(spark, d, "r01_candidates").select("record_id", "pair_id").join(blobs, "pair_id", "left")
    return x.select("record_id", F.coalesce("n", F.lit(0)).alias("n_blobs"), F.coalesce("bytes", F.lit(0)).alias("bytes"), COL("n").isNotNull().alias("found"), F.coalesce(COL("bytes") > 4096, F.lit(False)).alias("too_large"))


@query("SELECT op, count(*) AS requests, count(*) FILTER (doc_id % 10 <> 0) AS replayed, count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 23 = 0) AS differing, 0::BIGINT AS repeated_keys FROM documents, (VALUES ('size'), ('sha')) t(op) GROUP BY 1")
def capture_and_replay(spark, d):
    """Recorded results of operations: replayed by unique key, and verified by running the operation again."""
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    run = F.explode(F.array(F.struct(F.lit("size").alias("op"), F.octet_length("text").cast("string").alias("result")), F.struct(F.lit("sha").alias("op"), F.sha2("text", 256).alias("result")))).alias("x")
    now = docs.select(COL("doc_id").alias("args"), run).select("args", "x.*")
    captured = now.filter("args % 10 <> 0").withColumn("result", F.when(COL("args") % 23 == 0, F.concat("result", F.lit("?"))).otherwise(COL("result")))
    return files.replayed(now, captured, ["op", "args"], "result", by="op")


@query(r"SELECT readiness_id, regexp_matches(cited_path, '^[^/]+/src/(main|test)/[^/]+/[A-Z]\w*\.java$') AS follows, nullif(regexp_extract(cited_path, '^([^/]+)/src/(main|test)/([^/]+)/([A-Z]\w*)\.java$', 1), '') AS module, nullif(regexp_extract(cited_path, '^([^/]+)/src/(main|test)/([^/]+)/([A-Z]\w*)\.java$', 4), '') AS class FROM r01_readiness")
def grammar_paths(spark, d):
    """Paths of a directory grammar taken apart; those that don't follow it are marked."""
    rx = r"^([^/]+)/src/(main|test)/([^/]+)/([A-Z]\w*)\.java$"
    part = lambda i: F.nullif(F.regexp_extract("cited_path", rx, i), F.lit(""))
    return load(spark, d, "r01_readiness").select("readiness_id", COL("cited_path").rlike(rx).alias("follows"), part(1).alias("module"), part(4).alias("class"))


@query("WITH f AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE text IS NOT NULL), a AS (SELECT path // 512 AS b, sha256(string_agg(path || chr(10) || h, chr(10) ORDER BY path)) AS h FROM f GROUP BY 1), c AS (SELECT b // 512 AS b, sha256(string_agg(b || chr(10) || h, chr(10) ORDER BY b)) AS h FROM a GROUP BY 1) SELECT sha256(string_agg(b || chr(10) || h, chr(10) ORDER BY b)) AS digest FROM c")
def tree_material_hash(spark, d):
    """One digest of all files in order of their paths, level by level, so that no task holds more than a level's bucket."""
    f = load(spark, d, "documents").filter("text IS NOT NULL").select(COL("doc_id").alias("path"), F.sha2("text", 256).alias("h"))
    return S.level_digest(f, "path", "h", levels=2)


@query(f"WITH r AS (SELECT raw_id, sha256(json_array({_FIELD.format('provider')}, {_FIELD.format('model')}, {_FIELD.format('prompt_sha256')})::VARCHAR) AS key, {_FIELD.format('prompt_sha256')} AS prompt FROM enrichment_raw), f AS (SELECT key, min(raw_id) AS first FROM r WHERE prompt IS NOT NULL GROUP BY 1) SELECT raw_id, key, first < raw_id AS cached FROM r JOIN f USING (key) WHERE prompt IS NOT NULL")
def response_cache(spark, d):
    """The cache key of each call (canonical provider, model and request) and whether an earlier call answers it."""
    v = load(spark, d, "enrichment_raw").select("raw_id", F.try_parse_json("body").alias("v"))
    get = lambda c: F.try_variant_get("v", f"$.{c}", "string")
    r = v.filter(get("prompt_sha256").isNotNull()).select("raw_id", F.sha2(F.to_json(F.array(get("provider"), get("model"), get("prompt_sha256"))), 256).alias("key"))
    return r.join(r.groupBy("key").agg(F.min("raw_id").alias("first")), "key").select("raw_id", "key", (COL("first") < COL("raw_id")).alias("cached"))


@query("SELECT '| load | rows |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || load_id || ' | ' || n || ' |', chr(10) ORDER BY load_id) AS markdown FROM (SELECT load_id, count(*) AS n FROM r01_candidates WHERE load_id IS NOT NULL GROUP BY 1)")
def markdown_report(spark, d):
    """A small report as a Markdown table, rows in order."""
    g = load(spark, d, "r01_candidates").filter("load_id IS NOT NULL").groupBy("load_id").agg(F.count("*").alias("n"))
    row = F.concat(F.lit("| "), "load_id", F.lit(" | "), COL("n").cast("string"), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("load_id", row.alias("row")))), lambda x: x["row"])  # the fixed loads
    return g.agg(F.concat(F.lit("| load | rows |\n| --- | --- |\n"), F.array_join(rows, "\n")).alias("markdown"))


# ---- further forms


@query("SELECT record_id, CASE WHEN late THEN 'time_ood_test' WHEN b < 8 THEN 'train' WHEN b = 8 THEN 'dev' ELSE 'test' END AS split FROM (SELECT record_id, coalesce(max(registered_at) OVER (PARTITION BY project_family) >= (SELECT max(started_at) FROM registry_loads WHERE load_seq <= 8), false) AS late, ('0x' || left(sha256(coalesce(project_family, 'r' || record_id)), 8))::BIGINT % 10 AS b FROM r01_candidates)")
def date_first_split(spark, d):
    """SPEC: families with a record after the cutoff go to the time test whole, the others by a hash of the family."""
    c = load(spark, d, "r01_candidates").select("record_id", "project_family", "registered_at")
    cutoff = load(spark, d, "registry_loads").filter("load_seq <= 8").agg(F.max("started_at").alias("cutoff"))
    last = c.groupBy("project_family").agg(F.max("registered_at").alias("last")).crossJoin(F.broadcast(cutoff)).select(COL("project_family").alias("f"), F.coalesce(COL("last") >= COL("cutoff"), F.lit(False)).alias("late"))  # one row
    key = F.coalesce("project_family", F.concat(F.lit("r"), COL("record_id").cast("string")))
    b = F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("bigint") % 10
    x = c.join(last, COL("project_family").eqNullSafe(COL("f")), "left")
    return x.select("record_id", F.when(COL("late"), "time_ood_test").when(b < 8, "train").when(b == 8, "dev").otherwise("test").alias("split"))


@query("SELECT p_partkey, omitted FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size > 40, CASE WHEN p_size > 40 THEN 0 ELSE p_size END, p_partkey) AS r, count(*) OVER () - 32 AS omitted FROM part) WHERE r <= 32")
def limited_with_omitted(spark, d):
    """The first files of the candidate order, with the number of those left out."""
    part, big = load(spark, d, "part"), COL("p_size") > 40
    kept = part.orderBy(big, F.when(big, 0).otherwise(COL("p_size")), "p_partkey").limit(32)
    return kept.select("p_partkey").crossJoin(F.broadcast(part.agg((F.count("*") - 32).alias("omitted"))))  # one row


@query(r"SELECT readiness_id, coalesce(length(cited_path) > 0 AND NOT starts_with(cited_path, '/') AND NOT regexp_matches(cited_path, '(^|/)\.\.(/|$)'), false) AS relative FROM r01_readiness")
def relative_paths(spark, d):
    """The weaker path rule: relative, and no part leads upwards."""
    p = COL("cited_path")
    return load(spark, d, "r01_readiness").select("readiness_id", F.coalesce((F.length(p) > 0) & ~p.startswith("/") & ~p.rlike(r"(?:^|/)\.\.(?:/|$)"), F.lit(False)).alias("relative"))


@query("SELECT readiness_id, blockers, CASE WHEN blockers = '' THEN 'yes' ELSE 'no' END AS ready, CASE WHEN blockers = '' THEN 'source_resolved' WHEN contains(blockers, 'frozen') THEN 'metadata_only' ELSE 'evidence_draft' END AS status FROM (SELECT readiness_id, concat_ws(';', CASE WHEN versions_locatable IS DISTINCT FROM 'yes' THEN 'frozen_revision_not_locatable' END, CASE WHEN license_clear IS DISTINCT FROM 'yes' THEN 'license_unclear' END, CASE WHEN citation_range_exists IS DISTINCT FROM 'yes' THEN 'citation_range_missing' END, CASE WHEN coalesce(generic, true) THEN 'obligation_basis_generic_or_missing' END, CASE WHEN category_claim LIKE 'logic%' AND actor_view_generated IS DISTINCT FROM 'yes' THEN 'logic_not_confirmed' END) AS blockers FROM r01_readiness LEFT JOIN (SELECT pair_id, bool_and(coalesce(trim(obligation_basis) = '', true) OR contains(lower(obligation_basis), 'family_template')) AS generic FROM r01_candidates WHERE pair_id IS NOT NULL GROUP BY 1) USING (pair_id))")
def readiness_classes(spark, d):
    """Status, readiness and blockers in their fixed order; the basis is generic when all of the pair's rows say nothing."""
    basis = load(spark, d, "r01_candidates").filter("pair_id IS NOT NULL").groupBy("pair_id").agg(F.every(P.generic_basis(COL("obligation_basis"), ("family_template",))).alias("generic"))
    r = load(spark, d, "r01_readiness").join(basis, "pair_id", "left")
    yes = lambda c: COL(c) == "yes"
    logic = F.coalesce(COL("category_claim").startswith("logic"), F.lit(False))
    found = P.failing(frozen_revision_not_locatable=yes("versions_locatable"), license_unclear=yes("license_clear"), citation_range_missing=yes("citation_range_exists"), obligation_basis_generic_or_missing=~COL("generic"), logic_not_confirmed=~logic | F.coalesce(yes("actor_view_generated"), F.lit(False)))
    r = r.select("readiness_id", found.alias("blockers"))
    status = F.when(COL("blockers") == "", "source_resolved").when(F.contains("blockers", F.lit("frozen")), "metadata_only").otherwise("evidence_draft")
    return r.select("readiness_id", "blockers", F.when(COL("blockers") == "", "yes").otherwise("no").alias("ready"), status.alias("status"))
