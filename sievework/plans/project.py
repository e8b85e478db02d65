"""Queries on projects and runs: build facts, rule texts, skeletons, provenance of merges, receipts and phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import catalogue as C
from sievework.functions import scalar as S
from sievework.operators import aggregates as A
from sievework.sources import readers as R
from sievework.sources import sinks as K

from .evidence import query, severity, t


@query("SELECT doc_id, CAST(n_chars AS INTEGER) AS compile_sdk, lang || '.app' AS namespace, 'release,' || lang AS build_types, source AS flavors, 'release' AS signing_config_names FROM documents")
def build_facts(spark, d):
    script = "android {\n  compileSdk = %d\n  namespace '%s.app'\n  buildTypes {\n    release { x { } }\n    %s { }\n  }\n  productFlavors {\n    create(\"%s\") { }\n  }\n  signingConfigs {\n    create('release') { }\n    release { }\n  }\n}\n"
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("module"), F.lit("build.gradle").alias("file"), F.format_string(script, "n_chars", "lang", "lang", "source").alias("text"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return R.build_facts(docs).select(F.col("module").alias("doc_id"), "compile_sdk", "namespace", join("build_types"), join("flavors"), join("signing_config_names"))


@query("SELECT 'R-DOC-' || doc_id AS rule_id, lang || ' rule' AS title, lang || '/x' AS category, source AS severity, 'a+' AS pattern, n_chars > 1000 AS multiline, '*.kt,*.java' AS includes FROM documents")
def markdown_rules(spark, d):
    form = "# list\n## R-DOC-%d — %s rule\n- **Category:** `%s/x`\n- **Severity:** %s\n- **%s:** `a+` or `b`\n- **Include:** `*.kt`, `*.java`\n\n## R-BAD-1 — no pattern\n- **Category:** `c`\n- **Severity:** minor\n"
    kind = F.when(F.col("n_chars") > 1000, "Pattern (multiline)").otherwise("Pattern")
    texts = t(spark, d, "documents").select(F.format_string(form, "doc_id", "lang", "lang", "source", kind).alias("text"))
    return R.markdown_rules(texts).select("rule_id", "title", "category", "severity", "pattern", "multiline", F.array_join("includes", ",").alias("includes"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lang || chr(10) || repeat('- id: x' || chr(10) || ' - id: y' || chr(10), CAST(n_chars % 5 AS INTEGER)), '(?m)^- id:')) AS BIGINT) AS rules FROM documents")
def rule_id_counts(spark, d):
    text = F.concat("lang", F.lit("\n"), F.expr("repeat('- id: x\\n - id: y\\n', cast(n_chars % 5 as int))"))
    return t(spark, d, "documents").select("doc_id", S.rule_id_count(text).alias("rules"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_returnflag || CASE WHEN l_linestatus = 'O' THEN ' {' ELSE '()' END AS sig, l_returnflag = 'N' AS method FROM lineitem)
SELECT l_orderkey, '### ' || l_orderkey || chr(10) || string_agg('  ' || sig || CASE WHEN method AND NOT ends_with(sig, '{') THEN '  ...' ELSE '' END, chr(10) ORDER BY l_linenumber, sig) AS text FROM s GROUP BY l_orderkey""")
def skeletons(spark, d):
    sig = F.concat("l_returnflag", F.when(F.col("l_linestatus") == "O", " {").otherwise("()"))
    defs = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "N", "method").otherwise("class").alias("kind"), sig.alias("sig"))
    return K.skeletons(defs).select(F.col("file").cast("long").alias("l_orderkey"), "text")


@query("""WITH x AS (SELECT user_id, event_id * 2 AS o, event_type AS s FROM events UNION ALL SELECT user_id, event_id * 2 + 1, props FROM events),
f AS (SELECT user_id, s, min(o) AS o FROM x WHERE s IS NOT NULL GROUP BY user_id, s), c AS (SELECT user_id, count(*) AS inputs FROM events GROUP BY user_id)
SELECT user_id, any_value(inputs) AS inputs, string_agg(s, '|' ORDER BY o) AS source_ids FROM f JOIN c USING (user_id) GROUP BY user_id""")
def merge_provenance(spark, d):
    rows = severity(t(spark, d, "events")).select("user_id", "event_id", "event_type", "severity", F.array("event_type", "props").alias("source_ids"))
    out = A.merge(rows, "user_id", F.lit(0), "event_id", ["event_type"], lists=["source_ids"])
    return out.select("user_id", "inputs", F.array_join("source_ids", "|").alias("source_ids"))


_PLACES = "CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'error' THEN 'confirmed' WHEN 'click' THEN 'moved' ELSE 'review' END"


@query(f"""WITH r AS (SELECT user_id, user_id > 20 AS s, {_PLACES} AS q FROM events),
k AS (SELECT user_id, s, count(*) FILTER (q = 'confirmed') AS c, count(*) FILTER (q <> 'confirmed') AS h, count(*) FILTER (q = 'moved') AS m FROM r GROUP BY user_id, s),
n AS (SELECT *, greatest(c - 1, 0) + greatest(h - 1, 0) AS d FROM k)
SELECT count(*) FILTER (c > 0) AS findings_total, count(*) FILTER (c = 0 AND h > 0) AS needs_review_total, CAST(sum(d) AS BIGINT) AS findings_duplicate, CAST(coalesce(sum(d) FILTER (s), 0) AS BIGINT) AS semantic_duplicates_merged,
CAST(coalesce(sum(d) FILTER (NOT s), 0) AS BIGINT) AS exact_duplicates_merged, count(*) FILTER (c > 0 AND h > 0) AS confirmed_review_conflicts_resolved, CAST(coalesce(sum(c + h) FILTER (NOT s), 0) AS BIGINT) AS records_without_root_cause, CAST(sum(m) AS BIGINT) AS moved_to_review_no_origin FROM n""")
def merge_counters(spark, d):
    rows = t(spark, d, "events").select("user_id", (F.col("user_id") > 20).alias("semantic"), F.expr(_PLACES).alias("queue"))
    return A.merge_counters(rows, "user_id", "semantic", "queue")


@query("""SELECT event_id, sha256('{"config_fingerprint": null, "config_trusted": ' || CASE WHEN value > 100 THEN 'true' ELSE 'false' END || ', "effective_excluded_engines": ["ü", "' || event_type || '"], "effective_hunt_policy": {"a": 1, "b": ' || props || '}, "language": "' || event_type || '", "repo_dirty": null, "repo_revision": null, "run_id": ' || event_id || ', "scan_mode": null, "schema_version": null, "scope": null, "skill_fingerprint": null, "source_only": null, "started_at": null}') AS fingerprint FROM events""")
def manifest_fingerprints(spark, d):
    form = '{"run_id":%d,"language":"%s","finished_at":9,"effective_hunt_policy":{"b":%s,"a":1},"config_trusted":%b,"effective_excluded_engines":["\u00fc","%s"]}'
    rows = t(spark, d, "events").select("event_id", F.format_string(form, "event_id", "event_type", "props", F.col("value") > 100, "event_type").alias("manifest"))
    return rows.select("event_id", S.canonical_hash("manifest", C.MANIFEST_FIELDS).alias("fingerprint"))


_RUNS = """SELECT o_orderkey, o_orderpriority LIKE '1%' AS ai_excluded, CAST(CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'O' THEN 0 ELSE 5 END AS BIGINT) AS hunt_files, o_totalprice > 100000 AS hunt_ok,
CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice > 150000 END AS gap_ok, o_totalprice > 1000 AS coverage_ok, o_custkey AS given, CASE WHEN o_totalprice > 200000 THEN o_custkey + 1 ELSE o_custkey END AS batched,
CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_totalprice < 300000 END AS merge_ok FROM orders"""


@query(f"""WITH r AS ({_RUNS}), v AS (SELECT *, coalesce(coverage_ok AND given = batched, false) AS verify_ok FROM r)
SELECT o_orderkey, 'ai_hunter' AS phase, CASE WHEN ai_excluded THEN 'skipped' WHEN hunt_files IS NULL THEN 'failed' WHEN hunt_files = 0 THEN 'not_applicable' WHEN hunt_ok THEN 'complete' ELSE 'failed' END AS status,
CASE WHEN ai_excluded THEN 'excluded' WHEN hunt_files IS NULL THEN 'missing hunt scope' WHEN hunt_files = 0 OR hunt_ok THEN '' ELSE 'hunt coverage not ok' END AS reason FROM v
UNION ALL SELECT o_orderkey, 'ai_gap_audit', CASE WHEN ai_excluded THEN 'skipped' WHEN coalesce(hunt_files, 0) = 0 THEN 'not_applicable' WHEN gap_ok THEN 'complete' ELSE 'failed' END,
CASE WHEN ai_excluded THEN 'excluded' WHEN coalesce(hunt_files, 0) = 0 OR gap_ok THEN '' WHEN gap_ok IS NULL THEN 'missing receipt' ELSE 'audit coverage not ok' END FROM v
UNION ALL SELECT o_orderkey, 'verifier', CASE WHEN verify_ok THEN 'complete' ELSE 'failed' END, CASE WHEN verify_ok THEN '' ELSE 'not lossless' END FROM v
UNION ALL SELECT o_orderkey, 'merge', CASE WHEN merge_ok THEN 'complete' ELSE 'failed' END, CASE WHEN merge_ok THEN '' WHEN merge_ok IS NULL THEN 'missing receipt' ELSE 'receipt does not match' END FROM v""")
def phase_status(spark, d):
    t(spark, d, "orders").createOrReplaceTempView("orders")
    runs = spark.sql(_RUNS)
    return A.phases(runs.withColumns({"one": F.lit(1), "verify_ok": A.lossless("coverage_ok", "given", "batched", "one", "one")}), ["o_orderkey"])
