"""Queries on findings and texts: identities, markers, merging, gates and reports, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import scalar as S
from sievework.operators import aggregates as A
from sievework.operators import batching as B
from sievework.operators import filters as P
from sievework.operators import joins as J
from sievework.operators import windows as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


MARKERS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[ ]*[:=]",
    "bang": r"!!",
    "email": r"[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+",
    "license": r"(?i)licen[sc]e",
    "pipe": r"[|][^\n]*[|]",
}
SIGNALS = [(MARKERS["assign"], 4), (MARKERS["email"], 2), (MARKERS["bang"], 1)]
_RISK = " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w} ELSE 0 END" for p, w in SIGNALS)
_TAGS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in sorted(MARKERS.items()))
SEVERITY_OF = {"purchase": "critical", "signup": "major", "click": "minor", "view": "info"}
_SEVERITY = "CASE event_type WHEN 'purchase' THEN 'critical' WHEN 'signup' THEN 'major' WHEN 'click' THEN 'minor' WHEN 'view' THEN 'info' ELSE 'other' END"
_RANK = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 99 END"
_LINES = "SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL"
_LINE_COUNT = "length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END"


def severity(events: DataFrame) -> DataFrame:
    out = F
    for k, v in SEVERITY_OF.items():
        out = out.when(F.col("event_type") == k, v)
    return events.withColumn("severity", out.otherwise("other"))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), text of every line."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("long"))


@query(f"SELECT doc_id, array_to_string([x FOR x IN [{_TAGS}] IF x IS NOT NULL], ',') AS tags, CAST({_RISK} AS INTEGER) AS risk FROM documents")
def scan_risk_markers(spark, d):
    found = t(spark, d, "documents").select("doc_id", P.flags("text", MARKERS).alias("found"))
    return found.select("doc_id", F.array_join("found", ",").alias("tags"), P.weighed("found", {n: w for p, w in SIGNALS for n in MARKERS if MARKERS[n] == p}).alias("risk"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS file, line, 'R-SG-032' AS rule_id, 'stability/not-null-assert' AS category, 'minor' AS severity, left(text, 300) AS snippet FROM ({_LINES}) WHERE regexp_matches(text, '!!([^=]|$)')")
def rule_hits_not_null_assert(spark, d):
    rows = lines(t(spark, d, "documents")).withColumn("file", F.col("doc_id").cast("string"))
    return P.rule_hits(rows, [{"rule_id": "R-SG-032", "pattern": "!!(?!=)", "category": "stability/not-null-assert", "severity": "minor"}])


@query(_LINES)
def source_lines_index(spark, d):
    from sievework.sources.readers import source_lines

    content = F.encode("text", "UTF-8")
    files = t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.octet_length("text").alias("bytes"), content.alias("content"))
    return source_lines(files).select(F.col("file").alias("doc_id"), F.col("line").cast("long").alias("line"), "text")


@query(f"SELECT doc_id, string_agg(text, chr(10) ORDER BY line) AS snippet FROM ({_LINES}) WHERE line BETWEEN 2 AND 4 GROUP BY doc_id")
def snippet_range(spark, d):
    from sievework.operators.relations import snippets

    docs = t(spark, d, "documents")
    wanted = docs.select(F.col("doc_id").alias("file"), F.lit(2).alias("line"), F.lit(4).alias("end_line"))
    found = snippets(wanted, lines(docs).withColumnRenamed("doc_id", "file"), 1 << 30).where("snippet is not null")
    return found.select(F.col("file").alias("doc_id"), "snippet")


@query(f"SELECT doc_id, sha256(text) AS sha256, CAST({_LINE_COUNT} AS BIGINT) AS line_count FROM documents")
def line_count_snapshot(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), S.line_count("text").alias("line_count"))


@query("SELECT doc_id, CAST(greatest(64, (length(text) + 2) // 3) AS BIGINT) AS estimated_tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", S.token_estimate("text").alias("estimated_tokens"))


@query("SELECT event_id, sha1(event_type || ':' || CAST(event_id AS VARCHAR) || ':' || CAST(user_id AS VARCHAR) || ':R-1') AS finding_id FROM events")
def finding_ids(spark, d):
    return t(spark, d, "events").select("event_id", S.finding_id("event_type", "event_id", "user_id", F.lit("R-1")).alias("finding_id"))


@query(r"""SELECT p_partkey, sha1(lower(replace(p_brand, '\', '/')) || chr(0) || lower(regexp_replace(trim(p_name), '\s+', ' ', 'g')) || chr(0) || regexp_replace(replace(lower(trim(p_type)), '_', '-'), '\s+', '-', 'g')) AS root_id FROM part""")
def root_cause_ids(spark, d):
    return t(spark, d, "part").select("p_partkey", S.root_cause_id("p_brand", "p_name", "p_type").alias("root_id"))


@query(f"SELECT event_id, user_id, {_SEVERITY} AS severity, CAST({_RANK} AS INTEGER) AS severity_rank, row_number() OVER (PARTITION BY user_id ORDER BY {_RANK}, event_type, event_id) AS position FROM events")
def severity_rank_sort(spark, d):
    from pyspark.sql import Window

    e = severity(t(spark, d, "events")).withColumn("severity_rank", S.severity_rank("severity"))
    w = Window.partitionBy("user_id").orderBy("severity_rank", "event_type", "event_id")
    return e.select("event_id", "user_id", "severity", "severity_rank", F.row_number().over(w).cast("long").alias("position"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'R-LT-001' WHEN 'purchase' THEN 'R-LT-002' ELSE 'R-LT-000' END AS rule_id, CASE event_type WHEN 'click' THEN 'perf/click' WHEN 'purchase' THEN 'security/purchase' ELSE 'lint/' || event_type END AS category, CASE event_type WHEN 'click' THEN 'minor' WHEN 'purchase' THEN 'critical' ELSE 'info' END AS severity FROM events")
def rule_map_default(spark, d):
    rules = spark.createDataFrame([("click", "R-LT-001", "perf/click", "minor"), ("purchase", "R-LT-002", "security/purchase", "critical")], "native_rule_id string, rule_id string, category string, severity string")
    out = J.map_rules(t(spark, d, "events").select("event_id", "event_type"), rules, "event_type", {"rule_id": F.lit("R-LT-000"), "category": F.concat(F.lit("lint/"), "event_type"), "severity": F.lit("info")})
    return out.select("event_id", "rule_id", "category", "severity")


@query("SELECT lang, digest, doc_id, n_chars, first_seen FROM (SELECT lang, md5(text) AS digest, doc_id, n_chars, min(doc_id) OVER (PARTITION BY lang, md5(text)) AS first_seen, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_richest(spark, d):
    rows = t(spark, d, "documents").select("lang", F.md5("text").alias("digest"), "doc_id", "n_chars")
    return A.dedupe_richest(rows, ["lang", "digest"], F.col("n_chars"), "doc_id").select("lang", "digest", "doc_id", "n_chars", "first_seen")


@query(f"""WITH e AS (SELECT *, {_RANK} AS r FROM events),
w AS (SELECT user_id, event_id AS winner, event_type AS winner_type, row_number() OVER (PARTITION BY user_id ORDER BY length(props) DESC, event_id) AS k FROM e),
a AS (SELECT user_id, min(r) AS severity_rank, count(*) AS inputs, count(DISTINCT event_type) AS places FROM e GROUP BY user_id)
SELECT user_id, winner, winner_type, CAST(severity_rank AS INTEGER) AS severity_rank, inputs, CASE WHEN inputs > 1 THEN places END AS merged_manifestations FROM a JOIN w USING (user_id) WHERE k = 1""")
def root_merge(spark, d):
    rows = severity(t(spark, d, "events")).select("user_id", "event_id", "event_type", "severity", F.length("props").alias("evidence"))
    out = A.merge(rows, "user_id", F.col("evidence"), "event_id", ["event_type"])
    return out.select("user_id", F.col("event_id").alias("winner"), F.col("event_type").alias("winner_type"), S.severity_rank("severity").alias("severity_rank"), "inputs", F.col("merged_manifestations").cast("long").alias("merged_manifestations"))


@query("SELECT count(*) AS inputs, count(DISTINCT user_id) AS merged, count(*) - count(DISTINCT user_id) AS duplicates, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS critical FROM events")
def merge_stats(spark, d):
    e = t(spark, d, "events")
    return e.agg(F.count("*").alias("inputs"), F.countDistinct("user_id").alias("merged"), (F.count("*") - F.countDistinct("user_id")).alias("duplicates"), *A.count_where(critical=F.col("event_type") == "purchase"))


@query("SELECT d.doc_id, CASE WHEN lang = 'en' AND l.doc_id IS NULL THEN 'needs_review' ELSE 'confirmed' END AS queue, CASE WHEN lang = 'en' AND l.doc_id IS NULL THEN 'origin missing' END AS review_reason FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def evidence_gate(spark, d):
    labelled = t(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = t(spark, d, "documents").select("doc_id", "lang").join(labelled, "doc_id", "left")
    out = P.gate(rows, F.col("lang") == "en", F.coalesce("known", F.lit(False)), "origin missing")
    return out.select("doc_id", "queue", "review_reason")


@query("SELECT doc_id, quality FROM labels l WHERE toxic = 1 AND NOT EXISTS (SELECT 1 FROM labels c WHERE c.quality = 1 AND c.doc_id = l.doc_id)")
def confirmed_beats_review(spark, d):
    labels = t(spark, d, "labels")
    left, _ = J.beats(labels.where("quality = 1"), labels.where("toxic = 1"), ["doc_id"])
    return left.select("doc_id", "quality")


@query("SELECT conv_id, turn, 'role' AS field FROM conversations WHERE nullif(role, 'system') IS NULL OR trim(role) = '' UNION ALL SELECT conv_id, turn, 'text' FROM conversations WHERE text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = ''")
def required_fields_problems(spark, d):
    rows = t(spark, d, "conversations").withColumn("role", F.nullif("role", F.lit("system")))
    return P.missing_fields(rows, ("role", "text")).select("conv_id", "turn", "field")


@query("SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 100")
def per_rule_cap(spark, d):
    kept, _ = W.cap_per_key(t(spark, d, "events").select("event_type", "event_id", "user_id"), ["event_type"], ["event_id"], 100)
    return kept


@query("SELECT event_type, greatest(count(*) - 100, 0) AS truncated FROM events GROUP BY event_type")
def per_rule_truncated(spark, d):
    return W.cap_per_key(t(spark, d, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 100)[1]


@query("SELECT status, count(*) AS rows, min(line_count) AS least_lines FROM (SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS status, CAST(" + _LINE_COUNT + " AS BIGINT) AS line_count FROM documents JOIN labels USING (doc_id)) GROUP BY status")
def suppression_summary(spark, d):
    rows = t(spark, d, "documents").select("doc_id", S.line_count("text").alias("line_count")).join(t(spark, d, "labels"), "doc_id")
    status = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor")
    rows = rows.withColumn("status", status)
    return A.suppression_summary(rows, ["status"]).withColumnRenamed("suppressed", "rows").join(rows.groupBy("status").agg(F.min("line_count").alias("least_lines")), "status")


@query(f"SELECT user_id, count(CASE WHEN s = 'critical' THEN 1 END) AS critical, count(CASE WHEN s = 'major' THEN 1 END) AS major, count(CASE WHEN s = 'minor' THEN 1 END) AS minor, count(CASE WHEN s = 'info' THEN 1 END) AS info, count(*) AS total FROM (SELECT user_id, {_SEVERITY} AS s FROM events) GROUP BY user_id")
def severity_counts(spark, d):
    return A.severity_counts(severity(t(spark, d, "events")), ["user_id"])


@query("SELECT doc_id, left(sha256('documents:' || CAST(doc_id AS VARCHAR) || ':' || md5(text)), 24) AS candidate_id, CASE WHEN regexp_matches(source, '^src[0-4]$') THEN 'ai_hunter' WHEN regexp_matches(source, '^src1') THEN 'ai_gap_auditor' ELSE 'tool_engine' END AS source_kind FROM documents")
def candidate_enrich(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("canonical"), F.lit("documents").alias("file"))
    return B.enrich(rows, "source", "doc_id", "canonical", {"^src[0-4]$": "ai_hunter", "^src1": "ai_gap_auditor"}, "tool_engine").withColumn("candidate_id", S.candidate_id("file", "doc_id", "canonical")).select("doc_id", "candidate_id", "source_kind")


@query("SELECT doc_id, lang, 'needs_review' AS status, 'verification failed' AS review_reason FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fallback_review(spark, d):
    return B.fallback_review(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), ["doc_id"], "verification failed")


@query("SELECT 'documents' AS engine, CAST(doc_id AS VARCHAR) AS file, CAST(length(text) AS BIGINT) AS chars FROM documents UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), CAST(length(html) AS BIGINT) FROM pages UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR), CAST(length(text) AS BIGINT) FROM conversations")
def union_candidates(spark, d):
    from sievework.operators.sets import union_all

    a = t(spark, d, "documents").select(F.lit("documents").alias("engine"), F.col("doc_id").cast("string").alias("file"), F.length("text").cast("long").alias("chars"))
    b = t(spark, d, "pages").select(F.lit("pages").alias("engine"), F.col("page_id").cast("string").alias("file"), F.length("html").cast("long").alias("chars"))
    c = t(spark, d, "conversations").select(F.lit("conversations").alias("engine"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file"), F.length("text").cast("long").alias("chars"))
    return union_all([a, b, c])


@query(f"SELECT user_id, string_agg('[' || {_SEVERITY} || '] ' || event_type || ':' || CAST(event_id AS VARCHAR), chr(10) ORDER BY {_RANK}, event_type, event_id) AS report FROM events GROUP BY user_id")
def report_lines(spark, d):
    from sievework.sources.sinks import report

    rows = severity(t(spark, d, "events")).select("user_id", "severity", F.col("event_type").alias("category"), F.col("event_type").alias("file"), F.col("event_id").alias("line"))
    return report(rows, ["user_id"])


_SHAPES = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/repo/app/src/d' || doc_id || '.kt' WHEN 1 THEN 'app\\src\\d' || doc_id || '.kt' ELSE '/elsewhere/d' || doc_id || '.kt' END AS path,
CASE doc_id % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INVENTORY' WHEN 3 THEN 'EXPERIMENT' END AS level,
CASE WHEN doc_id % 4 <> 0 THEN n_chars % 500 END AS line, CASE WHEN doc_id % 2 = 0 THEN n_chars % 500 + doc_id % 3 END AS last, CASE WHEN doc_id % 7 = 0 THEN 'requires login' ELSE left(text, 350) END AS code FROM documents"""


@query(f"""SELECT 'R-SG-' || lpad(CAST(doc_id % 90 AS VARCHAR), 3, '0') AS rule_id, CASE doc_id % 3 WHEN 2 THEN path ELSE 'app/src/d' || doc_id || '.kt' END AS file, coalesce(level, 'INFO') AS level_given,
CASE coalesce(level, 'INFO') WHEN 'ERROR' THEN 'critical' WHEN 'WARNING' THEN 'major' WHEN 'INFO' THEN 'minor' ELSE 'info' END AS severity, coalesce(line, 0) AS line, nullif(coalesce(last, coalesce(line, 0)), coalesce(line, 0)) AS end_line,
CASE WHEN doc_id % 7 = 0 THEN '' ELSE left(trim(code, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 300) END AS snippet FROM ({_SHAPES})""")
def pattern_report_shapes(spark, d):
    """Reports of a result for each document: paths below the root, with back slashes and elsewhere, levels that are missing or unknown."""
    from sievework.sources.readers import pattern_texts

    t(spark, d, "documents").createOrReplaceTempView("shaped_documents")
    rows = spark.sql(_SHAPES.replace("FROM documents", "FROM shaped_documents").replace("\\", "\\\\"))
    spark.catalog.dropTempView("shaped_documents")
    result = F.struct(F.concat(F.lit("rules.r-sg-"), F.col("doc_id") % 90).alias("check_id"), "path", F.struct("line").alias("start"), F.struct(F.col("last").alias("line")).alias("end"), F.struct(F.coalesce("level", F.lit("INFO")).alias("message"), F.col("level").alias("severity"), F.col("code").alias("lines")).alias("extra"))
    reports = rows.select(F.to_json(F.struct(F.array(result).alias("results"))).alias("report"))
    return pattern_texts(reports, "/repo").select("rule_id", "file", F.col("message").alias("level_given"), "severity", F.col("line").cast("long"), F.col("end_line").cast("long"), "snippet")


_RULES = [("T1", r"[0-9]{3,}"), ("T2", r"[a-z]+ing[.]"), ("T3", r"!!")]


@query("WITH l AS (SELECT doc_id, line, text FROM (" + _LINES + ")) " + " UNION ALL ".join(f"SELECT 'd/' || doc_id || '.txt' AS file, CAST(line AS INTEGER) AS line, '{n}' AS rule_id, left(unnest(regexp_extract_all(text, '{p}')), 300) AS snippet FROM l" for n, p in _RULES))
def text_rule_matches(spark, d):
    from sievework.operators.review import text_rule_hits

    files = t(spark, d, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".txt")).alias("file"), "text")
    return text_rule_hits(files, [{"rule_id": n, "pattern": p, "category": "text", "severity": "info", "paths": ["**/*.txt"]} for n, p in _RULES]).select("file", "line", "rule_id", "snippet")


_PAGE_LINES = "SELECT page_id, unnest(generate_series(1, len(string_split(html, chr(10))))) AS line, unnest(string_split(html, chr(10))) AS text FROM pages"


@query(f"SELECT page_id, kind, name, CAST(line AS INTEGER) AS line FROM (SELECT page_id, line, 'definition.type' AS kind, unnest(regexp_extract_all(text, '\\b(?:class|interface|object|record)\\s+([A-Za-z_]\\w*)', 1)) AS name FROM ({_PAGE_LINES}) UNION ALL SELECT page_id, line, 'reference.call', unnest(regexp_extract_all(text, '\\b([A-Za-z_]\\w*)\\s*\\(', 1)) FROM ({_PAGE_LINES}))")
def page_captures(spark, d):
    """The table function over the scripts of pages, from SQL."""
    from sievework.sources.report_source import register_extract

    register_extract(spark)
    t(spark, d, "pages").createOrReplaceTempView("captured_pages")
    return spark.sql("SELECT page_id, kind, name, line FROM captured_pages, LATERAL extract_tags(html) WHERE kind IN ('definition.type', 'reference.call')")
