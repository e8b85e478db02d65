"""Composed steps: analysis of files, suppression, receipts, audits, impact slices and the final merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import catalogue as C
from sievework.functions import scalar as S
from sievework.sources.readers import inspect

from . import aggregates as A
from . import batching as B
from . import filters as P
from . import graph as G
from . import joins as J
from . import sets as X
from . import windows as W
from .structural import named as _named
from .structural import pattern_hits


def analyse(files: DataFrame) -> DataFrame:
    """file, risk_score, tech, estimated_tokens, sha256, line_count of texts (file, text), generated ones left out."""
    return files.where(~P.generated("file")).select("file", P.risk("text", C.SIGNALS).alias("risk_score"), P.flags("text", C.MARKERS).alias("tech"), S.token_estimate("text").alias("estimated_tokens"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), S.line_count("text").alias("line_count"))


def analyse_windows(windows: DataFrame, signals: list[tuple[str, int]] | None = None, markers: dict[str, str] | None = None, long_lines: int = 600) -> DataFrame:
    """The same of files that come in windows (sources.splits), which may be larger than a cell: file, risk_score, tech, estimated_tokens, line_count."""
    signals, markers = C.SIGNALS if signals is None else signals, C.MARKERS if markers is None else markers
    last = F.when(F.col("chars") > 0, F.endswith(W.own_part(), F.lit("\n"))).alias("_n")
    rows = windows.where(~P.generated("file"))
    found = W.match_counts(rows, {f"s{k}": p for k, (p, _) in enumerate(signals)} | {f"t{n}": p for n, p in markers.items()})
    # whether the last character is a line feed: a short row a window
    ends = rows.select("file", "start", "chars", last).where("chars > 0").groupBy("file").agg(F.max_by("_n", "start").alias("_end"))
    has = lambda k: F.map_contains_key("matches", k)
    risk = sum((F.when(has(f"s{k}"), w).otherwise(0) for k, (_, w) in enumerate(signals)), F.when(F.col("breaks") > long_lines, 1).otherwise(0))
    tech = F.array_compact(F.array(*(F.when(has(f"t{n}"), n) for n in sorted(markers))))
    tokens = F.greatest(F.lit(64), F.floor((F.col("chars") + 2) / 3)).cast("long")
    lines = F.col("breaks") + F.when(F.col("_end"), 0).when(F.col("chars") > 0, 1).otherwise(0)
    return found.join(ends, "file", "left").select("file", risk.cast("int").alias("risk_score"), tech.alias("tech"), tokens.alias("estimated_tokens"), lines.cast("long").alias("line_count"))


def text_rule_hits(files: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """One row a match of the text rules over whole texts: file, line, rule_id, category, severity, snippet. One scan for all rules."""
    rules = rules if rules is not None else C.text_rules()
    hits = pattern_hits(files, [(P.matches_any("file", r["paths"]), r["pattern"]) for r in rules])
    return _named(hits, [(r["rule_id"], r["category"], r["severity"]) for r in rules])


# Calls and what releases them.
_RELEASES = {"registerListener": "unregisterListener", "registerContentObserver": "unregisterContentObserver", "addCallback": "removeCallback", "addListener": "removeListener"}


def suppressed(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `suppression`, the reason why a candidate is surely false, or null. files: file, text."""
    rows = candidates.join(files.select("file", F.col("text").alias("_text")), "file", "left")
    compact = F.regexp_replace("snippet", r"\s+", "")
    name, arg = (F.regexp_extract("snippet", r"\b(" + "|".join(_RELEASES) + r")\s*\(\s*([A-Za-z_]\w*)", k) for k in (1, 2))
    inverse = F.lit("")
    for call, release in _RELEASES.items():
        inverse = F.when(name == call, release).otherwise(inverse)
    pattern = F.concat(F.lit(r"\bfinally\s*\{[\s\S]*?\b"), inverse, F.lit(r"\s*\(\s*"), arg, F.lit(r"\b"))
    reason = (
        F.when((F.col("rule_id") == "R-SG-060") & F.col("_text").contains("android.permission.ACCESS_COARSE_LOCATION"), "fine-coarse-permission-pair-present")
        .when(F.col("rule_id").isin("R-SG-017", "R-SG-023") & compact.contains("registerReceiver(null,"), "sticky-broadcast-null-receiver")
        .when((F.col("rule_id") == "R-SG-023") & (name != "") & F.regexp_like("_text", pattern), "paired-release-in-finally")
    )
    return rows.withColumn("suppression", reason).drop("_text")


def emitted(violations: DataFrame, advisories: bool = False) -> DataFrame:
    """Violations of the profile that goes on to verification."""
    kind = F.lower(F.replace("ruleset", F.lit(" "), F.lit("")))
    return violations.where(F.lit(advisories) | F.col("native_rule_id").isin(*C.HIGH_SIGNAL) | P.any_of([kind.contains(k) for k in C.HIGH_SIGNAL_SETS]))


def plan_batches(analysed: DataFrame, edges: DataFrame, policy: dict) -> DataFrame:
    """batch, position and the analysis of each file: related files together, the riskiest first."""
    items = analysed.select(F.col("file").alias("node"), F.col("risk_score").alias("risk"), F.col("estimated_tokens").alias("tokens"))
    return G.cluster(items, edges, policy["batch_size"], policy["token_budget"]).withColumnRenamed("node", "file").join(analysed, "file")


def expected_cases(batches: DataFrame) -> DataFrame:
    """batch, perspective, cases (sorted) that a batch's technologies call for."""
    spark = batches.sparkSession
    tags = batches.select("batch", F.explode_outer("tech").alias("tag")).distinct()
    cases = spark.createDataFrame(C.case_rows(), "perspective string, case_id string").groupBy("perspective").agg(F.array_sort(F.collect_set("case_id")).alias("cases"))
    gated = J.gated(tags, spark.createDataFrame(C.gate_rows(), "perspective string, tag string"))
    return gated.join(cases, "perspective", "left").select("batch", "perspective", F.coalesce("cases", F.array().cast("array<string>")).alias("cases"))


def read_problems(reads: DataFrame, expected: DataFrame, keys: list[str] = ["batch", "sample"]) -> DataFrame:
    """keys, file, problem: receipts that miss, exceed, repeat or misstate the files, or whose ranges leave gaps.
    reads: keys, file, sha256, line_count, ranges; expected: keys, file, sha256, line_count."""
    own = keys + ["file"]
    sets = J.compare_sets(expected, reads, own)
    values = J.compare_values(expected, reads, own, ["sha256", "line_count"]).where("field not in ('missing', 'extra')").withColumnRenamed("field", "problem")
    ranges = reads.select(*own, "line_count", F.explode_outer("ranges").alias("r")).select(*own, "line_count", F.col("r.start").alias("s"), F.col("r.end").alias("e"))
    gaps = W.ranges_cover(ranges, own, "s", "e", "line_count").where("not covered").select(*own, F.lit("ranges").alias("problem"))
    return sets.select(*own, "problem").union(values.select(*own, "problem")).union(gaps)


def evidence_problems(rows: DataFrame, files: DataFrame, keys: list[str], must: Column) -> DataFrame:
    """keys, problem of what backs a judgement: no signals or conclusion, no evidence where there must be some, places outside of the batch or the file.

    rows: keys, signals_checked array<string>, conclusion, evidence array<struct<file, line>>; files: file, line_count of the batch (with the keys it shares with rows, such as batch).
    """
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    none = F.coalesce(F.size("evidence"), F.lit(0)) <= 0
    own = F.array_compact(F.array(
        F.when(F.coalesce(F.size("signals_checked"), F.lit(0)) <= 0, "signals").when(F.exists("signals_checked", blank), "signals"),
        F.when(F.length(F.trim(F.coalesce("conclusion", F.lit("")))) < 4, "conclusion"),
        F.when(must & none, "evidence"),
    ))
    shared = [c for c in files.columns if c in keys]
    known = files.select(*shared, F.col("file").alias("_file"), F.col("line_count").alias("_lines"))
    spots = rows.select(*keys, F.explode("evidence").alias("_e")).select(*keys, F.replace(F.col("_e.file"), F.lit("\\"), F.lit("/")).alias("_file"), F.col("_e.line").alias("_line"))
    placed = spots.join(known, [*shared, "_file"], "left")
    wrong = F.array_compact(F.array(
        F.when(F.col("_lines").isNull(), "evidence-file"),
        F.when(F.col("_line").isNull() | (F.col("_line") < 1), "evidence-line").when(F.col("_line") > F.col("_lines"), "evidence-range"),
    ))
    return rows.select(*keys, F.explode(own).alias("problem")).union(placed.select(*keys, F.explode(wrong).alias("problem")))


def case_problems(assessed: DataFrame, expected: DataFrame, candidates: DataFrame, statuses: tuple[str, ...], files: DataFrame | None = None, status: str = "status", backed: tuple[str, ...] = ("candidate", "mitigated"), undecided: str = "needs_context") -> DataFrame:
    """batch, case_id, problem: cases missing, extra, repeated, of unknown status, or called a candidate without one (rule_id).

    With files (batch, file, line_count) also what the evidence lacks (evidence_problems), and cases left undecided.
    """
    keys = ["batch", "case_id"]
    sets = J.compare_sets(expected, assessed, keys).select(*keys, "problem")
    known = F.coalesce(F.col(status).isin(*statuses), F.lit(False))
    unknown = assessed.where(~known).select(*keys, F.lit("status").alias("problem"))
    have = candidates.select("batch", F.col("rule_id").alias("case_id")).distinct()
    unbacked = assessed.where(F.col(status).isin("candidate", "new_candidate")).join(have, keys, "left_anti").select(*keys, F.lit("no-candidate").alias("problem"))
    out = sets.union(unknown).union(unbacked)
    if files is None:
        return out
    planned = assessed.where(known).join(expected.select(*keys).distinct(), keys, "left_semi")
    open_ = planned.where(F.col(status) == undecided).select(*keys, F.lit("undecided").alias("problem"))
    return out.union(open_).union(evidence_problems(planned, files, keys, F.col(status).isin(*backed)))


def audit_case_problems(audits: DataFrame, expected: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """The same of an auditor's rows, whose judgement is a disposition."""
    return case_problems(audits, expected, candidates, tuple(C.DISPOSITIONS), files, "disposition", ("agree_mitigated", "new_candidate"), "unresolved")


def audit_plan(assessed: DataFrame, planned: DataFrame) -> DataFrame:
    """batch, negative and disputed cases: what an independent pass has to look at."""
    s = A.case_status(assessed, planned, ["batch", "case_id"], ["no_signal", "mitigated"])
    pick = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("case_id"))))
    return s.groupBy("batch").agg(pick("negative").alias("negative_cases"), pick("disagreement").alias("disagreements"))


def audit_inputs(files: DataFrame, expected: DataFrame, results: DataFrame, assessed: DataFrame, candidates: DataFrame) -> DataFrame:
    """What an independent pass over each batch gets, one row a batch, and hashes that bind it:

    batch, files (by position), expected_cases, negative_cases, disagreements, logic_cases, prior_results (by result_file: sample, result_file,
    case_assessments, candidate_locations), source_sha256, prior_sha256, audit_sha256, and problem, `no-results` for a batch without any.

    files: batch, position, file, sha256; expected: batch, case_id; results: batch, sample, result_file; assessed: batch, sample, case_id,
    status, signals_checked, evidence, conclusion; candidates: batch, sample, rule_id, file, line. A batch's rows are bounded by its size.
    Assessments stand by case, locations by rule and place, so equal inputs have equal hashes; those are of the rows as JSON.
    """
    said = ("case_id", "status", "signals_checked", "evidence", "conclusion")
    own = ["batch", "sample"]
    listed = lambda df, keys, fields, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    every = results.join(listed(assessed, own, said, "case_assessments"), own, "left").join(listed(candidates, own, ("rule_id", "file", "line"), "candidate_locations"), own, "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(every.dtypes)[c])).alias(c)
    prior = listed(every.select(*own, "result_file", empty("case_assessments"), empty("candidate_locations")), ["batch"], ("result_file", "sample", "case_assessments", "candidate_locations"), "prior_results")
    logic = F.array(*(F.lit(f"R-AI-{n:03d}") for n in C.CASES["business_logic"]))
    cases = expected.groupBy("batch").agg(F.array_sort(F.collect_set("case_id")).alias("expected_cases"))
    plan = listed(files, ["batch"], ("position", "file", "sha256"), "_files").join(cases, "batch", "left").join(audit_plan(assessed, expected), "batch", "left").join(prior, "batch", "left")
    none = F.array().cast("array<string>")
    plan = plan.withColumns({c: F.coalesce(F.col(c), none) for c in ("expected_cases", "negative_cases", "disagreements")})
    plan = plan.withColumn("logic_cases", F.array_intersect("expected_cases", logic))
    focus = ("negative_cases", "disagreements", "logic_cases")
    hashed = lambda *c: F.sha2(F.to_json(F.struct(*c)), 256)
    plan = plan.withColumn("source_sha256", hashed("batch", "_files", "expected_cases")).withColumn("prior_sha256", hashed("batch", *focus, "prior_results"))
    return plan.select(
        "batch", F.transform("_files", lambda x: x.file).alias("files"), "expected_cases", *focus, "prior_results", "source_sha256", "prior_sha256",
        hashed("batch", "source_sha256", "prior_sha256", "expected_cases").alias("audit_sha256"), F.when(F.col("prior_results").isNull(), "no-results").alias("problem"),
    )


def stale_audits(stored: DataFrame, inputs: DataFrame) -> DataFrame:
    """batch, field: batches of a stored audit plan that are missing, extra, or whose lists or hashes are not those of its inputs as they are now."""
    return J.compare_values(stored, inputs, ["batch"], ["files", "expected_cases", "negative_cases", "disagreements", "source_sha256", "prior_sha256", "audit_sha256"])


# What a plan's rows must have in common with the rebuilt ones, and the least token budget of a plan.
PLAN_FIELDS, LEAST_BUDGET = ("position", "risk_score", "tech", "estimated_tokens", "sha256", "line_count"), 1000


def plan_problems(stored: DataFrame, files: DataFrame, edges: DataFrame, policy: dict) -> DataFrame:
    """batch, file, problem of a stored plan against the plan that its files, edges and policy give when it is made again: files missing
    from their batch, extra or repeated there, and fields that differ. So no part of a plan passes as the whole.

    A policy without sound limits is a ValueError: no plan can be made of it.
    """
    size, budget = policy.get("batch_size"), policy.get("token_budget")
    if type(size) is not int or size < 1:
        raise ValueError(f"batch_size {size!r}")
    if type(budget) is not int or budget < LEAST_BUDGET:
        raise ValueError(f"token_budget {budget!r}")
    keys = ["batch", "file"]
    rebuilt = plan_batches(analyse(files), edges, policy)
    kinds = dict(rebuilt.dtypes)
    # fields are compared as the types of the plan that is made again; what cannot be read so differs
    own = stored.select(*(F.col(k).cast(kinds[k]).alias(k) for k in keys), *(F.col(f).cast(kinds[f]).alias(f) for f in PLAN_FIELDS))
    rebuilt = rebuilt.select(*keys, *PLAN_FIELDS)
    sets = J.compare_sets(rebuilt, own, keys)
    values = J.compare_values(rebuilt, own, keys, list(PLAN_FIELDS)).where("field not in ('missing', 'extra')").withColumnRenamed("field", "problem")
    return sets.select(*keys, "problem").union(values.select(*keys, "problem")).distinct()


def audit_result(plan: DataFrame, results: DataFrame, problems: DataFrame) -> DataFrame:
    """batch, state: audited, missing, stray, or failed where there are problems."""
    p = problems.select("batch").distinct().withColumn("_p", F.lit(True))
    both = plan.select("batch").distinct().withColumn("_e", F.lit(True)).join(results.select("batch").distinct().withColumn("_a", F.lit(True)), "batch", "full").join(p, "batch", "left")
    return both.select("batch", F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "stray").when(F.col("_p"), "failed").otherwise("audited").alias("state"))


def impact_slice(files: DataFrame, changed: DataFrame, edges: DataFrame, definitions: DataFrame, calls: DataFrame, modules: list[str], depth: int, module_names: list[str] = C.MODULE_WIDE, global_files: list[str] = C.GLOBAL_FILES, before: DataFrame | None = None) -> DataFrame:
    """file: what a change reaches. files: file, text; changed: file, deleted; definitions: name, file; calls: caller_file, caller, name.

    A change of a global file (whole path) reaches all. Files of module_names and deletions widen to their module, a deletion
    without one to all; relations, callees and callers to `depth`. before (file, text): deleted files as they were, whose types
    are looked for as well; without them a file's name stands for its type.
    """
    live = changed.where("not deleted").select("file")
    wide = changed.where(F.col("deleted") | F.element_at(F.split("file", "/"), -1).isin(module_names)).select("file", "deleted")
    homes = J.longest_prefix(wide, modules)
    tree = J.longest_prefix(files.select("file"), modules)
    everything = homes.where("module is null and deleted").select("file").union(changed.where(F.col("file").isin(global_files)).select("file")).limit(1).withColumn("_all", F.lit(True)).select("_all")
    parts = [live, tree.join(homes.select("module").where("module is not null").distinct(), "module", "left_semi").select("file"), files.select("file").join(F.broadcast(everything), how="cross").select("file")]
    if depth > 0:
        parts.append(G.expand(edges, live.withColumnRenamed("file", "node"), depth).select(F.col("node").alias("file")))
        parts.append(calls.join(live.withColumnRenamed("file", "caller_file"), "caller_file", "left_semi").join(definitions, "name").select("file"))
        declared = definitions.join(live, "file", "left_semi").select("name").distinct()
        levels = G.frontier(calls.select(F.col("name").alias("callee"), "caller"), declared, max(depth - 1, 0))
        parts.append(calls.join(levels, "name").select(F.col("caller_file").alias("file")))
        gone = changed.where("deleted").select(F.regexp_extract("file", r"([A-Za-z_]\w*)\.(?:java|kt)$", 1).alias("name")).where("name <> ''")
        if before is not None:
            old = before.join(changed.where("deleted").select("file"), "file", "left_semi")
            gone = gone.union(inspect(old).select(F.explode("symbols").alias("name"))).distinct()
        parts.append(J.mentions(files, gone).select("file"))
    return X.impact(files, parts)


def merge_findings(confirmed: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, needs_review): required fields or nothing, the gate, identities, merging, and confirmed rows beating reviews.

    confirmed: the required fields, dataflow_path, origin_trace, root_cause, ordinal, and, where there are, candidate_id, source_candidate_ids,
    provenance and related_locations, which a merged finding keeps of all its rows; review: file, line, category, rule_id, root_cause, ordinal, ...
    """
    P.require(P.missing_fields(confirmed, P.CONFIRMED_FIELDS), "confirmed rows lack fields")
    P.require(P.missing_fields(review, P.REVIEW_FIELDS), "review rows lack fields")
    gated = P.gate(confirmed, P.needs_origin("category"), P.has_items("dataflow_path", "origin_trace"), "origin not traced")
    key = S.identity("file", "line", "category", "rule_id", "root_cause.primary_file", "root_cause.symbol", "root_cause.failure_mode")
    named = lambda df: df.withColumn("_i", key).withColumns({"key": F.col("_i.key"), "id": F.col("_i.id"), "dedup_scope": F.when(F.col("_i.semantic"), "root_cause").otherwise("exact")}).drop("_i")
    score = A.richness("evidence", "why", "repro", "suggestion", F.to_json("dataflow_path"), F.to_json("origin_trace"))
    own = named(P.confirmed_record(gated.where("queue = 'confirmed'")))
    ids = [F.col("source_candidate_ids")] if "source_candidate_ids" in own.columns else []
    if "candidate_id" in own.columns:
        ids.append(F.array("candidate_id"))
    if ids:
        own = own.withColumn("source_candidate_ids", F.filter(F.concat(*(F.coalesce(x.cast("array<string>"), F.array().cast("array<string>")) for x in ids)), lambda x: x != ""))
    lists = [c for c in ("source_candidate_ids", "provenance") if c in own.columns]
    findings = A.merge(own, "key", score, "ordinal", ["file", "line", "rule_id", "category"], detail=["end_line", "title"], lists=lists)
    held = named(P.review_record(gated.where("queue = 'needs_review'"))).unionByName(named(P.review_record(review)), allowMissingColumns=True)
    left, _ = J.beats(findings, held, ["key"])
    return findings, A.distinct_structs(left, "key", [], "ordinal")


def merge_receipt(confirmed: DataFrame, review: DataFrame) -> DataFrame:
    """The eight counters of merge_findings over the same inputs."""
    key = S.identity("file", "line", "category", "rule_id", "root_cause.primary_file", "root_cause.symbol", "root_cause.failure_mode")
    held = P.needs_origin("category") & ~P.has_items("dataflow_path", "origin_trace")
    one = lambda df, queue: df.select(key.alias("i"), queue.alias("queue")).select(F.col("i.key").alias("key"), F.col("i.semantic").alias("semantic"), "queue")
    return A.merge_counters(one(confirmed, F.when(held, "moved").otherwise("confirmed")).union(one(review, F.lit("review"))), "key", "semantic", "queue")


def enriched(rows: DataFrame) -> DataFrame:
    """Candidates with ids and the kind of their source, told by its file name."""
    return B.enrich(rows, "source", "index", "json", {r"^hunt": "ai_hunter", r"^gap": "ai_gap_auditor"}, "tool_engine")
