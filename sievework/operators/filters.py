"""Predicates and projections over files, candidates and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.scalar import braces, col, glob_regex, normal_path, strip

# Categories that hold only once their origin is traced.
ORIGIN_PREFIXES = (
    "stability/static-context-leak",
    "perf/main-thread",
    "performance/thread-starvation",
    "performance/main-thread",
    "security/exported",
    "security/ipc-caller-unverified",
    "security/webview",
    "security/deeplink",
)
ORIGIN_PARTS = ("-data-flow", "unvalidated-input", "越权")
# Fields that a confirmed and a review record must have.
CONFIRMED_FIELDS = ("file", "line", "rule_id", "category", "severity", "title", "evidence", "why", "repro", "suggestion")
REVIEW_FIELDS = ("file", "line", "rule_id", "category", "severity", "title", "evidence")
# Engine statuses.
STATUSES = ("complete", "partial", "failed", "skipped", "not_applicable")
# Paths of generated code.
GENERATED = (
    r"/build/",
    r"(^|/)\.cxx/",
    r"(^|/)\.externalNativeBuild/",
    r"(^|/)CMakeFiles/",
    r"(^|/)CMakeCache\.txt$",
    r"(^|/)compile_commands\.json$",
    r"(^|/)compiler_id_[^/]*\.(c|cc|cpp)$",
    r"(^|/)R\.java$",
    r"BuildConfig\.(java|kt)$",
    r"databinding",
    r"DataBinderMapper",
    r"_GeneratedInjector",
    r"(^|/)Dagger[A-Z]\w*\.java$",
    r"\.g\.(kt|java)$",
    r"GeneratedAppGlideModule",
)


# Folders of test sources.
TEST_SETS = ("/src/test/", "/src/androidTest/", "/src/AndroidTest/")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches_any(file, globs: list[str]) -> Column:
    """Any path pattern matches, the whole path or its last parts; see glob_regex."""
    return any_of([col(file).rlike(glob_regex(g)) for x in globs for g in braces(x)])


def excluded(file, directories: list[str], names: list[str], globs: list[str]) -> Column:
    """A directory of the path, its file name or a pattern says no."""
    parts = F.split(col(file), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, directories)).cast("array<string>")) | F.element_at(parts, -1).isin(names) | matches_any(file, globs)


def generated(file) -> Column:
    return col(file).rlike("|".join(GENERATED))


def test_source(file) -> Column:
    """Files of test source sets, which the index leaves out."""
    path = F.concat(F.lit("/"), col(file))
    return any_of([path.contains(x) for x in TEST_SETS])


def in_module(file, module: str) -> Column:
    return (col(file) == module) | col(file).startswith(module.rstrip("/") + "/")


def user_filter(files: DataFrame, modules: list[str], module: str | None = None, globs: list[str] = []) -> DataFrame:
    """Files of a module (which must be known), then those that any pattern matches."""
    if module and module not in modules:
        raise ValueError(f"unknown module {module}")
    if module:
        files = files.where(in_module("file", module))
    return files.where(matches_any("file", globs)) if globs else files


def needs_origin(category) -> Column:
    c = F.coalesce(col(category), F.lit(""))
    return any_of([c.startswith(p) for p in ORIGIN_PREFIXES] + [c.contains(s) for s in ORIGIN_PARTS])


def has_items(*arrays) -> Column:
    return any_of([F.coalesce(F.size(col(a)) > 0, F.lit(False)) for a in arrays])


def gate(confirmed: DataFrame, needs: Column, has: Column, reason: str) -> DataFrame:
    """Adds queue (confirmed or needs_review), review_reason and missing_evidence: rows that need an origin and have none go to review."""
    held = needs & ~has
    return confirmed.withColumns({
        "queue": F.when(held, "needs_review").otherwise("confirmed"),
        "review_reason": F.when(held, reason),
        "missing_evidence": F.when(held, F.array(F.lit("origin"))),
    })


def missing_fields(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row (all columns, and `field`) for each required field that is null or blank."""
    problem = F.filter(F.array(*(F.when(F.col(f).isNull() | (strip(F.col(f).cast("string")) == ""), f) for f in fields)), lambda x: x.isNotNull())
    return rows.withColumn("field", F.explode(problem))


def require(problems: DataFrame, what: str) -> None:
    """Fails if there is any problem row; a whole merge stops then."""
    rows = problems.limit(5).collect()
    if rows:
        raise ValueError(f"{what}: {rows}")


def location_problems(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates whose file is unknown or whose lines lie outside of it, with `problem`. files: file, line_count."""
    known = files.select(F.col("file").alias("_file"), F.col("line_count").alias("_lines"))
    joined = candidates.join(known, normal_path("file") == F.col("_file"), "left")
    problem = (
        F.when(F.col("_file").isNull(), "file")
        .when(F.col("line").isNull() | (F.col("line") < 1) | (F.col("line") > F.col("_lines")), "line")
        .when(F.col("end_line").isNotNull() & ((F.col("end_line") < F.col("line")) | (F.col("end_line") > F.col("_lines"))), "end_line")
    )
    return joined.withColumn("problem", problem).where("problem is not null").drop("_file", "_lines")


def strict_integer(json, path: str) -> Column:
    """Whether a JSON text has a whole number at a path; true, false and 1.5 are none."""
    v = F.variant_get(F.parse_json(col(json)), path, "variant")
    return F.coalesce(F.schema_of_variant(v) == "BIGINT", F.lit(False))


def in_scope(rows: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Rows whose file is in scope; no scope, or an empty one, lets all pass."""
    if scope is None or not scope.head(1):
        return rows
    return rows.join(scope.select("file").distinct(), "file", "left_semi")


def status_or_failed(status) -> Column:
    return F.when(col(status).isin(*STATUSES), col(status)).otherwise("failed")


def confirmed_record(rows: DataFrame) -> DataFrame:
    """Defaults of a confirmed finding: end_line is line, status is open."""
    return rows.withColumns({"end_line": F.coalesce("end_line", "line"), "status": F.lit("open")})


def review_record(rows: DataFrame, fields: tuple[str, ...] = ("why", "repro", "suggestion", "review_reason")) -> DataFrame:
    have = [f for f in fields if f in rows.columns]
    return rows.withColumns({f: F.coalesce(F.col(f), F.lit("")) for f in have} | {"end_line": F.coalesce("end_line", "line"), "status": F.lit("needs_review")})


def flags(text, markers: dict[str, str]) -> Column:
    """Names of the patterns found anywhere in the text, sorted: one pass of boolean expressions."""
    return F.array_compact(F.array(*(F.when(col(text).rlike(p), n) for n, p in sorted(markers.items()))))


def risk(text, signals: list[tuple[str, int]], long_lines: int | None = 600) -> Column:
    """Sum of the weights of the patterns found (not of their hits), and one more for long texts."""
    out = sum((F.when(col(text).rlike(p), w).otherwise(0) for p, w in signals), F.lit(0))
    if long_lines is not None:
        t = F.coalesce(col(text), F.lit(""))
        out = out + F.when(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) > long_lines, 1).otherwise(0)
    return out.cast("int")


def weighed(tags, weights: dict[str, int]) -> Column:
    """The weights of the names in an array, as of flags(): what the patterns have found is not looked for again."""
    return sum((F.when(F.array_contains(col(tags), n), w).otherwise(0) for n, w in weights.items()), F.lit(0)).cast("int")


def rule_hits(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """file, line, rule_id, category, severity, snippet of each line that a rule's pattern matches. rules: rule_id, pattern, category, severity, and paths (globs, optional)."""
    hit = [F.when(F.col("text").rlike(r["pattern"]) & (matches_any("file", r["paths"]) if r.get("paths") else F.lit(True)), F.struct(*(F.lit(r[k]).alias(k) for k in ("rule_id", "category", "severity")))) for r in rules]
    return lines.withColumn("rule", F.explode(F.array_compact(F.array(*hit)))).select("file", "line", "rule.*", F.left("text", F.lit(300)).alias("snippet"))


# Build types that do not ship, beside those that end with the first.
NOT_SHIPPED = ("debug", "test", "androidtest")


def _first_up(text) -> Column:
    return F.concat(F.upper(F.left(col(text), F.lit(1))), F.substring(col(text), F.lit(2), F.length(col(text))))


def shipping_types(types, skip: tuple[str, ...] = NOT_SHIPPED) -> Column:
    """The build types (array) that ship, in their order; release where none does or none is given."""
    kept = F.filter(F.coalesce(col(types), F.array().cast("array<string>")), lambda x: ~F.lower(x).isin(*skip) & ~F.lower(x).endswith(NOT_SHIPPED[0]))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("release")))


def variant_names(flavors, types) -> Column:
    """Names of a project's shipping variants: each flavor with each type that ships, or the types alone. Both are a build script's short arrays."""
    f, t = F.coalesce(col(flavors), F.array().cast("array<string>")), shipping_types(types)
    return F.when(F.size(f) > 0, F.flatten(F.transform(f, lambda x: F.transform(t, lambda y: F.concat(x, _first_up(y)))))).otherwise(t)


def lint_tasks(flavors, types) -> Column:
    """The checks to run for a project, in order and once each: of its variants, of its types where there are flavors, and the one of all."""
    task = lambda a: F.transform(a, lambda x: F.concat(F.lit("lint"), _first_up(x)))
    return F.array_distinct(F.concat(task(variant_names(flavors, types)), task(shipping_types(types)), F.array(F.lit("lint"))))


def shipping_variants(flavors: DataFrame, types: DataFrame, skip: tuple[str, ...] = NOT_SHIPPED) -> DataFrame:
    """flavor, build_type, variant of one project's flavors and types that ship; both are short lists."""
    listed = types.agg(shipping_types(F.collect_list("build_type"), skip).alias("_t"))
    return flavors.join(F.broadcast(listed), how="cross").select("flavor", F.explode("_t").alias("build_type")).withColumn("variant", F.concat("flavor", _first_up("build_type")))
