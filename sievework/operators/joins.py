"""Joins of the evidence model. Sides are told apart by their keys; Catalyst picks the strategy by their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import in_module

#: Rows of a table of a few columns whose lists a broadcast may carry.
LISTED = 1_000_000
#: Joins by tiers: rows of right that a block of left rows meets at once (504 numbers are a whole run of Parquet's packing, so that repeats
#: fall on the same bytes), such runs cut from one list, and blocks a task by the product.
RUN, RUNS, BLOCKS = 504, 32, 16


def map_rules(rows: DataFrame, rules: DataFrame, native: str, default: dict[str, Column]) -> DataFrame:
    """Adds rule_id, category, severity from the map by native id, or the defaults."""
    names = ("rule_id", "category", "severity")
    m = rules.select(F.col("native_rule_id").alias("_native"), *(F.col(n).alias(f"_{n}") for n in names))
    return rows.join(m, F.col(native) == F.col("_native"), "left").withColumns({n: F.coalesce(F.col(f"_{n}"), default[n]) for n in names}).drop("_native", *(f"_{n}" for n in names))


def unique_target(references: DataFrame, targets: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    """References joined with their target, where exactly one target fits."""
    single = targets.groupBy(*on).agg(F.count("*").alias("_k"), F.min(F.struct(*[c for c in targets.columns if c not in on])).alias("_t")).where("_k = 1")
    return references.join(single, on).select(*keys, "_t.*")


def prefer_tier(rows: DataFrame, keys: list[str], tier: Column, only_if_many: bool = True) -> DataFrame:
    """Of each key's rows those of the least tier (only where a key has several)."""
    w = W.partitionBy(*keys)
    out = rows.withColumn("_tier", tier).withColumn("_low", F.min("_tier").over(w)).withColumn("_k", F.count("*").over(w))
    keep = F.col("_tier") == F.col("_low")
    return out.where(keep | (F.col("_k") == 1) if only_if_many else keep).drop("_tier", "_low", "_k")


def first_tier(left: DataFrame, right: DataFrame, tiers: list[list[str]], keys: list[str] | None = None) -> DataFrame:
    """left joined with right on the first of the lists of columns on which a row of left finds any; an empty list is all of right.

    With keys, rows of left that share them (nulls too) take the first tier that any of them reaches, as a least tier over their pairs would say.
    What right holds is looked up first, so no pair is made that a tier drops. The result is the product by key, and keys may be few: left rows
    are gathered as blocks, more of them for a key that has more of the product (and a fourth as many by its rows), and blocks are dealt in ranges of keys over all
    tasks. A block meets right's rows in runs of RUN, a run with each row of the block before the next. So the product is written as repeats
    of short runs, which columnar files hold in a part of a byte a row, and what is shuffled grows with left and right alone.
    Runs are broadcast while right has at most LISTED rows, else joined as Catalyst picks.
    """
    spark = left.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = right.limit(LISTED + 1).count() <= LISTED
    small = F.broadcast if few else (lambda d: d)
    own = [c for c in right.columns if c not in left.columns]
    rows, reached = left, F.lit(None).cast("int")
    for k, on in reversed(list(enumerate(tiers))):
        if on:
            rows = rows.join(small(right.select(*on, F.lit(True).alias(f"_in{k}")).distinct()), on, "left")
        reached = F.when(F.col(f"_in{k}") if on else F.lit(True), k).otherwise(reached)
    rows = rows.select(*left.columns, reached.alias("_tier")).withColumn("_low", F.min("_tier").over(W.partitionBy(*keys)) if keys else F.col("_tier"))
    out = None
    for k, on in enumerate(tiers):
        meet = lambda x, y: x.join(y, on) if on else x.crossJoin(y)  # noqa: B023, E731
        met = rows.where((F.col("_tier") == k) & (F.col("_low") == k)).select(*left.columns)
        of = right.groupBy(*on).agg(F.count("*").alias("_r"))
        each = meet(met.groupBy(*on).agg(F.count("*").alias("_l")), small(of)).withColumn("_p", F.col("_l").cast("double") * F.col("_r"))
        total = each.agg(F.greatest(F.sum("_l"), F.lit(1)).alias("_ls"), F.greatest(F.sum("_p"), F.lit(1)).alias("_ps"))
        shares = each.crossJoin(F.broadcast(total)).select(*on, F.ceil(BLOCKS * tasks * (F.col("_p") / F.col("_ps") + F.col("_l") / F.col("_ls") / 4)).alias("_n"))
        share = F.pmod(F.xxhash64(*left.columns), F.greatest("_n", F.lit(1)))
        blocks = meet(met, small(shares)).groupBy(*on, share.alias("_share")).agg(F.collect_list(F.struct(*left.columns)).alias("_block")).repartitionByRange(tasks, *on, "_share")
        part = F.pmod(F.xxhash64(*own), F.ceil(F.col("_r") / (RUN * RUNS)))
        lists = meet(right, small(of)).groupBy(*on, part.alias("_part")).agg(F.collect_list(F.struct(*own)).alias("_all"))
        runs = lists.select(*on, F.explode(F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(RUN)), lambda i: F.slice("_all", i, RUN))).alias("_of"))
        hit = meet(blocks, small(runs)).select(F.explode("_block").alias("_b"), "_of").select("_b.*", F.explode("_of").alias("_o")).select(*left.columns, "_o.*")
        out = hit if out is None else out.union(hit)
    return out


def variant_targets(sources: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Each source with its targets by the steps of variant_tier: those of its module and source set, else of its module's main, else of its module, else all.

    sources: keys, module, source_set; targets: columns of their own, module, source_set, main (of its module). A module that is null is
    unknown, unlike the root module that variant_tier knows as null: it equals no other, and its sources take all targets.
    """
    left = sources.withColumn("_home", F.col("module"))
    right = targets.withColumn("_home", F.when(F.col("main"), F.col("module"))).drop("main")
    return first_tier(left, right, [["module", "source_set"], ["_home"], ["module"], []], keys).drop("_home")


def report_paths(reported: DataFrame, scope: DataFrame) -> DataFrame:
    """reported (column file) with `path`: the shortest file of the scope that ends the reported path, or else the path as it is.

    Each path meets the scope by its suffixes from a slash on, an equality join; there is no pairwise comparison.
    """
    plain = F.replace("file", F.lit("\\"), F.lit("/"))
    parts = F.split("_plain", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    paths = reported.select("file", plain.alias("_plain")).distinct()
    known = scope.select(F.col("file").alias("path")).distinct()
    found = paths.select("file", F.explode(suffixes).alias("path")).join(known, "path").groupBy("file").agg(F.min_by("path", F.length("path")).alias("path"))
    return reported.join(found, "file", "left").withColumn("path", F.coalesce("path", plain))


def variant_tier(source_set, module, target_set, target_module) -> Column:
    """Same module and source set, else the module's main, else the module, else any."""
    same = F.col(module).eqNullSafe(F.col(target_module))
    return F.when(same & F.col(source_set).eqNullSafe(F.col(target_set)), 0).when(same & (F.col(target_set) == "main"), 1).when(same, 2).otherwise(3)


def overlay_anchor(files: DataFrame, keys: list[str], file: str, preferred: Column) -> DataFrame:
    """(keys, file, anchor) for each file but its group's anchor: the preferred one, else the first by name."""
    anchor = files.groupBy(*keys).agg(F.min(F.struct((~preferred).alias("o"), F.col(file).alias("f"))).alias("_a"))
    return files.join(anchor, keys).select(*keys, file, F.col("_a.f").alias("anchor")).where(F.col(file) != F.col("anchor"))


def receipt_problems(batches: DataFrame, receipts: DataFrame, hashes: list[str]) -> DataFrame:
    """batch, problem of the receipts that maps left for batches: missing, extra or duplicate ones, and the names of hashes that differ from the batch's own."""
    differ = compare_values(batches, receipts, ["batch"], hashes).where("field not in ('missing', 'extra')").select("batch", F.col("field").alias("problem"))
    return compare_sets(batches, receipts, ["batch"]).select("batch", "problem").union(differ).distinct()


def beats(winner: DataFrame, loser: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(losing side without keys that the winner has, the removed rows)."""
    k = winner.select(*keys).distinct()
    return loser.join(k, keys, "left_anti"), loser.join(k, keys, "left_semi")


def compare_sets(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: missing, extra or duplicate."""
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    a = actual.groupBy(*keys).agg(F.count("*").alias("_a"))
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_a") > 1, "duplicate")
    return e.join(a, keys, "full").withColumn("problem", problem).where("problem is not null").drop("_e", "_a")


def compare_values(expected: DataFrame, actual: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, field: each value that differs (null-safe), or `missing`/`extra` where one side lacks the key."""
    e = expected.select(*keys, F.struct(*values).alias("_e"))
    a = actual.select(*keys, F.struct(*values).alias("_a"))
    differs = [F.when(~F.col(f"_e.{v}").eqNullSafe(F.col(f"_a.{v}")), v) for v in values]
    field = F.when(F.col("_a").isNull(), F.array(F.lit("missing"))).when(F.col("_e").isNull(), F.array(F.lit("extra"))).otherwise(F.array_compact(F.array(*differs)))
    return e.join(a, keys, "full").select(*keys, F.explode(field).alias("field"))


def partition_problems(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """key, problem: an input in no output, in several, or an output that was no input."""
    counts = inputs.select(key).distinct().withColumn("_in", F.lit(1)).join(outputs.groupBy(key).agg(F.count("*").alias("_out")), key, "full")
    problem = F.when(F.col("_out").isNull(), "missing").when(F.col("_in").isNull(), "unknown").when(F.col("_out") > 1, "repeated")
    return counts.withColumn("problem", problem).where("problem is not null").select(key, "problem")


def provenance_problems(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """record, problem: records whose provenance (array of canonical texts) is not, as a set without repeats, that of their inputs.

    records: record, source_candidate_ids, provenance; inputs: candidate_id, provenance.
    """
    asked = records.select("record", F.explode(F.array_distinct("source_candidate_ids")).alias("candidate_id"))
    met = asked.join(inputs.select("candidate_id", F.col("provenance").alias("_p"), F.lit(True).alias("_known")), "candidate_id", "left")
    want = met.groupBy("record").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("_p", F.array().cast("array<string>")))))).alias("_want"), F.bool_or(F.col("_known").isNull()).alias("_unknown"))
    p = F.coalesce("provenance", F.array().cast("array<string>"))
    both = records.join(want, "record", "left").withColumn("_want", F.coalesce("_want", F.array().cast("array<string>")))
    found = F.array_compact(F.array(
        F.when(F.coalesce(F.size("source_candidate_ids"), F.lit(0)) <= 0, "no-source").when(F.size("source_candidate_ids") != F.size(F.array_distinct("source_candidate_ids")), "repeated-source"),
        F.when(F.col("_unknown"), "unknown-source"),
        F.when(F.size(p) <= 0, "no-provenance").when((F.size(p) != F.size(F.array_distinct(p))) | (F.array_sort(p) != F.col("_want")), "provenance"),
    ))
    return both.select("record", F.explode(found).alias("problem"))


def plan_difference(planned: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that only one side has, with `side`; repeated rows count."""
    return planned.exceptAll(rebuilt.select(planned.columns)).withColumn("side", F.lit("planned")).union(rebuilt.select(planned.columns).exceptAll(planned).withColumn("side", F.lit("rebuilt")))


def edge_split(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with an end in a batch: batch, part (internal or boundary). members: batch, node. Repeated edges and members count once.

    Each edge meets the batches of its two ends and gives a row for each of them; its rows are not gathered again. Edges are dealt before
    they are made distinct, over as many tasks as the session sets, so what a task holds falls with their number.
    """
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = edges.repartition(tasks, *edges.columns).distinct()
    of = members.groupBy("node").agg(F.collect_set(F.struct("batch")).alias("_b"))
    s, t = of.select(F.col("node").alias("source"), F.col("_b").alias("_s")), of.select(F.col("node").alias("target"), F.col("_b").alias("_t"))
    none = F.array().cast(of.schema["_b"].dataType)
    met = one.join(s, "source", "left").join(t, "target", "left").withColumns({"_s": F.coalesce("_s", none), "_t": F.coalesce("_t", none)})
    ends = met.select(*edges.columns, "_s", "_t", F.explode(F.array_union("_s", "_t")).alias("_x"))
    both = F.array_contains("_s", F.col("_x")) & F.array_contains("_t", F.col("_x"))
    return ends.select(F.col("_x.batch").alias("batch"), *edges.columns, F.when(both, "internal").otherwise("boundary").alias("part"))


def longest_prefix(files: DataFrame, modules: list[str]) -> DataFrame:
    """Adds module: the longest of a project's modules that holds the file, else null. Modules are a short list of a project."""
    hit = F.array_compact(F.array(*(F.when(in_module("file", m), m) for m in sorted(modules, key=lambda m: (-len(m), m)))).cast("array<string>"))
    return files.withColumn("module", F.get(hit, F.lit(0)))


def mentions(files: DataFrame, names: DataFrame, pattern: str = r"([A-Za-z_]\w*)") -> DataFrame:
    """file, name of each name that stands in a file's text as a whole word: an equi join on the words."""
    words = files.select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("name"))
    return words.join(names.select("name").distinct(), "name").select("file", "name")


def caller_confidence(references: DataFrame) -> DataFrame:
    """Adds confidence and its rank: high where the receiver's or own type is the owner, nominal where the name has one definition, else ambiguous.
    references: owner (wanted, may be null), receiver_type, enclosing_type, definitions (of the name)."""
    same = F.coalesce(F.col("receiver_type") == F.col("owner"), F.lit(False)) | (F.col("receiver_type").isNull() & F.coalesce(F.col("enclosing_type") == F.col("owner"), F.lit(False)))
    name = F.when(same, "high").when(F.coalesce(F.col("definitions") == 1, F.lit(False)), "nominal").otherwise("ambiguous")
    return references.withColumn("confidence", name).withColumn("confidence_rank", F.when(name == "high", 0).when(name == "nominal", 1).otherwise(2))


def definitions(defs: DataFrame, name: str, owner: str | None = None) -> DataFrame:
    out = defs.where(F.col("name") == name)
    return out.where(F.col("owner") == owner) if owner else out


def callees(defs: DataFrame, name: str, hint: str = "read the body and look up the definition of each name in it") -> DataFrame:
    """Definitions of a method with a hint: no edges to what it calls are made, they come from looking its body's names up."""
    return definitions(defs, name).withColumn("hint", F.lit(hint))


def type_hierarchy(defs: DataFrame, refs: DataFrame, name: str) -> DataFrame:
    """A type's definitions and what refers to it: role, file, line."""
    d = defs.where((F.col("name") == name) & F.col("kind").isin("class", "interface", "object", "enum", "type"))
    return d.select(F.lit("definition").alias("role"), "file", "line").union(refs.where(F.col("name") == name).select(F.lit("reference").alias("role"), "file", "line"))


def external_callers(refs: DataFrame, batch_defs: DataFrame, batch_files: DataFrame) -> DataFrame:
    """References to a batch's names from files outside of it."""
    return refs.join(batch_defs.select("name").distinct(), "name", "left_semi").join(batch_files.select("file").distinct(), "file", "left_anti")


def unselected(registry: DataFrame, selected: DataFrame, reason: str) -> DataFrame:
    """A skipped row for each engine of the registry that was not selected."""
    return registry.select("engine").join(selected.select("engine"), "engine", "left_anti").select("engine", F.lit("skipped").alias("status"), F.lit(reason).alias("reason"))


def score_sets(returned: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """by, tp, fp, fn of two sets of rows."""
    r, t = returned.select(*by, *keys).distinct().withColumn("_r", F.lit(1)), truth.select(*by, *keys).distinct().withColumn("_t", F.lit(1))
    n = lambda c: F.count(F.when(c, 1))
    return r.join(t, by + keys, "full").groupBy(*by).agg(n(F.col("_r").isNotNull() & F.col("_t").isNotNull()).alias("tp"), n(F.col("_t").isNull()).alias("fp"), n(F.col("_r").isNull()).alias("fn"))


def gated(tags: DataFrame, gates: DataFrame) -> DataFrame:
    """batch, perspective where a gate has no tag (always) or one of the batch's tags. tags: batch, tag; gates: perspective, tag (null: always)."""
    always = tags.select("batch").distinct().join(gates.where("tag is null").select("perspective"), how="cross")  # a fixed list of perspectives
    return always.union(tags.join(gates.where("tag is not null"), "tag").select("batch", "perspective")).distinct()
