"""The relation graph of a source tree and navigation in it. nodes: file, module, source_set, package, symbols, imports, identifiers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import scalar as S
from sievework.sources.readers import DECLARATION

from . import aggregates as A
from . import joins as J
from .graph import WEIGHTS
from .nesting import BEFORE_NAME, COMMENT_LINE, NOT_BEFORE, code_blocks, enclosing

# Words before a bracket that are no call.
KEYWORDS = ["if", "for", "while", "switch", "catch", "synchronized", "return", "new", "else", "do", "try", "when", "super", "this"]
# Names before a parenthesis that are no call where a change's callees are looked for.
CALL_STOP = ["if", "for", "while", "when", "switch", "catch", "return", "throw", "new", "super", "this", "synchronized", "require", "check", "assert"]


def _declared(nodes: DataFrame) -> DataFrame:
    d = nodes.select("file", "module", "source_set", "package", F.explode("symbols").alias("name"))
    return d.withColumn("fqn", F.concat_ws(".", "package", "name"))


def _raw(rows: DataFrame, kind: str, evidence) -> DataFrame:
    out = rows.where("source <> target").select("source", "target", F.lit(kind).alias("kind"), F.lit(WEIGHTS[kind]).cast("long").alias("weight"), evidence.alias("evidence"))
    return out.withColumn("ordinal", F.xxhash64("evidence"))


def _pick(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of several targets those of the best variant: the source's own set, its module's main, its module, any."""
    return J.prefer_tier(rows, keys, J.variant_tier("source_set", "module", "target_set", "target_module"))


def import_edges(nodes: DataFrame) -> DataFrame:
    """A file that imports a declared full name; imports with a star are skipped."""
    wants = nodes.select(F.col("file").alias("source"), "module", "source_set", F.explode("imports").alias("fqn")).where("fqn not like '%*'")
    has = _declared(nodes).select("fqn", F.col("file").alias("target"), F.col("module").alias("target_module"), F.col("source_set").alias("target_set"))
    return _raw(_pick(wants.join(has, "fqn"), ["source", "fqn"]), "import", F.col("fqn"))


def type_edges(nodes: DataFrame) -> DataFrame:
    """A file that names a type which resolves to exactly one file: in its own package first, else by the simple name.

    Declarations are counted first: by package and name, then by name alone, each in the three variants; a use meets a row of
    counts and one file of each level, however many files declare the name.
    """
    wants = nodes.select(F.col("file").alias("source"), "module", "source_set", "package", F.explode("identifiers").alias("name"))
    d = nodes.select(F.explode("symbols").alias("name"), F.coalesce("package", F.lit("")).alias("p"), F.col("module").alias("m"), F.col("source_set").alias("s"), "file").distinct()
    first = None
    rows = wants.withColumn("p", F.coalesce("package", F.lit("")))
    for scope in (["p"], []):
        found = rows
        for level, own in enumerate((["m", "s"], ["m", "main"], ["m"], [])):
            keys = ["name", *scope, *(k for k in own if k != "main")]
            held = (d.where("s = 'main'") if "main" in own else d).groupBy(*keys).agg(F.count("*").alias(f"k{level}"), F.min("file").alias(f"t{level}"))
            left = found.withColumn("m", F.col("module")).withColumn("s", F.col("source_set"))
            found = left.join(held, keys, "left").drop("m", "s")
        pick_k = F.coalesce(*(f"k{level}" for level in range(4)))
        pick_t = F.coalesce(*(f"t{level}" for level in range(4)))
        found = found.select("source", "module", "source_set", "package", "p", "name", pick_k.alias("k"), pick_t.alias("target"))
        hit = found.where("k is not null").select("source", "name", "k", "target")
        first = hit if first is None else first.union(hit)
        rows = found.where("k is null").drop("k", "target")
    return _raw(first.where("k = 1"), "type", F.col("name"))


def component_edges(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """A manifest and the class of a component it declares: the full name, else the last part, if exactly one file has it in the best variant.
    components: file, package, value and, if there, module and source_set."""
    at = [F.col(c) if c in components.columns else F.lit("").alias(c) for c in ("module", "source_set")]
    c = components.select(F.col("file").alias("source"), *at, S.component_class("value", "package").alias("fqn"))
    d = _declared(nodes).select("fqn", "name", F.col("file").alias("target"), F.col("module").alias("target_module"), F.col("source_set").alias("target_set"))
    exact = c.join(d.drop("name"), "fqn")
    rest = c.join(exact.select("source", "fqn").distinct(), ["source", "fqn"], "left_anti").withColumn("name", F.substring_index("fqn", ".", -1))
    loose = rest.join(d.drop("fqn"), "name").select(*exact.columns)
    best = _pick(exact.union(loose), ["source", "fqn"])
    only = best.groupBy("source", "fqn").agg(F.countDistinct("target").alias("k"), F.min("target").alias("target")).where("k = 1")
    return _raw(only, "component", F.col("fqn"))


def resource_edges(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """A file and the files that define a resource it refers to: of its own module, else of the root module; the source's
    set first, then main, then all. references, definitions: file, module, source_set, key."""
    r = references.select(F.col("file").alias("source"), "module", "source_set", "key")
    d = definitions.select(F.col("file").alias("target"), F.col("module").alias("target_module"), F.col("source_set").alias("target_set"), "key")
    both = r.join(d, "key").where("module = target_module or target_module = ''")
    own = J.prefer_tier(both, ["source", "key"], F.when(F.col("module") == F.col("target_module"), 0).otherwise(1))
    set_ = F.when(F.col("source_set") == F.col("target_set"), 0).when(F.col("target_set") == "main", 1).otherwise(2)
    return _raw(J.prefer_tier(own, ["source", "key"], set_), "resource", F.col("key"))


def build_edges(dependencies: DataFrame, scripts: DataFrame) -> DataFrame:
    """A build script and the script of a project it depends on. dependencies: file, module; scripts: file, module."""
    both = dependencies.select(F.col("file").alias("source"), "module").join(scripts.select(F.col("file").alias("target"), "module"), "module")
    return _raw(both, "gradle", F.col("module"))


def overlay_edges(nodes: DataFrame) -> DataFrame:
    """A file of a source set and the file it overlays: main's, else the first by name. nodes: also tail, the path in the set."""
    return _raw(J.overlay_anchor(nodes, ["module", "tail"], "file", F.col("source_set") == "main").select(F.col("file").alias("source"), F.col("anchor").alias("target"), "tail"), "overlay", F.col("tail"))


def graph(parts: list[DataFrame]) -> DataFrame:
    """One row for each (source, target, kind) of the parts' raw edges."""
    from .sets import union_all

    return A.edges(union_all(parts), "ordinal")


def index(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(definitions, references) of source lines by patterns: name, kind, file, line, signature; name, file, line, receiver, snippet; both
    with enclosing_type and enclosing_symbol, what the blocks around a line declare (of a declaration: itself, if it opens a block)."""
    code = lines.where(~F.col("text").rlike(COMMENT_LINE))
    blocks = code_blocks(lines)
    signature = F.left(S.strip("text"), F.lit(200)).alias("signature")
    types = code.select(F.explode(F.regexp_extract_all("text", F.lit(DECLARATION), F.lit(1))).alias("name"), F.lit("type").alias("kind"), "file", "line", signature)
    before, name = (F.regexp_extract("text", BEFORE_NAME, k) for k in (1, 2))
    methods = code.where((name != "") & ~F.regexp_extract(before, r"(\S+)$", 1).isin(*NOT_BEFORE)).select(name.alias("name"), F.lit("method").alias("kind"), "file", "line", signature)
    defs = types.union(methods).where(~F.col("name").isin(*KEYWORDS))
    calls = code.select("file", "line", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))).alias("name")).where(~F.col("name").isin(*KEYWORDS))
    refs = calls.join(methods.select("name", "file", "line"), ["name", "file", "line"], "left_anti")
    refs = refs.select("name", "file", "line", S.receiver("text", "name").alias("receiver"), F.left(S.strip("text"), F.lit(200)).alias("snippet"))
    return enclosing(defs, blocks), enclosing(refs, blocks)


def receiver_types(lines: DataFrame) -> DataFrame:
    """file, variable, type of declarations; the last part of a type with dots. The first form that a file has of a variable wins, and its first place.

    Forms, in order: Type name before = ; , ) or the line's end; val or var name: Type; val or var name = Type(...).
    """
    forms = [(r"\b([A-Z][\w$.]*)\s+([A-Za-z_]\w*)\s*(?:[=;,)]|$)", 2, 1), (r"\b(?:val|var)\s+(\w+)\s*:\s*([A-Z][\w$.]*)", 1, 2), (r"\b(?:val|var)\s+(\w+)\s*=\s*([A-Z][\w$.]*)\s*\(", 1, 2)]
    every = lambda p, k: F.regexp_extract_all("text", F.lit(p), F.lit(k))
    pair = lambda p, v, t: F.arrays_zip(every(p, v).alias("v"), every(p, t).alias("t"))
    placed = lambda k: lambda x, i: F.struct(F.lit(k).alias("form"), i.alias("at"), x["v"].alias("variable"), F.substring_index(x["t"], ".", -1).alias("type"))
    found = F.flatten(F.array(*(F.transform(pair(*form), placed(k)) for k, form in enumerate(forms))))
    rows = lines.select("file", "line", F.explode(found).alias("x")).select("file", "line", "x.*").where("variable not in ('this', 'super')")
    return rows.groupBy("file", "variable").agg(F.min_by("type", F.struct("form", "line", "at")).alias("type"))


def callers(refs: DataFrame, symbol: str, types: DataFrame) -> DataFrame:
    """References to a symbol with confidence and how they matched, best first. refs: as of index(), and enclosing_type."""
    one = refs.sparkSession.range(1).select(S.method_hint(F.lit(symbol)).alias("m"), S.class_hint(F.lit(symbol)).alias("c")).first()
    method, owner = one["m"] or symbol, one["c"]
    r = refs.where(F.col("name") == method).join(types.select("file", F.col("variable").alias("receiver"), F.col("type").alias("receiver_type")), ["file", "receiver"], "left")
    tail = F.substring_index("receiver", ".", -1)
    chain = F.col("snippet").rlike(rf"(?<![\w$]){re.escape(owner)}(?![\w$])[^;\n]*\.\s*{re.escape(method)}\s*\(") if owner else F.lit(False)
    how = (
        F.when(F.lit(not owner), "method-name")
        .when(tail == owner, "explicit-receiver")
        .when(F.col("receiver_type") == owner, "inferred-receiver-type")
        .when(chain, "type-reference-chain")
        .when((F.col("enclosing_type") == owner) & tail.isin("", "this"), "same-owner")
        .when(tail == "super", "super-dispatch")
        .otherwise("method-name-only")
    )
    r = r.withColumn("matched_by", how)
    level = F.when(F.col("matched_by").isin("explicit-receiver", "inferred-receiver-type", "same-owner"), "high").when(F.col("matched_by").isin("method-name", "type-reference-chain"), "nominal").otherwise("ambiguous")
    rank = F.when(F.col("confidence") == "high", 0).when(F.col("confidence") == "nominal", 1).otherwise(2)
    return r.withColumn("confidence", level).withColumn("confidence_rank", rank).orderBy("confidence_rank", "file", "line")


def snippets(candidates: DataFrame, lines: DataFrame, most: int = 300) -> DataFrame:
    """Adds `snippet`: the lines from line to end_line, cut to `most` characters. candidates: file, line, end_line."""
    spans = candidates.select("file", "line", F.coalesce("end_line", "line").alias("_end")).distinct()
    each = spans.select("file", "line", F.explode(F.sequence("line", F.greatest("line", "_end"))).alias("_l"), "_end")
    text = each.join(lines.select("file", F.col("line").alias("_l"), "text"), ["file", "_l"]).groupBy("file", "line", "_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_l", "text"))), lambda x: x.text), "\n").alias("snippet"))
    return candidates.withColumn("_end", F.coalesce("end_line", "line")).join(text.withColumn("snippet", F.left("snippet", F.lit(most))), ["file", "line", "_end"], "left").drop("_end")


def changes(tracked: DataFrame, untracked: DataFrame, present: DataFrame) -> DataFrame:
    """file, deleted of a change list and new files; a tracked entry wins, what is not present counts as deleted."""
    both = tracked.select("file", F.lit(0).alias("o")).union(untracked.select("file", F.lit(1).alias("o"))).select("file").distinct()
    here = present.select("file").distinct().withColumn("_p", F.lit(True))
    return both.join(here, "file", "left").select("file", F.col("_p").isNull().alias("deleted"))
