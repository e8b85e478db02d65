"""XML as a table of elements with nested intervals, and what a project's files declare and refer to: the relation graph from raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import scalar as S
from sievework.sources import readers as R

from . import relations as N
from .nesting import nest

MARKUP = r"<!--[\s\S]*?-->|<[?!][^>]*>|</?[A-Za-z_][^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*>"
ATTRIBUTE = r"([A-Za-z_][\w:.\-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
# Attributes that name a class, tags of a values file and the resource type they define, places of files and resources, references.
CLASS_ATTRIBUTES = ["name", "targetActivity", "parentActivityName", "backupAgent", "manageSpaceActivity", "class"]
CLASS_NAME = r"^[.$A-Za-z_][\w.$]*$"
VALUE_TAGS = {"string": "string", "color": "color", "dimen": "dimen", "bool": "bool", "integer": "integer", "plurals": "plurals", "style": "style", "attr": "attr", "declare-styleable": "styleable", "string-array": "array", "integer-array": "array", "array": "array"}
SOURCE_SET = r"^(?:(.+?)/)?src/([^/]+)/(.+)$"
RESOURCE_PATH = r"^(?:(.+?)/)?src/([^/]+)/res/([^/]+)/([^/.]+)\.[^/]+$"
RESOURCE_USE = {r"\bR\.([A-Za-z_]\w*)\.([A-Za-z_]\w*)", r"@\+?([A-Za-z_]\w*)/([A-Za-z_]\w*)"}
INLINE_ID = r"@\+id/([A-Za-z_]\w*)"
PROJECT_DEPENDENCY = r"project\s*\(\s*(?:path\s*(?:=|:)\s*)?['\"]:([^'\"]+)['\"]\s*\)"
BUILD_FILES = ["build.gradle", "build.gradle.kts"]
CODE = (".java", ".kt")


def shred(files: DataFrame, void: list[str] = []) -> DataFrame:
    """file, element, close, level, parent, tag, attributes array<struct<name, value>> of the elements of marked-up texts (file, text).

    element and close are the places of an element's two tags in the file's order: x is inside y if it lies between them. An empty
    element (and one of the `void` tags) closes at once; remarks and declarations count for nothing, stray closing tags are passed over.
    """
    tags = files.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(MARKUP), F.lit(0))).alias("k", "m")).where(~F.substring("m", 2, 1).isin("!", "?"))
    tag = F.regexp_extract("m", r"^</?([A-Za-z_][\w:.\-]*)", 1)
    tags = tags.withColumn("tag", tag)
    ends = F.startswith("m", F.lit("</"))
    alone = F.endswith("m", F.lit("/>")) | tag.isin(*void)
    steps = F.when(ends, F.array(F.lit(-1))).when(alone, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    events = tags.where(~(ends & tag.isin(*void))).select("file", "k", "tag", "m", F.posexplode(steps).alias("_i", "step")).withColumn("element", F.col("k").cast("long") * 2 + F.col("_i"))
    part = lambda k: F.regexp_extract_all("m", F.lit(ATTRIBUTE), F.lit(k))
    own = F.transform(F.arrays_zip(part(1).alias("n"), part(2).alias("a"), part(3).alias("b")), lambda x: F.struct(x["n"].alias("name"), F.concat(x["a"], x["b"]).alias("value")))
    return nest(events.drop("k", "_i"), ["file"], "element").select("file", "element", "close", "level", "parent", "tag", own.alias("attributes"))


def attribute(name: str):
    return F.get(F.filter("attributes", lambda x: x["name"] == name), F.lit(0))["value"]


def inside(elements: DataFrame, outer: DataFrame) -> DataFrame:
    """Elements that lie in one of the outer ones (file, element, close) of their file: an interval for each row, found by the nesting itself."""
    from .nesting import around

    marked = outer.select("file", "element", "close", F.lit(True).alias("_in"))
    return around(elements.withColumn("_at", F.col("element") - 1), marked, ["file"], "_at", "element", "_in").where("_in").drop("_in", "_at")


def nodes(files: DataFrame) -> DataFrame:
    """file, kind, module, source_set, tail, package, symbols, imports, identifiers, analysis_state of a project's files (file, bytes, text).

    Files beyond the indexed size have no contents here, and the state oversized.
    """
    large = F.col("bytes") > R.LARGEST_INDEXED
    rows = files.select("file", F.when(large, "").otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.when(large, "oversized").when(F.col("text").isNull(), "unreadable").otherwise("complete").alias("analysis_state"))
    name = F.element_at(F.split("file", "/"), -1)
    code = F.lit(False)
    for e in CODE:
        code = code | F.lower("file").endswith(e)
    place = lambda k: F.regexp_extract("file", SOURCE_SET, k)
    folder = F.regexp_replace("file", r"/?[^/]+$", "")
    kind = F.when(code, "code").when(F.lower("file").endswith(".xml"), "xml").otherwise("config")
    rows = rows.withColumns({"kind": kind, "module": F.when(name.isin(*BUILD_FILES), folder).otherwise(place(1)), "source_set": place(2), "tail": place(3)})
    read = R.inspect(rows.where("kind = 'code'").select("file", "text"))
    empty = F.array().cast("array<string>")
    out = rows.join(read, "file", "left").withColumns({c: F.coalesce(c, empty) for c in ("symbols", "imports", "identifiers")})
    return out.select("file", "kind", "module", "source_set", "tail", F.coalesce("package", F.lit("")).alias("package"), "symbols", "imports", "identifiers", "analysis_state", "text")


def components(known: DataFrame, elements: DataFrame) -> DataFrame:
    """file, module, source_set, package, value: classes that XML names, in an attribute or as a tag; the package is the manifest's."""
    package = elements.where("tag = 'manifest'").groupBy("file").agg(F.min_by(attribute("package"), "element").alias("package"))
    local = lambda x: F.regexp_replace(x["name"], "^android:", "")
    by_attribute = F.transform(F.filter("attributes", lambda x: local(x).isin(*CLASS_ATTRIBUTES)), lambda x: x["value"])
    by_tag = F.when(F.col("tag").rlike(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$"), F.array("tag"))
    named = elements.select("file", F.explode(F.concat(by_attribute, F.coalesce(by_tag, F.array().cast("array<string>")))).alias("value")).where(F.col("value").rlike(CLASS_NAME)).distinct()
    return named.join(package, "file", "left").join(known.select("file", "module", "source_set"), "file").select("file", "module", "source_set", F.coalesce("package", F.lit("")).alias("package"), "value")


def resource_references(known: DataFrame) -> DataFrame:
    """file, module, source_set, key (type/name) of what texts refer to."""
    pair = lambda p: F.transform(F.arrays_zip(F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("t"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("n")), lambda x: F.concat_ws("/", x["t"], x["n"]))
    keys = F.array_distinct(F.concat(*(pair(p) for p in sorted(RESOURCE_USE))))
    return known.select("file", "module", "source_set", F.explode(keys).alias("key"))


def resource_definitions(known: DataFrame, elements: DataFrame) -> DataFrame:
    """file, module, source_set, key of what files define: by their own name, as elements of a values file, and as new ids."""
    place = lambda k: F.regexp_extract("file", RESOURCE_PATH, k)
    kind = F.substring_index(place(3), "-", 1)
    by_name = known.where((kind != "") & (kind != "values")).select("file", "module", "source_set", F.concat_ws("/", kind, place(4)).alias("key"))
    ids = known.where("kind = 'xml'").select("file", "module", "source_set", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(INLINE_ID), F.lit(1)))).alias("n")).select("file", "module", "source_set", F.concat(F.lit("id/"), "n").alias("key"))
    kinds = F
    for tag, of in VALUE_TAGS.items():
        kinds = kinds.when(F.col("tag") == tag, of)
    own = elements.withColumn("kind", F.when(F.col("tag") == "item", attribute("type")).otherwise(kinds.otherwise(None))).withColumn("name", attribute("name"))
    values = known.where(kind == "values").select("file", "module", "source_set").join(own.where(F.col("kind").rlike(r"^[A-Za-z_]\w*$") & F.col("name").rlike(r"^[A-Za-z_]\w*$")), "file")
    return by_name.union(ids).union(values.select("file", "module", "source_set", F.concat_ws("/", "kind", "name"))).distinct()


def build_dependencies(known: DataFrame) -> DataFrame:
    """file, module of the projects that build scripts depend on."""
    scripts = known.where(F.element_at(F.split("file", "/"), -1).isin(*BUILD_FILES))
    return scripts.select("file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PROJECT_DEPENDENCY), F.lit(1)))).alias("p")).select("file", F.replace("p", F.lit(":"), F.lit("/")).alias("module"))


def project_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a project's files (file, bytes, text): edges of all six kinds, one row for each (source, target, kind)."""
    known = nodes(files)
    elements = shred(known.where("kind = 'xml'").select("file", "text"))
    scripts = known.where(F.element_at(F.split("file", "/"), -1).isin(*BUILD_FILES)).select("file", "module")
    parts = [
        N.import_edges(known), N.type_edges(known), N.component_edges(components(known, elements), known),
        N.resource_edges(resource_references(known), resource_definitions(known, elements)),
        N.build_edges(build_dependencies(known), scripts), N.overlay_edges(known.where("tail <> ''")),
    ]
    return known.drop("text"), N.graph(parts)
