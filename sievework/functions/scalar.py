"""Scalar expressions: identities, ranks, paths, symbols. All are columns that stay in generated code, but for canonical JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
SEVERITIES = {"critical": 0, "major": 1, "minor": 2, "info": 3}
UNKNOWN_SEVERITY = 99
TIME_ZONE = "+08:00"
FENCES = {".kt": "kotlin", ".kts": "kotlin", ".java": "java", ".xml": "xml", ".gradle": "groovy", ".aidl": "java"}

_BLANKS = " \\t\\n\\r\\f\\u000B"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without blanks of any kind at both ends (SQL's trim takes spaces only)."""
    return F.regexp_replace(col(x), r"^\s+|\s+$", "")


def finding_id(file, line, category, rule_id) -> Column:
    """SHA-1 of file:line:category:rule; nulls count as empty text."""
    return F.sha1(F.concat_ws(":", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in (file, line, category, rule_id))))


def root_cause_id(primary_file, symbol, failure_mode) -> Column:
    """SHA-1 of the normalised triple, joined by NUL: slashes and case of the path, blanks of the symbol, kebab case of the mode."""
    blanks = lambda x, by: F.regexp_replace(strip(x), r"\s+", by)
    path = F.lower(F.replace(strip(primary_file), F.lit("\\"), F.lit("/")))
    return F.sha1(F.concat_ws("\0", path, F.lower(blanks(symbol, " ")), blanks(F.replace(F.lower(strip(failure_mode)), F.lit("_"), F.lit("-")), "-")))


def has_root_cause(primary_file, symbol, failure_mode) -> Column:
    return F.coalesce((strip(primary_file) != "") & (strip(symbol) != "") & (strip(failure_mode) != ""), F.lit(False))


def identity(file, line, category, rule_id, primary_file, symbol, failure_mode) -> Column:
    """struct(key, id, semantic): the root cause if its triple is whole, else the exact place."""
    whole = has_root_cause(primary_file, symbol, failure_mode)
    root, exact = root_cause_id(primary_file, symbol, failure_mode), finding_id(file, line, category, rule_id)
    return F.struct(F.when(whole, F.concat(F.lit("root:"), root)).otherwise(F.concat(F.lit("exact:"), exact)).alias("key"), F.when(whole, root).otherwise(exact).alias("id"), whole.alias("semantic"))


def severity_rank(severity) -> Column:
    out = F
    for name, rank in SEVERITIES.items():
        out = out.when(col(severity) == name, rank)
    return out.otherwise(UNKNOWN_SEVERITY)


# Owners that stand for any class.
ANY_OWNER = ("", "any", "unknown", "*")


def severity_name(rank) -> Column:
    out = F
    for name, k in SEVERITIES.items():
        out = out.when(col(rank) == k, name)
    return out.otherwise("unknown")


def iso_time(timestamp) -> Column:
    """ISO-8601 with seconds in the fixed zone, of a timestamp in UTC."""
    return F.concat(F.date_format(F.from_utc_timestamp(col(timestamp), TIME_ZONE), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(TIME_ZONE))


def iso_date(text) -> Column:
    return F.substring_index(col(text), "T", 1)


def short_commit(commit, length: int = 8) -> Column:
    return F.coalesce(F.left(col(commit), F.lit(length)), F.lit(""))


def method_hint(symbol) -> Column:
    """The method's name in pkg.Class#method(args); null without a #, as nothing tells a method from a type there."""
    tail = F.regexp_extract(col(symbol), r"^[^#]*#([^(]*)", 1)
    return F.nullif(F.btrim(strip(tail), F.lit("`")), F.lit(""))


def class_hint(symbol) -> Column:
    """The simple class name before #, or an empty text: without a #, or where the owner is any."""
    owner = type_hint(symbol)
    return F.when(~col(symbol).contains("#") | F.lower(owner).isin(*ANY_OWNER), "").otherwise(owner)


def type_hint(symbol) -> Column:
    return F.btrim(strip(F.substring_index(F.substring_index(col(symbol), "#", 1), ".", -1)), F.lit("`"))


def receiver(line, method) -> Column:
    """What stands before .method( in a call's line, or an empty text."""
    return F.call_function("regexp_extract", col(line), F.concat(F.lit(r"([A-Za-z_]\w*)\s*(?:\?|!!)?\s*\.\s*\Q"), col(method), F.lit(r"\E\s*\(")), F.lit(1))


def component_class(value, package) -> Column:
    """.Foo and Foo within a package; a name with dots as it is."""
    v, p = strip(value), F.coalesce(col(package), F.lit(""))
    return F.when(v.startswith("."), F.concat(p, v)).when(v.contains(".") | (p == ""), v).otherwise(F.concat_ws(".", p, v))


def names(text, pattern: str, stop: list[str] = []) -> Column:
    """Distinct matches of a pattern's first group, sorted, without stop words."""
    found = F.regexp_extract_all(col(text), F.lit(pattern), F.lit(1))
    return F.array_sort(F.array_distinct(F.array_except(found, F.array(*map(F.lit, stop)).cast("array<string>"))))


def fence(file) -> Column:
    """The code fence's language by extension, or an empty text."""
    out = F
    for suffix, name in FENCES.items():
        out = out.when(F.lower(col(file)).endswith(suffix), name)
    return out.otherwise("")


def percent(x) -> Column:
    """One decimal and a percent sign; a dash for null."""
    return F.when(col(x).isNull(), "—").otherwise(F.format_string("%.1f%%", col(x) * 100))


def string_list(items) -> Column:
    """Trimmed, non-empty strings; an empty list for null."""
    return F.coalesce(F.filter(F.transform(col(items), strip), lambda x: x != ""), F.array().cast("array<string>"))


def relative(path, root: str) -> Column:
    return F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), "^" + re.escape(root.rstrip("/")) + "/", "")


def normal_path(path) -> Column:
    """Slashes, no empty and . parts, .. resolved; null for absolute paths and those that leave the root."""
    p = F.replace(strip(path), F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(parts, F.struct(empty.alias("p"), F.lit(True).alias("ok")), lambda a, x: F.when(x != "..", F.struct(F.array_append(a.p, x).alias("p"), a.ok.alias("ok"))).otherwise(F.struct(F.slice(a.p, 1, F.greatest(F.size(a.p) - 1, F.lit(0))).alias("p"), (a.ok & (F.size(a.p) > 0)).alias("ok"))))
    return F.when(walked.ok & ~p.startswith("/") & ~p.rlike("^[A-Za-z]:") & (F.size(walked.p) > 0), F.array_join(walked.p, "/"))


def glob_regex(glob: str) -> str:
    """A path pattern as a regular expression. It matches a whole path, where * crosses slashes, or, if it is no absolute
    one, the last parts of a path, where * stays within a part."""

    def regex(part: str, any_: str) -> str:
        out, i = "", 0
        while i < len(part):
            c = part[i]
            if c in "*?":
                out += any_ + "*" * (c == "*")
            elif c == "[" and (j := part.find("]", i + 3 if part[i + 1 : i + 2] == "!" else i + 2)) > 0:
                inner = part[i + 1 : j].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out += f"(?={any_})[" + ("^" + inner[1:] if inner[0] == "!" else "\\" * (inner[0] == "^") + inner) + "]"
                i = j
            else:
                out += re.escape(c)
            i += 1
        return out

    parts = [x for x in glob.split("/") if x not in ("", ".")]
    whole = regex(glob, ".")
    if glob.startswith("/") or not parts:
        return rf"(?s)^{whole}\z"
    return rf"(?s)^{whole}\z|(?:^|/){'/'.join(regex(x, '[^/]') for x in parts)}\z"


def braces(glob: str) -> list[str]:
    """One level of {a,b} spelled out."""
    m = re.search(r"\{([^{}]*)\}", glob)
    return [g for x in m[1].split(",") for g in braces(glob[: m.start()] + x + glob[m.end() :])] if m else [glob]


def line_count(text) -> Column:
    """Line feeds, and one more if the text does not end with one."""
    t = F.coalesce(col(text), F.lit(""))
    return (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + F.when((t != "") & ~t.endswith("\n"), 1).otherwise(0)).cast("long")


def token_estimate(text, per_token: int = 3, least: int = 64) -> Column:
    """max(least, ceil(characters / per_token))."""
    n = F.length(F.coalesce(col(text), F.lit("")))
    return F.greatest(F.lit(least), F.floor((n + per_token - 1) / per_token)).cast("long")


def candidate_tokens(record_json, least: int = 64) -> Column:
    return F.greatest(F.lit(least), F.floor(F.length(col(record_json)) / 3)).cast("long")


def candidate_id(source, index, canonical) -> Column:
    """24 hex digits of SHA-256 over source:index:record."""
    return F.left(F.sha2(F.concat_ws(":", col(source), col(index).cast("string"), col(canonical)), 256), F.lit(24))


def digest(path, content) -> Column:
    return F.struct(col(path).alias("path"), F.sha2(col(content), 256).alias("sha256"))


def canonical_json(struct_fields: list[str]) -> Column:
    """JSON of columns with sorted keys; nulls are left out."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(struct_fields))))


def canonical_text(record_json, fields: list[str] | None = None) -> Column:
    """JSON with keys sorted at every level, ", " and ": " between parts, nulls kept and other alphabets as they are.

    With `fields` an object of those alone, null where absent or where the text holds no object. Else null for what is no JSON.
    """

    def one(text):
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            value = None
            if fields is None:
                return None
        if fields is not None:
            own = value if isinstance(value, dict) else {}
            value = {k: own.get(k) for k in fields}
        return json.dumps(value, sort_keys=True, ensure_ascii=False)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(col(record_json))


def canonical_hash(record_json, fields: list[str] | None = None) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical_text(record_json, fields), 256)


def rule_id_count(text) -> Column:
    """Rules of a YAML text, told by the lines that begin with `- id:`."""
    return F.size(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"(?m)^- id:"), F.lit(0))).cast("long")


def strict_equal(left_json, right_json) -> Column:
    """JSON texts equal in value and type: true is not 1."""
    kind = lambda x: F.schema_of_variant(F.parse_json(col(x)))
    return (kind(left_json) == kind(right_json)) & (F.to_json(F.parse_json(col(left_json))) == F.to_json(F.parse_json(col(right_json))))


def bounded(text, cap: int, mark: str = "…") -> Column:
    """At most cap characters and a mark where something was cut."""
    return F.when(F.length(col(text)) > cap, F.concat(F.left(col(text), F.lit(cap)), F.lit(mark))).otherwise(col(text))
