"""Analysis reports as a data source: one partition a report, filters by engine and file pushed in, and a status for each report.

`spark.read.format("analysis_reports").load(folder)` gives engine, file, report (its text), status and error. A report that cannot be read
as what its name says is a row with the status failed and no text, so one broken file loses nothing of the others.
"""

from __future__ import annotations

import fnmatch
import json
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

NAME = "analysis_reports"
SCHEMA = "engine string, file string, report string, status string, error string"
# Names of the engines' reports.
REPORTS = {"semgrep": "semgrep*.json", "detekt": "detekt*.xml", "pmd": "pmd*.json", "lint": "lint-results*.xml"}


class Report(InputPartition):
    def __init__(self, engine: str, path: str):
        self.engine, self.path = engine, path


def engine_of(name: str) -> str | None:
    return next((e for e, p in REPORTS.items() if fnmatch.fnmatch(name, p)), None)


class ReportReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, {}

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in ("engine", "file"):
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        found = store.get_file_info(fs.FileSelector(top, recursive=True))
        out = [Report(e, i.path) for i in sorted(found, key=lambda i: i.path) if i.is_file and (e := engine_of(i.base_name))]
        return [r for r in out if r.engine in self.wanted.get("engine", {r.engine}) and r.path.rsplit("/", 1)[-1] in self.wanted.get("file", {r.path.rsplit("/", 1)[-1]})]

    def read(self, partition):
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        name = partition.path.rsplit("/", 1)[-1]
        try:
            with store.open_input_stream(partition.path) as f:
                text = f.read().decode()
            if name.endswith(".json"):
                if not isinstance(json.loads(text), dict):
                    raise ValueError("not an object")
            else:
                ET.fromstring(text)
            yield partition.engine, name, text, "complete", None
        except (OSError, ValueError, ET.ParseError) as e:  # the report's fault: it is told in the row
            yield partition.engine, name, None, "failed", str(e)[:300]


class AnalysisReports(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ReportReader(self.options["path"])


def reports(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(AnalysisReports)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).load(path)


def engine_status(rows: DataFrame) -> DataFrame:
    """engine, reports, failed, status of report rows: complete, partial where some failed, failed where all did."""
    k, n = F.count_if(F.col("status") == "failed"), F.count("*")
    return rows.groupBy("engine").agg(n.alias("reports"), k.alias("failed"), F.when(k == 0, "complete").when(k < n, "partial").otherwise("failed").alias("status"))


class Captures:
    """Captures of tag patterns in a text: kind, name, line; the handler of a table function."""

    KINDS = (("definition.type", r"\b(?:class|interface|object|record|enum(?!\s+class\b))\s+([A-Za-z_]\w*)"), ("definition.method", r"\bfun\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)\s*\("), ("reference.call", r"(?<!\bfun )\b([A-Za-z_]\w*)\s*\("), ("reference.new", r"\bnew\s+([A-Z]\w*)"))

    def eval(self, text: str):
        import re

        for line, own in enumerate((text or "").split("\n"), 1):
            for kind, pattern in self.KINDS:
                for m in re.finditer(pattern, own, re.ASCII):
                    yield kind, m[1], line


def register_extract(spark: SparkSession, name: str = "extract_tags") -> None:
    """Makes the captures callable from SQL: SELECT ... FROM files, LATERAL extract_tags(text)."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(Captures, returnType="kind string, name string, line int"))
