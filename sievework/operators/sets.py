"""Set operations over rows and file lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(parts: list[DataFrame]) -> DataFrame:
    """A bag union by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ordered_distinct(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """keys and the ordinal at which they first came."""
    return rows.groupBy(*keys).agg(F.min(ordinal).alias(ordinal))


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi")


def impact(all_files: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """The union of the parts of an impact slice (direct, module, relation, callee, caller, ...) that still exist."""
    found = reduce(lambda a, b: a.union(b), [p.select("file") for p in parts]).distinct()
    return found.join(all_files.select("file"), "file", "left_semi")
