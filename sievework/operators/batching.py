"""Batches: affinity groups, next-fit packing, enrichment and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.scalar import candidate_id


def affinity_groups(rows: DataFrame, key: Column, ordinal: str) -> DataFrame:
    """Adds `affinity` and `group_order`, the group's least ordinal."""
    out = rows.withColumn("affinity", key)
    first = out.groupBy("affinity").agg(F.min(ordinal).alias("group_order"))
    return out.join(first, "affinity")


def chunks(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds `chunk`: each group's rows in pieces of at most `size`."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("chunk", F.floor(n / size).cast("long"))


def next_fit(units: DataFrame, keys: list[str], order: list[str], count: str, tokens: str, most: int, budget: int) -> DataFrame:
    """Adds `batch`: units in order, a new batch when a count or token limit would be passed; a unit beyond the limits stands alone.

    The choice depends on all units before it, so a group (keys) passes through one task, a row at a time: the state is a
    batch's number, count and tokens, and no list is held. Only keys, order and numbers go along.
    """
    own = [c for c in units.select(*keys, *order).columns]
    light = units.select(*own, F.col(count).cast("long").alias("_n"), F.col(tokens).cast("long").alias("_t"))
    dealt = (light.repartition(*keys) if keys else light.coalesce(1)).sortWithinPartitions(*keys, *order)

    def run(parts):
        import pyarrow as pa

        now, batch, n, t = None, 0, 0, 0
        for part in parts:
            key, out = list(zip(*(part.column(k).to_pylist() for k in keys))) or [()] * part.num_rows, []
            for k, a, b in zip(key, part.column("_n").to_pylist(), part.column("_t").to_pylist()):
                if k != now:
                    now, batch, n, t = k, 0, 0, 0
                if n > 0 and (n + a > most or t + b > budget):
                    batch, n, t = batch + 1, 0, 0
                n, t = n + a, t + b
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(out, pa.int64())], [*own, "batch"])

    schema = T.StructType([*(f for f in light.schema.fields if f.name in own), T.StructField("batch", T.LongType())])
    placed = dealt.mapInArrow(run, schema)
    same = [F.col(f"u.{c}").eqNullSafe(F.col(f"p.{c}")) for c in own]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return units.alias("u").join(placed.alias("p"), on).select("u.*", "p.batch")


def enrich(rows: DataFrame, source: str, index: str, canonical: str, kinds: dict[str, str], default: str) -> DataFrame:
    """Adds candidate_id and source_kind, which the source's name tells (patterns, the first that matches)."""
    kind = F
    for pattern, name in kinds.items():
        kind = kind.when(F.col(source).rlike(pattern), name)
    return rows.withColumn("candidate_id", candidate_id(source, index, canonical)).withColumn("source_kind", kind.otherwise(default) if kinds else F.lit(default))


def fallback_review(candidates: DataFrame, done: DataFrame, keys: list[str], reason: str) -> DataFrame:
    """Candidates of batches without a result, as review rows with their ids kept."""
    return candidates.join(done.select(*keys).distinct(), keys, "left_anti").withColumns({"status": F.lit("needs_review"), "review_reason": F.lit(reason)})


def batch_totals(rows: DataFrame, batch: str, tags: str, tokens: str) -> DataFrame:
    return rows.groupBy(batch).agg(F.count("*").alias("file_count"), F.sum(tokens).alias("estimated_tokens"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(tags)))).alias("tech_present"))
