"""Navigation over an index of definitions and references: backends, one facade for both, calls that leave a batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph as G
from . import joins as J
from . import relations as N
from . import windows as W

# Names of the backends, the first one best.
BACKENDS = ("treesitter", "source")


def backend(wanted: str | None, available: set[str]) -> tuple[str, bool]:
    """(backend, degraded): the wanted one, else the best; without it the line patterns, which are always there and mark the index as degraded."""
    pick = (wanted or "").strip().lower()
    if pick != "source" and BACKENDS[0] in available:
        return BACKENDS[0], False
    return BACKENDS[1], True


@dataclass
class Navigation:
    """What an index answers. defs: name, kind, file, line, signature; refs: name, file, line, receiver, snippet, enclosing_type,
    enclosing_symbol; types: file, variable, type (as of relations.index and relations.receiver_types, or of a parser's captures)."""

    defs: DataFrame
    refs: DataFrame
    types: DataFrame
    fan_out: int = 25

    def definition(self, name: str, owner: str | None = None) -> DataFrame:
        return J.definitions(self.defs, name, owner)

    def callers(self, symbol: str) -> DataFrame:
        return N.callers(self.refs, symbol, self.types)

    def callees(self, name: str) -> DataFrame:
        return J.callees(self.defs, name)

    def type_hierarchy(self, name: str) -> DataFrame:
        return J.type_hierarchy(self.defs, self.refs, name)

    def frontier(self, names: DataFrame, depth: int) -> DataFrame:
        """name: methods that reach one of the names by at most `depth` calls."""
        return G.frontier(self.refs.select(F.col("name").alias("callee"), F.col("enclosing_symbol").alias("caller")), names, depth)

    def ranked_callers(self, symbol: str) -> DataFrame:
        """The best callers, at most `fan_out`, and a row that says how many more there are."""
        return W.fan_out(self.callers(symbol), ["name"], ["confidence_rank", "file", "line"], self.fan_out)


def measure(backends: dict[str, Callable[[str], DataFrame]], truth: DataFrame, symbols: list[str]) -> DataFrame:
    """backend, symbol, tp, fp, fn of each backend's (file, line) callers of a bounded list of symbols. truth: symbol, file, line."""
    from .sets import union_all

    keys = ["backend", "symbol", "file", "line"]
    spark = truth.sparkSession
    got = union_all([ask(s).select(F.lit(b).alias("backend"), F.lit(s).alias("symbol"), "file", "line") for b, ask in backends.items() for s in symbols])
    names = spark.createDataFrame([(b,) for b in backends], "backend string")
    want = names.join(F.broadcast(truth.where(F.col("symbol").isin(*symbols)).select("symbol", "file", "line").distinct()), how="cross")  # a few backends
    both = got.distinct().withColumn("_g", F.lit(1)).join(want.select(*keys).withColumn("_w", F.lit(1)), keys, "full")
    n = lambda c: F.count(F.when(c, 1))
    g, w = F.col("_g").isNotNull(), F.col("_w").isNotNull()
    return both.groupBy("backend", "symbol").agg(n(g & w).alias("tp"), n(g & ~w).alias("fp"), n(~g & w).alias("fn"))


def outgoing_calls(refs: DataFrame, methods: DataFrame, batch: DataFrame) -> DataFrame:
    """file, enclosing_symbol, fqn, line, target_file, target_line: calls out of a batch's files (batch: file, risk) that have exactly
    one target outside; of a (file, enclosing_symbol, fqn) the first by line and name.

    refs: file, line, name, receiver, receiver_type, snippet, enclosing_type, enclosing_symbol; methods: name, owner, fqn, file, line.
    The owner is a receiver that is a type's name, else the receiver's inferred type, else the one owner that the snippet
    names; without any the call must stand without a receiver, or with this or super, in the owner itself. Each of them is an
    equality, so a method name that thousands of files declare never meets all calls of that name.
    """
    own = refs.dropDuplicates().join(batch.select("file").distinct(), "file", "left_semi").withColumn("_r", F.struct(*refs.columns))
    tail = F.coalesce(F.substring_index("receiver", ".", -1), F.lit(""))
    hint = F.when(tail.rlike(r"^\p{Lu}"), tail).otherwise(F.nullif(F.col("receiver_type"), F.lit("")))
    own = own.withColumns({"_hint": hint, "_plain": tail.isin("", "this", "super")})
    words = F.array_distinct(F.regexp_extract_all(F.coalesce("snippet", F.lit("")), F.lit(r"(\w+)"), F.lit(1)))
    at = F.struct(F.lit(1).alias("way"), F.col("_hint").alias("owner"))
    named = F.transform(words, lambda x: F.struct(F.lit(2).alias("way"), x.alias("owner")))
    inside = F.when(F.col("_plain"), F.array(F.struct(F.lit(3).alias("way"), F.coalesce("enclosing_type", F.lit("")).alias("owner"))))
    none = F.array().cast("array<struct<way:int,owner:string>>")
    asked = own.select("_r", "name", F.explode(F.when(F.col("_hint").isNotNull(), F.array(at)).otherwise(F.concat(named, F.coalesce(inside, none)))).alias("a")).select("_r", "name", "a.*")
    outside = methods.join(batch.select("file").distinct(), "file", "left_anti")
    target = outside.select("name", F.coalesce("owner", F.lit("")).alias("owner"), F.struct("fqn", F.col("file").alias("target_file"), F.col("line").alias("target_line")).alias("t"))
    found = asked.join(target, ["name", "owner"]).groupBy("_r", "way").agg(F.count("*").alias("n"), F.min("t").alias("t"))
    # a single target of the first way that has one; a hint has no other way
    one = found.where("n = 1").groupBy("_r").agg(F.min_by("t", "way").alias("t")).select("_r.*", "t.*")
    w = F.min_by(F.struct("line", "target_file", "target_line"), F.struct("line", "name")).alias("f")
    return one.groupBy("file", "enclosing_symbol", "fqn").agg(w).select("file", "enclosing_symbol", "fqn", "f.*")
