"""Queries on coverage, integrity, relation graphs and batches, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.functions import scalar as S
from sievework.operators import aggregates as A
from sievework.operators import batching as B
from sievework.operators import elements as E
from sievework.operators import filters as P
from sievework.operators import graph as G
from sievework.operators import joins as J
from sievework.operators import sets as X
from sievework.operators import windows as W

from sievework.sources import readers as R

from .evidence import query, t

_EDGES = "SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS kind, 1 AS weight FROM lineitem"


def supply(spark, d):
    """Supplier to part edges of the line items, as raw evidence."""
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("kind"), F.lit(1).cast("long").alias("weight"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("evidence"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"))
    return rows


@query("SELECT l_orderkey, bool_and(ok) AND max(l_linenumber) = max(n) AS covered FROM (SELECT l_orderkey, l_linenumber, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS n, l_linenumber <= coalesce(max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS ok FROM lineitem) GROUP BY l_orderkey")
def interval_coverage(spark, d):
    from pyspark.sql import Window

    rows = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("s"), F.col("l_linenumber").alias("e"))
    rows = rows.withColumn("n", F.max("e").over(Window.partitionBy("l_orderkey")))
    return W.ranges_cover(rows, ["l_orderkey"], "s", "e", "n")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_turn FROM conversations")
def nearest_preceding(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", "role")
    return W.nearest_preceding(rows, ["conv_id"], ["turn"], F.col("role") == "user", F.col("turn"), "user_turn").drop("role")


@query("SELECT lang, source, doc_id, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(n_chars) OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS running FROM documents) WHERE running <= 40000")
def budget_prefix(spark, d):
    rows = t(spark, d, "documents").select("lang", "source", "doc_id", "n_chars")
    return W.budget_prefix(rows, ["lang", "source"], [F.desc("n_chars"), "doc_id"], "n_chars", 40000).select("lang", "source", "doc_id", "running")


@query("SELECT doc_id, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def receipt_full_outer(spark, d):
    return J.compare_sets(t(spark, d, "documents"), t(spark, d, "labels"), ["doc_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'repeated' END AS problem FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_custkey % 10 = 0)")
def id_partition_check(spark, d):
    o = t(spark, d, "orders")
    out = o.where("o_orderstatus in ('O', 'F')").select("o_orderkey").union(o.where("o_orderstatus = 'O' and o_custkey % 10 = 0").select("o_orderkey"))
    return J.partition_problems(o, out, "o_orderkey")


@query("SELECT doc_id, 'sha256' AS field FROM documents WHERE doc_id % 5 = 0 AND lang = 'de'")
def hash_binding(spark, d):
    rows = t(spark, d, "documents")
    live = rows.select("doc_id", F.sha2("text", 256).alias("sha256"))
    stored = rows.select("doc_id", F.when((F.col("doc_id") % 5 == 0) & (F.col("lang") == "de"), F.lit("stale")).otherwise(F.sha2("text", 256)).alias("sha256"))
    return J.compare_values(stored, live, ["doc_id"], ["sha256"])


@query("SELECT o_custkey, CASE WHEN max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 1 THEN 'incomplete' WHEN max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) = 1 THEN 'complete_with_skips' ELSE 'complete' END AS overall FROM orders GROUP BY o_custkey")
def status_lattice(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "partial").when(F.col("o_orderstatus") == "O", "skipped").otherwise("complete")
    return A.overall_status(t(spark, d, "orders").select("o_custkey", status.alias("status")), ["o_custkey"])


@query("SELECT user_id, sum(n)::BIGINT AS rules_run, sum(n)::BIGINT AS rules_triggered, sum(n)::BIGINT AS candidates, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (event_type <> 'purchase'), '') AS engines_used, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (event_type = 'purchase'), '') AS incomplete_engines FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def engine_rollup(spark, d):
    e = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    stats = e.select("user_id", F.col("event_type").alias("engine"), F.when(F.col("event_type") == "purchase", "failed").otherwise("complete").alias("status"), *(F.col("n").alias(c) for c in ("rules_run", "rules_triggered", "candidates")))
    return A.engine_rollup(stats, ["user_id"])


@query("SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS statuses, bool_and(role IN ('user', 'assistant')) AS negative, count(DISTINCT role) > 1 AS disagreement FROM conversations GROUP BY conv_id")
def case_disagreements(spark, d):
    c = t(spark, d, "conversations").select("conv_id", F.col("role").alias("status"))
    return A.case_status(c, c, ["conv_id"], ["user", "assistant"])


@query("SELECT source, target, kind, 1 AS weight, string_agg(evidence, ',' ORDER BY ordinal) FILTER (k <= 4) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY source, target, kind ORDER BY ordinal) AS k FROM (SELECT l_suppkey AS source, l_partkey AS target, l_returnflag AS kind, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS evidence, min(l_orderkey * 100 + l_linenumber) AS ordinal FROM lineitem GROUP BY ALL)) GROUP BY 1, 2, 3")
def edge_accumulate(spark, d):
    out = A.edges(supply(spark, d), "ordinal")
    return out.select("source", "target", "kind", F.col("weight").cast("int").alias("weight"), F.array_join("evidence", ",").alias("evidence"))


@query(f"SELECT node, neighbour, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT 's' || source AS node, 'p' || target AS neighbour, weight FROM ({_EDGES}) UNION ALL SELECT 'p' || target, 's' || source, weight FROM ({_EDGES})) GROUP BY 1, 2")
def adjacency_weights(spark, d):
    e = supply(spark, d).select(F.concat(F.lit("s"), F.col("source").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("target").cast("string")).alias("target"), "weight")
    return A.adjacency(e)


@query(f"SELECT kind, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT DISTINCT source, target, kind, weight FROM ({_EDGES})) GROUP BY kind")
def edge_kind_stats(spark, d):
    return A.kind_stats(supply(spark, d).select("source", "target", "kind", "weight").distinct())


@query("""WITH n AS (SELECT n_nationkey, n_regionkey AS r, n_nationkey = min(n_nationkey) OVER (PARTITION BY n_regionkey) AS main FROM nation),
c AS (SELECT c_custkey, c_nationkey, r FROM customer LEFT JOIN n ON c_nationkey = n_nationkey),
s AS (SELECT s_suppkey, s_nationkey, r, main FROM supplier LEFT JOIN n ON s_nationkey = n_nationkey),
p AS (SELECT c_custkey, s_suppkey, CASE WHEN c.r = s.r AND c_nationkey = s_nationkey THEN 0 WHEN c.r = s.r AND main THEN 1 WHEN c.r = s.r THEN 2 ELSE 3 END AS tier FROM c CROSS JOIN s)
SELECT c_custkey, s_suppkey FROM (SELECT *, min(tier) OVER (PARTITION BY c_custkey) AS low FROM p) WHERE tier = low""")
def variant_preference(spark, d):
    """A region stands for a module, a nation for a source set; a region's first nation is its main one."""
    from pyspark.sql import Window

    main = F.col("n_nationkey") == F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("source_set"), F.col("n_regionkey").alias("module"), main.alias("main"))
    c = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("source_set")).join(n.drop("main"), "source_set", "left")
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("source_set")).join(n, "source_set", "left")
    return J.variant_targets(c, s, ["c_custkey"]).select("c_custkey", "s_suppkey")


@query("SELECT l_orderkey, l_linenumber, t.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN (SELECT p_name, p_size, min(p_brand) AS p_brand FROM part GROUP BY p_name, p_size HAVING count(DISTINCT p_brand) = 1) t ON p.p_name = t.p_name AND p.p_size = t.p_size")
def unique_reference(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_size")
    refs = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey")).join(p, "p_partkey").select("l_orderkey", "l_linenumber", "p_name", "p_size")
    return J.unique_target(refs, t(spark, d, "part").select("p_name", "p_size", "p_brand").distinct(), ["p_name", "p_size"], ["l_orderkey", "l_linenumber"])


@query("SELECT lang, source, doc_id, anchor FROM (SELECT lang, source, doc_id, first_value(doc_id) OVER (PARTITION BY lang, source ORDER BY n_chars < 2000, doc_id) AS anchor FROM documents) WHERE doc_id <> anchor")
def overlay_pairs(spark, d):
    rows = t(spark, d, "documents").select("lang", "source", "doc_id", "n_chars")
    return J.overlay_anchor(rows, ["lang", "source"], "doc_id", F.col("n_chars") >= 2000)


@query(f"""WITH e AS (SELECT DISTINCT 's' || source AS a, 'p' || target AS b FROM ({_EDGES})), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
s AS (SELECT DISTINCT 's' || s_suppkey AS node FROM supplier WHERE s_suppkey % 25 = 0),
h1 AS (SELECT DISTINCT u.b AS node FROM s JOIN u ON s.node = u.a WHERE u.b NOT IN (SELECT node FROM s)),
h2 AS (SELECT DISTINCT u.b AS node FROM h1 JOIN u ON h1.node = u.a WHERE u.b NOT IN (SELECT node FROM s) AND u.b NOT IN (SELECT node FROM h1))
SELECT node, 0 AS hops FROM s UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def bfs_expand(spark, d):
    e = supply(spark, d).select(F.concat(F.lit("s"), F.col("source").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("target").cast("string")).alias("target"))
    seeds = t(spark, d, "supplier").where("s_suppkey % 25 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return G.expand(e, seeds, 2)


_TRADE = "SELECT s_nationkey AS s, c_nationkey AS t, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2"


@query(f"""WITH RECURSIVE e AS ({_TRADE}), o AS (SELECT s, sum(w) AS total FROM e GROUP BY s), m AS (SELECT a.n_nationkey AS s, b.n_nationkey AS t, CASE WHEN o.total IS NULL THEN 1.0 / 25 ELSE coalesce(e.w, 0)::DOUBLE / o.total END AS p FROM nation a CROSS JOIN nation b LEFT JOIN o ON o.s = a.n_nationkey LEFT JOIN e ON e.s = a.n_nationkey AND e.t = b.n_nationkey),
r AS (SELECT 0 AS k, list(1.0::DOUBLE / 25 ORDER BY n_nationkey) AS v FROM nation UNION ALL SELECT k + 1, (SELECT list(x ORDER BY t) FROM (SELECT t, 0.15::DOUBLE / 25 + 0.85 * sum(p * v[s + 1]) AS x FROM m GROUP BY t)) FROM r WHERE k < 30)
SELECT n_nationkey AS node, round(v[n_nationkey + 1], 9) AS rank FROM r, nation WHERE k = 30""")
def file_pagerank(spark, d):
    li, o = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), t(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("s_nationkey <> c_nationkey")
    e = e.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg(F.count("*").alias("weight"))
    out = G.pagerank(t(spark, d, "nation").select(F.col("n_nationkey").alias("node")), e)
    return out.select("node", F.round("rank", 9).alias("rank"))


_CALLS = "SELECT DISTINCT a.role AS caller, b.role AS callee FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role <> b.role"


@query(f"""WITH RECURSIVE c AS ({_CALLS}), r AS (SELECT ['user'] AS path, 0 AS depth UNION ALL SELECT list_append(path, caller), depth + 1 FROM r JOIN c ON c.callee = path[len(path)] WHERE depth < 6 AND NOT list_contains(path, caller))
SELECT array_to_string(path, '<') AS path, depth FROM r WHERE depth = 6 OR NOT EXISTS (SELECT 1 FROM c WHERE c.callee = path[len(path)] AND NOT list_contains(path, c.caller))""")
def trace_paths(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("callee"))
    calls = c.join(nxt, ["conv_id", "turn"]).where("role <> callee").select("callee", F.col("role").alias("caller"), F.lit("high").alias("confidence"))
    out = G.trace(spark, calls, spark.createDataFrame([("user",)], "symbol string"))
    return out.select(F.array_join("path", "<").alias("path"), "depth")


@query(f"""WITH e AS (SELECT DISTINCT source, target FROM ({_EDGES})), m AS (SELECT s_suppkey AS node, s_suppkey % 5 AS batch FROM supplier), p AS (SELECT p_partkey AS node, p_partkey % 5 AS batch FROM part),
x AS (SELECT batch, source, target FROM e JOIN m ON e.source = m.node UNION ALL SELECT batch, source, target FROM e JOIN p ON e.target = p.node)
SELECT batch, source, target, CASE WHEN count(*) = 2 THEN 'internal' ELSE 'boundary' END AS part FROM x GROUP BY 1, 2, 3""")
def batch_edge_split(spark, d):
    # one numbering of nodes: suppliers have even numbers, parts odd ones
    e = supply(spark, d).select((F.col("source") * 2).alias("source"), (F.col("target") * 2 + 1).alias("target"))
    node = lambda t_, k, odd: t_.select((F.col(k) % 5).alias("batch"), (F.col(k) * 2 + odd).alias("node"))
    members = node(t(spark, d, "supplier"), "s_suppkey", 0).union(node(t(spark, d, "part"), "p_partkey", 1))
    out = J.edge_split(e, members)
    return out.select("batch", F.shiftright("source", 1).alias("source"), F.shiftright("target", 1).alias("target"), "part")


@query("SELECT doc_id, lang || '/' || source AS affinity, min(doc_id) OVER (PARTITION BY lang, source) AS group_order FROM documents")
def affinity_groups(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "lang", "source")
    return B.affinity_groups(rows, F.concat_ws("/", "lang", "source"), "doc_id").select("doc_id", "affinity", "group_order")


@query("""WITH RECURSIVE u AS (SELECT lang, source, doc_id, greatest(64, (length(text) + 2) // 3) AS tok, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT lang, source, doc_id, k, 0::BIGINT AS batch, 1::BIGINT AS n, tok::BIGINT AS t FROM u WHERE k = 1 UNION ALL SELECT u.lang, u.source, u.doc_id, u.k, r.batch + CASE WHEN r.n + 1 > 20 OR r.t + u.tok > 30000 THEN 1 ELSE 0 END, CASE WHEN r.n + 1 > 20 OR r.t + u.tok > 30000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n + 1 > 20 OR r.t + u.tok > 30000 THEN u.tok ELSE r.t + u.tok END FROM r JOIN u ON u.lang = r.lang AND u.source = r.source AND u.k = r.k + 1)
SELECT lang, source, doc_id, batch FROM r""")
def next_fit_batches(spark, d):
    units = t(spark, d, "documents").select("lang", "source", "doc_id", F.lit(1).alias("n"), S.token_estimate("text").alias("tokens"))
    return B.next_fit(units, ["lang", "source"], ["doc_id"], "n", "tokens", 20, 30000).select("lang", "source", "doc_id", "batch")


@query()
def relation_clusters(spark, d):
    # a part's suppliers as a list: of each pair the lesser one moves, with the list of the greater ones
    held = supply(spark, d).groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("all"))
    after = held.select(F.posexplode("all").alias("k", "source"), "all").select("source", F.slice("all", F.col("k") + 2, F.size("all")).alias("after")).where("size(after) > 0")
    pairs = after.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source").select("source", F.explode("after").alias("target"))
    near = pairs.groupBy("source", "target").agg(F.count("*").alias("weight")).where("weight >= 2")
    items = t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 17).cast("int").alias("risk"), (F.lit(500) + F.col("s_suppkey") * 37 % 1500).cast("long").alias("tokens"))
    return G.cluster(items, near, 10, 12000)


_GATES = [("business", None), ("free", None), ("email", "email"), ("secrets", "assign"), ("assert", "bang"), ("tables", "pipe")]


@query("""WITH g AS (SELECT DISTINCT lang, source FROM documents), h AS (SELECT DISTINCT lang, source, 'email' AS p FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+[.][a-z]+') UNION SELECT DISTINCT lang, source, 'secrets' FROM documents WHERE regexp_matches(text, '(?i)(password|passwd|secret|token|api_?key)[ ]*[:=]') UNION SELECT DISTINCT lang, source, 'assert' FROM documents WHERE regexp_matches(text, '!!') UNION SELECT DISTINCT lang, source, 'tables' FROM documents WHERE regexp_matches(text, '[|][^\n]*[|]') UNION SELECT lang, source, 'business' FROM g UNION SELECT lang, source, 'free' FROM g)
SELECT lang || '/' || source AS batch, p AS perspective FROM h""")
def perspective_gating(spark, d):
    from .evidence import MARKERS

    tags = t(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("batch"), F.explode_outer(P.flags("text", {n: p for n, p in MARKERS.items() if n != "license"})).alias("tag")).distinct()  # no perspective asks for licenses
    return J.gated(tags, spark.createDataFrame(_GATES, "perspective string, tag string"))


@query("SELECT lang, count(*) AS total_input, count(CASE WHEN l.doc_id IS NOT NULL THEN 1 END) AS analysed, count(CASE WHEN l.doc_id IS NULL AND source = 'src0' THEN 1 END) AS generated, count(CASE WHEN l.doc_id IS NULL AND source <> 'src0' THEN 1 END) AS missing, count(CASE WHEN l.doc_id IS NULL AND source <> 'src0' THEN 1 END) = 0 AS coverage_ok FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY lang")
def coverage_accounting(spark, d):
    known = t(spark, d, "labels").select("doc_id").distinct().withColumn("k", F.lit(1))
    state = F.when(F.col("k").isNotNull(), "analysed").when(F.col("source") == "src0", "generated").otherwise("missing")
    return A.coverage(t(spark, d, "documents").select("doc_id", "lang", "source").join(known, "doc_id", "left").withColumn("state", state), ["lang"])


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN s = 0 THEN 'planned' ELSE 'rebuilt' END AS side FROM (SELECT o_orderkey, o_orderstatus, 0 AS s FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT o_orderkey, 'X', 1 FROM orders WHERE o_orderkey % 97 = 0)")
def plan_rebuild_diff(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return J.plan_difference(o, o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 97 == 0, "X").otherwise(F.col("o_orderstatus"))))


@query("""WITH p AS (SELECT p_partkey FROM part WHERE p_partkey % 400 = 0), s AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM p)), o AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM s))
SELECT DISTINCT o_orderkey AS file FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM o) OR o_custkey % 100 = 0""")
def impact_slice(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    changed = t(spark, d, "part").where("p_partkey % 400 = 0").select(F.col("p_partkey").alias("l_partkey"))
    near = li.join(changed, "l_partkey", "left_semi").select("l_suppkey").distinct()
    orders = t(spark, d, "orders")
    parts = [li.join(near, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("file")), orders.where("o_custkey % 100 = 0").select(F.col("o_orderkey").alias("file"))]
    return X.impact(orders.select(F.col("o_orderkey").alias("file")), parts)


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_differences(spark, d):
    return X.difference(t(spark, d, "documents"), t(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersection(spark, d):
    return X.intersection(t(spark, d, "documents"), t(spark, d, "labels"), ["doc_id"])


@query("SELECT lang, min(doc_id) AS doc_id, source FROM documents GROUP BY lang, source")
def ordered_distinct(spark, d):
    return X.ordered_distinct(t(spark, d, "documents"), ["lang", "source"], "doc_id")


@query("""WITH r AS (SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '!!|(idiot|moron|loser)')), l AS (SELECT DISTINCT doc_id, lang FROM labels JOIN documents USING (doc_id) WHERE toxic = 1),
c AS (SELECT coalesce(r.lang, l.lang) AS lang, count(CASE WHEN r.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 1 END) AS tp, count(CASE WHEN l.doc_id IS NULL THEN 1 END) AS fp, count(CASE WHEN r.doc_id IS NULL THEN 1 END) AS fn FROM r FULL JOIN l ON r.doc_id = l.doc_id GROUP BY 1),
p AS (SELECT lang, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END AS recall FROM c)
SELECT lang, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM p""")
def retrieval_score(spark, d):
    docs = t(spark, d, "documents")
    found = docs.where(F.col("text").rlike("!!|(idiot|moron|loser)")).select("doc_id", "lang")
    truth = t(spark, d, "labels").where("toxic = 1").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "lang")
    out = A.precision_recall(J.score_sets(found, truth, ["doc_id"], ["lang"]), ["lang"])
    return out.select("lang", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH k AS (SELECT c_nationkey, c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'high' WHEN c_acctbal > 5000 THEN 'nominal' ELSE 'ambiguous' END AS confidence, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 WHEN c_acctbal > 5000 THEN 1 ELSE 2 END AS r FROM customer),
p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY r, c_custkey) AS position, count(*) OVER (PARTITION BY c_nationkey) AS n FROM k)
SELECT c_nationkey, CASE WHEN position <= 25 THEN c_custkey END AS c_custkey, CASE WHEN position <= 25 THEN confidence END AS confidence, CAST(position AS INTEGER) AS position, CASE WHEN position > 25 THEN n - 25 ELSE 0 END AS truncated FROM p WHERE position <= 26""")
def caller_ladder(spark, d):
    c = t(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "BUILDING").alias("receiver_type"), F.lit("BUILDING").alias("owner"), F.lit("none").alias("enclosing_type"), F.when(F.col("c_acctbal") > 5000, 1).otherwise(2).alias("definitions"))
    ranked = J.caller_confidence(c).select("c_nationkey", "c_custkey", "confidence", "confidence_rank")
    return W.fan_out(ranked, ["c_nationkey"], ["confidence_rank", "c_custkey"]).drop("confidence_rank")


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%1%' AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def scope_semi_join(spark, d):
    parts = t(spark, d, "part").where(F.col("p_brand").contains("1")).withColumn("file", F.col("p_partkey"))
    return P.in_scope(parts, t(spark, d, "lineitem").select(F.col("l_partkey").alias("file"))).select("p_partkey", "p_brand")


@query("SELECT r_name AS name, CAST(level AS INTEGER) AS level FROM (SELECT 'EUROPE' AS r_name, 0 AS level) UNION ALL SELECT DISTINCT n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def caller_frontier(spark, d):
    calls = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("callee"), F.col("n_name").alias("caller"))
    return G.frontier(calls, spark.createDataFrame([("EUROPE",)], "name string"), 3)


_PLACE = "source || '/' || lang || '/' || d.doc_id"


@query(f"""WITH s AS (SELECT lang || '/' || d.doc_id AS path FROM documents d JOIN labels l ON d.doc_id = l.doc_id UNION SELECT {_PLACE} FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1),
r AS (SELECT DISTINCT d.doc_id, '/ci/build/' || {_PLACE} AS file FROM documents d)
SELECT doc_id, coalesce(arg_min(path, length(path)), file) AS path FROM r LEFT JOIN s ON ends_with(file, '/' || path) GROUP BY doc_id, file""")
def report_paths(spark, d):
    place = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    docs = t(spark, d, "documents").select("doc_id", "lang", place.alias("file"))
    known = docs.join(t(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    scope = known.select(F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("file")).union(known.where("quality = 1").select("file"))
    return J.report_paths(docs.select("doc_id", F.concat(F.lit("\\ci\\build/"), "file").alias("file")).distinct(), scope).select("doc_id", "path")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_PLACE} AS p FROM documents d) WHERE p LIKE 'en/1_' OR p LIKE '%/en/1_' OR p LIKE '%/de/%5' OR p LIKE '%/7%'")
def path_globs(spark, d):
    place = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return P.user_filter(t(spark, d, "documents").select("doc_id", place.alias("file")), [], globs=["en/1?", "*/de/*5", "7*"]).select("doc_id")


@query("SELECT event_type AS engine, count(DISTINCT user_id) AS rules_run, greatest(100, count(DISTINCT user_id)) AS rules_configured FROM events GROUP BY event_type")
def rule_kinds(spark, d):
    events = t(spark, d, "events")
    configured = events.select(F.col("event_type").alias("engine"), F.lit(100).alias("rules")).distinct()
    return A.rule_kinds(events.select(F.col("event_type").alias("engine"), F.col("user_id").cast("string").alias("check")), configured)


@query("""SELECT count(*) FILTER (lang = 'en' AND n_chars >= 50) AS direct_files, count(*) FILTER (n_chars > 1000 AND lang <> 'en') AS impact_added, count(*) FILTER (n_chars > 1000) AS scope_files,
count(*) FILTER (n_chars > 2000) AS hunt_files, count(*) FILTER (n_chars < 500) AS context_files, count(*) FILTER (n_chars < 50) AS deleted_files, count(*) FILTER (lang = 'en') AS direct_paths_total,
(SELECT count(*) FROM labels) AS missing_changed, count(*) FILTER (n_chars > 2000) > 0 AS should_hunt FROM documents""")
def scope_stats(spark, d):
    n = F.col("n_chars")
    files = t(spark, d, "documents").select(F.col("doc_id").alias("file"), (F.col("lang") == "en").alias("direct"), (n > 1000).alias("in_scope"), (n > 2000).alias("in_hunt"), (n < 500).alias("in_context"), (n < 50).alias("deleted"))
    return A.scope_stats(files, t(spark, d, "labels").select(F.col("doc_id").alias("file")))


@query("SELECT conv_id, turn, role AS file, CAST(turn AS INTEGER) AS line, 'from' AS message FROM conversations UNION ALL SELECT conv_id, turn, 'end', CAST(turn + 1 AS INTEGER), 'taint sink' FROM conversations")
def taint_trace(spark, d):
    form = '{"taint_sink": {"location": {"path": "end", "start": {"line": %d}}}, "taint_source": ["x", [{"path": "%s", "start": {"line": %d}, "content": {"value": " from "}}]]}'
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.format_string(form, F.col("turn") + 1, "role", "turn").alias("trace"))
    return rows.select("conv_id", "turn", F.explode(R.flat_trace("trace")).alias("hop")).select("conv_id", "turn", "hop.*")


_TAG_EVENTS = """SELECT page_id, k, m, regexp_extract(m, '^</?([A-Za-z_][\\w:.\\-]*)', 1) AS tag, CASE WHEN starts_with(m, '</') THEN -1 WHEN ends_with(m, '/>') OR regexp_extract(m, '^</?([A-Za-z_][\\w:.\\-]*)', 1) IN ('br', 'meta') THEN 0 ELSE 1 END AS step
FROM (SELECT page_id, unnest(l) AS m, unnest(range(len(l))) AS k FROM (SELECT page_id, regexp_extract_all(html, '""" + E.MARKUP.replace("'", "''") + """') AS l FROM pages)) WHERE substr(m, 2, 1) NOT IN ('!', '?')"""


@query(f"""WITH e AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM ({_TAG_EVENTS}) WHERE NOT (step = -1 AND tag IN ('br', 'meta')))
SELECT page_id, tag, 2 * k AS element, CASE WHEN step = 0 THEN 2 * k + 1 ELSE (SELECT 2 * min(c.k) FROM e c WHERE c.page_id = e.page_id AND c.k > e.k AND c.step = -1 AND c.depth < e.depth) END AS close,
CAST(depth + 1 - step AS BIGINT) AS level, (SELECT 2 * max(p.k) FROM e p WHERE p.page_id = e.page_id AND p.k < e.k AND p.step = 1 AND p.depth = e.depth - e.step) AS parent,
CAST(len(regexp_extract_all(m, '[A-Za-z_][\\w:.\\-]*\\s*=\\s*(?:"[^"]*"|''[^'']*'')')) AS INTEGER) AS n_attributes FROM e WHERE step >= 0""")
def page_elements(spark, d):
    rows = E.shred(t(spark, d, "pages").select(F.col("page_id").alias("file"), F.col("html").alias("text")), ["br", "meta"])
    return rows.select(F.col("file").alias("page_id"), "tag", "element", "close", "level", "parent", F.size("attributes").alias("n_attributes"))


# commas open and full stops close; a line that begins with a capital declares its first word
_MARKED = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(translate(text, ',.{}', '{}  '), chr(10)) AS l FROM documents)"
_DECLARES = r"^[^A-Za-z]*([A-Z][A-Za-z]+)"


@query(f"""WITH lines AS ({_MARKED}),
b AS (SELECT doc_id, line, line * 1048576 + k + 1 AS pos, m, sum(CASE m WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY line, k) AS depth FROM (SELECT doc_id, line, unnest(l) AS m, unnest(range(len(l))) AS k FROM (SELECT doc_id, line, regexp_extract_all(text, '[{{}}]') AS l FROM lines))),
o AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id, depth + CASE m WHEN '{{' THEN 0 ELSE 1 END ORDER BY pos) AS close, m FROM b),
n AS (SELECT doc_id, line, regexp_extract(text, '{_DECLARES}', 1) AS name FROM lines WHERE regexp_extract(text, '{_DECLARES}', 1) <> ''),
u AS (SELECT n.doc_id, n.line, n.name, min(o.pos) AS pos FROM n JOIN o ON o.doc_id = n.doc_id AND o.m = '{{' AND o.pos > n.line * 1048576 GROUP BY ALL),
t AS (SELECT u.doc_id, u.pos, o.close, arg_max(u.name, u.line) AS name FROM u JOIN o USING (doc_id, pos) GROUP BY ALL)
SELECT l.doc_id, l.line, coalesce((SELECT n.name FROM n WHERE n.doc_id = l.doc_id AND n.line = l.line), (SELECT arg_max(t.name, t.pos) FROM t WHERE t.doc_id = l.doc_id AND t.pos < l.line * 1048576 AND coalesce(t.close, 9223372036854775807) > l.line * 1048576)) AS type FROM lines l""")
def enclosing_type_lines(spark, d):
    docs = t(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("file"), F.posexplode(F.split(F.translate("text", ",.{}", "{}  "), "\n")).alias("line", "text"))
    rows = W.enclosing_type(docs.withColumn("line", (F.col("line") + 1).cast("long")), _DECLARES)
    return rows.select(F.col("file").alias("doc_id"), "line", "type")


@query("SELECT doc_id, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id) AS running FROM documents) WHERE running <= 200000")
def global_budget(spark, d):
    """One budget for all documents, the longest first: no task sees them all."""
    rows = t(spark, d, "documents").select("doc_id", "n_chars")
    return W.budget_prefix(rows, [], [F.desc("n_chars"), "doc_id"], "n_chars", 200000).select("doc_id", "running")


@query("""WITH r AS (SELECT l.doc_id, md5(CASE WHEN l.quality = 1 THEN coalesce(d.text, '') ELSE coalesce(d.text, '') || '!' END) AS h, md5(l.toxic || '') AS m, d.doc_id AS own, d.text AS text FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id)
SELECT doc_id AS batch, 'missing' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT doc_id, 'extra' FROM r WHERE own IS NULL UNION SELECT doc_id, 'duplicate' FROM r GROUP BY doc_id HAVING count(*) > 1 AND count(own) > 0
UNION SELECT doc_id, 'batch_sha256' FROM r WHERE own IS NOT NULL AND h <> md5(coalesce(text, '')) UNION SELECT doc_id, 'map_sha256' FROM r WHERE own IS NOT NULL AND m <> md5('0')""")
def batch_receipts(spark, d):
    """Receipts that labels leave for documents: whole for good ones, of another text for poor ones, of another map for toxic ones."""
    text = F.coalesce("text", F.lit(""))
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    batches = docs.select(F.col("doc_id").alias("batch"), F.md5(text).alias("batch_sha256"), F.md5(F.lit("0")).alias("map_sha256"))
    left = labels.join(docs.select("doc_id", "text"), "doc_id", "left")
    receipts = left.select(F.col("doc_id").alias("batch"), F.md5(F.when(F.col("quality") == 1, text).otherwise(F.concat(text, F.lit("!")))).alias("batch_sha256"), F.md5(F.col("toxic").cast("string")).alias("map_sha256"))
    return J.receipt_problems(batches, receipts, ["batch_sha256", "map_sha256"])


@query(f"SELECT *, row_number() OVER (ORDER BY weight DESC, source, target, kind) AS position FROM (SELECT source, target, kind, CAST(sum(weight) AS BIGINT) AS weight FROM ({_EDGES}) GROUP BY ALL)")
def edge_order(spark, d):
    e = supply(spark, d).groupBy("source", "target", "kind").agg(F.sum("weight").alias("weight"))
    return W.positions(e, A.edge_order())


@query("""WITH f AS (SELECT DISTINCT o_custkey, lower(substr(o_orderpriority, 3)) AS flavor FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT DISTINCT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'stagingDebug' WHEN 'O' THEN 'beta' ELSE 'Test' END AS kind FROM orders),
y AS (SELECT o_custkey, kind FROM b WHERE kind = 'beta' UNION ALL SELECT o_custkey, 'release' FROM b GROUP BY o_custkey HAVING NOT bool_or(kind = 'beta')),
k AS (SELECT o_custkey, 0 AS a, flavor, upper(left(flavor, 1)) || substr(flavor, 2) || upper(left(kind, 1)) || substr(kind, 2) AS task FROM f JOIN y USING (o_custkey)
UNION ALL SELECT o_custkey, 1, '', upper(left(kind, 1)) || substr(kind, 2) FROM y UNION ALL SELECT DISTINCT o_custkey, 2, '', '' FROM orders)
SELECT o_custkey, string_agg('lint' || task, ',' ORDER BY a, flavor) AS tasks FROM k GROUP BY o_custkey""")
def lint_tasks(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "stagingDebug").when(F.col("o_orderstatus") == "O", "beta").otherwise("Test")
    flavor = F.when(F.col("o_orderstatus") != "P", F.lower(F.expr("substring(o_orderpriority, 3)")))
    facts = t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(flavor)).alias("flavors"), F.array_sort(F.collect_set(kind)).alias("types"))
    return facts.select("o_custkey", F.array_join(P.lint_tasks("flavors", "types"), ",").alias("tasks"))


_COUNTED = {"assign": r"(?i)(password|passwd|secret|token|api_?key)[ ]*[:=]", "bang": "!!", "license": "(?i)licen[sc]e"}


@query(f"""SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS breaks,
{", ".join(f"CAST(sum(len(regexp_extract_all(text, '{p}'))) AS BIGINT) AS {n}" for n, p in _COUNTED.items())} FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def split_markers(spark, d):
    """The texts written as files, which are then read in windows of 64 KiB."""
    import uuid

    from sievework.sources.splits import text_windows

    path = f"{G.shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    t(spark, d, "documents").where("text is not null").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    rows = text_windows(spark, path, window=1 << 16)
    lang = F.regexp_extract("file", "/lang=([^/]*)/", 1)
    counts = W.match_counts(rows.withColumn("lang", F.nullif(lang, F.lit("__HIVE_DEFAULT_PARTITION__"))), _COUNTED, ["lang"])
    return counts.select("lang", "chars", "breaks", *(F.coalesce(F.col("matches").getItem(n), F.lit(0)).cast("long").alias(n) for n in _COUNTED))
