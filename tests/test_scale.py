"""Operators whose memory must not grow with a group, a batch or a task, against plain Python."""

import random

from pyspark.sql import functions as F

from sievework.operators import graph as G
from sievework.operators import joins as J
from sievework.operators import windows as W
from sievework.sources import splits


def greedy(items, edges, size, tokens):
    """node -> (batch, position) by the definition: all items, all relations, one loop. items: node, risk, tokens."""
    cost, order = {n: t for n, _, t in items}, [n for n, *_ in sorted(items, key=lambda x: (-x[1], x[0]))]
    near = {n: {} for n in cost}
    for a, b, w in edges:
        if a in cost and b in cost:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    left, out, batch = list(order), {}, 0
    while left:
        own = [left.pop(0)]
        while left and len(own) < size:
            used = sum(cost[n] for n in own)
            pull = {n: w for n in left if (w := sum(near[o].get(n, 0) for o in own))}
            fits = [n for n in left if used + cost[n] <= tokens and (not pull or n in pull)]
            if not fits:
                break
            own.append(min(fits, key=lambda n: (-pull.get(n, 0), order.index(n))))
            left.remove(own[-1])
        out |= {n: (batch, k) for k, n in enumerate(own)}
        batch += 1
    return out


def test_clusters_equal_the_definition(spark):
    rng = random.Random(3)
    items = {g: [(f"n{k}", rng.randrange(5), rng.randrange(1, 60)) for k in range(90)] for g in "ab"}
    edges = [(f"n{rng.randrange(100)}", f"n{rng.randrange(100)}", rng.randrange(1, 4)) for _ in range(160)]
    e = spark.createDataFrame([x for x in edges if x[0] != x[1]], "source string, target string, weight long")
    i = spark.createDataFrame([(g, *x) for g, own in items.items() for x in own], "g string, node string, risk int, tokens long")
    for g, size, tokens in (("a", 6, 100), ("b", 1, 10), ("a", 200, 10_000)):
        got = {r["node"]: (r["batch"], r["position"]) for r in G.cluster(i.where(F.col("g") == g), e, size, tokens).collect()}
        assert got == greedy(items[g], [x for x in edges if x[0] != x[1]], size, tokens)
    both = sorted((r["node"], r["batch"], r["position"]) for r in G.cluster(i, e, 6, 100, ["g"]).collect())
    assert both == sorted((n, *p) for own in items.values() for n, p in greedy(own, [x for x in edges if x[0] != x[1]], 6, 100).items())


def test_cluster_task_holds_no_relations(spark):
    """The task of a group is given numbers of its items; the relations are read from files, one list at a time."""
    items = spark.range(300).select(F.col("id").alias("node"), F.lit(1).alias("risk"), F.lit(1).alias("tokens"))
    e = spark.range(300).select(F.col("id").alias("source")).join(spark.range(300).select(F.col("id").alias("target")), F.col("source") < F.col("target")).withColumn("weight", F.lit(1))
    out = G.cluster(items, e, 10, 100)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "collect_list" not in plan and "array" not in plan.lower()
    assert out.select(F.max("batch")).first()[0] == 29


def test_windows_leave_a_task_in_small_batches(tmp_path):
    """Many windows, of which no more than about BATCH bytes are held at once; nothing is lost."""
    text = "é漢 key\n" * 2_000_000
    (tmp_path / "a.kt").write_text(text)
    for k in range(30):
        (tmp_path / f"e{k}.kt").write_text("x" * k)
    reader = splits.WindowReader(str(tmp_path), 1 << 16, 1 << 14, 128 << 20)
    parts = reader.partitions()
    batches = list(reader.read(parts[0]))
    assert len(parts) == 1 and max(b.nbytes for b in batches) < splits.BATCH + (1 << 18)
    rows = [r for b in batches for r in b.to_pylist()]
    own = {}
    for r in rows:
        own[r["file"]] = own.get(r["file"], "") + r["text"][r["lead"] : r["lead"] + r["chars"]]
    assert len(own) == 31 and own[str(tmp_path / "a.kt")] == text


def test_edge_split(spark):
    """Repeated edges and members, a node in two batches or none, a batch without a name, a loop; edges are dealt once and not gathered again."""
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 5), (6, 6), (7, 1), (None, 1), (8, 9)], "source long, target long")
    members = spark.createDataFrame([(1, 1), (2, 1), (1, 2), (1, 2), (2, 3), (None, 4), (3, 6)], "batch int, node long")
    got = J.edge_split(edges, members)
    want = [(1, 1, 2, "internal"), (2, 1, 2, "boundary"), (1, 1, 3, "boundary"), (2, 1, 3, "internal"), (None, 4, 5, "boundary"), (3, 6, 6, "internal"), *((b, s, 1, "boundary") for s in (7, None) for b in (1, 2))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_enclosing_type_moves_no_text(spark, tmp_path):
    """Where only the types are asked for, no text of a line is dealt or sorted."""
    lines = [("f", 1, "class A {"), ("f", 2, "x" * 50), ("f", 3, "class B { y }"), ("f", 4, "}"), ("f", 5, "z"), ("g", 1, None), ("g", 2, "class C")]
    spark.createDataFrame(lines, "file string, line long, text string").write.parquet(str(tmp_path / "l"))
    rows = W.enclosing_type(spark.read.parquet(str(tmp_path / "l")), r"class\s+(\w+)")
    assert rows.columns == ["file", "line", "text", "type"]
    assert sorted(map(tuple, rows.select("file", "line", "type").collect())) == [("f", 1, "A"), ("f", 2, "A"), ("f", 3, "B"), ("f", 4, "A"), ("f", 5, None), ("g", 1, None), ("g", 2, "C")]
    plan = rows.select("file", "line", "type")._jdf.queryExecution().optimizedPlan().toString()
    tops = [x for x in plan.splitlines() if "Window" in x or "RepartitionByExpression" in x]
    assert tops and all("text" not in x for x in tops) and "named_struct(line" not in plan


def test_first_tier_deals_the_left_rows(spark):
    """One key holds all rows: the product is made by many tasks; null keys go on to the next tier and are lost in the last."""
    left = spark.range(200).select("id", F.lit(1).alias("m"), F.lit(1).alias("r")).union(spark.createDataFrame([(900, None, 1), (901, 5, None), (902, 5, 2)], "id long, m int, r int")).coalesce(1)
    right = spark.createDataFrame([(10, 1, 1), (11, 1, 1), (12, 7, 2), (13, None, 1)], "t long, m int, r int")
    got = J.first_tier(left, right, [["m"], ["r"]]).select("id", "t", F.spark_partition_id().alias("p")).collect()
    want = [(i, t) for i in range(200) for t in (10, 11)] + [(900, t) for t in (10, 11, 13)] + [(902, 12)]
    assert sorted((r["id"], r["t"]) for r in got) == want
    assert len({r["p"] for r in got if r["id"] < 200}) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = [J.LISTED, setattr(J, "LISTED", 1)][0]
    try:
        again = J.first_tier(left, right, [["m"], ["r"]]).select("id", "t").collect()
    finally:
        J.LISTED = one
    assert sorted(map(tuple, again)) == want


def test_first_tier_is_written_short(spark, tmp_path):
    """The product of a key is written as repeats of short runs: a part of a byte a row, where each list at full length takes two; a key of few rows and long lists is dealt over the tasks."""
    left = spark.range(400).select("id", F.lit(1).alias("m")).union(spark.range(1000, 6000).select("id", F.lit(2).alias("m")))
    right = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("t"), F.lit(1).alias("m")).union(spark.createDataFrame([(90_000, 2)], "t long, m int"))
    J.first_tier(left, right, [["m"]]).select("id", "t").write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 400 * 20_000 + 5000
    assert got.where("id < 400").groupBy("id").agg(F.count_distinct("t").alias("n")).where("n = 20000").count() == 400
    assert sum(f.stat().st_size for f in files) < got.count()
    most = got.where("id < 400").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most < 400 * 20_000 * 0.5
