"""Operators whose plan must hold at scale: prefix sums by ranges, joins by tiers, ranks that are cut early, a fold without a list."""

import random

from pyspark.sql import functions as F

from sievework.operators import batching as B
from sievework.operators import joins as J
from sievework.operators import windows as W


def test_running_total(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice([0, 1, 5, 40, None]), rng.randrange(4)) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, cost int, g int").repartition(7)
    got = {r["k"]: r["running"] for r in W.running_total(df, [F.desc("g"), "k"], "cost").collect()}
    total, want = 0, {}
    for k, cost, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        total += cost or 0
        want[k] = total
    assert got == want
    assert {r["k"] for r in W.budget_prefix(df, [], [F.desc("g"), "k"], "cost", 300).collect()} == {k for k, v in want.items() if v <= 300}
    assert W.running_total(df.limit(0), ["k"], "cost").count() == 0


def test_first_tier(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, None, "y"), (4, "c", "z")], "id int, m string, r string")
    right = spark.createDataFrame([(10, "a", "x"), (11, "d", "x"), (12, "e", "y")], "t int, m string, r string")
    assert sorted(map(tuple, J.first_tier(left, right, [["m"], ["r"]]).select("id", "t").collect())) == [(1, 10), (2, 10), (2, 11), (3, 12)]


def test_variant_targets_takes_every_step(spark):
    """Same module and source set, else the module's main, else the module, else all; sources of one key (null too) take its best step."""
    sources = [(1, "a", "x"), (2, "a", "q"), (3, "b", "q"), (4, "z", "x"), (5, None, None), (6, "a", "x"), (6, "a", "q"), (6, "z", "x"), (7, "b", "y"), (7, "b", "y"), (None, "b", "x"), (None, "c", "x")]
    targets = [(10, "a", "x", False), (11, "a", "x", False), (12, "a", "m", True), (13, "b", "x", False), (14, "b", "y", False), (15, None, None, None), (16, "c", "m", True)]

    def tier(s, t):
        return (0 if s[2] == t[2] else 1 if t[3] else 2) if s[1] is not None and s[1] == t[1] else 3

    low = {s[0]: min(tier(r, t) for r in sources if r[0] == s[0] for t in targets) for s in sources}
    want = sorted((s[0] or 0, t[0]) for s in sources for t in targets if tier(s, t) == low[s[0]])
    left = spark.createDataFrame(sources, "id int, module string, source_set string")
    right = spark.createDataFrame(targets, "t int, module string, source_set string, main boolean")
    got = lambda: sorted((r["id"] or 0, r["t"]) for r in J.variant_targets(left, right, ["id"]).collect())
    assert got() == want
    assert [t for i, t in want if i == 2] == [12] and [t for i, t in want if i == 3] == [13, 14] and [t for i, t in want if i in (4, 5)] == [*range(10, 17)] * 2
    assert [t for i, t in want if i == 6] == [10, 11] and [t for i, t in want if i == 0] == [13]
    one = [J.LISTED, setattr(J, "LISTED", 1)][0]
    try:
        assert got() == want
    finally:
        J.LISTED = one
    assert J.variant_targets(left, right.limit(0), ["id"]).count() == 0


def test_variant_preference_equals_its_sql_where_nations_lack_suppliers(spark, tmp_path):
    import duckdb

    from sievework.plans import registry

    tables = {
        "nation": ([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, None), (None, 1)], "n_nationkey int, n_regionkey int"),
        "customer": ([*((k, k % 8) for k in range(40)), (100, None), (101, 77), (3, 0), (None, 4), (None, 5)], "c_custkey long, c_nationkey int"),
        "supplier": ([(1, 0), (2, 0), (3, 1), (4, 4), (5, 4), (6, None), (7, 77), (8, 6)], "s_suppkey long, s_nationkey int"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    order = lambda rows: sorted((a is None, a or 0, b) for a, b in rows)
    got = order(map(tuple, registry.QUERIES["variant_preference"](spark, str(tmp_path)).collect()))
    assert got == order(con.execute(registry.ORACLES["variant_preference"]).fetchall())
    assert {k for _, k, _ in got} >= {*range(40), 100, 101}


def test_fan_out_ranks_before_it_counts(spark):
    df = spark.createDataFrame([(g, k) for g in "ab" for k in range(7 if g == "a" else 2)], "g string, k int")
    out = W.fan_out(df, ["g"], ["k"], 3)
    assert sorted((r["g"], r["k"], r["position"], r["truncated"]) for r in out.where("k is not null").collect()) == [("a", k, k + 1, 0) for k in range(3)] + [("b", k, k + 1, 0) for k in range(2)]
    assert [(r["g"], r["truncated"]) for r in out.where("k is null").collect()] == [("a", 4)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_next_fit_is_a_fold(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", "y", None]), k, rng.randrange(1, 4), rng.randrange(1, 50)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, n int, t int").repartition(5)
    for keys in (["g"], []):
        got = {r["k"]: r["batch"] for r in B.next_fit(df, keys, ["k"], "n", "t", 6, 90).collect()}
        state, want = {}, {}
        for g, k, n, t in rows:
            b, a, c = state.get(g if keys else 0, (0, 0, 0))
            if a and (a + n > 6 or c + t > 90):
                b, a, c = b + 1, 0, 0
            state[g if keys else 0] = (b, a + n, c + t)
            want[k] = b
        assert got == want


def test_publish_is_all_or_nothing(spark, tmp_path):
    import json

    from sievework.sources import sinks as K

    base = f"file://{tmp_path}/out"
    good, worse = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(3, "x"), (-1, "y")], "k int, v string")
    first = K.publish(spark, {"findings": (good, F.col("k") < 0), "review": (good.limit(0), F.lit(False))}, base, "run")
    assert first["status"] == "published" and first["tables"]["findings"]["rows"] == 2 and first["tables"]["review"]["fingerprint"] == "0" * 16
    again = K.publish(spark, {"findings": (good.orderBy(F.desc("k")), F.col("k") < 0), "review": (worse, F.col("k") < 0)}, base, "run")
    assert again["status"] == "refused" and again["tables"]["review"]["problems"] == 1 and again["tables"]["findings"]["fingerprint"] == first["tables"]["findings"]["fingerprint"]
    assert spark.read.parquet(f"{base}/run/review").count() == 0 and json.loads(spark.read.text(f"{base}/run/receipt").first()[0]) == first
    assert K.publish(spark, {"findings": (worse.where("k > 0"), F.col("k") < 0)}, base, "run")["status"] == "published"
    assert [r["k"] for r in spark.read.parquet(f"{base}/run/findings").collect()] == [3] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["run"]


def test_receipts_of_batches(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "batch string, batch_sha256 string, map_sha256 string")
    got = J.receipt_problems(make(("a", "1", "m"), ("b", "2", "m"), ("c", "3", "m"), ("d", "4", "m")), make(("a", "1", "m"), ("b", "9", None), ("d", "4", "m"), ("d", "4", "m"), ("e", "5", "m")), ["batch_sha256", "map_sha256"])
    assert sorted(map(tuple, got.collect())) == [("b", "batch_sha256"), ("b", "map_sha256"), ("c", "missing"), ("d", "duplicate"), ("e", "extra")]
