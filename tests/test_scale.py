"""Skew-safe plan shapes against brute force, and assertions on physical plans."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ticketlens.operators import neardup, pareto, preference, vectors
from ticketlens.plans.scale import exact_quantiles, seeded_rank
from ticketlens.streaming import monitors as st


def test_seeded_rank_is_a_permutation_per_group(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise(
        F.when(F.col("id") % 7 == 0, None).otherwise("b")).alias("g"))
    ranks = {}
    for r in seeded_rank(df, 1, "id", ["g"]).collect():
        ranks.setdefault(r["g"], []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())
    assert len(ranks) == 3


@pytest.mark.parametrize("kind", ["normal", "heavy", "equal", "single"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(5)
    values = {"normal": rng.normal(size=700), "heavy": np.exp(rng.normal(size=700) * 6),
              "equal": np.full(50, 3.0), "single": np.array([4.5])}[kind]
    df = spark.createDataFrame([(float(v), i % 2 if kind == "normal" else 0)
                                for i, v in enumerate(values)], "v double, g int")
    probs = [0.0, 0.25, 0.5, 0.95, 1.0]
    for r in exact_quantiles(df, "v", probs, ["g"]).collect():
        part = [v for i, v in enumerate(values) if (i % 2 if kind == "normal" else 0) == r["g"]]
        assert r["q"] == pytest.approx(list(np.percentile(part, [100 * p for p in probs])))
    whole = exact_quantiles(df, "v", probs).first()["q"]
    assert whole == pytest.approx(list(np.percentile(values, [100 * p for p in probs])))


def _grams(t):
    t = t.lower()
    return {t[i:i + 3] for i in range(len(t) - 2)}


def _greedy(rows, threshold):
    kept, out = [], []
    for key, text in rows:
        g = _grams(text)
        if g and any(h and len(g & h) / len(g | h) >= threshold for h in kept):
            continue
        kept.append(g)
        out.append(key)
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
@pytest.mark.parametrize("dense", [0, 50])
def test_near_duplicates_brute_force(spark, threshold, dense):
    rng = np.random.default_rng(3)
    words = ["router", "refund", "invoice", "parcel", "late", "broken", "please", "help"]
    rows = []
    for i in range(70):
        base = "The support case about a " + " ".join(rng.choice(words, 6))
        rows.append((i, base + f" number {i % 9}"))
    rows += [(100 + i, "Exactly the same hot text for everyone") for i in range(30)]
    rows += [(200, "ab"), (201, "ab")]
    df = spark.createDataFrame(rows, "ticket_id bigint, text string")
    gone = {r[0] for r in neardup.near_duplicate_drops(df, threshold, dense_factor=dense)
            .collect()}
    assert [k for k, _ in rows if k not in gone] == _greedy(rows, threshold)


def test_neighbour_blocks_equal_broadcast(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], str(i % 3), i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>, label string, fold int")
    run = lambda **o: sorted((r["query_id"], r["train_id"]) for r in vectors.top_neighbours(
        df, df, 4, fold="fold", **o).collect())
    assert run() == run(matrix_values=8 * 25)
    assert run(metric="euclidean") == run(metric="euclidean", matrix_values=8 * 25)


def test_skyline_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = [tuple(float(x) for x in p) for p in rng.integers(0, 25, size=(300, 3))]
    df = spark.createDataFrame(pts, "accuracy double, latency_ms double, cost_per_ticket double")
    want = {p for p in pts if not any(
        q[0] >= p[0] and q[1] <= p[1] and q[2] <= p[2] and q != p for q in pts)}
    for block in (3, 50_000):
        assert {tuple(r) for r in pareto.frontier_points(df, block).collect()} == want


def test_hot_ticket_pairs_are_complete(spark):
    replies = ["I will refund the charge to your account. Thank you for waiting. We will help.",
               "No.", "Please contact us", "I understand, processing the refund invoice payment."]
    rows = [(1, i, replies[i % 4], "billing") for i in range(60)]
    df = spark.createDataFrame(rows, "ticket_id bigint, pos int, response string, domain string")
    pairs = lambda hot: sorted((r["chosen_pos"], r["rejected_pos"]) for r in
                               preference.preference_pairs(df, hot=hot).collect())
    assert pairs(7) == pairs(1000) and len(pairs(7)) > 0


def test_bradley_terry_fixed_point(spark):
    games = [("a", "b", 7), ("b", "a", 3), ("b", "c", 6), ("c", "b", 4), ("a", "c", 8),
             ("c", "a", 2)]
    df = spark.createDataFrame(games, "winner string, loser string, n bigint")
    p = {r["item"]: r["strength"] for r in preference.bradley_terry(df, 40, 1e-5).collect()}
    assert p["a"] > p["b"] > p["c"] and sum(p.values()) == pytest.approx(1)
    for i in p:
        wins = sum(n for w, _, n in games if w == i)
        expected = sum(n * p[i] / (p[w] + p[l]) for w, l, n in games if i in (w, l))
        assert wins == pytest.approx(expected, rel=1e-2)


def test_rolling_probe_over_batches(spark, tmp_path):
    for b in range(3):
        rows = [(b * 10 + i, f"2024-01-01 0{b}:{i:02d}:00", "billing") for i in range(10)]
        spark.createDataFrame(rows, "trace_id bigint, t string, domain string").select(
            "trace_id", F.to_timestamp("t").alias("ts"), "domain").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("trace_id bigint, ts timestamp, domain string").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    st.rolling_probe_stream(stream, out, 7).awaitTermination()
    got = sorted(r["trace_id"] for r in st.latest_version(spark, out).collect())
    assert got == list(range(23, 30))


def test_alert_stream_keeps_state_over_batches(spark, tmp_path):
    for b in range(3):
        rows = [(f"2024-01-01 00:0{b}:{s:02d}", 0.5) for s in (0, 30)]
        spark.createDataFrame(rows, "t string, auto_resolution_rate double").select(
            F.to_timestamp("t").alias("ts"), "auto_resolution_rate").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, auto_resolution_rate double").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    st.dispatch_alerts(st.alert_stream(stream), str(tmp_path / "out"),
                       lambda df, i: seen.append((i, df.count()))).awaitTermination()
    fires = spark.read.json(str(tmp_path / "out" / "data")).groupBy("rule_name").count()
    got = {r["rule_name"]: r["count"] for r in fires.collect()}
    assert got == {"auto_resolution_warn": 1, "auto_resolution_critical": 3}
    assert sum(n for _, n in seen) == 4


@pytest.mark.parametrize("name", [
    "p8_format_prompts", "t9_response_score", "t13_scrub_pii", "t15_t16_unsupported_claims",
    "t19_run_filters", "r7_route", "q2_iqr_fence", "e7_domain_evaluation", "x1_stratified_split",
    "w1_trace_counters", "r18_repeated_contact", "f1_preference_pairs", "o6_rank_checkpoints",
])
def test_plans_stay_in_the_jvm_without_products(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan, bad


def test_skyline_of_points_that_do_not_dominate_each_other(spark):
    from ticketlens.operators import sweep

    # x + y + z is constant, so all stay; a copy shifted down by one is dominated as a whole
    n = 50_000
    flat = spark.range(n).select((F.col("id") % 250).cast("double").alias("a"), F.floor(F.col("id") / 250).cast("double").alias("b"))
    rows = flat.select(F.col("a").alias("accuracy"), F.col("b").alias("latency_ms"),
                       (F.col("a") - F.col("b")).alias("cost_per_ticket"))
    worse = rows.select((F.col("accuracy") - 1).alias("accuracy"), "latency_ms", "cost_per_ticket")
    kept = pareto.frontier_points(rows.union(worse), 4_000)
    assert kept.count() == n and kept.join(rows, rows.columns, "left_anti").count() == 0
    assert sweep.ranged(rows.toDF("x", "y", "z").withColumn("kind", F.lit(0)), 4_000).select("r").distinct().count() > 5


def test_hypervolume_of_many_points_equals_its_closed_form(spark):
    from ticketlens.operators import sweep

    # boxes below the plane x + y + z = k + 3 on a grid of side 1: every cell below it is covered
    k = 630
    grid = spark.range(k).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1) - F.col("i"))))
    points = grid.select((F.col("i") + 1.0).alias("x"), (F.col("j") + 1.0).alias("y"), (k - F.col("i") - F.col("j")).cast("double").alias("z"))
    assert points.count() == k * (k + 1) // 2 > 198_000
    cells = k * (k + 1) * (k + 2) // 6
    assert sweep.volume(points).first()[0] == pytest.approx(cells, rel=1e-12)
    assert sweep.volume(points, 7_000).first()[0] == pytest.approx(cells, rel=1e-12)


def test_hypervolume_ranges_and_reference_equal_sampling_free_count(spark):
    from ticketlens.operators import sweep

    rng = np.random.default_rng(4)
    pts = rng.integers(0, 9, size=(200, 3))
    covered = np.zeros((9, 9, 9), bool)
    for x, y, z in pts:
        covered[:x, :y, :z] = True
    df = spark.createDataFrame([tuple(float(v) for v in p) for p in pts], "x double, y double, z double").distinct()
    for size in (1, 7, 10_000):
        assert sweep.volume(df, size).first()[0] == covered.sum()
    assert sweep.volume(df.limit(0)).first()[0] == 0.0
    speeds = df.where("y > 0 and z > 0").select(F.col("x").alias("accuracy"), (1 / F.col("y")).alias("latency_ms"),
                                                (1 / F.col("z")).alias("cost_per_ticket"))
    assert pareto.hypervolume(speeds, (2.0, 1.0, 3.0)).first()[0] == pytest.approx(covered[2:, 1:, 3:].sum())
    assert pareto.hypervolume(speeds, (2.0, 1.0, 3.0), 5).first()[0] == pytest.approx(covered[2:, 1:, 3:].sum())
    assert pareto.hypervolume(speeds, (9.0, 0.0, 0.0)).first()[0] == 0.0
