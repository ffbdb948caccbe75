"""Operators on rows of their own: results that stay the same however large a group is."""

import datetime
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ticketlens.catalog import routing
from ticketlens.functions import text as tx
from ticketlens.operators import classify, drift, linear, neardup, vectors
from ticketlens.streaming import monitors, stateful, windows


def test_drift_by_step_and_of_checks_are_two_functions(spark):
    pairs = spark.createDataFrame(
        [("a", 0, 0.95), ("a", 0, 0.97), ("a", 1, 0.7), ("b", 0, 1.0)], "domain string, step int, sim double")
    steps = {(r["domain"], r["step"]): r for r in drift.drift_history(pairs).collect()}
    assert steps["a", 1]["level"] == "severe" and steps["a", 1]["is_latest"] and not steps["a", 0]["is_latest"]
    trend = {r["domain"]: r for r in drift.drift_trend(drift.drift_history(pairs)).collect()}
    assert round(trend["a"]["slope"], 6) == 0.26 and trend["b"]["slope"] is None
    checks = spark.range(5).select(F.timestamp_seconds("id").alias("window_start"))
    assert [r[0].second for r in drift.check_history(checks, 2).collect()] == [3, 4]


def test_neighbours_tie_to_the_smaller_key_in_every_block(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(40, 3))
    rows = [(i, [float(x) for x in points[i % 40]], str(i % 3), i % 4) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>, label string, fold int")
    gap = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    want = {(i, j) for i in range(160) for j in sorted(
        (j for j in range(160) if j % 4 != i % 4), key=lambda j: (gap[i % 40, j % 40], j))[:5]}
    for values in (3 * 23, 8_000_000):
        found = vectors.top_neighbours(df, df, 5, metric="euclidean", fold="fold", matrix_values=values)
        assert {(r["query_id"], r["train_id"]) for r in found.collect()} == want


def test_a_small_file_is_compared_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TASK_PAIRS", 1000)
    df = spark.range(100, numPartitions=1).select(
        F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), F.lit("a").alias("label"))
    found = vectors.top_neighbours(df, df, 2, metric="euclidean")
    assert found.rdd.getNumPartitions() == 10 and found.count() == 200
    assert {(r["query_id"], r["train_id"]) for r in found.where("query_id = 50").collect()} == {(50, 50), (50, 49)}


def test_near_duplicates_meet_whatever_their_size(spark):
    """Pairs at and just below the threshold, of sizes at the edges of the spans, against brute force."""
    rng = np.random.default_rng(8)
    grams = lambda t: {t.lower()[i:i + 3] for i in range(len(t) - 2)}
    texts = []
    for size in [3, 4, 18, 19, 20, 21, 22, 23, 40, 41, 60, 150, 400]:
        base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé\U0001f600"), size))
        texts += [base, base + "A", base + "xyz", "q" + base[1:], base[: size // 2] + "#" + base[size // 2:],
                  base + "".join(rng.choice(list("0123456789"), max(1, size // 19))), base.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "ticket_id bigint, text string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(grams(t)), i)
    want = {(a, i, 1.0) for i, t in enumerate(texts) if (a := first[frozenset(grams(t))]) != i}
    for x, a in first.items():
        for y, b in first.items():
            if a < b and len(x & y) / len(x | y) >= 0.95 - 1e-9:
                want.add((a, b, round(len(x & y) / len(x | y), 9)))
    found = neardup.near_duplicate_pairs(df)
    assert sorted((r[0], r[1], round(r[2], 9)) for r in found.collect()) == sorted(want) and len(want) > 30


def test_near_duplicate_candidates_are_few_among_texts_of_common_words(spark):
    """Texts of the same words share every frequent trigram; few of them become candidates."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("aeiourstln"), 6)) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, 150))) for i in range(200)]
    rows += [(200 + i, t + " end") for i, t in rows[:20]]
    sets = neardup.distinct_sets(neardup.trigram_sets(spark.createDataFrame(rows, "ticket_id bigint, text string")), "ticket_id")
    postings = neardup._postings(sets, 0.95)
    found = {tuple(r) for r in neardup._candidates(postings, postings, 0.95).collect()}
    assert found == {(i, 200 + i) for i in range(20)}


def test_near_duplicates_move_few_texts_and_once_per_cell(spark, monkeypatch):
    rng = np.random.default_rng(10)
    words = ["".join(rng.choice(list("aeiourstln"), 6)) for _ in range(400)]
    base = " ".join(rng.choice(words, 200))
    texts = [f"{base} {rng.choice(words)}" for _ in range(40)] + [" ".join(rng.choice(words, 150)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "ticket_id bigint, text string").repartition(3)
    plan = lambda d: neardup.trigram_sets(d)._jdf.queryExecution().executedPlan().toString()
    files = spark.range(100, numPartitions=8).select(F.col("id").alias("ticket_id"), F.lit("some text").alias("text"))
    assert "Exchange" not in plan(files) and "Exchange" in plan(files.coalesce(2))
    kept, stored = {}, neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda d, label: kept.setdefault(label, stored(d, label)))
    rows, sets, postings = neardup._tables(df, 0.95, "ticket_id", "text")
    assert "low" in rows.columns and not {"low", "own", "below"} & {*sets.columns, *postings.columns}
    sent, find = [], neardup._texts
    monkeypatch.setattr(neardup, "_texts", lambda *a: sent.append(find(*a)) or sent[-1])
    found = neardup._verify(neardup._candidates(postings, postings, 0.95), rows, sets, 0.95)
    sets_of = [{t[i:i + 3] for i in range(len(t) - 2)} for t in texts]
    first = [i for i, x in enumerate(sets_of) if x not in sets_of[:i]]
    want = {(a, b): round(len(sets_of[a] & sets_of[b]) / len(sets_of[a] | sets_of[b]), 9) for a in first for b in first if a < b}
    want = {k: v for k, v in want.items() if v >= 0.95 - 1e-9}
    assert {(r[0], r[1]): round(r[2], 9) for r in found.collect()} == want and len(want) > 200
    assert sent[0].count() <= 40
    cells = kept["cells"]
    members = cells.select("cell", "rep_a").union(cells.select("cell", "rep_b")).distinct().count()
    assert members <= 80 < cells.count()


def test_tfidf_merges_rows_of_one_key_and_moves_no_terms(spark):
    rows = [(1, "red apple"), (1, "apple pie"), (2, "pie"), (3, None), (3, "x"), (None, "Été pie")]
    out = classify.tfidf(spark.createDataFrame(rows, "ticket_id bigint, text string"), "ticket_id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    found = {(r["ticket_id"], r["term"]): r["weight"] for r in out.collect()}
    idf = lambda df: np.log(7 / (1 + df)) + 1
    raw = {"red": idf(1), "apple": (1 + np.log(2)) * idf(1), "pie": idf(3), "red apple": idf(1), "apple pie": idf(1)}
    size = np.sqrt(sum(w * w for w in raw.values()))
    assert {t: round(w, 9) for (k, t), w in found.items() if k == 1} == {t: round(w / size, 9) for t, w in raw.items()}
    assert {t for k, t in found if k is None} == {"ete", "pie", "ete pie"} and not [k for k, _ in found if k == 3]


def test_tfidf_counts_few_terms_by_name_and_the_right_ones(spark, monkeypatch):
    rng = np.random.default_rng(12)
    draw = lambda n: " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 3000))
    texts = [draw(int(rng.integers(0, 120))) for _ in range(300)] + ["", "x", "ÉTÉ w1 w2", draw(4000)]
    rows = [(i % 290, t) for i, t in enumerate(texts)] + [(None, "w1 w2 w3"), (5, None)]
    df = spark.createDataFrame(rows, "ticket_id bigint, text string").repartition(3)
    docs = {}
    for k, t in rows:
        t = [w for w in (t or "").lower().replace("é", "e").split() if len(w) > 1]
        docs.setdefault(k, Counter()).update(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
    total = sum(docs.values(), Counter())
    best = sorted(total, key=lambda t: (-total[t], t))[:100]
    idf = {t: np.log((1 + len(rows)) / (1 + sum(t in d for d in docs.values()))) + 1 for t in best}
    want = {}
    for k, d in docs.items():
        raw = {t: (1 + np.log(d[t])) * idf[t] for t in best if t in d}
        size = np.sqrt(sum(w * w for w in raw.values()))
        want |= {(k, t): round(w / size, 9) for t, w in raw.items()}
    shuffled, add = [], classify._frequent
    monkeypatch.setattr(classify, "_frequent", lambda *a: shuffled.append(add(*a)) or shuffled[-1])
    for piece in (300, 8 << 20):
        monkeypatch.setattr(classify, "PIECE", piece)
        found = {(r["ticket_id"], r["term"]): round(r["weight"], 9) for r in classify.tfidf(df, "ticket_id", max_features=100).collect()}
        assert found == want
        assert 100 <= shuffled[-1].count() < len(total) / 10


def test_contact_stream_keeps_few_states_for_many_customers(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, f"c{i % 200}" if i % 7 else None, begin + datetime.timedelta(hours=(i * 37) % 60, microseconds=i % 2)) for i in range(600)]
    rows += [(1000, "edge", begin), (1001, "edge", begin + datetime.timedelta(hours=48)),
             (1002, "edge", begin + datetime.timedelta(hours=96, microseconds=1))]
    df = spark.createDataFrame(rows, "trace_id bigint, customer_id string, ts timestamp")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    running = monitors.append_files(monitors.repeated_contact_stream(stream), f"{tmp_path}/out")
    running.awaitTermination()
    assert max(s["numRowsTotal"] for p in running.recentProgress for s in p["stateOperators"]) <= 64 * 4
    span = datetime.timedelta(hours=48)
    want = {(i, sum(d == c and t - span <= u <= t for _, d, u in rows)) for i, c, t in rows}
    found = spark.read.parquet(f"{tmp_path}/out/data").collect()
    assert {(r["trace_id"], r["n_contacts"]) for r in found} == want and len(found) == len(rows)
    assert all(r["repeated_contact"] == (r["n_contacts"] >= 3) for r in found)


def test_similarity_of_texts_moves_no_trigrams(spark):
    grams = lambda t: {t.lower()[i:i + 3] for i in range(len(t) - 2)}
    texts = ["Abcabc", "abcABC", "xyz", "ab", "", "xy\U0001f600z", "XY\U0001f600", "zz abc abcabc", None]
    pairs = [(x, y) for x in texts for y in texts]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    found = df.select("i", F.spark_partition_id(), tx.jaccard(F.col("a"), F.col("b")).alias("sim"))
    assert "extract" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        x, y = pairs[r["i"]]
        if x is None or y is None:
            known = y if x is None else x
            want = None if known is None or len(known) > 2 else 0.0
        else:
            x, y = grams(x), grams(y)
            want = len(x & y) / len(x | y) if x and y else 0.0
        assert r["sim"] == want


def test_contacts_in_state_keep_few_timers_for_many_customers(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    hour = lambda h: begin + datetime.timedelta(hours=h)
    parts = [[(1000 * p + i, f"c{i % 300}" if i % 7 else None, hour(60 * p + (i * 37) % 60)) for i in range(900)] for p in range(3)]
    parts[1] += [(5000, "edge", hour(60))]
    parts[2] += [(5001, "edge", hour(108) + datetime.timedelta(hours=13)), (5002, "edge", hour(108 + 13))]
    schema, most = "trace_id bigint, customer_id string, ts timestamp", 0
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        running = stateful.start_append(stateful.trailing_contacts_stream(stream), f"{tmp_path}/out")
        running.awaitTermination()
        most = max([most, *(s["numRowsTotal"] for p in running.recentProgress for s in p["stateOperators"])])
    # spells of twelve hours in reach and their timers (two rows each), not contacts or customers
    assert most <= 64 * 3 * 12
    span, every = datetime.timedelta(hours=48), [r for rows in parts for r in rows]
    want = {(i, sum(d == c and t - span <= u <= t for _, d, u in every)) for i, c, t in every}
    found = windows.read_closed(spark, f"{tmp_path}/out").collect()
    assert {(r["trace_id"], r["n_contacts"]) for r in found} == want and len(found) == len(every)


def test_vectors_join_after_the_responses(spark):
    plan = routing._answered(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "vec_ref" in joins[0] and not any("vec_ref" in line for line in joins[1:])


def test_blocks_of_vectors_give_the_sums_of_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), int(rng.integers(2)), float(rng.random() + 0.5),
             {int(f): float(v) for f, v in zip(rng.permutation(30)[:rng.integers(0, 9)], rng.random(9))}) for _ in range(200)]
    cells = linear.sparse_vectors([r[3] for r in rows])
    df = spark.createDataFrame([(*r[:3], i.as_py(), v.as_py()) for r, i, v in zip(rows, *cells.columns)],
                               "y int, fold int, weight double, idx binary, val binary")
    weights = rng.normal(size=(31, 9))
    dense = np.zeros((200, 31))
    for i, r in enumerate(rows):
        dense[i, list(r[3])] = np.array(list(r[3].values()), np.float32)
    dense[:, 30] = 1.0
    y, fold, weight = (np.array([r[c] for r in rows]) for c in range(3))
    sign = np.where(y[:, None] == np.tile(np.arange(3), 3), 1.0, -1.0)
    used = np.where(fold[:, None] == np.repeat(np.arange(3), 3), 0.0, weight[:, None])
    short = np.maximum(0.0, 1.0 - sign * (dense @ weights))
    blocks = linear.blocks(df)
    assert blocks.count() < 20
    loss, grad = linear._squared_hinge(blocks, weights, 3)
    assert np.allclose(loss, (used * short * short).sum(axis=0)) and np.allclose(grad, dense.T @ (-2.0 * used * sign * short))
    held = linear.out_of_fold_margins(blocks, weights, 3, 2).collect()
    want = sorted((int(y[i]), *np.round((dense[i] @ weights).reshape(3, 3)[fold[i]], 9)) for i in range(200))
    assert np.allclose(sorted((r["y"], *np.round(r["m"], 9)) for r in held), want)
