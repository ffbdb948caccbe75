"""Small cases with known results."""

import math

import pytest
from pyspark.sql import functions as F

from ticketlens.functions import stats as st
from ticketlens.functions import text as tx
from ticketlens.operators import (
    abtest, clean, metrics, monitoring, neardup, pareto, quality, routing, safety, selection,
    splits, vectors,
)
from ticketlens.sources import stores, tickets


def one(df, column):
    return df.select(column).first()[0]


def text_row(spark, text):
    return spark.createDataFrame([(text,)], "text string")


@pytest.mark.parametrize("text, expected", [
    ("My SSN is 123-45-6789", "[SSN REDACTED]"),
    ("Card 4532015112830366 on file", "[CARD REDACTED]"),
    ("Mail john.doe@example.com now", "[EMAIL REDACTED]"),
    ("Call 555-867-5309 today", "[PHONE REDACTED]"),
    ("password: hunter2", "[PASSWORD REDACTED]"),
])
def test_scrub_pii(spark, text, expected):
    assert expected in one(text_row(spark, text), tx.scrub_pii(F.col("text")))


def test_escalation_lexicon(spark):
    score = lambda t: one(text_row(spark, t), tx.escalation_score(F.col("text")))
    assert score("all fine, thanks") == 0
    assert score("This is unacceptable") == pytest.approx(0.35)
    assert score("useless! I will sue you NOW") == 1.0
    assert score("I know nothing") == 0  # whole words only


def test_auto_resolution_and_escalation(spark):
    rows = [("resolved", "resolved"), ("resolved", "resolved"), ("resolved", "resolved"),
            ("escalate", "resolved"), ("escalate", "resolved"), ("escalate", "escalate")]
    df = spark.createDataFrame([(p, l, "billing") for p, l in rows], "pred string, label string, domain string")
    total = metrics.auto_resolution_rate(df).where("domain is null").first()
    assert total["auto_resolution_rate"] == pytest.approx(3 / 5)
    esc = metrics.escalation_metrics(df).where("domain is null").first()
    assert (esc["tp"], esc["fp"], esc["fn"], esc["tn"]) == (1, 2, 0, 3)
    assert esc["meets_budget"] and esc["f1"] == pytest.approx(2 * (1 / 3) / (1 + 1 / 3))


def test_cost_golden(spark):
    counts = {"technical": 54, "billing": 13, "returns": 25, "escalation": 7}
    rows = [(d,) for d, n in counts.items() for _ in range(n)] + [("unknown",)]
    total = metrics.cost_metrics(spark.createDataFrame(rows, "domain string")).where(
        "domain is null").first()
    assert round(total["avg_cost"], 4) == 0.0764
    assert round(total["total_cost"], 2) == 7.56
    assert round(total["cost_reduction_pct"], 2) == 84.73 or round(
        total["cost_reduction_pct"], 2) == 84.72


def test_composite_golden(spark):
    row = spark.createDataFrame([(0.9348, 1.0, 140.5, 0.8472, 0.0)],
                                "auto_resolution_rate double, sensitivity double, p95_ms double, "
                                "cost_reduction double, unsupported_rate double")
    assert round(metrics.composite_score(row).first()["composite_score"], 4) == 0.9619


@pytest.mark.parametrize("n, sizes", [(535, (427, 54, 54)), (128, (102, 13, 13)),
                                      (241, (192, 24, 25)), (69, (55, 7, 7))])
def test_split_sizes_golden(spark, n, sizes):
    df = spark.range(n).select(F.col("id").alias("ticket_id"), F.lit("billing").alias("domain"))
    got = {r["split"]: r["count"] for r in splits.three_way_split(df).groupBy("split").count()
           .collect()}
    assert (got["train"], got["val"], got["test"]) == sizes


def test_statistics_golden(spark):
    row = spark.createDataFrame([(0, 0, 9, 16)], "a int, b int, c int, d int")
    assert one(row, st.mcnemar_p_value()("b", "c")) == pytest.approx(2 * 0.5**9)
    n = spark.createDataFrame([(99,)], "n int")
    assert round(one(n, st.minimum_detectable_effect(F.col("n"))), 4) == 0.1788
    assert one(spark.createDataFrame([(30, 10)], "b int, c int"),
               st.mcnemar_p_value()("b", "c")) == pytest.approx(
        math.erfc(math.sqrt((20 - 1) ** 2 / 40 / 2)))


def test_bootstrap_interval_contains_delta(spark):
    rows = [("x" if i % 10 < 7 else "y", "x" if i % 10 < 9 else "y", "x") for i in range(400)]
    df = spark.createDataFrame(rows, "control_pred string, treatment_pred string, label string")
    r = abtest.ab_test(df).first()
    assert r["ci_lower"] <= r["accuracy_delta"] <= r["ci_upper"]
    assert r["is_significant"]


def test_pareto_small(spark):
    rows = [("a", 0.9, 100.0, 0.1), ("b", 0.8, 120.0, 0.2), ("c", 0.95, 150.0, 0.3),
            ("d", 0.9, 100.0, 0.1)]
    df = spark.createDataFrame(
        rows, "name string, accuracy double, latency_ms double, cost_per_ticket double")
    flags = {r["name"]: r["is_pareto_optimal"] for r in pareto.pareto_frontier(df).collect()}
    assert flags == {"a": True, "b": False, "c": True, "d": True}


def test_hypervolume_exact_and_sampled(spark):
    rows = [(0.9, 100.0, 0.1), (0.95, 150.0, 0.3), (0.7, 50.0, 0.2)]
    df = spark.createDataFrame(
        rows, "accuracy double, latency_ms double, cost_per_ticket double")
    exact = pareto.hypervolume(df).first()[0]
    sampled = pareto.hypervolume_sampled(df, 20000).first()[0]
    assert sampled == pytest.approx(exact, rel=0.05)


def test_run_names(spark):
    df = spark.createDataFrame([("billing_r24_lr1e-04",), ("plain",), ("returns_x",)], "r string")
    d, k = clean.parse_run_name(F.col("r"))
    assert [tuple(x) for x in df.select(d, k).collect()] == [
        ("billing", 24), ("technical", 32), ("returns", 32)]


def test_interference(spark):
    rows = [("a", 1, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("c", 1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_set string, key int, values array<double>")
    assert vectors.interference(df, "a", "b").first()["interference"] == 0.0
    assert vectors.interference(df, "a", "c").first()["interference"] == 1.0
    assert vectors.interference(df, "a", "zzz").first()["interference"] == 1.0


def test_runner_up_and_gap(spark):
    df = spark.createDataFrame(
        [(0.82, [("billing", 0.82, 1), ("technical", 0.14, 2)]), (0.99, [("billing", 0.99, 1)])],
        "primary_score double, all_scores array<struct<domain:string,score:double,rank:int>>")
    rows = df.select(routing.runner_up(), routing.confidence_gap()).collect()
    assert rows[0][0] == "technical" and rows[0][1] == pytest.approx(0.68)
    assert rows[1][0] is None and rows[1][1] == pytest.approx(0.99)


def test_identical_texts_keep_first(spark):
    df = spark.createDataFrame([(i, "the very same ticket text") for i in range(10)],
                               "ticket_id bigint, text string")
    assert [r["ticket_id"] for r in quality.drop_exact_duplicates(df).collect()] == [0]
    assert [r["ticket_id"] for r in neardup.drop_near_duplicates(df).collect()] == [0]


def test_gates_are_idempotent(spark):
    rows = [(i, "billing", f"my invoice number {i * 7919} is wrong again") for i in range(40)]
    rows += [(100, "billing", "hi"), (101, "billing", rows[0][2]), (102, "billing", "x" * 2200)]
    df = spark.createDataFrame(rows, "ticket_id bigint, domain string, text string")
    first = quality.run_quality_gates(df).where("reason is null").drop("reason")
    kept = first.count()
    assert kept <= 40
    again = quality.run_quality_gates(first)
    assert again.where("reason is null").count() == kept


def test_alert_snapshot(spark):
    df = spark.createDataFrame([(1, 0.80, 0.02, 250.0, None)],
                               "ts int, auto_resolution_rate double, false_negative_rate double, "
                               "p95_ms double, cache_hit_rate double")
    fired = {r["rule_name"] for r in monitoring.evaluate_rules(df).where("breach").collect()}
    assert fired == {"auto_resolution_warn", "auto_resolution_critical",
                     "escalation_fnr_critical", "latency_sla_warn"}


def test_alert_cooldown():
    fired, active, last = monitoring.fire_times(
        [0, 60, 120, 300, 301, 400, 500], [True, True, True, True, True, False, True], 300,
        False, 0.0)
    assert fired == [0, 300, 500] and active and last == 500


def test_alert_fires_respects_cooldown(spark):
    rows = [(f"2024-01-01 00:{m:02d}:00", 0.5) for m in range(0, 12)]
    df = spark.createDataFrame(rows, "ts string, auto_resolution_rate double").withColumn(
        "ts", F.to_timestamp("ts"))
    fires = monitoring.alert_fires(monitoring.evaluate_rules(df))
    got = {r["rule_name"]: r["n"] for r in fires.groupBy("rule_name").agg(
        F.count("*").alias("n")).collect()}
    assert got == {"auto_resolution_warn": 3, "auto_resolution_critical": 12}


def test_filters_on_escalated_ticket(spark):
    df = spark.createDataFrame(
        [(1, "This is useless, I will sue", "Please contact us.", "billing", 0.0)],
        "ticket_id bigint, text string, response string, domain string, escalation_score double")
    r = safety.run_filters(df).first()
    assert r["escalation_triggered"] and not r["quality_passed"]
    assert [f["name"] for f in r["filter_results"]] == ["escalation_guard", "pii_scrubber"]
    assert r["case_id"] in r["final_response"]


def test_checkpoint_order_puts_missing_last(spark):
    df = spark.createDataFrame([("billing", 1, None), ("billing", 2, 0.4), ("billing", 3, 0.2)],
                               "domain string, checkpoint_id int, loss double")
    assert selection.best_checkpoints(df, "loss").first()["checkpoint_id"] == 3
    ranked = {r["checkpoint_id"]: r["kept"] for r in
              selection.rank_checkpoints(df, "loss", 2).collect()}
    assert ranked == {1: False, 2: True, 3: True}


def test_sources(spark, tmp_path):
    good = '{"ticket_id": 1, "text": " hello there ", "domain": "Billing", "label": "MAYBE"}'
    (tmp_path / "t.jsonl").write_text(good + "\n\n{broken\n")
    rows, bad = tickets.read_tickets_jsonl(spark, str(tmp_path / "t.jsonl"))
    r = rows.first()
    assert (r["text"], r["domain"], r["label"]) == ("hello there", "billing", "resolved")
    assert [b["line"] for b in bad.collect()] == ["{broken"]
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(ValueError):
        tickets.read_tickets_jsonl(spark, str(tmp_path / "bad.jsonl"))
    (tmp_path / "t.csv").write_text(' Text ,label\n"a, b",escalate\n"  ",resolved\n')
    assert [tuple(x) for x in tickets.read_tickets_csv(spark, str(tmp_path / "t.csv")).collect()
            ] == [("a, b", "escalate")]
    with pytest.raises(ValueError):
        tickets.read_tickets_csv(spark, str(tmp_path / "t.csv"), "missing")
    (tmp_path / "seed.json").write_text('{"billing": [{"text": "a"}], "returns": []}')
    seed = tickets.read_seed_json(spark, str(tmp_path / "seed.json")).first()
    assert (seed["domain"], seed["source"], seed["response"]) == ("billing", "seed", "")
    assert stores.read_report(spark, str(tmp_path / "nothing.json"), "a int").count() == 0
    (tmp_path / "registry.json").write_text(
        '{"config": {}, "checkpoints": {"billing": [{"step": 5, "metrics": {"eval_loss": 0.5}}]}}')
    reg = stores.load_registry(spark, str(tmp_path / "registry.json")).first()
    assert reg["domain"] == "billing" and reg["metrics"] == {"eval_loss": 0.5}


def test_split_store_makes_validation_part_only_when_absent(spark, tmp_path):
    df = spark.range(100).select(
        F.col("id").alias("ticket_id"), F.lit("t").alias("text"), F.lit("billing").alias("domain"),
        F.when(F.col("id") % 2 == 0, "resolved").otherwise("escalate").alias("label"),
        F.when(F.col("id") < 80, "train").otherwise("test").alias("split"))
    tickets.write_splits(df, str(tmp_path / "s"))
    got = tickets.read_domain_splits(spark, str(tmp_path / "s"), "billing")
    sizes = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert sizes == {"train": 72, "val": 8, "test": 20}
    assert tickets.missing_domains(got) == ["technical", "returns", "escalation"]
