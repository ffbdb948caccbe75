"""Inputs that once gave wrong results: null groups, no rows, null replies, marked letters."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import classify, metrics, monitoring, pareto, safety
from ticketlens.sources import stores, tickets


def test_null_domain_is_a_group_of_its_own(spark):
    rows = spark.createDataFrame(
        [(None, "resolved", "resolved", "abc"), ("billing", "escalate", "escalate", "d")],
        "domain string, pred string, label string, response string")
    out = {r["domain"]: r for r in metrics.domain_evaluation(rows).collect()}
    assert out[None]["n"] == 2 and out["unknown"]["n"] == 1 and out["billing"]["n_escalated"] == 1
    single = rows.withColumns({"latency_ms": F.lit(1.0), "text": F.lit("x")})
    assert metrics.evaluate(single).count() == 1


def test_no_records(spark):
    none = spark.createDataFrame([], "domain string, pred string, label string")
    row = metrics.escalation_metrics(none).first()
    assert row["tp"] == 0 and row["false_negative_rate"] == 1.0 and row["false_positive_rate"] == 1.0


def test_null_response(spark):
    row = safety.run_filters(spark.createDataFrame(
        [(1, "my invoice", None, "billing", 0.0)],
        "ticket_id int, text string, response string, domain string, escalation_score double")).first()
    assert row["quality_passed"] is False and row["pii_scrubbed"] is False


def test_hypervolume_of_nothing(spark):
    none = spark.createDataFrame([], "point_id int, accuracy double, latency_ms double, cost_per_ticket double")
    assert pareto.hypervolume_sampled(none).first()[0] == 0.0


def test_stores_can_be_counted(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([('{"text": "a"}',), ("{broken",)], "value string").write.text(path)
    schema = spark.createDataFrame([], "text string").schema
    assert tickets.load_examples(spark, path, schema).count() == 1
    assert stores.read_report(spark, path, "text string").count() == 1


def test_accents_of_all_scripts(spark):
    row = spark.sql("select 'Đại học été ά ñ' as t").select(classify.strip_accents(F.col("t"))).first()
    assert row[0] == "Đai hoc ete α n"


def test_dashboard_refuses_tables(spark):
    one = spark.createDataFrame([(1,)], "a int")
    alerts = spark.createDataFrame([("warn", 2)], "level string, n_active bigint")
    assert monitoring.dashboard_snapshot(one, one, one, one.limit(0), one, alerts).first()["n_alerts"] == 2
    with pytest.raises(Exception, match="more than one row"):
        monitoring.dashboard_snapshot(one, one, one.union(one), one, one, alerts).collect()


def test_linear_classifier_query_trains_with_defaults_and_scores_held_out_rows(spark, sf, monkeypatch):
    from ticketlens.catalog import learning

    seen = {}

    class Model:
        def predict_proba(self, rows):
            seen["scored"] = {r[0] for r in rows.select("ticket_id").collect()}
            return rows.withColumn("prediction", F.col("domain"))

    def train(rows, kind, **options):
        seen.update(options=options, trained={r[0] for r in rows.select("ticket_id").collect()})
        return Model()

    monkeypatch.setattr(learning.classify, "train_classifier", train)
    learning.m2(spark, sf)
    assert seen["options"] == {"key": "ticket_id"}
    assert seen["scored"] and not seen["scored"] & seen["trained"]
    assert len(seen["trained"]) > 3 * len(seen["scored"])


def test_mcnemar_p_value_of_large_groups(spark):
    import math

    import duckdb

    from ticketlens.catalog import evaluation

    pairs = [(1, 0, 0), (2, 9, 3), (3, 24, 0), (4, 25, 0), (5, 30, 10), (6, 13, 12), (7, 900, 1000), (8, 20, 20)]
    got = {r["customer_id"]: r["p_value"] for r in evaluation.mcnemar_p_values(
        spark.createDataFrame(pairs, "customer_id int, b int, c int")).collect()}
    values = ", ".join(map(str, pairs))
    want = duckdb.sql(f"with y(customer_id, b, c) as (values {values}), {evaluation._P_VALUES}").fetchall()
    assert got == pytest.approx({r[0]: r[3] for r in want}, abs=1.5e-6) and None not in got.values()
    assert got[5] == pytest.approx(math.erfc(math.sqrt(19**2 / 40 / 2)), abs=1e-6)


def test_encoder_is_made_once_per_worker(spark, tmp_path):
    from ticketlens.operators import vectors

    log = str(tmp_path / "made")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = spark.range(2000).select(F.col("id"), F.col("id").cast("string").alias("text")).repartition(16)
    out = vectors.encode(rows, load=load)
    assert out.where("v[0] <> length(text)").count() == 0
    made = open(log).read().split()
    assert len(made) == len(set(made)) < 16


def test_all_gates_run_noise_on_what_is_left(spark):
    from ticketlens.operators import quality

    texts = [hashlib.sha512(str(k).encode()).hexdigest() for k in range(120)]  # of one length, none like another
    rows = [(k, t, "left" if k % 2 else "right") for k, t in enumerate(texts)]
    rows[10] = (10, rows[10][1], "left")  # its vector lies among the others
    rows += [(900, texts[0], "right"), (901, "x", "right"), (902, texts[1][::-1], "left"), (903, texts[2][::-1], None)]
    df = spark.createDataFrame(rows, "ticket_id int, text string, label string")
    vectors_of = spark.createDataFrame([(k, [float(k % 2), k / 1000.0]) for k in range(120)] + [(903, [0.0, 0.0])], "ticket_id int, v array<double>")
    got = {r["ticket_id"]: r["reason"] for r in quality.run_all_gates(df, vectors_of).collect()}
    assert {k: r for k, r in got.items() if r} == {10: "label_noise", 900: "exact_duplicate", 901: "outlier"}
    few = quality.run_all_gates(df.where("ticket_id < 19"), vectors_of)
    assert few.where("reason is not null").count() == 0 and few.columns == [*df.columns, "reason"]
    assert quality.run_all_gates(df.limit(0), vectors_of).count() == 0


def test_evaluation_job_of_small_tables(spark):
    from ticketlens.operators import job

    rows = [(1, "billing", "resolved", "resolved", "resolved", 90.0, "my invoice", "I will refund the charge today, thank you for waiting."),
            (2, None, "escalate", "resolved", "escalate", 250.0, "x", "No.")]
    records = spark.createDataFrame(rows, "ticket_id int, domain string, label string, control_pred string, treatment_pred string, "
                                          "latency_ms double, text string, response string")
    runs = spark.createDataFrame([(1, 0.9, 100.0, 0.1), (2, 0.8, 120.0, 0.2)], "point_id int, accuracy double, latency_ms double, cost_per_ticket double")
    report = {(r["part"], r["group"], r["metric"]): r["value"] for r in job.evaluation_job(records, runs).collect()}
    assert report[("headline", None, "n")] == 2 and report[("domain", None, "n")] in (1, 2)
    assert report[("ab", None, "accuracy_delta")] == 0.5 and report[("pareto", None, "n_frontier")] == 1
    assert report[("best", "speed", "best_point")] == 1
