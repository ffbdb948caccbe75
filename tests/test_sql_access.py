"""Predicates as rules and table functions: failures, order, nulls and argument checks."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ticketlens.functions import udtfs
from ticketlens.operators import monitoring
from ticketlens.operators.predicates import PredicateRule, evaluate_predicates, unusable_rules

T0 = dt.datetime(2024, 5, 1)
RULES = [
    PredicateRule("ratio", "warn", "a / b > 2", "a over b", "'a is ' || a"),
    PredicateRule("zero", "warn", "a / (b - b) > 0", "never"),
    PredicateRule("missing", "warn", "nowhere > 1", "never"),
    PredicateRule("no_sql", "warn", "a >", "never"),
    PredicateRule("bad_cast", "warn", "cast('x' as int) > 0", "never"),
    PredicateRule("plain", "critical", "b = 0", "b is zero", "1 / b"),
    PredicateRule("bad_message", "critical", "b = 0", "b is zero", "nowhere"),
]


@pytest.fixture(scope="module")
def snapshots(spark):
    return spark.createDataFrame([(T0, 5.0, 2.0), (T0 + dt.timedelta(hours=1), 1.0, 0.0), (T0 + dt.timedelta(hours=2), None, 1.0)],
                                 "ts timestamp, a double, b double")


def test_failing_rules_stay_silent(spark, snapshots):
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    out = evaluate_predicates(snapshots, RULES)
    fired = {(r["rule_name"], r["ts"].hour): r["message"] for r in out.where("breach").collect()}
    assert fired == {("ratio", 0): "a is 5.0", ("plain", 1): "b is zero", ("bad_message", 1): "b is zero"}
    assert out.count() == 3 * len(RULES) and out.where("breach is null").count() == 0
    assert unusable_rules(snapshots, RULES) == ["missing", "no_sql"]
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi
    assert monitoring.active_alerts(out).count() == 0
    assert [r["rule_name"] for r in monitoring.alert_fires(out).orderBy("rule_name").collect()] == ["bad_message", "plain", "ratio"]
    assert evaluate_predicates(snapshots.limit(0), RULES).count() == 0


def test_predicates_on_a_stream(spark, snapshots, tmp_path):
    snapshots.write.parquet(str(tmp_path / "in"))
    stream = evaluate_predicates(spark.readStream.schema(snapshots.schema).parquet(str(tmp_path / "in")), RULES)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("breach").count() == 3


def test_table_functions(spark):
    assert udtfs.register_udtfs(spark) == ["ranked_scores", "evaluate_rules", "preference_pairs"]
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.5), (1, "d", None), (2, "x", 0.1), (None, "n", 0.2), (None, "m", 0.9)],
                                 "k int, item string, score double")
    ranked = spark.sql("select * from ranked_scores(table({rows}), 'k', 'item', 'score', 2)", rows=rows).collect()
    assert {tuple(r) for r in ranked} == {(1, "b", 0.9, 1), (1, "a", 0.5, 2), (2, "x", 0.1, 1), (None, "m", 0.9, 1), (None, "n", 0.2, 2)}
    pairs = spark.sql("select * from preference_pairs(table({rows}), 'k', 'item', 'score', 0.4)", rows=rows).collect()
    assert {tuple(r)[:3] for r in pairs} == {(1, "b", "a"), (1, "b", "c"), (None, "m", "n")}
    assert spark.sql("select * from ranked_scores(table({rows}), 'k', 'item', 'score', 2)", rows=rows.limit(0)).count() == 0
    with pytest.raises(AnalysisException, match="must name a column"):
        spark.sql("select * from ranked_scores(table({rows}), 'k', 'nothing', 'score', 2)", rows=rows)
    with pytest.raises(AnalysisException, match="positive"):
        spark.sql("select * from ranked_scores(table({rows}), 'k', 'item', 'score', 0)", rows=rows)


def test_rules_as_a_table_function_skip_absent_metrics(spark, snapshots):
    udtfs.register_udtfs(spark)
    rules = '[["high", "warn", "a", ">", 2], ["absent", "warn", "z", "<", 1]]'
    out = spark.sql(f"select * from evaluate_rules(table({{s}}), 'ts', '{rules}')", s=snapshots)
    assert [(r["rule_name"], r["breach"]) for r in out.orderBy("ts").collect()] == [("high", True), ("high", False), ("high", False)]
    assert out.where(F.col("value").isNull()).count() == 1


def test_poisson_bootstrap_of_odd_metrics(spark):
    from ticketlens.operators import abtest

    rows = spark.createDataFrame([(i, "a" if i % 2 else None, float(i % 7), None) for i in range(700)],
                                 "id int, g string, x double, y double")
    out = {(r["g"], r["metric"]): r for r in abtest.poisson_bootstrap(rows, "id", {"x": F.col("x"), "y": F.col("y")}, ("g",)).collect()}
    assert set(out) == {("a", "x"), (None, "x"), ("a", "y"), (None, "y")}
    x = out[("a", "x")]
    assert x["n"] == 350 and x["ci_lower"] < x["estimate"] < x["ci_upper"]
    # two standard errors of the mean of 0 .. 6
    assert x["ci_upper"] - x["ci_lower"] == pytest.approx(2 * 1.96 * 2 / 350 ** 0.5, rel=0.15)
    assert out[("a", "y")]["n"] == 0 and out[("a", "y")]["ci_lower"] is None
    assert abtest.poisson_bootstrap(rows.limit(0), "id", {"x": F.col("x")}, ("g",)).count() == 0


def test_poisson_weights_have_the_right_counts(spark):
    import math

    from ticketlens.operators.abtest import poisson_weight

    found = {r["w"]: r["count"] for r in spark.range(65536).select(poisson_weight(F.col("id")).alias("w")).groupBy("w").count().collect()}
    for k in range(6):
        assert found[k] == pytest.approx(65536 * math.exp(-1) / math.factorial(k), abs=1.01)
    assert sum(found.values()) == 65536
