"""The one-pass trainer, its guards, and classifiers that save and load."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from ticketlens.operators import classify, linear
from ticketlens.operators.estimators import TicketClassifier, TicketClassifierModel
from ticketlens.plans.views import view

WORDS = {"billing": "invoice charge refund payment card", "returns": "parcel label damaged item return",
         "technical": "router firmware driver crash sync"}


@pytest.fixture(scope="module")
def tickets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        domain = list(WORDS)[i % 3]
        own = rng.choice(WORDS[domain].split(), 4).tolist() + rng.choice(["please", "today", "the", "order"], 3).tolist()
        rows.append((i, " ".join(own), domain))
    rows += [(900, None, "billing"), (901, "", "returns"), (902, "invoice", None)]
    return spark.createDataFrame(rows, "ticket_id int, text string, domain string")


def test_trainer_reaches_the_optimum_of_the_loss(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    y = (x @ rng.normal(size=6) + 0.5 * rng.normal(size=300) > 0).astype(int)
    batch = linear.sparse_vectors([{j: row[j] for j in range(6)} for row in x])
    rows = spark.createDataFrame(
        [(int(a), i % 3, 1.0 + i % 2, u, v) for i, (a, u, v) in enumerate(
            zip(y, batch.column("idx").to_pylist(), batch.column("val").to_pylist()))],
        "y int, fold int, weight double, idx binary, val binary").repartition(3).cache()
    weights, passes = linear.fit_margins(rows, 6, 2, 3, 1.0, 200, 1e-9)
    assert passes < 200 and weights.shape == (7, 8)
    design, sign, weight, fold = np.column_stack([x.astype(np.float32), np.ones(300)]), np.where(y == 1, 1.0, -1.0), 1.0 + np.arange(300) % 2, np.arange(300) % 3
    for f in range(4):  # the gradient vanishes where each fold's own rows are left out
        use = weight * (fold != f)
        w = weights[:, 2 * f + 1]
        slope = w + design.T @ (-2 * use * sign * np.maximum(0, 1 - sign * (design @ w)))
        assert np.abs(slope).max() < 1e-2
        assert weights[:, 2 * f] == pytest.approx(-w, abs=1e-3)


def test_steps_that_leave_the_finite_numbers_are_halved():
    seen = []

    def evaluate(points):
        p = points[0]
        seen.append(float(p[0]))
        with np.errstate(all="ignore"):
            loss = np.where(np.abs(p) > 1.5, np.nan, 3 * (p - 1) ** 4 + (p - 1) ** 2)
            return loss, (12 * (p - 1) ** 3 + 2 * (p - 1))[None, :]

    at, _ = linear._descend(1, 1, evaluate, 60, 1e-12)
    assert at[0, 0] == pytest.approx(1.0, abs=1e-3) and np.isfinite(seen).all()


def test_linear_classifier_learns_and_keeps_odd_rows(tickets, tmp_path):
    model = classify.train_classifier(tickets.where("ticket_id % 4 <> 0"), "svm", key="ticket_id")
    out = model.predict_proba(tickets).cache()
    assert out.count() == tickets.count() and out.columns == [*tickets.columns, "probability", "prediction"]
    right = out.where("ticket_id % 4 = 0 and text is not null and domain is not null").agg(
        F.avg((F.col("prediction") == F.col("domain")).cast("int"))).first()[0]
    assert right > 0.95
    sums = out.select(F.aggregate("probability", F.lit(0.0), lambda a, p: a + p)).distinct().collect()
    assert all(r[0] == pytest.approx(1.0) for r in sums)
    odd = {r["ticket_id"]: r["probability"] for r in out.where("ticket_id in (900, 901)").collect()}
    assert odd[900] == odd[901]
    path = str(tmp_path / "svm")
    model.save(path)
    again = classify.LinearClassifier.load(path).predict_proba(tickets)
    assert again.exceptAll(out).count() == 0
    assert model.predict_proba(tickets.limit(0)).count() == 0
    with pytest.raises(ValueError):
        classify.train_classifier(tickets.where("domain is null"), "svm", key="ticket_id")


def test_weights_are_logarithmic_in_the_count(spark):
    df = spark.createDataFrame([(0, "aa aa aa bb", "x"), (1, "bb cc", "y"), (2, "cc dd", "x")], "ticket_id int, text string, domain string")
    model = classify.LinearClassifier.fit(df, "ticket_id", folds=2, max_iter=2)
    vector = classify._weighted(classify._vocabulary(df, model.vocabulary, model.idf))
    row = classify._with_terms(df, "text").where("ticket_id = 0").select(vector("_terms").alias("v")).select("v.*").first()
    got = dict(zip((model.vocabulary[i] for i in np.frombuffer(row["idx"], np.int32)), np.frombuffer(row["val"], np.float32)))
    want = {r["term"]: r["weight"] for r in classify.tfidf(df, "ticket_id").where("ticket_id = 0").collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_stages_save_and_load_inside_a_pipeline(tickets, tmp_path):
    stage = TicketClassifier(options='{"max_iter": 10}')
    model = Pipeline(stages=[stage]).fit(tickets)
    path = str(tmp_path / "pipeline")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    assert isinstance(loaded.stages[0], TicketClassifierModel)
    assert loaded.transform(tickets).exceptAll(model.transform(tickets)).count() == 0
    stage.write().overwrite().save(str(tmp_path / "stage"))
    assert TicketClassifier.load(str(tmp_path / "stage")).getOrDefault("options") == '{"max_iter": 10}'


def test_embedding_classifier_round_trip(spark, sf, tmp_path):
    rows = view(spark, sf, "vectors_v").select("vec_id", "v", F.col("class_id").cast("string").alias("label"))
    stage = TicketClassifier(kind="embedding", keyCol="vec_id", labelCol="label", inputCol="v", options='{"k": 3}')
    model = Pipeline(stages=[stage]).fit(rows)
    path = str(tmp_path / "vectors")
    model.write().overwrite().save(path)
    query = rows.where("vec_id < 20")
    one, two = (m.transform(query).orderBy("query_id", "label").collect() for m in (model, PipelineModel.load(path)))
    assert one == two and len({r["query_id"] for r in one}) == query.count()
