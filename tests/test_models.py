"""Models: training, fallback, persistence, independence of row placement."""

import numpy as np
import pytest
from netsilt.operators import classify, failure_model, isolation_forest, log_classifier, maintenance
from netsilt.plans import derived
from netsilt.streaming import ingest, windows
from pyspark.sql import functions as F
from tests.conftest import SF


@pytest.fixture(scope="module")
def logs(spark):
    return derived.logs(spark, SF).persist()


@pytest.fixture(scope="module")
def labels(logs):
    return classify.rule_classify(logs).select("log_id", F.col("category").alias("label"))


@pytest.fixture(scope="module")
def trained(logs, labels):
    return log_classifier.train_classifier(logs, labels, num_trees=10, max_depth=8, folds=2)


def test_training_metrics(trained):
    m = trained.metrics
    assert m["n_samples"] == 1000 and m["accuracy"] > 0.9 and m["cv_mean"] > 0.9 and m["cv_std"] >= 0
    assert m["classes"] == sorted(m["classes"]) and "SECURITY" in m["classes"]
    assert trained.report.agg(F.sum("support")).first()[0] > 100


def test_prediction_and_fallback(spark, logs, trained, tmp_path):
    path = str(tmp_path / "model")
    log_classifier.save_model(trained.model, path)
    model = log_classifier.load_model(path)
    answers = log_classifier.predict(logs, model)
    done = classify.classify(logs, answers)
    methods = {r[0]: r[1] for r in done.groupBy("classification_method").count().collect()}
    assert done.count() == 1000 and methods["ml"] == answers.count()
    assert answers.filter("confidence < 0.65").count() == 0
    plain = classify.classify(logs, log_classifier.predict(logs, log_classifier.load_model(str(tmp_path / "none"))))
    assert plain.filter("classification_method <> 'rule'").count() == 0
    importance = log_classifier.feature_importance(spark, model).collect()
    assert len(importance) == 27 and abs(sum(r["importance"] for r in importance) - 1) < 1e-6


def test_answers_without_a_join_agree(spark, logs, trained, tmp_path):
    cols = ["log_id", "category", "subcategory", "classification_confidence", "classification_method", "threat_type"]
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    by_join = classify.classify(logs, log_classifier.predict(logs, trained.model))
    narrow = classify.classify(logs, answer=log_classifier.answering(trained.model))
    assert narrow.columns == by_join.columns and rows(narrow) == rows(by_join)
    assert "Exchange" not in narrow._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert rows(classify.classify(logs, answer=log_classifier.answering(None))) == rows(classify.classify(logs))
    # and on a stream
    logs.write.parquet(f"{tmp_path}/in")
    stream = ingest.table_stream(spark, f"{tmp_path}/in", logs.schema)
    classified = windows.classified_stream(stream, log_classifier.answering(trained.model))
    ingest.append_to(classified, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(narrow)


def test_labels_must_match(logs, labels):
    with pytest.raises(ValueError, match="one to one"):
        log_classifier.train_classifier(logs, labels.limit(10))
    with pytest.raises(ValueError, match="at least 20"):
        few = logs.limit(5).persist()
        log_classifier.train_classifier(few, few.select("log_id", F.lit("A").alias("label")))


def test_forest_does_not_depend_on_placement(spark, logs, tmp_path):
    one = isolation_forest.fit(logs, trees=20, sample=64)
    other = isolation_forest.fit(logs.repartition(7, "source"), trees=20, sample=64)
    assert one.nodes.equals(other.nodes) and one.nodes["tree"].nunique() == 20
    isolation_forest.save_forest(spark, one, str(tmp_path / "forest"))
    again = isolation_forest.load_forest(spark, str(tmp_path / "forest"))
    first = {r[0]: r[1] for r in isolation_forest.score(logs, one).collect()}
    second = {r[0]: r[1] for r in isolation_forest.score(logs, again).collect()}
    assert first == second and all(0 <= v <= 1 for v in first.values())
    flagged = sum(v > 0.5 for v in first.values()) / len(first)
    assert 0.02 < flagged < 0.08  # the contamination share
    assert isolation_forest.load_forest(spark, str(tmp_path / "none")) is None
    assert isolation_forest.score(logs, None).filter("ml_score <> 0").count() == 0


def test_outlier_is_isolated(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (255, 2)), [[9.0, 9.0]]])
    table = isolation_forest.grow_tree(0, x, 1)
    assert len(table) <= 2 * 256 - 1
    depths = []
    for point in (x[-1], np.zeros(2)):
        total = 0.0
        for tree in range(50):
            t = isolation_forest.grow_tree(tree, x, 1)
            node = 0
            while t["feature"][node] >= 0:
                node = t["left"][node] if point[t["feature"][node]] <= t["threshold"][node] else t["right"][node]
            total += t["path"][node]
        depths.append(total / 50)
    assert depths[0] < depths[1] - 2


def test_failure_model(logs, tmp_path):
    features = maintenance.device_features(logs).persist()
    labels = features.select("device", (F.col("cpu_last") > 0.2).cast("int").alias("label"))
    trained = failure_model.train_failure_model(features, labels, max_iter=5)
    log_classifier.save_model(trained.model, str(tmp_path / "gbt"))
    scores = failure_model.failure_probabilities(features, log_classifier.load_model(str(tmp_path / "gbt"))).collect()
    assert len(scores) == features.count() and all(0 <= r[1] <= 1 for r in scores)
    assert failure_model.failure_probabilities(features, None).filter("failure_probability <> 0").count() == 0
    features.unpersist()


def test_device_means_are_summed_oldest_first(spark):
    """Sums of these values differ by order, and the mean is shown as 31 or 32 with it."""
    values = [round(31.5 + (i * 37 % 50 - 24.5) * 1.01, 2) for i in range(50)]
    oldest_first, newest_first = 0.0, 0.0
    for v in values:
        oldest_first += v
    for v in values[::-1]:
        newest_first += v
    assert oldest_first != newest_first
    rows = [("d", "cpu_usage", 50 - i, v) for i, v in enumerate(values)]
    for stored in (rows, rows[::-1], sorted(rows, key=lambda r: r[3])):
        df = spark.createDataFrame(stored, "device string, signal string, age int, value double").coalesce(1)
        assert maintenance.features_of(df).first()["cpu_mean"] == oldest_first / 50 / 100.0


def test_fit_alone_is_the_model_of_a_training_run(spark, logs, labels):
    """No cross-validation for those who read only the model; rows are every core's work however few bytes they are."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fit", "fit alone")
    alone = log_classifier.fit_classifier(logs, labels, num_trees=5, max_depth=4, folds=2)
    spark.sparkContext.setJobGroup("train", "training run")
    whole = log_classifier.train_classifier(logs, labels, num_trees=5, max_depth=4, folds=2).model
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup("fit")) < len(tracker.getJobIdsForGroup("train")) / 2
    trees = lambda model: log_classifier._forest(model).toDebugString.split("\n", 1)[1]
    assert trees(alone) == trees(whole)
    _, _, ready = log_classifier._prepared(logs, labels, 2, 42)
    assert ready.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready.unpersist()
