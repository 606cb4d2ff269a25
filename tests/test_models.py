"""Values of the model queries: bounds on held-out error against plain baselines, and simple fits."""

import math

import numpy as np
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from stopflow.plans import catalog

BIG = FOLDER.replace("sf0.001", "sf0.01")


def run(spark, name, folder=FOLDER):
    return catalog.QUERIES[name](spark, folder).collect()


def errors(rows, label):
    y = np.array([float(r[label]) for r in rows])
    p = np.array([r["prediction"] for r in rows])
    return math.sqrt(((y - p) ** 2).mean()), math.sqrt(((y - y.mean()) ** 2).mean()), y, p


def test_boosting_beats_the_mean(spark):
    rows = run(spark, "ridership_boosting")
    error, spread, y, p = errors(rows, "n")
    assert len(rows) == 60 and len({r.date for r in rows}) == 60
    assert error < 1.1 * spread and (p > 0).all() and abs(p.mean() - y.mean()) < 2 * spread


def test_forest_beats_the_mean(spark):
    rows = run(spark, "reliability_forest", BIG)
    error, spread, y, p = errors(rows, "mdbf_mean")
    assert len(rows) > 20 and error < spread and y.min() - spread <= p.min() and p.max() <= y.max() + spread


def test_classes_beat_the_most_common(spark):
    rows = run(spark, "delay_classification")
    right = sum(r.target == r.prediction for r in rows) / len(rows)
    classes = {r.target for r in rows}
    # classes are weighted alike: compare the mean recall with that of one class for all
    recall = [np.mean([r.prediction == c for r in rows if r.target == c]) for c in classes]
    assert {r.prediction for r in rows} <= {0, 1, 2} and np.mean(recall) > 0.9 / len(classes) and right > 0.2


def test_importance_is_ranked_and_sums_to_one(spark):
    rows = run(spark, "delay_feature_importance")
    scores = [r.importance for r in sorted(rows, key=lambda r: r["rank"])]
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == list(range(1, len(rows) + 1)) and len({r.feature for r in rows}) == len(rows)
    assert scores == sorted(scores, reverse=True) and sum(scores) == pytest.approx(1) and min(scores) >= 0


def test_forecast_follows_the_series(spark):
    """The forecast lies where the least squares fit of the same terms does."""
    from stopflow.plans import trends
    from stopflow.plans.base import Tables
    rows = sorted(run(spark, "ridership_forecast"), key=lambda r: r.date)
    t = Tables(spark, FOLDER)
    history = sorted((r.date, float(r.n)) for r in trends.daily(t).select("date", "n").collect())
    free = {r.date for r in trends.holidays(t).collect()}
    origin = history[0][0].replace(year=1995, month=1, day=1)
    changes = [origin.replace(year=y, month=m) for y, m in ((1996, 7), (1998, 1), (1999, 7))]

    def terms(d):
        day = (d - origin).days
        out = [1.0, day / 365.25, *(max(0.0, (d - c).days / 365.25) for c in changes)]
        for period, order in ((365.25, 5), (7.0, 3)):
            out += [f(day * 2 * math.pi * k / period) for k in range(1, order + 1) for f in (math.sin, math.cos)]
        return [*out, float(d in free)]

    x, y = np.array([terms(d) for d, _ in history]), np.array([n for _, n in history])
    fit, *_ = np.linalg.lstsq(x, y, rcond=None)
    spread = math.sqrt(((x @ fit - y) ** 2).mean())
    want = np.array([terms(r.date) for r in rows]) @ fit
    assert len(rows) == 30 and (rows[0].date - history[-1][0]).days == 1
    assert max(abs(r.forecast - w) for r, w in zip(rows, want)) < 0.25 * spread
    assert all(r.upper - r.forecast == pytest.approx(1.2816 * spread, rel=0.02) and r.forecast - r.lower == pytest.approx(r.upper - r.forecast) for r in rows)


def test_split_computes_its_rows_once(spark):
    """The rows of a split are read back, not computed again by all that follows it."""
    from stopflow.operators import series as S

    df = spark.range(100).select("id", (F.col("id") * 7 % 100).alias("o"))
    out = S.chronological_split(df, ["o"], F.floor(F.col("o") / 10))
    assert "Range" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["o"] for r in out.filter("part = 'test'").collect()} == set(range(80, 100))


def test_classifier_keeps_nodes_and_grows_the_same_trees(spark):
    from pyspark.ml.classification import RandomForestClassifier

    from stopflow.operators import models as M

    rows = spark.range(300).selectExpr("id", "cast(id % 17 as double) a", "cast(id % 5 as double) b", "cast(id * id % 3 as int) y",
                                       "1.0D weight", "if(id < 240, 'train', 'test') part")
    model, _ = M.delay_classifier(rows, ["a", "b"], "y", trees=5, depth=4)
    grown = model.stages[-1]
    assert grown.getCacheNodeIds()
    plain = M._fit(M.complete_rows(rows, ["a", "b"], "y").filter("part = 'train'"), ["a", "b"],
                   RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=5, maxDepth=4, seed=42)).stages[-1]
    assert grown.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]


def test_large_forest_grows_in_parts(spark, monkeypatch):
    """Rows hold the draws of a part of the trees at a time; the forest has them all, and votes and ranks features with all."""
    from pyspark.ml.classification import RandomForestClassifier

    from stopflow.operators import models as M

    rows = spark.range(600).selectExpr("id", "cast(id % 17 as double) a", "cast(id % 5 as double) b", "cast(id % 7 as double) c", "cast(id % 17 div 6 as int) y",
                                       "1.0D + id % 2 weight", "if(id < 480, 'train', 'test') part")
    names, grown, fit = ["a", "b", "c"], [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: grown.append((self.getNumTrees(), self.getCacheNodeIds(), df.count())) or fit(self, df))
    monkeypatch.setattr(M, "KEPT_BYTES", 1000, raising=False)
    monkeypatch.setattr(M, "PART_TREES", 4, raising=False)
    model, predicted = M.delay_classifier(rows, names, "y", trees=9, depth=4)
    assert grown == [(3, False, 480)] * 3
    forest = model.stages[-1]
    trees = [t.toDebugString.split("\n", 1)[1] for t in forest.trees]
    assert forest.getNumTrees == 9 and forest.totalNumNodes == sum(t.numNodes for t in forest.trees) and len(set(trees)) > 3 and (forest.numClasses, forest.numFeatures) == (3, 3)
    train = M.complete_rows(rows, names, "y").filter("part = 'train'")
    first = M._fit(train, names, RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=3, maxDepth=4, seed=42)).stages[-1]
    assert trees[:3] == [t.toDebugString.split("\n", 1)[1] for t in first.trees]
    found = predicted.collect()
    assert len(found) == 120 and np.mean([r.y == r.prediction for r in found]) > 0.9
    votes = [sum(np.array(t.predictRaw(r.features).toArray()) / sum(t.predictRaw(r.features).toArray()) for t in forest.trees) for r in found[:20]]
    assert all(r.rawPrediction.toArray() == pytest.approx(v) for r, v in zip(found, votes))
    shares = sum(t.featureImportances.toArray() for t in forest.trees)
    ranked = M.feature_importance(model, spark, names).collect()
    assert {r.feature: r.importance for r in ranked} == pytest.approx(dict(zip(names, shares / shares.sum()))) and ranked[0].feature == "a"


def test_classifier_rows_hold_no_other_columns(spark, monkeypatch):
    """What is written for the forest is what it reads, and the rows it predicts keep their id."""
    from stopflow.operators import models as M
    from stopflow.plans import trends
    from stopflow.plans.base import Tables

    written, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    grow = M.delay_classifier
    monkeypatch.setattr(M, "delay_classifier", lambda rows, *names: grow(rows, *names, trees=2, depth=2))
    model, predicted = trends.classified(Tables(spark, FOLDER))
    assert len(written) == 1 and sorted(written[0]) == sorted(["arrival_id", "target", "weight", "part", *trends.DELAY_FEATURES])
    assert predicted.select("arrival_id").distinct().count() == predicted.count() > 0 and model.stages[-1].getNumTrees == 2
