"""Closed-form regression, models per site, the weather model and anomalies per site."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliofleet.plans import anomalies as An, models as M, regression as R, reports, site_models as S, weather_model as Wm

DAY0 = date(2024, 1, 1)


@pytest.fixture(scope="module")
def planted(spark):
    """Two sites with opposite laws; x3 = x1 + x2, x4 is constant, one row lacks x1."""
    rnd, rows = random.Random(3), []
    for site, (a, b, c) in {1: (5.0, 2.0, -1.0), 2: (-3.0, 0.5, 4.0)}.items():
        for i in range(300):
            x1, x2 = rnd.gauss(10, 3), rnd.gauss(-2, 1)
            rows.append((site, DAY0 + timedelta(i), a + b * x1 + c * x2 + rnd.gauss(0, 0.1), x1, x2, x1 + x2, 7.0))
    rows.append((1, DAY0 + timedelta(400), 1.0, None, 1.0, 1.0, 7.0))
    rows.append((3, DAY0, 2.5, 1.0, 1.0, 2.0, 7.0))
    return spark.createDataFrame(rows, "site_id BIGINT, day DATE, production_kwh DOUBLE, x1 DOUBLE, x2 DOUBLE, x3 DOUBLE, x4 DOUBLE").persist()


def least_squares(rows, names):
    x = np.array([[1.0] + [r[n] for n in names] for r in rows])
    y = np.array([r.production_kwh for r in rows])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return b, 1 - ((y - x @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("names", [["x1"], ["x1", "x2"], ["x2", "x1", "x4"]])
def test_closed_form_equals_least_squares(planted, names):
    models = {r.site_id: r for r in R.linear_models(planted, names).collect()}
    for site in (1, 2):
        rows = planted.where(f"site_id = {site} AND x1 IS NOT NULL").collect()
        kept = [n for n in names if n != "x4"]
        b, r2 = least_squares(rows, kept)
        got = dict(zip(names, models[site].coefficients))
        assert got.pop("x4", 0.0) == 0.0
        assert [models[site].intercept, *[got[n] for n in kept]] == pytest.approx(b.tolist(), rel=1e-8)
        assert models[site].r2 == pytest.approx(r2, rel=1e-9) and models[site].n == 300
    assert models[3].coefficients == [0.0] * len(names) and models[3].intercept == 2.5 and models[3].r2 is None


def test_dependent_features_add_nothing(planted):
    models = R.linear_models(planted, ["x1", "x2", "x3"])
    assert {r.coefficients[2] for r in models.collect()} == {0.0}
    scored = R.linear_predictions(planted, models, ["x1", "x2", "x3"])
    assert scored.where("x1 IS NULL").first().prediction is None and scored.count() == planted.count()
    scores = {r.site_id: r for r in M.regression_metrics(scored, ["site_id"]).collect()}
    assert scores[1].rmse == pytest.approx(0.1, rel=0.2) and scores[2].r2 > 0.99


def test_each_site_has_its_own_models(planted):
    split = M.share_split(planted)
    names = ["x1", "x2"]
    found = S.site_predictions(split, names, {"trees": S.Ensemble("boosted", 150, 3), "forest": S.Ensemble("forest", 60, 8)})
    linear = R.linear_predictions(split.where("is_test = 1"), R.linear_models(split.where("is_test = 0"), names), names)
    both = found.unionByName(linear.withColumn("model", F.lit("linear")).select(found.columns))
    scores = {(r.site_id, r.model): r for r in S.compare_site_models(both).collect()}
    for site in (1, 2):
        assert scores[site, "linear"].is_best == 1 and scores[site, "trees"].r2 > 0.85 and scores[site, "forest"].r2 > 0.8
    assert scores[1, "trees"].n == 60 and (3, "trees") not in scores  # one row trains nothing
    missing = found.where("site_id = 1 AND prediction IS NULL").collect()
    assert [str(r.day) for r in missing] == [str(DAY0 + timedelta(400))] * 2
    again = S.site_predictions(split.repartition(5), names, {"trees": S.Ensemble("boosted", 150, 3)})
    assert sorted(map(tuple, again.dropna().collect())) == sorted(map(tuple, found.where("model = 'trees'").dropna().collect()))


def test_importances_follow_the_law(planted):
    ranked = S.site_importances(M.share_split(planted), ["x1", "x2", "x4"], S.Ensemble("forest", 30, 6)).where("rank = 1")
    assert {r.site_id: r.feature for r in ranked.collect()} == {1: "x1", 2: "x2"}


def test_grown_tree_is_the_best_split():
    codes = np.array([[0, 1], [0, 0], [1, 1], [1, 0], [2, 1], [2, 0]])
    y = np.array([1.0, 1.0, 1.0, 1.0, 9.0, 9.0])
    tree = S.grow(codes, y, np.ones(6), 2)
    assert (tree[0][1], tree[1][1]) == (0, 1) and S.walk(tree, codes).tolist() == y.tolist()


def test_improvement_is_counted_per_site(spark):
    rows = [(s, DAY0 + timedelta(i), m, 10.0 + i, 10.0 + i + e) for s, base, wx in ((1, 2.0, 1.0), (2, 1.0, 2.0))
            for m, e in (("baseline", base), ("weather", wx)) for i in range(3)]
    found = spark.createDataFrame(rows, "site_id BIGINT, day DATE, model STRING, production_kwh DOUBLE, prediction DOUBLE")
    told = {(r.site_id, r.model): r.improvement_pct for r in S.improvement(found).collect()}
    assert told == {(1, "baseline"): 0.0, (1, "weather"): 50.0, (2, "baseline"): 0.0, (2, "weather"): -100.0}


def hours(spark, n, site=1, ghi=None, start=datetime(2024, 6, 1)):
    rows = [(site, start + timedelta(hours=i), float(15 + i % 10), 50.0, float(i * 7 % 100), 3.0, 1010.0,
             None if ghi is None else float(ghi(i))) for i in range(n)]
    return spark.createDataFrame(rows, "site_id BIGINT, ts TIMESTAMP, temperature DOUBLE, humidity DOUBLE, cloud_cover DOUBLE, "
                                       "wind_speed DOUBLE, pressure DOUBLE, ghi DOUBLE")


def test_weather_forecast_with_and_without_irradiance(spark):
    ahead = datetime(2024, 6, 11)
    past = hours(spark, 240).unionByName(hours(spark, 240, 2, lambda i: i * 13 % 900)).unionByName(hours(spark, 40, 3))
    clear = F.lit(100.0) - F.col("cloud_cover")
    made = past.select("site_id", "ts", F.when(F.col("site_id") == 2, F.col("ghi") / 10).otherwise(clear).alias("production_kwh"),
                       *[F.lit(0.0).alias(f"{c}_kwh") for c in ("consumption", "export", "import")])
    nxt = hours(spark, 48, start=ahead).unionByName(hours(spark, 48, 2, lambda i: i * 13 % 900, ahead)).unionByName(hours(spark, 48, 3, start=ahead))
    told = Wm.weather_impact(made, past, nxt)
    got = {(r.site_id, r.ts): r for r in told.collect()}
    assert {k[0] for k in got} == {1, 2} and len(got) == 96  # 40 hours are too few
    off = {s: np.mean([abs(r.predicted_production - (r.ghi / 10 if s == 2 else 100 - r.cloud_cover)) for (x, _), r in got.items() if x == s]) for s in (1, 2)}
    assert off[1] < 5 and off[2] < 6
    no_sun = Wm.weather_impact(made, past, nxt.drop("ghi"))
    assert no_sun.where("site_id = 1").count() == 48 and all(r.ghi is None for r in no_sun.collect())
    report = {r.site_id: r for r in reports.weather_report(past.join(made, ["site_id", "ts"]).withColumns(
        {c: F.lit(None).cast("double") for c in ("dni", "dhi")}), told).collect()}
    assert report[1].forecast_total == pytest.approx(sum(r.predicted_production for (s, _), r in got.items() if s == 1))
    assert report[3].forecast_total is None and report[3].data_points == 40


def test_anomalies_against_their_own_site(spark):
    rnd = random.Random(8)
    rows = [(s, DAY0 + timedelta(i), level + rnd.gauss(0, 1), rnd.gauss(0, 1)) for s, level in ((1, 10.0), (2, 500.0)) for i in range(200)]
    rows += [(2, DAY0 + timedelta(300), 10.0, 0.0), (9, DAY0, 1.0, 1.0)]  # a common value elsewhere, odd at site 2
    df = spark.createDataFrame(rows, "site_id BIGINT, day DATE, production_kwh DOUBLE, x DOUBLE")
    scored = An.site_anomalies(df, ["production_kwh", "x"], 0.1, trees=40).persist()
    assert scored.count() == len(rows)
    worst = {(r.site_id, r.production_kwh) for r in An.most_anomalous(scored, 1).collect() if r.site_id == 2}
    assert worst == {(2, 10.0)}
    rates = {r.site_id: r.anomaly_rate_pct for r in An.anomaly_summary(scored).collect()}
    assert all(9 <= rates[s] <= 11 for s in (1, 2))
    assert all(-1 <= r.anomaly_score < 0 for r in scored.collect())


def test_fit_leaves_out_incomplete_rows_and_predict_keeps_them(planted):
    model = M.fit(M.linear(["x1", "x2"]), planted.where("site_id = 1"))
    scored = M.predict(model, planted.where("site_id = 1"))
    assert scored.count() == 301 and scored.where("prediction IS NULL").count() == 1


def test_fitted_values_are_those_of_a_walk():
    rng = np.random.default_rng(5)
    codes, y = rng.integers(0, 32, (400, 3)), rng.normal(size=400)
    y[:150] = 1.0  # nodes of equal targets are left behind
    for weight in (np.ones(400), rng.integers(0, 3, 400).astype(float)):
        fitted = np.zeros(400)
        tree = S.grow(codes, y, weight, 8, fitted)
        assert (fitted == S.walk(tree, codes))[weight > 0].all()
        leaves = S.walk(S.grow(codes, y, weight, 8), codes)
        for v in np.unique(leaves[weight > 0]):
            rows = (leaves == v) & (weight > 0)
            assert v == pytest.approx((weight * y)[rows].sum() / weight[rows].sum())


def test_isolation_trees_draw_as_a_plain_version_does():
    def plain(rows, rng, limit):
        nodes, todo = [None], [(0, rows, 0)]
        while todo:
            at, part, depth = todo.pop()
            wide = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) else []
            if depth >= limit or len(part) <= 1 or len(wide) == 0:
                nodes[at] = (-1, 0.0, -1, -1, depth + An._path_norm(len(part)))
                continue
            feature = int(rng.choice(wide))
            cut = rng.uniform(part[:, feature].min(), part[:, feature].max())
            goes = part[:, feature] < cut
            nodes[at] = (feature, float(cut), len(nodes), len(nodes) + 1, 0.0)
            nodes += [None, None]
            todo += [(len(nodes) - 2, part[goes], depth + 1), (len(nodes) - 1, part[~goes], depth + 1)]
        return nodes
    data = np.random.default_rng(1).normal(size=(300, 4)).round(1)
    data[:, 3] = 2.0
    for n in (1, 2, 30, 300):
        assert An._grow(data[:n], np.random.default_rng(7), 8) == plain(data[:n], np.random.default_rng(7), 8)
