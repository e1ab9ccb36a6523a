"""Invariants of fitted models; exact trees are not comparable across libraries."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from worklens import columns as C
from worklens.operators import boosting, encode, ensembles, features, isotonic, models, objectives, rollups, unsupervised


@pytest.fixture(scope="module")
def split(prepared):
    return models.prepare_split(prepared, models.OBJECTIVES["sprint"], extra=C.ENGINEERED)


@pytest.fixture(scope="module")
def members(split):
    return ensembles.default_members(split.n_train, trees=4, rounds=3, boosts=3)


def local(df):
    rows = df.select(vector_to_array("features").alias("f"), "label").collect()
    return np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows])


def test_split_is_a_partition_and_scaler_is_population(prepared, split):
    assert split.train.count() + split.test.count() == prepared.count()
    x, _ = local(split.train)
    assert np.allclose(x.mean(axis=0), 0) and np.allclose(x.std(axis=0), 1)


def test_logistic_gradient_is_zero(split):
    m = models.logistic(split.n_train).fit(split.train)
    x, y = local(split.train)
    p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
    assert np.abs(x.T @ (p - y) + m.coefficients.toArray()).max() < 1e-2


def test_ridge_matches_closed_form(prepared):
    s = models.prepare_split(prepared, models.OBJECTIVES["ttr"])
    m = models.ridge(s.n_train, models.label_deviation(s.train)).fit(s.train)
    x, y = local(s.train)
    want = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ (y - y.mean()))
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-8)
    assert models.regress(m, s.test).where("predicted < 0").isEmpty()


def test_ols_residuals_are_orthogonal(prepared):
    s = models.prepare_split(prepared, models.OBJECTIVES["ttr"], drop_first=True)
    m = models.ols().fit(s.train)
    x, y = local(s.train)
    r = y - (x @ m.coefficients.toArray() + m.intercept)
    assert abs(r.sum()) < 1e-4 and np.abs(x.T @ r).max() < 1e-4


@pytest.mark.parametrize("make", [models.tree, lambda: models.forest(4), lambda: models.gbt(3)])
def test_tree_models_beat_the_majority(split, make):
    got = models.classify(make().fit(split.train), split.test)
    share = got.agg(F.avg((F.col("y") == F.col("pred")).cast("double")), F.avg("y"), F.min("p"), F.max("p")).first()
    assert share[0] > max(share[1], 1 - share[1]) and 0 <= share[2] <= share[3] <= 1


def test_importances_sum_to_one(spark, split):
    rows = models.feature_importance(models.gbt(3).fit(split.train), spark, split.names).collect()
    assert np.isclose(sum(r["importance"] for r in rows), 1.0)
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)


def test_vote_is_the_mean_of_members(split, members):
    voted = ensembles.vote_soft(ensembles.fit_members(members, split.train), split.test).collect()
    assert all(np.isclose(r["p"], np.mean([r[f"p{i}"] for i in range(len(members))])) for r in voted)
    assert len(voted) == split.test.count()


def test_adaboost_lowers_training_error(split):
    model = ensembles.AdaBoost(6).fit(split.train)
    err = lambda m: m.transform(split.train).agg(F.avg((F.col("prediction") != F.col("label")).cast("double"))).first()[0]
    first = ensembles.AdaBoostModel(2, model.stumps[:1])
    assert len(model.stumps) == 6 and err(model) <= err(first)
    p = model.transform(split.test).select(vector_to_array("probability").alias("p"), "prediction").collect()
    assert all(np.isclose(sum(r["p"]), 1) and int(np.argmax(r["p"])) == r["prediction"] for r in p)


def test_out_of_fold_covers_training_rows_once(split, members):
    two = dict(list(members.items())[:2])
    scored = ensembles.out_of_fold(two, split.train, 3)
    assert scored.count() == split.n_train == scored.select("row_id").distinct().count()
    card = ensembles.cv_scorecard(scored, list(two)).collect()
    assert len(card) == 3 and all(np.isclose(np.mean(r["fold_accuracy"]), r["mean_accuracy"]) for r in card)


def test_calibrated_scores_are_probabilities(split):
    got = ensembles.calibrated_gbt(split.train, split.test, folds=2, rounds=2, max_depth=2).collect()
    assert len(got) == split.test.count() and all(0 <= r["p"] <= 1 for r in got)


def test_single_class_is_refused(prepared):
    with pytest.raises(ValueError):
        encode.binary_weight(prepared.where("Success_Label = 1"), "Success_Label")


def test_anomaly_share_and_layout(prepared):
    df = features.engineer_features(prepared)
    flags = unsupervised.anomaly_flags(df, C.ANOMALY, trees=20)
    total, hits = flags.count(), flags.where("anomaly = 1").count()
    assert total == prepared.count() and 0 < hits <= 0.05 * total + 1
    other = unsupervised.anomaly_flags(df.repartition(13), C.ANOMALY, trees=20)
    assert sorted(flags.collect()) == sorted(other.collect())


def test_clusters_are_ordered_by_stress(prepared):
    got = unsupervised.cluster_resources(rollups.resource_vectors(prepared, "Resource_ID"), "Resource_ID", restarts=2)
    means = got.groupBy("cluster").agg(F.avg("burnout").alias("b"), F.avg("sprint_risk").alias("s"),
                                       F.avg("workload").alias("w")).orderBy("cluster").collect()
    assert [m["cluster"] for m in means] == [0, 1, 2] and means[0]["w"] < means[2]["w"]


def test_scenarios_need_no_label_and_may_lack_features(spark, prepared):
    fitted = {"sprint": models.fit_pipeline(prepared, models.OBJECTIVES["sprint"], lambda n, rows: models.gaussian_nb())[0],
              "ttr": models.fit_pipeline(prepared, models.OBJECTIVES["ttr"], lambda n, rows: models.ridge(n, models.label_deviation(rows)))[0]}
    form = spark.createDataFrame([(1, 20.0, None, "Bug", 8.0), (2, 20.0, 5.0, "Novelty", None)],
                                 "row_id long, Planned_Story_Points_Sprint double, Blocked_Stories double, Issue_Type string, Original_Estimate_Hours double")
    got = {(r["row_id"], r["objective"]): r for r in models.score_scenarios(form, fitted).collect()}
    assert len(got) == 4 and all(0 <= got[i, "sprint"]["p"] <= 1 for i in (1, 2))
    assert np.isclose(got[1, "ttr"]["delta"], got[1, "ttr"]["prediction"] - 8.0)
    assert np.isclose(got[2, "ttr"]["delta"], got[2, "ttr"]["prediction"])


def test_predictions_of_training_rows_match_the_split(prepared):
    pipeline, _, test = models.fit_pipeline(prepared, models.OBJECTIVES["workload"], lambda n, rows: models.gaussian_nb())
    want = {r["row_id"]: r["pred"] for r in models.classify(pipeline, test).collect()}
    got = {r["row_id"]: r["pred_workload"] for r in models.with_predictions(prepared, {"workload": pipeline}).select("row_id", "pred_workload").collect()}
    assert len(got) == prepared.count() and all(got[i] == p for i, p in want.items())


def test_allocation_learns_its_classes(prepared):
    ninth = prepared.withColumn("Assignee_Resource", F.when(F.col("row_id") % 7 == 0, "Zoe").otherwise(F.col("Assignee_Resource")))
    s = models.prepare_split(ninth, models.OBJECTIVES["alloc"])
    assert s.classes == sorted(s.classes) and "Zoe" in s.classes and s.train.count() + s.test.count() == ninth.count()
    assert {r[0] for r in s.train.select("label").distinct().collect()} == set(map(float, range(len(s.classes))))


def test_unknown_categories_get_their_own_columns(prepared):
    odd = prepared.withColumn("Issue_Type", F.when(F.col("row_id") % 5 == 0, "Chore").otherwise(F.col("Issue_Type")))
    flags = encode.one_hot(encode.levels_of(odd, ["Issue_Type"]))
    assert "Issue_Type_Chore" in flags
    assert odd.select(sum(flags.values()).alias("n")).where("n <> 1").isEmpty()


def plain_boosting(bins, cuts, y, rounds, depth, step):
    """Gradient boosting by trying every split of every node, on whole arrays."""
    mean = y.mean()
    score = np.full(len(y), np.log(mean / (1 - mean)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        leaves = [np.arange(len(y))]
        for _ in range(depth):
            grown = []
            for rows in leaves:
                best, pick = 1e-9, None
                for f, cut in enumerate(cuts):
                    for c in range(len(cut)):
                        left = rows[bins[rows, f] <= c]
                        if 0 < len(left) < len(rows):
                            a, n, whole = g[left].sum(), len(left), g[rows].sum()
                            gain = a ** 2 / n + (whole - a) ** 2 / (len(rows) - n) - whole ** 2 / len(rows)
                            if gain > best + 1e-9:
                                best, pick = gain, (f, c)
                grown += [rows] if pick is None else [rows[bins[rows, pick[0]] <= pick[1]], rows[bins[rows, pick[0]] > pick[1]]]
            leaves = grown
        for rows in leaves:
            score[rows] += step * g[rows].sum() / h[rows].sum()
    return score


def auc(y, p):
    order = np.argsort(p)
    ranks = np.empty(len(p))
    values, inverse, counts = np.unique(p, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    n = (y == 1).sum()
    assert len(order) == len(values[inverse])
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_boosting_equals_plain_version(split):
    model = models.gbt(3).fit(split.train)
    x, y = local(split.train)
    bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(model.cuts)], axis=1)
    want = 1 / (1 + np.exp(-plain_boosting(bins, model.cuts, y, 3, 3, 0.1)))
    got = model.transform(split.train).select(vector_to_array("features").alias("f"), vector_to_array("probability")[1].alias("p")).collect()
    by_row = {tuple(r["f"]): r["p"] for r in got}
    assert np.allclose([by_row[tuple(r)] for r in x], want, atol=1e-9)


def test_boosting_ranks_like_mllib(split):
    from pyspark.ml.classification import GBTClassifier
    theirs = models.classify(GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.1, maxBins=64, seed=42).fit(split.train), split.test).toPandas()
    ours = models.classify(models.gbt(20).fit(split.train), split.test).toPandas()
    assert auc(ours.y.to_numpy(), ours.p.to_numpy()) > auc(theirs.y.to_numpy(), theirs.p.to_numpy()) - 0.005


def test_models_fitted_together_equal_models_fitted_alone(split, monkeypatch):
    """Over folds and several refreshes of the scores, for boosting, AdaBoost and logistic regression."""
    monkeypatch.setattr(boosting, "REFRESH", 2)
    monkeypatch.setattr(boosting, "FAN_IN", 2)
    folded = encode.stratified_folds(split.train, "label", 3)
    data = boosting.Together.of(folded, (0, 1, 2, -1))
    for make in (lambda: models.gbt(5, 2), lambda: ensembles.AdaBoost(4), lambda: models.softmax(weighted=True)):
        for fold, one in zip((0, 1, 2, -1), make().fit_all(data)):
            alone = make().fit_all(boosting.Together(boosting.Together.of(folded.where(f"fold <> {fold}")).blocks, data.cuts, (-1,)))[0]
            if hasattr(one, "cuts"):  # the cuts of one part differ, so compare on the shared ones
                rows = folded.where(f"fold <> {fold}").select(F.col("features"), "label", "weight")
                flat = rows.select(vector_to_array("features").alias("_x"), F.col("label").alias("_y"), F.col("weight").alias("_w"), F.lit(-2).alias("_fold"))
                blocks = boosting.stage(flat.mapInArrow(boosting._cutter(data.cuts, 1), boosting._BLOCKS))
                alone = make().fit_all(boosting.Together(blocks, data.cuts, (-1,)))[0]
            elif isinstance(one, ensembles.AdaBoostModel):
                continue  # its cuts are part of the stumps; it shares its passes with boosting
            score = lambda m: np.array([r["p"] for r in m.transform(split.test).orderBy("row_id").select(vector_to_array("probability")[1].alias("p")).collect()])
            assert np.allclose(score(one), score(alone), atol=1e-7)


def test_regressor_fits_residuals(prepared):
    s = models.prepare_split(prepared, models.OBJECTIVES["ttr"])
    got = models.regress(models.gbt_regressor(10, step=0.5).fit(s.train), s.test).toPandas()
    assert ((got.y - got.predicted) ** 2).mean() < got.y.var() and (got.predicted >= 0).all()


@pytest.mark.parametrize("classes", [2, 4])
def test_softmax_gradient_is_zero(spark, classes):
    rng = np.random.default_rng(classes)
    x = rng.normal(size=(400, 3))
    y = (x @ rng.normal(size=(3, classes)) + rng.gumbel(size=(400, classes))).argmax(axis=1)
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x.tolist(), y.tolist())], ["label", "features"]).repartition(5)
    m = models.softmax(classes).fit(df)
    z = x @ m.coefficients.T + m.intercepts
    z = np.hstack([np.zeros((400, 1)), z]) if classes == 2 else z
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hit = (y[:, None] == np.arange(classes)).astype(float)
    miss = (p - hit)[:, 1:] if classes == 2 else p - hit
    assert np.abs(miss.T @ x + m.coefficients).max() < 1e-5 and np.abs(miss.sum(axis=0)).max() < 1e-5
    got = m.transform(df).select(vector_to_array("features").alias("f"), "prediction", vector_to_array("probability").alias("p")).collect()
    by_row = {tuple(r["f"]): r for r in got}
    assert all(np.allclose(by_row[tuple(a)]["p"], q) and by_row[tuple(a)]["prediction"] == q.argmax() for a, q in zip(x, p))


def test_stratified_split_keeps_class_shares(prepared):
    train, test = encode.stratified_split(prepared.select("row_id", "Success_Label"), "Success_Label")
    share = lambda d: {r[0]: r[1] for r in d.groupBy("Success_Label").count().collect()}
    a, b = share(train), share(test)
    assert sum(a.values()) + sum(b.values()) == prepared.count() and all(0 <= 4 * b[c] - a[c] <= 4 for c in a)


def test_objectives_skip_what_is_absent(prepared):
    some = prepared.select("row_id", *C.BASE_SPRINT[:3], "Success_Label", F.lit(1).alias("Risk_Flag"), *C.BURNOUT)
    got = objectives.train_objectives(some, objectives.CLOSED).collect()
    assert [r["objective"] for r in got] == ["sprint"] and got[0]["accuracy"] > 0.5


def test_suggested_assignee_of_a_known_item(prepared):
    history = prepared.limit(200)
    got = objectives.suggest_assignee(history.limit(20).drop("Assignee_Resource"), history)
    assert got.count() == 20 and got.join(history, "row_id").where(F.col("predicted").isNull()).isEmpty()


def test_one_feature_is_not_clustered(prepared):
    """Two of the four features are needed."""
    bare = prepared.select("row_id", "Resource_ID", "Current_Workload_Percent")
    assert not rollups.can_cluster(bare) and rollups.resource_vectors(bare, "Resource_ID").count() == 0
    two = prepared.select("row_id", "Resource_ID", "Current_Workload_Percent", "Risk_Flag")
    assert rollups.can_cluster(two) and rollups.resource_vectors(two, "Resource_ID").count() > 1


def test_clusters_are_the_nearest_and_do_not_depend_on_layout(prepared):
    vectors = rollups.resource_vectors(prepared, "Resource_ID")
    a = unsupervised.cluster_resources(vectors, "Resource_ID", restarts=4).toPandas().sort_values("Resource_ID").reset_index(drop=True)
    b = unsupervised.cluster_resources(vectors.repartition(7), "Resource_ID", restarts=4).toPandas().sort_values("Resource_ID").reset_index(drop=True)
    assert (a.cluster == b.cluster).all() and len(a) == vectors.count()
    x = a[list(unsupervised.VECTOR)].to_numpy()
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    centers = np.array([z[a.cluster == c].mean(axis=0) for c in range(3)])
    assert (((z[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1) == a.cluster).all()
    d2 = ((z[:, None] - z[None]) ** 2).sum(axis=2)
    c = a.cluster.to_numpy()
    own = np.array([d2[i][(c == c[i]) & (np.arange(len(c)) != i)].mean() for i in range(len(c))])
    far = np.array([min(d2[i][c == k].mean() for k in set(c) - {c[i]}) for i in range(len(c))])
    assert np.isclose(a.silhouette[0], np.where(np.isnan(own), 0, (far - own) / np.maximum(own, far)).mean(), atol=1e-9)


def max_min(pairs):
    """Isotonic values of (x, y) by the max-min form: {x: value}."""
    xs = sorted({x for x, _ in pairs})
    s = [sum(y for v, y in pairs if v == x) for x in xs]
    w = [sum(1 for v, _ in pairs if v == x) for x in xs]
    mean = lambda a, b: sum(s[a:b + 1]) / sum(w[a:b + 1])
    n = len(xs)
    return {xs[i]: max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)}


def isotonic_rows():
    rng = np.random.default_rng(3)
    rising = [(0, float(x), float(rng.random() < x / 60)) for x in rng.integers(0, 60, 300)]
    falling = [(1, float(x), float(60 - x)) for x in range(60)]
    # rising inside every stretch of eight, falling from one to the next
    saw = [(2, float(x), float(x % 8 - x // 8)) for x in range(64)]
    sorted_ = [(3, float(x), float(x)) for x in range(40)]
    return rising + falling + saw + sorted_ + [(4, 2.0, 1.0), (4, None, 0.0), (4, 3.0, None), (4, float("nan"), 0.0)]


def test_isotonic_is_the_max_min_form(spark):
    rows = isotonic_rows()
    blocks = isotonic.fit(spark.createDataFrame(rows, "model int, x double, y double")).toPandas()
    for model in range(4):
        want = max_min([(x, y) for m, x, y in rows if m == model])
        mine = blocks[blocks["model"] == model].sort_values("lo")
        assert (mine["hi"].to_numpy()[:-1] < mine["lo"].to_numpy()[1:]).all()
        for x, value in want.items():
            held = mine[(mine["lo"] <= x) & (x <= mine["hi"])]
            assert len(held) == 1 and abs(held["value"].iloc[0] - value) < 1e-9
    assert blocks[blocks["model"] == 4][["lo", "hi", "value"]].to_numpy().tolist() == [[2.0, 2.0, 1.0]]


def test_isotonic_values_are_lines_between_blocks(spark):
    rows = isotonic_rows()
    blocks = isotonic.fit(spark.createDataFrame(rows, "model int, x double, y double"))
    asked = [(m, x) for m in range(4) for x in (-5.0, 0.0, 0.25, 7.5, 31.9, 31.9, 63.0, 99.0)] + [(0, None), (9, 1.0)]
    got = isotonic.predict(blocks, spark.createDataFrame(asked, "model int, x double")).toPandas()
    assert len(got) == len(asked)
    for m, x, value in got.itertuples(index=False):
        if m == 9 or x != x:
            assert value is None or value != value
            continue
        want = sorted(max_min([(a, b) for k, a, b in rows if k == m]).items())
        assert abs(value - np.interp(x, *zip(*want))) < 1e-9
    assert isotonic.fit(spark.createDataFrame([], "model int, x double, y double")).count() == 0


def test_tree_samples_are_the_lowest_hashes(spark):
    from hashlib import md5
    rows = spark.range(3000).withColumnRenamed("id", "row_id")
    got = unsupervised.tree_samples(rows, trees=3, sample=64, seed=7).toPandas()
    for tree in range(3):
        want = sorted(range(3000), key=lambda i: (md5(f"7/{tree}/{i}".encode()).hexdigest(), i))[:64]
        assert sorted(got[got["tree"] == tree]["row_id"]) == sorted(want)
    assert unsupervised.tree_samples(rows.limit(5), trees=2).count() == 10 and unsupervised.tree_samples(rows.limit(0)).count() == 0


def test_trees_are_walked_by_columns():
    """Every row gets the place that walking it down alone gives, and passes touch no row one by one."""
    rng = np.random.default_rng(5)
    bins = rng.integers(0, boosting.MAX_BINS, (6, 500)).astype(np.uint8)
    for depth in (1, 2, 3, 4):
        inner = (1 << depth) - 1
        feature, cut = rng.integers(0, 6, inner), np.where(rng.random(inner) < 0.2, 255, rng.integers(0, boosting.MAX_BINS, inner))
        want = []
        for row in bins.T:
            node = 0
            for _ in range(depth):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            want.append(node - inner)
        assert boosting._down(feature, cut, bins, depth).tolist() == want


def test_stored_bins_stand_by_feature_and_scores_match_the_passes(split):
    """A model's margins over vectors are those that its trees give over the staged bins."""
    data = boosting.Together.of(split.train)
    model = models.gbt(6, 4).fit_all(data)[0]
    blocks = [b for r in data.blocks.toArrow().to_batches() for b in boosting._read([r], 1)]
    assert all(b.bins.shape == (len(data.cuts), len(b.y)) and b.bins.flags.c_contiguous for b in blocks)
    bins = np.hstack([b.bins for b in blocks])
    want = model.start + sum(boosting._scores(t, bins) for t in model.trees)
    got = split.train.select(model.margin(vector_to_array("features")).alias("m")).toPandas()["m"]
    assert np.allclose(np.sort(want), np.sort(got.to_numpy()), atol=1e-12)


def test_copies_of_rows_cost_no_pass(split):
    """Rows that are alike stand once in the blocks; models, clusters and thresholds are those of all rows."""
    rows = split.train.select("row_id", "label", "features", "weight")
    more = rows.unionByName(rows.where("row_id % 3 = 0")).unionByName(rows.where("row_id % 3 = 0"))
    once, thrice = boosting.Together.of(rows.where("row_id % 3 = 0")), boosting.Together.of(rows.where("row_id % 3 = 0").crossJoin(rows.sparkSession.range(3)))
    held = [sum(r["n"] for r in d.blocks.select("n").collect()) for d in (once, thrice)]
    assert held[0] == held[1]
    data = boosting.Together.of(more)
    flat = more.select(vector_to_array("features").alias("_x"), F.col("label").alias("_y"), F.col("weight").alias("_w"), F.lit(-2).alias("_fold"))
    plain = boosting.Together(boosting.stage(flat.mapInArrow(boosting._cutter(data.cuts, 1), boosting._BLOCKS)), data.cuts, (-1,))
    score = lambda m: np.array([r["p"] for r in m.transform(split.test).orderBy("row_id").select(vector_to_array("probability")[1].alias("p")).collect()])
    for make in (lambda: models.gbt(5, 2), lambda: boosting.Boosting(4, 2, weighted=True), lambda: ensembles.AdaBoost(4), lambda: models.softmax(weighted=True), lambda: models.softmax()):
        assert np.allclose(score(make().fit_all(data)[0]), score(make().fit_all(plain)[0]), atol=1e-9)


def test_packed_isolation_trees_score_like_a_walk(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 3)).round(1)
    pdf = unsupervised._build(5, 6)(pd.DataFrame({"tree": 0, "row_id": range(300), "f": list(x)})).sort_values("node")
    want = []
    for row in x:
        at = 0
        while pdf["dim"].iloc[at] >= 0:
            at = int(pdf["left" if row[pdf["dim"].iloc[at]] <= pdf["cut"].iloc[at] else "right"].iloc[at])
        want.append(pdf["path"].iloc[at])
    deep, dim, cut, turn, path = unsupervised._packed(pdf, 3)
    at = np.zeros(300, dtype=np.int64)
    for _ in range(deep):
        at = turn[2 * at + (x[np.arange(300), dim[at]] <= cut[at])]
    assert path[at].tolist() == want


def test_tree_samples_spread_over_all_cores(spark):
    """A few files of ids are dealt out before they are hashed, and no array of hashes is built."""
    rows = spark.range(5000).withColumnRenamed("id", "row_id").coalesce(1)
    plan = unsupervised.tree_samples(rows, trees=3, sample=64)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "filter(" not in plan


def test_preparing_a_fit_hashes_once_and_learns_from_plain_columns(spark, monkeypatch):
    n = 200
    rows = spark.createDataFrame([(i, i % 2, float(i * i % 37), 5.0, float(i)) for i in range(n)],
                                 "row_id bigint, Success_Label int, Planned_Story_Points_Sprint double, Completed_Story_Points double, Percent_Done double")
    staged, real = [], models.stage
    monkeypatch.setattr(models, "stage", lambda df, by=None: staged.append(by) or real(df, by))
    s = models.prepare_split(rows, models.OBJECTIVES["sprint"], balanced=True)
    assert staged == ["row_id", "row_id"]
    assert "md5" not in s.test._jdf.queryExecution().optimizedPlan().toString()
    x, _ = local(s.train)
    train, test = encode.split_80_20(rows)
    assert s.n_train == train.count() and s.test.count() == test.count()
    raw = np.array(train.select(*s.names).collect())
    at = {r["row_id"]: r["features"].toArray() for r in s.train.collect()}
    want = (raw - raw.mean(axis=0)) / np.where(raw.std(axis=0) > 0, raw.std(axis=0), np.inf)
    for i, row in enumerate(train.select("row_id").collect()):
        assert np.allclose(at[row["row_id"]], want[i], atol=1e-12)
    del staged[:]
    models.fit_pipeline(rows, models.OBJECTIVES["sprint"], lambda n, rows: models.gaussian_nb())
    assert staged == ["row_id"]                # naive Bayes reads its rows once: no vectors are written


def test_forests_keep_the_node_of_a_row_between_levels(split):
    kept = models.forest(3, max_depth=4)
    assert kept.getCacheNodeIds()
    walked = kept.copy().setCacheNodeIds(False)
    # the first line names the model
    drawn = lambda forest: [t.toDebugString.split("\n", 1)[1] for t in forest.fit(split.train).trees]
    assert drawn(kept) == drawn(walked)


def test_passes_add_up_the_lighter_child_only(split, monkeypatch):
    """The root's rows are counted once, then one child of two; curvatures are added up at the last level, for the leaves."""
    data, sizes, real = boosting.Together.of(split.train), [], boosting.Together.total
    monkeypatch.setattr(boosting.Together, "total", lambda *a, **k: sizes.append(real(*a, **k)) or sizes[-1])
    model = models.gbt(2, 3).fit_all(data)[0]
    one = len(data.cuts) * boosting.MAX_BINS
    assert [s.size / one for s in sizes[1:]] == [1 + 1, 2 + 1, 4 + 2 + 4, 1, 2 + 1, 4 + 2 + 4]
    # every row is in one leaf, and what was taken from the parent is what a count over rows gives
    bins = np.hstack([boosting._block(r, 1).bins for r in data.read(False).collect()])
    y = np.concatenate([boosting._block(r, 1).y for r in data.read(False).collect()])
    times = np.concatenate([boosting._block(r, 1).times for r in data.read(False).collect()])
    p, leaf = 1 / (1 + np.exp(-model.start)), boosting._down(model.trees[0].feature, model.trees[0].cut, bins, 3)
    for at in range(8):
        w = times * (leaf == at)
        assert np.isclose(model.trees[0].value[at], 0.1 * (w * (y - p)).sum() / (w * p * (1 - p)).sum() if w.sum() else 0.0, atol=1e-12)


def test_features_counted_in_pairs_have_their_own_sums():
    rng = np.random.default_rng(3)
    for width, slots in ((5, 1), (4, 2), (1, 4)):
        bins, slot = rng.integers(0, boosting.MAX_BINS, (width, 30_000)).astype(np.uint8), rng.integers(0, slots, 30_000).astype(np.uint8)
        rows, part = np.flatnonzero(rng.random(30_000) < 0.9), rng.normal(size=30_000)
        got = boosting._tables(bins, boosting._pairs(bins), slot[rows], rows, (part[rows], np.ones(len(rows))), slots)
        want = np.zeros((2, slots, width, boosting.MAX_BINS))
        for f in range(width):
            np.add.at(want[0, :, f], (slot[rows], bins[f, rows]), part[rows])
            np.add.at(want[1, :, f], (slot[rows], bins[f, rows]), 1.0)
        assert np.allclose(got, want, atol=1e-9)


def test_rows_of_megabytes_are_cut_into_small_row_groups(spark, split):
    """Passes hold a block at a time; no codec takes pages of many blocks off the heap."""
    import pyarrow.parquet as pq
    from worklens.storage import WIDE, stage
    rows = spark.range(40).coalesce(1).select("id", F.expr("transform(sequence(1, 131072), x -> sin(x * (id + 1)))").alias("v"))
    footer = lambda df: pq.ParquetFile(df.inputFiles()[0].removeprefix("file://")).metadata
    found = footer(stage(rows, options=WIDE))
    assert max(found.row_group(i).num_rows for i in range(found.num_row_groups)) <= 20
    assert {found.row_group(0).column(i).compression for i in range(2)} == {"ZSTD"}
    assert footer(boosting.Together.of(split.train).blocks).row_group(0).column(1).compression == "ZSTD"


def test_newer_scores_replace_the_older_files(split, monkeypatch):
    monkeypatch.setattr(boosting, "REFRESH", 1)
    data, dropped, real = boosting.Together.of(split.train), [], boosting.drop
    monkeypatch.setattr(boosting, "drop", lambda spark, path: dropped.append(path) or real(spark, path))
    models.gbt(4, 1).fit_all(data)
    assert len(set(dropped)) == 3 and set(data.files) == {False}
    assert data.read(False).map(lambda r: r[0]).sum() == sum(r["n"] for r in data.blocks.select("n").collect())
