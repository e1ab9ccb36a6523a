"""Branch semantics on small literal frames."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from worklens import columns as C
from worklens.operators import encode, features, metrics, neighbors, ordering, prep, profile, risk_scan, rollups, whatif
from worklens.sources import scan_csv, work_items
from worklens.sources.files import write_csv, write_parquet, write_text
from tests.conftest import SF

SPRINT = list(features.INPUTS.values())


def sprint_rows(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)],
                                 "row_id bigint, " + ", ".join(f"{c} double" for c in SPRINT))


#        planned completed pct days velocity blocked scope workload consec
ROWS = [(40, 30, 75, 5, 35, 1, 0, 90, 1),
        (0, 0, 0, 5, 35, 2, 3, 120, 2),      # nothing planned
        (40, 40, 100, 0, 0, 2, 3, 100, 0),   # gap 0, days 0, velocity 0
        (40, 50, 125, -2, 10, 4, -9, 60, 4)]  # negative gap and days


def test_core_feature_guards(spark):
    got = features.engineer_features(sprint_rows(spark, ROWS)).orderBy("row_id").collect()
    assert got[0]["Velocity_Efficiency"] == 35 / 40 and got[1]["Velocity_Efficiency"] == 1.0
    assert [r["Completion_Gap"] for r in got] == [10, 0, 0, -10]
    assert [r["Blocker_Severity"] for r in got] == [0.2, 0.4, 2.0, 4.0]
    assert got[1]["Scope_Pressure"] == 0.0 and got[2]["Scope_Pressure"] == 3 / 40
    assert got[2]["Sprint_Momentum"] == 0.0 and got[0]["Sprint_Momentum"] == 30 / 35
    assert [r["Recovery_Index"] for r in got] == [35 * 5 / 10 / 10, 1.0, 1.0, 1.0]
    assert got[3]["Workload_Stress"] == 2.4


def test_clipped_and_novel_bounds(spark):
    wide = ROWS + [(1, 0, 0, 13, 100, 0, 50, 0, 0), (100, 0, 0, -40, 1, 3, -500, 0, 0)]
    got = features.engineer_features(sprint_rows(spark, wide), "clipped", novel=True).orderBy("row_id").collect()
    assert got[4]["Velocity_Efficiency"] == 3.0 and got[4]["Scope_Pressure"] == 2.0 and got[5]["Scope_Pressure"] == -1.0
    assert got[2]["Recovery_Index"] == 0.0 and got[1]["Recovery_Index"] == 5.0
    assert got[3]["Blocker_Severity"] == 2.0            # 1 / |days|
    assert got[3]["Sprint_Momentum"] == 2.0
    assert got[4]["Days_Per_Remaining_SP"] == 10.0 and got[5]["Days_Per_Remaining_SP"] == -0.4
    assert got[5]["Overcommitment_Ratio"] == 3.0 and got[5]["Can_Finish_Score"] == -50.0
    assert got[4]["Can_Finish_Score"] == 50.0 and got[3]["Burn_Rate"] == 5.0


def test_missing_columns_count_as_zero(spark):
    df = sprint_rows(spark, ROWS[:1]).drop("Consecutive_Overloads", "Scope_Change")
    row = features.engineer_features(df).first()
    assert row["Workload_Stress"] == 0.0 and row["Scope_Pressure"] == 0.0
    assert prep.present(df, ["Scope_Change", "Percent_Done"]) == ["Percent_Done"]
    assert prep.align(df, ["Percent_Done", "Scope_Change"]).columns == ["row_id", "Percent_Done", "Scope_Change"]


def test_labels(spark):
    df = spark.createDataFrame([("Yes", 0.51, 0.3), ("No", 0.5, 0.31), ("yes", None, None), (None, 1.0, 1.0)],
                               "Success_Label string, Expected_Overload double, Risk_Flag double")
    got = prep.prepare(df).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0), (0, 0, 1), (0, 0, 0), (0, 1, 1)]
    assert prep.binarize_labels(df.drop("Risk_Flag")).columns == ["Success_Label", "Expected_Overload"]


def test_fill_missing_by_type(spark):
    df = spark.createDataFrame([(None, None, None), ("x", 2, 1.5)], "a string, b int, c double")
    assert [tuple(r) for r in prep.fill_missing(df).collect()] == [("0", 0, 0.0), ("x", 2, 1.5)]


def scan_frame(spark, n, fails, over, burn):
    return spark.createDataFrame([(int(i >= fails), int(i < over), int(i < burn), 1.0, 2.0, 90.0, 1) for i in range(n)],
                                 "Success_Label int, Expected_Overload int, Risk_Flag int, Blocked_Stories double, "
                                 "Days_Remaining_Sprint double, Current_Workload_Percent double, Consecutive_Overloads int")


@pytest.mark.parametrize("objective,share,severity", [
    (0, 15, "success"), (0, 16, "warning"), (0, 50, "warning"), (0, 51, "critical"),
    (1, 20, "success"), (1, 21, "warning"), (1, 45, "warning"), (1, 46, "critical"),
    (2, 25, "success"), (2, 26, "warning"), (2, 50, "warning"), (2, 51, "critical")])
def test_scan_thresholds(spark, objective, share, severity):
    counts = [0, 0, 0]
    counts[objective] = share
    name = (risk_scan.SPRINT, risk_scan.WORKLOAD, risk_scan.BURNOUT)[objective]
    rows = risk_scan.agent_scan(risk_scan.scan(scan_frame(spark, 100, *counts))).collect()
    assert {r["objective"]: r["severity"] for r in rows}[name] == severity


CHAINS = {(0, 0, 0): ["all_clear"], (1, 0, 0): ["sprint_only", "unblock"], (0, 1, 0): [], (0, 0, 1): [],
          (1, 1, 0): ["linked_sprint", "rebalance"], (0, 1, 1): ["linked_burnout", "recovery"],
          (1, 0, 1): ["sprint_only", "unblock"],
          (1, 1, 1): ["linked_sprint", "rebalance", "linked_burnout", "recovery"]}


@pytest.mark.parametrize("flags", list(itertools.product((0, 1), repeat=3)))
def test_chain_combinations(spark, flags):
    scanned = risk_scan.scan(scan_frame(spark, 10, *(10 * f for f in flags)))
    steps = risk_scan.decision_chain(scanned).orderBy("step").collect()
    want = ["Scan Objectives", *[risk_scan.CHAIN_TEXT[n][0] for n in CHAINS[flags]]]
    assert [s["label"] for s in steps] == want
    assert [s["step"] for s in steps] == list(range(1, len(want) + 1))
    health = risk_scan.health_score(scanned).first()
    assert health["health"] == 100 - 25 * sum(flags)


def test_person_score_variants(spark):
    df = scan_frame(spark, 10, 0, 0, 0).withColumns({"Assignee": F.lit("A"), "Current_Workload_Percent": F.lit(80.0)})
    assert rollups.assignee_risk(df).first()["score"] == 100.0
    heavy = df.withColumn("Current_Workload_Percent", F.lit(160.0))
    assert rollups.assignee_risk(heavy).first()["score"] == 85.0
    assert rollups.assignee_risk(heavy, variant="floored").first()["score"] == 70.0
    renamed = df.withColumnRenamed("Assignee", "Assignee_Resource")
    assert rollups.assignee_risk(renamed).columns[0] == "Assignee_Resource"


def test_hot_customers_take_the_split_path(spark):
    plain, split = work_items(spark, SF), work_items(spark, SF, hot_rows=12)
    assert plain.exceptAll(split).isEmpty() and split.exceptAll(plain).isEmpty()


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(700, 3.0), rng.normal(size=1400)])  # one value holds a third
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", float(v)) for i, v in enumerate(values)],
                               "row_id bigint, k string, v double")
    got = ordering.exact_quantiles(df, ["k"], "v", {"q10": 0.1, "q50": 0.5, "q95": 0.95}).collect()
    for row in got:
        part = [v for i, v in enumerate(values) if (i % 3 != 0) == (row["k"] == "a")]
        assert np.allclose([row["q10"], row["q50"], row["q95"]], np.quantile(part, [0.1, 0.5, 0.95]))
    every = ordering.exact_quantiles(df, [], "v", {"q": 0.5}).first()["q"]
    assert np.isclose(every, np.quantile(values, 0.5))
    ranks = ordering.hash_order_rank(df, ["k"]).groupBy("k").agg(
        F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count_distinct("rank").alias("n")).collect()
    assert all((r["lo"], r["hi"] + 1) == (0, r["n"]) for r in ranks)


def test_roc_auc_against_pairs(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.uniform(size=400) * 0.7 + y * 0.2, 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    diff = p[y == 1][:, None] - p[y == 0][None, :]
    want = ((diff > 0) + 0.5 * (diff == 0)).mean()
    assert np.isclose(metrics.roc_auc(df).first()["auc"], want)


def brute(points, queries, k, own):
    out = {}
    for qid, q in queries.items():
        d = sorted((int(np.floor(np.sqrt(((q - h) ** 2).sum()) * 1e6 + 0.5)), rid)
                   for rid, h in points.items() if not own or rid != qid)
        out[qid] = [rid for _, rid in d[:k]]
    return out


@pytest.mark.parametrize("own", [True, False])
def test_knn_equals_brute_force(spark, monkeypatch, own):
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 20)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(3)
    pts = np.concatenate([np.full((120, 3), 0.25), rng.normal(size=(240, 3)), rng.integers(0, 2, (60, 3)) * 1.0])
    rows = {i: p for i, p in enumerate(pts)}
    df = spark.createDataFrame([(i, *map(float, p), str(i % 2)) for i, p in rows.items()],
                               "row_id bigint, a double, b double, c double, tag string")
    got = neighbors.knn_join(df, df, ["a", "b", "c"], 5, payload="tag", exclude_self=own).collect()
    want = brute(rows, rows, 5, own)
    assert len(got) == len(rows)
    assert {r["query_id"]: [n["row_id"] for n in r["neighbors"]] for r in got} == want


@pytest.mark.parametrize(("top", "k"), [(1, 5), (4, 5), (4, 40)])
def test_knn_of_two_levels_equals_brute_force(spark, monkeypatch, top, k):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(4)
    pts = dict(enumerate(np.concatenate([np.full((30, 2), 0.5), rng.normal(size=(300, 2)), rng.normal(size=(40, 2)) * 1e-3 + 9.0])))
    asked = {1000 + i: q for i, q in enumerate(np.concatenate([rng.normal(size=(40, 2)) * 3, [[50.0, -50.0], [9.0, 9.0], [0.5, 0.5]]]))}
    frame = lambda rows: spark.createDataFrame([(i, *map(float, p)) for i, p in rows.items()], "row_id bigint, a double, b double")
    got = neighbors.knn_join(frame(asked), frame(pts), ["a", "b"], k, top_leaves=top, leaf_rows=10).collect()
    known = {i: p for i, p in pts.items() if i >= 30 or i <= k}
    assert {r["query_id"]: [n["row_id"] for n in r["neighbors"]] for r in got} == brute(known, asked, k, False)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_knn_search_measures_few_points_and_misses_none(shift):
    """The reach of a query leaves out most points of a cell, and none of its best, also far from the origin and with ties."""
    rng = np.random.default_rng(6)
    pts = np.concatenate([rng.normal(size=(900, 4)), rng.integers(0, 3, (100, 4)) * 1.0, np.full((24, 4), 0.5)]) + shift
    near = ((pts[:, None] - pts[None]) ** 2).sum(axis=2)
    reach = neighbors._reach(near, 1e-12, np.full(len(pts), 2.0 ** 53), 6)
    assert (near > reach[:, None]).mean() > 0.9
    ids = rng.permutation(len(pts)) * 3
    points = pa.array(pts.tolist(), pa.list_(pa.float64()))
    queries = pa.table({"query_id": ids, "home": ids, "f": points, "bound": np.full(len(pts), 2.0 ** 53), "hbs": np.ones(len(pts), dtype=np.int32)})
    history = pa.table({"row_id": ids, "f": points, "payload": pa.array(["1"] * len(pts))})
    got = neighbors._search(5, True, 4)(queries, history)
    rows = dict(zip(ids.tolist(), pts, strict=True))
    found = {i: [c["row_id"] for c in cand] for i, cand in zip(got["query_id"].to_pylist(), got["cand"].to_pylist(), strict=True)}
    assert found == brute(rows, rows, 5, True)


def test_knn_fewer_rows_than_k(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 5.0)], "row_id bigint, a double")
    got = {r["query_id"]: [n["row_id"] for n in r["neighbors"]]
           for r in neighbors.knn_join(df, df, ["a"], 5, exclude_self=True).collect()}
    assert got == {1: [2, 3], 2: [1, 3], 3: [2, 1]}


def test_knn_searches_a_point_once(spark, monkeypatch):
    """Queries at one point share a search; own rows, repeated ids and ids that the history lacks are kept apart."""
    monkeypatch.setattr(neighbors, "LEAF_ROWS", 20)
    asked, visit = [], neighbors._visit
    monkeypatch.setattr(neighbors, "_visit", lambda queries, *a: asked.append(queries.count()) or visit(queries, *a))
    spots = np.random.default_rng(5).normal(size=(12, 2))
    rows = {i: spots[i % 12] for i in range(600)}
    frame = lambda ids: spark.createDataFrame([(i, *map(float, rows[i])) for i in ids], "row_id bigint, a double, b double")
    df = frame(rows)
    got = neighbors.knn_join(df, df, ["a", "b"], 5, exclude_self=True).collect()
    assert len(got) == 600 and asked[0] == 12
    assert {r["query_id"]: [n["row_id"] for n in r["neighbors"]] for r in got} == brute(rows, rows, 5, True)
    got = neighbors.knn_join(df, frame(range(0, 600, 7)), ["a", "b"], 3).collect()
    assert {r["query_id"]: [n["row_id"] for n in r["neighbors"]] for r in got} == brute({i: rows[i] for i in range(0, 600, 7)}, rows, 3, False)


def test_knn_vote_zero_distance_and_ties(spark):
    rows = [(1, [(0.0, 5, "b"), (0.0, 6, "a"), (0.1, 7, "c"), (0.1, 8, "c"), (0.1, 9, "c")]),
            (2, [(0.5, 5, "b"), (0.5, 6, "a"), (1.0, 7, "c")]),
            (3, [(0.5, 5, "b"), (0.6, 6, "c"), (0.6, 7, "c")])]
    df = spark.createDataFrame(rows, "query_id bigint, neighbors array<struct<distance:double,row_id:bigint,payload:string>>")
    assert {r["query_id"]: r["predicted"] for r in neighbors.knn_vote(df).collect()} == {1: "a", 2: "a", 3: "c"}


def test_label_encode_unseen_is_zero(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    new = spark.createDataFrame([("c",), ("zz",), (None,)], "v string")
    assert [r["code"] for r in encode.label_encode(new, {"v": "code"}, fit_on=fit).collect()] == [2, 0, 0]


def test_dictionary_is_in_sorted_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "v string")
    got = encode.label_encode(df, {"v": "code"}).distinct().collect()
    assert {r["v"]: r["code"] for r in got} == {"a": 0, "b": 1, "c": 2}


def test_constant_column_is_centred(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "row_id bigint, x double")
    assert [r["x"] for r in encode.standardize(df, ["x"]).collect()] == [0.0, 0.0]


def test_optimal_path_notes_and_costs(spark):
    score = lambda x: F.greatest(F.lit(0.0), F.lit(0.9) - x["blocked"] * 0.2)
    df = sprint_rows(spark, [(40, 30, 75, 5, 35, 0, 0, 90, 1), (40, 30, 75, 5, 35, 2, 0, 90, 1)])
    got = {r["row_id"]: (r["action"], r["cost"]) for r in whatif.optimal_path(df, score).collect()}
    assert got == {0: ("none needed", None), 1: ("unblock stories", 2.0)}
    never = whatif.optimal_path(df, lambda x: F.lit(0.1) + x["days"] * 0.0).collect()
    assert {r["action"] for r in never} == {"combine actions"}


def test_monte_carlo_is_layout_independent(spark, prepared):
    score = whatif.rule_score()
    few = prepared.where("Sprint_Number = 3")
    one = whatif.monte_carlo(few.repartition(1), score, 30).collect()
    many = whatif.monte_carlo(few.repartition(13), score, 30).collect()
    assert sorted(one) == sorted(many) and len(one) == few.count()
    assert all(r["p5"] <= r["p50"] <= r["p95"] for r in one)


@pytest.mark.parametrize("parts", [1, 16])
def test_rollups_do_not_depend_on_layout(spark, prepared, parts):
    df = prepared.repartition(parts)
    assert sorted(rollups.assignee_risk(df).collect()) == sorted(rollups.assignee_risk(prepared).collect())
    narrow = df.select("row_id", "Success_Label")
    assert sorted(encode.stratified_folds(narrow, "Success_Label").collect()) == sorted(
        encode.stratified_folds(prepared.select("row_id", "Success_Label"), "Success_Label").collect())


def test_profile_nulls_and_distincts(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 1.5), (2, "x", 1.5)], "a int, b string, c double")
    got = {r["column_name"]: (r["spark_type"], r["nulls"], r["distinct_values"]) for r in profile.profile_columns(df).collect()}
    assert got == {"a": ("IntegerType", 0, 2), "b": ("StringType", 1, 1), "c": ("DoubleType", 1, 1)}
    assert profile.profile_columns(df, approximate=True).count() == 3


def test_sinks(spark, tmp_path, prepared):
    raw = work_items(spark, SF)
    write_csv(raw, str(tmp_path / "csv"))
    assert scan_csv(spark, str(tmp_path / "csv"), C.WORK_ITEM_SCHEMA).exceptAll(raw).isEmpty()
    inferred = scan_csv(spark, str(tmp_path / "csv"))
    assert inferred.columns == raw.columns
    write_parquet(raw, str(tmp_path / "pq"))
    scanned = risk_scan.scan(prepared)
    write_text(risk_scan.report_markdown(scanned), "report", str(tmp_path / "report"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "report")).collect())
    assert "### Findings" in text and "Health Score" in text


def test_cycle_time_falls_back_without_hours(spark, prepared):
    assert "avg_days_remaining" in rollups.cycle_time(prepared.drop("Resolution_Time_Hours")).columns


def test_fitted_model_as_score(spark, prepared):
    from worklens.operators import models
    few = prepared.where("Sprint_Number <= 4")
    pipeline, _, _ = models.fit_pipeline(prepared, models.OBJECTIVES["sprint"],
                                         lambda n, rows: models.logistic(n, weighted=True), balanced=True,
                                         extra=C.ENGINEERED + C.NOVEL)
    score = whatif.ModelScore(pipeline, (*C.BASE_SPRINT, *C.ENGINEERED, *C.NOVEL))
    steps = whatif.trajectory(few, score).collect()
    assert len(steps) == 3 * few.count() and all(0.05 <= r["p"] <= 0.98 for r in steps)
    paths = whatif.optimal_path(few, score).collect()
    assert {r["row_id"] for r in paths} == {r["row_id"] for r in few.select("row_id").collect()}
    assert all(r["new_p"] >= 0.8 for r in paths if r["cost"] is not None)


def test_pivot_keeps_people_outside_the_usual_list(spark, prepared):
    from pyspark.sql import functions as F
    from worklens.operators import rollups
    by = rollups.group_key(prepared)
    first = prepared.select(F.min(by)).first()[0]
    renamed = prepared.withColumn(by, F.when(F.col(by) == first, "Zoe").otherwise(F.col(by)))
    assert "Zoe" in rollups.workload_pivot(renamed).columns and first not in rollups.workload_pivot(renamed).columns


def test_text_sink_keeps_keys(prepared, tmp_path):
    scanned = risk_scan.scan(prepared, ["Sprint_Number"])
    path = str(tmp_path / "keyed")
    write_text(risk_scan.report_markdown(scanned, ["Sprint_Number"]), "report", path, ["Sprint_Number"])
    back = prepared.sparkSession.read.text(path)
    assert back.select("Sprint_Number").distinct().count() == scanned.count()
    assert back.where("value like '%Report auto-generated%'").count() == scanned.count()


def test_steps_of_the_neighbour_join_are_removed_and_dealt_in_slices(spark, monkeypatch):
    """Slices change no answer, and of the tables staged on the way only those that the answer reads are left."""
    rng = np.random.default_rng(4)
    pts = np.vstack([rng.normal(size=(400, 2)), np.ones((60, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "row_id bigint, a double, b double")
    join = lambda: {r["query_id"]: [(n["distance"], n["row_id"]) for n in r["neighbors"]] for r in
                    neighbors.knn_join(df, df, ["a", "b"], 4, exclude_self=True, top_leaves=top, leaf_rows=20).collect()}
    staged, dropped, stage, unstage = [], [], neighbors.stage, neighbors.unstage
    monkeypatch.setattr(neighbors, "stage", lambda *a: staged.append(stage(*a)) or staged[-1])
    monkeypatch.setattr(neighbors, "unstage", lambda *tables: dropped.extend(t._staged for t in tables) or unstage(*tables))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(axis=2))
    want = {i: sorted((np.floor(d[i, j] * 1e6 + 0.5) / 1e6, j) for j in range(len(pts)) if j != i)[:4] for i in range(len(pts))}
    for top, slices in ((4, 3), (1024, 2)):
        monkeypatch.setattr(neighbors, "SLICE_ROWS", len(pts) // slices)
        del staged[:], dropped[:]
        assert join() == want
        wide = [t for t in staged if "f" in t.columns]
        assert len(wide) >= 3 and {t._staged for t in wide} <= set(dropped) and len(dropped) == len(set(dropped))
